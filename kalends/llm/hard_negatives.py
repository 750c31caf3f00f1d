"""Hard negatives by a Voronoi-partitioned distributed kNN join: pivots cut the space, bounds decide which candidates meet which anchors."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import Scratch
from .topk_search import _matrix

#: Anchors of a block and candidates of a shard: what one task scores at once.
BLOCK, SHARD = 512, 4096
#: Pivots at most, so that the table of bounds between groups and cells has at most the square of this many rows.
PIVOTS = 256


def _assign(pivots: np.ndarray, top: int, width: int):
    """Adds each row's cell (its nearest pivot) and distance as a candidate, and group and distance as an anchor, in the augmented space.

    A candidate has one more component, sqrt(top - norm), so that all have the same length; an anchor has 0 there and is
    stretched to that length too, which leaves the order of its scores. A smaller distance between an anchor and a candidate
    then is a larger inner product.
    """
    more = np.sqrt(np.maximum(top - (pivots**2).sum(1), 0.0))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column("v"), width).astype(np.float64)
            norm = (m**2).sum(1)
            products = m @ pivots.T
            own = products + np.sqrt(np.maximum(top - norm, 0.0))[:, None] * more[None, :]
            cell, group = own.argmax(1), products.argmax(1)
            at = np.arange(len(m))
            dist = np.sqrt(np.maximum(2.0 * top - 2.0 * own[at, cell], 0.0))
            stretch = np.sqrt(np.divide(top, norm, out=np.zeros_like(norm), where=norm > 0))
            gdist = np.sqrt(np.maximum(stretch**2 * norm + top - 2.0 * stretch * products[at, group], 0.0))
            arrays = [*(batch.column(c) for c in ("id", "label", "asks", "v")), pa.array(cell, pa.int32()), pa.array(dist), pa.array(group, pa.int32()), pa.array(gdist), pa.array(stretch)]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "label", "asks", "v", "cell", "dist", "group", "gdist", "stretch"])

    return run


def _scorer(anchors: pa.Table, rows: pa.Table):
    """Candidates in order of id: their ids, and by label of anchors the anchors' numbers, scores of all candidates, and which have that label."""
    rows = rows.take(pc.sort_indices(rows["id"]))
    width = max((pc.max(pc.list_value_length(t["v"])).as_py() or 0) for t in (anchors, rows))
    q, m = _matrix(anchors["v"], width), _matrix(rows["v"], width)
    if width and float(np.abs(m).max()) * float(np.abs(q).max()) * width < 2.0**53:
        q, m = q.astype(np.float64), m.astype(np.float64)  # exact, and faster
    codes = pa.chunked_array([*anchors["label"].chunks, *rows["label"].chunks], pa.string()).combine_chunks().dictionary_encode().indices.to_numpy()
    of_anchor, of_row = codes[: len(q)], codes[len(q) :]
    ids, own = rows["id"].to_numpy(), anchors["id"].to_numpy()

    def each() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for label in np.unique(of_anchor):
            mine, same = np.flatnonzero(of_anchor == label), of_row == label
            for lo in range(0, len(mine), 64):
                some = mine[lo : lo + 64]
                yield from zip(some, q[some] @ m.T, [same] * len(some), strict=True)

    return ids, own, each()


def _positives(k: int):
    """The k best candidates of each anchor's own label in a shard, as far as they reach its `least`."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64),) * 3]
        if anchors.num_rows and rows.num_rows:
            ids, own, scored = _scorer(anchors, rows)
            least = pc.fill_null(anchors["least"], -(2**62)).to_numpy()
            for a, scores, same in scored:
                fit = np.flatnonzero(same & (ids != own[a]) & (scores >= least[a]))
                best = fit[np.argsort(-scores[fit], kind="stable")[:k]]
                found.append((np.full(len(best), own[a]), ids[best], scores[best].astype(np.int64)))
        return pa.table([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found, strict=True)], ["anchor_id", "vec_id", "score"])

    return run


def _negatives(k: int, low: int, high: int):
    """The k best candidates of other labels in a shard for each anchor and positive, among scores in the positive's band."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64),) * 5]
        if anchors.num_rows and rows.num_rows:
            ids, own, scored = _scorer(anchors, rows)
            bands = anchors["bands"].to_pylist()
            for a, scores, same in scored:
                other = np.flatnonzero(~same)
                other = other[np.argsort(-scores[other], kind="stable")]
                falling = -scores[other]
                for band in bands[a]:
                    positive, most = band["score"], band["score"] * high // 100
                    least = max(-(-positive * low // 100), band["least"])
                    first, end = np.searchsorted(falling, -most, "left"), np.searchsorted(falling, -least, "right")
                    best = other[first : min(end, first + k)]
                    found.append((np.full(len(best), own[a]), np.full(len(best), band["positive_id"]), np.full(len(best), positive), ids[best], scores[best].astype(np.int64)))
        names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
        return pa.table([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found, strict=True)], names)

    return run


class VoronoiJoin:
    """Candidates and anchors dealt by pivots: which cells may serve which groups, given how near or far the rows sought can be."""

    def __init__(self, scratch: Scratch, rows: DataFrame, pivots: np.ndarray, top: int, width: int):
        schema = "id long, label string, asks boolean, v array<long>, cell int, dist double, group int, gdist double, stretch double"
        self.spark, self.top = scratch.spark, top
        self.rows = scratch.write(rows.mapInArrow(_assign(pivots, top, width), schema), "rows")
        more = np.sqrt(np.maximum(top - (pivots**2).sum(1), 0.0))
        self.between = np.sqrt(np.maximum(2.0 * top - 2.0 * (pivots @ pivots.T + np.outer(more, more)), 0.0))
        self.slack = 1e-6 * (1 + math.sqrt(top))  # far above the rounding of distances
        self.anchors = self.rows.where("asks").dropDuplicates(["id", "label", "v"]).select("id", "label", "v", "group", "gdist", "stretch")
        self.cells = self.rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi")).collect()  # a row for each pivot
        self.groups = self.anchors.groupBy("group").agg(F.count("*").alias("n")).collect()

    def distance(self, score: Column) -> Column:
        """The distance at which a candidate has that score with the anchor of the row."""
        own = F.when(F.col("stretch") > 0, self.top).otherwise(0)
        return F.sqrt(F.greatest(own + self.top - 2.0 * F.col("stretch") * score, F.lit(0.0)))

    def seeds(self) -> tuple[DataFrame, DataFrame]:
        """Each group's bounds to its own cell, of which one shard is enough for a first threshold."""
        cells = {c["cell"]: c for c in self.cells}
        pairs = [(g["group"], g["group"], -1.0, math.inf) for g in self.groups if g["group"] in cells]
        return self._tables(pairs, {g["group"]: -(-cells[g["group"]]["n"] // SHARD) for g in self.groups if g["group"] in cells})

    def bounds(self, anchors: DataFrame, nearest: Column, farthest: Column) -> tuple[DataFrame, DataFrame]:
        """Which candidates of a cell, by their distance from its pivot, can lie between `nearest` and `farthest` from an anchor of a group."""
        reach = anchors.groupBy("group").agg(F.min(nearest - F.col("gdist")).alias("near"), F.max(farthest + F.col("gdist")).alias("far")).collect()
        pairs, n = [], {}
        for r in reach:
            for c in self.cells:
                between = self.between[r["group"], c["cell"]]
                first = max(between - r["far"], r["near"] - between) - self.slack
                last = r["far"] + between + self.slack
                if c["hi"] >= first and c["lo"] <= last:
                    pairs.append((r["group"], c["cell"], float(first), float(last)))
                    n[r["group"]] = n.get(r["group"], 0) + c["n"]
        return self._tables(pairs, {g: -(-m // SHARD) for g, m in n.items()})

    def _tables(self, pairs: list[tuple], shards: dict[int, int]) -> tuple[DataFrame, DataFrame]:
        blocks = {g["group"]: -(-g["n"] // BLOCK) for g in self.groups}
        groups = self.spark.createDataFrame([(g, blocks[g], s) for g, s in shards.items()], "group int, blocks int, shards int")
        return self.spark.createDataFrame([p for p in pairs if p[0] in shards], "group int, cell int, first double, last double"), groups

    def join(self, anchors: DataFrame, tables: tuple[DataFrame, DataFrame], local, schema: str, one_shard: bool = False) -> DataFrame:
        """Anchors with the candidates that bounds let meet them, a block and a shard at a time. Both tables are bounded by PIVOTS squared."""
        pairs, groups = (F.broadcast(t) for t in tables)
        near = self.rows.select("id", "label", "v", "cell", "dist").join(pairs, "cell").where(F.col("dist").between(F.col("first"), F.col("last"))).join(groups, "group")
        # under new names within the plan, as anchors come from the same table
        near = near.select(*[F.col(c).alias(c) for c in ("id", "label", "v", "group")], F.pmod(F.xxhash64("id", "v"), F.col("shards")).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        shard = F.explode(F.sequence(F.lit(0), F.lit(0) if one_shard else F.col("shards") - 1)).alias("shard")
        asking = anchors.join(groups, "group").select(*anchors.columns, F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int").alias("block"), shard)
        if one_shard:
            near = near.where("shard = 0")
        keys = ["group", "block", "shard"]
        return asking.groupBy(*keys).cogroup(near.groupBy(*keys)).applyInArrow(local, schema)


def hard_negatives(table: DataFrame, label: Column, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): rows of other labels that score well, but not too well.

    Components are floor(scale * x), x as double; a score is the integer inner product with the anchor. Positives are an anchor's
    first rows of its own label, by falling score and then id; negatives of a positive the first rows of other labels whose score lies between
    `low` and `high` percent of the positive's.

    Vectors get one more component that gives all the same length, so that the nearest are the best. At most PIVOTS rows are pivots; a
    row belongs to its nearest one's cell, an anchor to its nearest one's group. Each group's own cell gives first thresholds;
    with them, the distances of anchors and candidates from their pivots bound those between the two, and only
    candidates that can still serve one of a group's anchors are sent to it. There they are scored exactly, BLOCK anchors
    and SHARD candidates at a time, however many share a vector, a label or a cell; the best of all shards are merged.

    Rows whose id, label or vector is null, or whose vector holds a null, NaN or infinity, take no part. Shorter vectors count as padded
    with zeros. Repeated rows are each candidates, and none for an anchor with their id; a repeated anchor or positive is
    answered once. An anchor alone in its label has no rows, nor has a positive with a negative score. An empty table gives no rows.
    """
    spark = table.sparkSession
    scratch = Scratch(spark, "negatives")
    x = F.col(vector_col)
    fit = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    ints = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    rows = table.where(F.col(id_col).isNotNull() & x.isNotNull() & label.isNotNull()).where(fit)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("string").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("asks"), ints.alias("v"))
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda s, c: s + c * c)
    top, width, asking = rows.agg(F.max(norm), F.max(F.size("v")), F.sum(F.col("asks").cast("int"))).first()
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not asking:
        return spark.createDataFrame([], out)
    n_pivots = min(PIVOTS, max(8, -(-asking // BLOCK)))
    drawn = rows.select("v").orderBy(F.xxhash64("id", F.lit(2)), "id").limit(n_pivots).collect()
    pivots = np.zeros((n_pivots, width))
    for i, r in enumerate(drawn):
        pivots[i, : len(r["v"])] = r["v"]
    space = VoronoiJoin(scratch, rows, np.unique(pivots[: len(drawn)], axis=0), top, width)

    scored = "anchor_id long, vec_id long, score long"
    anchors = space.anchors.withColumn("least", F.lit(None).cast("long"))
    first = space.join(anchors, space.seeds(), _positives(positives), scored, one_shard=True)
    least = first.groupBy(F.col("anchor_id").alias("id")).agg(F.when(F.count("*") >= positives, F.min("score")).alias("least"))
    anchors = scratch.write(space.anchors.join(least, "id", "left"), "anchors")
    tables = space.bounds(anchors, F.lit(0.0), F.coalesce(space.distance(F.col("least")), F.lit(math.inf)))
    order = W.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    best = space.join(anchors, tables, _positives(positives), scored).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= positives)
    best = scratch.write(best.select("anchor_id", F.col("vec_id").alias("positive_id"), "score").where("score >= 0").distinct(), "positives")

    banded = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"

    def asking_with(bands: DataFrame) -> DataFrame:
        lists = bands.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("positive_id", "score", "least")).alias("bands"))
        return space.anchors.join(lists, "id")

    local = _negatives(negatives, low, high)
    bands = best.withColumn("least", F.ceil(F.col("score") * low / 100).cast("long") - 1)
    seeded = space.join(asking_with(bands), space.seeds(), local, banded, one_shard=True)
    reached = seeded.groupBy("anchor_id", "positive_id").agg(F.when(F.count("*") >= negatives, F.min("negative_score")).alias("_least"))
    bands = bands.join(reached, ["anchor_id", "positive_id"], "left").withColumn("least", F.greatest("least", "_least")).drop("_least")
    asked = scratch.write(asking_with(bands), "asked")
    most = F.array_max(F.transform("bands", lambda b: b["score"])) * high / 100 + 1
    fewest = F.array_min(F.transform("bands", lambda b: b["least"]))
    tables = space.bounds(asked, space.distance(most), space.distance(fewest))
    order = W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    found = space.join(asked, tables, local, banded).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
