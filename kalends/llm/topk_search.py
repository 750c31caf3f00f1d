"""Exact top-k search by inner product with MaxScore pruning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a shard and of a block of queries; one task scores a block against a shard.
SHARD, BLOCK = 8192, 1024


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows as integers, padded with zeros to `width`."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(lists.value_lengths()).astype(np.int64)
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = np.asarray(lists.flatten())
    return out


def max_score(vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and scores of the k best rows for `query`, ties to smaller ids; rows whose id is `own` are left out.

    Terms are dimensions; `high` and `low` are their largest and smallest components in the shard. The heads of the
    strongest terms' postings, scored wholly, give a first threshold. Terms whose bounds together stay below it are
    non-essential: no row reaches the threshold by them alone. Essential postings are traversed for all rows; only
    rows that stay competitive with the other terms' bounds are probed for the rest.
    """
    bounds = np.maximum(query * high, query * low)
    order = np.argsort(bounds, kind="stable")
    foreign = np.flatnonzero(ids != own)
    if len(foreign) <= 4 * k:
        rows = foreign
    else:
        strongest = vectors[foreign, order[-1]] * query[order[-1]]
        seeds = foreign[np.argpartition(strongest, -4 * k)[-4 * k :]]
        threshold = np.sort(vectors[seeds] @ query)[-k]
        below = int(np.searchsorted(np.cumsum(np.maximum(bounds[order], 0)), threshold, "left"))
        essential, other = order[below:], order[:below]
        partial = vectors[:, essential] @ query[essential]
        rest = bounds[other].sum()
        leaders = foreign[np.argpartition(partial[foreign], -4 * k)[-4 * k :]]
        threshold = max(threshold, np.sort(partial[leaders] + vectors[np.ix_(leaders, other)] @ query[other])[-k])
        rows = foreign[partial[foreign] + rest >= threshold]
    scores = vectors[rows] @ query
    best = np.lexsort((ids[rows], -scores))[:k]
    return rows[best], scores[best]


def _cell(k: int):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if vectors.num_rows and queries.num_rows:
            width = max(pc.max(pc.list_value_length(t["v"])).as_py() for t in (vectors, queries))
            m, q = _matrix(vectors["v"], width), _matrix(queries["v"], width)
            ids, own = np.asarray(vectors["id"]), np.asarray(queries["id"])
            if width and float(np.abs(m).max()) * float(np.abs(q).max()) * width < 2.0**53:
                m, q = m.astype(np.float64), q.astype(np.float64)  # exact, and faster
            high, low = m.max(0), m.min(0)
            for i in range(len(q)):
                rows, scores = max_score(m, ids, q[i], own[i], k, high, low) if width else (np.flatnonzero(ids != own[i])[np.argsort(ids[ids != own[i]])][:k], np.zeros(min(k, int((ids != own[i]).sum()))))
                out["query_id"].append(np.full(len(rows), own[i]))
                out["vec_id"].append(ids[rows])
                out["score"].append(scores.astype(np.int64))
        return pa.table({c: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for c, v in out.items()})

    return run


def topk_search(table: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows with the largest integer inner products for each row where `is_query` holds, itself left out.

    Returns query_id, rank (from 1), vec_id and score, with components floor(scale * x), x as double. Rows are dealt
    into shards and queries into blocks, both of bounded size; each block meets each shard in one task, where MaxScore
    finds the shard's k best, and the k best of all shards are merged. Ties go to smaller ids.

    Rows whose id or vector is null, or whose vector holds a null, NaN or infinity, take no part. Shorter vectors
    count as padded with zeros. Repeated rows are each candidates (none for a query with their id); a query id that repeats with
    equal vectors is answered once. Fewer than k candidates are all returned; an empty table gives no rows. Exact while
    scores fit in 64 bits.
    """
    spark = table.sparkSession
    x = F.col(vector_col)
    ints = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    fit = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    rows = table.where(F.col(id_col).isNotNull() & x.isNotNull()).where(fit).select(F.col(id_col).cast("long").alias("id"), ints.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    n, asking = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("asks").cast("int")), F.lit(0))).first()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-asking // BLOCK))
    shard, block = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")
    candidates = rows.select("id", "v", shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    queries = rows.where("asks").dropDuplicates(["id", "v"]).select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), block.alias("block"))
    found = candidates.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInArrow(_cell(k), "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
