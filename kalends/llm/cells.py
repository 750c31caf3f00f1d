"""Cells that many sets may share: each member beside the first, then members of different components against each other."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dictionaries import pack, unpack
from .scratch import Scratch
from .words import mix, releasing

#: Rows and elements of a part of a large cell that one task joins with another part.
PART, ELEMENTS = 1024, 1 << 20
#: Members of a cell whose pairs are listed, so that a text moves once for a pair and not once for a cell.
SMALL = 32


def _stars_of(cell: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells and ids in order, and for each row the first row of its cell."""
    order = np.lexsort((ids, cell))
    cell, ids = cell[order], ids[order]
    new = np.ones(len(cell), bool)
    new[1:] = cell[1:] != cell[:-1]
    return cell, ids, np.maximum.accumulate(np.where(new, np.arange(len(cell)), 0)) if len(cell) else np.zeros(0, int)


def _cell_names(part: int, cell: np.ndarray) -> pa.Array:
    return pa.array(mix(cell + (np.uint64(part) << np.uint64(48))).view(np.int64))


def _packed_cells(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each part of the cells: the batch's cells with their first ids, packed (kind 0), and other members beside the first (kind 1)."""
        for b in batches:
            lists = b.column("cells")
            flat = np.asarray(lists.flatten()).view(np.uint64)
            ids = np.repeat(np.asarray(b.column("id")), np.asarray(lists.value_lengths()).astype(np.int64))
            part = (flat % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            bounds = np.searchsorted(part[order], np.arange(parts + 1))
            kinds, places, blobs, rows = [], [], [], []
            for k in np.flatnonzero(np.diff(bounds)).tolist():
                some = order[bounds[k] : bounds[k + 1]]
                cell, who, first = _stars_of(flat[some] >> np.uint64(16), ids[some])
                lead = first == np.arange(len(cell))
                kinds.append(0)
                places.append(k)
                blobs.append(pack(cell=np.diff(cell[lead], prepend=np.uint64(0)), id=who[lead]))
                rest = np.flatnonzero(who != who[first])
                if len(rest):
                    rows.append((_cell_names(k, cell[rest]), pa.array(who[first[rest]]), pa.array(who[rest])))
            n = sum(len(r[0]) for r in rows)
            none = pa.nulls(len(blobs), pa.int64())
            columns = [pa.concat_arrays([none, *(r[i] for r in rows)]) for i in range(3)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds + [1] * n, pa.int32()), pa.array(places + [None] * n, pa.int32()), pa.array(blobs + [None] * n, pa.binary()), *columns],
                ["kind", "part", "blob", "cell", "a", "b"],
            )

    return run


def _merged_cells(table: pa.Table) -> pa.Table:
    held = [unpack(x) for x in table["blob"].to_pylist()]
    cell, ids, first = _stars_of(np.concatenate([np.cumsum(x["cell"]) for x in held]), np.concatenate([x["id"] for x in held]))
    rest = np.flatnonzero(ids != ids[first])
    return pa.table({"cell": _cell_names(table["part"][0].as_py(), cell[rest]), "a": ids[first[rest]], "b": ids[rest]})


def cell_stars(sets: DataFrame, scratch: Scratch, cells=iter) -> DataFrame:
    """(cell, a, b) for each member b of a cell beside its first one, a, from rows (id, cells), or what `cells` makes of them in tasks.

    Cells are hashed into as many parts as there are shuffle partitions. A task sends each part one packed list of its
    cells with their first ids, whose other members stay with them; so a cell that many sets share weighs as much as
    any, and cells of one set, which are most, cost some bytes. Cells are told apart by 48 bits within a part: a
    clash only makes more candidates.
    """
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = _packed_cells(parts)
    coded = scratch.write(sets.mapInArrow(lambda batches: packed(cells(batches)), "kind int, part int, blob binary, cell long, a long, b long"), "coded", by="kind")
    lists, near = scratch.part(coded, "kind=0"), scratch.part(coded, "kind=1").select("cell", "a", "b")
    merged = lists.select("part", "blob").groupBy("part").applyInArrow(_merged_cells, "cell long, a long, b long")
    out = scratch.write(near.unionByName(merged), "stars")
    scratch.drop(coded)
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...] = ("cell", "p", "q")) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows that come in order of `keys`, in batches that hold groups whole, with the number of each row's group."""
    held: list[pa.RecordBatch] = []

    def out() -> tuple[pa.RecordBatch, np.ndarray]:
        b = pa.concat_batches(held)
        key = np.stack([np.asarray(b.column(c)) for c in keys])
        return b, np.concatenate([[0], np.cumsum((key[:, 1:] != key[:, :-1]).any(0))])

    for b in batches:
        if not b.num_rows:
            continue
        key = np.stack([np.asarray(b.column(c)) for c in keys])
        turns = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
        if held and any(held[-1].column(c)[-1].as_py() != b.column(c)[0].as_py() for c in keys):
            yield out()
            held = []
        if len(turns):
            held.append(b.slice(0, int(turns[-1])))
            yield out()
            held, b = [], b.slice(int(turns[-1]))
        held.append(b)
    if held:
        yield out()


class Components:
    """Labels that merge as links are found, so that only links that join something are kept."""

    def __init__(self, component: np.ndarray):
        _, self.of = np.unique(component, return_inverse=True)
        self.root = np.arange(self.of.max(initial=-1) + 1)

    def top(self, rows: np.ndarray) -> np.ndarray:
        return self.root[self.of[rows]]

    def join(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the links i-j, in order, join two components; these are joined."""
        keep = np.zeros(len(i), bool)
        for n, (x, y) in enumerate(zip(self.of[i].tolist(), self.of[j].tolist(), strict=True)):
            x, y = self.root[x], self.root[y]
            if x != y:
                keep[n] = True
                self.root[self.root == max(x, y)] = min(x, y)
        return keep


def overlaps(at: np.ndarray, flat: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many elements sets i and j share, pair by pair; set k is flat[at[k] : at[k + 1]], distinct."""
    n, out = np.diff(at), []
    size = np.cumsum(n[i] + n[j])
    cuts = np.unique(np.append(np.searchsorted(size, np.arange(0, size[-1] if len(size) else 0, 1 << 21)), [0, len(i)]))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        rows, label = np.concatenate([i[lo:hi], j[lo:hi]]), np.tile(np.arange(hi - lo), 2)
        whole = np.repeat(at[rows] - np.concatenate([[0], np.cumsum(n[rows])[:-1]]), n[rows]) + np.arange(n[rows].sum())
        label, value = np.repeat(label, n[rows]), flat[whole]
        order = np.lexsort((value, label))
        label, value = label[order], value[order]
        out.append(np.bincount(label[1:][(label[1:] == label[:-1]) & (value[1:] == value[:-1])], minlength=hi - lo))
    return np.concatenate([np.zeros(0, np.int64), *out])


def mixed_cells(stars: DataFrame, linked: DataFrame, weights: DataFrame, least: int, most: int | None, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(members, cells) of cells with members of different components and `least` to `most` of them.

    stars: (cell, a, b); linked: (node, component); weights: (id, elements). members: (cell, id, component); cells: (cell,
    rows, elements). Cells with the same members would give the same links: one of them is enough.
    """
    listed = stars.select("cell", F.col("b").alias("id")).unionByName(stars.select("cell", F.col("a").alias("id"))).distinct()
    listed = listed.join(linked.withColumnRenamed("node", "id"), "id", "left").select("cell", "id", F.coalesce("component", "id").alias("component"))
    listed = scratch.write(listed.join(weights.select("id", "elements"), "id"), "listed")
    same = [F.bit_xor(F.xxhash64("id")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("s2")]
    size = [F.count("*").alias("rows"), F.sum("elements").alias("elements")]
    mixed = listed.groupBy("cell").agg(F.min("component").alias("low"), F.max("component").alias("high"), *size, *same).where((F.col("low") < F.col("high")) & (F.col("rows") >= least))
    mixed = mixed.where(F.col("rows") <= most) if most else mixed
    return listed, scratch.write(mixed.groupBy("s1", "s2", "rows").agg(F.min("cell").alias("cell"), F.max("elements").alias("elements")).select("cell", "rows", "elements"), "mixed")


def pairs_within(stars: DataFrame, linked: DataFrame, weights: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct pairs (a, b) of members of different components in cells of three to SMALL members: no more than SMALL for a row."""
    listed, mixed = mixed_cells(stars, linked, weights, 3, SMALL, scratch)
    lists = listed.join(mixed.select("cell"), "cell").groupBy("cell").agg(F.collect_list(F.struct("id", "component")).alias("m"))
    others = lambda x: F.transform(F.filter("m", lambda y: (y["id"] > x["id"]) & (y["component"] != x["component"])), lambda y: F.struct(x["id"].alias("a"), y["id"].alias("b")))
    out = scratch.write(lists.select(F.explode(F.flatten(F.transform("m", others))).alias("p")).select("p.a", "p.b").distinct(), "within")
    scratch.drop(listed)
    return out


def links_across(stars: DataFrame, linked: DataFrame, held: DataFrame, column: str, compare: Callable, scratch: Scratch, least: int = 3) -> DataFrame:
    """Links (a, b) between members of a cell that are in different components after each was held against the first.

    held: (id, elements, `column`). Only cells of `least` members count, as smaller ones are done. A cell is dealt into
    parts of about PART members and ELEMENTS elements, and a task holds one part against one
    other, so no cell is one task's. `compare` (batch, group numbers, Components) gives the rows of the links it finds, no
    more than join components, so their number is bounded by that of the rows.
    """
    parts = int(stars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed, mixed = mixed_cells(stars, linked, held, least, None, scratch)
    share = F.greatest(F.ceil(F.col("rows") / PART), F.ceil(F.col("elements") / ELEMENTS))
    inside = listed.select("cell", "id", "component").join(mixed.select("cell", share.alias("parts")), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    places = inside.select("cell", "id", "component", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    p, q = F.least("part", "other"), F.greatest("part", "other")
    places = places.select("cell", "id", "component", p.alias("p"), q.alias("q"), (F.when(F.col("part") == p, 1).otherwise(0) + F.when(F.col("part") == q, 2).otherwise(0)).alias("side"))
    joined = places.join(held.select("id", column), "id").repartition(parts, "cell", "p", "q").sortWithinPartitions("cell", "p", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, group in whole_groups(batches):
            ids = np.asarray(b.column("id"))
            i, j = compare(b, group, Components(np.asarray(b.column("component"))))
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j])], ["a", "b"])

    out = scratch.write(joined.select("cell", "p", "q", "id", "component", "side", column).mapInArrow(releasing(run), "a long, b long").distinct(), "across")
    scratch.drop(listed)
    return out
