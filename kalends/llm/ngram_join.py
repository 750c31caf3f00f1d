"""N-gram Jaccard join over a count-vector R-tree."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import SMALL, Components, cell_stars, links_across, overlaps, pairs_within
from .components import connected_components
from .scratch import Scratch
from .words import distinct_sorted, mix, releasing, shingles, slices, split_words, word_hashes

#: Coordinates of a set's point, at least. A larger set's has one for two shingles, so that its summed minima still
#: tell unlike sets apart; a point folds to fewer coordinates by adding up.
COORDINATES = 128
#: Entries of an R-tree leaf.
LEAF = 32
#: Finer coordinates in each block of the directory.
FINE = 1 << 20


def size_classes(threshold: int, largest: int) -> list[tuple[int, int, int, int]]:
    """(first size, size after the last, blocks, spare blocks) of each class of set sizes.

    Two sets of at most s elements that link differ in at most floor(2 (100 - t) s / (100 + t)) elements. With one block
    and some spare ones more, their points agree in all coordinates of more blocks than are spare.
    """
    out, lo = [], 1
    while lo <= largest:
        hi = max(lo + 1, lo * 5 // 4, lo * 100 // threshold)
        most = 2 * (100 - threshold) * (hi - 1) // (100 + threshold)
        spare = 1 + most // 8 if most else 0
        out.append((lo, hi, most + 1 + spare, spare))
        lo = hi
    return out


def needed(threshold: int, na, nb):
    """The least overlap of linked sets with na and nb elements."""
    return -(-threshold * (na + nb) // (100 + threshold))


def point_columns(offsets: np.ndarray, hashes: np.ndarray, k: int, threshold: int) -> dict[str, pa.Array]:
    """Set size, fingerprint, point and directory cells for each row's shingle set.

    A set names only its cells with elements if at most the spare ones are empty, as linked sets then agree in one that
    isn't; a set with more empty ones names all.
    """
    rows = len(offsets) - 1
    row, sh = distinct_sorted(*shingles(offsets, hashes, k))
    n = np.bincount(row, minlength=rows)
    at = np.concatenate([[0], np.cumsum(n)])
    some = np.flatnonzero(n)
    prints = []
    for salt in (1, 2):
        total = np.zeros(rows, np.uint64)
        if len(sh):
            total[some] = np.add.reduceat(mix(sh ^ mix(np.array([salt], np.uint64))), at[some])
        prints.append(pa.array(total.view(np.int64)))
    width = np.maximum(COORDINATES, 1 << np.ceil(np.log2(np.maximum(n, 2) / 2)).astype(np.int64)) * (n > 0)
    corner = np.concatenate([[0], np.cumsum(width)])
    point = np.bincount(corner[row] + (sh >> np.uint64(6)).astype(np.int64) % np.maximum(width, 1)[row], minlength=corner[-1])
    owners, cells = [], []
    classes = size_classes(threshold, int(n.max(initial=0)) * 100 // threshold + 1)
    spare = np.array([c[3] for c in classes] or [0])
    starts = np.array([c[0] for c in classes] or [1])
    for ahead in (0, 1):
        own = np.searchsorted(starts, n, "right") - 1 + ahead
        used = (n > 0) & (own < len(classes))
        if ahead:  # a partner may be larger, up to size / threshold
            used &= starts[np.minimum(own, len(starts) - 1)] * threshold <= 100 * n
        blocks = np.array([c[2] for c in classes] or [0])[np.minimum(own, len(starts) - 1)] * used
        blocks[blocks == 1] = 0  # no difference is allowed: such sets are equal or not linked
        held = blocks > 0
        inside = held[row]
        r, s = row[inside], sh[inside]
        first = np.concatenate([[0], np.cumsum(blocks)])
        sums = np.zeros(first[-1], np.uint64)
        if len(s):
            block = ((s >> np.uint64(33)) * blocks[r].astype(np.uint64)) >> np.uint64(31)
            slot = first[r] + block.astype(np.int64)  # ascending, as s ascends within a row
            begin = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
            # a sum of one random number for each coordinate times its count: a hash of the block's count vector
            sums[slot[begin]] = np.add.reduceat(mix((s & np.uint64(FINE - 1)) + np.uint64(7919)), begin)
        filled = np.zeros(first[-1], bool)
        if len(s):
            filled[slot[begin]] = True
        owner = np.repeat(np.arange(rows), blocks)
        empty = blocks - np.bincount(owner[filled], minlength=rows)
        named = filled | (empty > spare[np.minimum(own, len(spare) - 1)])[owner]
        place = (np.arange(first[-1]) - first[owner]).astype(np.uint64)
        cells.append(mix(sums + mix((own[owner].astype(np.uint64) << np.uint64(32)) + place))[named])
        owners.append(owner[named])
    owner, cell = np.concatenate(owners), np.concatenate(cells)
    order = np.argsort(owner, kind="stable")
    bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))])
    return {
        "n": pa.array(n),
        "f1": prints[0],
        "f2": prints[1],
        "point": pa.ListArray.from_arrays(pa.array(corner, pa.int32()), pa.array(point, pa.int32())),
        "cells": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(cell[order].view(np.int64))),
    }


def _points(k: int, threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            offsets, codes, words = split_words(b.column("text"))
            out = {"id": b.column("id"), "key": b.column("key")} | point_columns(offsets, word_hashes(words)[codes] if len(words) else np.zeros(0, np.uint64), k, threshold)
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return releasing(run)


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and distinct shingle hashes of each text's set."""
    offsets, codes, words = split_words(texts)
    row, sh = distinct_sorted(*shingles(offsets, word_hashes(words)[codes] if len(words) else np.zeros(0, np.uint64), k))
    return np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(texts)))]), sh


class Leaf:
    """Some sets of like size as points, and the corner of their box."""

    def __init__(self, rows: np.ndarray, at: np.ndarray, flat: np.ndarray):
        self.rows, self.n = rows, np.diff(at)[rows]
        self.width = max(COORDINATES, 1 << int(np.ceil(np.log2(max(int(self.n.max()), 2) / 2))))
        place = np.concatenate([flat[at[r] : at[r + 1]] for r in rows.tolist()]) >> np.uint64(6)
        owner = np.repeat(np.arange(len(rows)), self.n)
        points = np.bincount(owner * self.width + (place % np.uint64(self.width)).astype(np.int64), minlength=len(rows) * self.width)
        self.at_width = {self.width: points.reshape(len(rows), self.width).astype(np.int32)}

    def points(self, width: int) -> np.ndarray:
        if width not in self.at_width:
            self.at_width[width] = self.at_width[self.width].reshape(len(self.rows), -1, width).sum(1)
        return self.at_width[width]

    def corner(self, width: int) -> np.ndarray:
        return self.points(width).max(0)


def tree_pairs(left: list[Leaf], right: list[Leaf], threshold: int, components: Components) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of different components whose summed coordinate minima reach the needed overlap, leaf by leaf.

    A pair of leaves is left out if both are wholly in one component, or if even the minima of their boxes' corners don't
    reach what their smallest sets need.
    """
    for x, y in itertools.product(left, right):
        tops = np.union1d(components.top(x.rows), components.top(y.rows))
        least = needed(threshold, int(x.n.min()), int(y.n.min()))
        width = min(x.width, y.width)
        if len(tops) < 2 or np.minimum(x.corner(width), y.corner(width)).sum() < least:
            continue
        p, q = x.points(width), y.points(width)
        step = max(1, (1 << 22) // (len(q) * width))
        overlap = np.concatenate([np.minimum(p[i : i + step, None], q[None]).sum(2) for i in range(0, len(p), step)])
        i, j = np.nonzero(overlap >= needed(threshold, x.n[:, None], y.n[None]))
        i, j = x.rows[i], y.rows[j]
        apart = components.top(i) != components.top(j)
        yield i[apart], j[apart]


def _across(k: int, threshold: int):
    def compare(b: pa.RecordBatch, group: np.ndarray, components: Components) -> tuple[np.ndarray, np.ndarray]:
        """Links between the two parts of each cell in the batch that join components."""
        at, flat = shingle_sets(b.column("text"), k)
        n, top, side = np.diff(at), components.top(np.arange(b.num_rows)), np.asarray(b.column("side"))
        found = [(np.zeros(0, np.int64),) * 2]

        def leaves(rows: np.ndarray) -> list[Leaf]:
            rows = rows[np.lexsort((n[rows], top[rows]))]
            return [Leaf(rows[i : i + LEAF], at, flat) for i in range(0, len(rows), LEAF)]

        bounds = np.searchsorted(group, np.arange(group[-1] + 2))
        for lo, hi in itertools.pairwise(bounds.tolist()):
            here = np.arange(lo, hi)
            left = leaves(here[(side[lo:hi] & 1) > 0])
            right = left if (side[lo:hi] == 3).all() else leaves(here[(side[lo:hi] & 2) > 0])
            for i, j in tree_pairs(left, right, threshold, components):
                both = overlaps(at, flat, i, j)
                like = 100 * both >= threshold * (n[i] + n[j] - both)
                i, j = i[like], j[like]
                new = components.join(i, j)
                found.append((i[new], j[new]))
        return tuple(np.concatenate(f) for f in zip(*found, strict=True))

    return compare


def _verify(k: int, threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "x", 4 << 20):
            (p, x), (q, y) = shingle_sets(b.column("x"), k), shingle_sets(b.column("y"), k)
            m, pairs = b.num_rows, np.arange(b.num_rows)
            both = overlaps(np.concatenate([p, q[1:] + p[-1]]), np.concatenate([x, y]), pairs, pairs + m)
            keep = 100 * both >= threshold * (np.diff(p) + np.diff(q) - both)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return releasing(run)


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, threshold: int = 90) -> DataFrame:
    """Components of documents whose sets of word shingles have a Jaccard similarity of `threshold` percent or more.

    Returns doc id, n_shingles (size of the set) and component_id (smallest id that links reach, itself included) for
    every row. The method: shingles are hashed into groups, and a set's counts by group are its point. Linked sets
    differ little, so their points agree wholly in at least one block of coordinates; equal blocks (cells) are the
    directory of the tree and an equi-join key. Within a cell, R-tree leaves bound the overlap of their members by
    summed coordinate minima, and what survives is verified on whole texts.

    Equal sets become one row with a number of its own first. In a first pass each member of a cell is held against the
    cell's first member only: first against the smallest of these, then against those that are still in other
    components. A second pass holds members of different components of a cell against each other: pair by pair in cells
    of SMALL members at most, in parts of bounded size in larger ones, where components are joined as links are found. So
    pairs inside a linked group are never listed and no link is lost.
    Sets are compared by 64-bit shingle hashes.

    Null or wordless texts have n_shingles 0 and are linked with nothing. A null id never serves as component_id;
    such a row gets its equal sets' component, or null. Repeated rows fall in one component. Rows that share an id but
    not the text are sets of their own, each with its links; they are in one component only if links make them so. Other
    columns are not returned, so clashing names don't matter. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    points = scratch.write(slim.mapInArrow(_points(words, threshold), "id long, key long, n long, f1 long, f2 long, point array<int>, cells array<long>"), "points")
    light = scratch.write(points.select("id", "n", "f1", "f2"), "light")
    # (place, key) names a text: rows without id are told apart by their texts alone
    place = F.coalesce("id", F.lit(-1).cast("long")).alias("place")
    filled = points.where("n > 0").select(place, "key", "id", "n", "f1", "f2", "point", "cells")
    sets = filled.groupBy("f1", "f2", "n").agg(F.min("id").alias("first_id"), F.min(F.struct("place", "key")).alias("first"))
    sets = scratch.write(sets.select("f1", "f2", "n", "first_id", "first.place", "first.key", F.monotonically_increasing_id().alias("set")), "sets")
    names = sets.select("place", "key", "set", "n")

    single = filled.where("size(cells) > 0").select("place", "key", "cells").join(names.drop("n").hint("merge"), ["place", "key"])
    stars = cell_stars(single.select(F.col("set").alias("id"), "cells"), scratch)
    pairs = scratch.write(stars.select("a", "b").distinct(), "pairs")
    named = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct().withColumnRenamed("a", "set")
    named = scratch.write(names.join(named.hint("merge"), "set", "left_semi"), "named")
    shapes = scratch.write(filled.select("place", "key", "point").join(named.hint("merge"), ["place", "key"]).dropDuplicates(["set"]).select(F.col("set").alias("id"), "n", "point"), "shapes")
    scratch.drop(points)
    texts = slim.select(place, "key", "text").join(named.hint("merge"), ["place", "key"]).dropDuplicates(["set"])
    texts = scratch.write(texts.select(F.col("set").alias("id"), F.col("n").alias("elements"), "text"), "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        """Of pairs in a table: those whose whole texts link."""
        one, two = texts.select(F.col("id").alias("a"), F.col("text").alias("x")), texts.select(F.col("id").alias("b"), F.col("text").alias("y"))
        both = pairs.hint("merge").join(one, "a").hint("merge").join(two, "b").select("a", "b", "x", "y")
        return scratch.write(both.mapInArrow(_verify(words, threshold), "a long, b long"), "verified")

    one, two = (shapes.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("point").alias(f"p{x}")) for x in "ab")
    # sizes that differ more can't link, so that one of two points has as many coordinates, or twice as many
    near_sizes = 100 * F.least("na", "nb") >= threshold * F.greatest("na", "nb")
    width = F.least(F.size("pa"), F.size("pb"))
    fold = lambda c: F.when(F.size(c) == width, F.col(c)).otherwise(F.zip_with(F.slice(c, F.lit(1), width), F.slice(c, width + 1, width), lambda x, y: x + y))
    bound = F.aggregate(F.zip_with(fold("pa"), fold("pb"), lambda p, q: F.least(p, q)), F.lit(0), lambda s, v: s + v)
    reach = bound * (100 + threshold) >= threshold * (F.col("na") + F.col("nb"))

    def bounded(pairs: DataFrame) -> DataFrame:
        return pairs.join(one, "a").join(two, "b").where(near_sizes).where(reach).select("a", "b")

    near = scratch.write(bounded(pairs), "near")
    scratch.drop(pairs)

    lowest = scratch.write(near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "lowest")
    links = verified(lowest)
    linked = scratch.write(connected_components(links, scratch), "linked")
    ends = [linked.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab"]
    apart = near.join(ends[0], "a", "left").join(ends[1], "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
    links = scratch.write(links.unionByName(verified(scratch.write(apart.select("a", "b").join(lowest, ["a", "b"], "left_anti"), "apart"))), "links")
    linked = scratch.write(connected_components(links, scratch), "linked")
    within = bounded(pairs_within(stars, linked, texts, scratch)).join(near, ["a", "b"], "left_anti")
    links = scratch.write(links.unionByName(verified(scratch.write(within, "within"))), "links")
    linked = scratch.write(connected_components(links, scratch), "linked")
    links = links.unionByName(links_across(stars, linked, texts, "text", _across(words, threshold), scratch, SMALL + 1))
    linked = scratch.write(connected_components(links, scratch), "components")
    groups = sets.join(linked.withColumnRenamed("node", "set"), "set", "left").select("f1", "f2", "n", "first_id", F.coalesce("component", "set").alias("group"))
    least = groups.groupBy("group").agg(F.min("first_id").alias("component_id"))
    classes = scratch.write(groups.join(least, "group").select("f1", "f2", "n", "component_id"), "classes")
    scratch.keep_only(light, classes)
    out = light.where("n > 0").join(classes, ["f1", "f2", "n"]).select("id", "n", "component_id")
    none = light.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return out.unionByName(none).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
