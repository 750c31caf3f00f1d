"""Substring dedup: paragraphs cut by content, MinHash banding, exact Jaccard, components."""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cells import Components, cell_stars, links_across, overlaps
from .components import connected_components
from .scratch import Scratch
from .words import distinct_sorted, mix, releasing, shingles, slices, split_words, word_hashes

#: A paragraph starts where a word's hash is the least of as many words on either side, and after LONGEST words.
REACH, LONGEST = 5, 64
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def tune_bands(similarity: int, recall: float, rows: int) -> int:
    """The fewest bands of `rows` MinHash values that let a pair at `similarity` percent collide with probability `recall`."""
    return math.ceil(math.log(1 - recall) / math.log(1 - (similarity / 100) ** rows))


def paragraph_starts(offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Where paragraphs start among all words. Equal passages in different texts are cut alike, but for their ends."""
    n = len(hashes)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    after = np.concatenate([hashes[1:], np.zeros(1, np.uint64)]) if n else hashes.copy()
    after[offsets[1:][np.diff(offsets) > 0] - 1] = 0  # no text's cuts depend on what text comes next
    g = mix(hashes + np.uint64(3) * mix(after))
    least = np.ones(n, bool)
    for j in range(1, REACH + 1):
        same = row[j:] == row[:-j]
        least[j:] &= ~same | (g[j:] < g[:-j])
        least[:-j] &= ~same | (g[:-j] <= g[j:])
    least[offsets[:-1][np.diff(offsets) > 0]] = True
    # a word that repeats REACH times on end is a run: it starts a paragraph, what follows it does, and nothing within
    turn = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])])) if n else np.zeros(0, int)
    length = np.diff(np.append(turn, n))
    runs = turn[length >= REACH]
    within = np.repeat(length >= REACH, length)
    least[within] = False
    least[runs] = True
    ends = runs + length[length >= REACH]
    least[ends[ends < n]] = True
    starts = np.flatnonzero(least)
    place = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    return np.flatnonzero(place % LONGEST == 0)


def paragraphs(texts: pa.Array) -> dict[str, np.ndarray]:
    """Row, first word (in its text), words and content hash of each paragraph, with all words' hashes and bounds."""
    offsets, codes, words = split_words(texts)
    h = word_hashes(words)[codes] if len(words) else np.zeros(0, np.uint64)
    starts = paragraph_starts(offsets, h)
    n = np.diff(np.append(starts, len(h)))
    place = (np.arange(len(h)) - np.repeat(starts, n)).astype(np.uint64)
    content = mix(np.add.reduceat(mix(h + place * np.uint64(0x9E3779B97F4A7C15)), starts) + n.astype(np.uint64)) if len(h) else h
    row = np.searchsorted(offsets, starts, "right") - 1
    return {"row": row, "at": starts - offsets[row], "n": n, "hash": content, "words": h, "starts": starts}


def _occurrences(least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            p = paragraphs(b.column("text"))
            keep = p["n"] >= least_words
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(p["row"][keep])), pa.array(p["at"][keep], pa.int32()), pa.array(p["n"][keep], pa.int32()), pa.array(p["hash"][keep].view(np.int64))], ["id", "at", "n", "hash"])

    return releasing(run)


def _bands(k: int, similarity: int, bands: int, rows: int, least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            p = paragraphs(b.column("text"))
            bounds = np.append(p["starts"], len(p["words"]))
            long = p["n"] >= least_words
            row, sh = shingles(bounds, p["words"], k)
            inside = long[row]
            row, sh = distinct_sorted(row[inside], sh[inside])
            if not len(row):
                continue
            begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            n = np.diff(np.append(begin, len(row)))
            whose, at = np.unique(p["hash"][row[begin]], return_index=True)
            keys = [mix(np.add.reduceat(mix(sh), begin))]
            for band in range(bands):
                key = np.full(len(begin), band, np.uint64)
                for r in range(rows):
                    key = mix(key + np.minimum.reduceat(mix(sh ^ mix(np.array([band * rows + r], np.uint64))), begin))
                keys.append(key)
            # a set so small that one element more or less takes it under the similarity is like its equals only: the
            # hash of the whole set is its one cell; equal sets of any size agree in all bands
            small = (100 * n < similarity * (n + 1))[at]
            cells = np.stack(keys, 1)[at]
            named = np.concatenate([small[:, None], np.repeat(~small[:, None], bands, 1)], 1)
            ends = np.concatenate([[0], np.cumsum(named.sum(1))])
            yield pa.RecordBatch.from_arrays([pa.array(whose.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(cells[named].view(np.int64)))], ["id", "cells"])

    return releasing(run)


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            p = paragraphs(b.column("text"))
            wanted = b.column("hashes")
            flat, at = np.asarray(wanted.flatten()).view(np.uint64), np.asarray(wanted.offsets) - wanted.offsets[0].as_py()
            _, keep = np.unique(p["hash"], return_index=True)
            keep = keep[np.isin(p["hash"][keep], flat)] if at[-1] else keep[:0]
            bounds = np.append(p["starts"], len(p["words"]))
            row, sh = distinct_sorted(*shingles(bounds, p["words"], k))
            first = np.searchsorted(row, np.arange(len(p["starts"]) + 1))
            out = [sh[first[i] : first[i + 1]].view(np.int64) for i in keep]
            yield pa.RecordBatch.from_arrays([pa.array(p["hash"][keep].view(np.int64)), pa.array(out, pa.list_(pa.int64()))], ["hash", "set"])

    return releasing(run)


def _across(similarity: int):
    def compare(b: pa.RecordBatch, group: np.ndarray, components: Components) -> tuple[np.ndarray, np.ndarray]:
        """Links between the two parts of each cell in the batch that join components.

        Sizes and the bits that one set has and the other lacks bound the overlap first; what survives is compared exactly.
        """
        lists, side = b.column("set"), np.asarray(b.column("side")).astype(np.int64)
        at, flat = np.asarray(lists.offsets).astype(np.int64) - lists.offsets[0].as_py(), np.asarray(lists.flatten()).view(np.uint64)
        n = np.diff(at)
        order = np.lexsort((n, group))
        size, kind = n[order], side[order]
        bits = np.zeros((len(n), 4), np.uint64)
        owner = np.repeat(np.arange(len(n)), n)
        np.bitwise_or.at(bits, (owner, ((flat >> np.uint64(6)) & np.uint64(3)).astype(np.int64)), np.uint64(1) << (flat & np.uint64(63)))
        bits = bits[order]
        # in order of size, the partners of a row are those after it that are not too large
        key = group[order] * (1 << 32) + size
        end = np.searchsorted(key, group[order] * (1 << 32) + 100 * size // similarity, "right")
        count = end - np.arange(len(n)) - 1
        total = np.concatenate([[0], np.cumsum(count)])
        cuts = np.unique(np.append(np.searchsorted(total, np.arange(0, total[-1], 1 << 18), "left"), [0, len(n)]))
        found = [(np.zeros(0, np.int64),) * 2]
        for lo, hi in itertools.pairwise(cuts.tolist()):
            i = np.repeat(np.arange(lo, hi), count[lo:hi])
            j = np.arange(len(i)) - (total[i] - total[lo]) + i + 1
            keep = (components.top(order[i]) != components.top(order[j])) & (((kind[i] & 1) & (kind[j] >> 1)) | ((kind[j] & 1) & (kind[i] >> 1))).astype(bool)
            i, j = i[keep], j[keep]
            most = np.minimum(size[i] - np.bitwise_count(bits[i] & ~bits[j]).sum(1, dtype=np.int64), size[j] - np.bitwise_count(bits[j] & ~bits[i]).sum(1, dtype=np.int64))
            keep = most * (100 + similarity) >= similarity * (size[i] + size[j])
            i, j = order[i[keep]], order[j[keep]]
            both = overlaps(at, flat, i, j)
            like = 100 * both >= similarity * (n[i] + n[j] - both)
            i, j = i[like], j[like]
            new = components.join(i, j)
            found.append((i[new], j[new]))
        return tuple(np.concatenate(f) for f in zip(*found, strict=True))

    return compare


def repeated_paragraphs(
    docs: DataFrame, scratch: Scratch | None = None, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: int = 80,
    recall: float = 0.99, band_rows: int = 1, least_words: int = 5, least_run: int = 20,
) -> DataFrame:
    """Paragraphs that occur, equal or nearly so, in two documents or more.

    Returns doc id, start_word, n_words, first_doc_id and first_start (the class's first occurrence by id and place)
    and kept (this is it) for each occurrence. Paragraphs are cut where content says so, 6 to 64 words long, so a
    passage in the midst of lines is cut alike wherever it stands. Equal paragraphs (by 64-bit hash of lower-cased
    words) form one content. Contents collide in MinHash bands over `words`-word shingles, tuned so that a pair at
    `similarity` collides with probability `recall`; members of a bucket are held against its first by exact Jaccard
    of shingle sets, then members of different components against each other, so no pair that collides is lost. Links
    make components. Only runs of adjoining repeated paragraphs of `least_run` words together
    count, so chance repeats of a few words don't.

    Null or empty texts have no paragraphs. Rows with a null id are left out (they can't be named); rows that repeat
    with one id are one document. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "substring-dedup")
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    seen = scratch.write(slim.mapInArrow(_occurrences(least_words), "id long, at int, n int, hash long"), "seen")
    bands = tune_bands(similarity, recall, band_rows)
    stars = cell_stars(slim, scratch, _bands(words, similarity, bands, band_rows, least_words))
    near = scratch.write(stars.select("a", "b").distinct(), "near")

    wanted = scratch.write(near.select(F.col("a").alias("hash")).unionByName(near.select(F.col("b").alias("hash"))).distinct(), "wanted")
    where = seen.join(wanted.hint("merge"), "hash").groupBy("hash").agg(F.min("id").alias("id")).groupBy("id").agg(F.collect_list("hash").alias("hashes"))
    sets = scratch.write(slim.join(where.hint("merge"), "id").mapInArrow(_sets(words), "hash long, set array<long>").dropDuplicates(["hash"]), "sets")
    one, two = (sets.select(F.col("hash").alias(x), F.col("set").alias(f"s{x}")) for x in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    links = near.join(one, "a").join(two, "b").where(100 * both >= similarity * (F.size("sa") + F.size("sb") - both)).select("a", "b")
    links = scratch.write(links, "links")
    held = sets.select(F.col("hash").alias("id"), F.size("set").alias("elements"), "set")
    more = links_across(stars, connected_components(links, scratch), held, "set", _across(similarity), scratch)
    linked = scratch.write(connected_components(links.unionByName(more), scratch), "linked")
    for table in (stars, near, sets):
        scratch.drop(table)

    often = seen.groupBy("hash").agg(F.count("*").alias("times")).where("times > 1")
    classes = often.join(linked.withColumnRenamed("node", "hash"), "hash", "full").select("hash", F.coalesce("component", "hash").alias("class"))
    classes = scratch.write(classes, "classes")
    members = scratch.write(seen.join(classes, "hash").select("id", "at", "n", "class"), "members")
    firsts = members.groupBy("class").agg(F.min(F.struct("id", "at")).alias("first"), F.max("id").alias("last")).where("first.id < last").select("class", "first")
    firsts = scratch.write(firsts, "firsts")
    scratch.keep_only(members, firsts)
    found = members.join(firsts, "class").select("id", "at", "n", F.col("first.id").alias("first_id"), F.col("first.at").alias("first_at")).dropDuplicates(["id", "at"])
    along = W.partitionBy("id").orderBy("at")
    found = found.withColumn("new", (F.coalesce(F.lag(F.col("at") + F.col("n")).over(along), F.lit(-1)) != F.col("at")).cast("int"))
    found = found.withColumn("run", F.sum("new").over(along.rowsBetween(W.unboundedPreceding, 0)))
    found = found.withColumn("run_words", F.sum("n").over(W.partitionBy("id", "run"))).where(F.col("run_words") >= least_run)
    kept = (F.col("id") == F.col("first_id")) & (F.col("at") == F.col("first_at"))
    return found.select(F.col("id").alias(id_col), F.col("at").alias("start_word"), F.col("n").alias("n_words"), F.col("first_id").alias("first_doc_id"), F.col("first_at").alias("first_start"), kept.alias("kept"))


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of `spans` (first word, words), each with the white space that follows it."""
    raw = text.encode()
    at = [m.start() for m in WORD.finditer(raw)] + [len(raw)]
    out, done = [], 0
    for first, n in sorted(spans):
        out.append(raw[done : at[first]])
        done = max(done, at[min(first + n, len(at) - 1)])
    return b"".join([*out, raw[done:]]).decode()


def drop_repeated_paragraphs(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with all but the first occurrence of each repeated paragraph cut from the texts, and no other change."""
    spans = found.where("not kept").groupBy(id_col).agg(F.collect_list(F.struct("start_word", "n_words")).alias("_spans"))
    both = docs.join(spans.hint("merge"), id_col, "left")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t if not s or t is None else cut_words(t, [(x["start_word"], x["n_words"]) for x in s]) for t, s in zip(b.column(text_col).to_pylist(), b.column("_spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text_col else b.column(c) for c in names], names)

    return both.mapInArrow(run, docs.select(*[F.col(c).cast("string").alias(c) if c == text_col else c for c in names]).schema)
