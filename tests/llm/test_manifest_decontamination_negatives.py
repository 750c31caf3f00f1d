"""Merkle manifest, benchmark decontamination and hard negatives against plain Python and DuckDB, also on hard cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ..conftest import same_as_duckdb
from .conftest import SF, low, pairs_of
from kalends.llm import decontamination as D
from kalends.llm import hard_negatives as N
from kalends.llm import queries as Q
from kalends.llm.merkle import BLOCK, fold_path, leaf_of, manifest_digest, merkle_manifest

BOTH = pytest.mark.parametrize("which", ["real", "hard"])


@pytest.fixture
def docs(request, which):
    return request.getfixturevalue(which)


# --- 13: Merkle manifest


def sha(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def plain_leaf(*fields):
    return sha(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def plain_way(levels, i):
    out = []
    for nodes in levels[:-1]:
        run = nodes[i // 8 * 8 : i // 8 * 8 + 8]
        out.append((i % 8, run[: i % 8] + run[i % 8 + 1 :]))
        i //= 8
    return out


def plain_manifest(rows):
    groups: dict = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"], plain_leaf(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]), r))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in langs:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = plain_tree([x[1] for x in groups[g]])
    top = plain_tree([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for i, (d, leaf, r) in enumerate(groups[g]):
            way = plain_way(trees[g], i) + plain_way(top, k)
            changed = d is not None and zlib.crc32(str(d).encode()) % 3 == 0
            node = plain_leaf(d, r["source"], g, r["n_chars"], low(r["text"]) if changed and r["text"] is not None else r["text"])
            for at, others in way:
                node = sha(*others[:at], node, *others[at:])
            root = top[-1][0]
            out.append((d, leaf, trees[g][-1][0], root, sha(*(x for _, o in way for x in o)), node, node == root))
    return Counter(out)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@BOTH
def test_manifest_equals_plain_python(docs):
    got = Counter(tuple(r) for r in manifest_digest(docs).select(COLUMNS).collect())
    assert got == plain_manifest(docs.collect())


@pytest.mark.parametrize("n", [1, 8, 9, BLOCK, BLOCK + 1])
def test_manifest_of_trees_of_many_heights(spark, n):
    """One group of n rows beside one of a single row: blocks and blocks of blocks at their edges."""
    rows = [(i, f"Text {i}", "en" if i < n else None, "s", 6) for i in range(n + 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert Counter(tuple(r) for r in manifest_digest(df).select(COLUMNS).collect()) == plain_manifest(df.collect())


def test_manifest_ways_lead_to_the_root_and_nothing_else_does(spark, real):
    made = merkle_manifest(real, ["doc_id", "text"], by="source", carry={"text": F.col("text")})
    assert made.where(fold_path(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0
    changed = made.withColumn("other", leaf_of(F.col("doc_id"), F.concat("text", F.lit("."))))
    assert changed.where(fold_path(F.col("other"), F.col("path")) == F.col("root")).count() == 0


def test_manifest_of_an_empty_table(empty):
    assert manifest_digest(empty).count() == 0


def test_leaves_tell_null_from_empty_and_fields_apart(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), (None, "a"), ("", "a"), ("-", "a"), ("1:a", ""), ("a1:", "a")], "x string, y string")
    assert df.select(leaf_of(F.col("x"), F.col("y")).alias("h")).distinct().count() == 7


# --- 11: benchmark decontamination


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def plain_hits(docs, items, size):
    windows: dict = {}
    for i, t in items:
        w = plain_words(t)
        for s in range(max(1, len(w) - size + 1)) if w else ():
            windows.setdefault(tuple(w[s : s + size]), set()).add(i)
    lengths = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w, hit, found = plain_words(t), set(), set()
        for n in lengths:
            for s in range(len(w) - n + 1):
                if items_of := windows.get(tuple(w[s : s + n])):
                    hit |= {*range(s, s + n)}
                    found |= items_of
        names = sorted(str(i) for i in found if i is not None)
        out.append((d, len(w), len(hit), len(names), sha(",".join(names)), bool(hit)))
    return Counter(out)


def hard_items(spark, docs):
    """Passages of the documents, in other cases and with other separators; short, empty, null and repeated items."""
    texts = [t for _, t in pairs_of(docs) if t]
    r = random.Random(3)
    items = [(None, texts[0]), (5, None), (6, ""), (7, " .,; "), (8, "Two words"), (8, "one"), (9, "漢字かな"), (10, "no such passage in any of the documents at all, is there")]
    for n in range(30):
        w = r.choice(texts).split()
        s = r.randrange(max(1, len(w) - 20))
        items.append((100 + n % 25, "--".join(w[s : s + r.randrange(3, 20)]).upper()))
    return spark.createDataFrame(items, "item_id long, text string")


@BOTH
@pytest.mark.parametrize("limit", [D.BROADCAST_BYTES, 0])
def test_hits_equal_plain_python(spark, docs, limit):
    items = hard_items(spark, docs)
    got = D.contamination_digest(D.benchmark_hits(docs, items, size=10, broadcast_bytes=limit))
    expected = plain_hits(pairs_of(docs), [(r["item_id"], r["text"]) for r in items.collect()], 10)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()) == expected
    assert sum(n for row, n in expected.items() if row[-1]) > 5


def test_queries_equal_oracles(spark):
    for name in ("op11_decontamination", "op12_hard_negatives"):
        assert same_as_duckdb(Q.QUERIES[name](spark, SF), Q.ORACLES[name], SF) > 0


def test_long_texts_are_whole_rows_of_stretches(spark):
    """Windows at, before and behind the ends of stretches, in a text of many stretches."""
    words = [f"w{i}" for i in range(5 * D.STRIDE + 7)]
    spots = [0, D.STRIDE - 10, D.STRIDE - 9, D.STRIDE - 1, D.STRIDE, 2 * D.STRIDE - 5, len(words) - 10]
    items = spark.createDataFrame([(n, " ".join(words[s : s + 10])) for n, s in enumerate(spots)], "item_id int, text string")
    row = D.benchmark_hits(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string"), items).first()
    covered = {w for s in spots for w in range(s + 1, s + 11)}
    assert {w for s in row["spans"] for w in range(s["first"], s["last"] + 1)} == covered
    assert all(b["first"] > a["last"] + 1 for a, b in zip(row["spans"], row["spans"][1:], strict=False))
    assert row["items"] == [str(n) for n in range(len(spots))]


def test_removal_of_spans_and_documents(spark):
    item = "The quick brown fox jumps over the lazy dog, twice a day."
    rows = [(1, f"Kept before: {item.upper()} Kept behind!", "x"), (2, "Untouched.", "y"), (None, item, "z"), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    hits = D.benchmark_hits(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    cut = {r["doc_id"]: r for r in D.decontaminate(docs, hits).collect()}
    assert cut[1]["text"] == "Kept before. Kept behind!"
    assert (cut[None]["text"], cut[2]["text"], cut[4]["text"], cut[1]["spans"]) == (".", "Untouched.", None, "x")
    assert sorted(r["doc_id"] for r in D.decontaminate(docs, hits, remove="documents").collect()) == [2, 4]


def test_hits_on_empty_tables(spark, empty, real):
    items = spark.createDataFrame([], "item_id long, text string")
    assert D.benchmark_hits(empty, items).count() == 0
    assert D.benchmark_hits(real, items).where("size(spans) > 0").count() == 0
    assert D.benchmark_hits(real, items).count() == real.count()


# --- 12: hard negatives


def vectors(spark, n=700, seed=1, hot=0):
    """Clustered vectors of a few labels; bad rows, rows twice, and `hot` copies of one vector."""
    r = random.Random(seed)
    centers = [[r.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [c + r.gauss(0, 0.4) for c in centers[i % 6]], (i * 7 + i // 6) % 4) for i in range(n)]
    rows += [(10_000 + i, centers[0], i % 4) for i in range(hot)]
    rows += [(3, None, 1), (None, centers[1], 1), (5, [1.0, None], 2), (100, centers[2], None), (6, [float("nan")] * 8, 0), (7, [float("inf")] * 8, 0), (8, [], 1), (9, [0.5, 0.25], 2), rows[200], rows[17]]
    return spark.createDataFrame([(*row, "x", 1) for row in rows], "vec_id long, embedding array<double>, label int, group string, dist int")


def plain_negatives(rows, k, m):
    from math import floor, isfinite

    fit = [(r["vec_id"], r["label"], [floor(256 * x) for x in r["embedding"]]) for r in rows if r["vec_id"] is not None and r["label"] is not None and r["embedding"] is not None and all(x is not None and isfinite(x) for x in r["embedding"])]
    out = set()
    for a, la, va in fit:
        if a % 20:
            continue
        scored = [(-sum(x * y for x, y in zip(va, v, strict=False)), i, lab) for i, lab, v in fit if i != a]
        scored.sort()
        for s, p in {(s, i) for s, i, lab in [x for x in scored if x[2] == la][:k]}:
            band = [(t, i) for t, i, lab in scored if lab != la and 30 * -s <= 100 * -t <= 90 * -s][:m]
            out |= {(a, p, n + 1, i, -s, -t) for n, (t, i) in enumerate(band)}
    return out


@pytest.mark.parametrize(("block", "shard", "hot"), [(512, 4096, 0), (4, 50, 0), (4, 64, 400)])
def test_negatives_equal_brute_force(spark, monkeypatch, block, shard, hot):
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "SHARD", shard)
    df = vectors(spark, hot=hot)
    got = [tuple(r) for r in N.hard_negatives(df, F.col("label"), F.col("vec_id") % 20 == 0, positives=3, negatives=4).collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain_negatives(df.collect(), 3, 4)


def test_bounds_leave_out_candidates_without_loss(spark, monkeypatch):
    """Far clusters: their candidates aren't sent to groups that they can't serve."""
    monkeypatch.setattr(N, "BLOCK", 4)
    monkeypatch.setattr(N, "SHARD", 64)
    sent = []
    bounds = N.VoronoiJoin.bounds
    monkeypatch.setattr(N.VoronoiJoin, "bounds", lambda self, *a: sent.append((self, out := bounds(self, *a))) or out)
    r = random.Random(4)
    rows = []
    for i in range(900):  # six directions at right angles, each row close to one
        v = [(10.0 if c == i % 6 else 0.0) + r.gauss(0, 0.3) for c in range(8)]
        rows.append((i, [x / sum(y * y for y in v) ** 0.5 for x in v], i // 6 % 3))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {tuple(r) for r in N.hard_negatives(df, F.col("label"), F.col("vec_id") % 20 == 0, positives=2, negatives=3).collect()}
    assert got == plain_negatives(df.collect(), 2, 3)
    shares = [space.rows.select("cell", "dist").join(pairs, "cell").where("dist between first and last").count() / (space.rows.count() * len(space.groups)) for space, (pairs, _) in sent]
    assert max(shares) < 0.6


def test_negatives_without_anchors_or_rows(spark):
    df = vectors(spark, n=210)
    assert N.hard_negatives(df, F.col("label"), F.col("vec_id") == -1).count() == 0
    assert N.hard_negatives(df.limit(0), F.col("label"), F.col("vec_id") % 20 == 0).count() == 0
    assert N.hard_negatives(df, F.lit("one"), F.col("vec_id") % 20 == 0).count() == 0
