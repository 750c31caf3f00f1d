"""Substring dedup and the pipeline's stages against brute force."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from kalends.llm.substring_dedup import cut_words, drop_repeated_paragraphs, paragraphs, repeated_paragraphs, tune_bands
from kalends.llm.words import mix, shingles, word_hashes

from .conftest import SCHEMA, SF, find_classes, low, pairs_of, words_of


def grams(words, k=5):
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)}


def brute_runs(rows, k=5, similarity=0.8, least=5, run=20, recall_counts=True):
    """Repeated paragraphs, by comparing every content with every other one."""
    seen, content = [], {}
    for i, text in rows:
        p = paragraphs(pa.array([text or ""], pa.string()))
        w = words_of(low(text))
        for at, n in zip(p["at"].tolist(), p["n"].tolist(), strict=True):
            if n >= least:
                key = tuple(w[at : at + n])
                content.setdefault(key, grams(list(key), k))
                seen.append((i, at, n, key))
    keys = sorted(content)
    links = []
    for x, a in enumerate(keys):
        for b in keys[x + 1 :]:
            one, two = content[a], content[b]
            if min(len(one), len(two)) >= similarity * max(len(one), len(two)) and len(one & two) >= similarity * len(one | two):
                links.append((a, b))
    top = find_classes(keys, links)
    members = defaultdict(list)
    for i, at, n, key in seen:
        members[top[key]].append((i, at, n))
    found = defaultdict(set)
    for m in members.values():
        if len({i for i, _, _ in m}) > 1:
            for i, at, n in m:
                found[i].add((at, n))
    out = set()
    for i, spans in found.items():
        groups, last = [], None
        for at, n in sorted(spans):
            if at != last:
                groups.append([])
            groups[-1].append((at, n))
            last = at + n
        out |= {(i, at, n) for g in groups if sum(n for _, n in g) >= run for at, n in g}
    return out


@pytest.mark.parametrize("which", ["real", "hard"])
def test_repeated_paragraphs_equal_brute_force(request, which):
    docs = request.getfixturevalue(which)
    if which == "real":
        docs = docs.where("doc_id < 60")
    rows = sorted({r for r in pairs_of(docs) if r[0] is not None}, key=lambda r: r[0])
    got = {(r["doc_id"], r["start_word"], r["n_words"]) for r in repeated_paragraphs(docs).collect()}
    expected = brute_runs(rows)
    # exact copies are always found; near ones collide with the tuned probability
    assert got <= expected
    assert len(got) >= 0.97 * len(expected)


def test_near_copies_are_found_in_buckets_whose_first_is_unlike_both(spark):
    """40 pairs of contents of 34 words, Jaccard 0.94, which all share a phrase of 20 words: buckets of the phrase hold all pairs."""
    r = random.Random(3)
    names = [f"w{i}" for i in range(4000)]
    h = word_hashes(pa.array(names))
    index = {w: i for i, w in enumerate(names)}

    def next_words(words):
        """The words that make the least rise in what a cut looks at: where it rises, nothing is cut."""
        rise = mix(h[index[words[-1]]] + np.uint64(3) * mix(h))
        low = mix(h[index[words[-2]]] + np.uint64(3) * mix(h[[index[words[-1]]]]))[0] if len(words) > 1 else np.uint64(0)
        return [names[i] for i in np.argsort(rise) if rise[i] > low][:40]

    def grown(words, n):
        while len(words) < n:
            words = [*words, r.choice(next_words(words))]
        return words

    phrase = grown(["w0"], 20)
    rows = []
    while len(rows) < 80:
        text = grown(phrase, 33)
        for last in r.sample(next_words(text), 2):
            rows.append((len(rows), " ".join([*text, last])))
        if any(len(paragraphs(pa.array([t]))["at"]) > 1 for _, t in rows[-2:]):
            del rows[-2:]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute_runs(rows)
    assert len(expected) == 80
    got = repeated_paragraphs(docs).collect()
    assert {(x["doc_id"], x["start_word"], x["n_words"]) for x in got} == expected
    assert {x["first_doc_id"] for x in got} == set(range(0, 80, 2))


def test_planted_passage_is_found_and_cut_once(spark):
    r = random.Random(1)
    text = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    passage = text(120)
    rows = [(i, f"{text(80)} {passage} {text(80)}" if i % 5 == 0 else text(200)) for i in range(1, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = repeated_paragraphs(docs)
    assert {x["doc_id"] for x in found.collect()} == {i for i, _ in rows if i % 5 == 0}
    cut = dict(pairs_of(drop_repeated_paragraphs(docs, found)))
    for i, t in rows:
        if i % 5 or i == 5:
            assert cut[i] == t
        else:
            assert 160 <= len(words_of(cut[i])) <= 160 + 20


def test_cut_words_and_bands():
    assert cut_words("a b  c\nd e", [(1, 2)]) == "a d e"
    assert cut_words("é b", [(0, 1), (1, 1)]) == ""
    assert 1 - (1 - 0.8) ** tune_bands(80, 0.99, 1) >= 0.99


def test_near_but_unequal_paragraphs_share_a_class(spark):
    """Of all pairs of unlike contents whose shingle sets have a similarity of 0.8 or more, by brute force, nearly all are in one class."""
    docs = spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.01')}/documents.parquet")
    texts = dict(pairs_of(docs))
    sets, seen = {}, {}
    for i, t in texts.items():
        p = paragraphs(pa.array([t], pa.string()))
        bounds = np.append(p["starts"], len(p["words"]))
        row, sh = shingles(bounds, p["words"], 5)
        for n, (at, size, h) in enumerate(zip(p["at"].tolist(), p["n"].tolist(), p["hash"].tolist(), strict=True)):
            if size >= 5:
                sets.setdefault(h, frozenset(sh[row == n].tolist()))
                seen.setdefault(h, []).append((i, at))
    postings = defaultdict(list)
    for h, s in sets.items():
        for x in s:
            postings[x].append(h)
    near = set()
    for h, s in sets.items():
        for other, both in Counter(o for x in s for o in postings[x]).items():
            if other < h and 5 * both >= 4 * len(s | sets[other]):
                near.add((other, h))
    first = {(r["doc_id"], r["start_word"]): (r["first_doc_id"], r["first_start"]) for r in repeated_paragraphs(docs, least_run=1).collect()}
    apart = [(a, b) for a, b in near if len({i for i, _ in seen[a] + seen[b]}) > 1]
    linked = sum(any(first.get(x) is not None and first.get(x) == first.get(y) for x in seen[a] for y in seen[b]) for a, b in apart)
    assert len(apart) > 60
    assert linked >= 0.95 * len(apart)


def test_empty_table(empty):
    assert repeated_paragraphs(empty).count() == 0


# --- the pipeline


def test_stages_on_hard_rows_and_empty_tables(spark, hard, empty):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (hard.select(*columns), empty.select(*columns)):
        for name, stage in P.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == columns, name
            out.collect()


def test_pipeline_stage_by_stage(spark, real):
    """Every stage's decisions hold on what the one before it kept."""
    docs = real
    kept = P.keep_quality(spark, docs, SF).cache()
    verdict = {r["doc_id"]: r["kept"] for r in P.quality_rules(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert {r["doc_id"] for r in kept.collect()} == {i for i, k in verdict.items() if k}

    single = P.drop_near_copies(spark, kept, SF).cache()
    sets = {i: grams(words_of(low(t))) for i, t in pairs_of(kept)}
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert {r["doc_id"] for r in single.collect()} == set(find_classes(ids, links).values())

    cut = P.cut_repeats(spark, single, SF).cache()
    before, after = dict(pairs_of(single)), dict(pairs_of(cut))
    assert before.keys() == after.keys()
    assert all(Counter(words_of(after[i])) <= Counter(words_of(before[i])) for i in before)
    assert cut.where("n_chars <> length(text)").count() == 0

    mixed = P.mix(spark, cut, SF).cache()
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert max(times.values()) <= 2
    copies = {r["doc_id"]: r["copies"] for r in P.mix_sources(cut).where("copies > 0").collect()}
    assert times == Counter(copies)

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in P.encode(spark, mixed, SF).collect())
    assert got == Counter((i, tuple(sp.encode(t))) for i, t in pairs_of(mixed))


def test_repeated_rows_are_one_document(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, "en", "a", 1)] * 3 + [(2, text, "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert P.drop_near_copies(spark, docs, SF).select("doc_id").collect() == [(1,)]
    assert SCHEMA
    assert docs.where(F.col("doc_id") == 1).count() == 3
