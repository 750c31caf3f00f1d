"""Small documents with hard cases, and helpers of the brute-force versions."""

from __future__ import annotations

import random
import re

import pytest

from ..conftest import DATA

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = f"{DATA}/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, n long, words string, component_id long, size long, text_crc32 long, hash long, copies long, kept string, stratum string, part int"


def low(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def hard_texts() -> list[str | None]:
    """Null, empty, blank, one word, very long, ties, near copies, odd spaces, wide characters and special strings."""
    r = random.Random(5)
    names = [f"w{i}" for i in range(300)]
    base = [r.choice(names) for _ in range(400)]
    near = [*base]
    near[200] = "changed"
    passage = " ".join(r.choice(names) for _ in range(90))
    around = [" ".join(r.choice(names) for _ in range(60)) for _ in range(4)]
    return [
        None, "", " \t\n ", "one", "Two words", "two WORDS", " ".join(base), " ".join(near), " ".join(base), "a b " * 20_000, "x" * 30_000,
        f"{around[0]}. {passage} {around[1]}", f"{around[2]} {passage} {around[3]}", "tabs\tand\n\nlines  with   spaces \n ends ",
        "Ünïcödé ﬁgures ½ 漢字かな 👩‍👩‍👧  no-break​ zero é ▁mark", "<|endoftext|> special <|startoftext|> </s> <s> <unk>", "same line here\nsame line here\nother\nsame line here\n" * 30,
        "# * $ % & | < > " * 40, "\x00 null byte", "A" * 61 + " " + "b" * 70,
    ]


@pytest.fixture(scope="session")
def hard(spark):
    """All hard texts under ids with a gap, some rows twice, rows without id, and columns whose names clash with the operators' own."""
    texts = hard_texts()
    rows = [(i * 3, t, ["en", "de", None][i % 3], ["a", "b", "c", "d", None][i % 5]) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], rows[3], (None, texts[6], "en", "a"), (None, None, None, None)]
    extra = (7, 7, "x", 7, 7, 7, 7, 7, "x", "x", 7)
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), *extra) for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs_of(df):
    """(doc_id, text) on the driver; the fixtures are small."""
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def find_classes(nodes, links):
    """The smallest node that links reach, for each node."""
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}
