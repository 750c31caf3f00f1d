"""What scoring spends beside its results: one load of the vocabulary for a task's parts, attention at predicting positions only."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
import tokenizers

from kalends.llm import lm_scoring as L
from kalends.llm.dictionaries import pack_strings, unpack

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_a_task_loads_the_vocabulary_once_for_all_its_parts(monkeypatch):
    loads, load = [], tokenizers.Tokenizer.from_file

    class Counted:
        @staticmethod
        def from_file(path):
            loads.append(path)
            return load(path)

    monkeypatch.setattr(tokenizers, "Tokenizer", Counted)
    blobs = [pack_strings([b"red", b"x%d" % n], np.array([n, 1], np.uint32)) for n in range(6)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array([0, 0, 1, 1, 2, 2], pa.int32()), pa.array(blobs, pa.binary())], ["chunk", "part", "blob"])
    out = pa.Table.from_batches(list(L._count_words(PATH)(iter([rows.slice(0, 3), rows.slice(3)]))))
    assert len(loads) == 1
    assert [unpack(b.as_py())["c"].tolist() for b in out["blob"]] == [[1, 1], [1, 1], [5, 1], [5, 1], [9, 1], [9, 1]]
    assert sum(out["tokens"].to_pylist()) == 15 + 6


def test_attention_runs_at_predicting_positions():
    """Words of eight ids each: an eighth of the positions predict, and no others are computed but a window's padding."""
    docs, words, ids = 40, 30, 8
    codes = {"id": np.arange(docs), "null": np.zeros(docs, bool), "n": np.full(docs, words), "codes": np.zeros(docs * words, np.uint32)}
    answers = [{"c": np.array([9], np.uint64), "n": np.array([ids], np.uint32), "ids": np.arange(ids, dtype=np.uint32)}]
    flat = np.full((10, 2), -1.0, np.float32)
    m = L.Model(flat, np.concatenate([flat, flat[:1]]), np.log(np.full(2, 0.5, np.float32)), np.full(2, 0.5), 0.1, 60, 10, L.initial_attention(2))
    x = L.Chunk(L._gather(codes, answers)["blob"][0].as_py(), 2, 7)
    some = [(emit.shape[0] * emit.shape[1], int(scored.sum())) for _, _, emit, scored, _ in L._batches(x, m, L.vectors(m), False)]
    assert sum(n for _, n in some) == docs * (words + 1)
    assert sum(n for n, _ in some) < 1.5 * docs * (words + 1)
