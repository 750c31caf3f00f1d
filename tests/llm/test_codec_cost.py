"""What the codec spends beside its results: codes stay where they were written, and one fold takes many units."""

from __future__ import annotations

import numpy as np
import public_tokenizers

from kalends.llm import sentencepiece_codec as S


def test_codes_are_not_shuffled_to_their_answers(spark):
    docs = spark.createDataFrame([(n, f"one text of {n} and a few words") for n in range(50)], "doc_id long, text string")
    out = S.sentencepiece_encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    plan = out._jdf.queryExecution().toString()
    assert "Bucketed: true" in plan
    assert out.count() == 50


def test_merges_and_paths_of_several_units_at_once():
    """Unit 0: abc with ab (rank 1) and bc (rank 0); unit 1: ab."""
    e = lambda rank, start, n, i: rank << 32 | start << 26 | n << 20 | i
    edge = np.array([e(5, 0, 1, 1), e(6, 1, 1, 2), e(7, 2, 1, 3), e(1, 0, 2, 4), e(0, 1, 2, 5), e(5, 0, 1, 1), e(6, 1, 1, 2), e(1, 0, 2, 4)])
    unit, size = np.array([0, 0, 0, 0, 0, 1, 1, 1]), np.array([3, 2])
    assert S._merges(unit, edge, size).tolist() == [True, False, False, False, True, False, False, True]
    assert S.viterbi(unit, edge, size, 99).tolist() == [2, 1]
