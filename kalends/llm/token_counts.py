"""Token counts from distinct pre-tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dictionaries import by_text, dictionary_chunks, id_array, pack, unpack_strings, with_answers
from .scratch import Scratch
from .words import byte_characters, releasing

#: The pre-tokenizer's pattern (fixed value; public_tokenizers.PATTERN).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Below this code point the regex module's classes are the library's; other texts are cut by the library itself.
SAME_BELOW = 0x530


def pre_token_splitter(path: str):
    """Makes a splitter of texts into pre-tokens of a byte-level tokenizers file; special tokens in a text count beside."""

    def make():
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        added = sorted((t.content for t in tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        special = re.compile("|".join(map(re.escape, added))) if added else None
        pattern, beyond = regex.compile(PATTERN), re.compile(f"[^\\x00-{chr(SAME_BELOW - 1)}]")

        def cut(text: str) -> list[str]:
            if beyond.search(text):
                return [text[a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(text)]
            return pattern.findall(text)

        def split(text: str) -> tuple[list[str], int]:
            if special is None or not special.search(text):
                return cut(text), 0
            spans = special.split(text)
            return [p for span in spans for p in cut(span)], len(spans) - 1

        return by_text(split)

    return make


#: Pieces whose counts a task keeps; then it starts anew.
KEPT = 100_000


def _piece_counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        # a piece is a whole pre-token, so its bytes' characters go to the model at once
        model, characters, known = Tokenizer.from_file(path).model, byte_characters(), {}
        for b in batches:
            out = []
            for blob in b.column("blob"):
                if len(known) > KEPT:
                    known.clear()
                words = unpack_strings(blob.as_py())
                counts = np.fromiter((known.get(w, 0) for w in words), np.uint32, len(words))
                for i in np.flatnonzero(counts == 0).tolist():
                    counts[i] = known[words[i]] = len(model.tokenize(words[i].decode("latin-1").translate(characters)))
                out.append(pack(n=counts))
            yield pa.RecordBatch.from_arrays([b.column("chunk"), b.column("part"), pa.array(out, pa.binary())], ["chunk", "part", "blob"])

    return releasing(run)


def _sum_up(codes: dict[str, np.ndarray], answers: list[dict[str, np.ndarray]]) -> pa.Table:
    pieces = np.concatenate([a["n"] for a in answers]).astype(np.int64) if answers else np.zeros(0, np.int64)
    at = np.concatenate([[0], np.cumsum(codes["n"].astype(np.int64))])
    sums = np.concatenate([[0], np.cumsum(pieces[codes["codes"]] * codes["times"])])
    return pa.table({"doc_id": id_array(codes), "n_bytes": codes["size"], "n_tokens": sums[at[1:]] - sums[at[:-1]] + codes["beside"]})


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How many tokens each text has by a byte-level BPE file of the tokenizers library, no ids being made.

    Returns doc id, n_bytes (UTF-8), n_tokens and over_limit (more than `limit` tokens) for every row. Pieces are
    counted once for each distinct pre-token of the table; a document's count is the sum of these over its pre-token
    frequencies, which stay with its chunk as codes. Special strings in a text count as one token each, as the
    library takes them. Texts are neither truncated nor padded.

    Null text counts as empty: no bytes, no tokens. Null ids and repeated rows are kept. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "token-counts")
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    codes, pieces = dictionary_chunks(slim, pre_token_splitter(tokenizer), True, scratch, 4 << 20)
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    answers = scratch.write(pieces.repartition(spread, "part").mapInArrow(_piece_counts(tokenizer), "chunk long, part int, blob binary"), "answers")
    scratch.drop(pieces)
    out = with_answers(codes, answers, _sum_up, "doc_id long, n_bytes long, n_tokens long")
    return out.select(F.col("doc_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
