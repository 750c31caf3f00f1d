"""Token ids in Parquet: list columns in document order, made for selective reads."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import small_batches
from .words import byte_characters, releasing, slices

#: Rows go to row groups of about this size, and to pages of this size with an index of their smallest and largest ids.
ROW_GROUP, PAGE = 16 << 20, 256 << 10


#: Words of visible Latin-1 characters but those that start special tokens: normalisers change no more than their case.
VISIBLE = re.compile("[!-;=-~¡-¬®-ÿ]+")
#: Marks that the pattern parts from the letters before them.
MARKS = frozenset(".,!?;:")
#: Words that go through the library at once, and bytes of text whose distinct words a task encodes at once.
TOGETHER, SLICE = 2048, 12 << 20


class WordEncoder:
    """Ids of words by a byte-level tokenizers file that lower-cases, drops white space and parts words by a pattern.

    Ids are little-endian bytes. Words of visible Latin-1 characters are parted by
    the file's own pattern here and their parts go to the model at once; other words go through the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path) as f:
            split = json.load(f)["pre_tokenizer"]["pretokenizers"][0]
        self.tokenizer, self.pattern = Tokenizer.from_file(path), regex.compile(split["pattern"]["Regex"])
        self.characters = {n: "".join(chr(c) for c in map(byte_characters().__getitem__, chr(n).encode())) for n in range(256)}
        if any(not t.content.startswith("<") for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("special tokens of this file may stand in plain words")

    def __call__(self, words: list[str]) -> list[bytes]:
        tokenize, out, rest, known = self.tokenizer.model.tokenize, [], [], {}

        def ids(part: str) -> bytes:
            found = known.get(part)
            if found is None:
                found = known[part] = array("i", [t.id for t in tokenize(part)]).tobytes()
            return found

        for n, w in enumerate(words):
            if w.isascii() and w.isalpha():
                out.append(ids(w.lower()))
            elif w[-1:] in MARKS and (body := w[:-1]).isascii() and body.isalpha():
                out.append(ids(body.lower()) + ids(w[-1]))
            elif VISIBLE.fullmatch(w):
                body, mark = (w[:-1], w[-1]) if w[-1] in MARKS else (w, "")
                if body.isalpha():
                    out.append(ids(body.lower().translate(self.characters)) + (ids(mark) if mark else b""))
                    continue
                parts = self.pattern.findall(w.lower())
                out.append(b"".join(ids(p if p.isascii() else p.translate(self.characters)) for p in parts))
            else:
                out.append(b"")
                rest.append(n)
        for i in range(0, len(rest), TOGETHER):
            some = rest[i : i + TOGETHER]
            found = self.tokenizer.encode_batch_fast([words[n] for n in some], add_special_tokens=False)
            for n, e in zip(some, found, strict=True):
                out[n] = array("i", e.ids).tobytes()
        return out


def encode_texts(texts: pa.Array, encode: Callable[[list[str]], list[bytes]], end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and ids of all texts, each ended by end_id; every distinct word is encoded once."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    bounds = np.asarray(lists.offsets).astype(np.int64) - lists.offsets[0].as_py()
    coded = lists.flatten().dictionary_encode()
    codes = np.asarray(coded.indices)
    pieces = encode(coded.dictionary.to_pylist())
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
    flat = np.frombuffer(b"".join(pieces), "<i4")
    first = np.concatenate([[0], np.cumsum(lengths)])
    n = lengths[codes]
    ends = np.concatenate([[0], np.cumsum(n)])
    gather = np.repeat((first[codes] - ends[:-1]), n) + np.arange(ends[-1])
    offsets = ends[bounds] + np.arange(len(bounds))
    out = np.full(offsets[-1], end_id, np.int32)
    inside = np.ones(offsets[-1], bool)
    inside[offsets[1:] - 1] = False
    out[inside] = flat[gather]
    return offsets, out


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, before = WordEncoder(path), 0
        for b in slices(batches, most=SLICE):
            offsets, ids = encode_texts(b.column("text"), encode, end_id)
            counts = np.diff(offsets)
            arrays = [b.column("id"), pa.array(before + offsets[:-1]), pa.array(counts), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start_in_file", "n_tokens", "ids"])
            before += int(offsets[-1])

    return releasing(run)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> None:
    """Writes (doc_id, start_in_file, n_tokens, ids) in ascending doc_id order, files in order of their names.

    Texts are ranged and sorted by id before they are encoded, as text moves in less room than ids. Ids are dictionary
    encoded and bit packed (in the list column; the counters are delta encoded), zstd compressed, in row groups and
    pages of set sizes; Parquet's page indexes let a filter on doc_id or n_tokens skip pages, and readers that
    name no `ids` never touch them. Null text counts as empty: only the end id. Null ids come first, equal ids in
    order of their texts' hashes. An empty table gives files without rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, "id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    ids = ranged.mapInArrow(_encode(tokenizer, end_id), "doc_id long, start_in_file long, n_tokens long, ids array<int>")
    options = {"compression": "zstd", "parquet.block.size": ROW_GROUP, "parquet.page.size": PAGE, "parquet.writer.version": "v2", "parquet.enable.dictionary": "true"}
    ids.write.options(**options).parquet(path)


def read_token_files(spark: SparkSession, path: str, where: Column | None = None, with_ids: bool = True) -> DataFrame:
    """Documents of token files with `start`, the number of ids of all documents before each, in file order.

    `where` (on doc_id or n_tokens) is pushed into the scan; offsets of files come from the counters alone.
    """
    rows = spark.read.schema("doc_id long, start_in_file long, n_tokens long, ids array<int>").parquet(path).withColumn("file", F.col("_metadata.file_name"))
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("ids_in_file"))
    before = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("file", F.coalesce(F.sum("ids_in_file").over(before), F.lit(0)).alias("base"))
    if where is not None:
        rows = rows.where(where)
    out = rows.join(totals, "file").select("doc_id", (F.col("base") + F.col("start_in_file")).alias("start"), "n_tokens", "ids")
    return out if with_ids else out.drop("ids")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column("ids")
        flat, at = np.asarray(ids.flatten()).astype("<u4"), np.asarray(ids.offsets) - ids.offsets[0].as_py()
        crc = [zlib.crc32(flat[at[i] : at[i + 1]]) for i in range(b.num_rows)]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def digest_token_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what `read_token_files` gives; the checksum is over little-endian 32-bit ids."""
    return files.mapInArrow(releasing(_digest), "doc_id long, start long, n_tokens long, ids_crc32 long")
