"""Chunks of documents coded by dictionaries, so that each distinct piece of text is worked on once in the whole table.

A task cuts its documents into chunks. A chunk leaves one row of codes (which pieces its documents hold) and a row for
each part of its dictionary, the part of a piece being crc32 modulo the number of parts. All of a piece's occurrences
in dictionaries thus meet in one part, where it is worked on once; answers go back to the chunk part by part, in the order of
the dictionary, and codes then index the answers. Neither texts nor one row per word are ever shuffled.
"""

from __future__ import annotations

import itertools
import zlib
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import release_memory, slices

#: Parts of a dictionary for each shuffle partition, so that partitions get even shares.
PARTS_EACH = 8
#: Pieces of a chunk that have the smallest codes, the most frequent first: their codes then compress to about 14 % less.
OFTEN = 1 << 14
SCHEMA = "chunk long, kind int, part int, blob binary"
CODES, PIECES = 0, 1
#: Gives texts' distinct pieces, the pieces' codes in order, how many each text has, and a count beside them.
Coder = Callable[[pa.Array], tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]


def by_text(split: Callable[[str], tuple[list[str], int]]) -> Coder:
    """A coder from a function that cuts one text; pieces get codes at once, so that few strings are held."""

    def run(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        code_of: dict[str, int] = defaultdict(itertools.count().__next__)
        flat, n, beside = array("i"), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.uint32)
        for i, text in enumerate(texts):
            found, beside[i] = split(text.as_py())
            n[i] = len(found)
            flat.extend(map(code_of.__getitem__, found))
        return list(code_of), np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32), n, beside

    return run


def pack(**arrays: np.ndarray) -> bytes:
    """Named arrays as one compressed value; integers go byte plane by byte plane, which compresses small numbers well."""
    out = []
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()
        out.append(f"{name} {a.dtype.str} {len(a)}\n".encode() + planes)
    return zstandard.compress(b"".join(len(x).to_bytes(8, "little") + x for x in out), 3)


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    data, at, out = zstandard.decompress(blob), 0, {}
    while at < len(data):
        size = int.from_bytes(data[at : at + 8], "little")
        head, _, planes = data[at + 8 : at + 8 + size].partition(b"\n")
        name, kind, n = head.decode().split()
        dtype = np.dtype(kind)
        out[name] = np.frombuffer(planes, np.uint8).reshape(dtype.itemsize, int(n)).T.copy().view(dtype).ravel() if int(n) else np.zeros(0, dtype)
        at += 8 + size
    return out


def pack_strings(strings: list[bytes], times: np.ndarray | None = None) -> bytes:
    more = {} if times is None else {"times": times}
    return pack(lengths=np.fromiter(map(len, strings), np.uint32, len(strings)), data=np.frombuffer(b"".join(strings), np.uint8), **more)


def unpack_strings(blob: bytes) -> list[bytes]:
    return strings_of(unpack(blob))


def strings_of(x: dict[str, np.ndarray]) -> list[bytes]:
    """The strings of an unpacked value of `pack_strings`."""
    data, ends = x["data"].tobytes(), np.cumsum(x["lengths"].astype(np.int64)).tolist()
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


def _coded(make: Callable[[], Coder], parts: int, bags: bool, slice_bytes: int, counted: Callable[[np.ndarray], np.ndarray] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task, nth = make(), TaskContext.get().partitionId(), 0
        for b in slices(batches, most=slice_bytes):
            texts = pc.fill_null(b.column("text"), "")
            words, flat, n, beside = coder(texts)
            words = [w.encode() for w in words]
            part = np.fromiter((zlib.crc32(w) % parts for w in words), np.int64, len(words))
            order = np.argsort(part, kind="stable")
            code = np.empty(len(words), np.int64)
            code[order] = np.arange(len(words))
            codes = code[flat] if len(flat) else np.zeros(0, np.int64)
            rows, extra = np.repeat(np.arange(len(n)), n), {}
            ids, raw = b.column("id"), texts.cast(pa.binary()).to_pylist()
            held = {"null": np.asarray(ids.is_null()).astype(np.uint8), "id": np.asarray(ids.fill_null(0)), "size": np.fromiter((len(t) for t in raw), np.int64, len(raw)), "crc": np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw))}
            times = None
            if counted is not None:
                times = np.bincount(codes[counted(held)[rows]], minlength=len(words)).astype(np.uint32)
            if bags:
                key, several = np.unique(rows * max(len(words), 1) + codes, return_counts=True)
                n, codes = np.bincount(key // max(len(words), 1), minlength=len(n)), key % max(len(words), 1)
                extra = {"times": several.astype(np.uint32)}
            else:
                often = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")[:OFTEN]
                rank = np.arange(len(often), len(often) + len(words))
                rank[often] = np.arange(len(often))
                codes, extra = rank[codes], {"often": often.astype(np.uint32)}
            blobs = [pack(**held, beside=beside, n=n.astype(np.uint32), codes=codes.astype(np.uint32), **extra)]
            present, first = np.unique(part[order], return_index=True)
            for lo, hi in zip(first, np.append(first, len(words))[1:], strict=True):
                blobs.append(pack_strings([words[i] for i in order[lo:hi]], None if times is None else times[lo:hi]))
            kinds = [CODES] + [PIECES] * len(present)
            chunk = pa.array(np.full(len(blobs), (task << 32) + nth, np.int64))
            yield pa.RecordBatch.from_arrays([chunk, pa.array(kinds, pa.int32()), pa.array([-1, *present], pa.int32()), pa.array(blobs, pa.binary())], ["chunk", "kind", "part", "blob"])
            nth += 1
        release_memory()

    return run


def dictionary_chunks(docs: DataFrame, make: Callable[[], Coder], bags: bool, scratch: Scratch, slice_bytes: int = 8 << 20, counted: Callable[[dict[str, np.ndarray]], np.ndarray] | None = None, bucketed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(codes, pieces) of `docs` (id, text), both (chunk, part, blob); with `bucketed`, codes needn't be shuffled to meet their answers.

    With `bags`, codes are distinct in a document and have `times`. With `counted`, which marks rows by their ids,
    pieces have `times`, how often each occurs in the chunk's marked rows.
    """
    parts = PARTS_EACH * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # each folder of the table by kind has the other columns
    both = scratch.write(docs.mapInArrow(_coded(make, parts, bags, slice_bytes, counted), SCHEMA), "chunks", by="kind", bucketed="chunk" if bucketed else None)
    return scratch.part(both, f"kind={CODES}"), scratch.part(both, f"kind={PIECES}")


def unpack_codes(blob: bytes) -> dict[str, np.ndarray]:
    """A chunk's codes, as places in its dictionary in order of parts."""
    out = unpack(blob)
    if "often" in out:
        often, codes = out.pop("often"), out["codes"]
        out["codes"] = np.where(codes < len(often), often[np.minimum(codes, max(len(often), 1) - 1)], codes - np.uint32(len(often))) if len(codes) else codes
    return out


def with_answers(codes: DataFrame, answers: DataFrame, finish: Callable[[dict[str, np.ndarray], list[dict[str, np.ndarray]]], pa.Table], schema: str) -> DataFrame:
    """`finish` for every chunk, of its codes and of its parts' answers in order of parts."""

    def run(own: pa.Table, rows: pa.Table) -> pa.Table:
        out = finish(unpack_codes(own["blob"][0].as_py()), [unpack(x.as_py()) for x in rows.sort_by("part")["blob"]])
        release_memory()
        return out

    return codes.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


def id_array(codes: dict[str, np.ndarray]) -> pa.Array:
    return pa.array(codes["id"], pa.int64(), mask=codes["null"].astype(bool))
