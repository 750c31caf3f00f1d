"""Words of texts as Arrow dictionaries and numpy codes, for use inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that are worked on at once in a task.
SLICE_BYTES = 8 << 20

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the finaliser of splitmix64), wrapping."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts and joins batches so that a piece holds about `most` bytes of `column`, one row at least."""
    held, total = [], 0

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.concat_batches(held)

    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        piece = (total + np.cumsum(size)) // most
        cuts = (np.flatnonzero(np.diff(piece)) + 1).tolist()
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if held and lo == 0 and piece[0] > 0:
                yield joined()
                held, total = [], 0
            if lo:
                yield joined()
                held, total = [], 0
            held.append(batch.slice(lo, hi - lo))
            total += int(size[lo:hi].sum())
    if held:
        yield joined()


def split_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words `[^\\x20\\x09-\\x0D]+` of each text: row offsets (int64), codes (int32) and the dictionary of distinct words.

    Null counts as empty. `lower` lower-cases A-Z only.
    """
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    values, bounds = lists.flatten(), np.asarray(lists.offsets).astype(np.int64) - lists.offsets[0].as_py()
    real = pc.greater(pc.binary_length(values), 0)
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False), dtype=np.int64)])
    coded = values.filter(real).dictionary_encode()
    return before[bounds], np.asarray(coded.indices), coded.dictionary


def word_hashes(dictionary: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash for each distinct word."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in dictionary.to_pylist()), np.uint64, len(dictionary))


def shingles(offsets: np.ndarray, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit hash of every k-word shingle; a row with fewer words has its whole sequence as its only one."""
    counts = np.diff(offsets)
    row = np.repeat(np.arange(len(counts)), counts)
    n = max(0, len(hashes) - k + 1)
    whole = np.zeros(n, np.uint64)
    for j in range(k):
        whole = mix(whole + hashes[j : j + n])
    inside = row[:n] == row[k - 1 : k - 1 + n] if n else np.zeros(0, bool)
    short = np.flatnonzero((counts > 0) & (counts < k))
    value = mix(counts[short].astype(np.uint64))
    for j in range(k - 1):
        more = counts[short] > j
        value[more] = mix(value[more] + hashes[offsets[short[more]] + j])
    rows, out = np.concatenate([row[:n][inside], short]), np.concatenate([whole[inside], mix(value)])
    return rows, out


def distinct_sorted(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, value) pairs in order."""
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    return rows[first], values[first]


def releasing(run):
    """The same function of batches, which gives freed memory back when a task is done with it."""

    def held(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # freed Arrow memory then goes the way of all other
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            release_memory()

    return held


def byte_characters() -> dict[int, int]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, others from 256 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b for b in plain} | {b: 256 + n for n, b in enumerate(sorted({*range(256)} - {*plain}))}


def release_memory() -> None:
    """Gives freed memory back, as a reused worker would hold it beside the next stages' needs."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this kind of C library
        return
