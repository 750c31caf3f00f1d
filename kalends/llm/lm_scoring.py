"""Language-model scoring: causal self-attention over subword ids, trained and run in numpy within tasks."""

from __future__ import annotations

import itertools
import json
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import whole_groups
from .dictionaries import dictionary_chunks, id_array, pack, strings_of, unpack, with_answers
from .scratch import Scratch
from .token_counts import PATTERN, SAME_BELOW
from .words import byte_characters, mix, releasing, split_words

#: Positions (subword ids) of a context window that predict, and positions before them that it also holds: windows
#: overlap by BEFORE.
SCORED, BEFORE = 24, 8
#: Words of a stretch that one component explains in EM; windows whose attention is computed at once (four times as many
#: in a chunk of many windows, which has steps enough); heads' width.
STRETCH, BATCH, HEAD = 32, 64, 8
#: How far back each place of a window (columns) lies from each that may predict (rows); later places are masked.
GAP = np.arange(SCORED)[:, None] + BEFORE - np.arange(BEFORE + SCORED)[None]
BACK, MASK = np.maximum(GAP, 0), np.where(GAP >= 0, 0, -np.inf).astype(np.float32)


@dataclass(frozen=True)
class Model:
    """Parameters, all bounded by the subword vocabulary: log-probabilities of subwords by component, and attention.

    first[t, z] and later[t, z]: a word's first and later subwords; the last row of `later` ends a word.
    known[z]: the share of component z among training tokens. rate: probability of an unknown word. attention: flat.
    """

    first: np.ndarray
    later: np.ndarray
    prior: np.ndarray
    known: np.ndarray
    rate: float
    total: int
    ends: int
    attention: np.ndarray


def _words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    offsets, codes, words = split_words(texts)
    return words.to_pylist(), codes, np.diff(offsets), np.zeros(len(texts), np.uint32)


def held_out(ids: np.ndarray, null: np.ndarray, fold: int, folds: int) -> np.ndarray:
    """Whether crc32 of the id as text falls in the held-out fold; a null id counts as empty text."""
    return np.fromiter((zlib.crc32(b"" if n else str(i).encode()) % folds == fold for i, n in zip(ids.tolist(), null.tolist(), strict=True)), bool, len(ids))


def _count_words(path: str):
    """For the words of each part of all dictionaries: their training counts and subword ids, and the part's totals; rows come in order of parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        # loading the file takes longer than many parts' words, so a task does it once for all of its parts
        tok, characters = Tokenizer.from_file(path), byte_characters()
        pre, tokenize = tok.pre_tokenizer.pre_tokenize_str, tok.model.tokenize
        pattern, beyond = regex.compile(PATTERN), re.compile(f"[^\\x00-{chr(SAME_BELOW - 1)}]")

        def of(part: str) -> list[int]:
            return [t.id for t in tokenize(part.encode().decode("latin-1").translate(characters))]

        def ids_of(w: bytes) -> bytes:
            if w.isalpha():  # ASCII letters are one pre-token
                return array("I", [t.id for t in tokenize("\u0120" + w.decode())]).tobytes()
            text = w.decode()
            if beyond.search(text):
                return array("I", [t.id for p, _ in pre(" " + text) for t in tokenize(p)]).tobytes()
            parts = [" " + text] if text.isalpha() else pattern.findall(" " + text)
            return array("I", [i for p in parts for i in of(p)]).tobytes()

        for b, group in whole_groups(batches, ("part",)):
            bounds = np.searchsorted(group, np.arange(group[-1] + 2)).tolist()
            for lo, hi in itertools.pairwise(bounds):
                yield part_of(b.slice(lo, hi - lo), ids_of)

    def part_of(rows: pa.RecordBatch, ids_of) -> pa.RecordBatch:
        counts: dict[bytes, int] = defaultdict(int)
        for blob in rows.column("blob"):
            held = unpack(blob.as_py())
            for w, n in zip(strings_of(held), held["times"].tolist(), strict=True):
                counts[w] += n
        ids, out = {w: ids_of(w) for w in counts}, []
        for blob in rows.column("blob"):
            words = strings_of(unpack(blob.as_py()))
            pieces = [ids[w] for w in words]
            c = np.fromiter((counts[w] for w in words), np.uint64, len(words))
            out.append(pack(c=c, n=np.fromiter(map(len, pieces), np.uint32, len(pieces)) // 4, ids=np.frombuffer(b"".join(pieces), np.uint32)))
        totals = [np.zeros(len(out), np.int64) for _ in range(3)]
        c = np.fromiter(counts.values(), np.int64, len(counts))
        for t, v in zip(totals, (c.sum(), (c > 0).sum(), (c == 1).sum()), strict=True):
            t[0] = v
        return pa.RecordBatch.from_arrays([rows.column("chunk"), rows.column("part"), pa.array(out, pa.binary()), *map(pa.array, totals)], ["chunk", "part", "blob", "tokens", "types", "once"])

    return releasing(run)


def _gather(codes: dict[str, np.ndarray], answers: list[dict[str, np.ndarray]]) -> pa.Table:
    """A chunk's codes and answers in one blob."""
    parts = {k: np.concatenate([a[k] for a in answers]) if answers else np.zeros(0, np.uint32) for k in ("c", "n", "ids")}
    whole = pack(id=codes["id"], null=codes["null"], n=codes["n"], codes=codes["codes"], c=parts["c"], subwords=parts["n"], ids=parts["ids"])
    return pa.table({"blob": pa.array([whole], pa.binary())})


class Chunk:
    """A chunk's documents: word codes in order, and for each distinct word its count and subword ids."""

    def __init__(self, blob: bytes, fold: int, folds: int):
        x = unpack(blob)
        self.ids, self.null, self.n = x["id"], x["null"].astype(bool), x["n"].astype(np.int64)
        self.codes, self.c = x["codes"].astype(np.int32), x["c"].astype(np.float64)
        self.subwords, self.flat = x["subwords"].astype(np.int32), x["ids"].astype(np.int32)
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        self.out = held_out(self.ids, self.null, fold, folds)
        self.word_of = np.repeat(np.arange(len(self.c), dtype=np.int32), self.subwords)
        self.starts = np.cumsum(self.subwords, dtype=np.int32) - self.subwords
        self.is_first = np.zeros(len(self.flat), bool)
        self.is_first[self.starts] = True

    def spelled(self, m: Model) -> np.ndarray:
        """Log-probability of each distinct word's subwords by component."""
        if not len(self.c):
            return np.zeros((0, len(m.prior)), np.float32)
        out = np.add.reduceat(np.concatenate([m.first, m.later])[self.places(len(m.first))], self.starts, axis=0)
        out += m.later[-1]
        return out

    def places(self, vocabulary: int) -> np.ndarray:
        """Each subword's row in a table of first and then of later ones."""
        return self.flat + np.where(self.is_first, np.int32(0), np.int32(vocabulary))

    def shares(self, spelled: np.ndarray, m: Model) -> np.ndarray:
        """Posterior of the components for each distinct word alone."""
        x = spelled + m.prior
        x = np.exp(x - x.max(1, keepdims=True, initial=-np.inf)) if len(x) else x
        return x / x.sum(1, keepdims=True)


def each_chunk(batches: Iterator[pa.RecordBatch], fold: int, folds: int) -> Iterator[Chunk]:
    for b in batches:
        for blob in b.column("blob"):
            yield Chunk(blob.as_py(), fold, folds)


def _expect(m: Model, fold: int, folds: int, share: int, first_round: bool):
    """One EM round over 1 in `share` training stretches of STRETCH words: a task's expected subword counts by component."""
    k, v = len(m.prior), len(m.first)

    def add(x: Chunk, sums: list[np.ndarray]) -> None:
        row = np.repeat(np.arange(len(x.n)), x.n)
        place = np.arange(len(x.codes)) - x.at[row]
        new = np.flatnonzero(place % STRETCH == 0)
        size = np.diff(np.append(new, len(x.codes)))
        key = mix(x.ids[row[new]].view(np.uint64) + place[new].astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
        used = ~x.out[row[new]] & ((key >> np.uint64(9)) % np.uint64(share) == 0)
        codes, size, key = x.codes[np.repeat(used, size)], size[used], key[used]
        if not len(size):
            return
        if first_round:
            r = np.eye(k, dtype=np.float32)[(key % np.uint64(k)).astype(int)] * 0.9 + np.float32(0.1 / k)
        else:
            logs = np.add.reduceat(x.spelled(m)[codes], np.cumsum(size) - size, axis=0) + m.prior
            r = np.exp(logs - logs.max(1, keepdims=True))
            r /= r.sum(1, keepdims=True)
        sums[3] += r.sum(0)[None]
        met = np.bincount(codes, minlength=len(x.c)) > 0
        kinds = [(t, x.flat[t], x.word_of[t]) for t in (np.flatnonzero(met[x.word_of] & mask) for mask in (x.is_first, ~x.is_first))]
        for z, rz in enumerate(np.ascontiguousarray(r.T)):
            weight = np.bincount(codes, np.repeat(rz, size), len(x.c))
            for n, (_, ids, word_of) in enumerate(kinds):
                sums[n][:, z] += np.bincount(ids, weight[word_of], v)
            sums[2][0, z] += weight.sum()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((v, k)), np.zeros((v, k)), np.zeros((1, k)), np.zeros((1, k))]
        for x in each_chunk(batches, fold, folds):
            add(x, sums)
        for kind, s in enumerate(sums):
            some = np.flatnonzero(s.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), kind), pa.int32()), pa.array(some, pa.int32()), *(pa.array(s[some, z]) for z in range(k))], ["kind", "t", *(f"z{z}" for z in range(k))])

    return releasing(run)


def _maximise(m: Model, rows: list, smooth: float) -> Model:
    k, v = len(m.prior), len(m.first)
    first, later, prior = np.full((v, k), smooth), np.full((v + 1, k), smooth), np.full(k, 1.0)
    for r in rows:
        counts = np.array([r[f"z{z}"] for z in range(k)])
        if r["kind"] == 0:
            first[r["t"]] += counts
        elif r["kind"] == 1:
            later[r["t"]] += counts
        elif r["kind"] == 2:
            later[-1] += counts
        else:
            prior += counts
    return replace(m, first=np.log(first / first.sum(0)).astype(np.float32), later=np.log(later / later.sum(0)).astype(np.float32), prior=np.log(prior / prior.sum()).astype(np.float32))


# --- attention: inputs are subword ids' vectors and a one; the output is a distribution over components


def _shapes(k: int) -> dict[str, tuple[int, ...]]:
    return {"q": (k + 1, HEAD), "key": (k + 1, HEAD), "v": (k + 1, k), "o": (k, k), "u": (k + 1, k), "near": (SCORED + BEFORE,), "b": (k,)}


def split_parameters(flat: np.ndarray, k: int) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in _shapes(k).items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def initial_attention(k: int) -> np.ndarray:
    rng = np.random.default_rng(7)
    p = {n: rng.normal(0, 0.05, s) for n, s in _shapes(k).items()}
    p["v"][:k], p["o"], p["near"], p["b"] = p["v"][:k] + np.eye(k), p["o"] + 4 * np.eye(k), p["near"] * 0, p["b"] * 0
    return np.concatenate([p[n].ravel() for n in _shapes(k)]).astype(np.float32)


def windows(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For documents of n ids and an end each: every window's document, first predicting position and how many there are."""
    length = n + 1
    count = -(-length // SCORED)
    doc = np.repeat(np.arange(len(n)), count)
    first = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * SCORED
    return doc, first, np.minimum(SCORED, length[doc] - first), np.concatenate([[0], np.cumsum(length)])


def weights(p: dict[str, np.ndarray], x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Component weights (k, positions) for predicting positions `at` (windows, some; from 0 at the first that may predict).

    From inputs (windows, BEFORE + SCORED, k + 1) up to each. The last number of an input is one, or the whole input is
    zero where there is no such position; such ones then add nothing to the weighted sums, nor to the sum of weights, which is the one's.
    """
    k = x.shape[2] - 1
    one = np.zeros((k + 1, 1), x.dtype)
    one[k] = 1
    held = (x.reshape(-1, k + 1) @ np.concatenate([p["key"], p["v"], one], 1)).reshape(len(x), BEFORE + SCORED, -1)
    key, v = held[..., :HEAD], held[..., HEAD:]
    own = x[np.arange(len(x))[:, None], BEFORE + at].reshape(-1, k + 1)
    q = (own @ (p["q"] * np.float32(1 / np.sqrt(HEAD)))).reshape(*at.shape, HEAD)
    e = q @ key.transpose(0, 2, 1)
    e += (p["near"][BACK] + MASK).astype(x.dtype)[at]
    # inputs are shares and a one, so parameters bound the scores; only then can exp not overflow
    if 4 * (np.abs(p["q"]).max(0) * np.abs(p["key"]).max(0)).sum() + np.abs(p["near"]).max() > 80:
        np.minimum(e, 80, out=e)
    np.exp(e, out=e)
    h = e @ v
    total = h[..., k:] + np.finfo(x.dtype).tiny
    h = h[..., :k] / total
    # components lead, as sums over them are then sums of long rows
    w = p["o"].T @ h.reshape(-1, k).T
    w += p["u"].T @ own.T
    w += p["b"][:, None]
    w -= w.max(0)
    np.exp(w, out=w)
    w /= w.sum(0)
    return w, (own, q, key, v[..., :k], e, total, h)


def attend(p: dict[str, np.ndarray], x: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, tuple]:
    """Log component weights (windows, predicting positions, k); all SCORED positions predict unless `at` names some. See `weights`."""
    at = _every(x) if at is None else at
    w, held = weights(p, x, at)
    return np.log(w).T.reshape(*at.shape, -1), held


def _every(x: np.ndarray) -> np.ndarray:
    return np.broadcast_to(np.arange(SCORED), (len(x), SCORED))


def gradient(p: dict[str, np.ndarray], x: np.ndarray, emit: np.ndarray, scored: np.ndarray, at: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """Summed negative log-likelihood of predicting positions and its gradient, flat; emit: each one's likelihood by component."""
    at, k = _every(x) if at is None else at, emit.shape[2]
    w, (own, q, key, v, e, total, h) = weights(p, x, at)
    emit, scored = emit.reshape(-1, k).T, scored.ravel()
    parts = w * emit
    mixed = parts.sum(0)
    parts /= mixed
    g = np.subtract(w, parts, out=w)
    g *= scored
    flat = lambda t: t.reshape(-1, t.shape[-1])
    dh = (g.T @ p["o"].T).reshape(h.shape)
    a = np.divide(e, total, out=e)
    ds = dh @ v.transpose(0, 2, 1)
    ds -= np.einsum("wmk,wmk->wm", dh, h)[..., None]
    ds *= a
    scale = np.float32(1 / np.sqrt(HEAD))
    dq, dkey, dv = ds @ key, ds.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ dh
    dq *= scale
    ds *= x[:, None, :, k]
    by_place = np.eye(SCORED, dtype=x.dtype)[at.ravel()].T @ flat(ds)
    near = np.bincount(BACK.ravel(), np.where(GAP < 0, 0, by_place).ravel(), BEFORE + SCORED)
    out = {"q": own.T @ flat(dq), "key": flat(x).T @ flat(dkey), "v": flat(x).T @ flat(dv), "o": flat(h).T @ g.T, "u": own.T @ g.T, "near": near, "b": g.sum(1)}
    return float(-(np.log(mixed) * scored).sum()), np.concatenate([out[n].ravel() for n in _shapes(k)]).astype(np.float64)


def _emissions(x: Chunk, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """(log scale, likelihood over it by component) of each distinct word, and then of the end of a document.

    A known word's scale is its training share, an unknown one's its best spelling; so no exponent can overflow.
    """
    out = x.spelled(m)
    best = out.max(1, initial=-np.inf)
    out -= best[:, None]
    np.exp(out, out=out)
    seen = x.c > 0
    scale = np.log(m.rate) + best.astype(np.float64)
    share = np.log((1 - m.rate) * x.c[seen] / max(m.total, 1))
    ratio = np.exp(np.minimum(scale[seen] - share, 700))
    spelled = out[seen]
    by = spelled * (np.exp(m.prior) / m.known)
    by *= (1 / (spelled @ np.exp(m.prior)))[:, None]
    by += spelled * ratio[:, None]
    top = by.max(1, initial=0)
    scale[seen] = share + np.log(top)
    by /= top[:, None]
    out[seen] = by
    end = np.log((1 - m.rate) * max(m.ends, 1e-9) / max(m.total, 1))
    return np.append(scale, end), np.concatenate([out, np.ones((1, len(m.prior)), np.float32)])


def vectors(m: Model) -> np.ndarray:
    """The input vector of every subword id as a word's first (row t) and as a later one (row t + vocabulary), of the start, and of nothing.

    It is the posterior of the components given the id alone, and a one; zeros for nothing.
    """
    table = np.concatenate([m.first, m.later[: len(m.first)], np.zeros((1, len(m.prior)), np.float32)]) + m.prior
    table = np.exp(table - table.max(1, keepdims=True))
    table /= table.sum(1, keepdims=True)
    return np.pad(np.concatenate([table, np.ones((len(table), 1), np.float32)], 1), ((0, 1), (0, 0))).astype(np.float32)


class Windows(NamedTuple):
    """Inputs (windows, BEFORE + SCORED, k + 1), and which positions predict (windows, some), padded with the first."""

    x: np.ndarray
    at: np.ndarray


def _batches(x: Chunk, m: Model, table: np.ndarray, train: bool):
    """Arrays for some windows at once: documents, inputs, emissions, which predict, log scales.

    A document's positions are its start and its subword ids. The start and each word's last id predict the next word, all
    of its ids at once, or the end. Windows in which about as many positions predict come together, so that few are padding.
    """
    top, emit = _emissions(x, m)
    pieces = x.subwords[x.codes]
    row = np.repeat(np.arange(len(x.n), dtype=np.int32), x.n)
    ids_of = np.bincount(row, pieces, len(x.n)).astype(np.int64)
    doc, first, _, begins = windows(ids_of)
    into = np.cumsum(pieces, dtype=np.int64) - pieces
    before = into + row  # the position before each word's ids, each document having one start
    source = np.full(begins[-1] + 1, len(table) - 2, np.int32)
    source[-1] = len(table) - 1  # where a window has no position
    inside = np.ones(begins[-1] + 1, bool)
    inside[begins] = False
    # id k of a word stands in x.flat at its word's start plus k
    place = np.repeat((x.starts[x.codes] - into).astype(np.int32), pieces)
    place += np.arange(len(place), dtype=np.int32)
    source[inside] = x.places(len(m.first))[place]
    del inside, place, pieces, into
    target = np.full(begins[-1], -1, np.int32)
    target[before] = x.codes
    target[begins[1:] - 1] = len(x.c)
    where = np.flatnonzero(target >= 0)
    target = target[where]
    of = np.repeat(np.arange(len(x.n), dtype=np.int32), x.n + 1)
    window_of = np.searchsorted(doc, np.arange(len(x.n)))[of] + (where - begins[of]) // SCORED
    place = ((where - begins[of]) % SCORED).astype(np.int32)
    count = np.bincount(window_of, minlength=len(doc))
    start = np.cumsum(count) - count
    del where, of, window_of, row, before
    order = np.lexsort((count, np.arange(len(doc)) // (16 * BATCH)))
    if train:
        order = order[~x.out[doc[order]]]
    most = BATCH if len(order) < 64 * BATCH else 4 * BATCH
    for lo in range(0, len(order), most):
        w = order[lo : lo + most]
        d, f, c = doc[w], first[w], count[w]
        there = np.arange(c.max(initial=0)) < c[:, None]
        if not there.size:
            continue
        which = np.where(there, start[w][:, None] + np.arange(there.shape[1]), 0)
        t = target[which]
        where = f[:, None] + np.arange(-BEFORE, SCORED)
        token = np.where((where >= 0) & (where < (begins[d + 1] - begins[d])[:, None]), begins[d][:, None] + where, begins[-1])
        yield d, Windows(table[source[token]], np.where(there, place[which], 0)), emit[t], there, top[t]


def _train(m: Model, fold: int, folds: int, step: float):
    """A pass over all training windows with Adam, from the shared parameters; their weighted sum per task."""
    k, table = len(m.prior), vectors(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = m.attention.astype(np.float64)
        one, two, n, steps = np.zeros_like(flat), np.zeros_like(flat), 0.0, 0
        for x in each_chunk(batches, fold, folds):
            for _, inputs, emit, scored, _ in _batches(x, m, table, True):
                size = float(scored.sum())
                if not size:
                    continue
                _, g = gradient(split_parameters(flat.astype(np.float32), k), inputs.x, emit, scored.astype(np.float32), inputs.at)
                steps, n, g = steps + 1, n + size, g / size
                one, two = 0.9 * one + 0.1 * g, 0.99 * two + 0.01 * g * g
                flat = flat - step / np.sqrt(1 + steps / 50) * (one / (1 - 0.9**steps)) / (np.sqrt(two / (1 - 0.99**steps)) + 1e-8)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat * n), pa.array(np.full(len(flat), n))], ["i", "value", "weight"])

    return releasing(run)


def _known(m: Model, fold: int, folds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(m.prior))
        for x in each_chunk(batches, fold, folds):
            times = np.bincount(x.codes[np.repeat(~x.out, x.n)], minlength=len(x.c))
            total += times @ x.shares(x.spelled(m), m)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["z", "share"])

    return releasing(run)


def _score(m: Model, types: int, fold: int, folds: int):
    k, p, table = len(m.prior), split_parameters(m.attention, len(m.prior)), vectors(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in each_chunk(batches, fold, folds):
            scores = np.zeros(len(x.n))
            for doc, inputs, emit, scored, top in _batches(x, m, table, False):
                w, _ = weights(p, inputs.x, inputs.at)
                w *= emit.reshape(-1, k).T
                mixed = np.log(w.sum(0)).reshape(top.shape) + top
                scores += np.bincount(doc, (mixed * scored).sum(1), len(scores))
            base = np.bincount(np.repeat(np.arange(len(x.n)), x.n), np.log10((x.c + 1) / (m.total + types + 1))[x.codes], len(x.n))
            known = np.concatenate([[0], np.cumsum((x.c > 0)[x.codes])])
            end = np.log10((m.ends + 1) / (m.total + types + 1))
            columns = {
                "doc_id": id_array({"id": x.ids, "null": x.null}), "held_out": pa.array(x.out), "n_tokens": pa.array(x.n + 1), "n_known": pa.array(known[x.at[1:]] - known[x.at[:-1]] + int(m.ends > 0)),
                "train_tokens": pa.array(np.full(len(x.n), m.total)), "base_score": pa.array(base + end), "score": pa.array(scores / np.log(10)),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return releasing(run)


@dataclass(frozen=True)
class Fitted:
    """Documents' coded chunks in a table, the model that learned from those of training, and its number of word types."""

    chunks: DataFrame
    model: Model
    types: int


def fit_lm(docs: DataFrame, tokenizer: str, scratch: Scratch, fold: int, folds: int, components: int, em_shares: Sequence[int], rounds: int, id_col: str = "doc_id", text_col: str = "text") -> Fitted:
    """Codes the documents and learns from those of training; see `lm_scores`."""
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = lambda held: ~held_out(held["id"], held["null"], fold, folds)
    codes, pieces = dictionary_chunks(slim, lambda: _words, False, scratch, 4 << 20, counted)
    dealt = pieces.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part").sortWithinPartitions("part")
    answers = scratch.write(dealt.mapInArrow(_count_words(tokenizer), "chunk long, part int, blob binary, tokens long, types long, once long"), "answers")
    del dealt
    scratch.drop(pieces)
    coded = scratch.write(with_answers(codes, answers.select("chunk", "part", "blob"), _gather, "blob binary"), "coded")
    scratch.drop(codes)
    words, types, once = answers.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "types", "once"))).first()
    scratch.drop(answers)
    text_id = F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit(""))
    ends = docs.where(F.crc32(F.encode(text_id, "UTF-8")) % folds != fold).count()
    total, types = words + ends, types + int(ends > 0)

    with open(tokenizer) as f:
        vocabulary = len(json.load(f)["model"]["vocab"]) + 1
    k = components
    flat = np.full(k, -np.log(k), np.float32)
    uniform = np.full((vocabulary, k), -np.log(vocabulary), np.float32)
    rate = min(0.5, max(once / max(total, 1), 1e-6))
    m = Model(uniform, np.concatenate([uniform, uniform[:1]]), flat, np.full(k, 1 / k), rate, total, ends, initial_attention(k))
    sums = [F.sum(f"z{z}").alias(f"z{z}") for z in range(k)]
    for r, share in enumerate(em_shares):
        found = coded.mapInArrow(_expect(m, fold, folds, share, r == 0), "kind int, t int, " + ", ".join(f"z{z} double" for z in range(k)))
        m = _maximise(m, found.groupBy("kind", "t").agg(*sums).collect(), 0.02)
    shares = {r["z"]: r["share"] for r in coded.mapInArrow(_known(m, fold, folds), "z int, share double").groupBy("z").agg(F.sum("share").alias("share")).collect()}
    known = np.array([shares.get(z, 0.0) for z in range(k)])
    m = replace(m, known=np.maximum(known / max(known.sum(), 1e-9), 1e-9))
    for r in range(rounds):
        moved = coded.mapInArrow(_train(m, fold, folds, 0.03 / (r + 1)), "i int, value double, weight double")
        rows = moved.groupBy("i").agg(F.sum("value").alias("value"), F.sum("weight").alias("weight")).collect()
        if rows and rows[0]["weight"]:
            attention = m.attention.copy()
            for row in rows:
                attention[row["i"]] = row["value"] / row["weight"]
            m = replace(m, attention=attention)
    return Fitted(coded, m, types)


def lm_scores(
    docs: DataFrame, tokenizer: str, fold: int = 2, folds: int = 7, components: int = 8, em_shares: Sequence[int] = (16, 8, 4, 1), rounds: int = 1,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Log10 probability of every text by a causal self-attention model, beside a smoothed unigram's.

    Returns doc id, held_out, n_tokens (words and one end), n_known, train_tokens, base_score and score. Words are
    lower-cased (A-Z) and cut into subword ids of a byte-level tokenizers file. Attention runs over the ids of a document in
    overlapping windows and gives, after each word, the weights of the components for the next word's ids. Their likelihood by
    component mixes the word's training count, shared out by how its ids are spelled in each component, with the
    spelling alone, so every word has a probability and all sum to one; what each id adds to its word's is the chain of
    these mixtures. Components are fitted by EM: an early round takes 1 in `em_shares` of the stretches of text, as it only
    has to part the components, and the last takes all, so that what it leaves is learned from all training documents; so
    are word counts and shares. Attention is fitted by Adam in numpy within tasks over all training windows, and the
    tasks' parameters are averaged. Scoring windows predict from SCORED positions and hold BEFORE more, so each token is
    scored once, in masked batches.

    Training documents are those whose crc32 of the id as text mod `folds` is not `fold`. Null text is empty: one
    token, the end. A null id's crc is that of empty text. Repeated rows are all scored (and count). An empty table
    gives no rows. Only parameters and sums by subword reach the driver.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    fitted = fit_lm(docs, tokenizer, scratch, fold, folds, components, em_shares, rounds, id_col, text_col)
    out = fitted.chunks.mapInArrow(_score(fitted.model, fitted.types, fold, folds), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("doc_id", id_col)
