"""SentencePiece encoding over a relational lattice of word pieces, and decoding."""

from __future__ import annotations

import heapq
import itertools
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dictionaries import dictionary_chunks, id_array, pack, unpack, unpack_strings, with_answers
from .scratch import Scratch, session_setting
from .words import release_memory, releasing

SPACE = "▁"
#: Longest unit whose cut points fit in the bits of a long; longer ones are merged with a heap in the task.
LONGEST = 60
#: Units whose edges one task groups in memory before it sorts.
UNITS_AT_ONCE = 50_000
#: Bytes of text in a chunk: the larger, the fewer of its units other chunks hold too.
CHUNK = 6 << 20
#: In the bits of an edge: no id.
NO_ID = (1 << 20) - 1


class Vocabulary(NamedTuple):
    """Pieces with id and rank (best score first), the longest piece, the id of byte 0 (or None), and the unknown id."""

    pieces: list[tuple[str, int, int]]
    longest: int
    byte_zero: int | None
    unknown: int
    text_of: list[bytes]


def load_vocabulary(path: str) -> Vocabulary:
    """Reads a BPE model file of the sentencepiece library; the vocabulary's size bounds all that is broadcast."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.vocab_size())
    normal = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    rank = {s: n for n, s in enumerate(sorted({sp.get_score(i) for i in normal}, reverse=True))}
    pieces = [(sp.id_to_piece(i), i, rank[sp.get_score(i)]) for i in normal]
    zero = sp.piece_to_id("<0x00>")
    text = [sp.id_to_piece(i).replace(SPACE, " ").encode() for i in ids]
    for i in ids:
        if sp.is_byte(i):
            text[i] = bytes([int(sp.id_to_piece(i)[3:5], 16)])
        elif sp.is_control(i):
            text[i] = b""
        elif sp.is_unknown(i):
            text[i] = " ⁇ ".encode()
    return Vocabulary(pieces, max(len(p) for p, _, _ in pieces), zero if sp.is_byte(zero) else None, sp.unk_id(), text)


def _unit_splitter(v: Vocabulary):
    """Cuts a text, with its spaces escaped and one put in front, where no piece can cross.

    That is before a run of spaces, around line ends, and before those marks that no piece has after a letter.
    """
    letters = "a-zA-ZÀ-ÖØ-öø-ÿ"
    joined = {m for p, _, _ in v.pieces for m in re.findall(f"(?<=[{letters}])[^{letters}]", p)}
    marks = "".join(re.escape(c) for c in ".,!?;:" if c not in joined)
    words = f"{SPACE}+[{letters}]+(?=[{marks}])|(?<=[{letters}])[{marks}][^{SPACE}\n]*|" if marks else ""
    unit = re.compile(f"{words}{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+")

    def coder(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        # words between single spaces are cut once each; texts with other spaces are cut whole
        odd = pc.match_substring_regex(texts, f"  |^ | $|{SPACE}")
        lists = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        coded = lists.flatten().dictionary_encode()
        code_of: dict[str, int] = defaultdict(itertools.count().__next__)
        cut = [[code_of[u] for u in unit.findall(SPACE + w)] if w else [] for w in coded.dictionary.to_pylist()]
        size = np.fromiter(map(len, cut), np.int64, len(cut))
        flat = np.fromiter((c for x in cut for c in x), np.int32, int(size.sum()))
        word = np.asarray(coded.indices)
        n_of = size[word]
        ends = np.concatenate([[0], np.cumsum(n_of)])
        codes = flat[np.repeat((np.cumsum(size) - size)[word] - ends[:-1], n_of) + np.arange(ends[-1])]
        at = ends[np.asarray(lists.offsets) - lists.offsets[0].as_py()]
        n = np.diff(at)
        if pc.any(odd).as_py():
            rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
            whole = {i: np.array([code_of[u] for u in unit.findall(SPACE + texts[i].as_py().replace(" ", SPACE))], np.int32) for i in rows.tolist()}
            codes = np.concatenate([whole[i] if i in whole else codes[at[i] : at[i + 1]] for i in range(len(n))])
            n[rows] = [len(whole[i]) for i in rows.tolist()]
        return list(code_of), codes, n, np.zeros(len(texts), np.uint32)

    return coder


def _numbered_units(rows: pa.Table) -> pa.Table:
    """The distinct units of one part of all dictionaries, numbered (kind 0), and each chunk's units as such numbers (kind 1)."""
    numbers: dict[bytes, int] = defaultdict(itertools.count().__next__)
    blobs = [pack(seq=np.fromiter((numbers[u] for u in unpack_strings(blob.as_py())), np.uint32)) for blob in rows["blob"]]
    n, m, part = len(numbers), len(blobs), rows["part"][0].as_py()
    out = pa.table({
        "kind": pa.array(np.repeat(np.array([0, 1], np.int32), [n, m])), "part": pa.array(np.full(n + m, part, np.int32)), "seq": pa.array([*range(n), *[None] * m], pa.int32()),
        "unit": pa.array([*(u.decode() for u in numbers), *[None] * m], pa.string()), "chunk": pa.concat_arrays([pa.nulls(n, pa.int64()), rows["chunk"].combine_chunks().cast(pa.int64())]), "blob": pa.array([*[None] * n, *blobs], pa.binary()),
    })
    release_memory()
    return out


def merge_with_heap(unit: str, ranks: dict[str, int]) -> list[str]:
    """The pieces that merging the best-ranked, then leftmost neighbours leaves of one unit."""
    text, after, before = list(unit), list(range(1, len(unit) + 1)), list(range(-1, len(unit) - 1))
    heap = []

    def offer(i: int) -> None:
        if 0 <= i and after[i] < len(text) and (rank := ranks.get(text[i] + text[after[i]])) is not None:
            heapq.heappush(heap, (rank, i, text[i], text[after[i]]))

    for i in range(len(text)):
        offer(i)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if text[i] != left or j >= len(text) or text[j] != right:
            continue
        text[i], text[j], after[i] = left + right, "", after[j]
        if after[j] < len(text):
            before[after[j]] = i
        offer(i)
        offer(before[i])
    return [t for t in text if t]


def best_path(unit: str, ranks: dict[str, int], longest: int, unknown_rank: int) -> int:
    """What `viterbi` gives, for one unit of any length: the fewest ids of the path of least total rank."""
    best = [(0, 0)]
    for end in range(1, len(unit) + 1):
        offers = []
        for start in range(max(0, end - longest), end):
            rank = ranks.get(unit[start:end], unknown_rank if end - start == 1 else None)
            if rank is not None:
                total, n = best[start]
                offers.append((total + rank, n + 1))
        best.append(min(offers))
    return best[-1][1]


def _merge_long(v: Vocabulary):
    ranks, ids = {p: r for p, _, r in v.pieces}, {p: i for p, i, _ in v.pieces}
    unknown_rank = _unknown_rank(v)

    def of(piece: str) -> list[int]:
        return [ids[piece]] if piece in ids else _ids_beyond(piece, v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[i for p in merge_with_heap(u, ranks) for i in of(p)] for u in b.column("unit").to_pylist()]
            best = pa.array([best_path(u, ranks, v.longest, unknown_rank) for u in b.column("unit").to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("seq"), pa.array(found, pa.list_(pa.int32())), best], ["part", "seq", "ids", "best"])

    return releasing(run)


def _ids_beyond(character: str, v: Vocabulary) -> list[int]:
    """The ids of a character that is no piece."""
    return [v.unknown] if v.byte_zero is None else [v.byte_zero + x for x in character.encode()]


def _unknown_rank(v: Vocabulary) -> int:
    """What a character that is no piece costs a path: more than any piece."""
    return max(r for _, _, r in v.pieces) + 10


def lattice(units: DataFrame, v: Vocabulary) -> DataFrame:
    """(part, seq, unit, edges) for units of at most LONGEST characters: every piece that stands in one, and every character.

    Substrings up to the longest piece are exploded and joined with the pieces; a unit's hits are the edges of its
    lattice. An edge is one long, best rank first, then leftmost: rank (20 bits), start (6), length (6), id (20; all ones: none).
    """
    spark = units.sparkSession
    pieces = F.broadcast(spark.createDataFrame(v.pieces, "piece string, id int, rank int"))
    # no piece of over one character begins with other two characters than these, nor is longer than the longest of them
    most: dict[str, int] = {}
    for p, _, _ in v.pieces:
        if len(p) > 1:
            most[p[:2]] = max(most.get(p[:2], 0), len(p))
    begins = F.broadcast(spark.createDataFrame(list(most.items()), "head string, most int"))
    # dealt by unit first, so that the edges are grouped where they arise
    short = units.where(F.length("unit") <= LONGEST).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part", "seq")
    starts = short.select("part", "seq", "unit", F.explode(F.sequence(F.lit(0), F.length("unit") - 1)).alias("start"))
    starts = starts.withColumn("head", F.expr("substring(unit, start + 1, 2)")).join(begins, "head", "left")
    spans = starts.select("part", "seq", "unit", "start", F.explode(F.expr("sequence(1, greatest(1, least(coalesce(most, 1), length(unit) - start)))")).alias("n"))
    hits = spans.withColumn("piece", F.expr("substring(unit, start + 1, n)")).join(pieces, "piece", "left").where("id is not null or n = 1")
    edge = F.expr(f"shiftleft(cast(coalesce(rank, 0) as bigint), 32) | shiftleft(cast(start as bigint), 26) | shiftleft(cast(n as bigint), 20) | coalesce(id, {NO_ID})")
    return hits.groupBy("part", "seq", "unit").agg(F.collect_list(edge).alias("edges"))


def _merges(unit: np.ndarray, edge: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The edges that merging leaves as symbols, marked, for edges in order of units: a fold of merges over all units at once.

    A unit's cut points are the bits of a long. Each step takes every unit's best-ranked, then leftmost edge that spans
    exactly two of its present symbols, and removes the cut between. Edges that can no longer be taken leave, and so do units
    without an edge to take.
    """
    one = np.uint64(1)
    first = ((edge >> 26) & 63).astype(np.uint64)
    last = first + ((edge >> 20) & 63).astype(np.uint64)
    ends, inner = (one << first) | (one << last), (one << last) - (one << (first + one))
    cuts = (one << (size.astype(np.uint64) + one)) - one
    order = np.lexsort((edge, unit))
    order = order[inner[order] != 0]
    u, both, between = unit[order], ends[order], inner[order]
    while len(u):
        here = cuts[u]
        alive = ((here & both) == both) & ((here & between) != 0)
        u, both, between, inside = u[alive], both[alive], between[alive], (here & between)[alive]
        takes = np.flatnonzero((inside & (inside - one)) == 0)
        # as edges are in order of rank, a unit's first that fits is the best
        takes = takes[np.diff(u[takes], prepend=-1) != 0]
        cuts[u[takes]] &= ~between[takes]
        goes_on = np.zeros(len(cuts), bool)
        goes_on[u[takes]] = True
        going = goes_on[u]
        u, both, between = u[going], both[going], between[going]
    return ((cuts[unit] & ends) == ends) & ((cuts[unit] & inner) == 0)


def viterbi(unit: np.ndarray, edge: np.ndarray, size: np.ndarray, unknown_rank: int) -> np.ndarray:
    """The fewest ids of each unit's path of least total rank: Viterbi, as a fold over the edges of all units by their ends.

    The state holds the best (total, ids) of every place reached, as one long. A character that is no piece costs `unknown_rank`.
    """
    first, cost = (edge >> 26) & 63, np.where((edge & NO_ID) == NO_ID, unknown_rank, edge >> 32)
    last = first + ((edge >> 20) & 63)
    order = np.lexsort((unit, last))
    unit, first, last, step = unit[order], first[order], last[order], (cost[order] << 8) + 1
    best = np.zeros((len(size), int(size.max(initial=0)) + 1), np.int64)
    bounds = np.searchsorted(last, np.arange(1, best.shape[1] + 1))
    for end, (lo, hi) in enumerate(itertools.pairwise(bounds.tolist()), 1):
        u = unit[lo:hi]
        begin = np.flatnonzero(np.diff(u, prepend=-1))
        best[u[begin], end] = np.minimum.reduceat(best[u, first[lo:hi]] + step[lo:hi], begin)
    return best[np.arange(len(size)), size] & 255


def _fold(v: Vocabulary):
    unknown_rank = _unknown_rank(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("edges")
            edge, size = np.asarray(lists.flatten()), np.asarray(pc.utf8_length(b.column("unit"))).astype(np.int64)
            unit = np.repeat(np.arange(len(size)), np.asarray(lists.value_lengths()))
            kept = np.flatnonzero(_merges(unit, edge, size))
            kept = kept[np.lexsort((edge[kept] & 0xFFFFFFFF, unit[kept]))]  # without the rank: by start
            ids, n, more = edge[kept] & NO_ID, np.ones(len(kept), np.int64), []
            for k in np.flatnonzero(ids == NO_ID).tolist():
                start = int(edge[kept[k]] >> 26) & 63
                more.append(_ids_beyond(b.column("unit")[int(unit[kept[k]])].as_py()[start], v))
                n[k] = len(more[-1])
            flat = np.repeat(ids, n)
            flat[flat == NO_ID] = [i for x in more for i in x]
            at = np.concatenate([[0], np.cumsum(np.bincount(unit[kept], n, len(size)).astype(np.int64))])
            found = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("seq"), found, pa.array(viterbi(unit, edge, size, unknown_rank), pa.int32())], ["part", "seq", "ids", "best"])

    return releasing(run)


def lattice_ids(units: DataFrame, v: Vocabulary) -> DataFrame:
    """(part, seq, ids, best) for distinct units (part, seq, unit): the library's ids, and how many Viterbi would take.

    Merges and Viterbi fold over the units' edges in the tasks that joined them, a batch of units at once. Longer units
    are merged with a heap, by the same rules.
    """
    schema = "part int, seq int, ids array<int>, best int"
    long = units.where(F.length("unit") > LONGEST).mapInArrow(_merge_long(v), schema)
    return lattice(units, v).mapInArrow(_fold(v), schema).unionByName(long)


def _answer(chunks: pa.Table, found: pa.Table) -> pa.Table:
    found = found.sort_by("seq")
    lists = found["ids"].combine_chunks()
    n = np.asarray(lists.value_lengths()).astype(np.int64)
    flat, starts, best = np.asarray(lists.flatten()), np.cumsum(n) - n, np.asarray(found["best"])
    out = []
    for blob in chunks["blob"]:
        seq = unpack(blob.as_py())["seq"].astype(np.int64)
        size = n[seq]
        ids = flat[np.repeat(starts[seq] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        # Viterbi's paths mostly have as many ids
        out.append(pack(n=size.astype(np.uint32), ids=ids.astype(np.uint32), fewer=(size - best[seq]).astype(np.int32)))
    release_memory()
    return pa.table({"chunk": chunks["chunk"], "part": chunks["part"], "blob": pa.array(out, pa.binary())})


def _lay_out(codes: dict[str, np.ndarray], answers: list[dict[str, np.ndarray]]) -> pa.Table:
    n, flat, fewer = (np.concatenate([a[k] for a in answers]) if answers else np.zeros(0, np.uint32) for k in ("n", "ids", "fewer"))
    first = np.concatenate([[0], np.cumsum(n.astype(np.int64))])
    lengths = n.astype(np.int64)[codes["codes"]]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    ids = flat.astype(np.int32)[np.repeat(first[codes["codes"]] - ends[:-1], lengths) + np.arange(ends[-1])]
    at = np.concatenate([[0], np.cumsum(codes["n"].astype(np.int64))])
    paths = np.concatenate([[0], np.cumsum((n.astype(np.int64) - fewer)[codes["codes"]])])
    lists = pa.ListArray.from_arrays(pa.array(ends[at], pa.int32()), pa.array(ids))
    return pa.table({"doc_id": id_array(codes), "text_crc32": codes["crc"].astype(np.int64), "ids": lists, "n_viterbi": paths[at[1:]] - paths[at[:-1]]})


def sentencepiece_encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc id, text_crc32, ids, n_viterbi): every text's ids by a BPE model of the sentencepiece library, as the library gives them.

    The model must keep white space and put a space in front (no other normalisation). Distinct units of the whole
    table go through `lattice_ids` once; a document's codes then index the answers. The named method folds Viterbi,
    which finds the path of best total score; this model's scores are merge ranks, for which that gives other ids than the
    library. So ids come from a fold of merges over the same lattice, and n_viterbi tells how many ids Viterbi's paths
    have. Characters outside the vocabulary become byte pieces.

    Null text counts as empty: no ids, checksum 0. Null ids and repeated rows are kept. An empty table gives no rows.
    Units longer than `LONGEST` characters, whose cut points don't fit in a long, are merged with a heap, and
    their best paths found by the same recurrence, in the task instead of the folds.
    """
    return encoded_with(docs, model, _lay_out, "doc_id long, text_crc32 long, ids array<int>, n_viterbi long", id_col, text_col).withColumnRenamed("doc_id", id_col)


def encoded_with(docs: DataFrame, model: str, finish: Callable, schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What `finish` makes of a chunk's codes and its units' ids, for every chunk."""
    spark = docs.sparkSession
    scratch, v = Scratch(spark, "sentencepiece"), load_vocabulary(model)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    codes, pieces = dictionary_chunks(slim, lambda: _unit_splitter(v), False, scratch, CHUNK, bucketed=True)
    numbered = scratch.write(pieces.groupBy("part").applyInArrow(_numbered_units, "kind int, part int, seq int, unit string, chunk long, blob binary"), "numbered", by="kind")
    scratch.drop(pieces)
    units, chunks = scratch.part(numbered, "kind=0"), scratch.part(numbered, "kind=1").select("chunk", "part", "blob")
    # a partition's units fit in memory, so their edges are grouped by hash; sorting them would spill
    with session_setting(spark, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(UNITS_AT_ONCE)):
        found = scratch.write(lattice_ids(units.select("part", "seq", "unit"), v), "found")
    scratch.drop(units)
    answers = scratch.write(chunks.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(_answer, "chunk long, part int, blob binary"), "answers")
    scratch.keep_only(codes, answers)
    return with_answers(codes, answers, finish, schema)


def decoded_texts(ids: pa.Array, texts: list[bytes]) -> pa.Array:
    """The text of each list of ids; invalid UTF-8 from byte pieces becomes U+FFFD."""
    flat, at = np.asarray(ids.flatten()), (np.asarray(ids.offsets) - ids.offsets[0].as_py()).tolist()
    whole = (b"".join(map(texts.__getitem__, flat[p:q].tolist())) for p, q in zip(at[:-1], at[1:], strict=True))
    # the first piece brings the space that encoding put in front
    return pa.array([None if not ok else t.removeprefix(b" ").decode("utf-8", "replace") for t, ok in zip(whole, ids.is_valid().to_pylist(), strict=True)], pa.string())


def sentencepiece_decode(encoded: DataFrame, model: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """Adds the text of a column of ids; invalid UTF-8 from byte pieces becomes U+FFFD. Null ids give null text."""
    texts = load_vocabulary(model).text_of
    schema = encoded.drop(text_col).schema.add(text_col, "string")
    columns = [f.name for f in schema][:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), decoded_texts(b.column(ids_col), texts)], [*columns, text_col])

    return encoded.mapInArrow(releasing(run), schema)


def encode_digest(spark: SparkSession, docs: DataFrame, model: str, id_col: str = "doc_id") -> DataFrame:
    """(doc id, n_ids, n_viterbi, ids_crc32, decoded_crc32, round_trip) of encoding `docs` and decoding again."""
    texts = load_vocabulary(model).text_of

    def digest(codes: dict[str, np.ndarray], answers: list[dict[str, np.ndarray]]) -> pa.Table:
        rows = _lay_out(codes, answers)
        ids = rows["ids"].combine_chunks()
        flat, at = np.asarray(ids.flatten()).astype("<u4"), (np.asarray(ids.offsets) - ids.offsets[0].as_py()).tolist()
        crc = [zlib.crc32(flat[p:q]) for p, q in zip(at[:-1], at[1:], strict=True)]
        decoded = [zlib.crc32(t.as_py().encode()) for t in decoded_texts(ids, texts)]
        return pa.table({"doc_id": rows["doc_id"], "n_ids": pa.array(np.diff(at), pa.int64()), "n_viterbi": rows["n_viterbi"], "ids_crc32": pa.array(crc, pa.int64()), "decoded_crc32": pa.array(decoded, pa.int64()), "round_trip": np.asarray(rows["text_crc32"]) == np.array(decoded, np.int64)})

    return encoded_with(docs, model, digest, "doc_id long, n_ids long, n_viterbi long, ids_crc32 long, decoded_crc32 long, round_trip boolean", id_col).withColumnRenamed("doc_id", id_col)
