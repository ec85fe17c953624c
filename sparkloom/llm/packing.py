"""Packing: window-filling combinations of lengths, with repeats by non-negative least squares."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import spans
from .encoding import Encoder, ragged
from .shared import sums_before, written

WINDOW = 2048
END_ID = 1
#: Lengths, the most frequent ones, that triples are made of.
TRIPLE_LENGTHS = 96
#: Copies of one length that a combination repeats at most.
COPIES = 8
#: Documents, about, that are planned together where their order counts.
CHUNK = 4096


# -- token ids -------------------------------------------------------------


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _ended(ids: np.ndarray, count: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each text's, and where each text's begin."""
    bounds = np.r_[0, np.cumsum(count + 1)]
    out = np.empty(int(bounds[-1]), "<u4")
    inside = np.ones(len(out), bool)
    inside[bounds[1:] - 1] = False
    out[inside], out[~inside] = ids, end_id
    return out, bounds


# -- plan ------------------------------------------------------------------


def combinations(histogram: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """Lengths that fill the window: copies of one and a rest, and triples of frequent ones."""
    there = histogram > 0
    found = set()
    for a in np.flatnonzero(there).tolist():
        for copies in range(1, min(COPIES, window // a) + 1):
            rest = window - copies * a
            if rest == 0 or (rest < len(there) and there[rest]):
                found.add(tuple(sorted([a] * copies + [rest] * (rest > 0))))
    often = np.argsort(-histogram, kind="stable")[:TRIPLE_LENGTHS]
    often = sorted(x for x in often.tolist() if there[x])
    for i, a in enumerate(often):
        for b in often[i:]:
            if (c := window - a - b) >= b and there[c]:
                found.add((a, b, c))
    return sorted(found)


def nonnegative_least_squares(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, wanted: np.ndarray, n: int, rounds: int = 400) -> np.ndarray:
    """x >= 0 that brings A x near ``wanted``, A given by its entries: accelerated projected gradients."""
    forward = lambda x: np.bincount(rows, values * x[columns], minlength=len(wanted))
    back = lambda y: np.bincount(columns, values * y[rows], minlength=n)
    v = np.ones(n)
    for _ in range(30):
        v = back(forward(v))
        v /= (norm := np.linalg.norm(v)) or 1.0
    step, x, y, t = 1 / (1.05 * norm or 1.0), np.zeros(n), np.zeros(n), 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(forward(y) - wanted))
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, y, t = new, new + (t - 1) / later * (new - x), later
    return x


def plan(histogram: np.ndarray, window: int = WINDOW) -> tuple[dict[str, np.ndarray], np.ndarray, int]:
    """Where pieces shorter than the window go, by length and rank within the length.

    Returns slots (length, first rank, repeats, first sequence, offset) sorted
    by length and rank, the number of ranks of each length that slots take,
    and the number of sequences that they fill. All of it has the size of the
    histogram, whatever the number of documents.
    """
    left, taken = histogram.astype(np.int64).copy(), np.zeros(window, np.int64)
    slots: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    if combos := combinations(histogram, window):
        parts = [np.unique(c, return_counts=True) for c in combos]
        columns = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        rows, values = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(float)
        repeats = nonnegative_least_squares(rows, columns, values, histogram.astype(float), len(combos))
        for wanted in (np.floor(repeats), np.full(len(combos), np.inf)):  # as solved; then what is left, greedily
            for k in np.argsort(-repeats, kind="stable"):
                lengths, copies = parts[k]
                if (n := int(min(wanted[k], (left[lengths] // copies).min()))) > 0:
                    offset = 0
                    for length in combos[k]:
                        slots.append((length, int(taken[length]), n, sequences, offset))
                        taken[length] += n
                        left[length] -= n
                        offset += length
                    sequences += n
    table = np.array(sorted(slots), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "repeats", "sequence", "offset"), table.T.copy(), strict=True)), taken, sequences


def place(length: np.ndarray, rank: np.ndarray, slots: dict[str, np.ndarray], taken: np.ndarray, base: np.ndarray, sequences: int, total: int, window: int) -> tuple[np.ndarray, ...]:
    """Pieces (row, start, size, sequence, offset) of short pieces.

    Ranks beyond the slots lie one after the other in a stream that is cut at
    every window; what its last window holds is cut into powers of two, each
    a sequence without padding.
    """
    out = []
    planned = np.flatnonzero(rank < taken[length])
    if len(planned):
        deep = int(max(slots["rank"].max(), rank.max())) + 1
        at = np.searchsorted(slots["length"] * deep + slots["rank"], length[planned] * deep + rank[planned], side="right") - 1
        out.append((planned, np.zeros(len(planned), np.int64), length[planned], slots["sequence"][at] + rank[planned] - slots["rank"][at], slots["offset"][at]))
    rows = np.flatnonzero(rank >= taken[length])
    if len(rows):
        full = total // window * window
        edges, at = [full], full
        for bit in reversed(range(window.bit_length() - 1)):
            if (total - full) >> bit & 1:
                at += 1 << bit
                edges.append(at)
        low = base[length[rows]] + (rank[rows] - taken[length[rows]]) * length[rows]
        high, start = low + length[rows], low.copy()
        tail = np.array(edges, np.int64)
        while len(rows):
            in_tail = start >= full
            tail_at = np.searchsorted(tail, start, side="right") - 1
            begin = np.where(in_tail, tail[np.maximum(tail_at, 0)], start // window * window)
            end = np.where(in_tail, tail[np.minimum(tail_at + 1, len(tail) - 1)], begin + window)
            sequence = sequences + np.where(in_tail, full // window + tail_at, start // window)
            until = np.minimum(end, high)
            out.append((rows, start - low, until - start, sequence, start - begin))
            more = until < high
            rows, low, high, start = rows[more], low[more], high[more], until[more]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 5


# -- jobs ------------------------------------------------------------------


def _encoded(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, window: int, end_id: int) -> DataFrame:
    """Per document its ids' number, the checksums of its full windows, and the ids of the rest with its rank among a task's rests of this length."""
    names = ["doc_id", "doc_tokens", "full_crc32", "rest", "length", "part", "local_rank"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen, part = _encoder(vocabulary), np.zeros(window, np.int64), TaskContext.get().partitionId()
        small = encoder.merges.size <= 1 << 16
        for batch in batches:
            data, offsets = spans.bytes_of(batch.column(1))
            for i, j in spans.slices(offsets):
                ids, bounds = _ended(*encoder.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), end_id)
                tokens = np.diff(bounds)
                full, length = tokens // window, tokens % window
                raw, crcs, ranks = memoryview(ids.tobytes()), [], []
                for a, n, rest in zip(bounds[:-1].tolist(), full.tolist(), length.tolist(), strict=True):
                    crcs.append([zlib.crc32(raw[4 * (a + k * window) : 4 * (a + (k + 1) * window)]) for k in range(n)])
                    ranks.append(seen[rest])
                    seen[rest] += 1
                at = ragged(bounds[1:] - length, length)
                rests = ids[at].astype(np.uint16) if small else ids[at]
                edges = np.r_[0, np.cumsum(length)] * rests.itemsize
                rests = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(rests)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(tokens), pa.array(crcs, pa.list_(pa.int64())), rests, pa.array(length), pa.array(np.full(j - i, part)), pa.array(ranks, pa.int64())], names=names)

    kinds = (docs.schema[id_col].dataType, T.LongType(), T.ArrayType(T.LongType()), T.BinaryType(), T.LongType(), T.LongType(), T.LongType())
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)])
    return docs.select(id_col, text_col).mapInArrow(encode, schema)


def _pieces_of(length: np.ndarray, rank: np.ndarray, tokens: np.ndarray, crcs: list, rests: pa.Array, planned: tuple, window: int, full_sequence: Callable) -> tuple[np.ndarray, list[np.ndarray]]:
    """The row of each piece and its start, length, ids_crc32, doc_tokens, sequence_id and offset; ``full_sequence(owner, nth)`` numbers full windows."""
    some = np.flatnonzero(length)
    row, start, size, sequence, offset = place(length[some], rank[some], *planned, window)
    row = some[row]
    crc = []
    for k, a, n in zip(row.tolist(), start.tolist(), size.tolist(), strict=True):
        raw = rests[k].as_buffer()
        crc.append(_crc(np.frombuffer(raw, np.uint16 if len(raw) == 2 * length[k] else np.uint32)[a : a + n]))
    start = start + tokens[row] - length[row]
    full = np.array([len(x) for x in crcs], np.int64)
    owner = np.repeat(np.arange(len(full)), full)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)
    columns = [
        np.r_[start, nth * window],
        np.r_[size, np.full(len(owner), window)],
        np.r_[np.array(crc, np.int64), np.array([c for x in crcs for c in x], np.int64)],
        np.r_[tokens[row], tokens[owner]],
        np.r_[sequence, full_sequence(owner, nth)],
        np.r_[offset, np.zeros(len(owner), np.int64)],
    ]
    return np.r_[row, owner], [x.astype(np.int64) for x in columns]


_PIECE = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sequences of at most ``window`` tokens that hold all documents, one row per piece.

    A document's ids are those of its text and then ``end_id``; it is cut into
    full windows and a rest. Rests of equal length are interchangeable, so the
    plan needs only their histogram: combinations of lengths that fill a
    window get their repeats by non-negative least squares, rounded down and
    topped up greedily; rests left over follow each other and are cut where a
    window ends, the last window into powers of two. No sequence has padding.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset; other input columns are left out. Null and empty texts give one
    piece with the end id alone; repeated rows are packed each; null ids are
    kept; an empty table gives no pieces. A very long text is encoded whole in
    one task, at about 60 bytes for each of its bytes.
    """
    spark = docs.sparkSession
    encoded = written(_encoded(docs, vocabulary, id_col, text_col, window, end_id), "packing")
    parts = encoded.groupBy("length", "part").agg((F.max("local_rank") + 1).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    counts = encoded.groupBy("length").agg(F.count("*").alias("n"), F.max(F.size("full_crc32")).alias("full")).collect()  # a row per length: at most ``window``
    histogram = np.zeros(window, np.int64)
    for length, n, _ in counts:
        histogram[length] = n
    most_full = max((x[2] for x in counts), default=0)
    numbered = np.r_[0, np.cumsum(histogram)[:-1]]  # of a length's first document among all
    histogram[0] = 0
    slots, taken, sequences = plan(histogram, window)
    sizes = (histogram - taken) * np.arange(window)
    base, total = np.r_[0, np.cumsum(sizes)[:-1]], int(sizes.sum())
    tail = sequences + total // window + window.bit_length()
    shared = spark.sparkContext.broadcast((slots, taken, base))
    kinds = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *(T.StructField(n, T.LongType()) for n in _PIECE)])
    names = kinds.names

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, taken, base = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            tokens, crcs, rests = batch.column("doc_tokens").to_numpy(), batch.column("full_crc32").to_pylist(), batch.column("rest")
            number = lambda owner, nth: tail + (numbered[length[owner]] + rank[owner]) * most_full + nth
            row, columns = _pieces_of(length, rank, tokens, crcs, rests, (slots, taken, base, sequences, total), window, number)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), *map(pa.array, columns)], names=names)

    ranked = encoded.join(parts.select("length", "part", "first"), ["length", "part"]).withColumn("rank", F.col("first") + F.col("local_rank"))
    return ranked.select("doc_id", "doc_tokens", "full_crc32", "rest", "length", "rank").mapInArrow(pieces, kinds)


def pack_in_order(docs: DataFrame, vocabulary: str, schedule: Callable[[DataFrame], DataFrame], keep: tuple[str, ...], window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``pack``, but sequences are numbered in the order of a schedule.

    ``schedule(rows)`` gets rows with ``doc_id`` and the columns ``keep`` and
    adds ``at``, a different long for each row. Documents that follow each
    other there are planned together, about ``CHUNK`` at a time, and a chunk's
    sequences come in the order of the first document that each holds. Rests
    that fill no window are cut at the end of their chunk.

    Null and empty texts give one piece with the end id alone; null and
    repeated ids are packed each; other columns than the id and ``keep`` are
    left out, whatever their names; a very long text is encoded whole in one
    task and then holds as many windows as it fills; an empty table gives no
    pieces. Chunks and sequences are numbered by sums in two levels; no table
    that grows with the documents is sent to all tasks or sorted in one.
    """
    rows = docs.select(F.struct(F.col(id_col).alias("doc_id"), *keep).alias("who"), text_col)
    encoded = _encoded(rows, vocabulary, "who", text_col, window, end_id).select("doc_id.*", "doc_tokens", "full_crc32", "rest", "length")
    ordered = written(schedule(written(encoded, "packing")).select("doc_id", "at", "doc_tokens", "full_crc32", "rest", "length"), "scheduled")
    cell = F.floor(F.col("at") / CHUNK).alias("cell")
    cells = written(ordered.groupBy(cell).agg(F.count("*").alias("n")), "cells")
    chunks = sums_before(cells, "cell", "n", "before").select("cell", F.floor(F.col("before") / CHUNK).alias("chunk"))
    kinds = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("doc_id", docs.schema[id_col].dataType), *(T.StructField(n, T.LongType()) for n in _PIECE)])
    names = kinds.names

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("at").combine_chunks()
        length, tokens = table["length"].to_numpy(), table["doc_tokens"].to_numpy()
        histogram, order = np.bincount(length, minlength=window), np.argsort(length, kind="stable")
        rank = np.empty(len(length), np.int64)
        rank[order] = np.arange(len(length)) - np.r_[0, np.cumsum(histogram)[:-1]][length[order]]
        histogram[0] = 0
        slots, taken, sequences = plan(histogram, window)
        sizes = (histogram - taken) * np.arange(window)
        base, total = np.r_[0, np.cumsum(sizes)[:-1]], int(sizes.sum())
        number = lambda owner, nth: sequences + total // window + window.bit_length() + np.arange(len(owner))
        row, columns = _pieces_of(length, rank, tokens, table["full_crc32"].to_pylist(), table["rest"].combine_chunks(), (slots, taken, base, sequences, total), window, number)
        sequence, held = np.unique(columns[4], return_inverse=True)
        first = np.full(len(sequence), len(length))
        np.minimum.at(first, held, row)
        new = np.empty(len(sequence), np.int64)
        new[np.lexsort((sequence, first))] = np.arange(len(sequence))
        columns[4] = new[held]
        taken_rows = pa.array(row)
        return pa.table([table["chunk"].take(taken_rows), table["doc_id"].take(taken_rows), *map(pa.array, columns)], names=names)

    fitted = written(ordered.withColumn("cell", cell).join(chunks, "cell").drop("cell").groupBy("chunk").applyInArrow(fit, kinds), "fitted")
    sizes = written(fitted.groupBy("chunk").agg((F.max("sequence_id") + 1).alias("n")), "chunks")
    firsts = sums_before(sizes, "chunk", "n", "first").select("chunk", "first")
    numbered = fitted.join(firsts, "chunk").withColumn("sequence_id", F.col("first") + F.col("sequence_id"))
    return numbered.select("doc_id", *_PIECE)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
