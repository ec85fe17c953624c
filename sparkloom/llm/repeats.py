"""Passages that recur across a corpus, found through an index of every block.

The corpus is cut into reference blocks of whole documents, each a row of a
written table. Every window of units (words, lines) picks the least hash of its
grams as its anchor, so that two equal windows always pick the same one. Then:

1. Anchors of all blocks meet by their hash; those that stand at two places or
   more go back to their blocks, which is where windows can recur at all.
2. The windows around such an anchor meet under the anchor's hash and are
   compared by 128 bits. A window that stands elsewhere gets a reference: the
   first place that holds the same units.
3. In its block windows that go on in step with their references are matches,
   and a greedy parse from left to right takes as the next factor the match
   that reaches farthest from where it stands. What factors hold goes.

Every step costs in proportion to the corpus, whatever its size. Equal entries
are merged in their block, then under a salt, then under their hash, so that a
passage which a third of all documents hold never meets in one group as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import spans
from .blobs import packed, unpacked
from .shared import renamed, written

#: Text bytes that one reference block holds, about; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20
#: Text bytes for each bucket of hashes, about.
BUCKET_BYTES = 32 << 20
#: Blocks that meet under one salt, about: as a block tells a hash once, what a very common one adds to a group (40 MB). Fewer
#: would only cut the other hashes into groups of a few entries.
SALTED = 1 << 20
_COUNTER_BITS = 33


@dataclass(frozen=True)
class Units:
    """How texts split: ``split(data, offsets)`` gives begin, end and text number of each unit."""

    split: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
    window: int
    gram: int
    #: Whether all equal windows go or all but the first in the order of (id, block, place).
    keep_first: bool
    #: Further windows that count: (units, words that they hold at least).
    also: tuple[tuple[int, int], ...] = ()

    @property
    def widths(self) -> tuple[int, ...]:
        return self.window, *(width for width, _ in self.also)


@dataclass
class Entries:
    """What a block tells of its anchors or windows: hashes, the order of their documents, block, place, and whether the place is known to recur."""

    hashes: np.ndarray
    order: np.ndarray
    block: np.ndarray
    place: np.ndarray
    known: np.ndarray

    def take(self, at: np.ndarray) -> Entries:
        return Entries(self.hashes[at], self.order[at], self.block[at], self.place[at], self.known[at])


@dataclass
class Found:
    """Places that recur, each with a place elsewhere that holds the same."""

    block: np.ndarray
    place: np.ndarray
    other_block: np.ndarray
    other: np.ndarray


def merge(held: Entries, keep_first: bool) -> tuple[Found, Entries]:
    """What recurs among the entries, and one entry of each hash to be merged further.

    With ``keep_first`` all entries but the first of a hash are found; without
    it all that another one equals, and the one that goes on remembers that.
    """
    held = held.take(np.lexsort((held.place, held.block, held.order, *held.hashes.T)))
    n = len(held.place)
    if not n:
        return Found(held.block, held.place, held.block, held.place), held
    new = np.r_[True, (held.hashes[1:] != held.hashes[:-1]).any(axis=1)]
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    several = np.diff(np.r_[first, n]) > 1
    at = np.arange(n)
    goes = at != first[group] if keep_first else several[group] & ~held.known
    other = first[group]
    other = np.where(other == at, np.minimum(other + 1, n - 1), other)[goes]
    found = Found(held.block[goes], held.place[goes], held.block[other], held.place[other])
    rest = held.take(first)
    rest.known = rest.known | several
    return found, rest


def runs_of(found: Found, kinds: int) -> tuple[np.ndarray, ...]:
    """Block, first place, number, and the other block and place of runs of places that go on in step with their references."""
    order = np.lexsort((found.place, found.place % kinds, found.block))
    block, place, other_block, other = found.block[order], found.place[order], found.other_block[order], found.other[order]
    new = np.ones(len(place), bool)
    new[1:] = (block[1:] != block[:-1]) | (place[1:] != place[:-1] + kinds) | (other_block[1:] != other_block[:-1]) | (other[1:] != other[:-1] + kinds)
    first = np.flatnonzero(new)
    return block[first], place[first], np.diff(np.r_[first, len(place)]), other_block[first], other[first]


# -- windows of a block --------------------------------------------------------


def anchors(units: Units, data: np.ndarray, offsets: np.ndarray):
    """Text of each unit, both lanes of its hash; for each kind of window its width, which are valid, their anchor's hash and its place."""
    begin, end, text = units.split(data, offsets)
    hashes, kinds = spans.hash_spans(data, begin, end), []
    if units.also:
        first, _, _ = spans.split(data, offsets)
        words = np.searchsorted(first, begin), np.searchsorted(first, end)
    for width, gram, most in ((units.window, units.gram, 0), *((width, 1, most) for width, most in units.also)):
        n = max(len(begin) - width + 1, 0)
        valid = text[:n] == text[width - 1 :] if n else np.zeros(0, bool)
        if most and n:
            valid &= words[1][width - 1 :] - words[0][:n] >= most
        least, place = spans.leftmost_minima(spans.hash_windows(hashes, gram), width - gram + 1)
        kinds.append((width, valid, least[:n], place[:n]))
    return (begin, end, text), hashes, kinds


def _anchor_entries(units: Units, data: np.ndarray, offsets: np.ndarray, order: np.ndarray, block: int) -> Entries:
    """Every anchor of the block, once; places count units, times the kinds of windows, plus the kind."""
    _, _, kinds = anchors(units, data, offsets)
    places, hashes = [], []
    for kind, (_, valid, least, place) in enumerate(kinds):
        at, one = np.unique(place[valid], return_index=True)
        places.append(at * len(kinds) + kind)
        hashes.append(spans.mix(least[valid][one] + np.uint64(kind)))
    place, none = np.concatenate(places), np.zeros(sum(map(len, places)), np.int64)
    return Entries(np.concatenate(hashes)[:, None], none, np.full(len(place), block), place, np.zeros(len(place), bool))


def _window_entries(units: Units, data: np.ndarray, offsets: np.ndarray, order: np.ndarray, block: int, recurring: np.ndarray) -> Entries:
    """Every window whose anchor is at one of the places given; the first hash is the anchor's."""
    (begin, end, text), hashes, kinds = anchors(units, data, offsets)
    recurs = np.zeros(len(text) * len(kinds), bool)
    recurs[recurring] = True
    lanes, places = [], []
    for kind, (width, valid, least, place) in enumerate(kinds):
        at = np.flatnonzero(valid & recurs[place * len(kinds) + kind])
        if len(at):
            second = spans.hash_windows(spans.hash_spans(data, begin, end, 1), width, 1)
            lanes.append(np.stack([spans.mix(least[at] + np.uint64(kind)), spans.hash_windows(hashes, width)[at], second[at]], axis=1))
            places.append(at * len(kinds) + kind)
    if not places:
        none = np.zeros(0, np.int64)
        return Entries(np.zeros((0, 3), np.uint64), none, none, none, none.astype(bool))
    place = np.concatenate(places)
    return Entries(np.concatenate(lanes), order[text[place // len(kinds)]], np.full(len(place), block), place, np.zeros(len(place), bool))


# -- jobs ------------------------------------------------------------------------

_ENTRY = "bucket long, block long, blocks binary, hashes binary, orders binary, places binary, known binary, counts binary, other_blocks binary, others binary"
_ENTRY_NAMES = [x.split()[0] for x in _ENTRY.split(", ")]


def _entry_rows(held: Entries, buckets: int, one_block: int | None, ordered: bool) -> pa.Table:
    """Packed entries by bucket; ``one_block`` if all stem from one."""
    by = dict(hashes=held.hashes, places=held.place.astype(np.int32), known=held.known)
    if ordered:
        by["orders"] = held.order
    if one_block is None:
        by["blocks"] = held.block
    rows = packed((held.hashes[:, 0] % np.uint64(buckets)).astype(np.int64), **by)
    rows["bucket"] = rows.pop("group")
    n = len(rows["bucket"])
    rows["block"] = pa.array(np.full(n, -1 if one_block is None else one_block))
    return pa.table([rows.get(x, pa.nulls(n, pa.binary())) for x in _ENTRY_NAMES], names=_ENTRY_NAMES)


def _found_rows(found: Found, buckets: int, kinds: int) -> pa.Table:
    """Packed runs by block; they have no hashes."""
    block, place, count, other_block, other = runs_of(found, kinds)
    rows = packed(block, places=place.astype(np.int32), counts=count.astype(np.int32), other_blocks=other_block, others=other.astype(np.int32))
    rows["block"] = rows.pop("group")
    n = len(rows["block"])
    rows["bucket"] = pa.array(np.mod(rows["block"].to_numpy(), buckets))
    return pa.table([rows.get(x, pa.nulls(n, pa.binary())) for x in _ENTRY_NAMES], names=_ENTRY_NAMES)


def _entries_of(table: pa.Table, lanes: int, ordered: bool) -> Entries:
    place = unpacked(table["places"], np.int32).astype(np.int64)
    sizes = np.array([len(x.as_buffer()) // 4 for x in table["places"]], np.int64)
    parts = [np.full(n, b) if not x.is_valid else np.frombuffer(x.as_buffer(), np.int64) for n, b, x in zip(sizes.tolist(), table["block"].to_pylist(), table["blocks"], strict=True)]
    block = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    order = unpacked(table["orders"], np.int64) if ordered else np.zeros(len(place), np.int64)
    return Entries(unpacked(table["hashes"], np.uint64).reshape(-1, lanes), order, block, place, unpacked(table["known"], np.bool_))


def _merged(rows: DataFrame, units: Units, lanes: int, keep_first: bool, buckets: int, salts: int) -> DataFrame:
    """Runs of places that recur, by block, from rows that blocks emitted: under a salt first, if there are several, then under the bucket."""
    kinds = len(units.widths)

    def step(last: bool):
        def meet(table: pa.Table) -> pa.Table:
            told = pc.is_null(table["hashes"])
            found, rest = merge(_entries_of(table.filter(pc.invert(told)), lanes, keep_first), keep_first)
            parts = [table.filter(told).select(_ENTRY_NAMES), _found_rows(found, buckets, kinds)]
            return pa.concat_tables(parts if last else [*parts, _entry_rows(rest, buckets, None, keep_first)])

        return meet

    if salts > 1:
        rows = rows.groupBy("bucket", F.pmod(F.xxhash64("block"), F.lit(salts)).alias("salt")).applyInArrow(step(False), _ENTRY)
    return rows.groupBy("bucket").applyInArrow(step(True), _ENTRY).select("block", "places", "counts", "other_blocks", "others")


def _payload(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def rows_of(payload: pa.Scalar) -> pa.Table:
    """The rows that a block's payload holds."""
    return pa.ipc.open_stream(payload.as_buffer()).read_all().combine_chunks()


def reference_blocks(docs: DataFrame, text_col: str) -> DataFrame:
    """``block``, ``bytes`` of text and ``payload``, the rows themselves, of every reference block; a written table."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << _COUNTER_BITS
        for batch in batches:
            _, offsets = spans.bytes_of(batch.column(text_col))
            for i, j in spans.slices(offsets, BLOCK_BYTES):
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([offsets[j] - offsets[i]]), pa.array([_payload(batch.slice(i, j - i))], pa.binary())], names=["block", "bytes", "payload"])
                number += 1

    return written(docs.mapInArrow(emit, "block long, bytes long, payload binary"), "blocks")


def matches(units: Units, place: np.ndarray, count: np.ndarray, other_block: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, ...]:
    """A block's matches, in order: first unit, units, and the block and unit where the reference begins.

    Windows that go on in step with their reference are one match, however many
    buckets they came from; it ends where its reference parts from the text.
    """
    kinds = len(units.widths)
    order = np.lexsort((place, place % kinds))
    place, count, other_block, other = place[order], count[order], other_block[order], other[order]
    goes_on = np.zeros(len(place), bool)
    goes_on[1:] = (place[1:] == place[:-1] + count[:-1] * kinds) & (other_block[1:] == other_block[:-1]) & (other[1:] == other[:-1] + count[:-1] * kinds)
    first = np.flatnonzero(~goes_on)
    windows = np.add.reduceat(count, first) if len(first) else count
    begin, kind = np.divmod(place[first], kinds)
    size = windows + np.array(units.widths)[kind] - 1
    order = np.lexsort((-size, begin))
    return begin[order], size[order], other_block[first][order], other[first][order] // kinds


def factors(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which matches, in the order of their first unit, a greedy parse takes as factors.

    It reads from left to right. Where it stands it takes, of all matches that
    begin no later, the one that reaches farthest; so a match that crosses the
    end of the factor before, or meets it, is looked at there and goes on as
    the next factor. Where none reaches beyond it goes to the next match.
    """
    chosen, stand, best, far = [], -1, -1, -1
    for k, (low, high) in enumerate(zip(begin.tolist(), (begin + size).tolist(), strict=True)):
        if low > stand and far > stand:
            chosen.append(best)
            stand = far
        if low > stand:
            stand = low
        if high > far:
            best, far = k, high
    if far > stand:
        chosen.append(best)
    return np.array(chosen, np.int64)


def covered(begin: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` units the spans hold."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + size, -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, units: Units, rewrite: Callable, id_col: str, text_col: str, counts: tuple[str, str]) -> DataFrame:
    """``docs`` with texts rewritten and two counts more: units before, units removed.

    ``rewrite(data, offsets, begin, end, text, gone)`` gives the new bytes and
    offsets. Input columns named as the counts are replaced. Every row is a
    document of its own, repeated or not. A null text counts as empty and comes
    out empty. A text is held whole in one task, at about 60 bytes for each of
    its bytes.
    """
    spark = docs.sparkSession
    docs, own = renamed(docs, counts)
    id_col, text_col = own[id_col], own[text_col]
    schema = T.StructType([*docs.schema.fields, T.StructField(counts[0], T.LongType()), T.StructField(counts[1], T.LongType())])
    names, kept, keep_first = schema.names, docs.columns, units.keep_first
    blocks = reference_blocks(docs.withColumn("order", F.coalesce(F.col(id_col).try_cast("long"), F.lit(2**63 - 1))), text_col)
    total, n = blocks.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    buckets = max(-(-total // BUCKET_BYTES), 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    salts = max(1, -(-n // SALTED))
    kinds = len(units.widths)

    def told(held: Entries, block: int, first: bool) -> pa.Table:
        found, rest = merge(held, first)
        return pa.concat_tables([_found_rows(found, buckets, kinds), _entry_rows(rest, buckets, block, first)])

    def texts(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return *spans.bytes_of(rows[text_col]), rows["order"].to_numpy()

    def emit_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload"), strict=True):
                yield from told(_anchor_entries(units, *texts(rows_of(payload)), block), block, False).to_batches()

    def emit_windows(left: pa.Table, right: pa.Table) -> pa.Table:
        place, count = unpacked(right["places"], np.int32).astype(np.int64), unpacked(right["counts"], np.int32)
        place = np.repeat(place, count) + kinds * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
        parts = [told(_window_entries(units, *texts(rows_of(payload)), block, place), block, keep_first) for block, payload in zip(left["block"].to_pylist(), left["payload"], strict=True)]
        return pa.concat_tables(parts) if parts else pa.Table.from_batches([], pa.schema([(x, pa.int64() if x in ("bucket", "block") else pa.binary()) for x in _ENTRY_NAMES]))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        found = (unpacked(right["places"], np.int32).astype(np.int64), unpacked(right["counts"], np.int32).astype(np.int64), unpacked(right["other_blocks"], np.int64), unpacked(right["others"], np.int32).astype(np.int64))
        parts = []
        for payload in left["payload"]:
            rows = rows_of(payload)
            data, offsets = spans.bytes_of(rows[text_col])
            begin, end, text = units.split(data, offsets)
            begins, sizes, _, _ = matches(units, *found)
            chosen = factors(begins, sizes)
            gone = covered(begins[chosen], sizes[chosen], len(text))
            out, bounds = rewrite(data, offsets, begin, end, text, gone)
            new = pa.Array.from_buffers(pa.string(), len(rows), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(out))])
            held, removed = np.bincount(text, minlength=len(rows)), np.bincount(text, gone, minlength=len(rows)).astype(np.int64)
            parts.append(pa.table([*(new if name == text_col else rows[name] for name in kept), pa.array(held), pa.array(removed)], names=names))
        return pa.concat_tables(parts)

    by_block = blocks.select("block", "payload").groupBy("block")
    recurring = _merged(blocks.select("block", "payload").mapInArrow(emit_anchors, _ENTRY), units, 1, False, buckets, salts)
    windows = by_block.cogroup(recurring.groupBy("block")).applyInArrow(emit_windows, _ENTRY)
    found = _merged(windows, units, 3, keep_first, buckets, salts)
    return by_block.cogroup(found.groupBy("block")).applyInArrow(finish, schema).toDF(*own, *counts)
