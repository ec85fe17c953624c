"""Cross-tokenizer alignment: token ends of two vocabularies compared along diagonals, one-to-one runs skipped."""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import spans
from .blobs import packed, unpacked
from .bpe import byte_letters
from .encoding import ragged
from .shared import written

#: Text bytes of one block of documents, about; a longer text is a block of its own.
BLOCK_BYTES = 6 << 20
#: Stretches, the most frequent ones of a block, whose alignment a worker keeps for the next block.
KEPT_STRETCHES = 50_000
#: Stretches that are tokenised at once, and stretches of documents whose pairs are counted at once.
TOGETHER, COUNTED = 8192, 100_000
#: Text bytes that are cut into stretches at once, about.
SLICE_BYTES = 1 << 20
#: Linked pairs that a task adds up before it tells them.
HELD_PAIRS = 2_000_000
#: Linked pairs of blocks for each bucket, about.
BUCKET_PAIRS = 1_000_000
#: A space between two characters that aren't white space: both vocabularies always end a token before it.
CUT = re.compile(r"(?<=\S) (?=\S)")
_UNCLEAN = re.compile(r"^\s|\s$|\s \s?|\s? \s")
_COUNTER_BITS = 33


# -- alignment ---------------------------------------------------------------------


def align(ends_a: np.ndarray, from_a: np.ndarray, ends_b: np.ndarray, from_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens of each side end a group, in many sequences at once.

    ``ends_a`` and ``ends_b`` hold the byte offsets at which tokens end, one
    sequence after the other, ``from_a`` and ``from_b`` where each sequence's
    begin and at last the number of all; a sequence's last ends are equal.

    Each sequence stands at a pair of tokens, whose difference is its shift. It
    compares the next 1, 2, 4, ... ends of both sides at this shift; as long as
    all are equal, every token is a group with its partner and the sequence
    jumps over them. At the first pair that differs the side that is behind
    goes on until both end at one byte: that is a group of several tokens, and
    the shift becomes what it is after it.
    """
    cut_a, cut_b = np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)
    i, j, probe = from_a[:-1].copy(), from_b[:-1].copy(), np.ones(len(from_a) - 1, np.int64)
    open_ = np.flatnonzero(i < from_a[1:])
    while len(open_):
        at, to = i[open_], j[open_]
        size = np.minimum(probe[open_], np.minimum(from_a[open_ + 1] - at, from_b[open_ + 1] - to))
        left, right = ragged(at, size), ragged(to, size)
        place = np.arange(len(left)) - np.repeat(np.cumsum(size) - size, size)
        run = np.minimum.reduceat(np.where(ends_a[left] == ends_b[right], np.iinfo(np.int64).max, place), np.cumsum(size) - size)
        run = np.minimum(run, size)
        inside = place < np.repeat(run, size)
        cut_a[left[inside]] = cut_b[right[inside]] = True
        i[open_] += run
        j[open_] += run
        probe[open_] = np.where(run == size, 2 * probe[open_], 1)
        odd = open_[run < size]
        a, b = i[odd], j[odd]
        while len(odd):
            behind = ends_a[a] < ends_b[b]
            even = ends_a[a] == ends_b[b]
            cut_a[a[even]] = cut_b[b[even]] = True
            i[odd[even]], j[odd[even]] = a[even] + 1, b[even] + 1
            odd, a, b = odd[~even], a[~even] + behind[~even], b[~even] + ~behind[~even]
        open_ = open_[i[open_] < from_a[open_ + 1]]
    return cut_a, cut_b


def links(group_a: np.ndarray, ids_a: np.ndarray, group_b: np.ndarray, ids_b: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, pair (``a * span + b``) and number of the links of groups: equal pairs of a group come once, with how often they stand there."""
    one, many_a = np.unique(group_a * (1 << 32) + ids_a, return_counts=True)
    other, many_b = np.unique(group_b * (1 << 32) + ids_b, return_counts=True)
    group, a = np.divmod(one, 1 << 32)
    of, b = np.divmod(other, 1 << 32)
    low, high = np.searchsorted(of, group), np.searchsorted(of, group, side="right")
    size = high - low
    at = ragged(low, size)
    return np.repeat(group, size), np.repeat(a * span, size) + b[at], np.repeat(many_a, size) * many_b[at]


# -- stretches ---------------------------------------------------------------------


def _byte_table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(x) for x in tokens], np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size


def _separated(n: int, last: str) -> tuple[np.ndarray, np.ndarray]:
    """Each id in decimal, followed by a comma and by what ends its side of a group."""
    out = np.empty(n, object), np.empty(n, object)
    for k in range(n):
        out[0][k], out[1][k] = f"{k},", f"{k}{last}"
    return out


class Stretches:
    """Alignments of stretches of text between cuts, each computed once and kept.

    A text's tokens on either side are those of its stretches, one after the
    other, as no token of either side goes on over a cut. So are its groups.
    """

    def __init__(self, byte_level: str, pieces: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(byte_level), sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(byte_level, encoding="utf-8") as file:
            held = json.load(file)
        names = {i: x for x, i in held["model"]["vocab"].items()} | {x["id"]: x["content"] for x in held.get("added_tokens", [])}
        of_letter = {letter: b for b, letter in byte_letters().items()}
        self.size_a, self.size_b = max(names) + 1, self.b.get_piece_size()
        self.bytes_a = _byte_table([bytes(of_letter.get(c, 0) for c in names.get(i, "")) for i in range(self.size_a)])
        shown = [self.b.id_to_piece(i) for i in range(self.size_b)]
        self.bytes_b = _byte_table([bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(shown)])
        # a piece that goes on over a space would not end before it
        self.cut = not any("▁" in x.lstrip("▁") for x in shown)
        self.text_a, self.text_b = _separated(self.size_a, "|"), _separated(self.size_b, ";")
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.strings: list[str] = []
        #: Of each stretch: tokens on either side, groups, links, first pair, pairs; -1 tokens if its bytes don't come back.
        self.counts = np.zeros((0, 6), np.int64)
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def keep(self, most: int, used: np.ndarray) -> None:
        """Forget all but the ``most`` stretches that were used most often."""
        at = np.sort(np.argsort(-used, kind="stable")[:most])
        names, self.counts = list(self.known), self.counts[at]  # known in the order of their numbers
        held = ragged(self.counts[:, 4], self.counts[:, 5])
        self.pairs, self.times = self.pairs[held], self.times[held]
        self.counts[:, 4] = np.cumsum(self.counts[:, 5]) - self.counts[:, 5]
        self.known = {names[i]: k for k, i in enumerate(at.tolist())}
        self.strings = [self.strings[i] for i in at.tolist()]

    def split(self, text: str) -> list[str]:
        if not self.cut:
            return [text]
        return CUT.split(text) if _UNCLEAN.search(text) else text.split(" ")

    def learn(self, stretches: list[str]) -> None:
        if len(stretches) > TOGETHER:  # the library's answers take many times what is kept of them
            for i in range(0, len(stretches), TOGETHER):
                self.learn(stretches[i : i + TOGETHER])
            return
        a = [x.ids for x in self.a.encode_batch_fast([f" {x}" for x in stretches], add_special_tokens=False)]
        b = self.b.encode(stretches, num_threads=1)
        n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in (a, b))
        a, b = (np.fromiter((i for x in side for i in x), np.int64) for side in (a, b))
        wanted = [f" {x}".encode() for x in stretches]
        size = np.array([len(x) for x in wanted], np.int64)
        wanted = np.frombuffer(b"".join(wanted), np.uint8)
        good = self._spell(self.bytes_a, a, n_a, wanted, size) & self._spell(self.bytes_b, b, n_b, wanted, size)
        a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
        n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
        from_a, from_b = np.r_[0, np.cumsum(n_a)], np.r_[0, np.cumsum(n_b)]
        cut_a, cut_b = align(np.cumsum(self.bytes_a[2][a]), from_a, np.cumsum(self.bytes_b[2][b]), from_b)
        group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        groups = np.diff(np.r_[0, np.cumsum(cut_a)][from_a])
        owner = np.repeat(np.arange(len(stretches)), groups)
        group, pair, times = links(group_a, a, group_b, b, self.size_b)
        code, inverse = np.unique(owner[group] * (self.size_a * self.size_b) + pair, return_inverse=True)
        times = np.bincount(inverse, times, minlength=len(code)).astype(np.int64)
        owner, pair = np.divmod(code, self.size_a * self.size_b)
        each = np.bincount(owner, minlength=len(stretches))
        counts = [np.where(good, n_a, -1), n_b, groups, np.bincount(owner, times, minlength=len(stretches)).astype(np.int64), len(self.pairs) + np.cumsum(each) - each, each]
        self._write(a, cut_a, group_a, from_a, b, cut_b, group_b, from_b)
        self.known.update(zip(stretches, range(len(self.counts), len(self.counts) + len(stretches)), strict=True))
        self.counts = np.concatenate([self.counts, np.stack(counts, axis=1)])
        self.pairs, self.times = np.concatenate([self.pairs, pair]), np.concatenate([self.times, times])

    @staticmethod
    def _spell(table: tuple, ids: np.ndarray, count: np.ndarray, wanted: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether each stretch's tokens spell its bytes."""
        data, begin, length = table
        owner = np.repeat(np.arange(len(count)), count)
        good = np.bincount(owner, length[ids], minlength=len(count)).astype(np.int64) == size
        kept = good[owner]
        spelled = data[ragged(begin[ids[kept]], length[ids[kept]])]
        of = np.repeat(np.arange(len(size)), size)
        sure = good[of]
        good[of[sure][spelled != wanted[sure]]] = False
        return good

    def _write(self, a, cut_a, group_a, from_a, b, cut_b, group_b, from_b) -> None:
        """The groups of each stretch as text, without what follows the last one."""
        before_b, before_a = np.r_[0, np.flatnonzero(cut_b) + 1], np.r_[np.flatnonzero(cut_a) + 1, 0]
        text = np.empty(len(a) + len(b), object)
        text[np.arange(len(a)) + before_b[group_a]] = np.where(cut_a, self.text_a[1][a], self.text_a[0][a])
        text[np.arange(len(b)) + before_a[group_b]] = np.where(cut_b, self.text_b[1][b], self.text_b[0][b])
        text = text.tolist()
        bounds = (from_a + from_b).tolist()
        self.strings += ["".join(text[i:j])[:-1] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]


@functools.lru_cache(maxsize=1)
def _stretches(byte_level: str, pieces: str) -> Stretches:
    return Stretches(byte_level, pieces)


# -- blocks --------------------------------------------------------------------------


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


class Block:
    """Documents with the stretches that they consist of, until there are enough of them for a row."""

    def __init__(self, known: Stretches, digest: bool) -> None:
        self.known, self.digest, self.bytes = known, digest, 0
        self.parts: list[pa.RecordBatch] = []
        self.order: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def add(self, ids: pa.Array, texts: list[str | None], size: int) -> None:
        known = self.known
        cut = [known.split(x) if x else [] for x in texts]
        flat = [x for part in cut for x in part]
        if new := list(set(flat).difference(known.known)):
            known.learn(new)
        at = np.fromiter(map(known.known.__getitem__, flat), np.int64, len(flat))
        count = np.array([len(x) for x in cut], np.int64)
        doc = np.repeat(np.arange(len(texts)), count)
        bad = np.zeros(len(texts), bool)
        bad[doc[known.counts[at, 0] < 0]] = True
        at, count = at[~bad[doc]], np.where(bad, 0, count)
        doc = np.repeat(np.arange(len(texts)), count)
        numbers = [np.bincount(doc, known.counts[at, k], minlength=len(texts)).astype(np.int64) for k in range(4)]
        held, text, begin = at.tolist(), [], 0
        for n in count.tolist():
            groups = ";".join(map(known.strings.__getitem__, held[begin : begin + n]))
            text.append(hashlib.sha256(groups.encode()).hexdigest() if self.digest and n else groups)
            begin += n
        self.parts.append(pa.RecordBatch.from_arrays([ids, *map(pa.array, numbers), pa.array(text, pa.large_string())], names=["id", *_NUMBERS, "groups"]))
        self.order.append(at.astype(np.int32))
        self.sizes.append(count)
        self.bytes += size

    def row(self, number: int) -> pa.RecordBatch:
        """The block's documents, and every pair linked in one of them with the number of documents that hold it."""
        known, count = self.known, np.concatenate(self.sizes)
        order, used = np.concatenate(self.order), np.zeros(len(known.counts), bool)
        used[order] = True
        own, local = np.flatnonzero(used), (np.cumsum(used, dtype=np.int32) - 1)[order]
        begin, each = known.counts[own, 4], known.counts[own, 5]
        at = ragged(begin, each)
        pairs, pair = np.unique(known.pairs[at], return_inverse=True)
        pair, times = pair.astype(np.int32), known.times[at]
        del order, used, at
        first, bounds, holders = np.cumsum(each) - each, np.r_[0, np.cumsum(count)], np.zeros(len(pairs), np.int64)
        for i, j in spans.slices(bounds, COUNTED):
            doc = np.repeat(np.arange(j - i), count[i:j])
            doc, stretch = np.divmod(np.unique(doc * max(len(own), 1) + local[bounds[i] : bounds[j]]), max(len(own), 1))
            held = np.unique(np.repeat(doc, each[stretch]) * max(len(pairs), 1) + pair[ragged(first[stretch], each[stretch])]) % max(len(pairs), 1)
            holders += np.bincount(held, minlength=len(pairs))
        arrays = dict(count=count, order=local, each=each.astype(np.int32), pair=pair, times=times)
        batch = pa.Table.from_batches(self.parts).combine_chunks().to_batches()[0] if count.size else self.parts[0]
        payload = pa.record_batch({"docs": pa.array([_stream(batch)], pa.large_binary())} | {name: pa.array([x.tobytes()], pa.large_binary()) for name, x in arrays.items()})
        told = [pa.array([number]), pa.array([len(pairs)]), pa.array([pairs.tobytes()], pa.binary()), pa.array([holders.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays([*told, pa.array([_stream(payload)], pa.binary())], names=_BLOCK_NAMES)


_BLOCK = "block long, n long, pairs binary, counts binary, payload binary"
_BLOCK_NAMES = [x.split()[0] for x in _BLOCK.split(", ")]


def _stream(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _bucket(pairs: np.ndarray, buckets: int) -> np.ndarray:
    return (spans.mix(pairs.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _sums(pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, inverse = np.unique(pairs, return_inverse=True)
    return values, np.bincount(inverse, counts, minlength=len(values)).astype(np.int64)


def blocks_of(batches: Iterator[pa.RecordBatch], known: Stretches, number: int, digest: bool) -> Iterator[pa.RecordBatch]:
    """Rows of blocks, numbered from ``number``; of what it learned from a block, ``known`` keeps ``KEPT_STRETCHES``, also from the last one."""
    block = Block(known, digest)

    def row() -> pa.RecordBatch:
        out = block.row(number)
        if len(known.known) > KEPT_STRETCHES:
            known.keep(KEPT_STRETCHES, np.bincount(np.concatenate(block.order), minlength=len(known.counts)))
        return out

    for batch in batches:
        _, offsets = spans.bytes_of(batch.column(1))
        for i, j in spans.slices(offsets, SLICE_BYTES):
            block.add(batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i).to_pylist(), int(offsets[j] - offsets[i]))
            if block.bytes >= BLOCK_BYTES:
                yield row()
                pa.default_memory_pool().release_unused()
                block, number = Block(known, digest), number + 1
    if block.parts:
        yield row()


def aligned_blocks(docs: DataFrame, byte_level: str, pieces: str, id_col: str, text_col: str, digest: bool) -> DataFrame:
    """Blocks of aligned documents, a written table."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return blocks_of(batches, _stretches(byte_level, pieces), TaskContext.get().partitionId() << _COUNTER_BITS, digest)

    return written(docs.select(id_col, text_col).mapInArrow(emit, _BLOCK), "aligned")


def pair_counts(blocks: DataFrame, buckets: int) -> DataFrame:
    """``bucket``, ``pairs``, ``counts``: of every pair linked in any document the number of documents that hold it; a written table."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for batch in batches:
            for pairs, counts in zip(*batch.columns, strict=True):
                held = _sums(np.r_[held[0], np.frombuffer(pairs.as_buffer(), np.int64)], np.r_[held[1], np.frombuffer(counts.as_buffer(), np.int64)])
                if len(held[0]) > HELD_PAIRS:
                    yield rows(*held)
                    held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        yield rows(*held)

    def rows(pairs: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        out = packed(_bucket(pairs, buckets), pairs=pairs, counts=counts)
        return pa.RecordBatch.from_arrays([out["group"], out["pairs"], out["counts"]], names=["bucket", "pairs", "counts"])

    def meet(table: pa.Table) -> pa.Table:
        pairs, counts = _sums(unpacked(table["pairs"], np.int64), unpacked(table["counts"], np.int64))
        return pa.table({"bucket": table["bucket"][:1], "pairs": pa.array([pairs.tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary())})

    kinds = "bucket long, pairs binary, counts binary"
    return written(blocks.select("pairs", "counts").mapInArrow(tell, kinds).groupBy("bucket").applyInArrow(meet, kinds), "pair-counts")


def _highest(counts: DataFrame, size_b: int) -> DataFrame:
    """``a``, ``n``: the highest count of each id of the first vocabulary."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pairs, n in zip(*batch.columns, strict=True):
                a = np.frombuffer(pairs.as_buffer(), np.int64) // size_b  # in order
                begin = np.flatnonzero(np.r_[True, a[1:] != a[:-1]][: len(a)])
                if len(begin):
                    yield pa.RecordBatch.from_arrays([pa.array(a[begin]), pa.array(np.maximum.reduceat(np.frombuffer(n.as_buffer(), np.int64), begin))], names=["a", "n"])

    return counts.select("pairs", "counts").mapInArrow(tell, "a long, n long").groupBy("a").agg(F.max("n").alias("n"))


def align_tokens(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Per row of ``docs`` how its tokens by two vocabularies fit together.

    ``byte_level`` is a file of the tokenizers library (A), which reads a space
    and the text, ``pieces`` one of sentencepiece (B), which adds the space
    itself; both paths must be there on every executor. Byte offsets at which
    tokens of both end cut the tokens into groups (see ``align``); a link is a
    pair of an A and a B token of one group, and a pair of ids counts in as
    many documents as hold it linked.

    Columns: the id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``
    (links whose count is the highest that their A id has anywhere),
    ``count_sum`` (of counts over links) and ``groups``, such as
    ``1,2|3;4|5,6``, or with ``digest`` its SHA-256. A text that is null or
    empty or that either side's tokens don't spell has none of it: zeros and
    an empty string. Special strings inside texts are ordinary text. Every row
    is a document of its own, repeated or not; ids may be null or of any type;
    other columns are left out; an empty table gives an empty one.

    Texts are read whole, a long one in one task, at about 100 bytes for each
    of its bytes. Pairs are added up in tasks before they meet in buckets, and
    blocks ask these for the counts of their own; what the driver gets is one
    number for each id of A.
    """
    spark = docs.sparkSession
    known = _stretches(byte_level, pieces)
    size_b, size_a = known.size_b, known.size_a
    blocks = aligned_blocks(docs, byte_level, pieces, id_col, text_col, digest)
    total = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(total // BUCKET_PAIRS, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts = pair_counts(blocks, buckets)
    highest = np.zeros(size_a, np.int64)
    found = _highest(counts, size_b).toArrow()  # a row for each id of a vocabulary at most
    highest[found["a"].to_numpy()] = found["n"].to_numpy()
    best = spark.sparkContext.broadcast(highest)
    reply = "block long, bucket long, counts binary"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, pairs in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                pairs = np.frombuffer(pairs.as_buffer(), np.int64)
                out = packed(_bucket(pairs, buckets), pairs=pairs)
                yield pa.RecordBatch.from_arrays([out["group"], pa.array(np.full(len(out["group"]), block)), out["pairs"]], names=["bucket", "block", "pairs"])

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        pairs, n = unpacked(right["pairs"], np.int64), unpacked(right["counts"], np.int64)
        out = [n[np.searchsorted(pairs, np.frombuffer(x.as_buffer(), np.int64))].tobytes() for x in left["pairs"]]
        return pa.table({"block": left["block"], "bucket": left["bucket"], "counts": pa.array(out, pa.binary())})

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        right = right.sort_by("bucket")
        for pairs, payload in zip(left["pairs"], left["payload"], strict=True):
            pairs = np.frombuffer(pairs.as_buffer(), np.int64)
            n = np.empty(len(pairs), np.int64)
            n[np.argsort(_bucket(pairs, buckets), kind="stable")] = unpacked(right["counts"], np.int64)
            row = pa.ipc.open_stream(payload.as_buffer()).read_all()
            rows = pa.ipc.open_stream(row["docs"][0].as_buffer()).read_all()
            count, order, each, pair, times = (np.frombuffer(row[x][0].as_buffer(), kind) for x, kind in (("count", np.int64), ("order", np.int32), ("each", np.int32), ("pair", np.int32), ("times", np.int64)))
            of = np.repeat(np.arange(len(each)), each)
            top = n == best.value[pairs // size_b]
            sums = []
            for value in (times * top[pair], times * n[pair]):
                stretch = np.zeros(len(each) + 1, np.int64)
                np.add.at(stretch, of, value)
                sums.append(np.diff(np.r_[0, np.cumsum(stretch[order])][np.r_[0, np.cumsum(count)]]))
            parts.append(pa.table([*(rows[x] for x in ("id", *_NUMBERS)), *map(pa.array, sums), rows["groups"].cast(pa.string())], names=names))
        return pa.concat_tables(parts)

    last = "groups_sha256" if digest else "groups"
    schema = T.StructType([docs.schema[id_col], *(T.StructField(x, T.LongType()) for x in (*_NUMBERS, "n_best", "count_sum")), T.StructField(last, T.StringType())])
    names = schema.names
    replies = blocks.select("block", "pairs").mapInArrow(ask, "bucket long, block long, pairs binary").groupBy("bucket").cogroup(counts.groupBy("bucket")).applyInArrow(answer, reply)
    return blocks.select("block", "pairs", "payload").groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(finish, schema)


def op13_token_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return align_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)
