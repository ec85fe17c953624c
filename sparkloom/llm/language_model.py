"""Language-model scoring: smoothed n-grams as a weighted automaton with failure arcs, built where the texts are."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import spans
from .encoding import ragged
from .shared import bucketed, written

#: Tokens of the longest n-gram.
ORDER = 3
#: Text bytes of one block of documents, about; a longer text is a block of its own.
BLOCK_BYTES = 5 << 20
#: Tokens of the corpus for each bucket of n-grams, about.
BUCKET_TOKENS = 2_000_000
#: Occurrences of a context for each part that its followers are dealt to: what one bucket holds of a very common context.
PART = 64_000_000
#: Tokens that one lane of a traversal scores.
LANE = 256
#: The context before a text's first token; words are numbered from 1 on.
START = 0
#: What a discount is at least: some weight is always left for what wasn't seen.
LEAST = 0.05
_COUNTER_BITS = 33


# -- packed integers ---------------------------------------------------------------


def shrunk(values: np.ndarray) -> bytes:
    """Non-negative integers as compressed planes of bytes."""
    kind = np.dtype(f"<u{next(k for k in (1, 2, 4, 8) if not len(values) or int(values.max()) < 1 << 8 * k)}")
    planes = np.ascontiguousarray(values.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T)
    return bytes([kind.itemsize]) + len(values).to_bytes(8, "little") + (pa.compress(planes.tobytes(), "zstd", asbytes=True) if len(values) else b"")


class Reader:
    """Reads what ``shrunk`` wrote, array after array; each is preceded by its length."""

    def __init__(self, blob: bytes | memoryview) -> None:
        self.blob, self.at = memoryview(blob), 0

    @staticmethod
    def joined(*parts: np.ndarray) -> bytes:
        blobs = [shrunk(x) for x in parts]
        return b"".join(len(x).to_bytes(8, "little") + x for x in blobs)

    def next(self) -> np.ndarray:
        size = int.from_bytes(self.blob[self.at : self.at + 8], "little")
        held = self.blob[self.at + 8 : self.at + 8 + size]
        self.at += 8 + size
        width, n = held[0], int.from_bytes(held[1:9], "little")
        if not n:
            return np.zeros(0, np.int64)
        planes = np.frombuffer(pa.decompress(pa.py_buffer(held[9:]), n * width, "zstd"), np.uint8)
        return np.ascontiguousarray(planes.reshape(width, n).T).view(f"<u{width}").ravel().astype(np.int64)


def distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of two arrays of non-negative integers, in order, and which of them each pair is."""
    if not len(a):
        return a, b, a
    if (int(a.max()) + 1) * (int(b.max()) + 1) < 1 << 63:
        code, inverse = np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)
        return *np.divmod(code, int(b.max()) + 1), inverse
    order = np.lexsort((b, a))
    new = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]
    inverse = np.empty(len(a), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return a[order][new], b[order][new], inverse


def discounts(counts: np.ndarray) -> np.ndarray:
    """What n-grams seen once, twice and more often are discounted, from how many were seen once to four times."""
    n = [int(x) for x in counts[:4]]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    out = [min(max(k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k * y, LEAST), k) for k in (1, 2, 3)]
    return np.array([0.0, *out])


# -- the automaton -------------------------------------------------------------------


@dataclass
class Automaton:
    """States with arcs by word, and one failure arc each; weights are log10.

    State 0, the root, remembers nothing and has an arc for every word:
    ``word_weight`` and ``word_state``. Other states remember their last
    ``depth`` words. ``arcs`` has, for every depth from 1 on and every position
    of the texts, which arc leads on from the state that remembers the words
    before it, and -1 where that state has none for the word there: then its
    failure arc leads to the state of the next shorter context, at the cost of
    its weight.
    """

    word_weight: np.ndarray
    word_state: np.ndarray
    depth: np.ndarray
    arcs: np.ndarray
    arc_weight: np.ndarray
    arc_state: np.ndarray
    failure: np.ndarray
    failure_weight: np.ndarray

    def step(self, state: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each of many states goes with the word at a position, and what it costs."""
        out, cost = np.empty(len(state), np.int64), np.zeros(len(state))
        open_ = np.arange(len(state))
        while len(open_):
            depth = self.depth[state]
            arc = np.where(depth > 0, self.arcs[depth - 1, at], -1) if len(self.arcs) else np.full(len(state), -1)
            found, root = arc >= 0, depth == 0
            done = open_[found]
            out[done] = self.arc_state[arc[found]]
            cost[done] += self.arc_weight[arc[found]]
            done = open_[root]
            out[done] = self.word_state[word[root]]
            cost[done] += self.word_weight[word[root]]
            fails = ~(root | found)
            open_, state, word, at = open_[fails], state[fails], word[fails], at[fails]
            cost[open_] += self.failure_weight[state]
            state = self.failure[state]
        return out, cost

    def traverse(self, words: np.ndarray, bounds: np.ndarray, start: int, memory: int) -> np.ndarray:
        """The log10 probability of each text, its words from ``bounds`` to the next one, read once from left to right.

        Texts are read in lanes of ``LANE`` words, all lanes at once. A state
        remembers ``memory`` words at most, so a lane inside a text comes to the
        state in which the one before it ends by reading these without counting.
        """
        lanes = -(-np.diff(bounds) // LANE)
        text = np.repeat(np.arange(len(lanes)), lanes)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        low = bounds[text] + nth * LANE
        high = np.minimum(low + LANE, bounds[text + 1])
        at = np.maximum(low - memory, bounds[text])
        order = np.argsort(at - high, kind="stable")  # the longest first
        text, low, high, at = text[order], low[order], high[order], at[order]
        state, total = np.where(at == bounds[text], start, 0), np.zeros(len(text))
        while n := int(np.count_nonzero(at < high)):
            state[:n], cost = self.step(state[:n], words[at[:n]], at[:n])
            total[:n] += np.where(at[:n] >= low[:n], cost, 0.0)
            at[:n] += 1
        return np.bincount(text, total, minlength=len(lanes))


# -- blocks --------------------------------------------------------------------------


@dataclass
class Block:
    """A block's tokens, as numbers of its distinct words; the empty word is the end of a text."""

    ids: pa.Array
    held_out: np.ndarray
    bounds: np.ndarray
    token: np.ndarray
    words: np.ndarray
    sizes: np.ndarray

    @staticmethod
    def of(rows: pa.RecordBatch) -> Block:
        data, offsets = spans.bytes_of(rows.column(2))
        data = data + ((data >= 0x41) & (data <= 0x5A)).astype(np.uint8) * np.uint8(0x20)
        begin, end, text = spans.split(data, offsets)
        one, two = spans.hash_spans(data, begin, end), spans.hash_spans(data, begin, end, 1)
        _, first, inverse = np.unique(one, return_index=True, return_inverse=True)
        if (two[first][inverse] != two).any():  # one lane alone would take two words for the same
            _, first, inverse = np.unique(np.stack([one, two], axis=1), axis=0, return_index=True, return_inverse=True)
            inverse = inverse.ravel()
        count = np.bincount(text, minlength=len(rows))
        bounds = np.r_[0, np.cumsum(count + 1)]
        token = np.full(int(bounds[-1]), len(first), np.int64)
        inside = np.ones(len(token), bool)
        inside[bounds[1:] - 1] = False
        token[inside] = inverse
        size = np.r_[end[first] - begin[first], 0]
        return Block(rows.column(0), rows.column(1).to_numpy(zero_copy_only=False), bounds, token, data[ragged(begin[first], size[:-1])], size)

    def payload(self) -> bytes:
        ids = pa.record_batch([self.ids], names=["id"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, ids.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_batch(ids)
        numbers = Reader.joined(self.held_out.astype(np.int64), np.diff(self.bounds), self.token)
        return len(numbers).to_bytes(8, "little") + numbers + sink.getvalue().to_pybytes()

    def dictionary(self) -> bytes:
        """The words, how long they are and how often each stands in texts that are learned from."""
        return Reader.joined(self.words, self.sizes, np.bincount(self.token[self.learned], minlength=len(self.sizes)))

    @property
    def learned(self) -> np.ndarray:
        return np.repeat(~self.held_out, np.diff(self.bounds))

    @staticmethod
    def read(payload: pa.Scalar) -> Block:
        raw = memoryview(payload.as_buffer())
        at = 8 + int.from_bytes(raw[:8], "little")
        numbers = Reader(raw[8:at])
        held_out, count, token = numbers.next().astype(bool), numbers.next(), numbers.next()
        ids = pa.ipc.open_stream(pa.py_buffer(raw[at:])).read_all()["id"].combine_chunks()
        none = np.zeros(0, np.int64)
        return Block(ids, held_out, np.r_[0, np.cumsum(count)], token, none, none)


def _words(dictionary: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both hashes of a block's words, their lengths, and their counts."""
    read = Reader(dictionary.as_buffer())
    data, size, count = read.next().astype(np.uint8), read.next(), read.next()
    end = np.cumsum(size)
    return spans.hash_spans(data, end - size, end), spans.hash_spans(data, end - size, end, 1), size, count


# -- requests and replies ----------------------------------------------------------------


_ASKED = "bucket long, block long, n long, asked binary"
_TOLD = "block long, nth int, bucket long, told binary, counts array<long>"


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Every bucket in use, in order, with what it holds."""
    order = np.argsort(bucket, kind="stable")
    cut = np.r_[0, np.flatnonzero(np.diff(bucket[order])) + 1, len(order)] if len(order) else np.zeros(1, np.int64)
    for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        yield int(bucket[order[i]]), order[i:j]


def _rows_asked(block: int, asked: list[tuple[int, bytes]], n: int) -> pa.RecordBatch:
    """Requests of a block; ``n`` counts, once, what it needn't ask."""
    asked = asked or [(0, b"")]
    told = np.zeros(len(asked), np.int64)
    told[0] = n
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in asked]), pa.array(np.full(len(asked), block)), pa.array(told), pa.array([x for _, x in asked], pa.binary())], names=["bucket", "block", "n", "asked"])


def _rows_told(table: pa.Table, told: list[bytes], nth: int, counts: list[int]) -> pa.Table:
    """Replies to blocks, and a row without a block that has the bucket's counts."""
    n = len(told)
    return pa.table([
        pa.array([*table["block"].to_pylist(), -1], pa.int64()), pa.array(np.full(n + 1, nth, np.int32)), pa.array([*table["bucket"].to_pylist(), table["bucket"][0].as_py()], pa.int64()),
        pa.array([*told, b""], pa.binary()), pa.array([[]] * n + [counts], pa.list_(pa.int64())),
    ], names=["block", "nth", "bucket", "told", "counts"])


def _word_bucket(one: np.ndarray, buckets: int) -> np.ndarray:
    return (one % np.uint64(buckets)).astype(np.int64)


def _ask_words(dictionary: pa.Scalar, block: int, buckets: int) -> pa.RecordBatch:
    """Words of a block as bytes, so that equal hashes can't confuse two."""
    read = Reader(dictionary.as_buffer())
    data, size, count = read.next(), read.next(), read.next()
    one, _, _, _ = _words(dictionary)
    begin, asked = np.cumsum(size) - size, []
    for bucket, at in _by_bucket(_word_bucket(one, buckets)):
        asked.append((bucket, Reader.joined(data[ragged(begin[at], size[at])], size[at], count[at])))
    return _rows_asked(block, asked, 0)


def _number(need: np.ndarray, count: np.ndarray, bucket: int, buckets: int) -> np.ndarray:
    """Numbers from 1 on that no other bucket gives, small ones for what is frequent; 0 for the rest."""
    out, some = np.zeros(len(need), np.int64), np.flatnonzero(need)
    out[some[np.argsort(-count[some], kind="stable")]] = np.arange(len(some)) * buckets + bucket + 1
    return out


def _meet_words(table: pa.Table, buckets: int) -> pa.Table:
    """Of each word asked its count in all learned texts and its number, 0 if it isn't in them."""
    rows = [Reader(x.as_buffer()) if len(x.as_buffer()) else None for x in table["asked"]]
    parts = [[r.next(), r.next(), r.next()] if r else [np.zeros(0, np.int64)] * 3 for r in rows]
    data, size, count = (np.concatenate([p[k] for p in parts]) for k in range(3))
    data, end = data.astype(np.uint8), np.cumsum(size)
    one, two = spans.hash_spans(data, end - size, end), spans.hash_spans(data, end - size, end, 1)
    order = np.lexsort((two, one))
    new = np.r_[True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])][: len(order)]
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.cumsum(new) - 1
    total = np.bincount(inverse, count, minlength=int(new.sum())).astype(np.int64)
    number = _number(total > 0, total, table["bucket"][0].as_py(), buckets)
    cuts = np.cumsum([0, *(len(p[1]) for p in parts)])
    told = [Reader.joined(total[inverse[i:j]], number[inverse[i:j]]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    return _rows_told(table, told, 1, [int((total > 0).sum())])


@dataclass
class Pairs:
    """What a block asks of one order: distinct (context, part, follower) in order, follower 0 asking for the context alone.

    ``which`` has for each position of the block its entry, -1 where it has none.
    """

    context: np.ndarray
    part: np.ndarray
    follower: np.ndarray
    learned: np.ndarray
    held: np.ndarray
    bucket: np.ndarray
    which: np.ndarray

    @staticmethod
    def of(context: np.ndarray, occurs: np.ndarray, word: np.ndarray, learned: np.ndarray, buckets: int) -> Pairs:
        """From each position's context (negative: none), how often that occurs in all, and its word (0: unknown)."""
        some = np.flatnonzero(context >= 0)
        at, follower, which = distinct(context[some], word[some])
        count = np.bincount(which, learned[some], minlength=len(at)).astype(np.int64)
        held = np.bincount(which, ~learned[some], minlength=len(at)) > 0
        parts = np.zeros(len(at), np.int64)
        parts[which] = np.maximum(-(-occurs[some] // PART), 1)
        part = np.where(follower > 0, (spans.mix(follower.astype(np.uint64)) % parts.astype(np.uint64)).astype(np.int64), 0)
        split = np.flatnonzero(np.r_[True, at[1:] != at[:-1]][: len(at)] & (parts > 1))
        # every part of a very common context is asked for what it has of it
        more = np.repeat(at[split], parts[split]), ragged(np.zeros(len(split), np.int64), parts[split])
        context, part, follower = np.r_[at, more[0]], np.r_[part, more[1]], np.r_[follower, np.zeros(len(more[0]), np.int64)]
        count, held = np.r_[count, np.zeros(len(more[0]), np.int64)], np.r_[held, np.zeros(len(more[0]), bool)]
        bucket = (spans.mix(spans.fold(context.astype(np.uint64), part.astype(np.uint64), 0)) % np.uint64(buckets)).astype(np.int64)
        place = np.full(len(word), -1)
        place[some] = which
        return Pairs(context, part, follower, count, held, bucket, place)

    def requests(self) -> Iterator[tuple[int, np.ndarray]]:
        """For every bucket the entries that it is asked, by context and part."""
        # entries come by context and follower, but for the parts of very common contexts
        order = np.lexsort((self.follower, self.part, self.context)) if self.part.any() else None
        for bucket, at in _by_bucket(self.bucket if order is None else self.bucket[order]):
            yield bucket, at if order is None else order[at]

    def ask(self) -> list[tuple[int, bytes]]:
        out = []
        for bucket, at in self.requests():
            new = self._heads(at)
            head = np.flatnonzero(new)
            out.append((bucket, Reader.joined(np.diff(np.r_[0, self.context[at[head]]]), self.part[at[head]], np.diff(np.r_[head, len(at)]), self.follower[at], 2 * self.learned[at] + self.held[at])))
        return out

    def _heads(self, at: np.ndarray) -> np.ndarray:
        return np.r_[True, (self.context[at][1:] != self.context[at][:-1]) | (self.part[at][1:] != self.part[at][:-1])]

    def told(self, replies: pa.Table, numbered: bool, cut: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each entry's count and number, and, where discounts are given, the sum of all discounts of its context."""
        count, number, rest = np.zeros(len(self.context), np.int64), np.zeros(len(self.context), np.int64), np.zeros(len(self.context))
        held = dict(zip(replies["bucket"].to_pylist(), replies["told"], strict=True))
        for bucket, at in self.requests():
            read = Reader(held[bucket].as_buffer())
            count[at] = read.next()
            if numbered:
                number[at] = read.next()
            if cut is not None:
                rest[at] = sum(cut[k] * read.next() for k in (1, 2, 3))[np.cumsum(self._heads(at)) - 1]
        if cut is not None and self.part.any():
            # parts of a context add up; every part stands once for it
            order = np.lexsort((self.part, self.context))
            new = np.r_[True, self.context[order][1:] != self.context[order][:-1]]
            one = new | np.r_[False, self.part[order][1:] != self.part[order][:-1]]
            rest[order] = np.add.reduceat(np.where(one, rest[order], 0.0), np.flatnonzero(new))[np.cumsum(new) - 1]
        return count, number, rest


def _read(blob: pa.Scalar) -> list[np.ndarray]:
    """Contexts, their parts, how many followers each has, these, and their counts, as ``Pairs.ask`` wrote them."""
    if not len(blob.as_buffer()):
        return [np.zeros(0, np.int64)] * 5
    read = Reader(blob.as_buffer())
    steps, *rest = (read.next() for _ in range(5))
    return [np.cumsum(steps), *rest]


def _meet_pairs(table: pa.Table, buckets: int, nth: int, numbered: bool) -> pa.Table:
    """Of each entry asked its count in all learned texts, its number as a context, and how often its context's followers were seen.

    A context that was seen once, and nowhere in a text held out, needs no
    number: the block that holds it knows all about it.
    """
    held = [_read(blob) for blob in table["asked"]]
    heads, parts, sizes, followers, counts = (np.concatenate([x[k] for x in held]) for k in range(5))
    cuts, groups = np.cumsum([0, *(len(x[3]) for x in held)]), np.cumsum([0, *(len(x[0]) for x in held)])
    context, _, head = distinct(heads, parts)
    of, follower, pair = distinct(np.repeat(head, sizes), followers)
    total = np.bincount(pair, counts >> 1, minlength=len(follower)).astype(np.int64)
    held = np.bincount(pair, counts & 1, minlength=len(follower)) > 0
    arc = total > 0
    kinds = [np.bincount(of[arc & (total == 1)], minlength=len(context)), np.bincount(of[arc & (total == 2)], minlength=len(context)), np.bincount(of[total > 2], minlength=len(context))]
    number = _number((total > 1) | (arc & held), total, table["bucket"][0].as_py(), buckets) if numbered else total
    told = []
    for i, j, k, n in zip(cuts[:-1], cuts[1:], groups[:-1], groups[1:], strict=True):
        own, ask = pair[i:j], head[k:n]
        told.append(Reader.joined(total[own], *([number[own]] if numbered else []), *(x[ask] for x in kinds)) if j > i else b"")
    seen = np.bincount(np.minimum(total[arc], 5), minlength=6)[1:5].tolist()
    seen[0] += int(np.sum(table["n"].to_numpy()))  # those that blocks needn't ask
    return _rows_told(table, told, nth, seen)


# -- a block's model ---------------------------------------------------------------------


class Model:
    """What a block knows of its own n-grams, order by order, from the replies; with discounts also what its contexts leave to others."""

    def __init__(self, block: Block, dictionary: pa.Scalar, replies: pa.Table, buckets: int, order: int, cuts: list[np.ndarray] | None = None) -> None:
        self.block, self.buckets, self.order = block, buckets, order
        self.replies = {k: replies.filter(pc.equal(replies["nth"], k)) for k in range(1, order + 1)}
        one, _, size, _ = _words(dictionary)
        self.word_count, self.word_number = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        held = dict(zip(self.replies[1]["bucket"].to_pylist(), self.replies[1]["told"], strict=True))
        for bucket, at in _by_bucket(_word_bucket(one, buckets)):
            read = Reader(held[bucket].as_buffer())
            self.word_count[at], self.word_number[at] = read.next(), read.next()
        self.end = len(size) - 1
        self.word, self.learned = self.word_number[block.token], block.learned
        self.first = np.zeros(len(block.token), bool)
        self.first[block.bounds[:-1]] = True
        self.levels: list[tuple] = []
        # contexts of one word: its number, or the start; how often that occurs is how often something follows it
        context, occurs = np.r_[START, self.word[:-1]], np.r_[0, self.word_count[block.token[:-1]]]
        context = np.where(context == 0, -1, context)
        context[self.first], occurs[self.first] = START, self.word_count[self.end]
        context = np.where(occurs > 0, context, -1)
        private = np.zeros(len(context), bool)
        for k in range(2, order + 1):
            pairs = Pairs.of(np.where(private, -1, context), occurs, self.word, self.learned, buckets)
            self.levels.append((pairs, context, occurs, private, None, None))
            if not len(self.replies[k]):
                break
            # the entry -1 of positions that ask nothing stands for zeros
            count, number, rest = (np.r_[x, np.zeros(1, x.dtype)] for x in pairs.told(self.replies[k], k < order, cuts and cuts[k - 2]))
            seen, numbers = count[pairs.which], number[pairs.which]
            seen[private & self.learned] = 1
            if cuts:
                rest = rest[pairs.which]
                rest[private] = cuts[k - 2][1]
            self.levels[-1] = (pairs, context, occurs, private, seen, rest)
            if k == order:
                break
            # the next order's contexts: what was read up to here, if it was seen and goes on
            later = np.r_[0, seen[:-1]]
            later[self.first] = 0
            last = np.r_[0, numbers[:-1]]
            private = (later > 0) & (last == 0)
            context, occurs = np.where(later > 0, last, -1), later

    def unasked(self) -> int:
        """N-grams of the last order that only this block has, once."""
        private = self.levels[-1][3]
        return int((private & self.learned).sum())

    def automaton(self, total: int, known: int, cuts: list[np.ndarray]) -> Automaton:
        """The block's part of the model: its contexts as states, its n-grams as arcs, and what is left of each state as failure arcs.

        An n-gram seen c times after a context seen o times has the weight
        (c - d + r p) / o, where d is its discount, r the sum of all the
        context's discounts and p the weight without the context's first word;
        the failure arc has r / o. Single words have (c + 1) / (N + V + 1).
        """
        token, words = self.block.token, len(self.word_count)
        unigram = (self.word_count + 1) / (total + known + 1)
        # states of one word; the end leads nowhere and unknown words to the root
        has = (self.word_count > 0) & (np.arange(words) != self.end)
        word_state = np.where(has, np.arange(words) + 2, 0)
        depth, failure, weight = [np.zeros(1, np.int8), np.ones(words + 1, np.int8)], np.zeros(words + 2, np.int64), np.zeros(words + 2)
        before, after, shorter = np.r_[1, word_state[token[:-1]]], word_state[token], np.zeros(len(token), np.int64)
        before[self.first] = 1
        arcs, arc_weight, arc_state, below = [], [np.zeros(0)], [np.zeros(0, np.int64)], unigram[token]
        for k, ((pairs, _, occurs, private, seen, left), cut) in enumerate(zip(self.levels, cuts, strict=True)):
            there = occurs > 0
            rest = np.where(there, left / np.maximum(occurs, 1), 0.0)
            failure[before[there]], weight[before[there]] = shorter[there], np.log10(rest[there])
            own = private & self.learned
            # an arc for each n-gram that was asked for and each that only this block has
            which = np.where(own, len(pairs.context) + np.cumsum(own) - 1, pairs.which)
            n = len(pairs.context) + int(own.sum())
            arc = np.flatnonzero(there & (seen > 0))
            spot, count = which[arc], seen[arc]
            below = np.where(there, rest * below, below)
            below[arc] += (count - cut[np.minimum(count, 3)]) / occurs[arc]
            here = np.zeros(n)
            here[spot] = np.log10(below[arc])
            arcs.append(np.full(len(token), -1, np.int32))
            arcs[-1][arc] = spot + sum(map(len, arc_weight))
            arc_weight.append(here)
            # what was read becomes a state of its own, unless nothing follows it or it is as long as the model goes
            to = after[arc] if k + 2 == self.order else np.where(token[arc] != self.end, len(failure) + spot, 0)
            arc_state.append(np.zeros(n, np.int64))
            arc_state[-1][spot] = to
            if k + 2 < self.order:
                fell = after
                after = fell.copy()
                after[arc] = to
                more = np.zeros(n, np.int64)
                more[spot] = fell[arc]
                failure, weight = np.r_[failure, more], np.r_[weight, np.zeros(n)]
                depth.append(np.full(n, k + 2, np.int8))
                shorter, before = np.r_[0, fell[:-1]], np.r_[0, after[:-1]]
                before[self.first] = 0
        return Automaton(np.log10(unigram), word_state, np.concatenate(depth), np.array(arcs), np.concatenate(arc_weight), np.concatenate(arc_state), failure, weight)


# -- jobs --------------------------------------------------------------------------------


def held_out(id_col: Column) -> Column:
    """Documents that are never learned from: crc32 of the id as text leaves 2 modulo 7; a null id is learned from."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def _blocks(docs: DataFrame, apart: Column, id_col: str, text_col: str) -> DataFrame:
    """``block``, ``tokens`` learned from, ``all`` tokens, ``words`` and ``payload`` of every block."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << _COUNTER_BITS
        for batch in batches:
            _, offsets = spans.bytes_of(batch.column(2))
            for i, j in spans.slices(offsets, BLOCK_BYTES):
                block = Block.of(batch.slice(i, j - i))
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([int(block.learned.sum())]), pa.array([len(block.token)]), pa.array([block.dictionary()], pa.binary()), pa.array([block.payload()], pa.binary())], names=["block", "tokens", "all", "words", "payload"])
                number += 1

    rows = docs.select(F.col(id_col).alias("id"), apart.alias("apart"), F.col(text_col).alias("text"))
    return rows.mapInArrow(emit, "block long, tokens long, all long, words binary, payload binary")


def score_texts(docs: DataFrame, apart: Column | None = None, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs`` the log10 probability of its whole text by a model of all texts that aren't held ``apart``.

    Tokens are words between white space, A to Z lower-cased, and an end after
    each text. The model knows every n-gram of up to ``order`` tokens that
    stands in the texts it learns from, whatever their number; each is
    interpolated with the next shorter one, by discounts for n-grams seen once,
    twice and more often that follow from how many there are of each (see
    ``discounts``, ``Model.automaton``). Probabilities of all words and one
    unknown word after any context add up to 1.

    No task holds the whole model. Blocks of documents ask buckets for the
    counts of their own n-grams, order by order: words get numbers, small ones
    for frequent words, and n-grams are pairs of the number of a context and
    that of a word. A context above ``PART`` occurrences is dealt to several
    buckets. From the replies a block builds its part of the automaton, which
    gives its own texts the same as the whole one, and traverses it.

    Columns: the id, ``held_out``, ``n_tokens``, ``n_known`` (tokens that are
    learned anywhere), ``train_tokens``, ``base_score`` (single words alone)
    and ``score``. Null and empty texts are the end alone; every row is a
    document of its own, repeated or not; ids may be null or of any type; other
    columns are left out; an empty table gives an empty one. A long text is
    held whole in one task, at about 100 bytes for each of its bytes.
    """
    spark = docs.sparkSession
    apart = held_out(F.col(id_col)) if apart is None else apart
    blocks = bucketed(_blocks(docs, apart, id_col, text_col), "lm-blocks", "block")
    total, every = blocks.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("all"), F.lit(0))).first()
    buckets = max(every // BUCKET_TOKENS, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield _ask_words(words, block, buckets)

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        for block, words, payload in zip(*(left[x] for x in ("block", "words", "payload")), strict=True):
            model = Model(Block.read(payload), words, right, buckets, order)
            parts.append(_rows_asked(block.as_py(), model.levels[-1][0].ask(), model.unasked()))
        return pa.Table.from_batches(parts)

    def meet(k: int):
        def step(table: pa.Table) -> pa.Table:
            return _meet_words(table, buckets) if k == 1 else _meet_pairs(table, buckets, k, k < order)

        return step

    asked = blocks.select("block", "words").mapInArrow(ask_words, _ASKED).groupBy("bucket").applyInArrow(meet(1), _TOLD)
    told = [written(asked, "lm-words")]
    by_block = blocks.select("block", "words", "payload").groupBy("block")
    replies = lambda: _replies(told).groupBy("block")
    for k in range(2, order + 1):
        met = by_block.cogroup(replies()).applyInArrow(ask, _ASKED).groupBy("bucket").applyInArrow(meet(k), _TOLD)
        told.append(written(met, f"lm-{k}-grams"))
    counts = [t.where("block < 0").select(F.posexplode("counts")).groupBy("pos").agg(F.sum("col").alias("n")).orderBy("pos").collect() for t in told]
    known = counts[0][0].n if counts[0] else 0
    cuts = [discounts(np.array([x.n for x in rows] or [0] * 4)) for rows in counts[1:]]
    schema = T.StructType([
        docs.schema[id_col], T.StructField("held_out", T.BooleanType()), *(T.StructField(x, T.LongType()) for x in ("n_tokens", "n_known", "train_tokens")),
        T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
    ])
    names = schema.names

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        for words, payload in zip(left["words"], left["payload"], strict=True):
            block = Block.read(payload)
            model = Model(block, words, right, buckets, order, cuts)
            automaton = model.automaton(total, known, cuts)
            count, text = np.diff(block.bounds), np.repeat(np.arange(len(block.ids)), np.diff(block.bounds))
            base = np.bincount(text, automaton.word_weight[block.token], minlength=len(count))
            n_known = np.bincount(text, model.word_count[block.token] > 0, minlength=len(count)).astype(np.int64)
            score = automaton.traverse(block.token, block.bounds, 1 if total else 0, order - 1)
            parts.append(pa.table([block.ids, pa.array(block.held_out), pa.array(count), pa.array(n_known), pa.array(np.full(len(count), total)), pa.array(base), pa.array(score)], names=names))
        return pa.concat_tables(parts)

    return by_block.cogroup(replies()).applyInArrow(finish, schema)


def _replies(told: list[DataFrame]) -> DataFrame:
    """All replies to blocks."""
    out = told[0]
    for other in told[1:]:
        out = out.unionByName(other)
    return out.where("block >= 0").select("block", "nth", "bucket", "told")


def op12_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
