"""Thousands of terms in texts at once: an automaton over bytes, one pass over each text."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.session import with_package

#: Bytes of terms that one automaton is made of, and so of what is sent to all tasks, about; more terms take further passes.
MOST_BYTES = 1 << 20
#: Bytes of text that a lane reads, and bytes of text that are read together.
LANE, TOGETHER = 1024, 2 << 20


class TermAutomaton:
    """States are beginnings of terms; each byte leads to the longest beginning that the text now ends with."""

    def __init__(self, terms: list[bytes]) -> None:
        self.longest = max(map(len, terms), default=1)
        used = sorted(set(b"".join(terms)))
        self.kind = np.zeros(256, np.int32)  # bytes that no term has are all alike
        self.kind[used] = np.arange(1, len(used) + 1)
        children: list[dict[int, int]] = [{}]
        own: list[list[int]] = [[]]
        for number, term in enumerate(terms):
            at = 0
            for b in term:
                if b not in children[at]:
                    children[at][b] = len(children)
                    children.append({})
                    own.append([])
                at = children[at][b]
            own[at].append(number)
        self.next = np.zeros((len(children), len(used) + 1), np.int32)
        #: Of each state the terms that end there: those of its own and of the state that it falls back to.
        ends: list[list[int]] = [[] for _ in children]
        waiting = deque([(0, 0)])
        while waiting:
            at, back = waiting.popleft()
            if at:
                self.next[at] = self.next[back]
            ends[at] = own[at] + (ends[back] if at else [])
            fall = self.next[at].copy()
            for b, child in children[at].items():
                waiting.append((child, int(fall[self.kind[b]]) if at else 0))
                self.next[at, self.kind[b]] = child
        self.count = np.array([len(x) for x in ends])
        self.first = np.cumsum(self.count) - self.count
        self.ends = np.array([x for e in ends for x in e], np.int64)

    def hits(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, term) of texts that follow each other in ``data``.

        Texts are read in lanes, all at once; a lane begins as many bytes
        before its own as the longest term may have there.
        """
        lanes = -(-np.diff(bounds) // LANE)
        text = np.repeat(np.arange(len(lanes)), lanes)
        low = bounds[text] + (np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
        high = np.minimum(low + LANE, bounds[text + 1])
        at = np.maximum(low - self.longest + 1, bounds[text])
        order = np.argsort(at - high, kind="stable")
        text, high, at = text[order], high[order], at[order]
        kinds, state, found = self.kind[data], np.zeros(len(text), np.int32), []
        while n := int(np.count_nonzero(at < high)):
            state[:n] = self.next[state[:n], kinds[at[:n]]]
            at[:n] += 1
            hit = np.flatnonzero(self.count[state[:n]])
            if len(hit):
                found.append(np.unique(text[hit] * len(self.count) + state[hit]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        text, state = np.divmod(np.unique(np.concatenate(found)), len(self.count))
        size = self.count[state]
        spot = np.repeat(self.first[state] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        pairs = np.unique(np.repeat(text, size) * (int(self.ends.max()) + 1) + self.ends[spot])
        return np.divmod(pairs, int(self.ends.max()) + 1)


def _parts(terms: DataFrame, term: str) -> Iterator[list[str]]:
    """The distinct terms, as many at a time as have about ``MOST_BYTES``."""
    part, size = [], 0
    for (value,) in terms.select(F.lower(term)).where(F.coalesce(F.col(term), F.lit("")) != "").distinct().orderBy(F.lower(term)).toLocalIterator():
        part.append(value)
        size += len(value.encode())
        if size >= MOST_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def term_hits(texts: DataFrame, key: str, text: Column, terms: DataFrame, term: str = "term") -> DataFrame:
    """``key`` and ``term``: each text with every term that it holds, in any case of letters, once.

    ``terms`` is a table; its distinct terms, lower-cased, become an automaton
    that is sent to all tasks, so that a text is read once whatever their
    number. Terms beyond ``MOST_BYTES`` make further automata, each with a pass
    of its own. Blank terms and null texts count for nothing; terms may overlap
    and hold each other. Rows that repeat a key are read each.
    """
    spark = with_package(texts.sparkSession)
    schema = T.StructType([T.StructField(key, texts.schema[key].dataType), T.StructField("term", T.StringType())])
    plain = texts.select(F.col(key), F.lower(text).alias("__text")).where("__text IS NOT NULL")
    out = spark.createDataFrame([], schema)
    for part in _parts(terms, term):
        out = out.unionByName(plain.mapInArrow(_reader(spark.sparkContext.broadcast((TermAutomaton([x.encode() for x in part]), part)), key), schema))
    return out


def _reader(sent, key: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, names = sent.value
        names = pa.array(names, pa.string())
        for batch in batches:
            column = batch.column(1).cast(pa.large_binary())
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
            i = 0
            while i < len(column):
                j = min(max(i + 1, int(np.searchsorted(offsets, offsets[i] + TOGETHER, side="right")) - 1), len(column))
                at, term = automaton.hits(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at + i)), names.take(pa.array(term))], names=[key, "term"])
                i = j

    return read
