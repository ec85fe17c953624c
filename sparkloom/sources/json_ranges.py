"""Large JSON documents read in parts: byte ranges of one file, whose records are found from the state of brackets and quotes.

A first pass tells of each range, once for a start outside of a string and
once for one inside, how brackets and quotes go on in it and how many commas
stand at which depth. Put one after the other these give each range the state
in which it begins and the number of its first record. In the second pass a
range reads the records whose delimiter it holds, over its end if need be.
Files must be where all executors reach them by a path or address that Arrow's
file systems know. Listing, both passes and what joins them are work of tasks,
each of which reads many ranges.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .listing import files_below, located

#: Bytes of a range.
RANGE_BYTES = 64 << 20
_QUOTE, _BACKSLASH, _COMMA = 0x22, 0x5C, 0x2C
_STEP = np.zeros(256, np.int8)
_STEP[[0x5B, 0x7B]], _STEP[[0x5D, 0x7D]] = 1, -1


def marks(data: np.ndarray, escaped: bool, inside: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Where brackets and commas outside of strings stand, the depth after each, from 0, and whether the data end inside a string.

    ``escaped`` tells whether a backslash before the data escapes their first
    byte, ``inside`` whether they begin inside a string.
    """
    slash = np.flatnonzero(data == _BACKSLASH)
    quote = data == _QUOTE
    if len(slash) or escaped:
        # every second backslash of a run, and what follows an odd run, is escaped
        new = np.r_[True, np.diff(slash) > 1][: len(slash)]
        first = slash[new][np.cumsum(new) - 1] if len(slash) else slash
        odd = (slash - first) % 2 == 0
        if escaped and len(slash) and slash[0] == 0:
            odd = np.where(first == 0, ~odd, odd)
        after = slash[odd] + 1
        quote[after[after < len(data)]] = False
        if escaped and len(data) and data[0] != _BACKSLASH:
            quote[0] = False
    within = (np.cumsum(quote) + inside) % 2 == 1
    at = np.flatnonzero(((_STEP[data] != 0) | (data == _COMMA)) & ~within)
    return at, np.cumsum(_STEP[data[at]], dtype=np.int64), bool(within[-1]) if len(data) else inside


def escape_before(data: np.ndarray) -> bool:
    """Whether an odd number of backslashes ends the data."""
    other = np.flatnonzero(data[::-1] != _BACKSLASH)
    return bool((other[0] if len(other) else len(data)) % 2)


class _Range:
    def __init__(self, path: str, number: int, begin: int, end: int, state: tuple[int, int, int] = (0, 0, 0)) -> None:
        self.path, self.number, self.begin, self.end, self.state = path, number, begin, end, state


class _Reader:
    """Without the option ``states`` a range gives a row with what it does to the state, with it its records."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.size = options["path"], int(options.get("range_bytes", RANGE_BYTES))
        self.states = json.loads(options["states"]) if "states" in options else None

    def partitions(self) -> list[_Range]:
        system, path = located(self.path)
        found = system.get_file_info(path)
        files = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        files = sorted((x.path, x.size) for x in files if x.type == fs.FileType.File and not x.base_name.startswith(("_", ".")))
        ranges = [(name, i, begin, min(begin + self.size, size)) for name, size in files for i, begin in enumerate(range(0, size, self.size))]
        if self.states is None:
            return [_Range(*x) for x in ranges]
        return [_Range(*x, tuple(self.states[x[0]][x[1]])) for x in ranges]

    def read(self, part: _Range) -> Iterator[tuple]:
        system, _ = located(self.path)
        with system.open_input_file(part.path) as file:
            escaped = self._escaped(file, part.begin)
            data = np.frombuffer(file.read_at(part.end - part.begin, part.begin), np.uint8)
            yield from self._summary(part, data, escaped) if self.states is None else self._records(part, file, data, escaped)

    @staticmethod
    def _escaped(file: pa.NativeFile, begin: int) -> bool:
        """Whether the byte at ``begin`` is escaped by the backslashes before it."""
        back = min(begin, 64)
        while True:
            tail = np.frombuffer(file.read_at(back, begin - back), np.uint8)
            if back == begin or (tail != _BACKSLASH).any():
                return escape_before(tail)
            back = min(begin, 2 * back)

    @staticmethod
    def _summary(part: _Range, data: np.ndarray, escaped: bool) -> Iterator[tuple]:
        out = []
        for inside in (False, True):
            at, depth, ends = marks(data, escaped, inside)
            commas = Counter(depth[data[at] == _COMMA].tolist())
            out.append([int(ends), int(depth[-1]) if len(depth) else 0, sorted(commas.items())])
        yield part.path, part.number, json.dumps(out)

    def _records(self, part: _Range, file: pa.NativeFile, data: np.ndarray, escaped: bool) -> Iterator[tuple]:
        inside, level, pos = part.state
        at, depth, ends = marks(data, escaped, bool(inside))
        depth = depth + level
        step = _STEP[data[at]]
        opens = (step == 1) & (depth == 1)
        starts = np.flatnonzero(opens | ((step == 0) & (depth == 1)))
        closes = np.flatnonzero(((step == 0) & (depth == 1)) | ((step == -1) & (depth == 0)))
        ended = closes[np.minimum(np.searchsorted(closes, starts, side="right"), max(len(closes) - 1, 0))] if len(closes) else np.full(len(starts), -1)
        keyed = file.read_at(1 << 12, 0).lstrip(b"\xef\xbb\xbf \t\r\n")[:1] == b"{"
        for k, stop in zip(starts.tolist(), ended.tolist(), strict=True):
            begin = int(at[k]) + 1
            if stop > k:
                text, last = data[begin : at[stop]].tobytes(), bool(step[stop] == -1)
            else:
                text, last = self._beyond(part, file, data[begin:].tobytes(), ends, int(depth[-1]), escape_before(data))
            value, name = text.decode().strip(), None
            if opens[k] and last and not value:
                continue  # an empty list or object
            if keyed:
                name, until = json.JSONDecoder().raw_decode(value)
                value = value[until:].lstrip()[1:].lstrip()
            yield part.path, pos, name, value
            pos += 1

    def _beyond(self, part: _Range, file: pa.NativeFile, text: bytes, inside: bool, level: int, escaped: bool) -> tuple[bytes, bool]:
        """The rest of a record that goes on after its range, and whether it is the last one."""
        parts, begin, size = [text], part.end, 1 << 16
        while raw := file.read_at(size, begin):
            data = np.frombuffer(raw, np.uint8)
            at, depth, ends = marks(data, escaped, inside)
            step, depth = _STEP[data[at]], depth + level
            stop = np.flatnonzero(((step == 0) & (depth == 1)) | ((step == -1) & (depth == 0)))
            if len(stop):
                parts.append(raw[: int(at[stop[0]])])
                return b"".join(parts), bool(step[stop[0]] == -1)
            parts.append(raw)
            inside, level, escaped, begin, size = ends, int(depth[-1]) if len(depth) else level, escape_before(data), begin + len(raw), min(2 * size, self.size)
        return b"".join(parts), True  # the file ends too early


def json_parts(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``path``, ``pos``, ``name``, ``value``: the elements of JSON lists, or members of JSON objects, of one file or all files below a folder, as text.

    ``pos`` counts a file's records from 0 in their order; ``name`` is null in
    lists. Files are read in ranges of ``range_bytes``, whatever the size of a
    document; a record may be longer than a range and is held in the task that
    begins it. White space around records is left out. Empty files, lists and
    objects and single values have no records. A task reads several ranges,
    64 MB or more if there are more than tasks for all cores; the driver gets
    two sums. A file's states, a few numbers for each of its ranges, are put
    together in one task.
    """
    files = files_below(spark, path, without=lambda name: False).where(~F.element_at(F.split("path", "/"), -1).rlike("^[_.]") & (F.col("length") > 0))
    last = F.floor((F.col("length") - 1) / range_bytes)
    n, size = files.agg(F.coalesce(F.sum(last + 1), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0))).first()
    least = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    tasks = max(min(n, max(least, size // RANGE_BYTES)), 1)
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0), last)).alias("number"))

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader({"path": path, "range_bytes": range_bytes})
        for batch in batches:
            rows = [row for name, length, i in _rows(batch) for row in reader.read(_Range(name, i, i * range_bytes, min((i + 1) * range_bytes, length)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[2] for x in rows], pa.string())], names=[*batch.schema.names, "summary"])

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict[str, tuple[int, int, int, bool]] = {}
        for batch in batches:
            if batch.num_rows:
                found: dict[str, list[tuple[int, int, int]]] = {}
                rows = [(name, i, summary) for name, _, i, summary in _rows(batch)]
                put_together(rows, found, now)
                now = {rows[-1][0]: now[rows[-1][0]]}  # rows come file by file
                state = [x for held in found.values() for x in held]
                columns = [pa.array([int(x[k]) for x in state], pa.int64()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=["path", "length", "number", "inside", "level", "pos"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader({"path": path, "range_bytes": range_bytes, "states": "{}"})
        for batch in batches:
            for name, length, i, *state in _rows(batch):
                found = list(reader.read(_Range(name, i, i * range_bytes, min((i + 1) * range_bytes, length), tuple(state))))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*found), (pa.string(), pa.int64(), pa.string(), pa.string()))], names=["path", "pos", "name", "value"])

    told = ranges.repartition(tasks, "path", "number").mapInArrow(summaries, "path string, length long, number long, summary string")
    begun = told.repartition("path").sortWithinPartitions("path", "number").mapInArrow(states, "path string, length long, number long, inside long, level long, pos long")
    return begun.repartition(tasks, "path", "number").mapInArrow(records, "path string, pos long, name string, value string")


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(x.to_pylist() for x in batch.columns))


def put_together(summaries: list[tuple[str, int, str]], states: dict[str, list[tuple[int, int, int]]], now: dict[str, tuple[int, int, int, bool]]) -> None:
    """The state in which each range begins, by file: inside a string or not, depth, and number of the next record."""
    for name, _, summary in summaries:
        inside, level, pos, begun = now.get(name, (0, 0, 0, False))
        states.setdefault(name, []).append((inside, level, pos))
        ends, change, commas = json.loads(summary)[inside]
        # a record begins behind the first bracket and behind every comma at depth 1
        opened = not begun and (level + change > 0 or any(level + d > 0 for d, _ in commas))
        count = sum(n for d, n in commas if level + d == 1) + opened
        now[name] = (ends, level + change, pos + count, begun or opened)
