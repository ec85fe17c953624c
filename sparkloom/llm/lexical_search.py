"""Ranked lexical search: best-first over document intervals, bounded by range maxima of posting lists."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import spans
from .encoding import ragged
from .shared import written
from .toxicity import SEPARATORS

#: Fixed values of the score: a weight's and an impact's scale, and the parts of the length's norm.
WEIGHT_SCALE, IMPACT_SCALE, TF_SCALE, NORM_SCALE, NORM_FLAT, NORM_LENGTH = 1000, 1_000_000_000, 1000, 8, 10, 90
#: Documents that an item gets at most.
TOP = 10
#: Text bytes of the documents of one shard of the index, about; a longer text is a shard of its own.
SHARD_BYTES = 4 << 20
#: Bytes of items' texts that are sent to all tasks at once, about; further items take another pass over the index.
ITEM_BYTES = 4 << 20
#: Intervals of an item that are split together: the best ones, more in every round.
FIRST_SPLITS, MOST_SPLITS = 8, 512
_COUNTER_BITS = 33
_LAST = np.iinfo(np.int64).max


# -- terms ---------------------------------------------------------------------


def _lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = spans.bytes_of(column)
    return data + ((data >= 0x41) & (data <= 0x5A)).astype(np.uint8) * np.uint8(0x20), offsets


def _grouped(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both lanes of the terms' hashes, an order that keeps equal terms together and in their places, and where in it a new term begins."""
    one, two = spans.hash_spans(data, begin, end), spans.hash_spans(data, begin, end, 1)
    order = np.argsort(one, kind="stable")
    new = np.r_[True, one[order][1:] != one[order][:-1]][: len(order)]
    if (~new & np.r_[False, two[order][1:] != two[order][:-1]][: len(order)]).any():  # one lane alone would take two terms for the same
        order = np.lexsort((two, one))
        new = np.r_[True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])]
    return one, two, order, new


def _squeezed(**arrays: np.ndarray) -> bytes:
    batch = pa.record_batch({name: pa.array([x.tobytes()], pa.large_binary()) for name, x in arrays.items()})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _spread(blob: pa.Scalar, **kinds: type) -> list[np.ndarray]:
    row = pa.ipc.open_stream(blob.as_buffer()).read_all()
    return [np.frombuffer(row[name][0].as_buffer(), kind) for name, kind in kinds.items()]


# -- index -----------------------------------------------------------------------


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """An inverted index of every document's whole text, a written table of shards.

    ``filled`` counts a shard's documents with a term and ``held`` all their
    terms; ``words`` has its distinct terms in the order of their hashes, with
    the lengths of their posting lists; ``postings`` has the lists, documents
    in the order of their id, and ``who`` the ids and lengths of documents.
    It serves any number of searches.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << _COUNTER_BITS
        for batch in batches:
            _, sizes = spans.bytes_of(batch.column(1))
            for i, j in spans.slices(sizes, SHARD_BYTES):
                yield shard(batch.slice(i, j - i), number)
                number += 1

    def shard(rows: pa.RecordBatch, number: int) -> pa.RecordBatch:
        rows = rows.take(pc.sort_indices(rows.column(0), null_placement="at_end"))
        data, offsets = _lowered(rows.column(1))
        begin, end, doc = spans.split(data, offsets, SEPARATORS)
        lengths = np.bincount(doc, minlength=len(rows))
        _, _, order, new = _grouped(data, begin, end)
        term, doc = np.cumsum(new), doc[order]
        first = np.flatnonzero(new | np.r_[True, doc[1:] != doc[:-1]][: len(doc)])
        one = order[new]
        size = end[one] - begin[one]
        words = _squeezed(bytes=data[ragged(begin[one], size)], sizes=size.astype(np.int32), lists=np.bincount(term[first], minlength=len(one) + 1)[1:].astype(np.int32))
        postings = _squeezed(docs=doc[first].astype(np.int32), tf=np.diff(np.r_[first, len(doc)]).astype(np.int32))
        ids = rows.column(0)
        who = _squeezed(ids=ids.fill_null(_LAST).to_numpy(zero_copy_only=False), none=ids.is_null().to_numpy(zero_copy_only=False), lengths=lengths)
        return pa.RecordBatch.from_pydict({"shard": [number], "filled": [int((lengths > 0).sum())], "held": [int(lengths.sum())], "words": [words], "postings": [postings], "who": [who]}, schema=schema)

    schema = pa.schema([("shard", pa.int64()), ("filled", pa.int64()), ("held", pa.int64()), ("words", pa.binary()), ("postings", pa.binary()), ("who", pa.binary())])
    kinds = "shard long, filled long, held long, words binary, postings binary, who binary"
    return written(docs.select(F.col(id_col).try_cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(emit, kinds), "lexical-index")


# -- items -----------------------------------------------------------------------


@dataclass(frozen=True)
class Items:
    """Items of one pass: their ids and numbers, and for each its distinct terms, as numbers of the terms' sorted hashes."""

    ids: pa.Array
    numbers: np.ndarray
    offsets: np.ndarray
    terms: np.ndarray
    one: np.ndarray
    two: np.ndarray

    @staticmethod
    def of(table: pa.Table) -> Items:
        data, offsets = _lowered(table["text"])
        begin, end, item = spans.split(data, offsets, SEPARATORS)
        one, two, order, new = _grouped(data, begin, end)
        term = np.empty(len(order), np.int64)
        term[order] = np.cumsum(new) - 1
        n = int(new.sum())
        pairs = np.unique(item * max(n, 1) + term)
        item, term = np.divmod(pairs, max(n, 1))
        return Items(table["item"].combine_chunks(), table["number"].to_numpy(), np.searchsorted(item, np.arange(len(table) + 1)), term, one[order[new]], two[order[new]])

    def found(self, words: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Terms that a shard holds, and where their posting lists begin and how long they are."""
        data, sizes, lists = _spread(words, bytes=np.uint8, sizes=np.int32, lists=np.int32)
        end = np.cumsum(sizes, dtype=np.int64)
        hashes = spans.hash_spans(data, end - sizes, end)
        at = np.searchsorted(hashes, self.one)
        there = np.flatnonzero(at < len(hashes))
        there = there[hashes[at[there]] == self.one[there]]
        same = spans.hash_spans(data, (end - sizes)[at[there]], end[at[there]], 1) == self.two[there]
        for k in np.flatnonzero(~same).tolist():  # a lane in common: look further
            spot = int(at[there[k]]) + 1
            while spot < len(hashes) and hashes[spot] == self.one[there[k]] and not same[k]:
                same[k] = spans.hash_spans(data, (end - sizes)[spot : spot + 1], end[spot : spot + 1], 1)[0] == self.two[there[k]]
                at[there[k]], spot = spot, spot + 1
        there = there[same]
        first = np.cumsum(lists, dtype=np.int64) - lists
        return there, first[at[there]], lists[at[there]].astype(np.int64)


def _batches(items: DataFrame, item_col: str, text_col: str) -> Iterator[pa.Table]:
    """All items, as many at a time as have about ``ITEM_BYTES`` of text; a longer text stands alone."""
    numbered = written(items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("number")), "items")
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 16
    total, last = numbered.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(F.col("number").bitwiseAND((1 << 33) - 1)), F.lit(0))).first()
    if total <= ITEM_BYTES:
        yield numbered.toArrow()
        return
    step = max(1, (last + 1) // (-(-total // ITEM_BYTES)))
    lots = numbered.withColumn("lot", F.shiftright("number", 33) * (last // step + 1) + F.floor(F.col("number").bitwiseAND((1 << 33) - 1) / step))
    for (lot,) in lots.select("lot").distinct().orderBy("lot").toLocalIterator():
        yield lots.where(F.col("lot") == lot).drop("lot").toArrow()


# -- search ------------------------------------------------------------------------


class RangeMaxima:
    """Sparse tables of posting lists that follow each other: the place of the greatest value of any range of a list."""

    def __init__(self, values: np.ndarray, longest: int) -> None:
        self.values, self.levels = values, [np.arange(len(values), dtype=np.int32)]
        span = 1
        while 2 * span <= longest:
            a, b = self.levels[-1][:-span], self.levels[-1][span:]
            self.levels.append(np.where(values[a] >= values[b], a, b))
            span *= 2

    def places(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of each range low to high - 1, which mustn't be empty."""
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level).tolist():
            some = np.flatnonzero(level == k)
            a, b = self.levels[k][low[some]], self.levels[k][high[some] - (1 << k)]
            out[some] = np.where(self.values[a] >= self.values[b], a, b)
        return out


@dataclass
class Best:
    """Each item's best documents so far: scores, ids and whether an id is null, in order; score 0 where there are fewer."""

    score: np.ndarray
    id: np.ndarray
    none: np.ndarray

    @staticmethod
    def nothing(items: int, k: int) -> Best:
        return Best(np.zeros((items, k), np.int64), np.full((items, k), _LAST), np.zeros((items, k), bool))

    def add(self, item: np.ndarray, score: np.ndarray, id_: np.ndarray, none: np.ndarray) -> None:
        touched, k = np.unique(item), self.score.shape[1]
        owner = np.r_[np.repeat(touched, k), item]
        score, id_, none = np.r_[self.score[touched].ravel(), score], np.r_[self.id[touched].ravel(), id_], np.r_[self.none[touched].ravel(), none]
        order = np.lexsort((none, id_, -score, owner))
        rank = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        kept = order[rank < k].reshape(len(touched), k)
        self.score[touched], self.id[touched], self.none[touched] = score[kept], id_[kept], none[kept]


@dataclass
class Intervals:
    """Documents low to high - 1 that may hold an item's best ones: a bound of their scores, and the ranges of the lists with a posting there."""

    item: np.ndarray
    low: np.ndarray
    high: np.ndarray
    bound: np.ndarray
    #: Where the greatest impact of all the interval's lists stands.
    peak: np.ndarray
    offsets: np.ndarray
    first: np.ndarray
    last: np.ndarray
    list: np.ndarray

    @staticmethod
    def of(maxima: RangeMaxima, item: np.ndarray, low: np.ndarray, high: np.ndarray, owner: np.ndarray, first: np.ndarray, last: np.ndarray, list_: np.ndarray) -> Intervals:
        """Intervals with their bounds, the sum of their lists' range maxima; ranges without a posting and intervals without a range are left out."""
        some = np.flatnonzero(last > first)
        owner, first, last, list_ = owner[some], first[some], last[some], list_[some]
        new = np.r_[True, owner[1:] != owner[:-1]][: len(owner)]
        begin, which = np.flatnonzero(new), owner[new]
        place = maxima.places(first, last)
        impact = maxima.values[place]
        bound = np.add.reduceat(impact, begin) if len(begin) else impact
        size = np.diff(np.r_[begin, len(owner)])
        top = impact == np.repeat(np.maximum.reduceat(impact, begin), size) if len(begin) else np.zeros(0, bool)
        at = np.flatnonzero(top)
        peak = place[at[np.searchsorted(at, begin)]]
        return Intervals(item[which], low[which], high[which], bound, peak, np.r_[begin, len(owner)], first, last, list_)

    def take(self, rows: np.ndarray) -> Intervals:
        size = self.offsets[rows + 1] - self.offsets[rows]
        at = ragged(self.offsets[rows], size)
        return Intervals(self.item[rows], self.low[rows], self.high[rows], self.bound[rows], self.peak[rows], np.r_[0, np.cumsum(size)], self.first[at], self.last[at], self.list[at])

    def with_(self, other: Intervals) -> Intervals:
        joined = {n: np.concatenate([getattr(self, n), getattr(other, n)]) for n in ("item", "low", "high", "bound", "peak", "first", "last", "list")}
        return Intervals(offsets=np.r_[self.offsets, other.offsets[1:] + self.offsets[-1]], **joined)


def search_shard(items: Items, weights: np.ndarray, filled: int, held: int, words: pa.Scalar, postings: pa.Scalar, who: pa.Scalar, best: Best) -> int:
    """Bring the shard's documents into ``best``; the number of documents that were scored.

    An item begins with one interval, the whole shard. Of its open intervals
    the best are split at the document of their greatest impact, which is
    scored from the item's lists; what lies before and behind it becomes two
    intervals, bounded by the sums of their lists' range maxima. An interval
    whose bound is below the item's last place so far is dropped, and so is
    one that could only tie with it by larger ids.
    """
    term, start, size = items.found(words)
    if not len(term):
        return 0
    docs, tf = _spread(postings, docs=np.int32, tf=np.int32)
    ids, none, lengths = _spread(who, ids=np.int64, none=np.bool_, lengths=np.int64)
    at = ragged(start, size)
    doc, tf = docs[at].astype(np.int64), tf[at].astype(np.int64)
    norm = NORM_FLAT + NORM_LENGTH * lengths * filled // max(held, 1)
    impact = np.repeat(weights[term], size) * (IMPACT_SCALE * tf // (TF_SCALE * tf + NORM_SCALE * norm[doc]))
    maxima = RangeMaxima(impact, int(size.max()))
    start, n = np.cumsum(size) - size, len(ids)
    key = np.repeat(np.arange(len(term)), size) * n + doc  # lists one after the other, each in the order of documents
    of_term = np.full(len(items.one), -1)
    of_term[term] = np.arange(len(term))
    lists = of_term[items.terms]
    owner = np.repeat(np.arange(len(items.numbers)), np.diff(items.offsets))
    owner, lists = owner[lists >= 0], lists[lists >= 0]
    count = len(items.numbers)
    open_ = Intervals.of(maxima, np.arange(count), np.zeros(count, np.int64), np.full(count, n), owner, start[lists], start[lists] + size[lists], lists)
    splits, scored = FIRST_SPLITS, 0
    while True:
        floor, rival = best.score[open_.item, -1], best.id[open_.item, -1]
        rows = np.flatnonzero((open_.bound > floor) | ((open_.bound == floor) & (ids[open_.low] < rival)))
        if not len(rows):
            return scored
        rows = rows[np.lexsort((-open_.bound[rows], open_.item[rows]))]
        rank = np.arange(len(rows)) - np.searchsorted(open_.item[rows], open_.item[rows])
        now, later = open_.take(rows[rank < splits]), open_.take(rows[rank >= splits])
        splits = min(2 * splits, MOST_SPLITS)
        middle, width = doc[now.peak], np.diff(now.offsets)
        wanted = now.list * n + np.repeat(middle, width)
        cut = np.clip(np.searchsorted(key, wanted), now.first, now.last)
        hit = (cut < now.last) & (key[np.minimum(cut, len(key) - 1)] == wanted)
        score = np.add.reduceat(np.where(hit, impact[np.minimum(cut, len(key) - 1)], 0), now.offsets[:-1])
        scored += len(middle)
        real = score > 0
        best.add(now.item[real], score[real], ids[middle[real]], none[middle[real]])
        many = len(middle)
        owner = np.repeat(np.arange(many), width)
        halves = Intervals.of(
            maxima, np.r_[now.item, now.item], np.r_[now.low, middle + 1], np.r_[middle, now.high],
            np.r_[owner, owner + many], np.r_[now.first, cut + hit], np.r_[cut, now.last], np.r_[now.list, now.list],
        )
        open_ = later.with_(halves)


def search(shards: DataFrame, items: DataFrame, k: int = TOP, item_col: str = "item_id", text_col: str = "text", item_name: str = "item_id") -> DataFrame:
    """``item_name``, ``rank``, ``doc_id``, ``score``: each item's ``k`` best documents of an ``index``, those with a score above 0.

    Terms are runs of ASCII letters and digits and all other characters beyond
    ASCII, only A to Z lower-cased. A term's weight falls with the number of
    documents that hold it, its impact in a document grows with how often it
    stands there and falls with the document's length; an item's score is the
    sum of its distinct terms' impacts, all in whole numbers. Equal scores come
    by ascending id, null ids last.

    Every shard is searched by best-first splits (see ``search_shard``); a
    task carries each item's best documents from shard to shard, so that most
    of later shards are pruned as a whole, and tells only these. Items are sent
    to all tasks, about ``ITEM_BYTES`` at a time; beyond that every further
    part takes a pass of its own. What comes to the driver is two counts, the
    items and a number for each of their terms.

    Every row of ``items`` is an item of its own, also one that repeats an id;
    null and empty texts have no terms and no rows; so have empty tables. Ids
    of documents are whole numbers (others count as null); rows that repeat an
    id are documents each. Other columns don't matter. A very long text is one
    shard and is held whole in one task, at about 80 bytes for each of its bytes.
    """
    spark = shards.sparkSession
    filled, held = shards.agg(F.coalesce(F.sum("filled"), F.lit(0)), F.coalesce(F.sum("held"), F.lit(0))).first()
    kind = items.schema[item_col].dataType
    schema = T.StructType([T.StructField("query", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField(item_name, kind), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    parts = [_found(spark, shards, Items.of(table), filled, held, k, schema) for table in _batches(items, item_col, text_col)]
    rows = parts[0] if parts else spark.createDataFrame([], schema)
    for part in parts[1:]:
        rows = rows.unionByName(part)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for by in (("query", "part"), ("query",)):  # what many tasks tell of an item meets in parts first
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    return rows.select(item_name, "rank", "doc_id", "score")


def _found(spark, shards: DataFrame, items: Items, filled: int, held: int, k: int, schema: T.StructType) -> DataFrame:
    sent = spark.sparkContext.broadcast(items)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        total = np.zeros(len(items.one), np.int64)
        for batch in batches:
            for words in batch.column(0):
                term, _, size = items.found(words)
                total[term] += size
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "n"])

    counted = shards.select("words").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(items.one), np.int64)
    df[counted["term"].to_numpy()] = counted["n"].to_numpy()
    weights = spark.sparkContext.broadcast(np.floor(WEIGHT_SCALE * np.log((2 * filled + 2) / (2 * df + 1))).astype(np.int64))
    names = schema.names

    def best_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, part = sent.value, TaskContext.get().partitionId()
        best = Best.nothing(len(items.numbers), k)
        for batch in batches:
            for words, postings, who in zip(*batch.columns, strict=True):
                search_shard(items, weights.value, filled, held, words, postings, who, best)
        item, place = np.nonzero(best.score)
        ids = pa.array(best.id[item, place], mask=best.none[item, place])
        yield pa.RecordBatch.from_arrays([pa.array(items.numbers[item]), pa.array(np.full(len(item), part % 256, np.int32)), items.ids.take(pa.array(item)), ids, pa.array(best.score[item, place])], names=names)

    return shards.select("words", "postings", "who").mapInArrow(best_of, schema)


def op11_lexical_search(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return search(index(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), lengths AS (
  SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id
), totals AS (
  SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS l FROM lengths
), tfs AS (
  SELECT doc_id, term, count(*) AS tf FROM d GROUP BY doc_id, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tfs, totals GROUP BY term, big_n
), scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // l)))) AS BIGINT) AS score
  FROM q JOIN tfs USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), totals GROUP BY item_id, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0
) WHERE rank <= 10
"""
