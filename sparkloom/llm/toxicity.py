"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import spans
from .blobs import unpacked
from .shared import renamed, written

#: All ASCII that is neither letter nor digit stands between words.
SEPARATORS = tuple(b for b in range(128) if not chr(b).isalnum())
#: A feature is a word or two words at one of these distances: n-grams of one and two words, and skip-grams.
GAPS = (1, 2)
#: Features are hashed to this many coordinates.
BUCKETS = 1 << 22
#: Labelled rows, and bytes of their texts, to learn from, about, chosen by a hash of their id: the classifier's one bounded sample.
MOST_ROWS, MOST_BYTES = 16_000, 256 << 20
#: Passes over the sample.
EPOCHS = 6


@dataclass(frozen=True)
class Rates:
    """FTRL-proximal's parameters: step size alpha / (beta + sqrt(n)), and both penalties."""

    alpha: float = 4.0
    beta: float = 1.0
    l1: float = 10.0
    l2: float = 0.1


@dataclass(frozen=True)
class Model:
    """Coordinates of non-zero weight, their weights, and the bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float


def _features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, coordinate) of all occurrences, kind by kind."""
    begin, end, text = spans.split(data, offsets, SEPARATORS)
    words = spans.hash_spans(data, begin, end)
    yield text, (words % np.uint64(BUCKETS)).astype(np.int64)
    for gap in GAPS:
        if len(words) > gap:
            near = text[:-gap] == text[gap:]
            pair = spans.mix(spans.fold(words[:-gap][near], words[gap:][near], 0) + np.uint64(gap))
            yield text[:-gap][near], (pair % np.uint64(BUCKETS)).astype(np.int64)


def present(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct pairs (text number, coordinate) of the texts' features, or of those marked in ``wanted``."""
    codes = []
    for text, at in _features(data, offsets):
        if wanted is not None:
            some = wanted[at]
            text, at = text[some], at[some]
        codes.append(text * BUCKETS + at)
    codes = np.unique(np.concatenate(codes))
    return np.divmod(codes, BUCKETS)


def _weights(z: np.ndarray, n: np.ndarray, rates: Rates, l1: float) -> np.ndarray:
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((rates.beta + np.sqrt(n)) / rates.alpha + rates.l2))


def learn(rows: list[tuple[int, np.ndarray]], rates: Rates, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias after FTRL-proximal's passes over (label, coordinates) in order; the bias has no L1."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for _ in range(epochs):
        for label, at in rows:
            w = _weights(z[at], n[at], rates, rates.l1)
            bias = _weights(z[-1:], n[-1:], rates, 0.0)[0]
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - label
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / rates.alpha
            z[at] += g - step * w
            z[-1] += g - (np.sqrt(n[-1] + g * g) - np.sqrt(n[-1])) / rates.alpha * bias
            n[at] += g * g
            n[-1] += g * g
    return _weights(z[:-1], n[:-1], rates, rates.l1), float(_weights(z[-1:], n[-1:], rates, 0.0)[0])


def held_out(id_col: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 0 modulo 5."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _chosen(key: Column, share: float) -> Column:
    """Rows whose hash falls into a share of all hashes, however small."""
    return F.pmod(key, F.lit(1 << 40)) < math.ceil(min(share, 1.0) * (1 << 40))


def train(docs: DataFrame, labels: DataFrame, rates: Rates = Rates(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> Model:
    """A model of ``labels``, learned from about ``most_rows`` labelled rows, and ``most_bytes`` of text, that aren't held out.

    Features are words, pairs of neighbours and skip-grams, hashed to
    ``BUCKETS`` coordinates; none is dropped, L1 alone decides which get a
    weight. They are extracted where the texts are. The sample's coordinates
    then go, in the order of a hash of the id, through FTRL-proximal with its
    rates per coordinate, which is a sequence by nature and runs in one task;
    what it holds is bounded by the sample, and only the weights that aren't
    zero come back.

    Labels that are null or whose id is null don't count; of an id with several
    labels the largest does; rows that repeat an id and a text are learned
    once, and the bound holds for rows as for ids. Without labels the model is empty and every score 0.5.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    texts = docs.select(F.col(id_col).alias("__id"), F.lower(F.col(text_col)).alias("text"))
    mean = docs.agg(F.avg(F.octet_length(text_col))).first()[0] or 1.0
    most = min(most_rows, most_bytes / mean)
    order = F.xxhash64("__id", F.lit(1))
    sample = known.where(_chosen(order, most / max(known.count(), 1))).withColumn("order", order)
    # the sample's ids are bounded, and so are its rows: an id may have any number of them
    rows = texts.join(F.broadcast(sample), "__id").select("order", "label", "text").dropDuplicates(["order", "text"])
    held = rows.count()
    if held > 2 * most:
        rows = rows.where(_chosen(F.xxhash64("order", "text"), most / held))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = spans.bytes_of(batch.column(2))
            for i, j in spans.slices(offsets):
                text, at = present(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                bounds = np.searchsorted(text, np.arange(j - i + 1))
                held = [at[a:b].astype(np.int32).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(held, pa.binary()), pa.array(np.zeros(j - i, np.int64))], names=["order", "label", "features", "model"])

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("order", "ascending"), ("label", "ascending"), ("features", "ascending")])
        rows = [(y, np.frombuffer(x.as_buffer(), np.int32)) for y, x in zip(table["label"].to_pylist(), table["features"], strict=True)]
        weights, bias = learn(rows, rates)
        some = np.flatnonzero(weights)
        return pa.table({"features": pa.array([some.tobytes()], pa.binary()), "weights": pa.array([weights[some].tobytes()], pa.binary()), "bias": [bias]})

    examples = written(rows.mapInArrow(extract, "order long, label int, features binary, model long"), "examples")
    found = examples.groupBy("model").applyInArrow(fit, "features binary, weights binary, bias double").toArrow()
    return Model(unpacked(found["features"], np.int64), unpacked(found["weights"], np.float64), sum(found["bias"].to_pylist()))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on), replacing columns of these names.

    Whole texts are scored by the presence of features; null and empty texts
    get the bias alone. All rows stay, repeated or not, and so do all other
    columns. A very long text is held whole in one task, at about 150 bytes
    for each of its bytes. An empty table gives an empty one.
    """
    docs, own = renamed(docs, ("score", "predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        wanted, weights = np.zeros(BUCKETS, bool), np.zeros(BUCKETS, np.float64)
        wanted[model.features], weights[model.features] = True, model.weights
        for batch in batches:
            data, offsets = spans.bytes_of(batch.column(len(names)))
            sums = []
            for i, j in spans.slices(offsets):
                text, at = present(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], wanted)
                sums.append(np.bincount(text, weights[at], minlength=j - i) if len(at) else np.zeros(j - i))
            total = np.concatenate(sums) + model.bias if sums else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], names=[*names, "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    scored = docs.withColumn("lower", F.lower(own[text_col])).mapInArrow(judge, schema).toDF(*own, "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
