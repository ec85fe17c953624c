"""Literal search through an index: posting lists of byte trigrams, met for the query's, hits verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.session import with_package

#: Folders of the index; a query reads as many as it has trigrams at most.
BUCKETS = 256
#: Bytes of text whose trigrams are told together.
TOGETHER = 2 << 20


def _bucket(trigrams: np.ndarray) -> np.ndarray:
    return (trigrams * np.int64(0x9E3779B1) >> np.int64(7)) % BUCKETS


def _trigrams(data: np.ndarray) -> np.ndarray:
    """Every three bytes in a row as a number."""
    data = data.astype(np.int64)
    return (data[:-2] << 16) | (data[1:-1] << 8) | data[2:] if len(data) > 2 else np.zeros(0, np.int64)


def write_trigram_index(texts: DataFrame, key: str, text: Column, folder: str) -> None:
    """Posting lists of the lower-cased texts' trigrams below ``folder``, in folders by a hash of the trigram, replacing what was there.

    ``key`` is a whole number. Each task tells of some megabytes of text at a
    time one row for each bucket: distinct trigrams, how many keys each has,
    and these. So no list meets in one place, however common its trigram.
    """
    with_package(texts.sparkSession)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1).cast(pa.large_binary())
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            data, keys, i = np.frombuffer(column.buffers()[2] or b"", np.uint8), batch.column(0).to_numpy(), 0
            while i < len(column):
                j = min(max(i + 1, int(np.searchsorted(offsets, offsets[i] + TOGETHER, side="right")) - 1), len(column))
                part = data[offsets[i] : offsets[j]]
                codes, owner = _trigrams(part), np.repeat(np.arange(i, j), np.diff(offsets[i : j + 1]))
                inside = owner[:-2] == owner[2:] if len(owner) > 2 else np.zeros(0, bool)
                codes, at = np.divmod(np.unique(codes[inside] * (j - i) + owner[: len(inside)][inside] - i), j - i)
                yield rows(codes, keys[i + at])
                i = j

    def rows(codes: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(_bucket(codes), kind="stable")
        codes, keys = codes[order], keys[order].astype(np.int64)
        bucket = _bucket(codes)
        cut = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(bucket)] if len(bucket) else np.zeros(1, np.int64)
        out = []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            values, counts = np.unique(codes[a:b], return_counts=True)
            out.append((int(bucket[a]), values.astype(np.int32).tobytes(), counts.astype(np.int32).tobytes(), keys[a:b].tobytes()))
        return pa.RecordBatch.from_pylist([dict(zip(("bucket", "trigrams", "counts", "keys"), x, strict=True)) for x in out], schema=pa.schema([("bucket", pa.int32()), ("trigrams", pa.binary()), ("counts", pa.binary()), ("keys", pa.binary())]))

    plain = texts.where(F.col(key).isNotNull() & text.isNotNull()).select(F.col(key).cast("long").alias("key"), F.lower(text).alias("text"))
    told = plain.mapInArrow(tell, "bucket int, trigrams binary, counts binary, keys binary")
    told.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(folder)


def candidates(spark: SparkSession, folder: str, query: str) -> DataFrame | None:
    """``key`` of the texts that hold all trigrams of the query; null for a query of less than three bytes.

    Only the buckets of these trigrams are read.
    """
    wanted = np.unique(_trigrams(np.frombuffer(query.lower().encode(), np.uint8)))
    if not len(wanted):
        return None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for trigrams, counts, keys in zip(*batch.columns, strict=True):
                trigrams, counts = np.frombuffer(trigrams.as_buffer(), np.int32), np.frombuffer(counts.as_buffer(), np.int32)
                some = np.repeat(np.isin(trigrams, wanted), counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys.as_buffer(), np.int64)[some]), pa.array(np.repeat(trigrams, counts)[some])], names=["key", "trigram"])

    rows = with_package(spark).read.schema("trigrams binary, counts binary, keys binary, bucket int").parquet(folder).where(F.col("bucket").isin(sorted(set(_bucket(wanted).tolist()))))
    found = rows.select("trigrams", "counts", "keys").mapInArrow(read, "key long, trigram int")
    # a key that is repeated in the table may be told of by several tasks
    bits = F.collect_set("trigram")
    return found.groupBy("key").agg(F.size(bits).alias("n")).where(F.col("n") == len(wanted)).select("key")


def indexed_search(items: DataFrame, key: str, text: Column, query: str, folder: str) -> DataFrame:
    """The rows whose lower-cased text holds the trimmed query literally, as ``search.search`` finds them.

    The index gives the keys that may; their texts are looked at, and those of
    rows without a key. A query of less than three bytes looks at all.
    """
    wanted = query.strip().lower()
    holds = F.contains(F.lower(text), F.lit(wanted))
    may = candidates(items.sparkSession, folder, wanted)
    if may is None:
        return items.where(holds) if wanted else items
    met = items.join(may.withColumnRenamed("key", "__key"), F.col(key) == F.col("__key"), "left_semi")
    return met.unionByName(items.where(F.col(key).isNull())).where(holds)
