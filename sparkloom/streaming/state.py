"""Keyed state of a stream as a table: versions of buckets, merged with each batch in joins."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class VersionedState:
    """Rows with distinct ``keys`` and further columns, in buckets by a hash of the keys.

    A batch rewrites only the buckets that its keys fall into, as a version
    with the batch's number, and then a list that says which version each
    bucket has. The list is read from the batch before, so a batch that is run
    again replaces its own version and counts once. ``folder`` must be where
    all executors reach it.
    """

    folder: str
    keys: tuple[str, ...]
    values: str
    buckets: int = 64

    def _schema(self, rows: DataFrame) -> T.StructType:
        return T.StructType([*(T.StructField(k, rows.schema[k].dataType) for k in self.keys), *T._parse_datatype_string(self.values).fields])

    def _versions(self, spark: SparkSession, before: int | None) -> dict[int, int]:
        """The version of every bucket that has one: a row for each bucket at most."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/list")
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not system.exists(path):
            return {}
        done = [int(x.getPath().getName().partition("=")[2]) for x in system.listStatus(path) if "=" in x.getPath().getName() and system.exists(spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))]
        done = [n for n in done if before is None or n < before]
        return {r.bucket: r.version for r in spark.read.schema("bucket int, version long").json(f"{self.folder}/list/batch={max(done)}").collect()} if done else {}

    def _read(self, spark: SparkSession, versions: dict[int, int], schema: T.StructType) -> DataFrame:
        paths = [f"{self.folder}/rows/version={v}/bucket={b}" for b, v in sorted(versions.items())]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def rows(self, spark: SparkSession, keys: str) -> DataFrame:
        """The state after the last batch; ``keys`` are the keys' columns and types."""
        schema = T.StructType([*T._parse_datatype_string(keys).fields, *T._parse_datatype_string(self.values).fields])
        return self._read(spark, self._versions(spark, None), schema)

    def before(self, changes: DataFrame, number: int) -> DataFrame:
        """The state before a batch, of the buckets that ``changes`` fall into."""
        versions = self._versions(changes.sparkSession, number)
        touched = {r[0] for r in changes.select(self._bucket()).distinct().collect()}  # at most as many as buckets
        return self._read(changes.sparkSession, {b: v for b, v in versions.items() if b in touched}, self._schema(changes))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("bucket")

    def merge(self, changes: DataFrame, number: int, update: Callable[[], dict[str, Column]], stays: Column) -> None:
        """Bring a batch's ``changes``, one row for each key, into the state.

        ``update`` gives the new value columns from the columns ``old.*`` (null
        for a new key) and ``new.*`` (null for an old one that doesn't change);
        rows for which ``stays`` of the new values is false go.
        """
        spark = changes.sparkSession
        versions = self._versions(spark, number)
        old = self.before(changes, number).withColumn("__old", F.lit(True)).alias("old")
        new = changes.withColumn("__new", F.lit(True)).alias("new")
        same = None
        for k in self.keys:
            equal = F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}"))
            same = equal if same is None else same & equal
        key = [F.when(F.col("old.__old"), F.col(f"old.{k}")).otherwise(F.col(f"new.{k}")).alias(k) for k in self.keys]
        merged = old.join(new, same, "full").select(*key, *(c.alias(n) for n, c in update().items())).where(stays).withColumn("bucket", self._bucket())
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/rows/version={number}")
        touched = {r[0] for r in changes.select(self._bucket()).distinct().collect()}
        written = spark.read.schema(T.StructType([*self._schema(changes).fields, T.StructField("bucket", T.IntegerType())])).parquet(f"{self.folder}/rows/version={number}")
        there = {r[0] for r in written.select("bucket").distinct().collect()}  # a bucket may have lost its last row
        versions = {b: v for b, v in versions.items() if b not in touched} | dict.fromkeys(touched & there, number)
        spark.createDataFrame(sorted(versions.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").json(f"{self.folder}/list/batch={number}")


def basket_changes(changes: DataFrame, owner: str, item: str, order: str, action: str) -> DataFrame:
    """What a batch does to each owner's item: ``removed``, and ``since``, the first insertion after the last removal.

    Both are aggregated before the shuffle; insertions of a very common item
    meet its last removal in a join that can be split.
    """
    plain = changes.select(owner, item, F.col(order).cast("long").alias("order"), F.coalesce(F.col(action) == "remove", F.lit(False)).alias("out")).where("order IS NOT NULL")
    gone = plain.where("out").groupBy(owner, item).agg(F.max("order").alias("gone"))
    added = plain.where("NOT out").alias("a").join(gone.alias("g"), F.col(f"a.{owner}").eqNullSafe(F.col(f"g.{owner}")) & F.col(f"a.{item}").eqNullSafe(F.col(f"g.{item}")), "left")
    live = added.where("gone IS NULL OR order > gone").groupBy(F.col(f"a.{owner}").alias(owner), F.col(f"a.{item}").alias(item)).agg(F.min("order").alias("since"))
    both = live.select(owner, item, "since", F.lit(False).alias("out")).unionByName(gone.select(owner, item, F.lit(None).cast("long").alias("since"), F.lit(True).alias("out")))
    return both.groupBy(owner, item).agg(F.max("out").alias("removed"), F.min("since").alias("since"))


def merge_basket(state: VersionedState, batch: DataFrame, number: int, owner: str, item: str, order: str, action: str) -> None:
    """Bring a batch of insertions and removals into the baskets; ``state`` has the value ``since long``.

    The same as ``operators.intake.basket``, with a later batch's changes
    counting as later: inserting what is there changes nothing, removing takes
    it out, and an item is in since its first insertion after its last removal.
    """
    changes = basket_changes(batch, owner, item, order, action).persist()
    try:
        since = F.when(F.col("old.since").isNotNull() & ~F.coalesce(F.col("new.removed"), F.lit(False)), F.col("old.since")).otherwise(F.col("new.since"))
        state.merge(changes, number, lambda: {"since": since}, F.col("since").isNotNull())
    finally:
        changes.unpersist()


def merge_first_holders(state: VersionedState, batch: DataFrame, number: int, value: str, within: Sequence[str], key: str) -> DataFrame:
    """Rows (``within``, value, key, first_key) of a batch whose value an earlier row of their group holds, and the state brought on.

    ``state`` has the keys ``within`` and value and the column ``first`` of the
    key's type. An earlier batch's row is the first holder whatever its key;
    in a batch it is the least key. Null values hold nothing, nor do rows whose
    group is null.
    """
    filled = batch.select(*within, value, key).dropna(subset=[*within, value])
    first = filled.groupBy(*within, value).agg(F.min(key).alias("first")).persist()
    try:
        before = state.before(first, number)
        names = [*within, value]
        same = lambda a, b: [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names]
        known = first.alias("n").join(before.alias("o"), same("n", "o"), "left").select(*(F.col(f"n.{n}").alias(n) for n in names), F.coalesce("o.first", "n.first").alias("first_key"))
        later = filled.alias("r").join(known.alias("k"), same("r", "k"))
        found = later.select(*(F.col(f"r.{n}").alias(n) for n in (*names, key)), "first_key").where(F.col(key) != F.col("first_key"))
        state.merge(first, number, lambda: {"first": F.coalesce("old.first", "new.first")}, F.lit(True))
        return found
    finally:
        first.unpersist()
