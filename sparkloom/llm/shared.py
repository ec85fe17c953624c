"""Tables that cut lineage, in a folder that all executors share."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.session import shared_folder


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder, in folders by the columns ``by``, and read back, so that lost executors cost no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """``df`` as a table in the shared folder whose files hold the rows of a hash of ``key``: grouping or joining by it later moves the other side only."""
    spark, table = df.sparkSession, f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.repartition(n, key).write.format("parquet").bucketBy(n, key).option("path", f"{shared_folder(spark)}/{table}")
    writer.saveAsTable(table)
    return spark.table(table)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that only tables already written were made from."""
    for table in tables:
        if path := getattr(table, "_written_at", None):
            jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def sampled(df: DataFrame, key: Column, n: int, most: int) -> DataFrame:
    """``most`` of the ``n`` rows, or all, chosen by the hash ``key``; few others are left when the sort begins, however many tasks there are."""
    share = min(1.0, 1.25 * most / max(n, 1))
    return df.where(F.pmod(key, F.lit(1 << 40)) < math.ceil(share * (1 << 40))).orderBy(key).limit(most)


def sums_before(rows: DataFrame, at: str, value: str, name: str, parts: int = 4096) -> DataFrame:
    """``rows``, whose numbers ``at`` differ, with ``name``: the sum of ``value`` over all rows with smaller numbers.

    Numbers fall into ``parts`` stretches; sums of stretches, at most as many,
    are added up in one task, and rows within their stretch, so that no task
    gets more rows as there are more but its stretch's.
    """
    most = rows.agg(F.coalesce(F.max(at), F.lit(0))).first()[0]
    stretch = F.floor(F.col(at) / (most // parts + 1)).alias("__stretch")
    sums = rows.groupBy(stretch).agg(F.sum(value).alias("__sum"))
    earlier = F.sum("__sum").over(Window.orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1))
    firsts = sums.select("__stretch", F.coalesce(earlier, F.lit(0)).alias("__first"))
    within = F.sum(value).over(Window.partitionBy("__stretch").orderBy(at).rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumn("__stretch", stretch).withColumn("__within", F.coalesce(within, F.lit(0)))
    return placed.join(firsts, "__stretch").select(*rows.columns, (F.col("__first") + F.col("__within")).alias(name))


def renamed(df: DataFrame, without: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, str]]:
    """``df`` under the names c0, c1, ..., and these by the columns' own names, so that no column clashes with an operator's; columns in ``without`` are left out."""
    names = {c: f"c{i}" for i, c in enumerate(c for c in df.columns if c not in without)}
    return df.select([df[f"`{c}`"].alias(n) for c, n in names.items()]), names
