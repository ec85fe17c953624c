"""Positions in ordered lists: ordinals, neighbours on a ring, growing prefixes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import padded_ordinal
from ..sources.tables import kept


def ring(items: DataFrame, group: Sequence[str], key: str, stretches: int | None = None) -> DataFrame:
    """Each item's ``position`` and ``n_items`` in its group, a label ``i / n``, and the next and previous key round the ring.

    Spark cuts the order of all groups and keys into ``stretches`` ranges of
    about equal size, by default as many as shuffles have partitions, so that a
    group with a third of all rows isn't sorted in one task. The ranges are
    written once to the shared folder, only these columns of them; the counts
    and ends of a group's ranges, at most ``stretches`` rows a group, place
    their items in the whole. Null keys come first; a null group is a group;
    equal keys of a group share a range. An empty table gives an empty one.
    """
    spark = items.sparkSession
    parts = stretches or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = items.select(*group, key).repartitionByRange(parts, *group, key).withColumn("__stretch", F.spark_partition_id())
    placed = kept(cut, "ring")
    inside = Window.partitionBy(*group, "__stretch").orderBy(key)
    numbered = placed.withColumns({"__at": F.row_number().over(inside), "__next": F.lead(F.struct(key)).over(inside), "__previous": F.lag(F.struct(key)).over(inside)})
    held = placed.groupBy(*group, "__stretch").agg(F.count("*").alias("n"), F.min(F.struct(key)).alias("low"), F.max(F.struct(key)).alias("high"))
    across = Window.partitionBy(*group).orderBy("__stretch")
    whole, earlier = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), across.rowsBetween(Window.unboundedPreceding, -1)
    ends = held.select(
        *(F.col(g).alias(f"__end_{i}") for i, g in enumerate(group)), F.col("__stretch").alias("__end"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"), F.sum("n").over(whole).alias("n_items"),
        F.coalesce(F.lead("low").over(across), F.first("low").over(whole)).alias("__after"), F.coalesce(F.lag("high").over(across), F.last("high").over(whole)).alias("__back"),
    )
    same = F.col("__stretch") == F.col("__end")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"__end_{i}"))
    position, n = (F.col("__before") + F.col("__at")).cast("int"), F.col("n_items")
    return numbered.join(ends, same).select(
        *group, key, position.alias("position"), n, padded_ordinal(position).alias("ordinal"),
        F.concat_ws(" / ", position.cast("string"), n.cast("string")).alias("position_label"),
        F.coalesce("__next", "__after")[key].alias("next_key"), F.coalesce("__previous", "__back")[key].alias("previous_key"),
    )


def prefixes(parts: Column) -> Column:
    """For an array of path segments, structs of position, segment and the path up to it."""
    return F.transform(parts, lambda x, i: F.struct((i + 1).alias("position"), x.alias("segment"), F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i + 1), "/")).alias("path")))


def joined_in_order(rows: DataFrame, group: Sequence[str], order: str, value: Column, separator: str, out: str) -> DataFrame:
    """Each group's values as one string in the order of a column."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
    return rows.groupBy(*group).agg(F.array_join(F.transform(pairs, lambda x: x["v"]), separator).alias(out))
