"""Catalog joins: overlays, lookups with a policy for misses, ordered lists and bridges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import first_filled


def overlay(base: DataFrame, local: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """``base`` with every field that its row in ``local`` holds taken from there, an empty string included.

    Fields that only ``base`` has stay; rows without an overlay stay as they
    are; arrays are replaced whole. Use the position as the key for lists.
    """
    keys = [key] if isinstance(key, str) else list(key)
    fields = [c for c in local.columns if c not in keys]
    marked = local.select(*keys, *(F.col(c).alias(f"__local_{c}") for c in fields))
    joined = base.join(marked, keys, "left")
    kept = [F.coalesce(f"__local_{c}", F.col(c)).alias(c) if c in fields else F.col(c) for c in base.columns]
    return joined.select(*kept, *(F.col(f"__local_{c}").alias(c) for c in fields if c not in base.columns))


def with_label(df: DataFrame, code: str, labels: DataFrame, out: str, override: Column | None = None) -> DataFrame:
    """``df`` with ``out``: the override if filled, else the code's label from ``labels`` (code, label), else the code."""
    table = labels.select(F.col("code").alias("__code"), F.col("label").alias("__label"))
    joined = df.join(table, F.col(code) == F.col("__code"), "left")
    parts = [] if override is None else [override]
    return joined.withColumn(out, first_filled(*parts, F.col("__label"), F.col(code))).drop("__code", "__label")


def looked_up(facts: DataFrame, key: str, items: DataFrame, item_key: str, fields: Sequence[str], order: str | None = None) -> DataFrame:
    """``facts`` with fields of the item that their key names; a miss gives nulls or, with ``order``, the first item's fields."""
    named = items.select(F.col(item_key).alias("__key"), F.lit(True).alias("__hit"), *fields)
    joined = facts.join(named, F.col(key) == F.col("__key"), "left")
    if order is not None:
        first = items.agg(*(F.min_by(c, order).alias(f"__first_{c}") for c in fields))  # one row
        values = first.select(F.struct(*first.columns).alias("f")).scalar()
        joined = joined.withColumns({c: F.when(F.col("__hit"), F.col(c)).otherwise(values[f"__first_{c}"]) for c in fields})
    return joined.drop("__key", "__hit")


def present(lists: DataFrame, array: str, items: DataFrame, item_key: str) -> DataFrame:
    """A row per element of an array column that names an item, with ``pos`` for the list's order; misses are skipped."""
    rows = lists.select("*", F.posexplode(array).alias("pos", "element"))
    return rows.join(items.select(F.col(item_key).alias("element")), "element", "left_semi")


def in_given_order(names: Sequence[str], items: DataFrame, key: str) -> DataFrame:
    """The named items with ``pos``, the name's place in the list; names without an item are skipped."""
    spark = items.sparkSession
    wanted = spark.createDataFrame(list(enumerate(names)), f"pos long, {key} string")
    return items.join(F.broadcast(wanted), key)  # as long as the given list


def bridged(left: DataFrame, bridge: DataFrame, right: DataFrame, left_key: str, right_key: str, pos: str = "pos") -> DataFrame:
    """Pairs of rows that a bridge (left key, right key, pos) curates; its position keeps the order."""
    return left.join(bridge.select(left_key, right_key, pos), left_key).join(right, right_key)


def dependent_options(platforms: DataFrame, key: str, options: str, choice: str) -> DataFrame:
    """``key``, ``pos``, ``option``: the options that a map column lists for one choice; none for an unknown choice."""
    found = F.coalesce(F.try_element_at(F.col(options), F.lit(choice)), F.array().cast("array<string>"))
    return platforms.select(key, F.posexplode(found).alias("pos", "option"))


def for_each(rows: DataFrame, name: str, values: Sequence[str]) -> DataFrame:
    """Every row once for each value of a short given list, with ``pos`` for the list's order."""
    return rows.select("*", F.posexplode(F.array(*map(F.lit, values))).alias("pos", name))


def missing(expected: DataFrame, found: DataFrame, on: Sequence[str]) -> DataFrame:
    """Expected rows that weren't found."""
    return expected.join(found, list(on), "left_anti")


def keep_first(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key: what insertion without replacement leaves."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def all_but(rows: DataFrame, column: str, left_out: Sequence[str]) -> DataFrame:
    """Rows whose value isn't among those left out; null values stay."""
    return rows.where(F.coalesce(~F.col(column).isin(*left_out), F.lit(True)))


def first_match(rows: DataFrame, group: Sequence[str], holds: Column, order: str) -> DataFrame:
    """Each group with the ``order`` of its first row for which a condition holds, null where none does."""
    return rows.groupBy(*group).agg(F.min(F.when(holds, F.col(order))).alias(order))


def flattened(rows: DataFrame, group: Sequence[str], lists: Sequence[str], order: str, out: str) -> DataFrame:
    """Each group's lists one after the other: row by row in an order, and of a row column by column; null lists are empty."""
    whole = F.concat(*(F.coalesce(F.col(c), F.array().cast(rows.schema[c].dataType)) for c in lists))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), whole.alias("v"))))
    return rows.groupBy(*group).agg(F.flatten(F.transform(pairs, lambda x: x["v"])).alias(out))


def concatenated(*lists: DataFrame) -> DataFrame:
    """Rows of several tables of like columns, repeats included."""
    out = lists[0]
    for other in lists[1:]:
        out = out.unionByName(other)
    return out
