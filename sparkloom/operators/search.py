"""Faceted search: literal substrings and exact facets, their options and counts, and related items."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def search_text(*columns: str | Column) -> Column:
    """What a search reads: fields and array elements joined by spaces, in lower case; nulls are skipped."""
    return F.lower(F.concat_ws(" ", *columns))


def visible(text: Column, query: str, facets: Mapping[str, str]) -> Column:
    """Whether a row shows: it holds the trimmed query literally, and equals every chosen facet; blanks choose nothing."""
    wanted = query.strip().lower()
    parts = [F.contains(text, F.lit(wanted))] if wanted else []
    parts += [F.col(name) == value for name, value in facets.items() if value]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def search(items: DataFrame, text: Column, query: str, facets: Mapping[str, str]) -> DataFrame:
    return items.where(visible(text, query, facets))


def visible_counts(items: DataFrame, text: Column, query: str, facets: Mapping[str, str], by: Sequence[str]) -> DataFrame:
    """Rows, visible rows, and whether nothing shows, by group, in one pass."""
    shown = F.coalesce(visible(text, query, facets), F.lit(False))
    counts = items.groupBy(*by).agg(F.count("*").alias("n_rows"), F.count_if(shown).alias("n_visible"))
    return counts.withColumn("is_empty", F.col("n_visible") == 0)


def facet_options(items: DataFrame, facets: Sequence[str], position: str) -> DataFrame:
    """``facet``, ``value``, ``first_pos``, ``n_rows`` and ``rank``: distinct values in the order in which they first occur."""
    long = items.select(position, F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in facets))).alias("x"))
    values = long.where("x.value IS NOT NULL").groupBy("x.facet", "x.value").agg(F.min(position).alias("first_pos"), F.count("*").alias("n_rows"))
    # one row per distinct value
    return values.withColumn("rank", F.row_number().over(Window.partitionBy("facet").orderBy("first_pos", "value")))


def related(items: DataFrame, key: str, groups: Sequence[str], k: int = 3) -> DataFrame:
    """``key``, ``related``, ``rank``: of all other items that share any of the groups, the first ``k`` by key.

    An equality on one group or another would compare all pairs of rows. But
    an item's first k are among the first k + 1 of a group that it shares, so
    each group keeps k + 1 keys and every item meets those alone. The first
    keys of a group are merged as bounded arrays before the shuffle.
    """
    candidates = None
    for group in groups:
        least = _first_keys(items, group, key, k + 1)
        met = items.select(key, group).join(least, group).select(key, F.explode("keys").alias("related"))
        candidates = met if candidates is None else candidates.unionByName(met)
    others = candidates.where(F.col(key) != F.col("related")).distinct()
    rank = F.row_number().over(Window.partitionBy(key).orderBy("related"))
    return others.withColumn("rank", rank).where(F.col("rank") <= k)


def _first_keys(items: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """``group`` and ``keys``, its ``n`` least keys: first of salted parts of the group, then of the parts' firsts."""
    salted = items.where(F.col(group).isNotNull()).select(group, key, F.pmod(F.xxhash64(key), F.lit(32)).alias("__salt"))
    rank = F.row_number().over(Window.partitionBy(group, "__salt").orderBy(key))
    part = salted.withColumn("__rank", rank).where(F.col("__rank") <= n)
    return part.groupBy(group).agg(F.slice(F.array_sort(F.collect_list(key)), 1, n).alias("keys"))
