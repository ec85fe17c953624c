"""Sinks: pages by locale, manifest, sitemap and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SITEMAP_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:xhtml="http://www.w3.org/1999/xhtml">'
#: Fixed value: entries that a sitemap has at most.
MOST_ENTRIES = 50_000


def write_pages(pages: DataFrame, folder: str) -> None:
    """Rendered pages (locale, route, html) as Parquet by locale, replacing what was there."""
    pages.write.mode("overwrite").partitionBy("locale").parquet(folder)


def write_manifest(pages: DataFrame, folder: str) -> None:
    """What was generated, as lines of JSON."""
    pages.write.mode("overwrite").json(folder)


def write_sitemap(entries: DataFrame, folder: str, order: str = "pos") -> None:
    """``entry`` rows in order of a number that counts them from 0; each line of the files is a sitemap of at most ``MOST_ENTRIES``."""
    part = entries.groupBy(F.floor(F.col(order) / MOST_ENTRIES).alias("part")).agg(F.array_sort(F.collect_list(F.struct(order, "entry"))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda x: x["entry"]), "\n")
    part.select(F.concat(F.lit(SITEMAP_HEAD + "\n"), body, F.lit("\n</urlset>")).alias("value")).write.mode("overwrite").text(folder)


def write_state(state: DataFrame, folder: str, keys: list[str], buckets: int = 64) -> None:
    """Keyed state: ``keys`` and the other columns as JSON, in a folder for each bucket of the keys, replacing what was there."""
    rest = F.to_json(F.struct(*(c for c in state.columns if c not in keys)), {"ignoreNullFields": "false"})
    placed = state.select(*keys, rest.alias("state"), F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("bucket"))
    placed.write.mode("overwrite").partitionBy("bucket").parquet(folder)


def write_report(violations: DataFrame, folder: str) -> None:
    """Violations as Parquet by rule."""
    violations.write.mode("overwrite").partitionBy("rule").parquet(folder)
