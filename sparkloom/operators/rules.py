"""Validation of a corpus of pages: fields by pattern, rules as columns, violations as rows."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The attributes of a localized page by locale.
LANG, DIRECTION = {"en": "en", "ar": "ar-KW"}, {"en": "ltr", "ar": "rtl"}
#: The alternates that a localized page names.
ALTERNATES = ("en-KW", "ar-KW", "x-default")
#: Lengths of a description that are right, both included.
SHORTEST, LONGEST = 35, 165
#: Text that a finished page doesn't have.
PLACEHOLDERS = ("lorem ipsum", "insert image here", "fake review", "coming soon")
#: Number of source files from which there are too many, and endings of those whose text is searched.
MOST_FILES, SEARCHED = 100, ("js", "mjs", "html", "css", "json", "webmanifest")
#: Rules that only localized pages must pass.
LOCALIZED = ("canonical", "lang", "dir", "locale_mark", "alternates", "structured_data", "dictionaries", "theme")


def page_fields(html: Column) -> dict[str, Column]:
    """Title, description, canonical url, language and first heading; null where a page has none."""
    found = lambda pattern: F.nullif(F.trim(F.regexp_extract(html, pattern, 1)), F.lit(""))
    return {
        "title": found("(?i)<title>([^<]+)</title>"),
        "description": found('(?i)<meta name="description" content="([^"]*)"'),
        "canonical": found('(?i)<link rel="canonical" href="([^"]+)"'),
        "lang": found('(?i)<html[^>]* lang="([^"]+)"'),
        "heading": found("(?i)<h1[^>]*>([^<]+)</h1>"),
    }


def locale_of(path: Column, locales: Sequence[str]) -> Column:
    """The locale that a path begins with, else null."""
    first = F.regexp_extract(path, "^/?([^/]+)/", 1)
    return F.when(first.isin(*locales), first)


def page_rules(
    html: Column, locale: Column, terms: Sequence[str] = PLACEHOLDERS, lang: Mapping[str, str] = LANG, direction: Mapping[str, str] = DIRECTION,
    removed: Sequence[str] = (), alternates: Sequence[str] = ALTERNATES, dictionaries: Sequence[str] = (), theme: Sequence[str] = (),
) -> dict[str, Column]:
    """Whether a page passes each rule; rules for localized pages are null for others, and a page without content has none of what they ask for.

    Language and direction count on the opening ``<html`` alone; a heading is
    ``<h1`` and then white space or ``>``; every one of ``alternates`` must be
    named; all of ``dictionaries`` (scripts) and ``theme`` (what an early theme
    script holds) must occur. ``terms`` are placeholders and ``removed`` names
    of features that are gone; neither may occur, in any case of letters.
    """
    html = F.coalesce(html, F.lit(""))
    fields, low = page_fields(html), F.lower(html)
    length = F.coalesce(F.length(fields["description"]), F.lit(0))
    any_case = lambda pattern: F.rlike(html, F.lit(f"(?i){pattern}"))

    def attribute(name: str, table: Mapping[str, str]) -> Column:
        out = F.lit(False)
        for key, value in table.items():
            out = F.when(locale == key, any_case(f'<html[^>]+{name}="{re.escape(value)}"')).otherwise(out)
        return out

    def all_of(parts: Sequence[str]) -> Column:
        out = F.lit(True)
        for part in parts:
            out = out & low.contains(part.lower())
        return out

    rules = {
        "title": fields["title"].isNotNull(),
        "description_length": length.between(SHORTEST, LONGEST),
        "heading": any_case(r"<h1[\s>]"),
        "canonical": fields["canonical"].isNotNull(),
        "lang": attribute("lang", lang),
        "dir": attribute("dir", direction),
        "locale_mark": F.coalesce(F.contains(low, F.concat(F.lit('data-locale="'), F.lower(locale), F.lit('"'))), F.lit(False)),
        "alternates": all_of([f'hreflang="{x}"' for x in alternates]),
        "structured_data": low.contains("application/ld+json"),
    }
    if dictionaries:
        rules["dictionaries"] = all_of(dictionaries)
    if theme:
        rules["theme"] = all_of(theme)
    for kind, words in (("free_of", terms), ("removed", removed)):
        for term in words:
            rules[f"{kind}_{term.replace(' ', '_')}"] = ~low.contains(term.lower())
    return {name: F.when(locale.isNotNull(), ok) if name in LOCALIZED else ok for name, ok in rules.items()}


def violations(rows: DataFrame, keys: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """A row (keys, rule) for every rule that a row fails: one wide pass, then an explode of what failed."""
    failed = F.filter(F.array(*(F.when(F.coalesce(~ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())), lambda x: x.isNotNull())
    return rows.select(*keys, F.explode(failed).alias("rule"))


def duplicates(rows: DataFrame, value: str, within: Sequence[str], key: str) -> DataFrame:
    """Later rows with a value that an earlier row of the same group holds, and that first holder.

    The first holder is a minimum, aggregated before the shuffle, so that a
    value which most rows share isn't ordered in one task.
    """
    held = rows.where(F.col(value).isNotNull())
    first = held.groupBy(*within, value).agg(F.min(key).alias("first_key"), F.count("*").alias("n_rows")).where("n_rows > 1")
    return held.join(first.drop("n_rows"), [*within, value]).where(F.col(key) > F.col("first_key")).select(*within, value, key, "first_key")


def count_checks(tables: Mapping[str, tuple[DataFrame, int, str]]) -> DataFrame:
    """``check``, ``expected``, ``found``, ``passed`` for (table, number, comparison: =, >= or <) by name."""
    out = None
    for name, (table, number, how) in tables.items():
        row = table.agg(F.count("*").alias("found")).select(F.lit(name).alias("check"), F.lit(number).cast("long").alias("expected"), "found")
        row = row.withColumn("passed", F.col("found") >= number if how == ">=" else F.col("found") < number if how == "<" else F.col("found") == number)
        out = row if out is None else out.unionByName(row)
    return out


def incomplete_translations(base: DataFrame, local: DataFrame, key: str, locales: Sequence[str]) -> DataFrame:
    """``locale``, ``n_missing``: keys of ``base`` that a locale's overlay lacks (keys are compared, not only counted)."""
    wanted = base.select(key).select(key, F.explode(F.array(*map(F.lit, locales))).alias("locale"))
    gaps = wanted.join(local.select("locale", key).distinct(), ["locale", key], "left_anti")
    return gaps.groupBy("locale").agg(F.count("*").alias("n_missing"))


def payload(files: DataFrame, size: str, by: Sequence[str], limit: int) -> DataFrame:
    """Files, bytes, megabytes to one decimal, and whether a limit is passed, by group."""
    sums = files.groupBy(*by).agg(F.count("*").alias("n_files"), F.sum(size).alias("n_bytes"))
    return sums.withColumn("megabytes", F.round(F.col("n_bytes") / 1e6, 1)).withColumn("over_limit", F.col("n_bytes") > limit)


def exit_code(failures: DataFrame) -> DataFrame:
    """One row: number of failures and 1 if there is any, else 0."""
    return failures.agg(F.count("*").alias("n_failures")).withColumn("exit_code", (F.col("n_failures") > 0).cast("int"))


def report(found: DataFrame, warnings: Sequence[str]) -> DataFrame:
    """One row: numbers of failures and of warnings (rules named so), and 1 if anything fails; warnings alone don't."""
    warns = F.col("rule").isin(*warnings)
    counts = found.agg(F.count_if(~warns).alias("n_failures"), F.count_if(warns).alias("n_warnings"))
    return counts.withColumn("exit_code", (F.col("n_failures") > 0).cast("int"))


def lint_rules(source: Column) -> dict[str, Column]:
    """Whether source text passes each check: no debugger statement, no secret in a literal, no evaluation of text."""
    text = F.coalesce(source, F.lit(""))
    # fixed values: the patterns of what is looked for
    patterns = {
        "debugger": r"\bdebugger\s*;",
        "secret": r"(?:RESEND_API_KEY|API_KEY|SECRET|TOKEN)\s*[:=]\s*[\"'][A-Za-z0-9_\-]{20,}[\"']",
        "eval": r"\beval\s*\(",
    }
    return {name: ~F.rlike(text, F.lit(pattern)) for name, pattern in patterns.items()}


def manifest_violations(manifest: DataFrame, outputs: DataFrame, locales: Mapping[str, int], forbidden: Sequence[str]) -> DataFrame:
    """``rule``, ``locale``, ``route`` for manifest rows whose output (column ``output``) is missing or whose route is forbidden, and for locales with a wrong number of rows."""
    missing = manifest.join(outputs.select("output"), "output", "left_anti").select(F.lit("output_missing").alias("rule"), "locale", "route")
    bad = None
    for prefix in forbidden:
        hit = (F.col("route") == prefix) | F.startswith("route", F.lit(prefix + "/"))
        bad = hit if bad is None else bad | hit
    barred = manifest.where(F.lit(False) if bad is None else bad).select(F.lit("route_forbidden").alias("rule"), "locale", "route")
    wanted = manifest.sparkSession.createDataFrame(list(locales.items()), "locale string, wanted long")
    counts = manifest.groupBy("locale").agg(F.count("*").alias("n"))
    wrong = wanted.join(counts, "locale", "left").where(F.coalesce("n", F.lit(0)) != F.col("wanted")).select(F.lit("row_count").alias("rule"), "locale", F.lit(None).cast("string").alias("route"))
    return missing.unionByName(barred).unionByName(wrong)


def item_rules(width: Column, height: Column) -> dict[str, Column]:
    """Whether a media item has sizes above zero."""
    return {"width": F.coalesce(width > 0, F.lit(False)), "height": F.coalesce(height > 0, F.lit(False))}


def without_file(items: DataFrame, path: str, files: DataFrame, file_path: str) -> DataFrame:
    """Items whose path no file has; a null path has none."""
    there = files.select(F.col(file_path).alias("__path")).distinct()
    return items.join(there, F.col(path) == F.col("__path"), "left_anti")


def missing_names(wanted: DataFrame, there: DataFrame, name: str) -> DataFrame:
    """Required names, such as assets, that a table lacks."""
    return wanted.select(name).join(there.select(name), name, "left_anti")


def present_names(barred: DataFrame, there: DataFrame, name: str) -> DataFrame:
    """Names, such as removed tables or keys, that are barred and yet there."""
    return barred.select(name).join(there.select(name), name, "left_semi")


def text_features(text: Column, patterns: Mapping[str, str]) -> dict[str, Column]:
    """Whether text, such as a style sheet, has what each pattern describes."""
    return {name: F.rlike(F.coalesce(text, F.lit("")), F.lit(pattern)) for name, pattern in patterns.items()}


def remaining_terms(files: DataFrame, path: str, text: str, terms: Sequence[str], endings: Sequence[str] = SEARCHED) -> DataFrame:
    """``path`` and ``term``: searched source files, by the ending of their name, that still hold a removed term."""
    searched = files.where(F.rlike(F.col(path), F.lit(rf"(?i)\.(?:{'|'.join(endings)})$")))
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    hits = F.filter(F.array(*(F.when(low.contains(t.lower()), F.lit(t)) for t in terms)), lambda x: x.isNotNull())
    return searched.select(F.col(path).alias("path"), F.explode(hits).alias("term"))
