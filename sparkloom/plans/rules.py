"""Validation queries over raw pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rules as O
from ..sources.tables import table

_LANG = {"en": "en", "fr": "fr", "de": "de", "es": "es"}
_DIR = dict.fromkeys(_LANG, "ltr")


def _pages(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def _locale():
    path = F.regexp_extract("url", "^[^:]+://[^/?#]*([^?#]*)", 1)
    return O.locale_of(path, list(_LANG))


_FIELDS_SQL = r"""
SELECT page_id, nullif(regexp_extract(url, '^[^:]+://[^/?#]*/(en|fr|de|es)/', 1), '') AS locale, html,
       nullif(trim(regexp_extract(html, '(?i)<title>([^<]+)</title>', 1)), '') AS title,
       nullif(trim(regexp_extract(html, '(?i)<meta name="description" content="([^"]*)"', 1)), '') AS description,
       nullif(trim(regexp_extract(html, '(?i)<link rel="canonical" href="([^"]+)"', 1)), '') AS canonical,
       nullif(trim(regexp_extract(html, '(?i)<html[^>]* lang="([^"]+)"', 1)), '') AS lang,
       nullif(trim(regexp_extract(html, '(?i)<h1[^>]*>([^<]+)</h1>', 1)), '') AS heading
FROM pages
"""


def html_meta(spark, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", _locale().alias("locale"), *(c.alias(n) for n, c in O.page_fields(F.col("html")).items()))


HTML_META = f"SELECT page_id, locale, title, description, canonical, lang, heading FROM ({_FIELDS_SQL})"


def html_violations(spark, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    rules = O.page_rules(F.col("html"), _locale(), ("lorem ipsum", "Licht"), _LANG, _DIR, removed=("Menti",), alternates=("en", "x-default"), dictionaries=("<script", "track(0"), theme=("var t", "<style"))
    return O.violations(pages, ["page_id"], rules)


HTML_VIOLATIONS = rf"""
WITH f AS ({_FIELDS_SQL}), r AS (
  SELECT page_id, unnest([
    CASE WHEN title IS NULL THEN 'title' END,
    CASE WHEN coalesce(length(description), 0) NOT BETWEEN 35 AND 165 THEN 'description_length' END,
    CASE WHEN NOT regexp_matches(html, '(?i)<h1[\s>]') THEN 'heading' END,
    CASE WHEN locale IS NOT NULL AND canonical IS NULL THEN 'canonical' END,
    CASE WHEN locale IS NOT NULL AND NOT CASE locale WHEN 'en' THEN regexp_matches(html, '(?i)<html[^>]+lang="en"') WHEN 'fr' THEN regexp_matches(html, '(?i)<html[^>]+lang="fr"')
                                          WHEN 'de' THEN regexp_matches(html, '(?i)<html[^>]+lang="de"') ELSE regexp_matches(html, '(?i)<html[^>]+lang="es"') END THEN 'lang' END,
    CASE WHEN locale IS NOT NULL AND NOT regexp_matches(html, '(?i)<html[^>]+dir="ltr"') THEN 'dir' END,
    CASE WHEN locale IS NOT NULL AND NOT contains(lower(html), 'data-locale="' || locale || '"') THEN 'locale_mark' END,
    CASE WHEN locale IS NOT NULL AND NOT (contains(lower(html), 'hreflang="en"') AND contains(lower(html), 'hreflang="x-default"')) THEN 'alternates' END,
    CASE WHEN locale IS NOT NULL AND NOT (contains(lower(html), '<script') AND contains(lower(html), 'track(0')) THEN 'dictionaries' END,
    CASE WHEN locale IS NOT NULL AND NOT (contains(lower(html), 'var t') AND contains(lower(html), '<style')) THEN 'theme' END,
    CASE WHEN contains(lower(html), 'menti') THEN 'removed_Menti' END,
    CASE WHEN locale IS NOT NULL AND NOT contains(lower(html), 'application/ld+json') THEN 'structured_data' END,
    CASE WHEN contains(lower(html), 'lorem ipsum') THEN 'free_of_lorem_ipsum' END,
    CASE WHEN contains(lower(html), 'licht') THEN 'free_of_Licht' END]) AS rule FROM f)
SELECT page_id, rule FROM r WHERE rule IS NOT NULL
"""


def duplicate_titles(spark, sf_dir: str) -> DataFrame:
    fields = O.page_fields(F.col("html"))
    rows = _pages(spark, sf_dir).select("page_id", fields["lang"].alias("lang"), fields["title"].alias("title"))
    return O.duplicates(rows, "title", ["lang"], "page_id")


DUPLICATE_TITLES = f"""
SELECT lang, title, page_id, first_key FROM (SELECT lang, title, page_id, min(page_id) OVER (PARTITION BY lang, title) AS first_key FROM ({_FIELDS_SQL}) WHERE title IS NOT NULL) WHERE page_id > first_key
"""


def failure_summary(spark, sf_dir: str) -> DataFrame:
    return O.exit_code(html_violations(spark, sf_dir))


FAILURE_SUMMARY = f"SELECT count(*) AS n_failures, CAST(count(*) > 0 AS INTEGER) AS exit_code FROM ({HTML_VIOLATIONS})"


def payload_sum(spark, sf_dir: str) -> DataFrame:
    return O.payload(table(spark, sf_dir, "documents").select("source", "n_chars"), "n_chars", ["source"], 80_000)


PAYLOAD_SUM = """
SELECT source, count(*) AS n_files, CAST(sum(n_chars) AS BIGINT) AS n_bytes, round(sum(n_chars) / 1e6, 1) AS megabytes, sum(n_chars) > 80000 AS over_limit FROM documents GROUP BY source
"""

def lint_violations(spark, sf_dir: str) -> DataFrame:
    text = F.regexp_replace(F.replace(F.replace("html", F.lit("var t="), F.lit("TOKEN = ")), F.lit("<p>"), F.lit("debugger ;")), r"track\(", "eval (")
    return O.violations(_pages(spark, sf_dir), ["page_id"], O.lint_rules(text))


LINT_VIOLATIONS = r"""
SELECT page_id, unnest(list_filter([CASE WHEN regexp_matches(t, '\bdebugger\s*;') THEN 'debugger' END, CASE WHEN regexp_matches(t, '(?:RESEND_API_KEY|API_KEY|SECRET|TOKEN)\s*[:=]\s*["''][A-Za-z0-9_\-]{20,}["'']') THEN 'secret' END,
       CASE WHEN regexp_matches(t, '\beval\s*\(') THEN 'eval' END], lambda x: x IS NOT NULL)) AS rule
FROM (SELECT page_id, replace(replace(replace(html, 'var t=', 'TOKEN = '), '<p>', 'debugger ;'), 'track(', 'eval (') AS t FROM pages)
"""


def _path():
    return F.regexp_replace(F.regexp_extract("url", "^[^:]+://[^/?#]*([^?#]*)", 1), "^$", "/")


def duplicate_canonicals(spark, sf_dir: str) -> DataFrame:
    """The url's host and first folder stand for the canonical one, so that pages of a folder collide."""
    rows = _pages(spark, sf_dir).select("page_id", F.nullif(F.regexp_extract("url", "^[^:]+://([^/?#]*/[^/?#]*)", 1), F.lit("")).alias("canonical"))
    return O.duplicates(rows, "canonical", [], "page_id")


DUPLICATE_CANONICALS = """
WITH c AS (SELECT page_id, nullif(regexp_extract(url, '^[^:]+://([^/?#]*/[^/?#]*)', 1), '') AS canonical FROM pages)
SELECT canonical, page_id, first_key FROM (SELECT *, min(page_id) OVER (PARTITION BY canonical) AS first_key FROM c WHERE canonical IS NOT NULL) WHERE page_id > first_key
"""


def violation_report(spark, sf_dir: str) -> DataFrame:
    return O.report(html_violations(spark, sf_dir), ("canonical", "alternates"))


VIOLATION_REPORT = f"""
SELECT count_if(rule NOT IN ('canonical', 'alternates')) AS n_failures, count_if(rule IN ('canonical', 'alternates')) AS n_warnings, CAST(count_if(rule NOT IN ('canonical', 'alternates')) > 0 AS INTEGER) AS exit_code FROM ({HTML_VIOLATIONS})
"""


def orders_without_file(spark, sf_dir: str) -> DataFrame:
    """Orders are the items; the lines that were shipped are the files there are."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("order/"), "o_orderkey").alias("full"))
    files = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select(F.concat(F.lit("order/"), "l_orderkey").alias("path"))
    return O.without_file(orders, "full", files, "path")


ORDERS_WITHOUT_FILE = "SELECT o_orderkey, 'order/' || o_orderkey AS \"full\" FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')"


def required_and_barred(spark, sf_dir: str) -> DataFrame:
    """Customers' names are required of suppliers, and types of parts barred from names."""
    name = lambda t, c, cut: table(spark, sf_dir, t).select(F.regexp_replace(c, "^[A-Za-z]+#?", cut).alias("name"))
    customers, suppliers = name("customer", "c_name", "n"), name("supplier", "s_name", "n")
    lacking = O.missing_names(customers, suppliers, "name").select(F.lit("required").alias("rule"), "name")
    return lacking.union(O.present_names(suppliers, customers, "name").select(F.lit("barred"), "name"))


REQUIRED_AND_BARRED = r"""
WITH c AS (SELECT regexp_replace(c_name, '^[A-Za-z]+#?', 'n') AS name FROM customer), s AS (SELECT regexp_replace(s_name, '^[A-Za-z]+#?', 'n') AS name FROM supplier)
SELECT 'required' AS rule, name FROM c WHERE name NOT IN (SELECT name FROM s) UNION ALL SELECT 'barred', name FROM s WHERE name IN (SELECT name FROM c)
"""


def page_features(spark, sf_dir: str) -> DataFrame:
    rules = O.text_features(F.col("html"), {"dark": r'html\[dir="rtl"\]', "style": r"<style>p\{", "viewport": "viewport-fit=cover", "list": r"<li><a href=\"/[A-Z]"})
    return O.violations(_pages(spark, sf_dir), ["page_id"], rules)


PAGE_FEATURES = r"""
SELECT page_id, unnest(list_filter([CASE WHEN NOT regexp_matches(html, 'html\[dir="rtl"\]') THEN 'dark' END, CASE WHEN NOT regexp_matches(html, '<style>p\{') THEN 'style' END,
       CASE WHEN NOT contains(html, 'viewport-fit=cover') THEN 'viewport' END, CASE WHEN NOT regexp_matches(html, '<li><a href="/[A-Z]') THEN 'list' END], lambda x: x IS NOT NULL)) AS rule FROM pages
"""


def removed_terms(spark, sf_dir: str) -> DataFrame:
    """Pages as source files, named by their number and a language's ending."""
    files = _pages(spark, sf_dir).select(F.concat(F.lit("p"), "page_id", F.element_at(F.array(*map(F.lit, (".html", ".JS", ".png"))), (F.col("page_id") % 3 + 1).cast("int"))).alias("file"), "html")
    return O.remaining_terms(files, "file", "html", ("Licht", "menti", "no such term"))


REMOVED_TERMS = """
WITH f AS (SELECT 'p' || page_id || ['.html', '.JS', '.png'][page_id % 3 + 1] AS path, lower(html) AS t FROM pages WHERE page_id % 3 < 2)
SELECT path, 'Licht' AS term FROM f WHERE contains(t, 'licht') UNION ALL SELECT path, 'menti' FROM f WHERE contains(t, 'menti')
"""


def file_counts(spark, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    return O.count_checks({"few_pages": (pages, O.MOST_FILES, "<"), "some_pages": (pages, 10, ">="), "no_removed_host": (pages.where(F.contains("url", F.lit("example.invalid"))), 0, "=")})


FILE_COUNTS = """
SELECT 'few_pages' AS "check", CAST(100 AS BIGINT) AS expected, count(*) AS found, count(*) < 100 AS passed FROM pages UNION ALL SELECT 'some_pages', 10, count(*), count(*) >= 10 FROM pages
UNION ALL SELECT 'no_removed_host', 0, count(*), count(*) = 0 FROM pages WHERE contains(url, 'example.invalid')
"""


def item_sizes(spark, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return O.violations(part, ["p_partkey"], O.item_rules(F.col("p_size") - 5, F.col("p_retailprice")))


ITEM_SIZES = "SELECT p_partkey, 'width' AS rule FROM part WHERE NOT coalesce(p_size - 5 > 0, false) UNION ALL SELECT p_partkey, 'height' FROM part WHERE NOT coalesce(p_retailprice > 0, false)"


QUERIES = {
    "duplicate_canonicals": (duplicate_canonicals, DUPLICATE_CANONICALS),
    "violation_report": (violation_report, VIOLATION_REPORT),
    "orders_without_file": (orders_without_file, ORDERS_WITHOUT_FILE),
    "required_and_barred": (required_and_barred, REQUIRED_AND_BARRED),
    "page_features": (page_features, PAGE_FEATURES),
    "removed_terms": (removed_terms, REMOVED_TERMS),
    "file_counts": (file_counts, FILE_COUNTS),
    "lint_violations": (lint_violations, LINT_VIOLATIONS),
    "item_sizes": (item_sizes, ITEM_SIZES),
    "html_meta": (html_meta, HTML_META),
    "html_violations": (html_violations, HTML_VIOLATIONS),
    "duplicate_titles": (duplicate_titles, DUPLICATE_TITLES),
    "failure_summary": (failure_summary, FAILURE_SUMMARY),
    "payload_sum": (payload_sum, PAYLOAD_SUM),
}
