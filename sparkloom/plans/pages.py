"""Page generation and scalar queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import pages as O
from ..operators import rules
from ..sources import sinks
from ..sources.session import shared_folder
from ..sources.tables import table

_SITE, _LOCALES = "https://www.example.org/", ["en", "ar"]


def _routes(spark, sf_dir: str) -> DataFrame:
    """A route for each part: the root, its brand, or its name below the brand."""
    key, brand, name = F.col("p_partkey"), S.slugify(F.col("p_brand")), S.slugify(F.concat_ws(" ", "p_name", "p_partkey"))
    route = F.when(key == 0, "/").when(key % 3 == 1, F.concat(F.lit("/"), brand)).otherwise(F.concat_ws("/", F.lit(""), brand, name))
    return table(spark, sf_dir, "part").select("p_partkey", route.alias("route"), F.concat_ws(" ", "p_brand", "p_name").alias("title"))


_ROUTES_SQL = """
SELECT p_partkey, CASE WHEN p_partkey = 0 THEN '/' WHEN p_partkey % 3 = 1 THEN '/' || brand ELSE '/' || brand || '/' || name END AS route, p_brand || ' ' || p_name AS title
FROM (SELECT *, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS brand, trim(regexp_replace(lower(p_name || ' ' || p_partkey), '[^a-z0-9]+', '-', 'g'), '-') AS name FROM part)
"""
_MATRIX_SQL = f"""
SELECT p_partkey, route, title, CAST(pos AS INTEGER) AS pos, locale, CAST(d AS INTEGER) AS depth, repeat('../', d + 1) AS base, 'https://www.example.org/' || p AS canonical,
       CASE d WHEN 0 THEN '1.0' WHEN 1 THEN '0.8' ELSE '0.7' END AS priority, CASE d WHEN 0 THEN 'weekly' ELSE 'monthly' END AS changefreq, p || 'index.html' AS output
FROM (SELECT *, CASE WHEN route = '/' THEN 0 ELSE length(route) - length(replace(route, '/', '')) END AS d, locale || '/' || CASE WHEN route = '/' THEN '' ELSE route[2:] || '/' END AS p
      FROM ({_ROUTES_SQL}), (VALUES (0, 'en'), (1, 'ar')) l(pos, locale))
"""


def page_matrix(spark, sf_dir: str) -> DataFrame:
    return O.page_matrix(_routes(spark, sf_dir), _SITE, _LOCALES)


def sitemap_entries(spark, sf_dir: str) -> DataFrame:
    pages = O.page_matrix(_routes(spark, sf_dir), _SITE, _LOCALES)
    links = {f"{x}-XX": S.canonical_url(_SITE, F.lit(x), F.col("route")) for x in _LOCALES}
    return pages.select("p_partkey", "locale", O.sitemap_entry(F.col("canonical"), links, F.col("changefreq"), F.col("priority")).alias("entry"))


SITEMAP_ENTRIES = f"""
SELECT p_partkey, locale, '<url><loc>' || canonical || '</loc><xhtml:link rel="alternate" hreflang="en-XX" href="' || replace(canonical, '.org/' || locale, '.org/en') ||
  '"/><xhtml:link rel="alternate" hreflang="ar-XX" href="' || replace(canonical, '.org/' || locale, '.org/ar') || '"/><changefreq>' || changefreq || '</changefreq><priority>' || priority || '</priority></url>' AS entry
FROM ({_MATRIX_SQL})
"""


def page_manifest(spark, sf_dir: str) -> DataFrame:
    pages = O.page_matrix(_routes(spark, sf_dir), _SITE, _LOCALES)
    return O.manifest(pages.withColumn("description", F.repeat(F.concat("title", F.lit("  and ")), 12)).withColumn("hero", F.col("p_partkey") + 1))


PAGE_MANIFEST = rf"""
SELECT locale, route, title, CASE WHEN length(flat) <= 160 THEN flat ELSE regexp_replace(flat[1:157], '\s+\S*$', '') || '…' END AS description, p_partkey + 1 AS hero, output
FROM (SELECT *, trim(regexp_replace(repeat(title || '  and ', 12), '\s+', ' ', 'g')) AS flat FROM ({_MATRIX_SQL}))
"""


def structured_data(spark, sf_dir: str) -> DataFrame:
    pages = O.page_matrix(_routes(spark, sf_dir), _SITE, _LOCALES)
    return pages.select("p_partkey", "locale", O.structured_data(F.col("canonical"), F.concat(F.lit("<b>"), "title"), F.col("title"), F.col("locale")).alias("json_ld"))


STRUCTURED_DATA = rf"""
SELECT p_partkey, locale, '{{"@context":"https://schema.org","@type":"WebPage","@id":"' || canonical || '#webpage","url":"' || canonical || '","name":"\u003cb>' || title || '","description":"' || title || '","inLanguage":"' || locale || '"}}' AS json_ld
FROM ({_MATRIX_SQL})
"""


def rendered_pages(spark, sf_dir: str) -> DataFrame:
    pages = O.page_matrix(_routes(spark, sf_dir), _SITE, _LOCALES)
    template = '<html lang="{{LANG}}"><base href="{{BASE}}"><title>{{TITLE}}</title><link rel="canonical" href="{{CANONICAL}}">'
    values = {"TITLE": F.concat(F.col("title"), F.lit(" {{LANG}}")), "BASE": F.col("base"), "CANONICAL": F.col("canonical"), "LANG": F.col("locale")}
    return O.rendered(pages, template, values).select("p_partkey", "locale", "html")


RENDERED_PAGES = f"""
SELECT p_partkey, locale, '<html lang="' || locale || '"><base href="' || base || '"><title>' || title || ' ' || locale || '</title><link rel="canonical" href="' || canonical || '">' AS html FROM ({_MATRIX_SQL})
"""


def breadcrumbs(spark, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", "^[^:]+://[^/?#]*([^?#]*)", 1)
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/"), F.array_join(S.segments(path), "/")).alias("route"))
    steps = O.breadcrumbs(F.col("route"), F.concat(F.col("route"), F.lit(" | site")), "Home", {"en": "English", "fr": "French"})
    return pages.select("page_id", F.explode(steps).alias("s")).select("page_id", "s.position", "s.name", "s.path")


BREADCRUMBS = r"""
WITH p AS (
  SELECT page_id, list_filter(string_split(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS s FROM pages
), steps AS (
  SELECT page_id, s, unnest(range(1, len(s) + 1)) AS i FROM p
)
SELECT page_id, 1 AS position, 'Home' AS name, '/' AS path FROM p
UNION ALL
SELECT page_id, CAST(i + 1 AS INTEGER), CASE WHEN i = len(s) THEN '/' || array_to_string(s, '/') ELSE CASE s[i] WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' ELSE replace(s[i], '-', ' ') END END, '/' || array_to_string(s[1:i], '/') FROM steps
"""


def trim_description(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.trim_description(F.col("text")).alias("description"))


TRIM_DESCRIPTION = r"""
SELECT doc_id, CASE WHEN length(flat) <= 160 THEN flat ELSE regexp_replace(flat[1:157], '\s+\S*$', '') || '…' END AS description
FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM documents)
"""


def part_scalars(spark, sf_dir: str) -> DataFrame:
    name = F.concat_ws(" & ", "p_name", "p_brand")
    across, down = S.sprite_offsets(F.col("p_size"))
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        "p_partkey", S.slugify(name).alias("slug"), S.initials(F.col("p_name")).alias("initials"), S.encode_component(name).alias("encoded"),
        S.normalize_route(F.concat(F.lit("#/parts/"), "p_name", F.lit("/?q=1"))).alias("route"), S.title_base(F.concat_ws(" | ", "p_name", "p_type")).alias("title"),
        S.is_email(F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.when(key % 3 == 0, "@example.org\n").when(key % 3 == 1, "@example.org").otherwise("@example"))).alias("is_email"),
        S.is_year(F.concat(key.cast("string"), F.when(key % 2 == 0, "\n").otherwise(""))).alias("is_year"),
        S.is_active(F.concat(F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("/"))), F.concat(F.lit("/"), F.substring("p_name", 1, 3))).alias("is_active"), S.padded_ordinal(F.col("p_partkey") + 1).alias("ordinal"), across.alias("across"), down.alias("down"),
    )


PART_SCALARS = r"""
SELECT p_partkey, trim(regexp_replace(lower(p_name || ' & ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug, upper(replace(p_name, ' ', '')[1:2]) AS initials,
       replace(replace(replace(p_name || ' & ' || p_brand, '&', '%26'), '#', '%23'), ' ', '%20') AS encoded, '/parts/' || p_name AS route, p_name AS title, p_partkey % 3 = 1 AS is_email,
       p_partkey BETWEEN 1000 AND 9999 AND p_partkey % 2 = 1 AS is_year, p_name[4:4] IN ('', ' ') AS is_active, CASE WHEN p_partkey < 9 THEN '0' ELSE '' END || (p_partkey + 1) AS ordinal,
       round((p_size - 1) % 5 / 4.0 * 100, 4) AS across, round(floor((p_size - 1) / 5.0) / 9.0 * 100, 4) AS down
FROM part
"""


def text_scalars(spark, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", S.escape_markup(F.concat(F.lit("<a href='x'>\"&"), text)).alias("escaped"), S.clean_text(F.concat(F.lit(" \x01\t"), text, F.lit("\n "))).alias("cleaned"))


TEXT_SCALARS = r"""
SELECT doc_id, replace(replace(replace(replace(replace('<a href=''x''>"&' || text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped,
       regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '^\s+|\s+$', '', 'g')[1:3000] AS cleaned
FROM documents
"""


def status_class(spark, sf_dir: str) -> DataFrame:
    cases = [("green", ["urgent"]), ("amber", ["High", "MEDIUM"]), ("blue", ["low", "urgent"])]
    labels = {"1-URGENT": "Now", "5-LOW": "Later", "3-MEDIUM": ""}
    return table(spark, sf_dir, "orders").select("o_orderkey", S.first_match(F.col("o_orderpriority"), cases).alias("class"), S.label(F.col("o_orderpriority"), labels).alias("label"))


STATUS_CLASS = """
SELECT o_orderkey, CASE WHEN contains(lower(o_orderpriority), 'urgent') THEN 'green' WHEN contains(lower(o_orderpriority), 'high') OR contains(lower(o_orderpriority), 'medium') THEN 'amber'
       WHEN contains(lower(o_orderpriority), 'low') THEN 'blue' ELSE '' END AS class, CASE o_orderpriority WHEN '1-URGENT' THEN 'Now' WHEN '5-LOW' THEN 'Later' ELSE o_orderpriority END AS label
FROM orders
"""


def page_graphs(spark, sf_dir: str) -> DataFrame:
    pages = O.page_matrix(_routes(spark, sf_dir), _SITE, _LOCALES)
    crumbs = O.breadcrumbs(F.col("route"), F.col("title"), "Home", {"brand-2": "Second brand"})
    business = F.struct(F.array(F.lit("AutomotiveBusiness"), F.lit("LocalBusiness")).alias("@type"), F.lit(f"{_SITE}#business").alias("@id"), F.col("locale").alias("inLanguage"))
    own = F.when(F.col("p_partkey") % 2 == 0, F.array(F.to_json(F.struct(F.lit("Product").alias("@type"), F.col("p_partkey").alias("sku")))))
    image = F.concat(F.lit(f"{_SITE}assets/"), "p_partkey", F.lit(".webp"))
    graph = O.page_graph(F.col("route"), F.col("locale"), F.concat(F.col("title"), F.lit(" <b>")), F.col("title"), F.col("locale"), image, _SITE, crumbs, own, business)
    return pages.select("p_partkey", "locale", graph.alias("json_ld"))


PAGE_GRAPHS = rf"""
WITH m AS (SELECT *, list_filter(string_split(route, '/'), lambda x: x <> '') AS s FROM ({_MATRIX_SQL})), u AS (SELECT *, '{_SITE}' || locale || '/' AS home FROM m)
SELECT p_partkey, locale, replace('{{"@context":"https://schema.org","@graph":[' ||
  '{{"@type":"WebPage","@id":"' || canonical || '#webpage","url":"' || canonical || '","name":"' || title || ' <b>","description":"' || title || '","inLanguage":"' || locale ||
  '","isPartOf":{{"@id":"{_SITE}#website"}},"about":{{"@id":"{_SITE}#business"}},"primaryImageOfPage":{{"@type":"ImageObject","url":"{_SITE}assets/' || p_partkey || '.webp"}}}}' ||
  CASE WHEN route = '/' THEN '' ELSE ',{{"@type":"BreadcrumbList","itemListElement":[{{"@type":"ListItem","position":1,"name":"Home","item":"' || home || '"}}' ||
    CASE WHEN len(s) = 2 THEN ',{{"@type":"ListItem","position":2,"name":"' || CASE s[1] WHEN 'brand-2' THEN 'Second brand' ELSE replace(s[1], '-', ' ') END || '","item":"' || home || s[1] || '/"}}' ELSE '' END ||
    ',{{"@type":"ListItem","position":' || (len(s) + 1) || ',"name":"' || title || '","item":"' || canonical || '"}}]}}' END ||
  CASE WHEN p_partkey % 2 = 0 THEN ',{{"@type":"Product","sku":' || p_partkey || '}}' ELSE '' END ||
  CASE WHEN route = '/' THEN '' ELSE ',{{"@type":["AutomotiveBusiness","LocalBusiness"],"@id":"{_SITE}#business","inLanguage":"' || locale || '"}}' END || ']}}', '<', '\u003c') AS json_ld
FROM u
"""


def localized_urls(spark, sf_dir: str) -> DataFrame:
    route = F.regexp_extract("url", "^[^:]+://[^/?#]*([^#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", S.localized_url(F.lit("ar"), route).alias("localized"))


LOCALIZED_URLS = r"""
SELECT page_id, 'ar/' || CASE WHEN trim(p, '/') = '' THEN '' ELSE trim(p, '/') || '/' END || regexp_extract(url, '^[^:]+://[^/?#]*[^?#]*([^#]*)', 1) AS localized
FROM (SELECT page_id, url, regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) AS p FROM pages)
"""


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written_pages(spark, sf_dir: str) -> DataFrame:
    """The rendered pages, written by locale and read back."""
    folder = _folder(spark, "pages")
    sinks.write_pages(rendered_pages(spark, sf_dir), folder)
    return spark.read.parquet(folder).select("p_partkey", "locale", "html")


def written_manifest(spark, sf_dir: str) -> DataFrame:
    """The manifest, written as lines of JSON and read back."""
    folder, rows = _folder(spark, "manifest"), page_manifest(spark, sf_dir)
    sinks.write_manifest(rows, folder)
    return spark.read.schema(rows.schema).json(folder)


def written_sitemap(spark, sf_dir: str) -> DataFrame:
    """The elements of all sitemap files, and how many files hold a copy of each."""
    folder = _folder(spark, "sitemap")
    pages = sitemap_entries(spark, sf_dir).withColumn("pos", F.col("p_partkey") * 2 + (F.col("locale") == "ar").cast("int"))
    sinks.write_sitemap(pages, folder)
    lines = spark.read.text(folder).where(F.startswith("value", F.lit("<url>")))
    return lines.groupBy(F.col("value").alias("entry")).agg(F.count("*").alias("n"))


WRITTEN_SITEMAP = f"SELECT entry, count(*) AS n FROM ({SITEMAP_ENTRIES}) GROUP BY entry"


def manifest_check(spark, sf_dir: str) -> DataFrame:
    pages = O.page_matrix(_routes(spark, sf_dir), _SITE, _LOCALES)
    there = pages.where("p_partkey % 5 <> 2")
    return rules.manifest_violations(pages, there, {"en": 2000, "ar": 24, "fr": 1}, ["/brand-2", "/brand-17/red-widget-1"])


MANIFEST_CHECK = f"""
WITH m AS ({_MATRIX_SQL})
SELECT 'output_missing' AS rule, locale, route FROM m WHERE output NOT IN (SELECT output FROM m WHERE p_partkey % 5 <> 2)
UNION ALL SELECT 'route_forbidden', locale, route FROM m WHERE route IN ('/brand-2', '/brand-17/red-widget-1') OR starts_with(route, '/brand-2/') OR starts_with(route, '/brand-17/red-widget-1/')
UNION ALL SELECT 'row_count', w.locale, NULL FROM (VALUES ('en', 2000), ('ar', 24), ('fr', 1)) w(locale, n) WHERE n <> (SELECT count(*) FROM m WHERE m.locale = w.locale)
"""

QUERIES = {
    "manifest_check": (manifest_check, MANIFEST_CHECK),
    "page_matrix": (page_matrix, _MATRIX_SQL),
    "sitemap_entries": (sitemap_entries, SITEMAP_ENTRIES),
    "page_manifest": (page_manifest, PAGE_MANIFEST),
    "structured_data": (structured_data, STRUCTURED_DATA),
    "rendered_pages": (rendered_pages, RENDERED_PAGES),
    "page_graphs": (page_graphs, PAGE_GRAPHS),
    "localized_urls": (localized_urls, LOCALIZED_URLS),
    "written_pages": (written_pages, RENDERED_PAGES),
    "written_manifest": (written_manifest, PAGE_MANIFEST),
    "written_sitemap": (written_sitemap, WRITTEN_SITEMAP),
    "breadcrumbs": (breadcrumbs, BREADCRUMBS),
    "trim_description": (trim_description, TRIM_DESCRIPTION),
    "part_scalars": (part_scalars, PART_SCALARS),
    "text_scalars": (text_scalars, TEXT_SCALARS),
    "status_class": (status_class, STATUS_CLASS),
}
