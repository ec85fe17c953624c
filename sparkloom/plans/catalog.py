"""Catalog queries: overlays, lookups, ordered lists, bridges and rings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import item_href
from ..operators import catalog as O
from ..operators import rules, sequences
from ..sources.tables import table


def overlay_labels(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.lit(-1).alias("quality"))
    return O.overlay(docs, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id")


OVERLAY_LABELS = """
SELECT d.doc_id, lang, source, coalesce(l.quality, -1) AS quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""


def positional_overlay(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    base = turns.where("conv_id % 2 = 0").select((F.col("conv_id") / 2).cast("long").alias("pair"), "turn", "role", F.length("text").cast("long").alias("size"))
    local = turns.where("conv_id % 2 = 1").select(((F.col("conv_id") - 1) / 2).cast("long").alias("pair"), "turn", F.length("text").cast("long").alias("size"))
    return O.overlay(base, local, ["pair", "turn"])


POSITIONAL_OVERLAY = """
SELECT a.conv_id // 2 AS pair, a.turn, a.role, CAST(coalesce(length(b.text), length(a.text)) AS BIGINT) AS size
FROM (SELECT * FROM conversations WHERE conv_id % 2 = 0) a LEFT JOIN (SELECT * FROM conversations WHERE conv_id % 2 = 1) b ON a.conv_id // 2 = b.conv_id // 2 AND a.turn = b.turn
"""


def code_labels(spark, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    labels = part.where("p_type <> 'PROMO'").select(F.col("p_type").alias("code")).distinct().withColumn("label", F.initcap("code"))
    return O.with_label(part.select("p_partkey", "p_type", "p_size"), "p_type", labels, "type_label", F.when(F.col("p_size") > 45, "Oversize"))


CODE_LABELS = """
SELECT p_partkey, p_type, p_size, CASE WHEN p_size > 45 THEN 'Oversize' WHEN p_type = 'PROMO' THEN p_type ELSE upper(p_type[1]) || lower(p_type[2:]) END AS type_label FROM part
"""


def fk_default_first(spark, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    parts = table(spark, sf_dir, "part").where("p_size > 25")
    return O.looked_up(lines, "l_partkey", parts, "p_partkey", ["p_name", "p_brand"], order="p_partkey")


FK_DEFAULT_FIRST = """
WITH parts AS (SELECT * FROM part WHERE p_size > 25), f AS (SELECT p_name AS n, p_brand AS b FROM parts ORDER BY p_partkey LIMIT 1)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN p_partkey IS NULL THEN n ELSE p_name END AS p_name, CASE WHEN p_partkey IS NULL THEN b ELSE p_brand END AS p_brand
FROM lineitem LEFT JOIN parts ON l_partkey = p_partkey, f
"""


def fk_or_null(spark, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return O.looked_up(orders, "o_custkey", table(spark, sf_dir, "customer").where("c_acctbal > 0"), "c_custkey", ["c_name", "c_mktsegment"])


FK_OR_NULL = "SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey"


def orders_without_lines(spark, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return O.missing(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), lines, ["o_orderkey"])


ORDERS_WITHOUT_LINES = "SELECT o_orderkey, o_totalprice FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"


def orders_with_lines(spark, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").join(lines, "o_orderkey", "left_semi")


ORDERS_WITH_LINES = "SELECT o_orderkey, o_orderpriority FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)"


def gallery_present(spark, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("parts"))
    return O.present(lines, "parts", table(spark, sf_dir, "part").where("p_size <= 10"), "p_partkey").select("l_orderkey", "pos", "element")


GALLERY_PRESENT = """
WITH numbered AS (
  SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS INTEGER) AS pos, l_partkey AS element FROM lineitem
)
SELECT * FROM numbered WHERE element IN (SELECT p_partkey FROM part WHERE p_size <= 10)
"""


def named_in_order(spark, sf_dir: str) -> DataFrame:
    names = ["Customer#000000007", "Customer#000000003", "nobody", "Customer#000000012"]
    return O.in_given_order(names, table(spark, sf_dir, "customer"), "c_name").select("pos", "c_name", "c_custkey")


NAMED_IN_ORDER = "SELECT pos, c_name, c_custkey FROM customer JOIN (VALUES (CAST(0 AS BIGINT), 'Customer#000000007'), (1, 'Customer#000000003'), (2, 'nobody'), (3, 'Customer#000000012')) w(pos, name) ON c_name = name"


def bridge_top(spark, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    supplied = lines.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    totals = supplied.groupBy(F.col("s_nationkey").alias("n_nationkey"), F.col("l_partkey").alias("p_partkey")).agg(F.sum("q").alias("q"))
    rank = F.row_number().over(Window.partitionBy("n_nationkey").orderBy(F.desc("q"), "p_partkey"))
    bridge = totals.withColumn("pos", rank).where("pos <= 3")
    nations, parts = table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return O.bridged(nations, bridge, parts, "n_nationkey", "p_partkey").select("n_name", "pos", "p_partkey", "p_name")


BRIDGE_TOP = """
WITH totals AS (
  SELECT s_nationkey, l_partkey, sum(l_quantity) AS q FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey, l_partkey
), bridge AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY q DESC, l_partkey) AS INTEGER) AS pos FROM totals
)
SELECT n_name, pos, p_partkey, p_name FROM nation JOIN bridge ON n_nationkey = s_nationkey JOIN part ON l_partkey = p_partkey WHERE pos <= 3
"""


def dependent_options(spark, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "part").select("p_type", "p_brand", "p_name").distinct()
    lists = pairs.groupBy("p_type", "p_brand").agg(F.array_sort(F.collect_list("p_name")).alias("names"))
    platforms = lists.groupBy("p_type").agg(F.map_from_entries(F.collect_list(F.struct("p_brand", "names"))).alias("models"))
    return O.dependent_options(platforms, "p_type", "models", "Brand#4")


DEPENDENT_OPTIONS = """
SELECT p_type, CAST(row_number() OVER (PARTITION BY p_type ORDER BY p_name) - 1 AS INTEGER) AS pos, p_name AS option
FROM (SELECT DISTINCT p_type, p_name FROM part WHERE p_brand = 'Brand#4')
"""


def ring_nav(spark, sf_dir: str) -> DataFrame:
    return sequences.ring(table(spark, sf_dir, "part"), ["p_brand"], "p_partkey")


RING_NAV = """
SELECT p_brand, p_partkey, CAST(i AS INTEGER) AS position, n AS n_items, CASE WHEN i < 10 THEN '0' || i ELSE CAST(i AS VARCHAR) END AS ordinal, i || ' / ' || n AS position_label,
       coalesce(nx, f) AS next_key, coalesce(pv, l) AS previous_key
FROM (
  SELECT p_brand, p_partkey, row_number() OVER w AS i, count(*) OVER (PARTITION BY p_brand) AS n, lead(p_partkey) OVER w AS nx, lag(p_partkey) OVER w AS pv,
         min(p_partkey) OVER (PARTITION BY p_brand) AS f, max(p_partkey) OVER (PARTITION BY p_brand) AS l
  FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)
)
"""


def agg_strings(spark, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_returnflag")
    rows = orders.join(lines, "o_orderkey").withColumn("k", F.struct("l_linenumber", "l_partkey"))
    return sequences.joined_in_order(rows, ["o_orderkey"], "k", F.concat_ws(":", F.col("l_partkey").cast("string"), "l_returnflag"), ", ", "parts")


AGG_STRINGS = """
SELECT o_orderkey, string_agg(l_partkey || ':' || l_returnflag, ', ' ORDER BY l_linenumber, l_partkey, l_returnflag) AS parts
FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY o_orderkey
"""


def table_counts(spark, sf_dir: str) -> DataFrame:
    named = {"regions": ("region", 5, "="), "nations": ("nation", 25, "="), "parts": ("part", 200, ">="), "orders": ("orders", 1_000_000_000, ">=")}
    return rules.count_checks({name: (table(spark, sf_dir, t), n, how) for name, (t, n, how) in named.items()})


TABLE_COUNTS = """
SELECT "check", CAST(expected AS BIGINT) AS expected, found, CASE WHEN how = '=' THEN found = expected ELSE found >= expected END AS passed FROM (
  SELECT 'regions' AS "check", 5 AS expected, count(*) AS found, '=' AS how FROM region UNION ALL SELECT 'nations', 25, count(*), '=' FROM nation
  UNION ALL SELECT 'parts', 200, count(*), '>=' FROM part UNION ALL SELECT 'orders', 1000000000, count(*), '>=' FROM orders)
"""


def translation_gaps(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    local = table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", F.col("lang").alias("locale"))
    return rules.incomplete_translations(docs, local, "doc_id", ["en", "fr", "de", "es"])


TRANSLATION_GAPS = """
SELECT locale, count(*) AS n_missing FROM documents d, (VALUES ('en'), ('fr'), ('de'), ('es')) l(locale)
WHERE NOT EXISTS (SELECT 1 FROM labels x WHERE x.doc_id = d.doc_id AND d.lang = locale) GROUP BY locale
"""


def first_matches(spark, sf_dir: str) -> DataFrame:
    return O.first_match(table(spark, sf_dir, "orders"), ["o_custkey"], F.col("o_orderstatus") == "F", "o_orderkey")


FIRST_MATCHES = "SELECT o_custkey, min(o_orderkey) FILTER (o_orderstatus = 'F') AS o_orderkey FROM orders GROUP BY o_custkey"


def concatenated_lists(spark, sf_dir: str) -> DataFrame:
    customers = O.all_but(table(spark, sf_dir, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY"]).select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    return O.concatenated(customers, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name")))


CONCATENATED_LISTS = """
SELECT c_name AS name, c_nationkey AS nation FROM customer WHERE coalesce(c_mktsegment NOT IN ('BUILDING', 'MACHINERY'), true) UNION ALL SELECT s_name, s_nationkey FROM supplier
"""


def flattened_lists(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array("l_returnflag", "l_linestatus").alias("flags"), F.when(F.col("l_linenumber") % 2 == 0, F.array(F.col("l_linenumber").cast("string"))).alias("even"))
    return O.flattened(rows, ["l_orderkey"], ["flags", "even"], "l_linenumber", "all").select("l_orderkey", F.array_join("all", ",").alias("flat"))


FLATTENED_LISTS = """
SELECT l_orderkey, string_agg(l_returnflag || ',' || l_linestatus || CASE WHEN l_linenumber % 2 = 0 THEN ',' || l_linenumber ELSE '' END, ',' ORDER BY l_linenumber, l_returnflag, l_linestatus) AS flat FROM lineitem GROUP BY l_orderkey
"""


def item_hrefs(spark, sf_dir: str) -> DataFrame:
    slug = F.lower(F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", item_href(slug, "orders", {"1-urgent": "/now", "5-low": "/later"}).alias("href"))


ITEM_HREFS = """
SELECT o_orderkey, CASE lower(o_orderpriority) WHEN '1-urgent' THEN '/now' WHEN '5-low' THEN '/later' ELSE '/orders/' || lower(o_orderpriority) END AS href FROM orders
"""

QUERIES = {
    "first_matches": (first_matches, FIRST_MATCHES),
    "concatenated_lists": (concatenated_lists, CONCATENATED_LISTS),
    "flattened_lists": (flattened_lists, FLATTENED_LISTS),
    "item_hrefs": (item_hrefs, ITEM_HREFS),
    "overlay_labels": (overlay_labels, OVERLAY_LABELS),
    "positional_overlay": (positional_overlay, POSITIONAL_OVERLAY),
    "code_labels": (code_labels, CODE_LABELS),
    "fk_default_first": (fk_default_first, FK_DEFAULT_FIRST),
    "fk_or_null": (fk_or_null, FK_OR_NULL),
    "orders_without_lines": (orders_without_lines, ORDERS_WITHOUT_LINES),
    "orders_with_lines": (orders_with_lines, ORDERS_WITH_LINES),
    "gallery_present": (gallery_present, GALLERY_PRESENT),
    "named_in_order": (named_in_order, NAMED_IN_ORDER),
    "bridge_top": (bridge_top, BRIDGE_TOP),
    "dependent_options": (dependent_options, DEPENDENT_OPTIONS),
    "ring_nav": (ring_nav, RING_NAV),
    "agg_strings": (agg_strings, AGG_STRINGS),
    "table_counts": (table_counts, TABLE_COUNTS),
    "translation_gaps": (translation_gaps, TRANSLATION_GAPS),
}
