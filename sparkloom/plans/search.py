"""Search queries over parts and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import search as O
from ..sources.tables import table


def faceted_search(spark, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    text = O.search_text("p_name", "p_brand", "p_type")
    return O.search(part, text, " Ring ", {"p_type": "SMALL", "p_brand": ""}).select("p_partkey", "p_name", "p_brand", "p_type")


FACETED_SEARCH = """
SELECT p_partkey, p_name, p_brand, p_type FROM part
WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'ring') AND p_type = 'SMALL'
"""


def facet_options(spark, sf_dir: str) -> DataFrame:
    return O.facet_options(table(spark, sf_dir, "part"), ["p_brand", "p_type"], "p_partkey")


FACET_OPTIONS = """
WITH long AS (
  SELECT 'p_brand' AS facet, p_brand AS value, p_partkey FROM part UNION ALL SELECT 'p_type', p_type, p_partkey FROM part
), grouped AS (
  SELECT facet, value, min(p_partkey) AS first_pos, count(*) AS n_rows FROM long WHERE value IS NOT NULL GROUP BY facet, value
)
SELECT *, CAST(row_number() OVER (PARTITION BY facet ORDER BY first_pos, value) AS INTEGER) AS rank FROM grouped
"""


def search_counts(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", "source", "text")
    return O.visible_counts(docs, O.search_text("text"), "license", {"source": "src7"}, ["lang"])


SEARCH_COUNTS = """
WITH counted AS (
  SELECT lang, count(*) AS n_rows, CAST(count_if(contains(lower(text), 'license') AND source = 'src7') AS BIGINT) AS n_visible FROM documents GROUP BY lang
)
SELECT *, n_visible = 0 AS is_empty FROM counted
"""


def search_documents(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return O.search(docs, O.search_text("source", "text"), "the ", {"lang": "en"}).select("doc_id", "source")


SEARCH_DOCUMENTS = "SELECT doc_id, source FROM documents WHERE lang = 'en' AND contains(lower(concat_ws(' ', source, text)), 'the')"


def related_top3(spark, sf_dir: str) -> DataFrame:
    return O.related(table(spark, sf_dir, "part"), "p_partkey", ["p_brand", "p_type"], 3)


RELATED_TOP3 = """
SELECT * FROM (
  SELECT a.p_partkey, b.p_partkey AS related, CAST(row_number() OVER (PARTITION BY a.p_partkey ORDER BY b.p_partkey) AS INTEGER) AS rank
  FROM part a JOIN part b ON (a.p_brand = b.p_brand OR a.p_type = b.p_type) AND a.p_partkey <> b.p_partkey
) WHERE rank <= 3
"""

QUERIES = {
    "faceted_search": (faceted_search, FACETED_SEARCH),
    "facet_options": (facet_options, FACET_OPTIONS),
    "search_counts": (search_counts, SEARCH_COUNTS),
    "search_documents": (search_documents, SEARCH_DOCUMENTS),
    "related_top3": (related_top3, RELATED_TOP3),
}
