import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.functions import scalars
from sparkloom.operators import pages, search, terms, text_index
from sparkloom.operators.terms import TermAutomaton, term_hits

short = st.text("abé ", min_size=1, max_size=4)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abé ", max_size=40), min_size=1, max_size=5), st.lists(short, min_size=1, max_size=12, unique=True), st.integers(1, 9))
def test_automaton_finds_all_terms(texts, wanted, lane):
    raw = [x.encode() for x in texts]
    old, terms.LANE = terms.LANE, lane
    try:
        text, term = TermAutomaton([x.encode() for x in wanted]).hits(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    finally:
        terms.LANE = old
    assert list(zip(text.tolist(), term.tolist())) == [(i, k) for i, x in enumerate(texts) for k, w in enumerate(wanted) if w in x]


@pytest.mark.parametrize("most", [1 << 20, 8])
def test_term_hits_in_one_or_several_passes(spark, monkeypatch, most):
    monkeypatch.setattr(terms, "MOST_BYTES", most)
    rows = [(1, "Old Feature and OLD"), (1, "nothing"), (2, None), (None, "feature"), (3, ""), (4, "x" * 5000 + "old")]
    wanted = ["Old Feature", "old", "feature", "FEATURE", "", None, "xx"]
    found = term_hits(spark.createDataFrame(rows, "page int, html string"), "page", F.col("html"), spark.createDataFrame([(x,) for x in wanted], "term string"))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([(k, w) for k, t in rows if t for w in {x.lower() for x in wanted if x} if w in t.lower()], key=repr)
    assert term_hits(spark.createDataFrame(rows, "page int, html string"), "page", F.col("html"), spark.createDataFrame([], "term string")).count() == 0


def test_indexed_search_equals_the_scan_and_reads_its_buckets(spark, tmp_path):
    rows = [(i, f"Item {i} of the catalogue, {'éà' if i % 3 == 0 else 'plain'} text") for i in range(300)] + [(None, "catalogue without key"), (5, "a repeated key: catalogue"), (400, None), (401, ""), (402, "ca")]
    items = spark.createDataFrame(rows, "id int, text string").repartition(3)
    text_index.write_trigram_index(items, "id", F.col("text"), f"file://{tmp_path}/index")
    for query in ("catalogue", "  Éà text ", "item 29", "the catalogue, plain", "not there", "ca", "", "%", "_te", "repeated"):
        found = text_index.indexed_search(items, "id", F.col("text"), query, f"file://{tmp_path}/index")
        whole = search.search(items, search.search_text("text"), query, {}).where("text IS NOT NULL" if query.strip() else "true")
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr), query
    plan = text_index.candidates(spark, f"file://{tmp_path}/index", "item 29")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters:")[1][:60]


def test_active_menus_equal_all_pairs(spark):
    routes = ["/", "/a", "/a/b", "/ab", "/a/b/c", "//a", "/a//b", "", None, "a", "a/b", "/a/"]
    left = spark.createDataFrame(list(enumerate(routes)), "page int, route string")
    right = spark.createDataFrame([(10 * i, r) for i, r in enumerate(routes)], "menu int, route string")
    found = pages.active_menus(left, right, "page", "menu")
    pairs = left.withColumnRenamed("route", "own").crossJoin(right).where(scalars.is_active(F.col("own"), F.col("route"))).select("page", "menu")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, pairs.collect()))
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()


def test_active_menus_of_a_shared_route_are_written_by_several_tasks(spark):
    rows = spark.range(0, 3000, 1, 1).select(F.when(F.col("id") > 9, F.col("id")).alias("page"), F.when(F.col("id") > 5, F.lit("/a")).otherwise("/a/b").alias("route"))
    found = pages.active_menus(rows, rows.withColumnRenamed("page", "menu"), "page", "menu").withColumn("task", F.spark_partition_id())
    tasks = [r["count"] for r in found.groupBy("task").count().collect()]
    assert sum(tasks) == 2994 * 2994 + 6 * 3000 and max(tasks) < sum(tasks) / 2
    assert found.where("page IS NULL AND menu IS NULL").count() == 4 * 4 + 6 * 10


@pytest.mark.parametrize("part", [1, 3])
def test_active_menus_of_cut_routes_equal_all_pairs(spark, monkeypatch, part):
    monkeypatch.setattr(pages, "PART", part)
    routes = ["/", "/a", "/a/b", "/a/b", "/ab", "/a", "", None, "/none/below", "/none/too"]
    left = spark.createDataFrame([(None if i % 7 == 0 else i % 31, routes[i % 10]) for i in range(60)], "page int, route string")
    right = spark.createDataFrame([(None if i % 5 == 0 else f"m{i % 13}", routes[i % 8]) for i in range(40)], "menu string, route string")
    found = pages.active_menus(left, right, "page", "menu")
    pairs = left.withColumnRenamed("route", "own").crossJoin(right).where(scalars.is_active(F.col("own"), F.col("route"))).select("page", "menu")
    assert found.dtypes == pairs.dtypes and sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, pairs.collect()), key=repr)


def _shuffled_rows(spark, rows):
    """The number of ``rows``, and of rows that their shuffles take."""
    gateway, store = spark.sparkContext._gateway, spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: {s.stageId(): s.shuffleWriteRecords() for s in gateway.jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList()))}
    before = stages()
    return rows.count(), sum(n for stage, n in stages().items() if stage not in before)


def test_active_menus_shuffle_rows_and_not_pairs(spark):
    rows = spark.range(0, 9000, 1, 4).select(F.col("id").alias("page"), F.lit("/a").alias("route"))
    n, sent = _shuffled_rows(spark, pages.active_menus(rows, rows.withColumnRenamed("page", "menu"), "page", "menu"))
    assert n == 9000 * 9000 and sent < 4 * 9000


def test_active_menus_leave_out_long_routes_without_menus(spark):
    rows = spark.range(0, 4000, 1, 4).select(F.col("id").alias("page"), F.concat(F.lit("/a/"), "id").alias("route"))
    menus = spark.createDataFrame([(1, "/a/7"), (2, "/b")], "menu int, route string")
    lists = pages._lists(rows.select("page", F.lit("/a").alias("__route")), "page", "__pages", pages._grids(rows.select(F.lit("/a").alias("__route")), menus.select(F.col("route").alias("__route")), 8), "__high")
    assert lists.count() == 0
    assert list(map(tuple, pages.active_menus(rows, menus, "page", "menu").collect())) == [(7, 1)]
