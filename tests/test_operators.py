from pyspark.sql import functions as F

from sparkloom.operators import catalog, pages, rules, search, sequences


def test_overlay_presence_wins_and_absence_falls_back(spark):
    base = spark.createDataFrame([("a", "A", [1, 2]), ("b", "B", [3]), ("c", "C", None)], "slug string, title string, media array<int>")
    local = spark.createDataFrame([("a", "", None), ("b", None, [9, 9])], "slug string, title string, media array<int>")
    assert {tuple(r) for r in catalog.overlay(base, local, "slug").select("slug", "title", F.col("media").cast("string")).collect()} == {("a", "", "[1, 2]"), ("b", "B", "[9, 9]"), ("c", "C", None)}


def test_label_falls_back_to_the_code(spark):
    rows = spark.createDataFrame([("x",), ("Alignment",), (None,)], "category string")
    labels = spark.createDataFrame([("x", "label")], "code string, label string")
    assert {tuple(r) for r in catalog.with_label(rows, "category", labels, "l").collect()} == {("x", "label"), ("Alignment", "Alignment"), (None, None)}


def test_lookup_policies(spark):
    facts, items = spark.createDataFrame([(1, 7), (2, 8), (3, None)], "id int, media int"), spark.createDataFrame([(5, "first"), (7, "seven")], "id2 int, full string")
    assert {tuple(r) for r in catalog.looked_up(facts, "media", items, "id2", ["full"]).collect()} == {(1, 7, "seven"), (2, 8, None), (3, None, None)}
    assert {tuple(r) for r in catalog.looked_up(facts, "media", items, "id2", ["full"], order="id2").collect()} == {(1, 7, "seven"), (2, 8, "first"), (3, None, "first")}


def test_lists_keep_order_and_skip_misses(spark):
    lists = spark.createDataFrame([("s", [3, 1, 9, 1])], "slug string, media array<int>")
    items = spark.createDataFrame([(1,), (3,)], "id int")
    assert [(r.pos, r.element) for r in catalog.present(lists, "media", items, "id").orderBy("pos").collect()] == [(0, 3), (1, 1), (3, 1)]


def test_unknown_choice_has_no_options(spark):
    rows = spark.createDataFrame([("p", {"B58": ["x", "y"]})], "slug string, models map<string,array<string>>")
    assert [tuple(r) for r in catalog.dependent_options(rows, "slug", "models", "B58").orderBy("pos").collect()] == [("p", 0, "x"), ("p", 1, "y")]
    assert catalog.dependent_options(rows, "slug", "models", "S55").count() == 0


def test_search_is_literal_and_blank_choices_pass(spark):
    rows = spark.createDataFrame([(1, "50% off", "a"), (2, "50 off", "b"), (3, None, "a")], "id int, t string, f string")
    text = search.search_text("t")
    found = lambda q, f: {r.id for r in search.search(rows, text, q, f).collect()}
    assert found("50% OFF ", {}) == {1} and found("_", {}) == set() and found("", {"f": "a"}) == {1, 3} and found("", {"f": ""}) == {1, 2, 3}
    empty = search.visible_counts(rows, text, "zzz", {}, ["f"]).collect()
    assert all(r.is_empty and r.n_visible == 0 for r in empty)


def test_facets_in_first_seen_order(spark):
    rows = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b"), (3, None)], "pos int, c string")
    assert [(r.value, r.first_pos, r.n_rows) for r in search.facet_options(rows, ["c"], "pos").orderBy("rank").collect()] == [("b", 0, 2), ("a", 1, 1)]


def test_related_equals_the_naive_join(spark):
    rows = spark.range(200).select(F.col("id").alias("k"), (F.col("id") % 7).alias("g"), F.when(F.col("id") % 3 > 0, F.col("id") % 11).alias("h"))
    naive = {}
    data = [tuple(r) for r in rows.collect()]
    for k, g, h in data:
        naive[k] = [x for x, a, b in data if x != k and (a == g or (h is not None and b == h))][:3]
    found = {}
    for r in search.related(rows, "k", ["g", "h"]).orderBy("k", "rank").collect():
        found.setdefault(r.k, []).append(r.related)
    assert found == {k: v for k, v in naive.items() if v}


def test_ring_wraps(spark):
    rows = spark.createDataFrame([("g", 1), ("g", 2), ("g", 3), ("h", 9)], "g string, k int")
    found = {r.k: (r.position_label, r.next_key, r.previous_key) for r in sequences.ring(rows, ["g"], "k").collect()}
    assert found == {1: ("1 / 3", 2, 3), 2: ("2 / 3", 3, 1), 3: ("3 / 3", 1, 2), 9: ("1 / 1", 9, 9)}


def test_breadcrumbs(spark):
    rows = spark.createDataFrame([("/", "Home | x"), ("/services/engine-work/dyno-run", "Dyno | x")], "route string, title string")
    found = rows.select(pages.breadcrumbs(F.col("route"), F.col("title"), "Home", {"services": "All services"}).alias("b")).collect()
    assert [tuple(x) for x in found[0].b] == [(1, "Home", "/")]
    assert [tuple(x) for x in found[1].b] == [(1, "Home", "/"), (2, "All services", "/services"), (3, "engine work", "/services/engine-work"), (4, "Dyno", "/services/engine-work/dyno-run")]


GOOD = (
    '<html lang="ar-KW" dir="rtl" data-locale="ar"><title>T</title><meta name="description" content="' + "d" * 35 + '"><link rel="canonical" href="u">'
    '<link hreflang="en-KW"><link hreflang="ar-KW"><link hreflang="x-default"><script type="application/ld+json">{}</script><h1>x</h1>'
)


def test_rules(spark):
    rows = spark.createDataFrame([("ar/a/index.html", GOOD), ("ar/b/index.html", GOOD.replace("d" * 35, "d" * 34).replace("rtl", "ltr") + "Lorem IPSUM"), ("404.html", "<title>x</title>"), ("en/x/index.html", None)], "path string, html string")
    checks = rules.page_rules(F.col("html"), rules.locale_of(F.col("path"), ["en", "ar"]))
    found = {}
    for r in rules.violations(rows, ["path"], checks).collect():
        found.setdefault(r.path, set()).add(r.rule)
    assert "ar/a/index.html" not in found
    assert found["ar/b/index.html"] == {"description_length", "dir", "free_of_lorem_ipsum"}
    assert found["404.html"] == {"description_length", "heading"}
    assert {"title", "canonical", "heading"} <= found["en/x/index.html"]


def test_duplicates_name_the_first_holder(spark):
    rows = spark.createDataFrame([("en", "T", 1), ("en", "T", 4), ("ar", "T", 2), ("en", "T", 9), ("en", None, 3), ("en", None, 5)], "locale string, title string, k int")
    assert {tuple(r) for r in rules.duplicates(rows, "title", ["locale"], "k").collect()} == {("en", "T", 4, 1), ("en", "T", 9, 1)}


def test_counts_and_gaps(spark):
    t = spark.range(3)
    assert [(r.check, r.passed) for r in rules.count_checks({"a": (t, 3, "="), "b": (t, 4, ">=")}).orderBy("check").collect()] == [("a", True), ("b", False)]
    base, local = spark.createDataFrame([("x",), ("y",)], "slug string"), spark.createDataFrame([("ar", "x"), ("ar", "zz")], "locale string, slug string")
    assert [tuple(r) for r in rules.incomplete_translations(base, local, "slug", ["ar"]).collect()] == [("ar", 1)]


def test_rules_look_at_the_opening_tag_and_at_each_alternate(spark):
    bodies = {
        "lang": GOOD.replace('lang="ar-KW" ', "") + '<p lang="ar-KW">', "dir": GOOD.replace('dir="rtl" ', "") + '<p dir="rtl">', "heading": GOOD.replace("<h1>", "<h12>"),
        "alternates": GOOD.replace('"x-default"', '"en-KW"'), "dictionaries": GOOD.replace("a.js", "c.js"), "theme": GOOD.replace("dataset.theme", ""), "removed_old_thing": GOOD + "Old Thing",
    }
    good = "<script src=a.js></script><script src=b.js>dataset.theme</script>"
    rows = spark.createDataFrame([(k, (v.replace("</h1>", "</h1>" + good) if k not in ("dictionaries", "theme") else v + (good.replace("a.js", "x") if k == "dictionaries" else good.replace("dataset.theme", "")))) for k, v in bodies.items()], "name string, html string")
    checks = rules.page_rules(F.col("html"), F.lit("ar"), removed=("old thing",), dictionaries=("a.js", "b.js"), theme=("dataset.theme",))
    assert {(r.name, r.rule) for r in rules.violations(rows, ["name"], checks).collect()} == {(k, k) for k in bodies}


def test_lint_patterns(spark):
    texts = ["debugger ;", "debugger", f"API_KEY = '{'a' * 20}'", f"API_KEY = '{'a' * 19}'", "api_key = 'aaaaaaaaaaaaaaaaaaaaaaaa'", "eval (x)", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    assert {(r.i, r.rule) for r in rules.violations(rows, ["i"], rules.lint_rules(F.col("text"))).collect()} == {(0, "debugger"), (2, "secret"), (5, "eval")}


def test_names_files_and_terms(spark):
    of = lambda *x: spark.createDataFrame([(v,) for v in x], "name string")
    assert [r.name for r in rules.missing_names(of("a", "b"), of("b", "c"), "name").collect()] == ["a"]
    assert [r.name for r in rules.present_names(of("a", "b"), of("b", "c"), "name").collect()] == ["b"]
    files = spark.createDataFrame([("a.js", "x OLD y"), ("b.png", "old"), ("c.HTML", None)], "path string, text string")
    assert [tuple(r) for r in rules.remaining_terms(files, "path", "text", ["old"]).collect()] == [("a.js", "old")]
    assert [r.name for r in rules.without_file(of("a.js", "q", None), "name", files, "path").orderBy("name").collect()] == [None, "q"]


def test_ring_over_stretches_equals_one_window(spark):
    """Hot, single, null and empty groups, with a null key, over many stretches."""
    rows = [("hot", i) for i in range(400)] + [("one", 7), (None, 3), (None, 1), ("null", None), ("null", 2)]
    items = spark.createDataFrame(rows, "g string, k int")
    found = {(r.g, r.k): (r.position, r.n_items, r.next_key, r.previous_key) for r in sequences.ring(items, ["g"], "k", 37).collect()}
    wanted = {}
    for g in {g for g, _ in rows}:
        keys = sorted((k for h, k in rows if h == g), key=lambda k: (k is not None, k or 0))
        wanted |= {(g, k): (i + 1, len(keys), keys[(i + 1) % len(keys)], keys[i - 1]) for i, k in enumerate(keys)}
    assert found == wanted
    assert sequences.ring(items.limit(0), ["g"], "k").collect() == []


def test_a_hot_ring_is_cut_by_keys_of_any_type(spark):
    """A group with nearly all rows lies in many ranges, none of which has far more than its share; keys are texts."""
    items = spark.range(4000).select(F.when(F.col("id") < 3900, "hot").otherwise(F.col("id").cast("string")).alias("g"), F.lpad(F.col("id").cast("string"), 5, "0").alias("k"))
    found = sequences.ring(items, ["g"], "k", 16)
    assert found.where("g = 'hot' AND next_key != lpad(CAST((CAST(k AS INT) + 1) % 3900 AS STRING), 5, '0')").count() == 0
    assert found.where("g != 'hot' AND (next_key != k OR previous_key != k OR n_items != 1)").count() == 0
    scans = [x for x in found.inputFiles()]
    sizes = [r["count"] for r in spark.read.parquet(*scans).groupBy("__stretch").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 1000
