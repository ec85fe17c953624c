import json

from pyspark.sql import functions as F

from sparkloom.operators import intake, pages
from sparkloom.sources import sinks, tables


def test_json_catalog_keeps_order_and_types(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"slug": "b", "media": [1, 2]}, {"slug": "a", "media": None, "other": 1}]))
    rows = tables.json_catalog(spark, f"file://{tmp_path}/c.json", "struct<slug:string,media:array<int>>").orderBy("pos").collect()
    assert [(r.pos, r.slug, r.media) for r in rows] == [(0, "b", [1, 2]), (1, "a", None)]


def test_page_files_by_suffix(spark, tmp_path):
    (tmp_path / "en" / "x").mkdir(parents=True)
    (tmp_path / "en" / "x" / "index.html").write_text("<title>é</title>")
    (tmp_path / "en" / "x.txt").write_text("no")
    rows = tables.page_files(spark, f"file://{tmp_path}").collect()
    assert [(r.html, r.length) for r in rows] == [("<title>é</title>", 17)]
    assert tables.file_sizes(spark, f"file://{tmp_path}").count() == 2


def test_broken_lines_are_kept(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"submission_id":"1","method":"POST"}\n{broken\n')
    rows = tables.submissions(spark, f"file://{tmp_path}/s.json", intake.SUBMISSION).cache().collect()
    assert sorted((r.submission_id or "", r._corrupt_record or "") for r in rows) == [("", "{broken"), ("1", "")]


def test_sinks(spark, tmp_path):
    routes = spark.createDataFrame([("/",), ("/a",)], "route string")
    made = pages.page_matrix(routes, "https://x.org/", ["en", "ar"]).withColumn("title", F.lit("t")).withColumn("description", F.lit("d")).withColumn("hero", F.lit(1))
    sinks.write_pages(pages.rendered(made, "{{T}}", {"T": F.col("title")}), f"file://{tmp_path}/pages")
    sinks.write_manifest(pages.manifest(made), f"file://{tmp_path}/manifest")
    sinks.write_sitemap(made.select("depth", "canonical").withColumn("entry", F.concat(F.lit("<url>"), "canonical", F.lit("</url>"))).withColumnRenamed("depth", "pos"), f"file://{tmp_path}/map")
    assert spark.read.parquet(f"file://{tmp_path}/pages").groupBy("locale").count().count() == 2
    assert spark.read.json(f"file://{tmp_path}/manifest").count() == 4
    text = "".join(r.value for r in spark.read.text(f"file://{tmp_path}/map", wholetext=True).collect())
    assert text.count("<url>") == 4 and text.count("</urlset>") >= 1


def test_trees_are_listed_and_read_by_tasks(spark, tmp_path):
    (tmp_path / "in" / "a b" / "_x=1").mkdir(parents=True)
    (tmp_path / "in" / "_left").mkdir()
    for name in ("a b/é+%20.html", "a b/_x=1/x.html", "top.html", "empty.html", "_left/out.html", ".out.html", "a b/note.txt"):
        (tmp_path / "in" / name).write_text("" if name == "empty.html" else name)
    for found, wanted in ((tables.page_files(spark, f"file://{tmp_path}/in"), "*.html"), (tables.file_sizes(spark, f"{tmp_path}/in"), "*")):
        plain = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", wanted).load(f"file://{tmp_path}/in")
        # Spark's reader leaves out empty files
        assert sorted(map(tuple, found.where("length > 0").select("path", "length").collect())) == sorted(map(tuple, plain.select("path", "length").collect())) and found.count() > 3
        assert "binaryFile" not in found._jdf.queryExecution().toString() and len(found.inputFiles()) < 20
    assert {r.html for r in tables.page_files(spark, f"{tmp_path}/in").collect()} == {"", "top.html", "a b/é+%20.html", "a b/_x=1/x.html"}
