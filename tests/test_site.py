from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import site
from sparkloom.sources.site import folder_files, page_path, write_site


def tree(folder):
    return {str(p.relative_to(folder)): p.read_text() for p in Path(folder).rglob("*") if p.is_file()}


def rows(spark, pairs, kinds="path string, content string"):
    return spark.createDataFrame(pairs, kinds).repartition(4)


def test_a_page_for_each_route(spark, tmp_path):
    pages = spark.createDataFrame([("en", "/"), ("en", "/a/b"), ("ar", "a"), ("ar", "//a//c/")], "locale string, route string")
    write_site(pages.select(page_path(F.col("locale"), F.col("route")).alias("path"), F.concat_ws(" ", "locale", "route").alias("content")), f"file://{tmp_path}/dist")
    assert tree(tmp_path / "dist") == {"en/index.html": "en /", "en/a/b/index.html": "en /a/b", "ar/a/index.html": "ar a", "ar/a/c/index.html": "ar //a//c/"}
    assert [p.name for p in tmp_path.iterdir()] == ["dist"]


def test_a_tree_is_replaced_as_a_whole(spark, tmp_path):
    write_site(rows(spark, [("old/x.html", "1"), ("same.html", "1")]), str(tmp_path / "dist"))
    write_site(rows(spark, [("same.html", "2"), ("new/y.html", "é"), ("empty.html", None)]), str(tmp_path / "dist"))
    assert tree(tmp_path / "dist") == {"same.html": "2", "new/y.html": "é", "empty.html": ""}


def test_a_failed_job_leaves_what_was_there(spark, tmp_path):
    write_site(rows(spark, [("a.html", "1")]), str(tmp_path / "dist"))
    late = spark.range(50).repartition(4).select(F.concat(F.lit("p"), "id").alias("path"), F.when(F.col("id") == 37, F.raise_error(F.lit("broken page"))).otherwise(F.lit("x")).alias("content"))
    with pytest.raises(Exception, match="broken page"):
        write_site(late, str(tmp_path / "dist"))
    assert tree(tmp_path / "dist") == {"a.html": "1"} and [p.name for p in tmp_path.iterdir()] == ["dist"]


@pytest.mark.parametrize("path", ["../x", "a/../../x", "/x", "a//b", "", None, "a/."])
def test_paths_stay_inside(spark, tmp_path, path):
    with pytest.raises(Exception, match="not a path inside the tree"):
        write_site(rows(spark, [(path, "1")]), str(tmp_path / "dist"))
    assert not (tmp_path / "dist").exists()


def test_the_last_of_equal_paths_counts(spark, tmp_path):
    write_site(rows(spark, [("a", "1", 1), ("a", "3", 3), ("a", "2", 2)], "path string, content string, pos int"), str(tmp_path / "dist"))
    assert tree(tmp_path / "dist") == {"a": "3"}


def test_an_empty_table_makes_an_empty_tree(spark, tmp_path):
    write_site(rows(spark, []), str(tmp_path / "dist"))
    assert tree(tmp_path / "dist") == {} and (tmp_path / "dist").is_dir()


def test_assets_are_copied_along(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a b+c.css").write_text("css")
    (tmp_path / "in" / "deep" / "x.js").write_text("js")
    both = folder_files(spark, f"file://{tmp_path}/in", "assets").unionByName(rows(spark, [("index.html", "page")]).withColumn("content", F.col("content").cast("binary")))
    write_site(both, str(tmp_path / "dist"))
    assert tree(tmp_path / "dist") == {"assets/a b+c.css": "css", "assets/deep/x.js": "js", "index.html": "page"}


def test_an_attempt_that_is_repeated_replaces_its_pages(tmp_path):
    writer = site._Writer(str(tmp_path / "dist"), True)
    writer.write(iter([("a", b"half")]))
    writer.write(iter([("a", b"whole"), ("b", b"x")]))
    assert not (tmp_path / "dist").exists()
    writer.commit([None])
    assert tree(tmp_path / "dist") == {"a": "whole", "b": "x"}
