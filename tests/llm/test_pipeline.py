import pytest

import corpus_pipeline
from sparkloom.llm import toxicity
from tests.llm.test_text import check_packing, plain_features

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output, written and read again."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"file://{tmp_path_factory.mktemp(name)}/x"
        stage(spark, docs, SF).write.parquet(path)
        out[name] = docs, spark.read.parquet(path)
        docs = out[name][1]
    return out


def test_all_but_the_last_return_documents(stages, spark):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(after.columns == columns for name, (_, after) in stages.items() if name != "packing")


def test_lines(stages):
    before, after = stages["line_dedup"]
    assert before.count() == after.count() and before.select("doc_id").exceptAll(after.select("doc_id")).count() == 0
    assert after.where("n_chars <> length(text)").count() == 0


def test_near_duplicates_keep_the_least_of_equal_texts(stages):
    before, after = stages["simhash_near_dedup"]
    kept = {r.doc_id for r in after.collect()}
    groups = {}
    for r in before.collect():
        groups.setdefault(r.text, []).append(r.doc_id)
    assert all(len(kept & set(g)) <= 1 for g in groups.values()) and 0 < len(kept) <= before.count()


def test_mixing_keeps_every_row(stages):
    before, after = stages["source_mixing"]
    assert before.exceptAll(after).count() == 0 == after.exceptAll(before).count()


def test_packing(stages):
    before, after = stages["packing"]
    check_packing({r.doc_id: r.text for r in before.collect()}, after.collect())


def test_run_gives_the_last_stage(spark, stages):
    found = corpus_pipeline.run(spark, SF)
    assert found.count() == stages["packing"][1].count()


@pytest.mark.parametrize("empty", [False, True])
def test_stages_take_odd_rows(spark, tmp_path, empty):
    text = "\n".join(f"line {k} of a longer text with words" for k in range(30))
    rows = [(1, text, "en", "a", 5, 77, "x"), (1, text, "en", "a", 5, 77, "x"), (2, text + "\nend", None, None, None, None, None), (None, None, None, None, None, None, None), (None, "", "fr", "b", 0, 2, "y"), (3, "one", "de", "", 3, None, ""), (4, "w " * 50_000, "en", "a", 1, 1, "x")]
    rows = [(*r, r[5], r[6], r[6], r[5], r[6]) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars int, score int, n_removed string, n_lines int, mix_slot string, predicted string, at int, c0 string"
    spark.createDataFrame([(1, 1, 0), (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([] if empty else rows, schema)
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, f"file://{tmp_path}").write.parquet(f"file://{tmp_path}/{name}")
        after = spark.read.parquet(f"file://{tmp_path}/{name}")
        if name != "packing":
            assert after.schema.simpleString() == docs.schema.simpleString()
            assert after.select(others).exceptAll(docs.select(others)).count() == 0
        if name in ("toxicity", "line_dedup", "source_mixing"):
            assert after.count() == docs.count()
        docs = after
    assert docs.count() == 0 if empty else docs.count() > 0


def test_toxicity_rejects_what_a_plain_score_rejects(spark, stages):
    before, after = stages["toxicity"]
    model = toxicity.train(before, spark.read.parquet(f"{SF}/labels.parquet"))
    weights = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    kept = {r.doc_id for r in before.collect() if model.bias + sum(weights.get(i, 0.0) for i in plain_features(r.text)) < 0}
    assert kept == {r.doc_id for r in after.collect()} and 0 < len(kept) <= before.count()
