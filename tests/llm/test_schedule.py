import random

import corpus_pipeline
from sparkloom.llm import packing
from tests.llm.test_text import check_packing


def test_any_stretch_of_sequences_shows_the_target_shares(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 256)
    r = random.Random(2)
    source = {i: "large" if i % 10 else "small" for i in range(4000)}  # targets 60 to 20
    texts = {i: " ".join(r.choice(["alpha", "beta", "gamma"]) for _ in range(r.randint(50, 400))) for i in source}
    rows = spark.createDataFrame([(i, texts[i], source[i]) for i in source], "doc_id long, text string, source string").repartition(5)
    corpus_pipeline.sources_mixed(spark, rows, "").write.parquet(f"file://{tmp_path}/mixed")
    found = corpus_pipeline.packed(spark, spark.read.parquet(f"file://{tmp_path}/mixed"), "").collect()
    check_packing(texts, found)
    pieces = sorted((x.sequence_id, source[x.doc_id]) for x in found)
    while_both_last = pieces[:1300]  # small ends after about 1,600 documents
    for k in range(0, 1300, 260):
        share = sum(s == "small" for _, s in while_both_last[k : k + 260]) / 260
        assert 0.18 < share < 0.32, (k, share)
