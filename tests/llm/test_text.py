import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkloom.llm import inner_products, mixing, packing, spans, token_counts, toxicity, url_filter

ODD = [chr(x) for x in range(256)] + list(" \t\n\x1c\x1f\x85\xa0\u2003\u2028\u3000\u200b\ufeffΣσß漢😀\u0301'") * 4 + ["<|endoftext|>", "<|startoftext|>", "'s", "  ", "aaaaaaaa", "word.", "İ"]


def texts(n, seed):
    r = random.Random(seed)
    return [None, "", " ", "aaaa" * 500] + ["".join(r.choice(ODD) for _ in range(r.randint(0, 20))) for _ in range(n)]


def test_counts_equal_the_library(spark):
    library = Tokenizer.from_file(path := public_tokenizers.path("byte_bpe_50k.json"))
    docs = dict(enumerate(texts(1500, 1)))
    rows = spark.createDataFrame([(i, t, "x") for i, t in docs.items()], "doc_id long, text string, n_tokens string")
    found = token_counts.count_tokens(rows, path).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in found} == {
        i: (len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in docs.items()
    }
    assert token_counts.count_tokens(rows.limit(0), path).count() == 0


def check_packing(docs, rows, window=2048):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in docs.items()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[i]) and r.ids_crc32 == zlib.crc32(ids[i][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[i])
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window and at & (at - 1) == 0, "a sequence with padding"


@pytest.mark.parametrize("window", [2048, 64])
def test_packing_is_whole_and_gapless(spark, window):
    docs = dict(enumerate(texts(300, 2) + ["many words here " * 3000] + ["the same text"] * 150))
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    check_packing(docs, packing.pack(rows, public_tokenizers.path("word_bpe_49k.json"), window).collect(), window)
    assert packing.pack(rows.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_least_squares_fit_a_histogram_of_combinations():
    histogram = np.zeros(64, np.int64)
    histogram[[10, 54, 20, 22, 21]] = [100, 100, 40, 40, 43]
    slots, taken, sequences = packing.plan(histogram, 64)
    assert (taken <= histogram).all() and taken[10] == taken[54] == 100
    used = np.bincount(np.repeat(slots["sequence"], slots["repeats"]) + np.concatenate([np.arange(n) for n in slots["repeats"]]), np.repeat(slots["length"], slots["repeats"]))
    assert len(used) == sequences and (used == 64).all()


@pytest.mark.parametrize("seed", range(5))
def test_least_squares_reach_the_best_of_all_active_sets(seed):
    """The solver's rest is that of the best unconstrained solution, over every subset of columns, that has no negative part."""
    r = np.random.default_rng(seed)
    dense = r.integers(0, 4, (9, 6)).astype(float)
    wanted = r.integers(0, 50, 9).astype(float)
    rows, columns = np.nonzero(dense)
    found = packing.nonnegative_least_squares(rows, columns, dense[rows, columns], wanted, 6, 4000)
    best = np.linalg.norm(wanted)
    for chosen in range(1, 64):
        some = [k for k in range(6) if chosen >> k & 1]
        x = np.linalg.lstsq(dense[:, some], wanted, rcond=None)[0]
        if (x >= 0).all():
            best = min(best, np.linalg.norm(dense[:, some] @ x - wanted))
    assert (found >= 0).all() and abs(np.linalg.norm(dense @ found - wanted) - best) < 1e-6 * (1 + best)


def test_toxicity_learns_and_holds_out(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 5)))
    docs, labels = [], []
    for i in range(1500):
        toxic = r.random() < 0.2
        w = [word() for _ in range(60)]
        if toxic:
            for _ in range(4):
                w.insert(r.randint(0, 50), r.choice(["scoundrel", "rotten", "wretch"]))
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs += [(9000, None), (9001, ""), (9000, None)]
    rows, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(rows, known)
    found = toxicity.score(rows, model).withColumn("held", toxicity.held_out(mixing.F.col("doc_id"))).collect()
    truth = dict(labels)
    out = [r for r in found if r.held and r.doc_id in truth]
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    assert len(found) == len(docs) and len(out) > 100 and np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.97
    assert 0 < len(model.features) < 2000
    nothing = toxicity.train(rows, known.limit(0))
    assert {r.score for r in toxicity.score(rows, nothing).collect()} == {0.5}
    assert toxicity.score(rows.limit(0), model).count() == 0


def plain_features(text):
    """Coordinates of a text, word by word."""
    low = "".join(c if ord(c) > 127 or c.isalnum() else " " for c in (text or "").lower())
    of = lambda w: spans.hash_spans(x := np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(x)]))
    words = [of(w) for w in low.split(" ") if w]
    at = [int(w[0]) for w in words]
    for gap in (1, 2):
        at += [int(spans.mix(spans.fold(a, b, 0) + np.uint64(gap))[0]) for a, b in zip(words, words[gap:], strict=False)]
    return {x % toxicity.BUCKETS for x in at}


def plain_ftrl(rows, rates, epochs):
    """FTRL-proximal coordinate by coordinate, as published."""
    z, n = {}, {}

    def weight(i, l1):
        a = z.get(i, 0.0)
        return 0.0 if abs(a) <= l1 else -(a - math.copysign(l1, a)) / ((rates.beta + math.sqrt(n.get(i, 0.0))) / rates.alpha + rates.l2)

    for _ in range(epochs):
        for y, at in rows:
            w = {i: weight(i, rates.l1) for i in at} | {None: weight(None, 0.0)}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i, x in w.items():
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / rates.alpha
                z[i] = z.get(i, 0.0) + g - sigma * x
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i, rates.l1) for i in z if i is not None}, weight(None, 0.0)


def test_toxicity_equals_plain_ftrl(spark):
    r = random.Random(3)
    texts = {i: None if i == 0 else " ".join(r.choice(["Ok", "fine", "vile", "hut", "été", "x-y"]) for _ in range(r.randint(0, 9))) for i in range(120)}
    labels = {i: int("vile" in (t or "")) for i, t in texts.items()}
    rows = spark.createDataFrame([(i, t, "a", 7.5) for i, t in texts.items()], "doc_id long, text string, predicted string, weights double").repartition(3)
    rates = toxicity.Rates(alpha=1.0, l1=0.5)
    model = toxicity.train(rows, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"), rates)
    order = {x.doc_id: x.o for x in rows.selectExpr("doc_id", "xxhash64(doc_id, 1) AS o").collect()}
    held = [i for i in texts if zlib.crc32(str(i).encode()) % 5]
    weights, bias = plain_ftrl([(labels[i], plain_features(texts[i])) for i in sorted(held, key=order.get)], rates, toxicity.EPOCHS)
    assert dict(zip(model.features.tolist(), model.weights.tolist(), strict=True)) == pytest.approx({i: w for i, w in weights.items() if w}) and model.bias == pytest.approx(bias)
    found = toxicity.score(rows, model)
    assert found.columns == ["doc_id", "text", "weights", "score", "predicted"]
    for x in found.collect():
        assert x.score == pytest.approx(1 / (1 + math.exp(-bias - sum(weights.get(i, 0.0) for i in plain_features(x.text))))) and x.weights == 7.5


def test_a_very_long_toxic_text(spark):
    model = toxicity.Model(np.array(sorted(plain_features("vile"))), np.array([9.0]), -4.0)
    rows = spark.createDataFrame([(1, "word " * 1_000_000 + "vile"), (2, "word " * 1_000_000)], "doc_id long, text string")
    assert {x.doc_id: x.predicted for x in toxicity.score(rows, model).collect()} == {1: 1, 2: 0}


def test_url_parts_and_cascade(spark):
    urls = [None, "", "no scheme", "http://A.Example.COM/en/x?q#f", "https://www.example.com/en/", "http://example.com", "ftp://x.net/es/://y", "s://h?p/en/", "a://b://c/d", "http://xexample.net/fr/1", "http://İ.net/a\nb"]
    hosts = [f"http://host{i}.org/" for i in range(3000)]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls + hosts + hosts[:5])], "page_id long, url string, rule string")
    listed = spark.createDataFrame([(f"host{i}.org",) for i in range(0, 3000, 7)] + [("absent.org",), (None,), ("host0.org",)], "host string")
    for most in (url_filter.MOST_WORDS, 16):  # with one cascade, and with keys dealt to several
        found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, listed, most_words=most).collect()}
        assert [found[i] for i in range(len(urls))] == [
            ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("a.example.com", "/en/x", "example.com/en/", "block"), ("www.example.com", "/en/", "www.example.com/en/", "allow"),
            ("example.com", "", None, "allow"), ("x.net", "/es/://y", "net/es/", "block"), ("h", "", None, "allow"), ("b:", "//c/d", None, "allow"), ("xexample.net", "/fr/1", "net/fr/", "block"), ("İ.net", "/a\nb", None, "allow"),
        ]
        assert len(found) == len(urls) + 3005
        assert all((found[len(urls) + i][3] == "block") == (i % 7 == 0) for i in range(3000))
    assert url_filter.judge_urls(pages.limit(0), listed).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages.where("page_id < 3"), listed.limit(0)).collect()} == {"allow"}


def check_mix(found, weights, rows):
    """Every block within its window, and no source ever a block away from its exact target while all last."""
    assert len(found) == rows and len({(r.mix_slot, r.mix_place) for r in found}) == rows
    assert all(r.mix_release <= r.mix_slot < r.mix_deadline for r in found)
    total, blocks = sum(weights.values()), {}
    for r in found:
        assert blocks.setdefault(r.mix_slot, r.source or "") == (r.source or "")
    end = min(max(s for s, x in blocks.items() if x == name) for name in weights)
    count = dict.fromkeys(weights, 0)
    for at in range(end):
        count[blocks[at]] += 1
        assert all(abs(count[n] * total - (at + 1) * w) < total for n, w in weights.items()), at
    return end / total


def test_mixing_deviates_by_less_than_a_block(spark):
    sizes = {"big": 4000, "mid": 900, "small": 200, "": 30, None: 10}
    rows, k = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((k, source, "clash"))
            k += 1
    rows += [(None, "big", "x"), (5, "big", "x"), (5, "big", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, mix_slot string")
    roots = {n: m**0.5 for n, m in {"big": 4003, "mid": 900, "small": 200, "": 40}.items()}
    weights = {n: round(1000 * m / sum(roots.values())) for n, m in roots.items()}
    check_mix(mixing.mix(docs, block=4).collect(), weights, len(rows))
    assert mixing.mix(docs.limit(0)).count() == 0


@pytest.mark.parametrize("weights", [{"a": 5, "b": 3, "c": 3}, {"a": 10_000, "b": 1}, {"a": 5773, "b": 2000, "c": 1000}])
def test_exact_weights_over_many_frames(spark, weights):
    frames = 12 if sum(weights.values()) < 100 else 2
    docs = spark.createDataFrame([(k, s) for s, w in weights.items() for k in range(w * frames)], "doc_id long, source string")
    assert check_mix(mixing.mix(docs, weights, block=1).collect(), weights, docs.count()) > frames - 1.5


def test_many_small_sources_beside_a_hot_one(spark):
    weights = {"hot": 300} | {f"s{k}": 1 + k % 3 for k in range(200)}
    docs = spark.createDataFrame([(k, s) for s, w in weights.items() for k in range(2 * w)], "doc_id long, source string")
    check_mix(mixing.mix(docs, weights, block=1).collect(), weights, docs.count())


def test_a_bucket_of_one_id_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 5)
    docs = spark.createDataFrame([(None, "a")] * 300 + [(7, "a")] * 100 + [(k, "b") for k in range(100)], "doc_id long, source string").repartition(3)
    check_mix(mixing.mix(docs, {"a": 2, "b": 1}, block=4).collect(), {"a": 2, "b": 1}, 500)


@pytest.mark.parametrize("step", [512, 7])
def test_top_k_equals_brute_force(spark, monkeypatch, step):
    monkeypatch.setattr(inner_products, "STEP", step)
    monkeypatch.setattr(inner_products, "CANDIDATES", 150)
    monkeypatch.setattr(inner_products, "QUERIES", 10)
    r = np.random.default_rng(3)
    rows = [(i, (r.normal(size=20) * r.lognormal()).round(1).tolist()) for i in range(500)] + [(i, [0.0] * 20) for i in range(500, 540)]
    rows += [(600, None), (601, [None] * 20), (602, [float("nan")] * 20), (603, [1.0]), (None, [9.0] * 20), (20, [1.0] * 20)]
    found = {}
    for x in inner_products.top_inner_products(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(2)).orderBy("rank").collect():
        found.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    clean = [(i, np.floor(64 * np.array(v + [0.0] * (20 - len(v)), np.float32).astype(float))) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    for at, (i, q) in enumerate(clean):
        if i % 20 == 0 and i != 20:
            scores = sorted((-int(q @ c), j) for k, (j, c) in enumerate(clean) if k != at)[:20]
            assert found[i] == [(n + 1, j, -s) for n, (s, j) in enumerate(scores)]
    assert len(found[20]) == 40  # a repeated id asks twice


def test_equal_null_rows_of_the_query_are_dealt_out(spark, tmp_path, monkeypatch):
    """Rows that hold nothing but a null id and one source, as the query reads them."""
    monkeypatch.setattr(mixing, "BUCKET", 10)
    spark.createDataFrame([(None, "x", "src0")] * 300 + [(i, "y", "src1") for i in range(20)], "doc_id long, text string, source string").repartition(6).write.parquet(f"file://{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet").select("doc_id", "source")
    dealt, sizes = mixing._dealt(docs, F.col("source"), "doc_id")
    parts = [r.n for r in sizes.where("name = 'src0'").collect()]
    assert len(parts) == 8 and sum(parts) == 300 and max(parts) < 80 and dealt.count() == 320
    rows = mixing.op7_source_mixing(spark, f"file://{tmp_path}").where("source = 'src0'").collect()
    assert sorted(r.mix_block * mixing.BLOCK + r.mix_place for r in rows) == list(range(300))


def test_a_share_of_labels_never_rounds_to_nothing(spark):
    rows = spark.range(2000).select(F.xxhash64("id").alias("h"))
    assert rows.where(toxicity._chosen(F.col("h"), 1e-13)).count() <= 1 and rows.where(toxicity._chosen(F.lit(0).cast("long"), 1e-13)).count() == 2000
    assert 900 < rows.where(toxicity._chosen(F.col("h"), 0.5)).count() < 1100 and rows.where(toxicity._chosen(F.col("h"), 7.0)).count() == 2000


def test_rows_of_one_id_are_bounded_and_repeats_learned_once(spark):
    docs = spark.createDataFrame([(1, f"bad text {i}") for i in range(400)] + [(2, "fine words")] * 300, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, most_rows=20)
    few = toxicity.train(docs.dropDuplicates(), labels, most_rows=20)
    assert model.bias == few.bias and model.weights.tolist() == few.weights.tolist()


def test_a_text_of_megabytes_is_packed_as_the_library_encodes_it(spark):
    r = random.Random(4)
    words = ["alpha", "it's", "Ünder", "12ab", "日本", "x" * 50, "<|endoftext|>", "don't"]
    texts = {1: " ".join(r.choice(words) for _ in range(300_000)), 2: "short"}
    assert len(texts[1]) > 3_000_000
    check_packing(texts, packing.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json")).collect())


def test_least_squares_against_a_plain_solver():
    """Coordinate descent, exactly solved in each step, on small dense problems."""
    rng = np.random.default_rng(1)
    for _ in range(20):
        a = rng.integers(0, 3, (6, 9)).astype(float)
        wanted = rng.integers(0, 50, 6).astype(float)
        x = np.zeros(9)
        for _ in range(3000):
            for j in range(9):
                if (norm := a[:, j] @ a[:, j]) > 0:
                    x[j] = max(0.0, x[j] + a[:, j] @ (wanted - a @ x) / norm)
        rows, columns = np.nonzero(a)
        found = packing.nonnegative_least_squares(rows, columns, a[rows, columns], wanted, 9, rounds=4000)
        assert (found >= 0).all() and np.linalg.norm(a @ found - wanted) <= np.linalg.norm(a @ x - wanted) + 1e-3
