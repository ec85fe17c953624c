import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import lexical_search
from sparkloom.llm.lexical_search import RangeMaxima, index, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    """The scores of all documents, as the contract states them."""
    held = [(key, Counter(terms(text))) for key, text in docs]
    n, length = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for t, x in df.items()}
    out = []
    for item, text in items:
        scores = []
        for key, c in held:
            m = 10 + 90 * sum(c.values()) * n // max(length, 1)
            score = sum(weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scores.append((-score, key is None, key))
        out += [(item, rank + 1, key, -score) for rank, (score, _, key) in enumerate(sorted(scores)[:k])]
    return out


def found(spark, docs, items, k=10, parts=3):
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts) if docs else spark.createDataFrame([], "doc_id long, text string")
    return sorted(map(tuple, search(index(table), spark.createDataFrame(items, "item_id long, text string"), k).collect()), key=repr)


def corpus(seed, n):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Straße", "日本", "x1y"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(i, " ".join(random.choices(vocabulary, weights, k=random.choice([0, 1, 5, 40, 200])))) for i in range(n)]
    docs += [(n + i, docs[i % 3][1]) for i in range(40)]  # copies, whose scores tie
    items = [(i, " ".join(random.choices(vocabulary, weights, k=8))) for i in range(12)]
    return docs, items


@pytest.mark.parametrize("shard_bytes", [300, 4 << 20])
def test_equals_brute_force_with_ties_over_shards_of_any_size(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(lexical_search, "SHARD_BYTES", shard_bytes)
    docs, items = corpus(1, 250)
    assert found(spark, docs, items) == sorted(brute(docs, items), key=repr)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "..."), (4, "Alpha beta"), (4, "Alpha beta"), (None, "ALPHA"), (5, "alpha " * 30_000), (-7, "alpha"), (8, "gamma\x00alpha\x7fÀlpha")]
    items = [(1, "alpha ALPHA Àlpha"), (1, "beta"), (None, "gamma delta"), (2, None), (3, ""), (4, "nothing here")]
    assert found(spark, docs, items) == sorted(brute(docs, items), key=repr)
    assert found(spark, docs, items, k=2) == sorted(brute(docs, items, 2), key=repr)


def test_empty_tables_and_clashing_columns(spark):
    items = spark.createDataFrame([(1, "a", 0, 0)], "item_id long, text string, number int, rank int")
    assert search(index(spark.createDataFrame([], "doc_id long, text string")), items).count() == 0
    docs = spark.createDataFrame([(1, "a b", 0, 0)], "doc_id long, text string, shard int, score int")
    assert search(index(docs), items).count() == 1
    assert search(index(docs), items.limit(0)).count() == 0


def test_items_in_several_passes(spark, monkeypatch):
    docs, items = corpus(2, 80)
    whole = found(spark, docs, items)
    monkeypatch.setattr(lexical_search, "ITEM_BYTES", 200)
    assert found(spark, docs, items) == whole == sorted(brute(docs, items), key=repr)


def test_splits_score_few_documents_of_a_large_shard(spark):
    """One document holds all of the item's rare terms: the bounds must keep the search from most others."""
    random.seed(5)
    docs = [(i, " ".join(random.choices(["a", "b", "c", "d"], k=20))) for i in range(2000)] + [(5000, "rare words of one item a b"), (5001, "rare words of one")]
    shards = index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).toArrow()
    table = spark.createDataFrame([(1, "rare words of one item a b", 0)], "item long, text string, number long").toArrow()
    items = lexical_search.Items.of(table)
    best = lexical_search.Best.nothing(1, 2)
    scored = 0
    for filled, held, words, postings, who in zip(*(shards[x] for x in ("filled", "held", "words", "postings", "who")), strict=True):
        df = np.zeros(len(items.one), np.int64)
        term, _, size = items.found(words)
        df[term] = size
        weights = np.floor(1000 * np.log((2 * 2002 + 2) / (2 * df + 1))).astype(np.int64)
        scored += lexical_search.search_shard(items, weights, filled.as_py(), held.as_py(), words, postings, who, best)
    assert best.id[0].tolist() == [5000, 5001] and scored < 100


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=60), st.data())
def test_range_maxima(values, data):
    values = np.array(values)
    maxima = RangeMaxima(values, len(values))
    pairs = [sorted((data.draw(st.integers(0, len(values) - 1)), data.draw(st.integers(0, len(values) - 1)))) for _ in range(5)]
    low, high = np.array([a for a, _ in pairs]), np.array([b + 1 for _, b in pairs])
    at = maxima.places(low, high)
    assert ((low <= at) & (at < high)).all() and values[at].tolist() == [max(values[a:b]) for a, b in zip(low, high)]
