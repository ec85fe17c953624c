import random

import pytest

import corpus_pipeline
from sparkloom.llm import near_texts
from tests.llm import brute


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def near(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def corpus():
    """Copies whose similarity lies around 0.8, chains of them, and a passage that many share."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    texts = [None, "", " \n", "one two", "One  two", "one two three four five six"]
    for _ in range(40):
        w = [word() for _ in range(r.choice([12, 40, 90, 200]))]
        for _ in range(6):
            texts.append(" ".join(w))
            w = w[:]
            for _ in range(max(1, round(len(w) * r.choice([0.01, 0.02, 0.03, 0.04])))):
                w[r.randrange(len(w))] = word()
    passage = " ".join(word() for _ in range(40))
    texts += [f"{passage} {' '.join(word() for _ in range(r.randint(2, 30)))}" for _ in range(60)]
    return dict(enumerate(r.sample(texts, len(texts))))


@pytest.mark.parametrize("group", [1024, 7])
def test_stage_keeps_one_of_each_group_at_exactly_four_fifths(spark, monkeypatch, group):
    monkeypatch.setattr(near_texts, "GROUP", group)
    docs = corpus()
    sets = {i: shingles(t) for i, t in docs.items()}
    groups = brute.components(docs, lambda a, b: near(sets[a], sets[b]))
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates_out(spark, rows, "").collect()}
    assert kept == set(groups.values())


def test_odd_rows(spark):
    text = " ".join(f"word{i}" for i in range(120))
    rows = spark.createDataFrame([(3, text), (2, text), (2, text), (9, text + " tail"), (None, text), (4, "quite another text of its own"), (None, None), (8, "")], "doc_id long, text string")
    assert sorted(r.doc_id for r in near_texts.one_of_each(rows, 5, (4, 5)).collect()) == [2, 4, 8]
    assert near_texts.one_of_each(rows.where("false"), 5, (4, 5)).count() == 0
