import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import language_model
from sparkloom.llm.language_model import Automaton, Reader, discounts, score_texts

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
END, START = "", None


def tokens(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + [END]


def held_out(key):
    return key is not None and zlib.crc32(str(key).encode()) % 7 == 2


class Plain:
    """The same model by dictionaries of whole n-grams."""

    def __init__(self, rows, order):
        learned = [tokens(text) for key, text in rows if not held_out(key)]
        self.order, self.grams = order, [Counter() for _ in range(order + 1)]
        for words in learned:
            padded = [START, *words]
            for i in range(1, len(padded)):
                for n in range(1, min(order, i + 1) + 1):
                    self.grams[n][tuple(padded[i - n + 1 : i + 1])] += 1
        self.total, self.known = sum(self.grams[1].values()), len(self.grams[1])
        self.followers = defaultdict(list)
        for n in range(2, order + 1):
            for gram, c in self.grams[n].items():
                self.followers[gram[:-1]].append(c)
        self.cuts = {n: discounts(np.array([sum(c == k for c in self.grams[n].values()) for k in (1, 2, 3, 4)])) for n in range(2, order + 1)}

    def p(self, context, word):
        if not context:
            return (self.grams[1][(word,)] + 1) / (self.total + self.known + 1)
        below, seen = self.p(context[1:], word), self.followers.get(context)
        if not seen:
            return below
        cut, c = self.cuts[len(context) + 1], self.grams[len(context) + 1][(*context, word)]
        return (c - cut[min(c, 3)] + sum(cut[min(x, 3)] for x in seen) * below) / sum(seen)

    def rows(self, rows):
        for key, text in rows:
            padded = [START, *tokens(text)]
            score = sum(math.log10(self.p(tuple(padded[max(0, i - self.order + 1) : i]), padded[i])) for i in range(1, len(padded)))
            base = sum(math.log10(self.p((), w)) for w in padded[1:])
            yield key, held_out(key), len(padded) - 1, sum(self.grams[1][(w,)] > 0 for w in padded[1:]), self.total, base, score


def same(found, wanted):
    order = lambda r: repr([*r[:5], round(r[5], 4), round(r[6], 4)])
    found, wanted = sorted(map(tuple, found), key=order), sorted(wanted, key=order)
    assert len(found) == len(wanted)
    for a, b in zip(found, wanted, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


def test_query_equals_the_plain_model(spark):
    from sparkloom.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = QUERIES["op12_lm_scoring"](spark, SF)
    assert found.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    same(found.collect(), Plain(rows, 3).rows(rows))


def corpus(seed, n=120):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(random.choices(vocabulary, [1 / (k + 1) for k in range(40)], k=random.choice([0, 1, 2, 30, 700])))) for i in range(n)]
    return rows + [(n + i, rows[i % 5][1]) for i in range(30)] + [(None, "null id w1"), (None, None), (7, ""), (8, " \t "), (9, "new Words W1 w1"), (9, "x" * 5000 + " w1 w2"), (-3, "unseen unheard w1 w2 w3")]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_odd_rows_in_small_blocks_and_parts_of_contexts(spark, monkeypatch, order):
    monkeypatch.setattr(language_model, "BLOCK_BYTES", 4000)
    rows = corpus(order)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    same(score_texts(docs, order=order).collect(), Plain(rows, order).rows(rows))


def test_common_contexts_are_dealt_to_parts(monkeypatch):
    """Followers of a context in several parts give the sums that one part would."""
    monkeypatch.setattr(language_model, "PART", 100)
    context, word = np.array([5, 5, 5, 7, -1, 5]), np.array([1, 2, 0, 1, 3, 2])
    pairs = language_model.Pairs.of(context, np.array([950, 950, 950, 3, 0, 950]), word, np.array([True, True, False, True, True, True]), 4)
    import pyarrow as pa

    rows = language_model._rows_asked(0, pairs.ask(), 0)
    table = pa.Table.from_batches([rows])
    replies = pa.concat_tables([language_model._meet_pairs(table.filter(pa.compute.equal(table["bucket"], b)), 4, 2, True) for b in set(table["bucket"].to_pylist())])
    cut = np.array([0.0, 0.5, 10.0, 100.0])
    count, number, rest = pairs.told(replies.filter(pa.compute.greater_equal(replies["block"], 0)), True, cut)
    assert (pairs.part > 0).any() and count[pairs.which[[0, 1, 2, 3, 5]]].tolist() == [1, 2, 0, 1, 2] and pairs.which[4] == -1
    assert rest[pairs.which[0]] == 10.5 and rest[pairs.which[3]] == 0.5 and number[pairs.which[1]] > 0


def test_probabilities_of_all_words_add_up_to_one():
    rows = corpus(9)
    plain = Plain(rows, 3)
    words = [w for (w,) in plain.grams[1]] + ["never seen"]
    for context in ((), ("w0",), (START,), ("w0", "w1"), (START, "w0"), ("w39", "w38"), ("never", "seen")):
        assert sum(plain.p(context, w) for w in words) == pytest.approx(1, abs=1e-9)


def test_empty_tables_clashing_columns_and_other_ids(spark):
    docs = spark.createDataFrame([("a", "x y", 1), ("b", "x y", 2)], "doc_id string, text string, score int")
    assert [r.n_tokens for r in score_texts(docs).collect()] == [3, 3]
    assert score_texts(docs.limit(0)).count() == 0
    from pyspark.sql import functions as F

    assert score_texts(docs, apart=F.lit(True)).select("train_tokens", "base_score", "score").distinct().collect() == [(0, 0.0, 0.0)]


def test_held_out_texts_gain_from_context(spark):
    rows = score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out AND n_tokens > 50").collect()
    assert len(rows) > 50 and sum(r.score > r.base_score for r in rows) > 0.85 * len(rows)


def test_blocks_stay_where_they_are(spark):
    plan = score_texts(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=40), min_size=1, max_size=6), st.integers(1, 7))
def test_lanes_give_what_one_walk_gives(texts, lane):
    """An automaton over six words whose states are the last word or the last two."""
    pairs = {ab: 8 + i for i, ab in enumerate((a, b) for a in range(6) for b in range(6) if (a + b) % 2)}
    arcs = {(2 + a) * 6 + b: s for (a, b), s in pairs.items()}
    arcs |= {s * 6 + c: pairs[b, c] for (a, b), s in pairs.items() for c in range(6) if (b, c) in pairs and (a + c) % 3 == 0}
    rng = np.random.default_rng(0)
    order = sorted(arcs)
    words, bounds = np.array([w for t in texts for w in t], np.int64), np.cumsum([0, *map(len, texts)])
    hints = np.full((2, len(words)), -1)
    for low, high in zip(bounds[:-1], bounds[1:]):
        for i in range(low + 1, high):
            hints[0, i] = order.index(k) if (k := (2 + words[i - 1]) * 6 + words[i]) in arcs else -1
            if i > low + 1 and tuple(words[i - 2 : i].tolist()) in pairs:
                hints[1, i] = order.index(k) if (k := pairs[tuple(words[i - 2 : i].tolist())] * 6 + words[i]) in arcs else -1
    failure = np.r_[0, 0, np.zeros(6, int), [2 + b for _, b in pairs]]
    depth = np.r_[0, np.ones(7, int), np.full(len(pairs), 2)]
    machine = Automaton(rng.random(6), 2 + np.arange(6), depth, hints, rng.random(len(arcs)), np.array([arcs[k] for k in order]), failure, rng.random(len(failure)))

    def walk(low, high):
        at, total = 1, 0.0
        for i in range(low, high):
            while machine.depth[at] and (at * 6 + words[i]) not in arcs:
                total, at = total + machine.failure_weight[at], machine.failure[at]
            if machine.depth[at]:
                k = order.index(at * 6 + words[i])
                total, at = total + machine.arc_weight[k], machine.arc_state[k]
            else:
                total, at = total + machine.word_weight[words[i]], machine.word_state[words[i]]
        return total

    old, language_model.LANE = language_model.LANE, lane
    try:
        assert machine.traverse(words, bounds, 1, 2) == pytest.approx([walk(a, b) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())])
    finally:
        language_model.LANE = old


@given(st.lists(st.integers(0, 2**62), max_size=30), st.lists(st.integers(0, 255), max_size=30))
def test_packed_integers_come_back(a, b):
    read = Reader(Reader.joined(np.array(a, np.int64), np.array(b, np.int64)))
    assert read.next().tolist() == a and read.next().tolist() == b
