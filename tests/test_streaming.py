import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import intake, rules
from sparkloom.streaming import outbox, state

KINDS = "who string, item string, t long, action string"


def run(spark, stream, folder, batch):
    stream.writeStream.option("checkpointLocation", f"file://{folder}/cp").trigger(availableNow=True).foreachBatch(batch).start().awaitTermination(120)


def baskets(tmp_path):
    return state.VersionedState(f"file://{tmp_path}/state", ("who", "item"), "since long", 8)


def test_basket_state_equals_the_batch(spark, tmp_path):
    """Two batches: insertions, a repeated one, a removal, one of what isn't there, and an insertion after it."""
    batches = [[("u", "a", 1, "add"), ("u", "a", 2, "add"), ("u", "b", 3, "add"), ("v", "a", 4, "remove"), (None, "a", 5, "add")], [("u", "a", 6, "remove"), ("u", "b", 7, "add"), ("u", "a", 9, "add"), ("u", "a", 8, "add"), ("v", "c", 10, "remove"), ("v", "c", 10, "add")]]
    held = baskets(tmp_path)
    for rows in batches:
        spark.createDataFrame(rows, KINDS).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        changes = spark.readStream.schema(KINDS).parquet(f"file://{tmp_path}/in")
        run(spark, changes, tmp_path, lambda rows, number: state.merge_basket(held, rows, number, "who", "item", "t", "action"))
    whole = intake.basket(spark.createDataFrame(sum(batches, []), KINDS), "who", "item", "t", F.col("action"))
    assert {(r.who, r.item): r.since for r in held.rows(spark, "who string, item string").collect()} == {("u", "a"): 8, ("u", "b"): 3, (None, "a"): 5} == {(r.who, r.item): r.added for r in whole.collect()}


def test_many_batches_and_batches_run_again(spark, tmp_path):
    random.seed(1)
    rows = [(random.choice("abc"), random.choice("xyz") * random.randint(1, 3), t, random.choice(["add", "add", "remove"])) for t in range(120)]
    held = baskets(tmp_path)
    for number in range(4):
        part = spark.createDataFrame(rows[30 * number : 30 * number + 30], KINDS)
        for _ in range(2 if number == 2 else 1):
            state.merge_basket(held, part, number, "who", "item", "t", "action")
    state.merge_basket(held, part.limit(0), 4, "who", "item", "t", "action")
    whole = intake.basket(spark.createDataFrame(rows, KINDS), "who", "item", "t", F.col("action"))
    assert {(r.who, r.item, r.since) for r in held.rows(spark, "who string, item string").collect()} == {(r.who, r.item, r.added) for r in whole.collect()}


def test_all_items_of_a_bucket_may_go(spark, tmp_path):
    held = state.VersionedState(f"file://{tmp_path}/state", ("who", "item"), "since long", 1)
    for number, action in enumerate(["add", "remove", "add"]):
        state.merge_basket(held, spark.createDataFrame([("u", "a", number, action)], KINDS), number, "who", "item", "t", "action")
        assert [r.since for r in held.rows(spark, "who string, item string").collect()] == {"add": [number], "remove": []}[action]


def test_first_holders_over_batches_equal_duplicates(spark, tmp_path):
    rows = [(i, random.Random(i).choice(["en", "ar", None]), random.Random(-i).choice(["A", "B", "C", None])) for i in range(60)]
    kinds = "page int, lang string, title string"
    held = state.VersionedState(f"file://{tmp_path}/state", ("lang", "title"), "first int", 4)
    found = []
    for number in range(3):
        part = spark.createDataFrame(rows[20 * number : 20 * number + 20], kinds)
        for _ in range(2 if number == 1 else 1):
            last = state.merge_first_holders(held, part, number, "title", ["lang"], "page").collect()
        found += last
    whole = rules.duplicates(spark.createDataFrame(rows, kinds), "title", ["lang"], "page")
    assert found and sorted(map(tuple, found), key=repr) == sorted(map(tuple, whole.select("lang", "title", "page", "first_key").collect()), key=repr)


def test_outbox_hands_nothing_over_twice(spark, tmp_path):
    ledger, sent = outbox.Outbox(f"file://{tmp_path}/ledger"), []

    def send(rows):
        got = [(r.submission_id, r.attempt) for r in rows.collect()]
        sent.extend(got)
        return spark.createDataFrame([(i, {"late": 200, "no": 500}.get(i, 200), 7001 if i == "late" else 10) for i, _ in got], "submission_id string, http int, millis int")

    batch = lambda *ids: spark.createDataFrame([(i,) for i in ids], "submission_id string")
    auto = F.lit("auto")
    ledger.deliver(batch("a", "late", "no", "a"), 0, auto, send)
    ledger.deliver(batch("a", "late", "no", "a"), 0, auto, send)
    assert sorted(sent) == [("a", 1), ("late", 1), ("no", 1)]
    ledger.deliver(batch("no", "a", "b"), 1, auto, send)
    assert sorted(sent[3:]) == [("b", 1), ("no", 2)]
    ledger.deliver(batch("m"), 2, F.lit("whatsapp"), send)
    assert len(sent) == 5

    def breaks(rows):
        send(rows)
        raise RuntimeError("cut off after the hand-over")

    with pytest.raises(RuntimeError):
        ledger.deliver(batch("x"), 3, F.lit("api"), breaks)
    ledger.deliver(batch("x"), 3, F.lit("api"), send)
    assert sent[5:] == [("x", 1)]
    found = {(r.submission_id, r.attempt): (r.answer, r.outcome) for r in ledger.attempts(spark).collect()}
    assert found == {("a", 1): ("ok", "delivered"), ("late", 1): ("late", "handed_off"), ("no", 1): ("refused", "handed_off"), ("no", 2): ("refused", "handed_off"), ("b", 1): ("ok", "delivered"), ("m", 1): ("none", "handed_off"), ("x", 1): ("none", "failed")}
    assert {(r.submission_id, r.attempts) for r in ledger.hand_offs(spark).collect()} == {("late", 1), ("no", 2), ("m", 1)}
