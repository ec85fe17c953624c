import json

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import intake
from sparkloom.streaming import intake as streaming

NOW = 1_000_000
FIELDS = {"name": "n", "phone": "p", "vehicle": "v", "message": "m"}


def body(**changes):
    return json.dumps({"ref": "R", "type": "General Quote", "fields": FIELDS} | changes)


CASES = {
    "get": ({"method": "GET"}, 405, "method_not_allowed"),
    "honeypot": ({"body": body(website="x")}, 202, "accepted"),
    "honeypot of spaces": ({"body": body(website="  ")}, 200, "accepted"),
    "other origin": ({"origin": "https://evil.example"}, 403, "origin_not_allowed"),
    "own origin": ({"origin": "https://WWW.x.org/a"}, 200, "accepted"),
    "no url": ({"origin": "nonsense"}, 403, "origin_not_allowed"),
    "too long": ({"content_length": "32001"}, 413, "payload_too_large"),
    "just right": ({"content_length": "32000"}, 200, "accepted"),
    "length not a number": ({"content_length": "abc"}, 200, "accepted"),
    "broken json": ({"body": "{"}, 400, "invalid_json"),
    "array": ({"body": "[1]"}, 400, "invalid_payload"),
    "null": ({"body": "null"}, 400, "invalid_payload"),
    "empty body": ({"body": ""}, 400, "missing_or_invalid_required_fields"),
    "too fast": ({"body": body(startedAt=NOW - 1199)}, 429, "submission_too_fast"),
    "slow enough": ({"body": body(startedAt=NOW - 1200)}, 200, "accepted"),
    "from the future": ({"body": body(startedAt=NOW + 5)}, 429, "submission_too_fast"),
    "no start": ({"body": body(startedAt=0)}, 200, "accepted"),
    "start not a number": ({"body": body(startedAt="soon")}, 200, "accepted"),
    "only a name": ({"body": body(fields={"name": "n"})}, 400, "missing_or_invalid_required_fields"),
    "message elsewhere": ({"body": body(fields={"name": "n", "phone": "p", "vehicle": "v", "modifications": "m"})}, 200, "accepted"),
    "type by pattern": ({"body": body(type="Fuel & Air (E85) Enquiry")}, 200, "accepted"),
    "type in other letters": ({"body": body(type="طلب Enquiry")}, 400, "missing_or_invalid_required_fields"),
    "text after the value": ({"body": body() + " junk"}, 400, "invalid_json"),
    "a bracket that closes too much": ({"body": body() + "] x"}, 400, "invalid_json"),
    "two values": ({"body": body() + "," + body()}, 400, "invalid_json"),
    "a value and null": ({"body": body() + ",null"}, 400, "invalid_json"),
    "brace and member": ({"body": body() + ',"b":1'}, 400, "invalid_json"),
    "white space around": ({"body": " \n" + body(extra=[1, {"a": []}]) + "\t "}, 200, "accepted"),
    "text": ({"body": '"x"'}, 400, "invalid_payload"),
    "blanks": ({"body": "  "}, 400, "invalid_json"),
    "a repeated key": ({"body": body().replace('"ref"', '"ref": "", "ref"', 1)}, 200, "accepted"),
    "a repeated key, blank at last": ({"body": body()[:-1] + ', "ref": ""}'}, 400, "missing_or_invalid_required_fields"),
    "website as an empty list": ({"body": body(website=[])}, 200, "accepted"),
    "website as a list of null": ({"body": body(website=[None])}, 200, "accepted"),
    "website as two nulls": ({"body": body(website=[None, None])}, 202, "accepted"),
    "website zero": ({"body": body(website=0)}, 202, "accepted"),
    "website null": ({"body": body(website=None)}, 200, "accepted"),
    "message zero": ({"body": body(fields=FIELDS | {"message": 0})}, 400, "missing_or_invalid_required_fields"),
    "message zero, then another": ({"body": body(fields=FIELDS | {"message": 0, "modifications": "m"})}, 200, "accepted"),
    "the last fallback counts as it is": ({"body": body(fields=FIELDS | {"message": False, "engineDetails": 0})}, 200, "accepted"),
    "message an empty list": ({"body": body(fields=FIELDS | {"message": [], "modifications": "m"})}, 400, "missing_or_invalid_required_fields"),
    "name a number": ({"body": body(fields=FIELDS | {"name": 0})}, 200, "accepted"),
    "started as text": ({"body": body(startedAt=f" {NOW - 1} ")}, 429, "submission_too_fast"),
    "started as a Java number": ({"body": body(startedAt=f"{NOW - 1}d")}, 200, "accepted"),
    "started true": ({"body": body(startedAt=True)}, 200, "accepted"),
    "started as a list": ({"body": body(startedAt=[NOW - 1])}, 429, "submission_too_fast"),
    "length infinite": ({"content_length": "Infinity"}, 413, "payload_too_large"),
    "type with a line feed": ({"body": body(type="General Quote\nx Enquiry")}, 400, "missing_or_invalid_required_fields"),
    "fields not an object": ({"body": body(fields=[1])}, 400, "missing_or_invalid_required_fields"),
}


@pytest.fixture(scope="module")
def decided(spark):
    base = {"method": "POST", "host": "www.x.org", "origin": None, "content_length": "10", "body": body()}
    rows = [{"submission_id": name} | base | changes for name, (changes, _, _) in CASES.items()]
    found = intake.decide(spark.createDataFrame(rows, intake.SUBMISSION), F.lit(NOW))
    return {r.submission_id: (r.status, r.code) for r in found.collect()}


@pytest.mark.parametrize("name", CASES)
def test_decision(decided, name):
    assert decided[name] == CASES[name][1:]


def test_backend_missing(spark):
    row = spark.createDataFrame([("1", "POST", "", None, None, body())], intake.SUBMISSION)
    assert intake.decide(row, F.lit(NOW), F.lit(False)).first().status == 503


def test_merged_fields_drop_blanks_and_reserved(spark):
    rows = spark.createDataFrame([(1, "a", "", 0), (1, "a", "x", 1), (1, "a", "y", 2), (1, "website", "w", 3), (1, "b", None, 4)], "id int, name string, value string, pos int")
    assert {(r.name, r.value) for r in intake.merged_fields(rows, "id").collect()} == {("a", "x, y"), ("b", "")}


def fields_of(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    found = sorted(intake.field_rows(rows, "id", F.col("body")).collect(), key=lambda r: (r.id, r.pos))
    assert [r.pos for r in found if r.id == 0] == list(range(sum(r.id == 0 for r in found)))
    return [(r.name, r.value) for r in found if r.id == 0] if len(texts) == 1 else [(r.id, r.name, r.value) for r in found]


def test_field_rows_are_at_most_eighty(spark):
    rows = fields_of(spark, json.dumps({"fields": {f"k{i}": "" if i == 2 else "v" for i in range(1, 101)}}))
    assert len(rows) == 80 and "k2" not in {name for name, _ in rows} and rows[0] == ("k1", "v")


def test_field_rows_keep_types_and_order(spark):
    fields = {"z": '["a"]', "list": ["a", 1, None, [2, [3]], {"x": 1}, True], "n": 1.5, "whole": 2.0, "large": 1e20, "larger": 1.5e300, "small": 1e-6, "smaller": -2.5e-7, "third": 0.333, "zero": 0, "no": False, "none": None, "empty": "", "blank": [], "object": {}, "website": "w", "startedAt": 1, "b": " x\x01 ", "10": "ten", "9": "nine", "01": "text"}
    assert fields_of(spark, json.dumps({"fields": fields})) == [
        ("9", "nine"), ("10", "ten"), ("z", '["a"]'), ("list", "a, 1, , 2,3, [object Object], true"), ("n", "1.5"), ("whole", "2"), ("large", "100000000000000000000"), ("larger", "1.5e+300"), ("small", "0.000001"), ("smaller", "-2.5e-7"), ("third", "0.333"), ("blank", ""), ("object", "[object Object]"), ("b", "x"), ("01", "text"),
    ]


def test_field_rows_of_repeated_names_and_broken_bodies(spark):
    assert fields_of(spark, '{"fields":{"a":"1","b":"2","a":["3"]}}') == [("a", "3"), ("b", "2")]
    good = '{"fields":{"a":"1"}}'
    assert fields_of(spark, good + " x", good, "", '{"fields":["a"]}', '{"fields":"a"}', "[1]", "null", good + "]", '{"fields":{}}') == [(1, "a", "1")]


def test_basket(spark):
    rows = spark.createDataFrame([(1, "a", "add"), (2, "a", "add"), (3, "b", "add"), (4, "a", "remove"), (5, "a", "add"), (6, "b", "remove")], "t int, item string, action string").withColumn("who", F.lit("u"))
    assert [(r.item, r.added) for r in intake.basket(rows, "who", "item", "t", F.col("action")).collect()] == [("a", 5)]


def test_stream_decides_as_the_batch_does(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    (folder / "1.json").write_text("\n".join(json.dumps({"submission_id": str(i), "method": m, "host": "h", "content_length": "1", "body": body()}) for i, m in enumerate(["POST", "GET"])))
    seen = []
    stream = streaming.decided_stream(streaming.submission_stream(spark, str(folder)), F.lit(NOW))
    query = streaming.deliver(stream, f"file://{out}", f"file://{tmp_path}/cp", lambda rows, number: seen.append(rows.count()))
    assert query.awaitTermination(120)
    assert {(r.submission_id, r.status) for r in spark.read.option("basePath", f"file://{out}").parquet(f"file://{out}/*").collect()} == {("0", 200), ("1", 405)} and sum(seen) == 1


def test_delivery_failure_and_reference(spark):
    body = '{"ref":"R1","type":"General Quote","fields":{"name":"n","phone":1,"vehicle":"v","message":"m"}}'
    rows = spark.createDataFrame([("1", "POST", "h", "", "9", body, True), ("2", "POST", "h", "", "9", body, False), ("3", "GET", "h", "", "9", body, True)], "submission_id string, method string, host string, origin string, content_length string, body string, sent boolean")
    found = {r.submission_id: (r.status, r.code, r.ref) for r in intake.decide(rows, F.lit(0), delivered=F.col("sent")).collect()}
    assert found == {"1": (200, "accepted", "R1"), "2": (502, "delivery_failed", None), "3": (405, "method_not_allowed", None)}


def test_lists_blanks_and_attached_names(spark):
    entries = spark.createDataFrame([("f", "x", "", 0), ("f", "x", " a ", 1), ("f", "x", "", 2), ("f", "x", "b", 3), ("f", "y", "", 4), *(("f", "files", f"n{k}", 10 + k) for k in range(20))], "form string, name string, value string, pos int")
    assert {r.name: r.value for r in intake.merged_fields(entries, "form").collect()} == {"x": "a, , b", "y": ""}
    assert intake.attached_names(entries, "form").first().names == [f"n{k}" for k in range(15)]


def test_submitted_fields_add_what_the_form_knows(spark):
    entries = spark.createDataFrame([(1, "x", "", 0), (1, "x", "b", 1), (1, "context", "own", 2), (2, "context", "own", 0), (1, "files", "f", 3), (1, "website", "w", 4)], "form int, name string, value string, pos int")
    forms = spark.createDataFrame([(1, "General Quote", "page", None, "u"), (2, "Other", "", "pl", "u"), (3, "General Quote", None, None, "v")], "form int, kind string, context string, platform string, who string")
    items = spark.createDataFrame([("u", "Part", "B", "2", 5), ("u", "Part", "A", "1", 2)], "who string, kind string, title string, details string, pos int")
    found = sorted(map(tuple, intake.submitted_fields(entries, forms, items, "form", "who").collect()))
    assert found == [(1, "context", 1, "page"), (1, "files", 1, "f"), (1, "selectedItems", 1, "Part: A — 1"), (1, "selectedItems", 2, "Part: B — 2"), (1, "x", 1, "b"), (2, "context", 1, "own"), (2, "platform", 1, "pl")]
