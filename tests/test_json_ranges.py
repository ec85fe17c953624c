import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sparkloom.sources import json_ranges
from sparkloom.sources.json_ranges import _Reader, json_parts
from sparkloom.sources.tables import json_catalog

TRICKY = ['a"b', "\\", '\\"', "],[", "{,}", 'x\\\\"', "é😀", "", "\n\t", '"' * 7, "\\" * 9]
values = st.recursive(st.none() | st.booleans() | st.integers() | st.sampled_from(TRICKY) | st.text(max_size=8), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.sampled_from(TRICKY), x, max_size=3), max_leaves=12)


def read(path, size):
    """What the two passes give, without Spark."""
    first = _Reader({"path": path, "range_bytes": size})
    rows = [r for part in first.partitions() for r in first.read(part)]
    states, now = {}, {}
    json_ranges.put_together(rows, states, now)
    second = _Reader({"path": path, "range_bytes": size, "states": json.dumps(states)})
    return [r[1:] for part in second.partitions() for r in second.read(part)]


@settings(max_examples=250, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(values, max_size=6) | st.dictionaries(st.sampled_from(TRICKY), values, max_size=6), st.integers(1, 40), st.sampled_from([None, 1]), st.booleans())
def test_any_document_in_ranges_of_any_size(tmp_path, document, size, indent, ascii_only):
    path = tmp_path / "one.json"
    path.write_text("  " + json.dumps(document, indent=indent, ensure_ascii=ascii_only) + "\n", encoding="utf-8")
    found = read(str(path), size)
    assert [r[0] for r in found] == list(range(len(document)))
    if isinstance(document, dict):
        assert [(name, json.loads(value)) for _, name, value in found] == list(document.items())
    else:
        assert [json.loads(value) for _, _, value in found] == document and all(name is None for _, name, _ in found)


@pytest.mark.parametrize("text", ["", " ", "[]", "{}", "7", '"a,b"', "[ \n ]"])
def test_nothing_to_read(tmp_path, text):
    (tmp_path / "one.json").write_text(text)
    assert read(str(tmp_path / "one.json"), 3) == []


def test_several_tasks_read_one_list_in_order(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"id": i, "tags": ["],", str(i)], "deep": {"x": "\\" * (i % 5)}} for i in range(3000)]
    (tmp_path / "in" / "a.json").write_text(json.dumps(rows))
    (tmp_path / "in" / "b.json").write_text(json.dumps([{"id": -1}, "no object", {"id": -2}]))
    parts = json_parts(spark, f"file://{tmp_path}/in", 5000)
    assert parts.rdd.getNumPartitions() > 10
    one = json_catalog(spark, f"file://{tmp_path}/in/a.json", "id int, tags array<string>, deep struct<x:string>", 5000).orderBy("pos").collect()
    assert [(r.pos, r.id, r.tags, r.deep.x) for r in one] == [(i, r["id"], r["tags"], r["deep"]["x"]) for i, r in enumerate(rows)]
    assert [r.id for r in json_catalog(spark, f"{tmp_path}/in/b.json", "id int").orderBy("pos").collect()] == [-1, None, -2]


def test_tasks_read_many_ranges_and_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(30):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps([{"id": 100 * k + i, "s": '],"'} for i in range(100 if k else 0)]))
    (tmp_path / "in" / "_out.json").write_text("[1]")
    parts = json_parts(spark, f"file://{tmp_path}/in", 64)
    assert parts.rdd.getNumPartitions() < 50  # of some 1,000 ranges
    rows = parts.selectExpr("regexp_extract(path, '([0-9]+).json', 1) AS k", "pos", "value").collect()
    assert sorted((int(r.k), r.pos, json.loads(r.value)["id"]) for r in rows) == [(k, i, 100 * k + i) for k in range(1, 30) for i in range(100)]
