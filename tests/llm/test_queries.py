import pytest

from sparkloom.llm import queries
from tests.oracle import assert_equal

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_oracle(spark, name):
    assert_equal(spark, SF, queries.QUERIES[name], queries.ORACLES[name])


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    assert {int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op")} == set(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", ["op2_url_filter", "op7_source_mixing"])
def test_native_operators_run_no_python(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
