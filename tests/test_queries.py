import pytest

from sparkloom import registry
from tests.oracle import assert_equal

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_oracle(spark, name):
    assert_equal(spark, SF, registry.QUERIES[name], registry.ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())


def test_or_join_is_not_a_nested_loop(spark):
    plan = registry.QUERIES["related_top3"](spark, SF)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = registry.QUERIES["search_documents"](spark, SF)._jdf.queryExecution().toString()
    assert "EqualTo(lang,en)" in plan and "n_chars" not in plan.split("Physical Plan")[-1]
