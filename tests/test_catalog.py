"""Every registered query against its SQL on the smallest tables."""

import pytest

import check
from catalog import all_queries, all_sql

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


def test_entry(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(all_queries()))
def test_query(spark, con, name):
    df = all_queries()[name](spark, SF)
    plan = plan_of(df)
    # No free pairing of rows, and no Python row by row.
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert unwanted not in plan
    assert check.compare(spark, con, lambda *_: df, all_sql().get(name), SF) is None


def test_every_query_has_sql():
    assert set(all_sql()) == set(all_queries())


def test_scans_read_only_what_is_used(spark):
    plan = plan_of(all_queries()["emotion_hits"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in plan
    assert "PushedFilters: [IsNotNull(source)]" in plan
