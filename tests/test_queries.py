"""Every registered query against its SQL in DuckDB, and what the plans may not contain."""

from __future__ import annotations

import re

import pytest
from conftest import DATA
from oracle import connect, differences

import __spark_entry__ as registered

SMALL = f"{DATA}/sf0.001"
QUERIES, SQL = registered.queries(), registered.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|ArrowEvalPython", plan)
    if name in SQL:
        assert differences(df, duck, SQL[name]) == []
    else:
        assert df.count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert registered.entry(spark).count() == 30


def test_row_rules_share_one_scan(spark):
    from plumbline import Rule, validate

    df = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    rules = [Rule("A", "l_tax", "positive"), Rule("B", "l_tax", "range", params={"max": 1}), Rule("C", "l_quantity", "numeric")]
    plan = validate(df, rules).rule_results._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet", plan)) == 1
    assert "l_tax" in plan and "l_comment" not in plan and "l_shipdate" not in plan  # only the columns of the rules


def test_row_violations_do_not_shuffle(spark):
    from plumbline import Rule, validate

    df = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    rules = [Rule("A", "l_tax", "positive"), Rule("B", "l_quantity", "range", params={"max": 10})]
    plan = validate(df, rules, key=["l_orderkey", "l_linenumber"]).violations._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and len(re.findall(r"FileScan parquet", plan)) == 1
