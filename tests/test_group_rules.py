"""`aggregate` rules: bounds per group and at every roll-up level."""

from __future__ import annotations

import random
import re
from collections import defaultdict
from itertools import combinations

import pytest

from plumbline import Rule, validate
from plumbline.operators.group_rules import levels_of

ROWS = [("x", 1, 10.0), ("x", 1, 5.0), ("x", None, -2.0), (None, 2, None), (None, 2, float("nan")), ("y", 2, 7.5)]


def judged(df, column="v", **params):
    run = validate(df, [Rule("R", column, "aggregate", params=params)], run_id="r")
    result = run.rule_results.first()
    found = {(r.level, tuple(r.group)): r.value for r in run.group_violations.collect()}
    assert result.status == "ok" and result.failed_count == len(found) and result.passed == (not found)
    return result, found


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "g string, h int, v double")


def test_sums_roll_up(rows):
    result, found = judged(rows, measure="sum", by=["g", "h"], levels="rollup", min=0, max=12)
    assert result.total_rows == 4 + 3 + 1
    assert found == {("g,h", ("x", "1")): 15.0, ("g,h", ("x", None)): -2.0, ("g", ("x",)): 13.0, ("", ()): 20.5}


def test_null_is_a_group_and_not_the_total(rows):
    _, found = judged(rows, column="_all", measure="count", by=["g", "h"], levels="cube", max=1)
    assert found == {
        ("g,h", ("x", "1")): 2, ("g,h", (None, "2")): 2, ("g", ("x",)): 3, ("g", (None,)): 2,
        ("h", ("1",)): 2, ("h", ("2",)): 3, ("", ()): 6,
    }


def test_missing_values_are_not_measured(rows):
    assert judged(rows, measure="mean", by="g", min=100)[1] == {("g", ("x",)): 13 / 3, ("g", ("y",)): 7.5}
    assert judged(rows, measure="count", by="g", max=0)[1] == {("g", ("x",)): 3, ("g", ("y",)): 1}
    assert judged(rows, measure="min", by=(), levels="total", min=0)[1] == {("", ()): -2.0}
    assert judged(rows, measure="max", by=["g"], levels=[[]], max=9)[1] == {("", ()): 10.0}


def test_numbers_in_text(spark):
    df = spark.createDataFrame([("a", "1"), ("a", " 2 "), ("a", "10d"), ("b", None)], "g string, v string")
    assert judged(df, measure="sum", by="g", min=100)[1] == {("g", ("a",)): 3.0}
    assert judged(df, measure="count", by="g", min=2)[1] == {("g", ("b",)): 0}


def test_large_whole_numbers(spark):
    df = spark.createDataFrame([(2**62,)] * 6, "v long")
    assert judged(df, measure="sum", levels="total", max=0)[1] == {("", ()): 6.0 * 2**62}


def test_empty_table_has_no_groups(spark):
    nothing = spark.createDataFrame([], "g string, v double")
    for params in ({"by": "g", "levels": "cube"}, {"levels": "total"}):
        result, found = judged(nothing, measure="sum", min=1, **params)
        assert (result.total_rows, result.passed, found) == (0, True, {})


def test_against_brute_force_with_a_hot_group(spark):
    rng = random.Random(4)
    rows = [("hot" if k % 3 == 0 else rng.choice("abc"), rng.choice([None, 1, 2]), rng.choice("pq"), rng.randint(-50, 50)) for k in range(600)]
    df, by = spark.createDataFrame(rows, "a string, b int, c string, v long").repartition(6), ("a", "b", "c")
    result, found = judged(df, measure="sum", by=by, levels="cube", max=0)
    sums = defaultdict(int)
    for row in rows:
        for n in range(4):
            for level in combinations(range(3), n):
                sums[",".join(by[k] for k in level), tuple(None if row[k] is None else str(row[k]) for k in level)] += row[3]
    assert result.total_rows == len(sums) and found == {k: float(v) for k, v in sums.items() if v > 0}


@pytest.mark.parametrize("params, error", [
    ({"min": 1, "measure": "median"}, "Unknown measure: median"), ({}, "The rule has no bounds"), ({"min": 1, "by": "zz"}, "Column 'zz' not in dataset"),
    ({"min": 1, "by": "g", "levels": "all"}, "Validator error: unknown levels: all"), ({"min": 1, "by": "g", "levels": [["h"]]}, "Validator error: level column 'h' is not a grouping column"),
])
def test_rules_that_cannot_run(rows, params, error):
    result = validate(rows, [Rule("R", "v", "aggregate", params=params)]).rule_results.first()
    assert (result.status, result.error, result.failed_count) == ("error", error, 6)


def test_levels():
    assert levels_of(("a", "b"), "rollup") == [("a", "b"), ("a",), ()]
    assert levels_of(("a", "b"), "cube") == [("a", "b"), ("a",), ("b",), ()]
    assert levels_of(("a", "b"), [["b", "a"], ["a", "b"], []]) == [("a", "b"), ()]


def test_rules_with_the_same_groups_share_one_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    by = ["l_returnflag", "l_linestatus"]
    rules = [
        Rule("A", "l_quantity", "aggregate", params={"measure": "sum", "by": by, "levels": "cube", "max": 9}),
        Rule("B", "l_tax", "aggregate", params={"measure": "mean", "by": by, "levels": "rollup", "max": 9}),
        Rule("C", "_all", "aggregate", params={"by": by, "min": 9}),
    ]
    plan = validate(df, rules).rule_results._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("FileScan parquet", plan)) == 1 and len(re.findall(r"\bExpand\b", plan)) == 1
    assert "l_extendedprice" not in plan


def test_rows_and_groups_in_one_run(spark, rows):
    run = validate(rows.selectExpr("*", "monotonically_increasing_id() AS rk"), [Rule("A", "v", "positive"), Rule("B", "v", "aggregate", params={"by": "g", "measure": "sum", "max": 10})], key=["rk"])
    assert [(r.rule_id, r.total_rows, r.failed_count) for r in run.rule_results.orderBy("position").collect()] == [("A", 6, 1), ("B", 3, 1)]
    assert [r.rule_id for r in run.violations.collect()] == ["A"] and [r.rule_id for r in run.group_violations.collect()] == ["B"]


def test_no_rules_on_groups(rows):
    assert validate(rows, [Rule("A", "v", "positive")]).group_violations.collect() == []
