"""`reference` rules: every complete key must stand in another table."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import types as T

from plumbline import Rule, RuleCatalog, validate
from plumbline.operators import references, repeats


def run(df, tables, column="a", **params):
    result = validate(df, [Rule("R", column, "reference", params=params)], key=["rk"], tables=tables)
    first = result.rule_results.first()
    failing = sorted(r.row_key.rk for r in result.violations.select("row_key").collect())
    if first.status == "ok":
        assert first.failed_count == len(failing) and first.total_rows == df.count()
        assert first.passed == (not failing)
    return first, failing


def keyed(spark, rows, schema):
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], f"{schema}, rk long")


@pytest.fixture(params=["broadcast", "salted"])
def way(request, monkeypatch):
    """Both ways to list rows give the same."""
    if request.param == "salted":
        monkeypatch.setattr(references, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(repeats, "HOT_ROWS", 20)
    return request.param


def test_missing_keys(spark, way):
    child = keyed(spark, [(1,), (2,), (None,), (3,), (3,), (99,)], "a long")
    parent = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    result, failing = run(child, {"p": parent}, table="p", to="k")
    assert failing == [3, 4, 5] and result.total_rows == 6


def test_hot_key_against_brute_force(spark, way):
    rng = random.Random(2)
    rows = [(7 if k % 3 == 0 else rng.randrange(60), rng.choice(["x", "y", None, ""])) for k in range(900)]
    known = [(rng.randrange(60), rng.choice(["x", "", None])) for _ in range(80)]
    known = [k for k in known if k[0] != 7]
    child, parent = keyed(spark, rows, "a long, b string").repartition(5), spark.createDataFrame(known, "c int, d string")
    _, failing = run(child, {"p": parent}, table="p", columns=["a", "b"], to=["c", "d"])
    found = {k for k in known if None not in k}
    assert failing == [k for k, r in enumerate(rows) if None not in r and r not in found]
    _, failing = run(child, {"p": parent}, table="p", to="c")
    assert failing == [k for k, r in enumerate(rows) if r[0] not in {c for c, _ in known}]


def test_wide_composite_keys(spark, way):
    names = [f"c{k}" for k in range(6)]
    rows = [tuple(j + k % 7 for j in range(6)) for k in range(30)]
    child = keyed(spark, rows, ", ".join(f"{n} long" for n in names))
    parent = spark.createDataFrame(rows[:3], ", ".join(f"{n} int" for n in names))
    _, failing = run(child, {"p": parent}, column="c0", table="p", columns=names)
    assert failing == [k for k in range(30) if k % 7 > 2]


def test_numbers_of_different_types(spark):
    parent = spark.createDataFrame([(Decimal("1.50"), 2.0, True)], T.StructType([T.StructField("d", T.DecimalType(9, 2)), T.StructField("f", T.DoubleType()), T.StructField("b", T.BooleanType())]))
    assert run(keyed(spark, [(1,), (2,), (None,)], "a int"), {"p": parent}, table="p", to="f")[1] == [0]
    assert run(keyed(spark, [(1.5,), (float("nan"),), (2.0,)], "a double"), {"p": parent}, table="p", to="d")[1] == [2]
    assert run(keyed(spark, [(1,), (2,)], "a bigint"), {"p": parent}, table="p", to="d")[1] == [0, 1]


def test_the_table_itself(spark):
    rows = [(1, None), (2, 1), (3, 9), (4, 2)]
    assert run(keyed(spark, rows, "id long, parent long"), {}, column="parent", to="id")[1] == [2]


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], "a long, rk long")
    some = keyed(spark, [(1,), (None,)], "a long")
    assert run(nothing, {"p": some}, table="p", to="a")[1] == []
    assert run(some, {"p": nothing}, table="p", to="a")[1] == [0]


@pytest.mark.parametrize("params, error", [
    ({"table": "q", "to": "k"}, "Table 'q' is not given"), ({"table": "p", "to": "zz"}, "Column 'zz' not in table 'p'"),
    ({"table": "p", "to": ["k", "t"]}, "1 columns refer to 2"), ({"table": "p", "to": "t"}, "Column 'a' (bigint) cannot equal 't' (string)"),
    ({"table": "p", "columns": "zz", "to": "k"}, "Column 'zz' not in dataset"),
])
def test_rules_that_cannot_run(spark, params, error):
    parent = spark.createDataFrame([(1, "x")], "k long, t string")
    result, failing = run(keyed(spark, [(1,), (2,)], "a long"), {"p": parent}, **params)
    assert (result.status, result.error, result.passed, result.failed_count, len(failing)) == ("error", error, False, 2, 2)


def test_column_names_of_its_own(spark):
    """Columns called like the ones the operator adds, and names with dots."""
    child = spark.createDataFrame([(1, 5, 0, 2), (2, 6, 1, 3)], "`a.b` long, __n long, rk long, __ref_0 long")
    _, failing = run(child, {"p": spark.createDataFrame([(1,)], "`k.k` long")}, column="a.b", table="p", to="k.k")
    assert failing == [1]


def test_few_missing_keys_do_not_shuffle_the_rows(spark):
    child = keyed(spark, [(k % 50,) for k in range(500)], "a long")
    found = validate(child, [Rule("R", "a", "reference", params={"table": "p", "to": "k"})], key=["rk"], tables={"p": spark.range(40).toDF("k")}).violations
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_catalogue_knows_the_type(spark):
    catalog = RuleCatalog([{"id": "1", "column": "a", "type": "REFERENCE", "params": {"table": "p"}}, {"id": "2", "column": "a", "type": "aggregate"}, {"id": "3", "column": "a", "type": "refers"}])
    assert [r.type for r in catalog] == ["reference", "aggregate"] and len(catalog.errors) == 1
    assert [r.params for r in RuleCatalog.from_table(catalog.to_dataframe(spark))] == [{"table": "p"}, {}]
