"""Rules on the order of rows, and quantiles and outliers of groups, over many small range partitions."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import Rule, validate
from plumbline.operators import group_outliers, repeats
from plumbline.operators.ordered import Ordered, grouped_quantiles


@pytest.fixture(autouse=True, params=[1, 13])
def partitions(request, spark):
    """One partition, and many that are not put together, so that groups span several."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def failing(df, column="v", **params):
    run = validate(df, [Rule("R", column, "sequence", params=params)], key=["rk"])
    result = run.rule_results.first()
    assert result.status == "ok", result.error
    rows = {r.row_key.rk: (r.value, r.reason) for r in run.violations.collect()}
    assert (result.failed_count, result.total_rows, result.passed) == (len(rows), df.count(), not rows)
    return rows


def sequence_rows(rng, n):
    return [(rng.choice(["hot", "hot", None, "a", "b", f"g{k % 20}"]), rng.choice([None, *range(40)]), rng.choice([None, *range(-20, 20)]), k) for k in range(n)]


def by_group(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[0]].append(row)
    for members in groups.values():
        yield sorted((r for r in members if r[1] is not None and r[2] is not None), key=lambda r: (r[1], r[3]))


@pytest.mark.parametrize("strict", [False, True])
def test_increasing(spark, strict):
    rows = sequence_rows(random.Random(1), 400)
    want = set()
    for members in by_group(rows):
        for a, b in zip(members, members[1:]):
            if b[2] < a[2] or (strict and b[2] == a[2]):
                want.add(b[3])
    df = spark.createDataFrame(rows, "g string, o int, v int, rk long").repartition(4)
    assert set(failing(df, by="g", order="o", strict=strict)) == want


def test_overlaps_with_intervals_that_last(spark):
    rng = random.Random(2)
    rows = []
    for k in range(300):
        start = rng.choice([None, *range(500)])
        end = None if start is None or rng.random() < 0.1 else start + rng.choice([0, 1, 5, 200])
        rows.append((rng.choice(["hot", "hot", None, "a"]), start, end, k))
    want = set()
    for g in {r[0] for r in rows}:
        members = sorted((r for r in rows if r[0] == g and r[1] is not None), key=lambda r: (r[1], r[3]))
        most = None
        for r in members:
            if most is not None and r[1] < most:
                want.add(r[3])
            most = max((x for x in (most, r[2]) if x is not None), default=None)
    df = spark.createDataFrame(rows, "g string, s int, e int, rk long").repartition(4)
    assert set(failing(df, column="s", check="overlap", by="g", end="e")) == want


def test_gaps(spark):
    rows = [("a", dt.datetime(2024, 1, 1, 0, 0, s), k) for k, s in enumerate((0, 5, 6, 30))] + [("b", dt.datetime(2024, 1, 1), 4), (None, None, 5)]
    df = spark.createDataFrame(rows, "g string, t timestamp, rk long")
    assert set(failing(df, column="t", check="gap", by="g", max=5)) == {3}
    assert set(failing(df, column="t", check="gap", by="g", min=2, max=10)) == {2, 3}
    days = spark.createDataFrame([(dt.date(2024, 1, d), d) for d in (1, 2, 3, 5, 9)], "d date, rk long")
    found = failing(days, column="d", check="gap", max=1)
    assert set(found) == {5, 9} and found[5] == ("2024-01-05", "Row 5: 'd' value '2024-01-05' comes too soon or too late after '2024-01-03'")


def test_what_a_row_follows_is_shown(spark):
    df = spark.createDataFrame([(1, 2.5, 1), (2, 1.5, 2), (3, float("nan"), 3), (4, 1.0, 4)], "o int, v double, rk long")
    assert failing(df, order="o") == {2: ("1.5", "Row 2: 'v' value '1.5' falls from '2.5'"), 4: ("1.0", "Row 4: 'v' value '1.0' falls from '1.5'")}


def test_one_group_with_all_rows(spark, partitions):
    df = spark.range(2000).select(F.col("id").alias("o"), F.when(F.col("id") % 100 == 50, -1).otherwise(F.col("id")).alias("v"), F.col("id").alias("rk"))
    assert set(failing(df, order="o")) == {k for k in range(2000) if k % 100 == 50}
    ordered = Ordered(df, F.lit(0), F.col("o"), F.struct("rk"), {"v": F.col("v")})
    sizes = [r["count"] for r in ordered.placed.groupBy("part").count().collect()]
    assert len(sizes) == partitions and max(sizes) < 2000 / partitions * 2  # no part holds the whole group


def test_text_and_no_rows(spark):
    assert set(failing(spark.createDataFrame([(1, "b", 1), (2, "a", 2), (3, "a", 3)], "o int, v string, rk long"), order="o")) == {2}
    assert failing(spark.createDataFrame([], "o int, v int, rk long"), order="o", by="v") == {}


@pytest.mark.parametrize("params, error", [
    ({"check": "sorted"}, "Unknown check of a sequence: sorted"), ({"order": "zz"}, "Column 'zz' not in dataset"), ({"by": "zz"}, "Column 'zz' not in dataset"),
    ({"check": "overlap"}, "Column 'None' not in dataset"), ({"check": "overlap", "end": "t"}, "Column 't' has no order that can be checked"),
    ({"check": "gap"}, "The rule has no bounds"), ({"check": "overlap", "end": "w"}, "Columns 'v' and 'w' have two types"),
])
def test_rules_that_cannot_run(spark, params, error):
    df = spark.createDataFrame([(1, "x", 1.0)], "v int, t string, w double")
    result = validate(df, [Rule("R", "v", "sequence", params=params)]).rule_results.first()
    assert (result.status, result.error) == ("error", error)


def price_rows(rng, n):
    values = [None, float("nan"), 1e9, 0.0, 1.0, 2.0, 3.0]
    return [(rng.choice(["hot", "hot", None, "a", "none"]), rng.random() * 100 if rng.random() < 0.7 else rng.choice(values), k) for k in range(n)]


def test_quantiles_of_groups(spark):
    rows = [(g, None if g == "none" else v, k) for g, v, k in price_rows(random.Random(5), 600)]
    probs = (0.0, 0.25, 0.5, 0.9, 1.0)
    found = {r["group"].g0: (r.n, r.quantiles) for r in grouped_quantiles(spark.createDataFrame(rows, "g string, v double, rk long").repartition(5), ["g"], F.col("v"), probs).collect()}
    values = defaultdict(list)
    for g, v, _ in rows:
        values[g] += [] if v is None or v != v else [v]
    assert set(found) == set(values)
    for g, v in values.items():
        assert found[g][0] == len(v)
        if v:
            np.testing.assert_allclose(found[g][1], np.quantile(v, probs), rtol=1e-12)
        else:
            assert found[g][1] is None


def test_quantiles_without_groups(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("v"))
    assert [(r.n, r.quantiles) for r in grouped_quantiles(df, [], F.col("v"), (0.5, 0.99)).collect()] == [(101, [50.0, 99.0])]
    assert grouped_quantiles(df.limit(0), [], F.col("v"), (0.5,)).collect() == []


@pytest.mark.parametrize("broadcast", [True, False])
def test_outliers_of_groups(spark, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(group_outliers, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(repeats, "HOT_ROWS", 50)
    rows = price_rows(random.Random(6), 500)
    df = spark.createDataFrame(rows, "g string, v double, rk long").repartition(5)
    run = validate(df, [Rule("R", "v", "outlier", params={"by": ["g"], "factor": 1.0})], key=["rk"])
    want = set()
    for g in {r[0] for r in rows}:
        v = [r[1] for r in rows if r[0] == g and r[1] is not None and r[1] == r[1]]
        q1, q3 = np.quantile(v, (0.25, 0.75))
        want |= {r[2] for r in rows if r[0] == g and r[1] is not None and (r[1] < q1 - (q3 - q1) or r[1] > q3 + (q3 - q1))}
    assert {r.row_key.rk for r in run.violations.collect()} == want and want
    assert run.rule_results.first().failed_count == len(want)
