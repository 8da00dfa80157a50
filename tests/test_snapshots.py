"""Differences of two snapshots as multisets."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline import snapshot_diff
from plumbline.operators import snapshots

SCHEMA = "k long, t string, v double, a array<int>"


def plain(r):
    return (r.k, r.t, None if r.v != r.v else r.v, None if r.a is None else tuple(r.a))


def check(spark, old, new, key=("k",), schema=SCHEMA, **params):
    frames = [spark.createDataFrame(rows, schema).repartition(3) for rows in (old, new)]
    diff = snapshot_diff(*frames, list(key), **params)
    was, now = (Counter(plain(r) for r in f.collect()) for f in frames)
    want = {("removed", *r): n for r, n in (was - now).items()} | {("added", *r): n for r, n in (now - was).items()}
    got = [((r.change, *plain(r)), r.copies) for r in diff.rows.collect()]
    assert dict(got) == want and len(got) == len(want)
    names = dict(zip("ktva", range(4)))
    per_key = {}
    for (change, *row), n in want.items():
        per_key.setdefault(tuple(row[names[k]] for k in key), Counter())[change] += n
    keys = {tuple(r[k] for k in key): (r.change, r.removed_rows, r.added_rows) for r in diff.keys.collect()}
    assert keys == {k: ("changed" if len(c) == 2 else next(iter(c)), c["removed"], c["added"]) for k, c in per_key.items()}
    summary = diff.summary.first()
    assert (summary.old_rows, summary.new_rows) == (len(old), len(new))
    assert (summary.removed_rows, summary.added_rows) == (sum((was - now).values()), sum((now - was).values()))
    assert summary.changed_keys + summary.added_keys + summary.removed_keys == len(keys)
    return diff, summary


def some_rows(rng, n):
    return [(rng.choice([k, k, None, 5]), rng.choice(["x", "y", None, ""]), rng.choice([1.0, None, float("nan")]), rng.choice([None, [], [1], [1, None]])) for k in range(n)]


@pytest.mark.parametrize("key", [("k",), ("t",), ("t", "k")])
def test_random_snapshots(spark, key):
    rng = random.Random(len(key))
    old = some_rows(rng, 150)
    new = [r for r in old if rng.random() < 0.9] + some_rows(rng, 15) + old[:7]
    check(spark, old, new, key, ranges=16)


def test_both_ways_to_fetch_rows(spark, monkeypatch):
    monkeypatch.setattr(snapshots, "BROADCAST_BYTES", 0)
    rng = random.Random(8)
    check(spark, some_rows(rng, 80), some_rows(rng, 80), ranges=4)


def test_equal_snapshots_in_another_order(spark):
    rows = some_rows(random.Random(1), 100)
    _, summary = check(spark, rows, rows[::-1])
    assert summary.unequal_ranges == summary.compared_rows == summary.changed_keys == 0


def test_empty_snapshots(spark):
    rows = some_rows(random.Random(1), 20)
    for old, new in (([], []), (rows, []), ([], rows)):
        check(spark, old, new)


def test_a_repeated_row_with_a_third_of_the_table(spark):
    rows = [(k, "x", 1.0, None) for k in range(200)]
    hot = (7, "hot", 2.0, [1])
    check(spark, rows + [hot] * 100, rows + [hot] * 130, ranges=32)


def test_only_unequal_ranges_are_compared(spark):
    old = spark.range(64_000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    new = old.withColumn("v", F.when(F.col("k").between(100, 120), -1).otherwise(F.col("v")))
    diff = snapshot_diff(old, new, ["k"], ranges=64)
    summary = diff.summary.first()
    assert (summary.n_ranges, summary.unequal_ranges, summary.changed_keys) == (64, 1, 21)
    assert summary.compared_rows == 2000  # the two times 1000 rows of one range
    plan = diff._unequal(new)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan  # filtered before any exchange of rows
    assert diff._unequal(new).count() == 1000
    assert {tuple(r.changed_columns) for r in diff.keys.collect()} == {("v",)}


def test_text_and_date_keys(spark):
    old = spark.range(300).select(F.concat(F.lit("key"), "id").alias("t"), F.date_add(F.lit("2024-01-01"), F.col("id").cast("int")).alias("d"), F.lit(1).alias("v"))
    new = old.filter("t <> 'key7'").withColumn("v", F.when(F.col("t") == "key9", 2).otherwise(1))
    for key in (["t"], ["d"], ["d", "t"]):
        summary = snapshot_diff(old, new, key, ranges=50).summary.first()
        assert (summary.removed_keys, summary.added_keys, summary.changed_keys) == (1, 0, 1)
        assert summary.unequal_ranges <= 2


def test_some_columns_and_names_of_its_own(spark):
    old = spark.createDataFrame([(1, 2, 3, "a"), (2, 2, 3, "b")], "`k.k` long, change long, copies long, __a string")
    new = spark.createDataFrame([(1, 2, 4, "z"), (2, 2, 3, "y")], "`k.k` long, change long, copies long, __a string")
    diff = snapshot_diff(old, new, ["k.k"], columns=["k.k", "copies"])
    assert diff.summary.first().changed_keys == 1
    assert [(r["k.k"], r.changed_columns) for r in diff.keys.collect()] == [(1, ["copies"])]
    assert sorted((r.change, r._copies, r["k.k"], r.copies) for r in diff.rows.collect()) == [("added", 1, 1, 4), ("removed", 1, 1, 3)]


def test_what_cannot_be_compared(spark):
    one = spark.createDataFrame([(1, {"a": 1})], "k long, m map<string,int>")
    with pytest.raises(ValueError, match="is a map"):
        snapshot_diff(one, one, ["k"])
    with pytest.raises(ValueError, match="two types"):
        snapshot_diff(one.select("k"), one.select(F.col("k").cast("int")), ["k"])
    with pytest.raises(ValueError, match="not in both"):
        snapshot_diff(one.select("k"), one.select("k", F.lit(1).alias("x")), ["k"])
    with pytest.raises(ValueError, match="key must be"):
        snapshot_diff(one, one, [], columns=["k"])
