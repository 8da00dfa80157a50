"""Repeated keys against brute force, with hot groups and wide keys, and with every path forced."""

from __future__ import annotations

import math
import random

import pytest

from plumbline.operators import repeats


def brute(rows, keys):
    """Per row: whether it repeats an earlier one, and the size of its group."""
    def norm(v):
        return None if isinstance(v, float) and math.isnan(v) else v

    seen, repeated, sizes = set(), [], {}
    for r in rows:
        k = tuple(norm(r[i]) for i in keys)
        repeated.append(k in seen)
        seen.add(k)
        sizes[k] = sizes.get(k, 0) + 1
    return repeated, [sizes[tuple(norm(r[i]) for i in keys)] for r in rows]


def skewed_rows(n=600, seed=3):
    """A third of all rows share one key, another part is null, the rest is spread."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.33:
            rows.append(("hot", 1, float("nan"), i))
        elif kind < 0.5:
            rows.append((None, None, None, i))
        else:
            rows.append((f"k{rng.randrange(200)}", rng.randrange(3), rng.choice([0.5, 1.5, float("nan")]), i))
    return rows


@pytest.fixture(scope="module")
def data(spark):
    rows = skewed_rows()
    return rows, spark.createDataFrame(rows, "a STRING, b BIGINT, c DOUBLE, rk BIGINT").repartition(7)


@pytest.mark.parametrize("hot_rows", [1, 50, 10**6])
@pytest.mark.parametrize("wide", [0, 10**6])
@pytest.mark.parametrize("keys", [["a"], ["a", "b", "c"]])
def test_against_brute_force(data, monkeypatch, hot_rows, wide, keys):
    rows, df = data
    monkeypatch.setattr(repeats, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(repeats, "WIDE_KEY", wide)
    repeated, sizes = brute(rows, ["abc".index(k) for k in keys])
    expected = [i for i, r in enumerate(repeated) if r]

    counted = repeats.repeat_counts(df, keys).first()
    assert (counted["total_rows"], counted["repeats"]) == (len(rows), len(expected))
    assert sorted(r["rk"] for r in repeats.repeats(df, keys, ["rk"]).collect()) == expected
    kept = sorted(r["rk"] for r in repeats.keep_first(df, keys, ["rk"]).collect())
    assert kept == [i for i, r in enumerate(repeated) if not r]
    marked = repeats.mark_repeats(df, keys, ["rk"], "again").collect()
    assert sorted(r["rk"] for r in marked if r["again"]) == expected and len(marked) == len(rows)
    found = {r["rk"]: r["n"] for r in repeats.copies(df, keys, "n").collect()}
    assert found == dict(enumerate(sizes))


def test_hot_groups_are_few(spark, monkeypatch):
    """The broadcast side holds groups above both thresholds only."""
    monkeypatch.setattr(repeats, "HOT_ROWS", 10)
    df = spark.createDataFrame([(i % 40 if i % 3 else 0, i) for i in range(300)], "a BIGINT, rk BIGINT")
    assert repeats.repeat_counts(df, ["a"]).first()["repeats"] == 260
    assert repeats.repeats(df, ["a"], ["rk"]).count() == 260


def test_keys_of_several_columns_as_row_identity(spark):
    df = spark.createDataFrame([("x", 1, 2), ("x", 1, 1), ("x", 0, 9), ("y", 5, 5)], "a STRING, k1 BIGINT, k2 BIGINT")
    later = repeats.repeats(df, ["a"], ["k1", "k2"]).select("k1", "k2").collect()
    assert sorted(tuple(r) for r in later) == [(1, 1), (1, 2)]


def test_empty(spark):
    df = spark.createDataFrame([], "a STRING, rk BIGINT")
    assert tuple(repeats.repeat_counts(df, ["a"]).first()) == (0, 0)
    assert repeats.repeats(df, ["a"], ["rk"]).count() == 0


def test_a_hot_key_is_spread(spark, monkeypatch):
    """With broadcast by size, coalescing and Spark's own skew handling switched off, the salts do it alone."""
    from pyspark.sql import functions as F

    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in settings}
    df = spark.range(24_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7000)).alias("a"),
        F.col("id").alias("rk"),
    )

    def fullest(hot_rows):
        monkeypatch.setattr(repeats, "HOT_ROWS", hot_rows)
        found = repeats.copies(df, ["a"], "n").select(F.spark_partition_id().alias("p")).groupBy("p").count()
        return max(r["count"] for r in found.collect())

    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert fullest(10**9) > 8000  # all hot rows in one task
        assert fullest(1000) < 4500  # 3000 per task on average
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
