"""Sketches of columns: merged ones say what one of the union says, within stated bounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from plumbline import History
from plumbline.operators.sketches import SKETCH_SCHEMA, TRACKED, column_sketches, merged_sketches, sketched_profile


def table(spark, n=6000):
    key = F.col("id")
    return spark.range(n).select(
        ((key * 7919) % 2500).alias("k"), F.when(key % 5 == 0, None).when(key % 5 == 1, F.lit(float("nan"))).otherwise((key * 31 % 997).cast("double")).alias("v"),
        F.when(key % 3 == 0, "often").otherwise(F.concat(F.lit("t"), (key % 40).cast("string"))).alias("t"), F.lit(None).cast("int").alias("none"), key,
    )


def test_merged_and_whole(spark):
    df = table(spark)
    parts = column_sketches(df.filter("id % 4 = 0")).unionByName(column_sketches(df.filter("id % 4 <> 0")))
    for sketches in (merged_sketches(parts), column_sketches(df)):
        found = {r.column: r for r in sketched_profile(sketches, probs=(0.1, 0.5, 0.9)).collect()}
        assert {c: (r.rows, r.nulls) for c, r in found.items()} == {"k": (6000, 0), "v": (6000, 2400), "t": (6000, 0), "none": (6000, 6000), "id": (6000, 0)}
        assert abs(found["k"].distinct_values - 2500) <= 0.08 * 2500 and found["none"].distinct_values == 0
        values = np.sort([r.v for r in df.filter("v is not null and not isnan(v)").collect()])
        for p, q in zip((0.1, 0.5, 0.9), found["v"].quantiles):
            assert abs(np.searchsorted(values, q) / len(values) - p) < 0.03
        assert (found["v"].low, found["v"].high) == (values[0], values[-1]) and abs(found["v"].mean - values.mean()) < 1e-9
        top = found["t"].top_values[0]
        assert top.value == "often" and 2000 - top.n <= 6000 / TRACKED * 4
        assert found["none"].quantiles is None and found["none"].mean is None


def test_stored_runs_merge_by_month_and_follow_deletions(spark, tmp_path):
    store, df = History(spark, str(tmp_path)), table(spark, 900)
    assert store.sketches().count() == 0
    for k in range(3):
        store.save_sketches("d", f"r{k}", column_sketches(df.filter(F.col("id") % 3 == k), ["k", "t"]), f"2024-0{k // 2 + 1}-0{k + 1}")
    months = merged_sketches(store.sketches().withColumn("month", F.date_format("run_date", "yyyy-MM")), ["dataset_name", "month"])
    assert {(r.month, r.column): r.rows for r in sketched_profile(months).collect()} == {("2024-01", "k"): 600, ("2024-01", "t"): 600, ("2024-02", "k"): 300, ("2024-02", "t"): 300}
    store.delete_run("r2")
    assert {r.column: r.rows for r in merged_sketches(store.sketches()).collect()} == {"k": 600, "t": 600}
    fresh = store.compact(str(tmp_path / "fresh"))
    assert {r.column: r.rows for r in merged_sketches(fresh.sketches()).collect()} == {"k": 600, "t": 600}
    store.clear()
    assert store.sketches().count() == 0


def test_no_rows_and_the_schema(spark):
    nothing = column_sketches(table(spark).limit(0))
    assert [(f.name, f.dataType) for f in nothing.schema] == [(f.name, f.dataType) for f in spark.createDataFrame([], SKETCH_SCHEMA).schema]
    assert {(r.rows, r.distinct_values, r.quantiles) for r in sketched_profile(nothing).collect()} == {(0, 0, None)}


def test_one_scan(spark):
    import re

    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = column_sketches(df)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("FileScan parquet", plan)) == 1
