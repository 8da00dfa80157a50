"""Profiles, scores, explanations and suggestions on small frames."""

from __future__ import annotations

import pandas as pd
import pytest
from helpers import texts
from pyspark.sql import functions as F

from plumbline import Rule, suggest_rules, validate
from plumbline.operators import explain, profile, scoring
from plumbline.operators.validate import RESULT_SCHEMA


def test_dataset_summary(spark):
    df = spark.createDataFrame([(1, "a", 1.5), (1, "a", 1.5), (2, None, float("nan"))], "n BIGINT, t STRING, x DOUBLE")
    row = profile.dataset_summary(df).first().asDict()
    assert row == {
        "total_rows": 3, "total_columns": 3, "total_cells": 9, "null_count": 2, "null_percentage": 22.22,
        "duplicated_rows": 1, "numeric_columns": ["n", "x"], "text_columns": ["t"], "date_columns": [],
    }
    assert profile.dataset_summary(df.limit(0)).first()["null_percentage"] == 0


def test_numeric_profile_is_pandas(spark):
    series = pd.Series([3.0, 1.0, None, 2.5, 2.5, 10.0])
    df = spark.createDataFrame([(None if pd.isna(v) else v,) for v in series], "v DOUBLE")
    row = profile.column_profile(df, "v").first()
    assert (row["null_count"], row["null_percentage"], row["unique_count"]) == (1, 16.67, series.nunique())
    assert (row["min"], row["max"], row["median"]) == (1.0, 10.0, series.median())
    assert (row["mean"], row["std"]) == (round(series.mean(), 2), round(series.std(), 2))


def test_text_profile(spark):
    row = profile.column_profile(texts(spark, "bb", "a", "bb", None, "ccc", "a", "d", "e", "f"), "c").first()
    assert [(v["value"], v["n"]) for v in row["top_values"]] == [("a", 2), ("bb", 2), ("ccc", 1), ("d", 1), ("e", 1)]
    assert (row["max_length"], row["min_length"], row["unique_count"]) == (3, 1, 6)
    empty = profile.column_profile(texts(spark, None), "c").first()
    assert (empty["max_length"], empty["unique_count"], empty["top_values"]) == (0, 0, [])


def test_column_summary(spark):
    df = spark.createDataFrame([(i, f"v{i % 3}", None if i % 4 else float(i)) for i in range(20)], "k BIGINT, t STRING, x DOUBLE")
    found = {r["column"]: r for r in profile.column_summary(df.repartition(5), ["k"]).collect()}
    assert found["t"]["samples"] == ["v0", "v1", "v2", "v0", "v1"]
    assert found["x"]["samples"] == ["0.0", "4.0", "8.0", "12.0", "16.0"]
    assert (found["x"]["nulls"], found["x"]["null_pct"], found["x"]["distinct_values"]) == (15, 75.0, 5)
    assert (found["k"]["min"], found["k"]["max"], found["k"]["mean"]) == (0, 19, 9.5)
    rough = {r["column"]: r["distinct_values"] for r in profile.column_summary(df, ["k"], approximate=True).collect()}
    assert rough == {"k": 20, "t": 3, "x": 5}


@pytest.mark.parametrize(
    "rows, nulls, copies, failed, expected",
    [(0, 0, 0, 0, 0), (100, 0, 0, 0, 100), (100, 50, 0, 0, 90), (100, 1000, 100, 100, 0), (100, 0, 3, 7, 80), (3, 1, 0, 0, 93)],
)
def test_health_score(spark, rows, nulls, copies, failed, expected):
    score = scoring.health_score(F.lit(rows), F.lit(nulls), F.lit(copies), F.lit(failed))
    assert spark.range(1).select(score).first()[0] == expected


def python_severity(kind, failed, total, base):
    level = base if base in ("low", "medium", "high") else scoring.DEFAULT_SEVERITY.get(kind, "medium")
    rate = failed / total if total else 0
    steps = {("low", True): "medium"} if rate > 0.5 else {}
    if (level, True) in steps:
        return steps[level, True]
    return "high" if level == "medium" and rate > 0.8 else level


def python_confidence(kind, failed, total, params, model):
    rate = scoring.FIX_RATE.get(kind, 0.75)
    rate = min(1.0, rate + 0.1) if model else rate
    score = rate * 0.40 + (0.9 if params else 0.7) * 0.30 + (1.0 - failed / max(total, 1)) * 0.30
    return min(100, max(0, int(score * 100)))


def test_scores_for_every_type(spark):
    cases = [
        (kind, failed, total, base, params)
        for kind in [*scoring.DEFAULT_SEVERITY, "other"]
        for failed, total in [(0, 0), (0, 10), (5, 10), (6, 10), (9, 10), (10, 10), (1, 3)]
        for base, params in [("low", True), ("medium", False), (None, True)]
    ]
    df = spark.createDataFrame(cases, "rule_type STRING, failed_count BIGINT, total_rows BIGINT, severity STRING, has_params BOOLEAN")
    for model in (False, True):
        rough = [F.col(c).alias(f"_{c}") for c in df.columns]
        found = scoring.scored(df.select("*", *rough), model).collect()
        for r in found:
            args = r["_rule_type"], r["_failed_count"], r["_total_rows"]
            assert r["severity"] == python_severity(*args, r["_severity"])
            assert r["confidence"] == python_confidence(*args, r["_has_params"], model)


def results(spark, *rows):
    return spark.createDataFrame(
        [("run", i, f"R{i}", kind, "col", "medium", "", True, "ok", failed == 0, 10, 10 - failed, failed, None)
         for i, (kind, failed) in enumerate(rows)],
        RESULT_SCHEMA,
    )


def test_explanations(spark):
    rule = Rule("R1", "col", "range", params={"min": 1, "max": 9})
    found = {r["rule_id"]: r for r in explain.explain_failures(results(spark, ("not_null", 2), ("range", 3), ("phone", 1), ("email", 0)), [rule]).collect()}
    assert sorted(found) == ["R0", "R1", "R2"]
    assert found["R0"]["root_cause"] == "Column 'col' contains 2 null values."
    assert found["R1"]["sql_fix"] == "UPDATE table_name SET col = NULL WHERE col < 1 OR col > 9;"
    assert found["R2"]["code_fix"] == "# Manual review needed for col"
    assert found["R2"]["explanation"] == "The phone check on 'col' found 1 issues."


def test_analysis_takes_the_first_five(spark):
    failures = results(spark, *[("email", 9 if i else 0) for i in range(8)])
    found = explain.analyse_failures(failures).orderBy("position").collect()
    assert [r["rule_id"] for r in found] == ["R1", "R2", "R3", "R4", "R5"]
    assert {r["severity"] for r in found} == {"high"}  # more than 80 % fail
    assert explain.analyse_failures(failures, top=None).count() == 7


def test_health_trend(spark):
    runs = spark.createDataFrame([("a", 1, "r1", 50), ("a", 2, "r2", 70), ("b", 1, "r3", 10)],
                                 "dataset_name STRING, validation_timestamp INT, run_id STRING, score INT")
    found = {r["run_id"]: r["delta"] for r in scoring.health_trend(runs).collect()}
    assert found == {"r1": None, "r2": 20, "r3": None}


def test_suggested_rules(spark):
    df = spark.createDataFrame(
        [(1, "a@x.com", 25, 10.5, "US", None), (2, "b@x.com", 35, 20.0, "UK", "x"), (3, "bad", 45, 30.0, "US", None)],
        "user_id BIGINT, email STRING, age BIGINT, amount DOUBLE, country STRING, mobile STRING",
    )
    found = suggest_rules(df)
    shown = [(r.column, r.type, r.severity) for r in found]
    assert shown == [
        ("user_id", "unique", "high"), ("user_id", "range", "medium"),
        ("email", "email", "medium"), ("email", "allowed_values", "medium"),
        ("age", "range", "medium"), ("age", "range", "high"),
        ("amount", "range", "medium"), ("amount", "positive", "high"),
        ("country", "allowed_values", "medium"),
        ("mobile", "not_null", "high"), ("mobile", "phone", "low"),
        ("_all", "duplicate_row", "high"),
    ]
    assert [r.id for r in found] == [f"R{i:03d}" for i in range(1, 13)]
    assert found.rules[1].params == {"min": 0.8, "max": 3.2}
    assert found.rules[8].params == {"values": ["UK", "US"]}
    run = validate(df, found)
    assert {r["status"] for r in run.rule_results.collect()} == {"ok"}


def test_suggestions_cover_all_columns(spark):
    df = spark.range(30).select(*[F.col("id").alias(f"x{i}") for i in range(60)])
    found = suggest_rules(df)
    assert {r.column for r in found} == {*df.columns, "_all"} and len(found) == 121


def test_summary_covers_all_columns(spark):
    df = spark.range(3).select("id", F.create_map("id", "id").alias("m"), *[F.col("id").alias(f"x{i}") for i in range(59)])
    rows = {r["column"]: r for r in profile.column_summary(df, ["id"]).collect()}
    assert set(rows) == set(df.columns)
    assert rows["x58"]["distinct_values"] == 3 and rows["m"]["distinct_values"] is None and rows["m"]["samples"] == []


def test_column_summary_scans_do_not_grow_with_columns(spark):
    import re

    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = profile.column_summary(df, ["l_orderkey", "l_linenumber"])._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("FileScan parquet", plan)) <= 3  # the first rows are written down beforehand


def test_first_values_of_thin_columns(spark, monkeypatch):
    monkeypatch.setattr(profile, "FIRST_ROWS", 10)
    monkeypatch.setattr(profile, "COLUMNS_PER_PASS", 2)
    rows = [(k, k % 3, f"t{k}" if k % 40 == 39 else None, None, [k, None] if k > 150 else None) for k in range(200)]
    df = spark.createDataFrame(rows, "k int, full int, thin string, `no.thing` double, nested array<int>").repartition(4)
    found = {r["column"]: r for r in profile.column_summary(df, ["k"]).collect()}
    assert found["full"].samples == ["0", "1", "2", "0", "1"]
    assert found["thin"].samples == ["t39", "t79", "t119", "t159", "t199"] and found["thin"].distinct_values == 5
    assert (found["no.thing"].samples, found["no.thing"].distinct_values) == ([], 0)
    assert found["nested"].distinct_values == 49 and len(found["nested"].samples) == 5
    assert [found[c].distinct_values for c in ("k", "full")] == [200, 3]
