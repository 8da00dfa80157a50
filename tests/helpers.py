"""Small helpers for the tests."""

from __future__ import annotations

from plumbline import Rule, validate


def frame(spark, rows, schema):
    """A frame with a row number in `rk`."""
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"{schema}, rk BIGINT")


def failing(df, rule_type, column="c", as_of="2024-12-01", **params):
    """The row numbers that fail one rule; checks on the way that the counts agree with the rows."""
    rule = Rule("R", column, rule_type, params=params)
    run = validate(df, [rule], key=["rk"], as_of=as_of)
    result = run.rule_results.first()
    if result["status"] == "error":
        assert not result["passed"] and result["failed_count"] == result["total_rows"]
        return "error"
    rows = sorted(r["row_key"]["rk"] for r in run.violations.select("row_key").collect())
    assert result["failed_count"] == len(rows)
    assert result["passed_count"] + result["failed_count"] == result["total_rows"]
    assert result["passed"] == (not rows)
    return rows


def texts(spark, *values):
    return frame(spark, [(v,) for v in values], "c STRING")


def longs(spark, *values):
    return frame(spark, [(v,) for v in values], "c BIGINT")


def doubles(spark, *values):
    return frame(spark, [(v,) for v in values], "c DOUBLE")
