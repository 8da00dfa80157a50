"""Severity, confidence and health scores as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.plans.rules import SEVERITIES

# ---- fixed values ----------------------------------------------------------------------------
DEFAULT_SEVERITY = {
    "not_null": "high", "unique": "high", "range": "medium", "regex": "medium", "email": "medium",
    "date": "low", "phone": "low",
    "allowed_values": "medium", "numeric": "medium", "positive": "medium", "min_length": "low",
    "max_length": "low", "duplicate_row": "high", "future_date": "medium", "date_format": "low",
    "placeholder": "medium", "missing_threshold": "high", "customer_id_pattern": "medium",
    "email_domain": "medium", "currency": "medium", "country": "low", "date_order": "medium",
    "age": "medium", "salary": "medium", "transaction_amount": "high", "outlier": "medium",
    "cross_field": "high", "business_rule": "high", "data_consistency": "high", "data_freshness": "low",
}
FIX_RATE = {
    "not_null": 0.95, "unique": 0.90, "range": 0.85, "regex": 0.80, "email": 0.75, "date": 0.85, "phone": 0.80,
    "allowed_values": 0.90, "numeric": 0.95, "positive": 0.90, "min_length": 0.85, "max_length": 0.85,
    "duplicate_row": 0.88, "future_date": 0.90, "date_format": 0.85, "placeholder": 0.92,
    "missing_threshold": 0.80, "customer_id_pattern": 0.85, "email_domain": 0.88, "currency": 0.90,
    "country": 0.85, "date_order": 0.85, "age": 0.85, "salary": 0.80, "transaction_amount": 0.85,
    "outlier": 0.70, "cross_field": 0.75, "business_rule": 0.70, "data_consistency": 0.70,
    "data_freshness": 0.90,
}
OTHER_FIX_RATE = 0.75
MODEL_BONUS = 0.1
CLARITY_WITH_PARAMS, CLARITY_WITHOUT = 0.9, 0.7
WEIGHT_FIX_RATE, WEIGHT_CLARITY, WEIGHT_COVERAGE = 0.40, 0.30, 0.30


def _map(entries: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(entries.items())])


def severity(rule_type: Column, failed: Column, total: Column, base: Column) -> Column:
    """The rule's own severity (or its type's default), raised one step when most rows fail."""
    start = F.when(base.isin(*SEVERITIES), base).otherwise(
        F.coalesce(F.try_element_at(_map(DEFAULT_SEVERITY), rule_type), F.lit("medium"))
    )
    rate = F.when(total > 0, failed / F.greatest(total, F.lit(1)))
    return (
        F.when((rate > 0.5) & (start == "low"), "medium")
        .when((rate > 0.8) & (start == "medium"), "high")
        .otherwise(start)
    )


def confidence(rule_type: Column, failed: Column, total: Column, has_params: Column, model: bool = False) -> Column:
    """0 to 100: how likely the suggested fix is right."""
    rate = F.coalesce(F.try_element_at(_map(FIX_RATE), rule_type), F.lit(OTHER_FIX_RATE))
    if model:
        rate = F.least(F.lit(1.0), rate + MODEL_BONUS)
    clarity = F.when(has_params, CLARITY_WITH_PARAMS).otherwise(CLARITY_WITHOUT)
    coverage = F.lit(1.0) - failed / F.greatest(total, F.lit(1))
    # The order of the operands decides the last bit, and the score is truncated.
    score = rate * WEIGHT_FIX_RATE + clarity * WEIGHT_CLARITY + coverage * WEIGHT_COVERAGE
    return F.least(F.lit(100), F.greatest(F.lit(0), (score * 100).cast("int")))


def scored(results: DataFrame, model: bool = False) -> DataFrame:
    """Rule results with `severity` adjusted and `confidence` added."""
    kind, failed, total = F.col("rule_type"), F.col("failed_count"), F.col("total_rows")
    return results.withColumns(
        {
            "severity": severity(kind, failed, total, F.col("severity")),
            "confidence": confidence(kind, failed, total, F.col("has_params"), model),
        }
    )


def health_score(
    total_rows: Column, null_count: Column, repeated_rows: Column, failed: Column | None = None, columns: int = 10
) -> Column:
    """0 to 100; nulls cost up to 40 points, repeated rows up to 20, failures up to 40.

    The share of nulls is taken as if the table had `columns` columns.
    """
    rows = F.greatest(total_rows, F.lit(1))

    def cost(part: Column, whole: Column, most: float) -> Column:
        return F.least(F.lit(most), part / whole * 100 * 2)

    score = F.lit(100.0) - cost(null_count, rows * columns, 40.0) - cost(repeated_rows, rows, 20.0)
    if failed is not None:
        score = score - cost(failed, rows, 40.0)
    return F.when(total_rows == 0, 0).otherwise(F.greatest(F.lit(0), score.cast("int")))


def health_trend(runs: DataFrame) -> DataFrame:
    """Runs with `delta`: the change of `score` since the dataset's previous run."""
    order = Window.partitionBy("dataset_name").orderBy("validation_timestamp", "run_id")
    return runs.withColumn("delta", F.col("score") - F.lag("score").over(order))
