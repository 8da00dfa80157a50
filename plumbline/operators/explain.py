"""Explanations of failed rules from fixed templates; no network and no model."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.scoring import scored
from plumbline.plans.rules import Rule

TEMPLATE_CONFIDENCE = 60

# ---- fixed values: root cause and SQL fix per rule type; the code fix is for a Spark DataFrame `df` ---
TEMPLATES = {
    "not_null": (
        "Column '{column}' contains {failed} null values.",
        "DELETE FROM table_name WHERE {column} IS NULL;",
        "df = df.na.drop(subset=['{column}'])",
    ),
    "unique": (
        "Column '{column}' has {failed} duplicate values.",
        "DELETE FROM table_name WHERE rowid NOT IN (SELECT MIN(rowid) FROM table_name GROUP BY {column});",
        "df = keep_first(df, ['{column}'], row_key)",
    ),
    "range": (
        "Column '{column}' has values outside expected range.",
        "UPDATE table_name SET {column} = NULL WHERE {column} < {min} OR {column} > {max};",
        "df = null_outside(df, '{column}', {min}, {max})",
    ),
    "positive": (
        "Column '{column}' has negative values.",
        "UPDATE table_name SET {column} = 0 WHERE {column} < 0;",
        "df = zero_negatives(df, '{column}')",
    ),
    "outlier": (
        "Column '{column}' has statistical outliers.",
        "-- Review outliers in {column}",
        "# Review and cap outliers in {column}",
    ),
    "email": (
        "Column '{column}' has invalid email formats.",
        "UPDATE table_name SET {column} = NULL WHERE {column} NOT LIKE '%_@_%.__%';",
        "df = null_bad_addresses(df, '{column}')",
    ),
    "date": (
        "Column '{column}' has invalid date formats.",
        "UPDATE table_name SET {column} = NULL WHERE {column} NOT LIKE '____-__-__';",
        "df = text_to_date(df, '{column}')",
    ),
}
OTHER = (
    "Column '{column}' failed {type} with {failed} failures.",
    "-- Manual review needed for {column}",
    "# Manual review needed for {column}",
)
EXPLANATION = "The {type} check on '{column}' found {failed} issues."
IMPACT = "Data quality issues may cause incorrect reporting or downstream errors."
PREVENTION = "Add {type} validation at data ingestion."
PERMANENT = "Implement automated {type} checks."


def _filled(template: Column, rules: bool) -> Column:
    fields = {
        "{type}": F.col("rule_type"),
        "{column}": F.col("column_name"),
        "{failed}": F.col("failed_count").cast("string"),
    }
    if rules:
        # A range without bounds is checked against 0 and 120.
        fields["{min}"] = F.coalesce(F.col("__min"), F.lit("0"))
        fields["{max}"] = F.coalesce(F.col("__max"), F.lit("120"))
    for name, value in fields.items():
        template = F.replace(template, F.lit(name), value)
    return template


def explain_failures(results: DataFrame, rules: Iterable[Rule] = ()) -> DataFrame:
    """Failed rules with root cause, explanation, impact, fixes and prevention.

    `rules` supplies the bounds of `range` rules; the list is small (it was written by hand or suggested)
    and joined by broadcast.
    """
    spark = results.sparkSession
    templates = spark.createDataFrame(
        [(k, *v) for k, v in TEMPLATES.items()], "rule_type STRING, __root STRING, __sql STRING, __code STRING"
    )
    bounds = spark.createDataFrame(
        [
            (r.id, None if r.params.get("min") is None else str(r.params["min"]),
             None if r.params.get("max") is None else str(r.params["max"]))
            for r in rules if r.type == "range"
        ],
        "rule_id STRING, __min STRING, __max STRING",
    )
    joined = (
        results.filter(~F.col("passed"))
        .join(F.broadcast(templates), "rule_type", "left")
        .join(F.broadcast(bounds.dropDuplicates(["rule_id"])), "rule_id", "left")
    )

    def text(column: str, n: int) -> Column:
        return _filled(F.coalesce(F.col(column), F.lit(OTHER[n])), True)

    return joined.select(
        "run_id", "position", "rule_id", "rule_type", "column_name", "severity", "has_params",
        "total_rows", "failed_count",
        text("__root", 0).alias("root_cause"),
        _filled(F.lit(EXPLANATION), False).alias("explanation"),
        F.lit(IMPACT).alias("business_impact"),
        text("__sql", 1).alias("sql_fix"),
        text("__code", 2).alias("code_fix"),
        _filled(F.lit(PREVENTION), False).alias("prevention"),
        F.lit(TEMPLATE_CONFIDENCE).alias("confidence"),
        F.col("failed_count").alias("estimated_affected_rows"),
        _filled(F.lit(PERMANENT), False).alias("permanent_fix"),
        F.lit("template").alias("provider"),
    )


def analyse_failures(results: DataFrame, rules: Iterable[Rule] = (), top: int | None = 5) -> DataFrame:
    """The first failed rules, explained and scored; `top=None` takes them all."""
    chosen = results.filter(~F.col("passed"))
    if top is not None:
        chosen = chosen.orderBy("position").limit(top)
    return scored(explain_failures(chosen, rules))
