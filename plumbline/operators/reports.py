"""Tables built from rule results and violations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.plans.rules import SEVERITIES

# How much of each rule the problem report shows unless told otherwise.
REPORT_INDICES = 10
REPORT_SAMPLE = 3


def run_summary(results: DataFrame) -> DataFrame:
    """One row: rule totals, failed rows in total and by severity, and whether everything passed."""
    failed = ~F.col("passed")
    return results.agg(
        F.count(F.lit(1)).alias("total_rules"),
        F.count_if("passed").alias("passed_rules"),
        F.count_if(failed).alias("failed_rules"),
        F.coalesce(F.sum(F.when(failed, F.col("failed_count"))), F.lit(0)).alias("total_failures"),
        F.coalesce(F.bool_and("passed"), F.lit(True)).alias("all_passed"),
        *[
            F.coalesce(F.sum(F.when(failed & (F.col("severity") == s), F.col("failed_count"))), F.lit(0)).alias(
                f"{s}_failures"
            )
            for s in reversed(SEVERITIES)
        ],
    )


def display_table(results: DataFrame) -> DataFrame:
    """The results as shown to people."""
    return results.select(
        F.col("rule_id").alias("Rule ID"),
        F.col("column_name").alias("Column"),
        F.col("rule_type").alias("Type"),
        F.col("severity").alias("Severity"),
        F.when(F.col("passed"), "PASS").otherwise("FAIL").alias("Status"),
        F.col("passed_count").alias("Passed"),
        F.col("failed_count").alias("Failed"),
        F.col("total_rows").alias("Total"),
    )


def summary_lines(results: DataFrame) -> DataFrame:
    """One line of text per rule."""
    line = F.format_string(
        "[%s] %s | %s → %s | %d/%d failed",
        F.when(F.col("passed"), "PASS").otherwise("FAIL"),
        "rule_id", "column_name", "rule_type", "failed_count", "total_rows",
    )
    return results.select("position", "rule_id", line.alias("line"))


def failure_list(results: DataFrame) -> DataFrame:
    """Failed rules with a label and the number of rows affected."""
    affected = F.concat(F.col("description"), F.lit(" — "), F.col("failed_count"), F.lit(" rows affected"))
    return results.filter(~F.col("passed")).select(
        F.concat("rule_id", F.lit(": "), "column_name", F.lit(" → "), "rule_type").alias("rule"),
        F.when(F.col("failed_count") > 0, affected).otherwise(F.col("description")).alias("description"),
        "severity",
    )


def failed_rows(violations: DataFrame) -> DataFrame:
    """The failing rows of every rule, by key."""
    return violations.select("rule_id", "row_key")


def sample_per_rule(violations: DataFrame, k: int = REPORT_INDICES) -> DataFrame:
    """The first `k` violations of every rule by row key, with their place in `sample_no`.

    A plain window would sort all violations of a rule in one task. Here every task first keeps its own
    smallest `k` per rule; the window filter `row_number <= k` makes Spark do that before the shuffle.
    """
    order = Window.partitionBy("position", "rule_id").orderBy("row_key")
    return violations.withColumn("sample_no", F.row_number().over(order)).filter(F.col("sample_no") <= k)


def problem_report(
    results: DataFrame, violations: DataFrame, indices: int = REPORT_INDICES, samples: int = REPORT_SAMPLE
) -> DataFrame:
    """P001, P002, ... per failed rule in rule order, with the first failing rows and sample values."""
    numbered = results.filter(~F.col("passed")).withColumn(
        "n", F.row_number().over(Window.orderBy("position"))  # one row per rule
    )
    firsts = (
        sample_per_rule(violations, indices)
        .groupBy("position")
        .agg(F.array_sort(F.collect_list(F.struct("sample_no", "row_key", "value"))).alias("s"))
    )
    return numbered.join(firsts, "position", "left").select(
        F.format_string("P%03d", "n").alias("id"),
        "rule_id", "rule_type", F.col("column_name").alias("column"), "severity", "failed_count", "total_rows",
        F.transform("s", lambda s: s["row_key"]).alias("affected"),
        F.transform(F.slice("s", 1, samples), lambda s: s["value"]).alias("sample_values"),
    )


def solution_report(explained: DataFrame) -> DataFrame:
    """S001, S002, ... per explained failure, in order of iteration and rule."""
    order = Window.orderBy("iteration", "position")  # one row per explained rule
    return explained.withColumn("n", F.row_number().over(order)).select(
        F.format_string("S%03d", "n").alias("id"), "iteration", "rule_id", "rule_type",
        F.col("column_name").alias("column"), "root_cause", "explanation", "code_fix", "confidence", "severity",
    )


def report_statistics(problems: DataFrame, solutions: DataFrame) -> DataFrame:
    """One row: numbers of problems and solutions, problems by severity, mean confidence."""
    counted = problems.select("severity", F.lit(None).cast("int").alias("confidence"), F.lit(True).alias("problem"))
    explained = solutions.select(F.lit(None).cast("string").alias("severity"), "confidence", F.lit(False).alias("problem"))
    both = counted.unionByName(explained)
    return both.agg(
        F.count_if("problem").alias("total_problems"),
        F.count_if(~F.col("problem")).alias("total_solutions"),
        *[F.count_if(F.col("problem") & (F.col("severity") == s)).alias(f"{s}_severity") for s in reversed(SEVERITIES)],
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("average_confidence"),
    )
