"""The history of runs: seven append-only Parquet tables.

Nothing is rewritten in place. A change of status is a new version of the row, and readers take the latest
version by key; a deletion is a row in a table of removed runs. `compact` rewrites the tables without what is
no longer visible. Several writers may append at the same time; `compact` and `clear` need the store alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.reports import run_summary, sample_per_rule
from plumbline.operators.sketches import SKETCH_SCHEMA
from plumbline.sources.storage import cut_lineage, drop_scratch, scratch_path, shuffles_dropped

# The tables, their columns, and how much of a result is kept.
SCHEMAS = {
    "validation_runs": (
        "run_id STRING, dataset_name STRING, total_rows BIGINT, total_columns INT, total_rules BIGINT, "
        "passed_rules BIGINT, failed_rules BIGINT, total_failures BIGINT, overall_status STRING, "
        "validation_timestamp TIMESTAMP, metadata MAP<STRING,STRING>"
    ),
    "validation_results": (
        "result_id STRING, run_id STRING, rule_id STRING, column_name STRING, validation_type STRING, "
        "severity STRING, confidence_score INT, passed BOOLEAN, total_rows BIGINT, passed_count BIGINT, "
        "failed_rows BIGINT, failed_keys ARRAY<STRING>, error_details ARRAY<STRING>"
    ),
    "failed_records": (
        "record_id STRING, run_id STRING, result_id STRING, rule_id STRING, column_name STRING, "
        "sample_no INT, row_key STRING, invalid_value STRING, failure_reason STRING"
    ),
    "ai_analysis": (
        "analysis_id STRING, run_id STRING, result_id STRING, rule_id STRING, validation_type STRING, "
        "column_name STRING, root_cause STRING, explanation STRING, business_impact STRING, "
        "recommendation STRING, severity STRING, confidence_score INT, estimated_affected_rows BIGINT, "
        "permanent_fix STRING, provider STRING, created_at TIMESTAMP"
    ),
    "remediation_suggestions": (
        "remediation_id STRING, run_id STRING, result_id STRING, rule_id STRING, validation_type STRING, "
        "column_name STRING, sql_fix STRING, code_fix STRING, confidence_score INT, fix_applied BOOLEAN, "
        "created_at TIMESTAMP"
    ),
    "agent_iterations": (
        "iteration_id STRING, run_id STRING, iteration_number INT, action_taken STRING, passed_rules INT, "
        "failed_rules INT, total_failures BIGINT, fixes_applied INT, validation_status STRING, "
        "timestamp TIMESTAMP, details MAP<STRING,STRING>"
    ),
    "api_validation_results": (
        "api_id STRING, run_id STRING, email STRING, api_status STRING, is_valid BOOLEAN, "
        "confidence_score INT, response STRING, created_at TIMESTAMP"
    ),
}
KEYS = {
    "validation_runs": "run_id", "validation_results": "result_id", "failed_records": "record_id",
    "ai_analysis": "analysis_id", "remediation_suggestions": "remediation_id",
    "agent_iterations": "iteration_id", "api_validation_results": "api_id",
}
# The tables that go with a run when it is deleted; e-mail verdicts stay.
CHILDREN = ("validation_results", "failed_records", "ai_analysis", "remediation_suggestions", "agent_iterations")
# The tables whose rows change after they were written.
VERSIONED = ("validation_runs", "remediation_suggestions")
REMOVED = "removed_runs"
# Profiles that merge; kept beside the seven tables.
SKETCHES = "column_sketches"
# The partition of a row: the month of the day it belongs to.
MONTH = "run_month"
# What the newest-first readers return unless told otherwise, and how many keys and messages a result row shows.
RECENT_RUNS, RECENT = 20, 50
SHOWN_KEYS, SHOWN_MESSAGES = 50, 20
# When a row happened, by table; its month is the partition that the row is stored in.
HAPPENED = {
    "validation_runs": "validation_timestamp", "ai_analysis": "created_at", "remediation_suggestions": "created_at",
    "agent_iterations": "timestamp", "api_validation_results": "created_at",
}


def latest(versions: DataFrame, key: str) -> DataFrame:
    """The newest version of every row.

    A grouped `max_by` keeps one row per key in each task, so many versions of one key cost no skew. The run of a
    row never changes, so it is a grouping column too, and a filter on it reaches the files.
    """
    keys = list(dict.fromkeys([key, *[c for c in ("run_id",) if c in versions.columns]]))
    data = [c for c in versions.columns if c not in (*keys, "updated_at")]
    newest = versions.groupBy(*keys).agg(F.max_by(F.struct(*data), F.struct("version", "updated_at")).alias("row"))
    return newest.select(*keys, *[F.col(f"row.{c}").alias(c) for c in data])


def result_id() -> Column:
    """A result is identified by its run and rule, so every table can name it without a lookup."""
    return F.concat_ws(":", "run_id", "rule_id")


def _now() -> Column:
    return F.current_timestamp()


class History:
    """A store of runs below `path`, which must be a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    # ---- storage -----------------------------------------------------------------------------

    def _append(self, table: str, rows: DataFrame, version: Column | None = None, derived: Mapping[str, Column] | None = None) -> None:
        """Append rows in the declared schema, in a partition for the month they belong to.

        Rows are gathered by month before they are written, large months split into several files and small ones put
        together, so the number of files follows the months touched and the size, not the tasks. Inside, rows are in
        order of day and run, so that a filter on either skips row groups by their statistics. `derived` has columns that
        follow from the others of a row: they are made after the rows are gathered, so that they aren't shuffled.
        """
        schema = T.StructType.fromDDL(SCHEMAS[table])
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]
        happened = F.to_date(F.col(HAPPENED[table]).cast("timestamp")) if table in HAPPENED else F.lit(None).cast("date")
        day = F.coalesce(happened, F.current_date())
        dated = rows.withColumns({"run_date": day, MONTH: F.date_format(day, "yyyy-MM")})
        gathered = dated.hint("rebalance", F.col(MONTH)).withColumns(dict(derived or {}))
        shaped = gathered.select(*columns, (F.lit(1) if version is None else version).cast("bigint").alias("version"), _now().alias("updated_at"), "run_date", MONTH)
        self._write(table, shaped.sortWithinPartitions(MONTH, "run_date", "run_id"))

    def _write(self, table: str, rows: DataFrame) -> None:
        """Append rows by month; ids of neighbouring rows are alike, so zstd makes them small. What was shuffled for it goes at once."""
        with shuffles_dropped(self.spark):
            rows.write.mode("append").option("compression", "zstd").partitionBy(MONTH).parquet(f"{self.path}/{table}")

    def _stored(self, table: str) -> DataFrame:
        """All versions of all rows; an empty table when nothing was written yet."""
        extra = f", version BIGINT, updated_at TIMESTAMP, run_date DATE, {MONTH} STRING"
        schema = (SCHEMAS[table] if table in SCHEMAS else "run_id STRING") + extra
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{table}")
        except AnalysisException:  # nothing was written yet: known while planning, so that joins with it fall away
            nothing = self.spark.range(1).where(F.lit(False))
            return nothing.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema)])

    def _removed(self) -> DataFrame:
        return self._stored(REMOVED).select("run_id").distinct()

    def table(self, name: str) -> DataFrame:
        """The visible rows of a table: latest versions, without deleted runs."""
        return self._visible(name).select(*T.StructType.fromDDL(SCHEMAS[name]).names)

    def _visible(self, name: str) -> DataFrame:
        rows = self._stored(name).drop("run_date", MONTH)
        rows = latest(rows, KEYS[name]) if name in VERSIONED else rows.drop("updated_at")
        if name == "validation_runs" or name in CHILDREN:
            rows = rows.join(self._removed(), "run_id", "left_anti")
        return rows

    # ---- writing -----------------------------------------------------------------------------

    def save_run(
        self,
        dataset_name: str,
        results: DataFrame,
        violations: DataFrame | None = None,
        total_columns: int = 0,
        metadata: Mapping[str, str] | None = None,
        run_id: str | None = None,
        sample: int | None = None,
    ) -> str:
        """Save one run, its rule results and its violations: all of them, or the first `sample` of each rule."""
        run_id = run_id or uuid.uuid4().hex
        results = cut_lineage(results)  # one row per rule; the validation must not run once per table
        pairs = [F.lit(x) for item in (metadata or {}).items() for x in item]
        totals = run_summary(results).select(
            F.lit(run_id).alias("run_id"), F.lit(dataset_name).alias("dataset_name"),
            F.lit(total_columns).alias("total_columns"),
            "total_rules", "passed_rules", "failed_rules", "total_failures",
            F.when(F.col("all_passed"), "passed").otherwise("failed").alias("overall_status"),
            _now().alias("validation_timestamp"),
            (F.create_map(*pairs) if pairs else F.expr("CAST(map() AS MAP<STRING,STRING>)")).alias("metadata"),
            results.agg(F.coalesce(F.max("total_rows"), F.lit(0)).alias("n")).scalar().alias("total_rows"),
        )
        self._append("validation_runs", totals)
        self.save_results(results.withColumn("run_id", F.lit(run_id)), violations, sample)
        return run_id

    def save_results(
        self,
        results: DataFrame,
        violations: DataFrame | None = None,
        sample: int | None = None,
        keys: int = SHOWN_KEYS,
        messages: int = SHOWN_MESSAGES,
    ) -> None:
        """Append rule results (of one or many runs) and their violations.

        A result row shows its first `keys` keys and `messages` messages; the failed records are complete unless
        `sample` says how many of each rule are kept.
        """
        if violations is None:
            shown_keys = shown_messages = F.expr("CAST(array() AS ARRAY<STRING>)")
            rows = results
        else:
            names = violations.schema["row_key"].dataType.names
            label = F.concat_ws("/", *[F.col("row_key")[n].cast("string") for n in names])
            found = violations.drop("run_id")
            columns = ["rule_id", "column_name", "sample_no", "value", "reason", label.alias("row_key")]
            first = cut_lineage(sample_per_rule(found, max(keys, messages, sample or 0)).select(*columns))
            listed = first.groupBy("rule_id").agg(
                F.array_sort(F.collect_list(F.struct("sample_no", "row_key", "reason"))).alias("s")
            )
            rows = results.join(listed, "rule_id", "left")
            shown_keys = F.coalesce(F.transform(F.slice("s", 1, keys), lambda s: s["row_key"]), F.array())
            shown_messages = F.coalesce(F.transform(F.slice("s", 1, messages), lambda s: s["reason"]), F.array())
            if sample is None:
                kept = found.withColumn("sample_no", F.lit(None).cast("int")).select(*columns)
            else:
                kept = first.filter(F.col("sample_no") <= sample)
            self.save_failed_records(kept.join(results.select("run_id", "rule_id"), "rule_id"))
        self._append(
            "validation_results",
            rows.select(
                "run_id", "rule_id", "column_name", F.col("rule_type").alias("validation_type"),
                "severity", F.lit(0).alias("confidence_score"), "passed", "total_rows", "passed_count",
                F.col("failed_count").alias("failed_rows"), shown_keys.alias("failed_keys"),
                shown_messages.alias("error_details"),
            ),
            derived={"result_id": result_id()},
        )

    def save_failed_records(self, violations: DataFrame) -> None:
        """Append violations: (run_id, rule_id, column_name, sample_no, row_key, value, reason)."""
        place = F.coalesce(F.col("sample_no").cast("string"), "row_key")
        self._append(
            "failed_records",
            violations.select(
                "run_id", "rule_id", "column_name", "sample_no", F.col("row_key").cast("string").alias("row_key"),
                F.coalesce("value", F.lit("nan")).alias("invalid_value"),
                F.col("reason").alias("failure_reason"),
            ),
            derived={"record_id": F.concat_ws(":", "run_id", "rule_id", place), "result_id": result_id()},
        )

    def save_analyses(self, explained: DataFrame) -> None:
        """Append explanations; those with a fix also become remediation suggestions.

        Both are identified by their run, rule and round of the loop (0 outside of one).
        """
        round_ = F.coalesce("iteration", F.lit(0)) if "iteration" in explained.columns else F.lit(0)
        common = ["run_id", "rule_id", F.col("rule_type").alias("validation_type"), "column_name"]
        written = scratch_path(self.spark, "explained")  # the source must not run once per table
        explained.select(
            *common, "root_cause", "explanation", "business_impact", F.col("prevention").alias("recommendation"),
            "severity", F.col("confidence").alias("confidence_score"), "estimated_affected_rows", "permanent_fix", "provider",
            F.col("sql_fix").cast("string").alias("sql_fix"), F.col("code_fix").cast("string").alias("code_fix"), round_.cast("string").alias("round"),
        ).write.option("compression", "zstd").parquet(written)
        rows = self.spark.read.parquet(written).withColumn("created_at", _now())
        key = F.concat_ws(":", result_id(), "round")
        self._append("ai_analysis", rows, derived={"analysis_id": key, "result_id": result_id()})
        has_fix = (F.coalesce("sql_fix", F.lit("")) != "") | (F.coalesce("code_fix", F.lit("")) != "")
        fixes = rows.filter(has_fix).withColumn("fix_applied", F.lit(False))
        self._append("remediation_suggestions", fixes, derived={"remediation_id": key, "result_id": result_id()})
        drop_scratch(self.spark, written)

    def save_iterations(self, iterations: DataFrame) -> None:
        """Append the rounds of a loop."""
        action = F.format_string("Iteration %d: %s", "iteration", "status")
        self._append(
            "agent_iterations",
            iterations.select(
                F.concat_ws(":", "run_id", "iteration").alias("iteration_id"), "run_id",
                F.col("iteration").alias("iteration_number"), action.alias("action_taken"), "passed_rules",
                "failed_rules", "total_failures", "fixes_applied", F.col("status").alias("validation_status"),
                _now().alias("timestamp"),
                F.create_map(F.lit("fixes_attempted"), F.col("fixes_attempted").cast("string")).alias("details"),
            ),
        )

    def save_email_verdicts(self, verdicts: DataFrame, run_id: str | None = None) -> None:
        """Append (email, verdict struct) rows."""
        v = F.col("verdict")
        self._append(
            "api_validation_results",
            verdicts.select(
                F.sha2(F.concat_ws(":", F.lit(run_id).cast("string"), "email"), 256).alias("api_id"), F.lit(run_id).cast("string").alias("run_id"), "email",
                v["api_status"].alias("api_status"), v["is_valid"].alias("is_valid"),
                v["confidence"].alias("confidence_score"), F.to_json(v).alias("response"), _now().alias("created_at"),
            ),
        )

    def save_sketches(self, dataset_name: str, run_id: str, sketches: DataFrame, day: str | None = None) -> None:
        """Append the column sketches of a run (`column_sketches`); they merge over runs and days without the data."""
        happened = F.current_date() if day is None else F.lit(day).cast("date")
        rows = sketches.withColumns({"dataset_name": F.lit(dataset_name), "run_id": F.lit(run_id), "run_date": happened, MONTH: F.date_format(happened, "yyyy-MM")})
        rows.hint("rebalance", F.col(MONTH)).write.mode("append").partitionBy(MONTH).parquet(f"{self.path}/{SKETCHES}")

    def sketches(self) -> DataFrame:
        """(dataset_name, run_id, run_date, the sketch columns) of every run that was not deleted."""
        schema = f"{SKETCH_SCHEMA}, dataset_name STRING, run_id STRING, run_date DATE, {MONTH} STRING"
        try:
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/{SKETCHES}")
        except AnalysisException:  # nothing was written yet
            rows = self.spark.createDataFrame([], schema)
        return rows.drop(MONTH).join(self._removed(), "run_id", "left_anti")

    def append(self, table: str, rows: DataFrame) -> None:
        """Append rows that already have the table's columns."""
        self._append(table, rows)

    # ---- changing ----------------------------------------------------------------------------

    def update_run_status(self, run_id: str, status: str) -> None:
        self._new_version("validation_runs", run_id, "overall_status", F.lit(status))

    def mark_remediation_applied(self, remediation_id: str) -> None:
        self._new_version("remediation_suggestions", remediation_id, "fix_applied", F.lit(True))

    def _new_version(self, table: str, key: str, column: str, value: Column) -> None:
        self.change_rows(table, F.col(KEYS[table]) == key, column, value)

    def change_rows(self, table: str, which: Column, column: str, value: Column) -> None:
        """Write a new version of the rows that match. The files to read are listed before any is added."""
        rows = self._visible(table).filter(which).withColumn(column, value)
        self._append(table, rows, F.col("version") + 1)

    def delete_run(self, run_id: str) -> None:
        """Hide a run and everything recorded for it, except e-mail verdicts."""
        self.delete_runs(self.spark.createDataFrame([(run_id,)], "run_id STRING"))

    def delete_runs(self, runs: DataFrame) -> None:
        gone = runs.select("run_id").withColumns({"updated_at": _now(), "run_date": F.current_date()})
        gone.hint("rebalance").write.mode("append").parquet(f"{self.path}/{REMOVED}")

    def clear(self) -> None:
        """Empty all tables."""
        for name in (*SCHEMAS, REMOVED):
            empty = self.spark.createDataFrame([], self._stored(name).schema)
            empty.write.mode("overwrite").parquet(f"{self.path}/{name}")
        self.sketches().limit(0).write.mode("overwrite").parquet(f"{self.path}/{SKETCHES}")

    def compact(self, target: str) -> History:
        """Write the visible rows to a new store and return it."""
        fresh = History(self.spark, target)
        for name in SCHEMAS:
            fresh._append(name, self.table(name))
        kept = self.sketches().withColumn(MONTH, F.date_format("run_date", "yyyy-MM"))
        kept.hint("rebalance", F.col(MONTH)).write.mode("append").partitionBy(MONTH).parquet(f"{fresh.path}/{SKETCHES}")
        return fresh

    # ---- reading -----------------------------------------------------------------------------

    def recent_runs(self, limit: int = RECENT_RUNS) -> DataFrame:
        return recent(self.table("validation_runs").drop("metadata"), "validation_timestamp", "run_id", limit)

    def run_details(self, run_id: str) -> dict[str, DataFrame]:
        """The run and everything recorded for it, table by table."""
        return {n: self.table(n).filter(F.col("run_id") == run_id) for n in ("validation_runs", *CHILDREN)}

    def analyses(self, run_id: str | None = None, limit: int = RECENT) -> DataFrame:
        return _by_run_or_recent(self.table("ai_analysis"), "created_at", "analysis_id", run_id, limit)

    def remediations(self, run_id: str | None = None, limit: int = RECENT) -> DataFrame:
        return _by_run_or_recent(self.table("remediation_suggestions"), "created_at", "remediation_id", run_id, limit)

    def iterations(self, run_id: str | None = None, limit: int = RECENT) -> DataFrame:
        rows = self.table("agent_iterations")
        if run_id is not None:
            return rows.filter(F.col("run_id") == run_id).orderBy("iteration_number")
        return recent(rows, "timestamp", "iteration_id", limit)

    def email_verdicts(self, limit: int = RECENT) -> DataFrame:
        return recent(self.table("api_validation_results"), "created_at", "api_id", limit)

    def failed_records(self, run_id: str, limit: int | None = None) -> DataFrame:
        rows = self.table("failed_records").filter(F.col("run_id") == run_id).orderBy("rule_id", "sample_no", "row_key")
        return rows if limit is None else rows.limit(limit)

    def statistics(self) -> DataFrame:
        return statistics({n: self.table(n) for n in SCHEMAS})


# ---- reports over history tables, wherever they are kept ---------------------------------------


def recent(rows: DataFrame, when: str, key: str, limit: int) -> DataFrame:
    """The newest rows: a top-k."""
    return rows.orderBy(F.desc(when), key).limit(limit)


def _by_run_or_recent(rows: DataFrame, when: str, key: str, run_id: str | None, limit: int) -> DataFrame:
    if run_id is not None:
        return rows.filter(F.col("run_id") == run_id).orderBy(F.desc(when), key)
    return recent(rows, when, key, limit)


def run_overview(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Every run with the number of its rows in each child table."""
    runs = tables["validation_runs"]
    for name in CHILDREN:
        counted = tables[name].groupBy("run_id").agg(F.count(F.lit(1)).alias(name))
        runs = runs.join(counted, "run_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return runs


def statistics(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row: the size of every table, the rules checked, and the share of them that passed."""
    runs = tables["validation_runs"].agg(
        F.count(F.lit(1)).alias("validation_runs"),
        F.coalesce(F.sum("passed_rules"), F.lit(0)).alias("p"),
        F.coalesce(F.sum("failed_rules"), F.lit(0)).alias("f"),
    )
    checked = F.col("p") + F.col("f")
    others = [
        tables[n].agg(F.count(F.lit(1)).alias("n")).scalar().alias(n) for n in SCHEMAS if n != "validation_runs"
    ]
    return runs.select(
        "validation_runs", *others,
        checked.alias("total_rules_checked"),
        F.bround(F.col("p") / F.greatest(F.lit(1), checked) * 100, 1).alias("pass_rate"),
    )

