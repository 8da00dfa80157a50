"""Validate, repair, and validate again, up to a number of rounds.

A round works on one marked frame: a repair changes cells or marks rows as dropped, and notes per row whether
it had an effect there. The frame is written to reliable storage once per round, so the repairs are evaluated
once, their effect is counted by one aggregate, and the plan does not grow from round to round.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import cells, dates
from plumbline.operators import repair, repeats
from plumbline.operators.explain import analyse_failures
from plumbline.operators.validate import RESULT_SCHEMA, local_results, validate
from plumbline.operators.validators import PLACEHOLDERS
from plumbline.plans.checks import data_columns
from plumbline.plans.rules import Rule
from plumbline.sources.storage import cut_lineage

MAX_ITERATIONS = 3

ITERATION_SCHEMA = (
    "run_id STRING, iteration INT, total_rules INT, passed_rules INT, failed_rules INT, total_failures BIGINT, "
    "fixes_attempted INT, fixes_applied INT, status STRING"
)
ATTEMPT_SCHEMA = (
    "run_id STRING, iteration INT, position INT, rule_id STRING, rule_type STRING, column_name STRING, "
    "fix STRING, changed_rows BIGINT, success BOOLEAN, needs_review BOOLEAN"
)

ALIVE = "__alive"


@dataclass(frozen=True)
class Work:
    """What a repair gets: the marked frame, the rule, the row key, and the name of its effect column."""

    frame: DataFrame
    rule: Rule
    row_key: tuple[str, ...]
    effect: str

    @property
    def column(self) -> str:
        return self.rule.column

    @property
    def cell(self) -> Column:
        return F.col(f"`{self.column}`")

    @property
    def dtype(self):
        return self.frame.schema[self.column].dataType

    def change(self, fix: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Apply a repair of cells and note which live rows it changed."""
        before = f"{self.effect}_before"
        fixed = fix(self.frame.withColumn(before, self.cell.cast("string")))
        same = self.cell.cast("string").eqNullSafe(F.col(before))
        return fixed.withColumn(self.effect, F.col(ALIVE) & ~same).drop(before)

    def drop(self, bad: Column) -> DataFrame:
        """Mark rows as dropped."""
        hit = F.col(ALIVE) & F.coalesce(bad, F.lit(False))
        return self.frame.withColumn(self.effect, hit).withColumn(ALIVE, F.col(ALIVE) & ~F.col(self.effect))

    def mark_copies(self, keys: Sequence[str]) -> DataFrame:
        """Note the second and later live rows per key."""
        live = self.frame.filter(ALIVE)
        later = repeats.repeats(live, keys, self.row_key).select(*self.row_key, F.lit(True).alias(self.effect))
        columns = [F.col(f"`{c}`") for c in self.frame.columns]
        effect = F.coalesce(F.col(self.effect), F.lit(False)).alias(self.effect)
        return self.frame.join(later, list(self.row_key), "left").select(*columns, effect)

    def drop_copies(self, keys: Sequence[str]) -> DataFrame:
        return self.mark_copies(keys).withColumn(ALIVE, F.col(ALIVE) & ~F.col(self.effect))


Repair = Callable[[Work], DataFrame]


def _drop_missing(w: Work) -> DataFrame:
    return w.drop(cells.missing(w.cell, w.dtype))


def _null_outside(w: Work) -> DataFrame:
    bounds = w.rule.params.get("min"), w.rule.params.get("max")
    return w.change(lambda df: repair.null_outside(df, w.column, *bounds))


def _zero_negatives(w: Work) -> DataFrame:
    return w.change(lambda df: repair.zero_negatives(df, w.column))


def _null_bad_addresses(w: Work) -> DataFrame:
    return w.change(lambda df: repair.null_bad_addresses(df, w.column))


def _text_to_date(w: Work) -> DataFrame:
    fmt = w.rule.params.get("format", dates.DEFAULT_FORMAT)
    return w.change(lambda df: repair.text_to_date(df, w.column, fmt))


def _fill_missing(w: Work) -> DataFrame:
    return w.change(lambda df: repair.fill_missing(df, w.column, among=F.col(ALIVE)))


def _suffix_copies(w: Work) -> DataFrame:
    marked = w.mark_copies([w.column])
    text = cells.text(w.cell, w.dtype)
    suffixed = F.concat(F.coalesce(text, F.lit("nan")), F.lit(repair.REPEAT_SUFFIX))
    return marked.withColumn(w.column, F.when(F.col(w.effect), suffixed).otherwise(text))


def _null_non_numeric(w: Work) -> DataFrame:
    return w.change(lambda df: repair.null_non_numeric(df, w.column))


def _null_invalid_email(w: Work) -> DataFrame:
    return w.change(lambda df: repair.null_invalid_email(df, w.column))


def _standardize_dates(w: Work) -> DataFrame:
    return w.change(lambda df: repair.standardize_dates(df, w.column))


def _null_placeholders(w: Work) -> DataFrame:
    words = w.rule.params.get("values", PLACEHOLDERS)
    return w.change(lambda df: repair.null_placeholders(df, w.column, words))


def _drop_column_copies(w: Work) -> DataFrame:
    return w.drop_copies([w.column])


def _drop_row_copies(w: Work) -> DataFrame:
    own = [c for c in data_columns(w.frame.columns) if not c.startswith("__")]
    return w.drop_copies(list(w.rule.params.get("columns") or own))


# The general repair of a rule type, tried first, and its specific repair, tried when that had no effect.
TEMPLATE_REPAIRS: dict[str, Repair] = {
    "not_null": _drop_missing,
    "unique": _drop_column_copies,
    "range": _null_outside,
    "positive": _zero_negatives,
    "email": _null_bad_addresses,
    "date": _text_to_date,
}
TYPED_REPAIRS: dict[str, Repair] = {
    "not_null": _fill_missing,
    "unique": _suffix_copies,
    "range": _null_non_numeric,
    "age": _null_non_numeric,
    "salary": _null_non_numeric,
    "transaction_amount": _null_non_numeric,
    "email": _null_invalid_email,
    "date": _standardize_dates,
    "date_format": _standardize_dates,
    "future_date": _standardize_dates,
    "placeholder": _null_placeholders,
    "duplicate_row": _drop_row_copies,
}
# Nothing is changed for these; somebody has to look.
REVIEW_ONLY = {"outlier", "regex", "phone", "customer_id_pattern"}
# Repairs that join, so that what follows should not run them again.
_SHUFFLING = {_drop_column_copies, _drop_row_copies, _suffix_copies}


def repair_round(
    df: DataFrame, failed: Sequence[Rule], row_key: Sequence[str], prefer: str = "template"
) -> tuple[DataFrame, list[dict]]:
    """Repair the failures of some rules in their order; returns the repaired data and one record per attempt.

    `prefer="typed"` skips the general repairs.
    """
    work, attempts, fresh = df.withColumn(ALIVE, F.lit(True)), [], True
    for n, rule in enumerate(failed):
        if rule.column not in df.columns and rule.column != "_all":
            continue
        attempt = {"rule": rule, "place": n, "fix": "none", "effect": None, "needs_review": rule.type in REVIEW_ONLY}
        attempts.append(attempt)
        general, specific = TEMPLATE_REPAIRS.get(rule.type), TYPED_REPAIRS.get(rule.type)
        options = [r for r in ([general] if prefer == "template" else []) + [specific] if r is not None]
        for i, option in enumerate(options):
            if not fresh:  # shuffling repairs are pending and would run once more for this one
                work, fresh = cut_lineage(work), True
            effect = f"__effect_{n}"
            tried = option(Work(work, rule, tuple(row_key), effect))
            # Whether the specific repair is needed shows with the first row the general one changed.
            if i + 1 < len(options) and tried.filter(effect).isEmpty():
                continue
            work, attempt["fix"], attempt["effect"] = tried, option.__name__.strip("_"), effect
            fresh = option not in _SHUFFLING
            break
    effects = [a["effect"] for a in attempts if a["effect"]]
    if effects:
        work = cut_lineage(work)
        counts = work.agg(*[cells.count_where(F.col(e)).alias(e) for e in effects]).first().asDict()
        for a in attempts:
            a["changed_rows"] = counts.get(a["effect"], 0)
    kept = work.filter(ALIVE).select(*[F.col(f"`{c}`") for c in df.columns])
    return kept, attempts


@dataclass(frozen=True)
class LoopResult:
    """What the loop did. All tables but `final` have one row per round or per rule and round."""

    run_id: str
    status: str
    iterations: DataFrame
    attempts: DataFrame
    analyses: DataFrame
    final: DataFrame

    def improvement(self) -> DataFrame:
        return loop_improvement(self.iterations)


def run_loop(
    df: DataFrame,
    rules: Iterable[Rule],
    row_key: Sequence[str],
    max_iterations: int = MAX_ITERATIONS,
    as_of: dt.date | str | None = None,
    prefer: str = "template",
    run_id: str | None = None,
) -> LoopResult:
    """Run the loop. `row_key` must identify rows and must not be a column that a repair changes.

    The status is `completed` when all rules pass, `stalled` when a round changed nothing, and otherwise
    `max_reached`. After the last round the data is validated once more.
    """
    spark, rules, run_id = df.sparkSession, list(rules), run_id or uuid.uuid4().hex
    iterations, attempts, analyses = [], [], []
    current, status = df, "max_reached"
    for iteration in range(1, max_iterations + 2):
        results = local_results(validate(current, rules, row_key, as_of, run_id).rule_results)
        failures = [r for r in results if not r["passed"]]
        entry = {
            "run_id": run_id, "iteration": iteration, "total_rules": len(results),
            "passed_rules": len(results) - len(failures), "failed_rules": len(failures),
            "total_failures": sum(r["failed_count"] for r in failures),
            "fixes_attempted": 0, "fixes_applied": 0, "status": "all_passed",
        }
        iterations.append(entry)
        if not failures:
            status = "completed"
            break
        if iteration > max_iterations:
            entry["status"] = "failures_remain"
            break
        explained = analyse_failures(spark.createDataFrame(results, RESULT_SCHEMA), rules, top=None)
        analyses.append(explained.withColumn("iteration", F.lit(iteration)))
        current, done = repair_round(current, [rules[r["position"]] for r in failures], row_key, prefer)
        for a in done:
            changed = a.get("changed_rows", 0)
            attempts.append(
                (run_id, iteration, failures[a["place"]]["position"], a["rule"].id, a["rule"].type, a["rule"].column,
                 a["fix"], changed, changed > 0, a["needs_review"])
            )
        entry["fixes_attempted"] = len(done)
        entry["fixes_applied"] = sum(a.get("changed_rows", 0) > 0 for a in done)
        entry["status"] = "fixes_applied" if entry["fixes_applied"] else "no_fixes"
        if not entry["fixes_applied"]:
            status = "stalled"  # another round would find and do the same
            break
    empty = analyse_failures(spark.createDataFrame([], RESULT_SCHEMA), [], None).withColumn("iteration", F.lit(0))
    for part in analyses:
        empty = empty.unionByName(part)
    return LoopResult(
        run_id,
        status,
        spark.createDataFrame(iterations, ITERATION_SCHEMA),
        spark.createDataFrame(attempts, ATTEMPT_SCHEMA),
        empty,
        current,
    )


def loop_improvement(iterations: DataFrame) -> DataFrame:
    """One row per run: failures at the first and the last validation, and how many fewer in percent."""
    ends = iterations.groupBy("run_id").agg(
        F.max("iteration").alias("validations"),
        F.min_by("total_failures", "iteration").alias("initial_failures"),
        F.max_by("total_failures", "iteration").alias("final_failures"),
        F.max_by("status", "iteration").alias("final_status"),
    )
    fewer = (F.col("initial_failures") - F.col("final_failures")) / F.greatest("initial_failures", F.lit(1)) * 100
    return ends.withColumn("reduction_pct", F.bround(fewer, 1))
