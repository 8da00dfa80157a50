"""Run a list of rules over a table.

All rules that look at one row share one aggregate over one scan. Rules about repeated keys add one
`groupBy` per distinct key set, rules on groups one for each set of grouping columns, rules that refer to another
table one `groupBy` and a join of distinct keys, rules on the order of rows or the outliers of groups a sort by ranges. Quartiles for `outlier` rules are found beforehand for all columns at once, by
jobs that run while binding and collect one bounded row; results and violations stay lazy DataFrames.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import cells
from plumbline.operators.group_outliers import group_outliers
from plumbline.operators.group_rules import grouped
from plumbline.operators.quantiles import exact_quantiles
from plumbline.operators.references import Reference
from plumbline.operators.repeats import repeat_counts, repeats
from plumbline.operators.sequences import broken_order
from plumbline.operators.validators import OUTLIER_PROBS, Shared, Target, as_of_date, bind, outside
from plumbline.plans.checks import (
    NO_VALUE,
    Broken,
    Check,
    GroupCheck,
    GroupOutlierCheck,
    Message,
    ReferenceCheck,
    RepeatCheck,
    RowCheck,
    SequenceCheck,
    ShareCheck,
    Skipped,
)
from plumbline.plans.rules import Rule

RESULT_SCHEMA = (
    "run_id STRING, position INT, rule_id STRING, rule_type STRING, column_name STRING, severity STRING, "
    "description STRING, has_params BOOLEAN, status STRING, passed BOOLEAN, total_rows BIGINT, "
    "passed_count BIGINT, failed_count BIGINT, error STRING"
)

_KNOWN = (
    "run_id STRING, position INT, rule_id STRING, rule_type STRING, column_name STRING, severity STRING, "
    "description STRING, has_params BOOLEAN, status STRING, error STRING"
)

# Rules per aggregate, and rules per projection of violations. A projection becomes one generated method, and
# the JVM does not compile methods above 8000 bytes (measured: ten rules in a method cost four times as much as
# six); rules are put together by column, so that several passes read few columns twice.
RULES_PER_PASS = 100
VIOLATION_RULES_PER_PASS = 6


@dataclass
class _Bound:
    position: int
    rule: Rule
    check: Check

    def known(self, run_id: str) -> dict:
        """The part of the result that does not depend on the data."""
        status, error = "ok", None
        if isinstance(self.check, Broken):
            status, error = "error", self.check.message
        elif isinstance(self.check, Skipped):
            status, error = "skipped", self.check.message
        elif isinstance(self.check, RowCheck):
            error = self.check.warning
        rule = self.rule
        return {
            "run_id": run_id, "position": self.position, "rule_id": rule.id, "rule_type": rule.type,
            "column_name": rule.column, "severity": rule.severity, "description": rule.description,
            "has_params": bool(rule.params), "status": status, "error": error,
        }


class ValidationRun:
    """The outcome of `validate`: lazy tables over one input."""

    def __init__(self, df: DataFrame, bound: list[_Bound], run_id: str, key: Sequence[str] | None):
        self.run_id = run_id
        self.key = list(key) if key else None
        self._df = df  # with the columns that checks prepared
        self._bound = bound

    def _of(self, *kinds: type) -> list[_Bound]:
        return [b for b in self._bound if isinstance(b.check, kinds)]

    @cached_property
    def rule_results(self) -> DataFrame:
        """One row per rule (see `RESULT_SCHEMA`)."""
        spark = self._df.sparkSession
        parts = []
        single = self._of(RowCheck, ShareCheck, Broken, Skipped)
        for at in range(0, len(single), RULES_PER_PASS):
            parts.append(self._one_pass(single[at : at + RULES_PER_PASS]))
        by_key: dict[frozenset, list[_Bound]] = {}
        for b in self._of(RepeatCheck):
            by_key.setdefault(frozenset(b.check.keys), []).append(b)
        for group in by_key.values():
            parts.append(self._repeat_pass(group))
        parts += [self._reference_pass(b) for b in self._of(ReferenceCheck)]
        parts += [self._failing_pass(b, self._out_of_order(b)) for b in self._of(SequenceCheck)]
        parts += [self._failing_pass(b, self._out_of_group(b)) for b in self._of(GroupOutlierCheck)]
        parts += [self._group_pass(bound, table) for bound, table in self._group_tables()]
        if not parts:
            return spark.createDataFrame([], RESULT_SCHEMA)
        return reduce(DataFrame.unionByName, parts)

    def _one_pass(self, bound: list[_Bound]) -> DataFrame:
        total, measures, failed = F.col("total"), [F.count(F.lit(1)).alias("total")], []
        for b in bound:
            count = F.col(f"f{b.position}")
            if isinstance(b.check, (RowCheck, ShareCheck)):
                measures.append(cells.count_where(b.check.fails).alias(f"f{b.position}"))
            if isinstance(b.check, ShareCheck):
                count = F.when(_pct(count, total) > b.check.limit_pct, count).otherwise(0)
            elif isinstance(b.check, Broken):
                count = total
            elif isinstance(b.check, Skipped):
                count = F.lit(0)
            failed.append(count)
        return self._shaped(self._df.agg(*measures).select("total", F.array(*failed).alias("failed")), bound)

    def _repeat_pass(self, bound: list[_Bound]) -> DataFrame:
        counted = repeat_counts(self._df, bound[0].check.keys)
        failed = F.array_repeat("repeats", len(bound)).alias("failed")
        return self._shaped(counted.select(F.col("total_rows").alias("total"), failed), bound)

    def _reference(self, b: _Bound) -> Reference:
        check = b.check
        return Reference(self._df, check.columns, self._df if check.table is None else check.table, check.to, check.types)

    def _reference_pass(self, b: _Bound) -> DataFrame:
        return self._shaped(self._reference(b).counts().select("total", F.array("failed").alias("failed")), [b])

    def _out_of_order(self, b: _Bound) -> DataFrame:
        return broken_order(self._df, b.check, self.key)

    def _out_of_group(self, b: _Bound) -> DataFrame:
        return group_outliers(self._df, b.check.by, b.check.number, b.check.factor)

    def _failing_pass(self, b: _Bound, failing: DataFrame) -> DataFrame:
        """The result of a rule from the rows that fail it."""
        total = self._df.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
        counted = failing.agg(F.count(F.lit(1)).alias("n"))
        return self._shaped(counted.select(total.alias("total"), F.array("n").alias("failed")), [b])

    def _group_tables(self) -> list[tuple[list[_Bound], DataFrame]]:
        """For each set of grouping columns its rules, and one table with a measure for each of them."""
        by_columns: dict[tuple, list[_Bound]] = {}
        for b in self._of(GroupCheck):
            by_columns.setdefault(b.check.by, []).append(b)
        out = []
        for by, bound in by_columns.items():
            levels = list(dict.fromkeys(level for b in bound for level in b.check.levels))
            out.append((bound, grouped(self._df, by, levels, [b.check.measure for b in bound])))
        return out

    def _judged(self, k: int, b: _Bound) -> tuple[Column, Column]:
        """Whether a group is judged by the k-th rule of its table, and whether it fails."""
        judged = F.col("level").isin([",".join(level) for level in b.check.levels])
        return judged, judged & F.coalesce(outside(F.col(f"m{k}"), b.check.low, b.check.high), F.lit(False))

    def _group_pass(self, bound: list[_Bound], table: DataFrame) -> DataFrame:
        both = [self._judged(k, b) for k, b in enumerate(bound)]
        counts = [F.struct(cells.count_where(judged).alias("total"), cells.count_where(fails).alias("failed")) for judged, fails in both]
        return self._results(table.agg(F.array(*counts).alias("counts")), bound)

    def _shaped(self, counted: DataFrame, bound: list[_Bound]) -> DataFrame:
        """Results from one row: the number of rows, and the failures of each rule in an array."""
        count = F.transform("failed", lambda n: F.struct(F.col("total").alias("total"), n.alias("failed")))
        return self._results(counted.select(count.alias("counts")), bound)

    def _results(self, counted: DataFrame, bound: list[_Bound]) -> DataFrame:
        """Results from one row: what was judged and what failed, for each rule, in an array of pairs."""
        # What is known about the rules beforehand is one literal, unfolded next to the counts.
        known = F.from_json(F.lit(json.dumps([b.known(self.run_id) for b in bound])), f"ARRAY<STRUCT<{_KNOWN}>>")
        rows = counted.select(F.inline(F.arrays_zip(known.alias("known"), "counts")))
        total, failed = (F.col(f"counts.{c}").cast("bigint") for c in ("total", "failed"))
        return rows.select("known.*", total.alias("total_rows"), failed.alias("failed_count")).select(
            "run_id", "position", "rule_id", "rule_type", "column_name", "severity", "description", "has_params",
            "status",
            # An error never passes, not even on an empty table.
            ((F.col("status") != "error") & (F.col("failed_count") == 0)).alias("passed"),
            "total_rows",
            (F.col("total_rows") - F.col("failed_count")).alias("passed_count"),
            "failed_count",
            "error",
        )

    @cached_property
    def violations(self) -> DataFrame:
        """Every failing row of every rule: (run_id, position, rule_id, column_name, row_key, value, reason).

        Row rules take one narrow pass. A rule that could not run fails on all rows: each is a violation with the
        message as its reason.
        """
        if not self.key:
            raise ValueError("violations need key columns: validate(df, rules, key=[...])")
        row_key = F.struct(*[F.col(f"`{k}`") for k in self.key]).alias("row_key")

        def entry(b: _Bound) -> Column:
            note = b.check.reason.note if isinstance(b.check, (RowCheck, RepeatCheck, ReferenceCheck)) else None
            return F.struct(
                F.lit(b.position).alias("position"),
                b.check.value.build().alias("value"),
                (F.lit(None).cast("string") if note is None else note()).alias("note"),
            )

        parts = []
        narrow = sorted(self._of(RowCheck, ShareCheck), key=lambda b: b.rule.column)
        for at in range(0, len(narrow), VIOLATION_RULES_PER_PASS):
            found = [
                F.when(b.check.fails & self._over_limit(b), entry(b)) if isinstance(b.check, ShareCheck)
                else F.when(b.check.fails, entry(b))
                for b in narrow[at : at + VIOLATION_RULES_PER_PASS]
            ]
            # The array is built by one projection and thinned out by the next operator. In a single
            # expression the predicates would stand inside a lambda and be interpreted.
            rows = self._df.select(row_key, F.array(*found).alias("found"))
            parts.append(rows.select("row_key", F.inline(F.array_compact("found"))))
        if broken := self._of(Broken):
            nothing = F.lit(None).cast("string")
            entries = [F.struct(F.lit(b.position).alias("position"), nothing.alias("value"), nothing.alias("note")) for b in broken]
            parts.append(self._df.select(row_key, F.inline(F.array(*entries))))
        for b in self._of(RepeatCheck):
            failing = repeats(self._df, b.check.keys, self.key)
            parts.append(failing.select(row_key, entry(b).alias("v")).select("row_key", "v.*"))
        for b in self._of(SequenceCheck):
            parts.append(self._out_of_order(b).select("row_key", F.lit(b.position).alias("position"), "value", "note"))
        for b in self._of(GroupOutlierCheck):
            parts.append(self._out_of_group(b).select(row_key, entry(b).alias("v")).select("row_key", "v.*"))
        for b in self._of(ReferenceCheck):
            parts.append(self._reference(b).orphans().select(row_key, entry(b).alias("v")).select("row_key", "v.*"))
        if not parts:
            nothing = F.struct(F.lit(0).alias("position"), F.lit("").alias("value"), F.lit("").alias("note"))
            parts.append(self._df.limit(0).select(row_key, nothing.alias("v")).select("row_key", "v.*"))
        return self._described(reduce(DataFrame.unionByName, parts))

    def _share(self, b: _Bound) -> Column:
        """The share of the table that matches, in percent: a scalar subquery, evaluated once."""
        measures = F.count(F.lit(1)).alias("total"), cells.count_where(b.check.fails).alias("failed")
        return self._df.agg(*measures).select(_pct(F.col("failed"), F.col("total"))).scalar()

    def _over_limit(self, b: _Bound) -> Column:
        return self._share(b) > b.check.limit_pct

    def _described(self, found: DataFrame) -> DataFrame:
        """Violations in full, from (row_key, position, value, note)."""
        texts = []
        for b in self._bound:
            of_rows = not isinstance(b.check, GroupCheck)
            reason, value = (getattr(b.check, k, d) if of_rows else d for k, d in (("reason", Message()), ("value", NO_VALUE)))
            texts.append(
                {"rule_id": b.rule.id, "column_name": b.rule.column, "before": reason.before, "after": reason.after,
                 "is_float": value.is_float, "broken": b.check.message if isinstance(b.check, Broken) else None}
            )
        schema = (
            "ARRAY<STRUCT<rule_id STRING, column_name STRING, before STRING, after STRING, is_float BOOLEAN, broken STRING>>"
        )
        rule = F.get(F.from_json(F.lit(json.dumps(texts)), schema), F.col("position"))
        label = F.concat_ws("/", *[F.col("row_key")[k].cast("string") for k in self.key])
        if any(t["is_float"] for t in texts):
            shown = F.when(rule["is_float"], cells.text(F.col("value").try_cast("double"), T.DoubleType()))
            found = found.withColumn("value", shown.otherwise(F.col("value")))
        with_value = F.concat(rule["before"], F.coalesce("value", F.lit("null")), rule["after"])
        reason = F.coalesce(rule["broken"], F.concat(F.lit("Row "), label, F.coalesce("note", with_value, rule["before"])))
        for b in self._of(ShareCheck):
            text = F.format_string(
                f"Column '{b.check.column}' has %.1f%% nulls (threshold: {b.check.limit_pct}%%)", self._share(b)
            )
            reason = F.when(F.col("position") == b.position, text).otherwise(reason)
        return found.select(
            F.lit(self.run_id).alias("run_id"), "position", rule["rule_id"].alias("rule_id"),
            rule["column_name"].alias("column_name"), "row_key", "value", reason.alias("reason"),
        )

    @cached_property
    def group_violations(self) -> DataFrame:
        """Every failing group of every rule on groups: (run_id, position, rule_id, column_name, level, group, value, reason).

        `level` names the columns of the group, `group` holds their values in that order (null is a value).
        """
        parts = []
        for bound, table in self._group_tables():
            found = [
                F.when(self._judged(k, b)[1], F.struct(
                    F.lit(b.position).alias("position"), F.lit(b.rule.id).alias("rule_id"), F.lit(b.rule.column).alias("column_name"),
                    F.col(f"m{k}").alias("value"), F.lit(f"{b.check.measure.kind} of '{b.rule.column}' is {b.check.reason}").alias("reason"),
                )) for k, b in enumerate(bound)
            ]
            parts.append(table.select("level", "group", F.array(*found).alias("found")).select("level", "group", F.inline(F.array_compact("found"))))
        names = ["position", "rule_id", "column_name", "level", "group", "value", "reason"]
        if not parts:
            schema = "position INT, rule_id STRING, column_name STRING, level STRING, `group` ARRAY<STRING>, value DOUBLE, reason STRING"
            parts.append(self._df.sparkSession.createDataFrame([], schema))
        return reduce(DataFrame.unionByName, parts).select(F.lit(self.run_id).alias("run_id"), *names)

    def failed(self) -> DataFrame:
        return self.rule_results.filter(~F.col("passed"))


def _pct(part: Column, total: Column) -> Column:
    return F.when(total > 0, part / F.greatest(total, F.lit(1)) * 100).otherwise(F.lit(0.0))


def _attach(df: DataFrame, b: _Bound) -> DataFrame:
    """Add the columns that a check reads; a rule whose expression does not resolve becomes `Broken`."""
    prepare = getattr(b.check, "prepare", None)
    if prepare is None:
        return df
    try:
        return prepare(df)
    except (AnalysisException, ParseException) as e:
        b.check = Broken(f"Validator error: {str(e).splitlines()[0]}")
        return df


def bind_rules(
    df: DataFrame, rules: Iterable[Rule], as_of: dt.date | str | None = None, tables: Mapping[str, DataFrame] | None = None
) -> tuple[list[_Bound], dict[str, Column]]:
    """Bind rules to the schema; also returns the columns that their predicates share.

    Runs a job only when there are `outlier` rules.
    """
    rules, day = list(rules), as_of_date(as_of)
    wanted = {
        r.column: cells.double(F.col(f"`{r.column}`"), df.schema[r.column].dataType)
        for r in rules
        if r.type == "outlier" and r.column in df.columns and not r.params.get("by")
    }
    quartiles = exact_quantiles(df, wanted, OUTLIER_PROBS)
    shared = Shared()
    bound = [_Bound(i, r, bind(Target(r, df.schema, day, quartiles, shared, tables or {}))) for i, r in enumerate(rules)]
    return bound, shared.columns


def validate(
    df: DataFrame,
    rules: Iterable[Rule],
    key: Sequence[str] | None = None,
    as_of: dt.date | str | None = None,
    run_id: str | None = None,
    tables: Mapping[str, DataFrame] | None = None,
) -> ValidationRun:
    """Check `rules` against `df`.

    `key` names the columns that identify a row; it is only needed for `violations`. `as_of` is the day that
    counts as today (default: the current date). `tables` are the tables that `reference` rules name.
    """
    bound, shared = bind_rules(df, rules, as_of, tables)
    df = df.withColumns(shared) if shared else df
    for b in bound:
        df = _attach(df, b)
    return ValidationRun(df, bound, run_id or uuid.uuid4().hex, key)


def local_results(results: DataFrame) -> list[dict]:
    """The results as Python rows, in rule order: one row per rule, so never more than the rule list."""
    return [r.asDict() for r in results.orderBy("position").collect()]
