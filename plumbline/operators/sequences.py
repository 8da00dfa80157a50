"""Rules on the order of rows in their groups: values that fall, steps that are too long or short, intervals that overlap.

Rows meet the row before them in a table of ordered parts (`Ordered`), so a group with a third of the rows is no single
task; only the columns of the rule and the row key travel. Rows without an order value, and values that are null, take no part and pass; among equal order
values the row key decides. An interval may begin where an earlier one ends; one whose end is missing ends nowhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.cells import is_date
from plumbline.operators.ordered import Ordered, group_key, sortable
from plumbline.plans.checks import SequenceCheck

MICROSECONDS = 1_000_000


def broken_order(df: DataFrame, check: SequenceCheck, row_key: Sequence[str] | None) -> DataFrame:
    """(row_key, value, note): the rows that fail, with the value and what it follows as text."""
    kinds = {c: df.schema[c].dataType for c in (check.order, check.column, check.end) if c}

    def column(name: str) -> Column:
        return sortable(F.col(f"`{name}`"), kinds[name])

    columns = {"v": column(check.column)}
    if check.end:
        columns["e"] = column(check.end)
    # Without a row key, equal order values are taken in the order of the value.
    key = F.struct(*[F.col(f"`{k}`").alias(k) for k in row_key] if row_key else columns["v"])
    rows = df.filter(column(check.column).isNotNull())
    ordered = Ordered(rows, group_key(df, check.by), column(check.order), key, columns)
    if check.kind == "overlap":
        found = ordered.with_previous(F.col("e"))
        fails, before = F.col("v") < F.col("most"), F.col("most")
        text = "begins before"
    else:
        found = ordered.with_previous()
        before = F.col("before.v")
        if check.kind == "increasing":
            fails = (F.col("v") <= before) if check.strict else (F.col("v") < before)
            text = "does not grow from" if check.strict else "falls from"
        else:
            unit = MICROSECONDS if kinds[check.order].typeName().startswith("timestamp") else 1
            step = (F.col("o") - F.col("before.o")) / F.lit(unit)
            tests = [step < F.lit(check.least)] * (check.least is not None) + [step > F.lit(check.most)] * (check.most is not None)
            fails, text = tests[0] if len(tests) == 1 else tests[0] | tests[1], "comes too soon or too late after"
    dtype = kinds[check.column]
    shown, earlier = (_text(c, dtype) for c in (F.col("v"), before))
    note = F.concat(F.lit(f": '{check.column}' value '"), shown, F.lit(f"' {text} '"), earlier, F.lit("'"))
    return found.filter(F.coalesce(fails, F.lit(False))).select(F.col("r").alias("row_key"), shown.alias("value"), note.alias("note"))


def _text(c: Column, dtype) -> Column:
    """The value as the column writes it."""
    if not is_date(dtype):
        return c.cast("string")
    return (F.timestamp_micros(c).cast(dtype) if dtype.typeName().startswith("timestamp") else F.date_from_unix_date(c.cast("int"))).cast("string")
