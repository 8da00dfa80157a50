"""What a rule becomes once it is bound to a schema."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.group_rules import Measure

# Columns that `with_row_key` adds. They identify a row but are not part of its data.
GENERATED_KEY = ("row_file", "row_index")


def data_columns(names: list[str]) -> list[str]:
    return [n for n in names if n not in GENERATED_KEY]


@dataclass(frozen=True)
class Value:
    """The failing value as text; made only for violations.

    Floats come as Spark writes them and are put into their final form together at the end.
    """

    build: Callable[[], Column]
    is_float: bool = False


NO_VALUE = Value(lambda: F.lit(None).cast("string"))


@dataclass(frozen=True)
class Message:
    """Why a row fails: `Row <row><before>[<value><after>]`, or `Row <row><note>` with a note made per row.

    Texts that are the same for all rows are kept out of the generated code and put together at the end.
    """

    before: str = ""
    after: str | None = None
    note: Callable[[], Column] | None = None


@dataclass(frozen=True)
class RowCheck:
    """Decided by one row alone: no shuffle, all such rules share one pass."""

    fails: Column
    value: Value
    reason: Message
    # Adds the columns that the predicate reads (a lookup, an expression); usually nothing to add.
    prepare: Callable[[DataFrame], DataFrame] | None = None
    warning: str | None = None


@dataclass(frozen=True)
class ShareCheck:
    """The rows that match fail, but only where their share of the table is above the limit."""

    fails: Column
    value: Value
    limit_pct: float
    column: str


@dataclass(frozen=True)
class RepeatCheck:
    """Second and later rows with the same key fail; nulls equal each other."""

    keys: tuple[str, ...]
    value: Value
    reason: Message


@dataclass(frozen=True)
class ReferenceCheck:
    """Rows whose complete key stands in no row of another table fail."""

    columns: tuple[str, ...]
    table: DataFrame | None  # None: the table that is checked
    to: tuple[str, ...]
    types: tuple
    value: Value
    reason: Message


@dataclass(frozen=True)
class GroupCheck:
    """Groups whose measure is out of bounds fail; what is judged is the group, not the row."""

    by: tuple[str, ...]
    levels: tuple[tuple[str, ...], ...]
    measure: Measure
    low: float | None
    high: float | None
    reason: str


@dataclass(frozen=True)
class SequenceCheck:
    """Rows that break the order of their group fail: `kind` is increasing, gap or overlap."""

    by: tuple[str, ...]
    order: str
    kind: str
    column: str
    end: str | None
    strict: bool
    least: float | None
    most: float | None


@dataclass(frozen=True)
class GroupOutlierCheck:
    """Rows outside the interquartile bounds of their own group fail."""

    by: tuple[str, ...]
    number: Column
    factor: float
    value: Value
    reason: Message


@dataclass(frozen=True)
class Broken:
    """The rule cannot be run: every row counts as failed and the message is kept."""

    message: str


@dataclass(frozen=True)
class Skipped:
    """The rule has nothing to compare: it passes."""

    message: str


Check = RowCheck | ShareCheck | RepeatCheck | ReferenceCheck | GroupCheck | SequenceCheck | GroupOutlierCheck | Broken | Skipped
