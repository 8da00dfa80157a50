"""Rules across datasets: every complete key of a table must exist in another one.

A key is complete if none of its columns is null (NaN counts as null); rows with incomplete keys pass. Keys of the
table are counted first (`groupBy` adds up inside each task), so the join that looks them up meets every distinct key
once, however often it stands in the table: a key with a third of the rows is one row there. Keys that are not found
come out of that join as one row each. To list the rows that have them, that table of missing keys is written down and
counted: up to BROADCAST_BYTES of it are broadcast, so rows are not shuffled at all; beyond, hot keys are settled
first and the others join on a salted key (`attach_groups`).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.cells import clean, is_date, is_numeric, is_string
from plumbline.operators.repeats import WIDE_KEY, attach_groups
from plumbline.sources.storage import cut_lineage

BROADCAST_BYTES = 8 << 20


def common_type(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The type in which values of two columns are compared without loss; None where they cannot be equal."""
    if is_string(a) and is_string(b):
        return T.StringType()
    if is_numeric(a) and is_numeric(b):
        if isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType):
            return T.LongType()
        if isinstance(a, T.DecimalType) or isinstance(b, T.DecimalType):
            scales = [t.scale for t in (a, b) if isinstance(t, T.DecimalType)]
            if all(isinstance(t, (T.DecimalType, T.IntegralType)) for t in (a, b)):
                return T.DecimalType(38, max(scales))
        return T.DoubleType()
    if is_date(a) and is_date(b):
        return a if a == b else T.TimestampType()
    return a if a == b and isinstance(a, (T.BooleanType, T.BinaryType)) else None


@dataclass(frozen=True)
class Reference:
    """The key `columns` of `rows`, to be found in the columns `to` of `table`, compared as `types`."""

    rows: DataFrame
    columns: tuple[str, ...]
    table: DataFrame
    to: tuple[str, ...]
    types: tuple[T.DataType, ...]
    tag: str = field(default_factory=lambda: uuid.uuid4().hex)  # keeps the names added here apart from those of the tables

    def _parts(self, df: DataFrame, names: Sequence[str]) -> tuple[dict[str, Column], Column]:
        """What equal keys have in common (the key, or 128 bits of hashes if it is wide), and whether a key is complete."""
        parts = [clean(F.col(f"`{n}`"), df.schema[n].dataType).cast(t) for n, t in zip(names, self.types)]
        complete = reduce(lambda a, b: a & b, [p.isNotNull() for p in parts])
        wide = any(is_string(t) or isinstance(t, T.BinaryType) for t in self.types) or 16 * len(parts) > WIDE_KEY
        if wide:
            parts = [F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)]
        return {f"__ref_{k}_{self.tag}": p for k, p in enumerate(parts)}, complete

    @cached_property
    def keys(self) -> dict[str, Column]:
        return self._parts(self.rows, self.columns)[0]

    @cached_property
    def complete(self) -> Column:
        return self._parts(self.rows, self.columns)[1]

    @cached_property
    def _known(self) -> DataFrame:
        parts, complete = self._parts(self.table, self.to)
        return self.table.filter(complete).select(*[c.alias(k) for k, c in parts.items()]).distinct()

    @cached_property
    def _sizes(self) -> DataFrame:
        grouped = self.rows.groupBy(*[c.alias(k) for k, c in self.keys.items()], self.complete.alias("__complete"))
        return grouped.agg(F.count(F.lit(1)).alias("__n"))

    def counts(self) -> DataFrame:
        """One row: (total, failed)."""
        looked_up = self._sizes.join(self._known.withColumn("__found", F.lit(True)), list(self.keys), "left")
        orphan = F.col("__complete") & F.col("__found").isNull()
        return looked_up.agg(
            F.coalesce(F.sum("__n"), F.lit(0)).alias("total"),
            F.coalesce(F.sum(F.when(orphan, F.col("__n"))), F.lit(0)).alias("failed"),
        )

    def missing(self) -> DataFrame:
        """One row for each distinct complete key that is not found, with its number of rows in `__n`."""
        return self._sizes.filter("__complete").drop("__complete").join(self._known, list(self.keys), "left_anti")

    def orphans(self) -> DataFrame:
        """The rows whose key is not found, whole. Runs a job that finds and measures the missing keys."""
        missing = cut_lineage(self.missing())
        rows = self.rows.filter(self.complete)
        if missing.count() * 16 * (len(self.keys) + 1) <= BROADCAST_BYTES:
            same = reduce(lambda a, b: a & b, [c == F.col(k) for k, c in self.keys.items()])
            return rows.join(F.broadcast(missing.drop("__n")), same, "left_semi")
        size = f"__n_{self.tag}"
        joined = attach_groups(rows, missing.withColumnRenamed("__n", size), self.keys, size)
        return joined.filter(F.col(size).isNotNull()).drop(size)
