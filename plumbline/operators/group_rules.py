"""Rules on groups and totals: bounds on a count, sum, mean, minimum or maximum per group, at every roll-up level.

Rules with the same grouping columns share one scan: rows are reduced to one row per finest group (`groupBy`, which
adds up inside each task first, so a group with a third of the rows costs no skew), and GROUPING SETS over that small
table gives all coarser levels. The measures kept are sums, counts, minima and maxima, from which every level follows.

A null is a group value of its own, told apart from "all values" by the grouping id. Missing values (null, NaN, text
that is no number) are not measured; a group without any has no sum, mean, minimum or maximum and passes. An empty
table has no groups, not even a grand total. What is judged here is the group: `total_rows` and `failed_count` of such
a rule count groups.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEASURES = ("count", "sum", "mean", "min", "max")

Level = tuple[str, ...]


def levels_of(by: Level, kind: str | list) -> list[Level]:
    """The grouping sets: `group` (the finest), `total`, `rollup`, `cube`, or a list of lists of columns."""
    if kind == "group":
        return [by]
    if kind == "total":
        return [()]
    if kind == "rollup":
        return [by[:k] for k in range(len(by), -1, -1)]
    if kind == "cube":
        return [c for k in range(len(by), -1, -1) for c in combinations(by, k)]
    if isinstance(kind, str):
        raise ValueError(f"unknown levels: {kind}")
    sets = [tuple(c for c in by if c in level) for level in kind]
    for level in kind:
        if unknown := [c for c in level if c not in by]:
            raise ValueError(f"level column '{unknown[0]}' is not a grouping column")
    return list(dict.fromkeys(sets))


@dataclass(frozen=True)
class Measure:
    """A measure of a column; `value` is the number of a row (or, for counts, whether it counts)."""

    kind: str
    column: str
    value: Column

    def parts(self, name: str) -> list[Column]:
        """What the finest groups keep."""
        if self.kind == "count":
            return [F.count(F.when(self.value, 1)).alias(name)]
        if self.kind == "mean":
            return [F.sum(self.value).alias(name), F.count(self.value).alias(f"{name}_n")]
        return [getattr(F, self.kind)(self.value).alias(name)]

    def total(self, name: str) -> Column:
        """The measure of a level, from what its finest groups kept."""
        if self.kind in ("min", "max"):
            out = getattr(F, self.kind)(name)
        elif self.kind == "mean":
            n = F.sum(f"{name}_n")
            out = F.when(n > 0, F.sum(name).cast("double") / n)
        else:
            out = F.sum(name)
        return out.cast("double").alias(name)


def summable(value: Column, dtype: T.DataType) -> Column:
    """Whole numbers are added as decimals, which do not overflow."""
    return value.cast(T.DecimalType(38, 0)) if isinstance(dtype, T.IntegralType) else value


def grouped(df: DataFrame, by: Level, levels: list[Level], measures: list[Measure]) -> DataFrame:
    """(level, group, m0, m1, ...): one row per group of every level; `level` names its columns, `group` holds their values."""
    keys = [f"__by_{k}" for k in range(len(by))]
    named = dict(zip(by, keys))
    parts = [p for k, m in enumerate(measures) for p in m.parts(f"m{k}")]
    totals = [m.total(f"m{k}") for k, m in enumerate(measures)]
    names = [f"m{k}" for k in range(len(measures))]
    if not by:  # grouped by a constant, because without keys an empty table would have a group
        everything = df.groupBy(F.lit(0).alias("__all")).agg(*parts).groupBy("__all").agg(*totals)
        return everything.select(F.lit("").alias("level"), F.array().cast("array<string>").alias("group"), *names)
    finest = df.groupBy(*[F.col(f"`{c}`").alias(k) for c, k in named.items()]).agg(*parts)
    sets = [[named[c] for c in level] for level in levels]
    rolled = finest.groupingSets(sets, *keys).agg(F.grouping_id().alias("__level"), *totals)
    name, values = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    for level in levels:
        number = sum(1 << (len(by) - 1 - k) for k, c in enumerate(by) if c not in level)
        here = F.col("__level") == number
        shown = F.array(*[F.col(named[c]).cast("string") for c in level]).cast("array<string>")
        name, values = F.when(here, F.lit(",".join(level))).otherwise(name), F.when(here, shown).otherwise(values)
    return rolled.select(name.alias("level"), values.alias("group"), *names)
