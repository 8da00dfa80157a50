"""Exact quantiles by narrowing an interval, so that no task ever holds a column.

Spark's exact `percentile` keeps every distinct value of a column in one buffer. That is fine for a column
with a bounded number of distinct values and used there, after the values were counted by a distributed
`groupBy` so that each one reaches the last task once. Other columns are narrowed: each pass counts the rows around an
interval exactly and sketches the rows inside it, and the sketch says where to look next. The interval
loses a factor of some hundred per pass, so a trillion rows take four or five passes over one column, and
only what is left inside (at most `SMALL` rows) is sorted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.cells import count_where

# A column with at most this many distinct values (estimated) goes to the built-in aggregate.
FEW_DISTINCT = 1_000_000
# An interval with at most this many rows is sorted in one task.
SMALL = 100_000
# Points of the sketch that are read per pass, and the sketch's accuracy.
GRID = 500
ACCURACY = 5_000


@dataclass
class _Search:
    """The rows of one column at the positions `ranks` (0-based, ascending, non-missing)."""

    value: Column
    ranks: list[int]
    total: int
    low: float | None = None  # answers lie in [low, high]; None means unbounded
    high: float | None = None
    margin: int = 2
    found: dict[int, float] = field(default_factory=dict)

    def inside(self) -> Column:
        test = self.value.isNotNull()
        if self.low is not None:
            test = test & (self.value > F.lit(self.low))
        if self.high is not None:
            test = test & (self.value < F.lit(self.high))
        return test

    def measures(self) -> list[Column]:
        none = F.lit(False)
        low = F.lit(self.low) if self.low is not None else None
        high = F.lit(self.high) if self.high is not None else None
        inner = F.when(self.inside(), self.value)
        grid = [i / GRID for i in range(GRID + 1)]
        return [
            count_where(self.value < low if low is not None else none),
            count_where(self.value == low if low is not None else none),
            F.count(inner),
            count_where(self.value == high if high is not None else none),
            F.percentile_approx(inner, grid, ACCURACY),
        ]

    def narrow(self, below: int, at_low: int, inner: int, at_high: int, grid: list[float] | None) -> int | None:
        """Use the counts of a pass; returns the offset of the interior if it still has to be searched."""
        start = below + at_low
        open_ranks = []
        for r in self.ranks:
            if r in self.found:
                continue
            if self.low is not None and below <= r < start:
                self.found[r] = self.low
            elif self.high is not None and start + inner <= r < start + inner + at_high:
                self.found[r] = self.high
            elif start <= r < start + inner:
                open_ranks.append(r)
            else:  # the sketch missed: look again from the outside, with a wider margin
                self.low = self.high = None
                self.margin = min(self.margin * 4, GRID // 4)
                return None
        if not open_ranks or inner <= SMALL:
            return start if open_ranks else None
        first = (open_ranks[0] - start) / inner * GRID
        last = (open_ranks[-1] - start + 1) / inner * GRID
        i, j = math.floor(first) - self.margin, math.ceil(last) + self.margin
        if i >= 0:
            self.low = grid[i]
        if j <= GRID:
            self.high = grid[j]
        return None


def _ranks(total: int, probs: Sequence[float]) -> list[int]:
    wanted = set()
    for p in probs:
        position = p * (total - 1)
        wanted |= {math.floor(position), math.ceil(position)}
    return sorted(wanted)


def _interpolate(found: dict[int, float], total: int, p: float) -> float:
    position = p * (total - 1)
    lower, upper = found[math.floor(position)], found[math.ceil(position)]
    if lower == upper:
        return lower
    return lower + (upper - lower) * (position - math.floor(position))


def _select(df: DataFrame, searches: list[_Search]) -> None:
    """Fill `found` of every search. Each round is one aggregate with one bounded row."""
    while pending := [s for s in searches if len(s.found) < len(s.ranks)]:
        measures = [m.alias(f"m{i}_{j}") for i, s in enumerate(pending) for j, m in enumerate(s.measures())]
        row = df.agg(*measures).first()
        finish = []
        for i, s in enumerate(pending):
            bounds = (s.low, s.high)
            start = s.narrow(*[row[f"m{i}_{j}"] for j in range(5)])
            if start is not None:
                finish.append((s, start, bounds))
        if finish:
            lists = [
                F.sort_array(F.collect_list(F.when(s.inside(), s.value))) for s, _, _ in finish
            ]  # at most SMALL values each, by the exact count above
            wanted = [[r for r in s.ranks if r not in s.found] for s, _, _ in finish]
            row = df.agg(*[values.alias(f"l{i}") for i, values in enumerate(lists)]).select(
                *[F.get(F.col(f"l{i}"), r - start).alias(f"v{i}_{r}")
                  for i, (_, start, _) in enumerate(finish) for r in wanted[i]]
            ).first()
            for i, (s, _, _) in enumerate(finish):
                for r in wanted[i]:
                    s.found[r] = row[f"v{i}_{r}"]


def exact_quantiles(
    df: DataFrame, columns: dict[str, Column], probs: Sequence[float]
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles per named DOUBLE column; None where a column has no value."""
    if not columns:
        return {}
    names = list(columns)
    values = df.select(*[columns[n].cast("double").alias(f"q{i}") for i, n in enumerate(names)])
    cells = [F.col(f"q{i}") for i in range(len(names))]
    row = values.agg(
        *[F.count(c).alias(f"n{i}") for i, c in enumerate(cells)],
        *[F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(cells)],
    ).first()
    result: dict[str, list[float | None]] = {n: [None] * len(probs) for n in names}
    direct = [i for i in range(len(names)) if row[f"n{i}"] and row[f"d{i}"] <= FEW_DISTINCT]
    if direct:
        counted = [
            values.select(F.col(f"q{i}").alias("v"))
            .filter(F.col("v").isNotNull())
            .groupBy("v")
            .agg(F.count(F.lit(1)).alias("n"))
            .agg(F.percentile("v", list(probs), F.col("n")).alias("p"))
            .select(F.lit(i).alias("i"), "p")
            for i in direct
        ]
        for found in reduce(DataFrame.unionByName, counted).collect():  # one row per column
            result[names[found["i"]]] = list(found["p"])
    searches = {}
    for i in range(len(names)):
        if row[f"n{i}"] and i not in direct:
            total = row[f"n{i}"]
            for p in probs:
                searches[i, p] = _Search(cells[i], _ranks(total, [p]), total)
    _select(values, list(searches.values()))
    for (i, p), s in searches.items():
        result[names[i]][list(probs).index(p)] = _interpolate(s.found, s.total, p)
    return result
