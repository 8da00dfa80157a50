"""Rows in order inside groups, without a task for a whole group.

Rows are dealt to range partitions of (group, order, row key) and written down with the number of their partition. A
group that is larger than a partition spans several, so nothing grows with the largest group. What a row needs from
the rows before it comes from its own part (partition and group) by a window, and from earlier parts by a carry: one
row for each partition, read off its last group, which is a table of as many rows as there are partitions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.cells import clean
from plumbline.sources.storage import cut_lineage


def group_key(df: DataFrame, by: Sequence[str]) -> Column:
    """The grouping columns as one value; nulls equal each other, NaN counts as null."""
    if not by:
        return F.lit(0)
    return F.struct(*[clean(F.col(f"`{c}`"), df.schema[c].dataType).alias(f"g{k}") for k, c in enumerate(by)])


def sortable(c: Column, dtype: T.DataType) -> Column:
    """A value to sort by and to take differences of: timestamps in microseconds, dates in days, numbers as they are."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp"))
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("bigint")
    return clean(c, dtype)


class Ordered:
    """Rows (`g` group, `o` order, `r` row key, more columns), dealt to parts of ranges."""

    def __init__(self, rows: DataFrame, group: Column, order: Column, row_key: Column, columns: Mapping[str, Column]):
        named = rows.select(group.alias("g"), order.alias("o"), row_key.alias("r"), *[c.alias(n) for n, c in columns.items()])
        self._rows = named.filter(F.col("o").isNotNull())
        self.columns = list(columns)

    @cached_property
    def placed(self) -> DataFrame:
        """The rows with their partition in `part`."""
        return cut_lineage(self._rows.repartitionByRange("g", "o", "r").withColumn("part", F.spark_partition_id()))

    @cached_property
    def _last(self) -> DataFrame:
        """(part, last): the last row of every partition."""
        row = F.struct("g", "o", "r", *self.columns)
        return cut_lineage(self.placed.groupBy("part").agg(F.max(row).alias("last")))

    def carried(self, summed: Column | None = None) -> DataFrame:
        """(to_part, last, carry): for each partition the last row before it, and a maximum over its group's rows before it."""
        last = self._last
        in_order = Window.orderBy("part")  # as many rows as partitions
        if summed is None:
            carry = F.lit(None)
        else:
            ends = last.select(F.col("part").alias("p"), F.col("last.g").alias("lg"))
            mine = self.placed.join(F.broadcast(ends), (F.col("part") == F.col("p")) & F.col("g").eqNullSafe(F.col("lg")))
            last = last.join(F.broadcast(mine.groupBy("p").agg(F.max(summed).alias("most"))), F.col("part") == F.col("p"), "left")
            carry = F.max("most").over(Window.partitionBy("last.g").orderBy("part"))
        held = last.select("part", "last", carry.alias("most"))
        return held.select(
            "part", F.lag("last").over(in_order).alias("last"), F.lag("most").over(in_order).alias("carry")
        ).select(F.col("part").alias("to_part"), "last", "carry")

    def with_previous(self, summed: Column | None = None) -> DataFrame:
        """The rows, with `before`: the row before it in its group (null for the first); and `most`: the maximum of
        `summed` over all rows before it in its group."""
        row = F.struct("o", "r", *self.columns)
        parts = Window.partitionBy("part", "g").orderBy("o", "r")
        rows = self.placed.withColumn("before", F.lag(row).over(parts))
        if summed is not None:
            rows = rows.withColumn("most", F.max(summed).over(parts.rowsBetween(Window.unboundedPreceding, -1)))
        rows = rows.join(F.broadcast(self.carried(summed)), F.col("part") == F.col("to_part"), "left")
        same = F.col("last.g").eqNullSafe(F.col("g")) & F.col("last").isNotNull()
        before = F.coalesce("before", F.when(same, F.struct(*[F.col("last").getField(c).alias(c) for c in ("o", "r", *self.columns)])))
        names = ["g", "o", "r", *self.columns]
        if summed is None:
            return rows.select(*names, before.alias("before"))
        return rows.select(*names, before.alias("before"), F.greatest("most", F.when(same, F.col("carry"))).alias("most"))


def grouped_quantiles(df: DataFrame, by: Sequence[str], value: Column, probs: Sequence[float]) -> DataFrame:
    """(group, n, quantiles): exact quantiles of a number in every group at once, interpolated between neighbours.

    Equal values of a group are counted first. The counts are put in order over range partitions; running sums inside
    a part, and the sums of a group's earlier parts (one row for each part and group), give every value its ranks, and
    the values at the ranks that are asked for are picked out. A group with a third of all rows is spread over a third
    of the partitions. Nulls are left out; a group without a number has `n` = 0 and null quantiles.
    """
    number = F.when(F.isnan(value.cast("double")), None).otherwise(value.cast("double"))
    counted = df.select(group_key(df, by).alias("g"), number.alias("v")).groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    placed = cut_lineage(counted.repartitionByRange("g", "v").withColumn("part", F.spark_partition_id()))
    some = placed.filter("v IS NOT NULL")
    parts = some.groupBy("g", "part").agg(F.sum("n").alias("in_part"))
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.sum("in_part").over(Window.partitionBy("g"))
    # One row for each part that a group touches: at most groups + partitions rows, joined on both.
    offsets = parts.select(F.col("g").alias("pg"), F.col("part").alias("pp"), F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("offset"), whole.alias("total"))
    upto = F.sum("n").over(Window.partitionBy("part", "g").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = some.withColumn("upto", upto).join(offsets, (F.col("part") == F.col("pp")) & F.col("g").eqNullSafe(F.col("pg")))
    first, end = F.col("offset") + F.col("upto") - F.col("n"), F.col("offset") + F.col("upto")

    def at(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank < end), F.col("v")))

    picks = []
    for k, p in enumerate(probs):
        place = F.lit(float(p)) * (F.col("total") - 1)
        picks += [at(F.floor(place)).alias(f"lo{k}"), at(F.ceil(place)).alias(f"hi{k}")]
    picked = ranked.groupBy("g").agg(F.max("total").alias("n"), *picks)
    values = []
    for k, p in enumerate(probs):
        place = F.lit(float(p)) * (F.col("n") - 1)
        values.append(F.col(f"lo{k}") + (F.col(f"hi{k}") - F.col(f"lo{k}")) * (place - F.floor(place)))
    found = picked.select("g", "n", F.array(*values).alias("quantiles"))
    groups = placed.select(F.col("g").alias("all_g")).distinct()
    return groups.join(found, F.col("all_g").eqNullSafe(F.col("g")), "left").select(F.col("all_g").alias("group"), F.coalesce("n", F.lit(0)).alias("n"), "quantiles")
