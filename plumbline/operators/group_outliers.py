"""Outliers within groups: rows outside the interquartile bounds of their own group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.ordered import group_key, grouped_quantiles
from plumbline.operators.repeats import attach_groups
from plumbline.sources.storage import cut_lineage

BROADCAST_BYTES = 8 << 20


def group_bounds(df: DataFrame, by: Sequence[str], number: Column, factor: float) -> DataFrame:
    """(group, n, low, high): the bounds of every group that has a number; found for all groups at once."""
    first, third = F.col("quantiles")[0], F.col("quantiles")[1]
    reach = (third - first) * F.lit(factor)
    return grouped_quantiles(df, by, number, (0.25, 0.75)).filter("n > 0").select("group", "n", (first - reach).alias("low"), (third + reach).alias("high"))


def group_outliers(df: DataFrame, by: Sequence[str], number: Column, factor: float) -> DataFrame:
    """The rows outside the bounds of their group, whole.

    The table of bounds is written down and measured: small ones are broadcast, others joined, hot groups first.
    """
    bounds = cut_lineage(group_bounds(df, by, number, factor))
    size = bounds.agg(F.sum(F.octet_length(F.to_json(F.struct("group"))) + 32)).first()[0] or 0
    low, high, n = (f"__{c}_{id(bounds)}" for c in ("low", "high", "n"))
    bounds = bounds.select("group", F.col("n").alias(n), F.col("low").alias(low), F.col("high").alias(high))
    key = group_key(df, by)
    if size <= BROADCAST_BYTES:
        held = f"__group_{id(bounds)}"
        joined = df.join(F.broadcast(bounds.withColumnRenamed("group", held)), key.eqNullSafe(F.col(held)))
    else:
        joined = attach_groups(df, bounds, {"group": key}, n)
    return joined.filter((number < F.col(low)) | (number > F.col(high))).select(*[F.col(f"`{c}`") for c in df.columns])
