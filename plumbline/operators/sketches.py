"""Mergeable profiles: sketches of every column, kept for each run and merged over runs and days without the data.

A profile row holds exact counts, sums and bounds, a HyperLogLog sketch for distinct values, a KLL sketch for quantiles
of numbers, and a frequent-items sketch for top values. All are aggregates, so one scan makes the rows of all columns,
each task sends one small row, and merging is the same aggregate over stored rows: merging the parts gives what one
sketch of the union would give, within the same bounds.

Bounds: distinct values within about 1.04 / sqrt(2^DISTINCT_BITS) (1.6 % at 12 bits) as one standard error; the rank of a
quantile within about 1.65 % with QUANTILE_K = 200 (99 % confidence); a top value's count is too small by at most the
rows divided by the items tracked. Missing values (null, NaN) are counted and not sketched. An empty table has a row
for each column, with nothing in it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.cells import clean, is_numeric, missing, text

DISTINCT_BITS = 12
QUANTILE_K = 200
TRACKED = 1024
TOP_SKETCH = "STRUCT<sketch: BINARY, maxItemsTracked: INT, itemDataType: STRING, itemDataTypeDDL: STRING>"
SKETCH_SCHEMA = (
    "`column` STRING, dtype STRING, rows BIGINT, nulls BIGINT, low DOUBLE, high DOUBLE, total DOUBLE, "
    f"distinct_sketch BINARY, quantile_sketch BINARY, top_sketch {TOP_SKETCH}"
)


def column_sketches(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """One row per column in SKETCH_SCHEMA, from one aggregate over one scan; map columns are left out."""
    fields = [f for f in df.schema if (names is None or f.name in names) and not isinstance(f.dataType, T.MapType)]
    prepared, measures, entries = [], [F.count(F.lit(1)).alias("rows")], []
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        prepared.append(F.when(~missing(c, f.dataType), text(c, f.dataType)).alias(f"t{i}"))
        measures += [
            F.count(f"t{i}").alias(f"n{i}"), F.hll_sketch_agg(f"t{i}", DISTINCT_BITS).alias(f"d{i}"),
            F.expr(f"approx_top_k_accumulate(t{i}, {TRACKED})").alias(f"k{i}"),
        ]
        low = high = total = F.lit(None).cast("double")
        quantiles = F.lit(None).cast("binary")
        if is_numeric(f.dataType):
            prepared.append(clean(c, f.dataType).cast("double").alias(f"v{i}"))
            measures += [F.min(f"v{i}").alias(f"a{i}"), F.max(f"v{i}").alias(f"b{i}"), F.sum(f"v{i}").alias(f"s{i}"), F.kll_sketch_agg_double(f"v{i}", QUANTILE_K).alias(f"q{i}")]
            low, high, total, quantiles = (F.col(f"{m}{i}") for m in "absq")
        entries.append(F.struct(
            F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"), F.col("rows"), (F.col("rows") - F.col(f"n{i}")).alias("nulls"),
            low.alias("low"), high.alias("high"), total.alias("total"), F.col(f"d{i}").alias("distinct_sketch"), quantiles.alias("quantile_sketch"),
            F.col(f"k{i}").cast(TOP_SKETCH).alias("top_sketch"),
        ))
    return df.select(*prepared).agg(*measures).select(F.inline(F.array(*entries)))


def merged_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The sketches of each column (within `by`: a dataset, a day) put together into one row."""
    return sketches.groupBy(*by, "column", "dtype").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"),
        F.expr(f"approx_top_k_combine(top_sketch, {TRACKED})").cast(TOP_SKETCH).alias("top_sketch"),
    )


def sketched_profile(sketches: DataFrame, probs: Sequence[float] = (0.25, 0.5, 0.75), k: int = 5) -> DataFrame:
    """What the sketches say: rows, nulls, bounds, mean, distinct values, quantiles and top values, one row for each row."""
    kept = [c for c in sketches.columns if c not in ("distinct_sketch", "quantile_sketch", "top_sketch", "total")]
    known = F.col("rows") - F.col("nulls")
    some = F.col("high").isNotNull()  # a number was sketched
    quantiles = F.array(*[F.when(some, F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(float(p)))) for p in probs])
    return sketches.select(
        *[F.col(f"`{c}`") for c in kept], (F.col("total") / F.when(known > 0, known)).alias("mean"), F.hll_sketch_estimate("distinct_sketch").alias("distinct_values"),
        F.when(some, quantiles).alias("quantiles"), _top("top_sketch", k).alias("top_values"),
    )


def _top(sketch: str, k: int) -> Column:
    return F.transform(F.expr(f"approx_top_k_estimate({sketch}, {k})"), lambda x: F.struct(x["item"].alias("value"), x["count"].alias("n")))
