"""Profiles of tables and columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.cells import clean, count_where, is_date, is_numeric, is_string, missing, text
from plumbline.operators.quantiles import exact_quantiles
from plumbline.operators.repeats import key_columns, repeat_counts
from plumbline.sources.storage import cut_lineage

TOP_VALUES = 5
# Columns whose distinct values are counted in one scan, and rows among which first values are looked for.
COLUMNS_PER_PASS = 40
FIRST_ROWS = 100


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _countable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if not isinstance(f.dataType, T.MapType)]


def null_counts(df: DataFrame, names: Sequence[str]) -> list[Column]:
    return [count_where(missing(_col(n), df.schema[n].dataType)) for n in names]


def round2(c: Column, places: int = 2) -> Column:
    """Rounded half to even on the decimal value, as Python's `round` does."""
    return F.bround(c, places)


def dataset_summary(df: DataFrame) -> DataFrame:
    """One row: size, nulls, repeated rows, and the columns by kind."""
    names = df.columns
    counted = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        reduce(lambda a, b: a + b, null_counts(df, names), F.lit(0).cast("bigint")).alias("null_count"),
    )
    repeated = repeat_counts(df, names).select("repeats").scalar()
    cells = F.col("total_rows") * len(names)

    def of_kind(test) -> Column:
        return F.array(*[F.lit(f.name) for f in df.schema if test(f.dataType)]).cast("array<string>")

    return counted.select(
        "total_rows",
        F.lit(len(names)).alias("total_columns"),
        cells.alias("total_cells"),
        "null_count",
        F.when(cells > 0, round2(F.col("null_count") / F.greatest(cells, F.lit(1)) * 100)).otherwise(0.0)
        .alias("null_percentage"),
        repeated.alias("duplicated_rows"),
        of_kind(is_numeric).alias("numeric_columns"),
        of_kind(is_string).alias("text_columns"),
        of_kind(is_date).alias("date_columns"),
    )


def null_profile(df: DataFrame) -> DataFrame:
    """One row per column: (position, column, dtype, nulls). One aggregate over one scan."""
    row = df.agg(*[c.alias(f"n{i}") for i, c in enumerate(null_counts(df, df.columns))])
    entries = [
        F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("dtype"), F.col(f"n{i}").alias("nulls"),
        )
        for i, f in enumerate(df.schema)
    ]
    return row.select(F.inline(F.array(*entries)))


def value_counts(df: DataFrame, name: str) -> DataFrame:
    """(value, n) for the non-missing values of a column."""
    value = clean(_col(name), df.schema[name].dataType).alias("value")
    return df.select(value).filter(F.col("value").isNotNull()).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, name: str, k: int = TOP_VALUES) -> DataFrame:
    """The most frequent values; equal counts by value."""
    return value_counts(df, name).orderBy(F.desc("n"), "value").limit(k)


def _digest(value: Column, dtype: T.DataType) -> list[Column]:
    """128 bits of hashes in place of a value; null for null. Nested values are hashed as JSON, which shows their nulls."""
    hashed = F.to_json(F.struct(value)) if isinstance(dtype, (T.ArrayType, T.StructType)) else value
    return [F.when(value.isNotNull(), F.xxhash64(hashed)).alias("a"), F.xxhash64(F.lit(1), hashed).alias("b")]


def distinct_counts(df: DataFrame, names: Sequence[str], approximate: bool = False) -> DataFrame:
    """(column, distinct_values), missing values not counted.

    Exact counts take one scan for every COLUMNS_PER_PASS columns: values become (column, 128 bits of hashes), of which
    each task passes on the distinct ones. No value is shuffled itself.
    """
    if approximate:
        row = df.agg(*[
            F.approx_count_distinct(clean(_col(n), df.schema[n].dataType)).alias(f"d{i}")
            for i, n in enumerate(names)
        ])
        entries = [
            F.struct(F.lit(n).alias("column"), F.col(f"d{i}").alias("distinct_values"))
            for i, n in enumerate(names)
        ]
        return row.select(F.inline(F.array(*entries)))

    if not names:
        return df.sparkSession.createDataFrame([], "column STRING, distinct_values BIGINT")
    parts = []
    for at in range(0, len(names), COLUMNS_PER_PASS):
        some = list(names[at : at + COLUMNS_PER_PASS])
        entries = [F.struct(F.lit(i).alias("i"), *_digest(clean(_col(n), df.schema[n].dataType), df.schema[n].dataType)) for i, n in enumerate(some)]
        # One entry for each value, thinned out to one for each distinct value inside every task.
        values = df.select(F.array(*entries).alias("entries")).select(F.inline("entries")).filter("a IS NOT NULL").distinct()
        counted = values.groupBy("i").agg(F.count(F.lit(1)).alias("n"))
        listed = counted.agg(F.map_from_entries(F.collect_list(F.struct("i", "n"))).alias("n"))  # one entry a column
        rows = [F.struct(F.lit(n).alias("column"), F.coalesce(F.try_element_at("n", F.lit(i)), F.lit(0)).alias("distinct_values")) for i, n in enumerate(some)]
        parts.append(listed.select(F.inline(F.array(*rows))))
    return reduce(DataFrame.unionByName, parts)


def numeric_profile(df: DataFrame, name: str) -> DataFrame:
    """One row: type, nulls, distinct values, minimum, maximum, mean, median and sample deviation."""
    dtype = df.schema[name].dataType
    value = clean(_col(name), dtype)
    median = exact_quantiles(df, {name: value}, [0.5])[name][0]
    distinct = value_counts(df, name).agg(F.count(F.lit(1)).alias("d"))
    measured = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(value.isNull()).alias("null_count"),
        F.min(value).cast("double").alias("min"),
        F.max(value).cast("double").alias("max"),
        F.avg(value.cast("double")).alias("mean"),
        F.stddev_samp(value.cast("double")).alias("std"),
    )
    return measured.select(
        F.lit(name).alias("column"), F.lit(dtype.simpleString()).alias("dtype"), "null_count",
        _null_pct().alias("null_percentage"), distinct.scalar().alias("unique_count"), "min", "max",
        round2(F.col("mean")).alias("mean"),
        F.lit(median).cast("double").alias("median"),
        round2(F.col("std")).alias("std"),
    )


def text_profile(df: DataFrame, name: str, k: int = TOP_VALUES) -> DataFrame:
    """One row: type, nulls, distinct values, the longest and shortest length, and the `k` top values.

    One shuffle of the value counts serves the distinct count, the lengths and the top values.
    """
    groups = df.groupBy(_col(name).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    sums = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
        F.count("value").alias("unique_count"),
        F.coalesce(F.max(F.length("value")), F.lit(0)).alias("max_length"),
        F.coalesce(F.min(F.length("value")), F.lit(0)).alias("min_length"),
    )
    top = groups.filter(F.col("value").isNotNull()).orderBy(F.desc("n"), "value").limit(k)
    listed = top.agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col("value").alias("value")))),
            lambda x: F.struct(x["value"].alias("value"), (-x["o"]).alias("n")),
        ).alias("top_values")
    )
    return sums.select(
        F.lit(name).alias("column"), F.lit(df.schema[name].dataType.simpleString()).alias("dtype"), "null_count",
        _null_pct().alias("null_percentage"), "unique_count", "max_length", "min_length",
        listed.scalar().alias("top_values"),
    )


def _null_pct(places: int = 2) -> Column:
    total = F.col("total")
    return F.when(total > 0, round2(F.col("null_count") / F.greatest(total, F.lit(1)) * 100, places)).otherwise(0.0)


def column_profile(df: DataFrame, name: str) -> DataFrame:
    """The profile of one column, numeric or text by its type; other types get the common part."""
    dtype = df.schema[name].dataType
    if is_numeric(dtype):
        return numeric_profile(df, name)
    if is_string(dtype):
        return text_profile(df, name)
    sums = (
        df.groupBy(*key_columns(df, [name]))
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
            F.coalesce(F.sum(F.when(_col(name).isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
            F.count_if(_col(name).isNotNull()).alias("unique_count"),
        )
    )
    return sums.select(
        F.lit(name).alias("column"), F.lit(dtype.simpleString()).alias("dtype"), "null_count",
        _null_pct().alias("null_percentage"), "unique_count",
    )


def _first_values(df: DataFrame, names: Sequence[str], row_key: Sequence[str], samples: int) -> DataFrame:
    """(column, samples): the first non-missing values of every column by row key, as text.

    Most columns have them among the first rows of the table, which are found once as a bounded top-k. Columns that
    don't are thinly filled; their values take one more scan, with all but the first ones dropped inside each task.
    """
    order = F.struct(*[_col(k).alias(f"k{i}") for i, k in enumerate(row_key)]).alias("k")
    head = cut_lineage(df.orderBy(*[_col(k) for k in row_key]).limit(FIRST_ROWS))
    found = {n: F.when(~missing(_col(n), df.schema[n].dataType), F.struct(order, text(_col(n), df.schema[n].dataType).alias("value"))) for n in names}
    known = head.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"n{i}") for i, c in enumerate(found.values())]).first()
    thin = [n for i, n in enumerate(names) if known["rows"] == FIRST_ROWS and known[f"n{i}"] < samples]
    settled = [n for n in names if n not in thin]

    def listed(values: Column) -> Column:
        return F.transform(F.slice(F.array_sort(F.collect_list(values)), 1, samples), lambda x: x["value"])

    parts = [df.sparkSession.createDataFrame([], "column STRING, samples ARRAY<STRING>")]
    if settled:
        row = head.agg(*[listed(found[n]).alias(f"s{i}") for i, n in enumerate(settled)])
        parts.append(row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"s{i}").alias("samples")) for i, n in enumerate(settled)]))))
    if thin:
        entries = [F.when(found[n].isNotNull(), F.struct(F.lit(n).alias("column"), found[n].alias("v"))) for n in thin]
        values = df.select(F.array(*entries).alias("e")).select(F.inline(F.array_compact("e")))
        place = F.row_number().over(Window.partitionBy("column").orderBy("v"))
        few = values.withColumn("place", place).filter(F.col("place") <= samples)
        parts.append(few.groupBy("column").agg(listed(F.col("v")).alias("samples")))
    return reduce(DataFrame.unionByName, parts)


def column_summary(df: DataFrame, row_key: Sequence[str], approximate: bool = False, samples: int = 5) -> DataFrame:
    """One row per column: nulls, distinct values, range and mean, first sample values.

    Samples are the non-missing values with the smallest row keys. Whatever the number of columns up to
    COLUMNS_PER_PASS, this takes three scans, or four if a column has few values. Maps can
    neither be counted nor be compared: their distinct values are null and their samples empty.
    """
    fields = list(df.schema)
    plain = [f for f in fields if not isinstance(f.dataType, T.MapType)]
    measures, entries = [F.count(F.lit(1)).alias("total")], []
    for i, f in enumerate(fields):
        value = clean(_col(f.name), f.dataType)
        measures.append(F.count(value).alias(f"c{i}"))
        low = high = mean = F.lit(None).cast("double")
        if is_numeric(f.dataType):
            measures += [F.min(value).cast("double").alias(f"a{i}"), F.max(value).cast("double").alias(f"b{i}"),
                         F.avg(value).alias(f"m{i}")]
            low, high, mean = F.col(f"a{i}"), F.col(f"b{i}"), F.col(f"m{i}").cast("double")
        entries.append(
            F.struct(
                F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("dtype"),
                (F.col("total") - F.col(f"c{i}")).alias("nulls"),
                round2((F.col("total") - F.col(f"c{i}")) / F.greatest("total", F.lit(1)) * 100, 1).alias("null_pct"),
                low.alias("min"), high.alias("max"), round2(mean).alias("mean"),
            )
        )
    base = df.agg(*measures).select(F.inline(F.array(*entries)))
    firsts = _first_values(df, [f.name for f in plain], row_key, samples)
    distinct = distinct_counts(df, [f.name for f in plain], approximate)
    # Both sides have one row per column of the table.
    return base.join(F.broadcast(distinct), "column", "left").join(F.broadcast(firsts), "column", "left").select(
        "position", "column", "dtype", "nulls", "null_pct", "distinct_values", "min", "max", "mean",
        F.coalesce("samples", F.array().cast("array<string>")).alias("samples"),
    )
