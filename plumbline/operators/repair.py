"""Repairs: each takes a DataFrame and returns the repaired DataFrame.

Single values that a repair needs (a median, a mode, a percentile) are found by jobs that spread over the
cluster and come back as one literal. Repairs about copies take the row key, so that "first" is well defined.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import cells, dates
from plumbline.functions.patterns import match_start
from plumbline.operators import repeats
from plumbline.operators.profile import value_counts
from plumbline.operators.quantiles import exact_quantiles
from plumbline.plans.checks import data_columns
from plumbline.operators.validators import EMAIL_PATTERN, PLACEHOLDERS, as_of_date, outlier_bounds
from plumbline.sources.storage import cut_lineage

UNKNOWN = "Unknown"
REPEAT_SUFFIX = "_dup"


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _dtype(df: DataFrame, name: str):
    return df.schema[name].dataType


def _present(df: DataFrame, name: str) -> Column:
    return cells.present(_col(name), _dtype(df, name))


def _number(df: DataFrame, name: str) -> Column:
    return cells.number(_col(name), _dtype(df, name))


def _null(df: DataFrame, name: str) -> Column:
    return F.lit(None).cast(_dtype(df, name))


def _quantile(df: DataFrame, name: str, p: float, where: Column | None = None) -> float | None:
    value = cells.double(_col(name), _dtype(df, name))
    return exact_quantiles(df, {name: value if where is None else F.when(where, value)}, [p])[name][0]


# ---- replace cells: rule-typed repairs ---------------------------------------------------------


def null_where(df: DataFrame, name: str, bad: Column) -> DataFrame:
    return df.withColumn(name, F.when(F.coalesce(bad, F.lit(False)), _null(df, name)).otherwise(_col(name)))


def _fitting(df: DataFrame, name: str, value: float):
    """The type that holds the value: the column's own, or DOUBLE for a fraction in an integer column."""
    dtype = _dtype(df, name)
    return T.DoubleType() if isinstance(dtype, T.IntegralType) and value != int(value) else dtype


def fill_median(df: DataFrame, name: str, among: Column | None = None) -> DataFrame:
    """Missing numbers become the median (of the rows `among`)."""
    median = _quantile(df, name, 0.5, among)
    if median is None:
        return df
    kind = _fitting(df, name, median)
    known = cells.clean(_col(name), _dtype(df, name)).cast(kind)
    return df.withColumn(name, F.coalesce(known, F.lit(median).cast(kind)))


def mode_of(df: DataFrame, name: str, among: Column | None = None) -> str | None:
    """The most frequent text that is not blank; the smallest of equals. A grouped count and a top-1."""
    filled = df.filter(_present(df, name) if among is None else among & _present(df, name))
    row = value_counts(filled, name).orderBy(F.desc("n"), "value").first()
    return None if row is None else row["value"]


def fill_mode(df: DataFrame, name: str, among: Column | None = None) -> DataFrame:
    """Missing and blank text becomes the most frequent value (of the rows `among`)."""
    mode = mode_of(df, name, among)
    return df.withColumn(name, F.when(_present(df, name), _col(name)).otherwise(F.lit(UNKNOWN if mode is None else mode)))


def fill_missing(df: DataFrame, name: str, among: Column | None = None) -> DataFrame:
    return fill_median(df, name, among) if cells.is_numeric(_dtype(df, name)) else fill_mode(df, name, among)


def suffix_repeats(df: DataFrame, name: str, row_key: Sequence[str]) -> DataFrame:
    """Second and later copies get a suffix; the column becomes text."""
    marked = repeats.mark_repeats(df, [name], row_key, "__repeat")
    value = cells.text(_col(name), _dtype(df, name))
    changed = F.when(F.col("__repeat"), F.concat(F.coalesce(value, F.lit("nan")), F.lit(REPEAT_SUFFIX)))
    return marked.withColumn(name, changed.otherwise(value)).drop("__repeat")


def suffix_groups(df: DataFrame, name: str, suffix: str = REPEAT_SUFFIX) -> DataFrame:
    """Every member of a group of copies gets the suffix, the first one too."""
    counted = repeats.copies(df, [name], "__copies")
    value = cells.text(_col(name), _dtype(df, name))
    changed = F.when(F.col("__copies") > 1, F.concat(F.coalesce(value, F.lit("nan")), F.lit(suffix)))
    return counted.withColumn(name, changed.otherwise(value)).drop("__copies")


def null_non_numeric(df: DataFrame, name: str) -> DataFrame:
    """Text that is not a number becomes null; numbers out of range stay."""
    return null_where(df, name, _present(df, name) & _number(df, name).isNull())


def flag_mismatch(df: DataFrame, name: str, pattern: str, flag: str = "needs_review") -> DataFrame:
    """Nothing is changed; rows that do not match the pattern are flagged."""
    text = cells.text(_col(name), _dtype(df, name))
    return df.withColumn(flag, F.coalesce(_present(df, name) & ~match_start(text, pattern), F.lit(False)))


def null_invalid_email(df: DataFrame, name: str) -> DataFrame:
    return null_where(df, name, _present(df, name) & ~match_start(_col(name), EMAIL_PATTERN))


def standardize_dates(df: DataFrame, name: str, formats: Sequence[str] = dates.LENIENT_FORMATS) -> DataFrame:
    """Dates in any listed format are rewritten as yyyy-MM-dd; other text becomes null."""
    day = dates.parse_lenient(_col(name), _dtype(df, name), tuple(formats))
    fixed = F.when(_present(df, name), F.date_format(day, "yyyy-MM-dd")).otherwise(_col(name).cast("string"))
    return df.withColumn(name, fixed)


def null_placeholders(df: DataFrame, name: str, words: Sequence[str] = PLACEHOLDERS) -> DataFrame:
    text = F.lower(cells.strip(cells.text(_col(name), _dtype(df, name))))
    return null_where(df, name, _present(df, name) & text.isin(sorted({str(w).lower() for w in words})))


def drop_repeated_rows(df: DataFrame, row_key: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Copies of an earlier row are dropped (a generated row key is not part of the comparison)."""
    return repeats.keep_first(df, list(columns) if columns else data_columns(df.columns), row_key)


# ---- replace cells: template repairs -----------------------------------------------------------


def null_outside(df: DataFrame, name: str, low: float | None, high: float | None) -> DataFrame:
    n = _number(df, name)
    return null_where(df, name, outside_interval(n, low, high))


def outside_interval(n: Column, low: float | None, high: float | None) -> Column:
    below = F.lit(False) if low is None else n < F.lit(low)
    above = F.lit(False) if high is None else n > F.lit(high)
    return below | above


def zero_negatives(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.when(_number(df, name) < 0, F.lit(0).cast(_dtype(df, name))).otherwise(_col(name)))


def flag_outliers(df: DataFrame, name: str, factor: float = 1.5, flag: str = "needs_review") -> DataFrame:
    value, bounds = _iqr(df, name, factor)
    return df.withColumn(flag, F.coalesce(outside_interval(value, *bounds), F.lit(False)))


def _iqr(df: DataFrame, name: str, factor: float) -> tuple[Column, tuple[float | None, float | None]]:
    """The column as numbers, and the bounds beyond which its values are outliers."""
    value = cells.double(_col(name), _dtype(df, name))
    bounds = outlier_bounds(exact_quantiles(df, {name: value}, (0.25, 0.75))[name], factor)
    return value, bounds or (None, None)


def null_bad_addresses(df: DataFrame, name: str) -> DataFrame:
    """E-mails without a dot somewhere after an `@` become null."""
    return null_where(df, name, ~_col(name).rlike(r"@.*\."))


def text_to_date(df: DataFrame, name: str, fmt: str = dates.DEFAULT_FORMAT) -> DataFrame:
    """The column becomes DATE; text that does not parse becomes null."""
    return df.withColumn(name, dates.parse(_col(name), _dtype(df, name), fmt).cast("date"))


# ---- drop rows ---------------------------------------------------------------------------------


def drop_missing(df: DataFrame, names: Sequence[str]) -> DataFrame:
    keep = F.lit(True)
    for n in names:
        keep = keep & ~cells.missing(_col(n), _dtype(df, n))
    return df.filter(keep)


def keep_first(df: DataFrame, names: Sequence[str], row_key: Sequence[str]) -> DataFrame:
    return repeats.keep_first(df, names, row_key)


def keep_between(df: DataFrame, name: str, low: float, high: float) -> DataFrame:
    return df.filter(_number(df, name).between(F.lit(low), F.lit(high)))


def drop_bad_phones(df: DataFrame, name: str, shortest: int = 7) -> DataFrame:
    """Keep numbers made of digits, `+ - ( )` and white space, and not too short."""
    return df.filter(match_start(_col(name), r"[-+()\d\s]+$") & (F.length(_col(name)) >= shortest))


def drop_bad_dates(df: DataFrame, name: str, formats: Sequence[str] = dates.LENIENT_FORMATS) -> DataFrame:
    """The column becomes DATE; rows whose text is not a date are dropped."""
    day = dates.parse_lenient(_col(name), _dtype(df, name), tuple(formats))
    return df.withColumn(name, day).filter(_col(name).isNotNull())


def drop_future(df: DataFrame, name: str, as_of: dt.date | str | None = None) -> DataFrame:
    day = dates.parse(_col(name), _dtype(df, name)).cast("date")
    return df.filter(F.coalesce(day <= as_of_date(as_of), F.lit(True)))


def drop_placeholders(df: DataFrame, name: str, words: Sequence[str]) -> DataFrame:
    found = F.lower(_col(name)).isin(sorted({w.lower() for w in words}))
    return df.filter(~F.coalesce(found, F.lit(False)))


def keep_allowed(df: DataFrame, name: str, values: Sequence) -> DataFrame:
    return df.filter(_col(name).isin(list(values)))


def drop_negative(df: DataFrame, name: str) -> DataFrame:
    return df.filter(_number(df, name) >= 0)


def keep_domains(df: DataFrame, name: str, domains: Sequence[str], domain: str = "domain") -> DataFrame:
    """Adds the text after the first `@` and keeps the rows whose domain is allowed."""
    return df.withColumn(domain, F.regexp_extract(_col(name), "@(.+)$", 1)).filter(F.col(domain).isin(list(domains)))


def drop_outliers(df: DataFrame, name: str, factor: float = 1.5) -> DataFrame:
    """Outliers are dropped, and rows without a value too."""
    value, bounds = _iqr(df, name, factor)
    return df.filter(value.isNotNull() & ~outside_interval(value, *bounds))


def drop_above(df: DataFrame, name: str, p: float = 0.99, only_above: float = 2.0) -> DataFrame:
    """Rows above `only_above` times the percentile are dropped, and rows without a value too."""
    top = _quantile(df, name, p)
    return df.limit(0) if top is None else df.filter(_number(df, name) <= F.lit(top * only_above))


# ---- change values -----------------------------------------------------------------------------


def replace_known(df: DataFrame, name: str, corrections: Mapping[str, str]) -> DataFrame:
    """Known wrong parts of a trimmed text are replaced, in the order given."""
    value = cells.strip(_col(name))
    for wrong, right in corrections.items():
        value = F.replace(value, F.lit(wrong), F.lit(right))
    return df.withColumn(name, value)


def replace_values(df: DataFrame, name: str, corrections: Mapping[str, str] | DataFrame) -> DataFrame:
    """Whole values are replaced by a (wrong, right) table. Spark broadcasts the table while it is small."""
    if not isinstance(corrections, DataFrame):
        corrections = df.sparkSession.createDataFrame(list(corrections.items()), "wrong STRING, right STRING")
    table = corrections.groupBy(F.col("wrong").alias("__wrong")).agg(F.min("right").alias("__right"))
    joined = df.join(table, _col(name) == F.col("__wrong"), "left")
    return joined.withColumn(name, F.coalesce("__right", _col(name))).select(*[_col(c) for c in df.columns])


def cap_above(df: DataFrame, name: str, p: float = 0.99, only_above: float = 1.0) -> DataFrame:
    """Values above `only_above` times the percentile become the percentile."""
    top = _quantile(df, name, p)
    if top is None:
        return df
    high = _number(df, name) > F.lit(top * only_above)
    return df.withColumn(name, F.when(high, F.lit(top)).otherwise(_number(df, name).cast("double")))


def impute_outside(df: DataFrame, name: str, low: float, high: float) -> DataFrame:
    """Values outside the interval become the median of the values inside."""
    n = _number(df, name)
    median = _quantile(df, name, 0.5, n.between(F.lit(low), F.lit(high)))
    if median is None:
        return df
    kind = _fitting(df, name, median)
    fixed = F.when(outside_interval(n, low, high), F.lit(median).cast(kind))
    return df.withColumn(name, fixed.otherwise(_col(name).cast(kind)))


# ---- user repairs and reports --------------------------------------------------------------------


def apply_user_fix(df: DataFrame, fix: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, str | None]:
    """The data after a user's own DataFrame function, and why it failed if it did; then the data is as it was.

    The result is written to the shared folder, because a fix can also fail on a row while it runs.
    """
    try:
        return cut_lineage(df.transform(fix)), None
    except Exception as e:  # noqa: BLE001 - any failure of foreign code means "no change", and is reported
        return df, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows before, rows after, rows removed and the share removed."""
    n = before.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        after.agg(F.count(F.lit(1)).alias("rows_after"))
        .select(n.alias("rows_before"), "rows_after")
        .select(
            "rows_before", "rows_after",
            (F.col("rows_before") - F.col("rows_after")).alias("rows_removed"),
            F.when(F.col("rows_before") > 0,
                   F.bround((F.col("rows_before") - F.col("rows_after")) / F.greatest("rows_before", F.lit(1)) * 100, 1))
            .otherwise(0.0).alias("removed_pct"),
        )
    )


def fix_summary(attempts: DataFrame) -> DataFrame:
    """One row over fix attempts: totals, successes, failures, and the columns that were fixed."""
    return attempts.agg(
        F.count(F.lit(1)).alias("total_fixes"),
        F.count_if("success").alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
        F.array_sort(F.collect_set(F.when(F.col("success"), F.col("column_name")))).alias("columns_fixed"),
    )
