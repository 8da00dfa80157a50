"""Repeated keys: counting them, listing the second and later copies, keeping the first copy.

"First" is the smallest row key. Nulls equal each other, and NaN counts as null.

Three things keep these jobs balanced when one key holds a large part of the table:

* counts come from `groupBy`, which adds up inside each task before anything is shuffled;
* rows meet their group in two steps (`attach_groups`): hot groups by broadcast, which a threshold on the
  group size bounds to a fixed number of rows, and all other groups by a join on a salted key;
* wide keys (texts, nested values, many columns) are reduced to 128 bits of hashes before anything is shuffled,
  and are the same if these are (among 10^12 keys two different ones meet with a chance of 10^-15).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.cells import clean, is_string

# A group is hot from this many rows on, and from 1/HOT_GROUPS of the table on, so there are never
# more than HOT_GROUPS hot groups and the broadcast side has at most that many rows. Groups between the two
# bounds are left to the second join, whose skewed partitions AQE splits.
HOT_ROWS = 200_000
HOT_GROUPS = 10_000
SALTS = 1024

# Keys wider than this many bytes are compared by their digests.
WIDE_KEY = 64


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def key_columns(df: DataFrame, keys: Sequence[str]) -> list[Column]:
    return [clean(_quoted(k), df.schema[k].dataType).alias(k) for k in keys]


def is_wide(df: DataFrame, keys: Sequence[str]) -> bool:
    def width(dtype: T.DataType) -> int:
        if is_string(dtype) or isinstance(dtype, (T.BinaryType, T.ArrayType, T.StructType)):
            return WIDE_KEY + 1  # nothing bounds a text
        return 8

    return sum(width(df.schema[k].dataType) for k in keys) > WIDE_KEY


def key_exprs(df: DataFrame, keys: Sequence[str]) -> dict[str, Column]:
    """What rows with equal keys have in common: the key columns, or two 64-bit hashes if they are wide."""
    cleaned = {k: clean(_quoted(k), df.schema[k].dataType) for k in keys}
    if not is_wide(df, keys):
        return cleaned
    parts = []
    for k, c in cleaned.items():
        nested = isinstance(df.schema[k].dataType, (T.ArrayType, T.StructType))
        # hashes pass over nulls, so where a null stands has to be hashed too; in nested values JSON shows it
        parts += [F.to_json(F.struct(c)) if nested else c, c.isNull()]
    return {"__digest_a": F.xxhash64(*parts), "__digest_b": F.xxhash64(F.lit(1), *parts)}


def attach_groups(rows: DataFrame, groups: DataFrame, keys: dict[str, Column], size: str) -> DataFrame:
    """Left-join `groups` (one row per key, `size` rows each) to `rows`, hot groups first.

    `keys` maps each key column of `groups` to its expression over `rows`. The rows of hot groups are settled
    by the first join; the second one gives them salts that match nothing, which only keeps them from piling
    up in one task.
    """
    tag = uuid.uuid4().hex
    names = rows.columns
    rows = rows.withColumn(f"__spread_{tag}", F.monotonically_increasing_id())
    payload = [c for c in groups.columns if c not in keys]
    total = groups.agg(F.sum(size).alias("n")).select(F.coalesce("n", F.lit(0))).scalar()
    hot_from = F.greatest(F.lit(HOT_ROWS), (total / HOT_GROUPS).cast("bigint"))
    renamed = groups.select(
        *[_quoted(k).alias(f"__{k}_{tag}") for k in keys], *[_quoted(p).alias(f"__{p}_{tag}") for p in payload]
    )
    is_hot = F.col(f"__{size}_{tag}") > hot_from

    def same_key(side: str):
        tests = [e.eqNullSafe(_quoted(f"__{k}_{tag}{side}")) for k, e in keys.items()]
        on = tests[0]
        for test in tests[1:]:
            on = on & test
        return on

    def side(frame: DataFrame, name: str) -> DataFrame:
        return frame.select(*[_quoted(c).alias(f"{c}{name}") for c in renamed.columns])

    hot = side(renamed.filter(is_hot), "_hot")
    # Always 0, but not a literal: with a literal the optimizer would take the salt out of the join keys.
    no_salt = (_quoted(f"__{size}_{tag}_cold") < 0).cast("int")
    cold = side(renamed.filter(~is_hot), "_cold").withColumn(f"__salt_{tag}", no_salt)
    settled = _quoted(f"__{size}_{tag}_hot").isNotNull()
    salt = F.when(settled, F.pmod(F.col(f"__spread_{tag}"), F.lit(SALTS)).cast("int") + 1).otherwise(F.lit(0))
    joined = rows.join(F.broadcast(hot), same_key("_hot"), "left").join(
        cold, same_key("_cold") & (salt == F.col(f"__salt_{tag}")), "left"
    )
    return joined.select(
        *[_quoted(c) for c in names],
        *[F.coalesce(_quoted(f"__{p}_{tag}_hot"), _quoted(f"__{p}_{tag}_cold")).alias(p) for p in payload],
    )


def group_sizes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per distinct key (as `key_exprs` gives it), with its number of rows in `copies`."""
    exprs = key_exprs(df, keys)
    return df.groupBy(*[c.alias(k) for k, c in exprs.items()]).agg(F.count(F.lit(1)).alias("copies"))


def repeat_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: (total_rows, repeats), where repeats are the second and later copies."""
    return group_sizes(df, keys).agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("repeats"),
    )


def repeats(df: DataFrame, keys: Sequence[str], row_key: Sequence[str]) -> DataFrame:
    """The second and later rows of every key, whole."""
    exprs = key_exprs(df, keys)
    own = F.struct(*[_quoted(k).alias(f"k{i}") for i, k in enumerate(row_key)])
    groups = (
        df.groupBy(*[c.alias(k) for k, c in exprs.items()])
        .agg(F.count(F.lit(1)).alias("__copies"), F.min(own).alias("__first"))
        .filter(F.col("__copies") > 1)
    )
    joined = attach_groups(df, groups, exprs, "__copies")
    return joined.filter(F.col("__first").isNotNull() & (own != F.col("__first"))).select(
        *[_quoted(c) for c in df.columns]
    )


def copies(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Every row, with the number of rows that share its key in column `name`."""
    groups = group_sizes(df, keys).filter(F.col("copies") > 1).withColumnRenamed("copies", name)
    joined = attach_groups(df, groups, key_exprs(df, keys), name)
    return joined.withColumn(name, F.coalesce(F.col(name), F.lit(1)))


def mark_repeats(df: DataFrame, keys: Sequence[str], row_key: Sequence[str], name: str) -> DataFrame:
    """Every row, with `name` true on second and later copies. The join is on the unique row key."""
    flagged = repeats(df, keys, row_key).select(*[_quoted(k) for k in row_key], F.lit(True).alias(name))
    return df.join(flagged, list(row_key), "left").select(
        *[_quoted(c) for c in df.columns], F.coalesce(F.col(name), F.lit(False)).alias(name)
    )


def keep_first(df: DataFrame, keys: Sequence[str], row_key: Sequence[str]) -> DataFrame:
    """The first row of every key, whole. Only the row keys of the dropped rows are joined back."""
    dropped = repeats(df, keys, row_key).select(*[_quoted(k) for k in row_key])
    return df.join(dropped, list(row_key), "left_anti").select(*[_quoted(c) for c in df.columns])
