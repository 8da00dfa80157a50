"""Differences of two snapshots of a table, as multisets: rows that came, rows that went, keys that changed.

1. Every row gets a 128-bit digest of its columns. Both snapshots are cut into the same ranges of the first key column
   (equal widths between the smallest and the largest value; by hash where that column is no number or date), and for
   each range the number of rows and the sums of the digests' parts are added up, which is independent of order. Two
   ranges with equal checksums hold the same multiset of rows.
2. Rows of equal ranges are filtered out where they are read, before anything is shuffled. The list of unequal ranges
   has at most RANGES rows, so it is broadcast.
3. What remains is counted by key and digest, old rows as -1 and new ones as +1; only keys and digests are shuffled,
   and a repeated row is one row for each task. What does not add up to 0 differs.
4. Whole rows are fetched for the digests that differ: by broadcast if these are few (their number is measured), else
   by a join; one of each with its number of copies.

Nulls equal each other, NaN counts as null. A key stands for its rows: with old and new rows that differ it has
changed, else its rows were added or removed. Keys need not be unique. Map columns cannot be compared.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.cells import clean, is_date, is_numeric
from plumbline.sources.storage import cut_lineage

RANGES = 4096
BROADCAST_BYTES = 8 << 20


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _digest(df: DataFrame, names: Sequence[str], a: str, b: str) -> list[Column]:
    """Two 64-bit hashes of the columns; where nulls stand is hashed too, and nested values as JSON."""
    parts = []
    for n in names:
        dtype = df.schema[n].dataType
        nested = isinstance(dtype, (T.ArrayType, T.StructType))
        c = clean(_col(n), dtype)
        parts += [F.to_json(F.struct(c)) if nested else c, c.isNull()]
    return [F.xxhash64(*parts).alias(a), F.xxhash64(F.lit(1), *parts).alias(b)]


class SnapshotDiff:
    """Lazy tables about what differs; building them runs the jobs of steps 1 to 3."""

    def __init__(self, old: DataFrame, new: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None, ranges: int = RANGES):
        self.key = list(key)
        self.columns = list(columns) if columns else list(new.columns)
        if not self.key or any(k not in self.columns for k in self.key):
            raise ValueError("the key must be columns that are compared")
        for side in (old, new):
            for c in self.columns:
                if c not in side.columns:
                    raise ValueError(f"column '{c}' is not in both snapshots")
                if isinstance(side.schema[c].dataType, T.MapType):
                    raise ValueError(f"column '{c}' is a map and cannot be compared")
        for c in self.columns:
            if old.schema[c].dataType != new.schema[c].dataType:
                raise ValueError(f"column '{c}' has two types")
        self.n_ranges = ranges
        self.old, self.new = old, new

    @cached_property
    def _place(self) -> Column:
        """The range of a row by its first key column; null has a range of its own (-1)."""
        name = self.key[0]
        dtype = self.new.schema[name].dataType
        number = None
        if is_numeric(dtype):
            number = clean(_col(name), dtype).cast("double")
        elif is_date(dtype):
            number = F.unix_seconds(_col(name).cast("timestamp")).cast("double")
        if number is None:
            where = F.pmod(F.xxhash64(_col(name)), F.lit(self.n_ranges))
        else:
            ends = [side.agg(F.min(number).alias("lo"), F.max(number).alias("hi")).first() for side in (self.old, self.new)]
            low = min((r["lo"] for r in ends if r["lo"] is not None), default=0.0)
            high = max((r["hi"] for r in ends if r["hi"] is not None), default=0.0)
            width = (high - low) / self.n_ranges
            if not 0 < width < float("inf"):
                where = F.pmod(F.xxhash64(_col(name)), F.lit(self.n_ranges))
            else:
                where = F.least(F.floor((number - F.lit(low)) / F.lit(width)), F.lit(self.n_ranges - 1))
        return F.coalesce(F.when(_col(name).isNotNull(), where), F.lit(-1)).cast("int")

    def _digested(self, side: DataFrame, *extra: Column) -> DataFrame:
        return side.select(self._place.alias("__range"), *_digest(side, self.columns, "__a", "__b"), *extra)

    @cached_property
    def ranges(self) -> DataFrame:
        """(range, old_rows, new_rows, same): one row for each range that either snapshot has rows in."""
        low = F.lit(0xFFFFFFFF).cast("long")
        sums = [F.sum(F.col(h).bitwiseAND(low)).alias(f"{h}0") for h in ("__a", "__b")]
        sums += [F.sum(F.shiftrightunsigned(h, 32)).alias(f"{h}1") for h in ("__a", "__b")]

        def sums_of(side: DataFrame, rows: str, check: str) -> DataFrame:
            counted = self._digested(side).groupBy("__range").agg(F.count(F.lit(1)).alias(rows), *sums)
            return counted.select("__range", rows, F.struct(rows, *[s for h in ("__a", "__b") for s in (f"{h}0", f"{h}1")]).alias(check))

        both = sums_of(self.old, "old_rows", "__old").join(sums_of(self.new, "new_rows", "__new"), "__range", "full")
        n = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("old_rows", "new_rows")]
        same = F.coalesce(F.col("__old").eqNullSafe(F.col("__new")), F.lit(False))
        return cut_lineage(both.select(F.col("__range").alias("range"), *n, same.alias("same")))

    def _unequal(self, side: DataFrame, *extra: Column) -> DataFrame:
        """Digests of the rows in unequal ranges; all other rows end here."""
        unequal = self.ranges.filter("not same").select("range")
        return self._digested(side, *extra).join(F.broadcast(unequal), F.col("__range") == F.col("range"), "left_semi")

    @cached_property
    def _differing(self) -> DataFrame:
        """(key digest, row digest, net): rows that do not stand equally often in both."""
        sides = []
        for side, sign in ((self.old, -1), (self.new, 1)):
            rows = self._unequal(side, *_digest(side, self.key, "__ka", "__kb"))
            sides.append(rows.select("__ka", "__kb", "__a", "__b", F.lit(sign).cast("long").alias("__sign")))
        net = sides[0].unionAll(sides[1]).groupBy("__ka", "__kb", "__a", "__b").agg(F.sum("__sign").alias("net"))
        return cut_lineage(net.filter("net <> 0"))

    def _free(self, name: str) -> str:
        """The name, with underscores before it where a compared column has it already."""
        while name in self.columns:
            name = f"_{name}"
        return name

    @cached_property
    def _whole(self) -> DataFrame:
        """(change, copies, row): every row that differs, once."""
        size = self._differing.count() * 32
        parts = []
        for side, change, sign in ((self.old, "removed", -1), (self.new, "added", 1)):
            wanted = self._differing.filter(F.col("net") * sign > 0).select(F.col("__a").alias("__wa"), F.col("__b").alias("__wb"), F.abs("net").alias("copies"))
            wanted = F.broadcast(wanted) if size <= BROADCAST_BYTES else wanted
            whole = self._unequal(side, F.struct(*[_col(c) for c in self.columns]).alias("__row"))
            found = whole.join(wanted, (F.col("__a") == F.col("__wa")) & (F.col("__b") == F.col("__wb")))
            one = found.groupBy("__a", "__b").agg(F.first("copies").alias("copies"), F.first("__row").alias("__row"))
            parts.append(one.select(F.lit(change).alias("change"), "copies", F.col("__row").alias("row")))
        return parts[0].unionAll(parts[1])

    def _of_row(self, name: str) -> Column:
        return F.col("row").getField(name)

    @cached_property
    def rows(self) -> DataFrame:
        """Every row that differs, once: (change, copies, the columns); `removed` from the old snapshot or `added` in the new one.

        `added` rows are what a multiset difference new - old gives, `removed` ones old - new.
        """
        marks = [F.col(c).alias(self._free(c)) for c in ("change", "copies")]
        return self._whole.select(*marks, *[self._of_row(c).alias(c) for c in self.columns])

    @cached_property
    def keys(self) -> DataFrame:
        """(the key, change, removed_rows, added_rows, changed_columns): one row for each key with a difference.

        `changed_columns` is filled in for keys with one removed and one added row.
        """
        rest = [c for c in self.columns if c not in self.key]
        old = F.col("change") == "removed"

        def only(side: Column) -> Column:
            return F.max(F.when(side, F.struct(*[self._cleaned(c).alias(f"c{k}") for k, c in enumerate(rest)])))

        compared = [only(old).alias("__was"), only(~old).alias("__is")] if rest else []
        grouped = self._whole.groupBy(*[self._cleaned(k).alias(f"k{j}") for j, k in enumerate(self.key)]).agg(
            F.sum(F.when(old, F.col("copies")).otherwise(0)).alias("removed_rows"),
            F.sum(F.when(~old, F.col("copies")).otherwise(0)).alias("added_rows"), *compared,
        )
        kind = F.when(F.col("added_rows") == 0, "removed").when(F.col("removed_rows") == 0, "added").otherwise("changed")
        differing = [F.when(~F.col("__was")[f"c{k}"].eqNullSafe(F.col("__is")[f"c{k}"]), F.lit(c)) for k, c in enumerate(rest)]
        listed = F.array_compact(F.array(*differing)) if rest else F.array().cast("array<string>")
        single = (F.col("removed_rows") == 1) & (F.col("added_rows") == 1)
        found = {"change": kind, "removed_rows": F.col("removed_rows"), "added_rows": F.col("added_rows"), "changed_columns": F.when(single, listed)}
        return grouped.select(*[F.col(f"k{j}").alias(k) for j, k in enumerate(self.key)], *[c.alias(self._free(n)) for n, c in found.items()])

    def _cleaned(self, name: str) -> Column:
        return clean(self._of_row(name), self.new.schema[name].dataType)

    @cached_property
    def summary(self) -> DataFrame:
        """One row: rows, ranges, ranges and rows that were compared one by one, and what differs by rows and by keys."""
        ranges = self.ranges.agg(
            F.coalesce(F.sum("old_rows"), F.lit(0)).alias("old_rows"), F.coalesce(F.sum("new_rows"), F.lit(0)).alias("new_rows"),
            F.count(F.lit(1)).alias("n_ranges"), F.count_if(~F.col("same")).alias("unequal_ranges"),
            F.coalesce(F.sum(F.when(~F.col("same"), F.col("old_rows") + F.col("new_rows"))), F.lit(0)).alias("compared_rows"),
        )
        net = F.col("net")
        per_key = self._differing.groupBy("__ka", "__kb").agg(F.sum(F.when(net < 0, -net).otherwise(0)).alias("r"), F.sum(F.when(net > 0, net).otherwise(0)).alias("a"))
        changes = per_key.agg(
            F.coalesce(F.sum("r"), F.lit(0)).alias("removed_rows"), F.coalesce(F.sum("a"), F.lit(0)).alias("added_rows"),
            F.count_if((F.col("r") > 0) & (F.col("a") == 0)).alias("removed_keys"), F.count_if((F.col("a") > 0) & (F.col("r") == 0)).alias("added_keys"),
            F.count_if((F.col("r") > 0) & (F.col("a") > 0)).alias("changed_keys"),
        )
        both = ranges.unionByName(changes, allowMissingColumns=True)  # two rows; a join on a constant would be a nested loop
        return both.agg(*[F.max(c).alias(c) for c in both.columns])


def snapshot_diff(old: DataFrame, new: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None, ranges: int = RANGES) -> SnapshotDiff:
    """What changed from `old` to `new`; `key` names rows, `columns` are compared (default: all of `new`)."""
    return SnapshotDiff(old, new, key, columns, ranges)
