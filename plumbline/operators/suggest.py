"""Suggest rules from a profile of the data."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.cells import clean, count_where, is_numeric, is_string, missing
from plumbline.operators.profile import distinct_counts
from plumbline.plans.rules import Rule, RuleCatalog

# ---- fixed values ----------------------------------------------------------------------------
MONEY_WORDS = ("income", "amount", "salary", "price", "cost", "revenue", "mnt", "spend", "payment", "fee")
MANY_NULLS = 0.3
CATEGORIES = (2, 15)
OUTLIER_DISTINCT = 10


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def profile_for_rules(df: DataFrame) -> dict[str, dict]:
    """Per column what the suggestions need, from bounded rows only.

    Distinct values are counted exactly; the values themselves are gathered only where they are so few that
    they make a list of allowed values.
    """
    fields = [f for f in df.schema if not isinstance(f.dataType, T.MapType)]
    measures = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(fields):
        value = clean(_col(f.name), f.dataType)
        measures.append(count_where(missing(_col(f.name), f.dataType)).alias(f"n{i}"))
        if is_numeric(f.dataType):
            measures += [F.min(value).cast("double").alias(f"a{i}"), F.max(value).cast("double").alias(f"b{i}")]
    row = df.agg(*measures).first().asDict()
    distinct = {r["column"]: r["distinct_values"] for r in distinct_counts(df, [f.name for f in fields]).collect()}
    few = [f for f in fields if is_string(f.dataType) and distinct[f.name] <= CATEGORIES[1]]
    sets = [F.sort_array(F.collect_set(_col(f.name))).alias(f"s{i}") for i, f in enumerate(few)]
    listed = dict(zip([f.name for f in few], df.agg(*sets).first())) if sets else {}  # at most 15 values a column
    found = {}
    for i, f in enumerate(fields):
        nulls, n = row[f"n{i}"], distinct[f.name]
        found[f.name] = {
            "rows": row["rows"], "nulls": nulls, "distinct": n, "values": listed.get(f.name),
            "low": row.get(f"a{i}"), "high": row.get(f"b{i}"),
            "all_distinct": "id" in f.name.lower() and nulls == 0 and n == row["rows"],
            "numeric": is_numeric(f.dataType), "text": is_string(f.dataType),
        }
    return found


@dataclass(frozen=True)
class Hint:
    """One heuristic: the rule it proposes for a column, and what the column must look like."""

    type: str
    severity: str
    description: str
    fits: Callable[[str, dict], bool]
    params: Callable[[dict], dict] = lambda p: {}


def _names(*words: str) -> Callable[[str, dict], bool]:
    return lambda name, p: any(w in name for w in words)


def _called(word: str) -> Callable[[str, dict], bool]:
    return lambda name, p: name == word


def _widened(p: dict) -> dict:
    """The observed interval, a tenth wider at both ends."""
    low = 0.0 if p["low"] is None else p["low"]
    high = 100.0 if p["high"] is None else p["high"]
    margin = (high - low) / 10 if high > low else 1
    return {"min": round(low - margin, 2), "max": round(high + margin, 2)}


# The proposals, in the order in which they are numbered within a column.
HINTS = (
    Hint("not_null", "high", "Ensure {0} is not null", lambda name, p: p["nulls"] > p["rows"] * MANY_NULLS),
    Hint("not_null", "medium", "Ensure {0} is not null", lambda name, p: 0 < p["nulls"] <= p["rows"] * MANY_NULLS),
    Hint("unique", "high", "Ensure {0} is unique", lambda name, p: p["all_distinct"]),
    Hint("range", "medium", "Ensure {0} is within expected range", lambda name, p: p["numeric"], _widened),
    Hint("positive", "high", "Ensure {0} is positive", _names(*MONEY_WORDS)),
    Hint("email", "medium", "Validate email format in {0}", _names("email")),
    Hint("date", "low", "Validate date format in {0}", _names("date", "dt_")),
    Hint("allowed_values", "medium", "Ensure {0} has valid values",
         lambda name, p: p["text"] and CATEGORIES[0] <= p["distinct"] <= CATEGORIES[1],
         lambda p: {"values": p["values"]}),
    Hint("phone", "low", "Validate phone format in {0}", _names("phone", "mobile")),
    Hint("range", "high", "Ensure {0} is valid year", _called("year_birth"), lambda p: {"min": 1900, "max": 2010}),
    Hint("range", "high", "Ensure {0} is valid", _called("age"), lambda p: {"min": 0, "max": 120}),
    Hint("outlier", "medium", "Detect outliers in {0}",
         lambda name, p: p["numeric"] and p["distinct"] > OUTLIER_DISTINCT),
)


def suggest_rules(df: DataFrame) -> RuleCatalog:
    """Rules that the data suggests, column by column, closing with a check for repeated rows."""
    proposals: list[tuple[str, Hint, dict]] = []
    for name, p in profile_for_rules(df).items():
        proposals += [(name, h, h.params(p)) for h in HINTS if h.fits(name.lower(), p)]
    whole_row = Hint("duplicate_row", "high", "Check for duplicate rows", lambda name, p: True)
    proposals.append(("_all", whole_row, {}))
    return RuleCatalog(
        [
            Rule(f"R{n:03d}", name, h.type, h.severity, h.description.format(name), params)
            for n, (name, h, params) in enumerate(proposals, 1)
        ],
        source="suggested",
    )
