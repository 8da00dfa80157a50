"""Rules as objects, as files and as tables."""

from __future__ import annotations

import pytest

from plumbline import Rule, RuleCatalog
from plumbline.plans import rules as tables

ENTRIES = [
    {"id": "R1", "column": "age", "type": "RANGE", "severity": "High", "params": {"min": 0, "max": 120}},
    {"id": "R2", "column": "email", "type": "email"},
    {"id": "R3", "column": "email", "type": "sorted"},
    {"id": "R4", "type": "email"},
    {"id": "R5", "column": "age", "type": "not_null", "severity": "urgent"},
    "just text",
    {"id": 6, "column": "name", "type": "not_null", "params": None},
]


def test_rule():
    rule = Rule("R1", "age", "range", "high", "text", {"min": 0})
    assert rule.summary() == "[R1] age → range (high)"
    assert Rule.of(rule.to_dict()) == rule
    assert Rule("R1", "age", "range").severity == "medium"
    for bad in [("R", "c", "nope"), ("R", "", "email"), ("R", "c", "email", "urgent")]:
        with pytest.raises(ValueError):
            Rule(*bad)


def test_all_types_are_accepted():
    assert len(tables.RULE_TYPES) == len(set(tables.RULE_TYPES)) == 30
    for kind in tables.RULE_TYPES:
        Rule("R", "c", kind)


def test_catalog_keeps_bad_rules_as_errors():
    catalog = RuleCatalog(ENTRIES)
    assert [r.id for r in catalog] == ["R1", "R2", "6"]
    assert [e.split(":")[0] for e in catalog.errors] == ["Rule #3", "Rule #4", "Rule #5", "Rule #6"]
    assert [r.id for r in catalog.for_column("email")] == ["R2"]
    assert [r.id for r in catalog.of_type("range")] == ["R1"]
    assert [r.id for r in catalog.with_severity("medium")] == ["R2", "6"]
    assert catalog.summary() == {
        "total_rules": 3, "by_type": {"range": 1, "email": 1, "not_null": 1},
        "by_severity": {"high": 1, "medium": 2}, "columns_covered": ["age", "email", "name"],
        "parse_errors": 4, "source": "inline",
    }


def test_no_rules():
    with pytest.raises(ValueError):
        RuleCatalog([])


def test_table_round_trip(spark):
    catalog = RuleCatalog(ENTRIES)
    again = RuleCatalog.from_table(catalog.to_dataframe(spark))
    assert again.rules == catalog.rules


def test_rule_tables(spark):
    raw = spark.createDataFrame(
        [("R1", "age", "RANGE", None, None, {}), ("R2", None, "email", "low", "d", {}), ("R3", "x", "odd", "low", "d", {}),
         ("R4", "", "email", "low", "d", {}), ("R5", "age", "email", "LOUD", "d", {})],
        tables.RULE_SCHEMA,
    )
    checked = tables.check_rules(raw)
    assert {r["id"]: r["error"] for r in checked.collect()} == {
        "R1": None, "R2": "missing keys: column", "R3": "invalid type 'odd'", "R4": "column name is empty",
        "R5": "invalid severity 'loud'"}
    assert [r["severity"] for r in tables.select_rules(checked, column="age").collect()] == ["medium"]
    summary = {(r["measure"], r["name"]): r["n"] for r in tables.rules_summary(checked).collect()}
    assert summary == {("type", "range"): 1, ("severity", "medium"): 1, ("column", "age"): 1, ("total", "rules"): 1,
                       ("total", "errors"): 4}


def test_coverage(spark):
    rules = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("c", "z")], "dataset STRING, column STRING")
    columns = spark.createDataFrame([("a", "x"), ("a", "w"), ("c", "z")], "dataset STRING, column STRING")
    found = {r["dataset"]: (r["matching"], r["absent"], r["verdict"]) for r in tables.rule_coverage(rules, columns).collect()}
    assert found == {"a": (1, 1, "warning"), "b": (0, 1, "error"), "c": (1, 0, "ok")}
