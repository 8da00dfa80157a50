"""Twelve customers, thirty-three rules, and the rows that must fail."""

from __future__ import annotations

import pytest

from plumbline import Rule, validate
from plumbline.operators.reports import run_summary

# The sample customers and rules with their known failures.
CUSTOMERS = [
    (1, "Alice Johnson", "alice@example.com", 28, "+1-555-0101", "2024-01-15", "US", 55000),
    (2, None, "bob@example.com", 35, "+1-555-0102", "2024-02-20", "UK", 62000),
    (3, "Carol White", "carol-at-example.com", 200, "+1-555-0103", "2024-13-45", "ZZ", 75000),
    (4, "David Brown", "david@example.com", -5, "555-INVALID", "not-a-date", "AU", -5000),
    (5, "Eve Davis", "eve@example.com", 27, "+1-555-0105", "2024-05-12", "US", 48000),
    (5, "Frank Miller", "frank@example", 55, "+1-555-0106", "2024-06-18", "DE", 15000000),
    (7, None, None, 23, "+1-555-0107", "2024-07-22", None, 42000),
    (8, "test", "henry@example.com", 39, None, "2024/08/30", "FR", 58000),
    (9, "Ivy Chen", "ivy@example.com", 44, "+1-555-0109", "2024-09-14", "CN", 67000),
    (10, "Jack Taylor", "jack@@example.com", 33, "+1-555-0110", "2024-10-01", "US", 51000),
    (11, "Kate Adams", "kate@example.com", 150, "12345", "2024-02-30", "ZZ", 95000),
    (12, "TODO", "todo@test.com", 999, "+1-555-0112", "2028-01-01", "XX", 0),
]
SCHEMA = (
    "row BIGINT, customer_id BIGINT, name STRING, email STRING, age BIGINT, phone STRING, signup_date STRING, "
    "country STRING, salary BIGINT"
)
TEN = ["US", "UK", "CA", "AU", "DE", "FR", "JP", "CN", "IN", "BR"]
PHONE = r"^\+\d{1,3}-\d{3}-\d{4}$"
ISO = "%Y-%m-%d"
RULES = [
    Rule("R001", "customer_id", "not_null", "high"),
    Rule("R002", "name", "not_null", "high"),
    Rule("R003", "email", "not_null", "high"),
    Rule("R004", "country", "not_null", "medium"),
    Rule("R005", "customer_id", "unique", "high"),
    Rule("R006", "age", "range", "medium", params={"min": 0, "max": 120}),
    Rule("R007", "country", "regex", "low", params={"pattern": "^[A-Z]{2}$"}),
    Rule("R008", "email", "email", "medium"),
    Rule("R009", "signup_date", "date", "low", params={"format": ISO}),
    Rule("R010", "phone", "phone", "low", params={"pattern": PHONE}),
    Rule("R011", "country", "allowed_values", "medium", params={"values": TEN}),
    Rule("R012", "age", "numeric", "medium"),
    Rule("R013", "age", "positive", "medium", params={"allow_zero": False}),
    Rule("R014", "name", "min_length", "low", params={"min_length": 2}),
    Rule("R015", "name", "max_length", "low", params={"max_length": 100}),
    Rule("R016", "_all", "duplicate_row", "high", params={"columns": ["customer_id", "name", "email"]}),
    Rule("R017", "signup_date", "future_date", "medium", params={"format": ISO}),
    Rule("R018", "signup_date", "date_format", "low", params={"format": ISO}),
    Rule("R019", "name", "placeholder", "medium",
         params={"values": ["N/A", "NA", "null", "none", "TODO", "TBD", "XXX", "test", "dummy"]}),
    Rule("R020", "email", "missing_threshold", "high", params={"max_null_pct": 10.0}),
    Rule("R021", "customer_id", "customer_id_pattern", "medium", params={"pattern": r"^\d+$"}),
    Rule("R022", "email", "email_domain", "medium",
         params={"domains": ["example.com", "gmail.com", "yahoo.com", "outlook.com"]}),
    Rule("R023", "country", "currency", "medium", params={"currencies": TEN}),
    Rule("R024", "country", "country", "low", params={"valid_countries": [*TEN, "MX", "IT", "ES", "NL"]}),
    Rule("R025", "signup_date", "date_order", "medium",
         params={"start_column": "signup_date", "end_column": "signup_date", "format": ISO}),
    Rule("R026", "age", "age", "medium", params={"min": 18, "max": 100}),
    Rule("R027", "age", "salary", "medium", params={"min": 0, "max": 10000000}),
    Rule("R028", "age", "transaction_amount", "high", params={"min": 0.01, "max": 999999.99}),
    Rule("R029", "age", "outlier", "medium", params={"factor": 1.5}),
    Rule("R030", "age", "cross_field", "high", params={"column_a": "age", "column_b": "age", "operator": ">="}),
    Rule("R031", "age", "business_rule", "high", params={"expression": "age >= 0"}),
    Rule("R032", "country", "data_consistency", "high",
         params={"reference_column": "country", "check_column": "country", "mappings": {"US": "US", "UK": "UK"}}),
    Rule("R033", "signup_date", "data_freshness", "low", params={"max_age_days": 730, "format": ISO}),
]
FAILING = {
    "R002": [1, 6], "R003": [6], "R004": [6], "R005": [5], "R006": [2, 3, 10, 11], "R008": [2, 5, 9],
    "R009": [2, 3, 7, 10], "R010": [3, 10], "R011": [2, 10, 11], "R013": [3], "R017": [2, 3, 7, 10, 11],
    "R018": [2, 3, 7, 10], "R019": [7, 11], "R022": [2, 5, 9, 11], "R023": [2, 10, 11], "R024": [2, 10, 11],
    "R026": [2, 3, 10, 11], "R027": [3], "R028": [3], "R029": [2, 11], "R031": [3],
    "R033": [0, 1, 2, 3, 4, 7, 10],
}


@pytest.fixture(scope="module")
def customers(spark):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(CUSTOMERS)], SCHEMA)


def test_first_pass(customers):
    run = validate(customers, RULES, key=["row"], as_of="2026-06-07")
    found = {}
    for r in run.violations.select("rule_id", "row_key.row").collect():
        found.setdefault(r["rule_id"], []).append(r["row"])
    assert {k: sorted(v) for k, v in found.items()} == FAILING
    counts = {r["rule_id"]: r["failed_count"] for r in run.rule_results.collect()}
    assert counts == {r.id: len(FAILING.get(r.id, [])) for r in RULES}
    total = run_summary(run.rule_results).first()
    assert (total["total_failures"], total["failed_rules"], total["passed_rules"]) == (59, 22, 11)


def test_the_day_matters(customers):
    run = validate(customers, RULES, as_of="2024-12-01")
    assert run_summary(run.rule_results).first()["total_failures"] == 56


def test_partitioning_does_not_matter(customers):
    whole = validate(customers, RULES, key=["row"], as_of="2026-06-07")
    split = validate(customers.repartition(5), RULES, key=["row"], as_of="2026-06-07")

    def rows(run):
        return sorted(tuple(r) for r in run.violations.drop("run_id", "row_key").collect())

    assert rows(whole) == rows(split)


def test_clean_up_leaves_four_customers(customers):
    from plumbline.operators import repair

    data = repair.drop_missing(customers, ["name", "email"])
    data = repair.keep_first(data, ["customer_id"], ["row"])
    data = repair.replace_known(data, "email", {"carol-at-example.com": "carol@example.com", "jack@@": "jack@"})
    data = repair.keep_between(data, "age", 18, 100)
    data = repair.drop_bad_phones(data, "phone")
    data = repair.drop_bad_dates(data, "signup_date")
    data = repair.drop_future(data, "signup_date", "2026-06-07")
    data = repair.drop_placeholders(data, "name", ["N/A", "TODO", "test", "placeholder", "unknown"])
    data = repair.keep_allowed(data, "country", ["US", "UK", "CA", "AU", "DE", "JP", "FR", "CN"])
    data = repair.drop_negative(data, "salary")
    assert sorted(r["customer_id"] for r in data.collect()) == [1, 5, 9, 10]
    assert repair.before_after(customers, data).first().asDict() == {
        "rows_before": 12, "rows_after": 4, "rows_removed": 8, "removed_pct": 66.7}
