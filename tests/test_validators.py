"""Pass and fail cases of every rule type, and rules that cannot run."""

from __future__ import annotations

import datetime as dt

import pytest
from helpers import doubles, failing, frame, longs, texts

from plumbline import Rule, validate
from plumbline.operators import validators


def test_not_null(spark):
    assert failing(texts(spark, "a", None, "", " \t", "b"), "not_null") == [1, 2, 3]
    assert failing(doubles(spark, 1.0, float("nan"), None), "not_null") == [1, 2]


def test_unique(spark):
    assert failing(texts(spark, "a", "b", "a", None, None, "a"), "unique") == [2, 4, 5]
    assert failing(doubles(spark, float("nan"), None, 0.0, -0.0), "unique") == [1, 3]
    assert failing(longs(spark, 1, 2, 3), "unique") == []
    arrays = frame(spark, [([1, 2],), ([1],), ([1, 2],)], "c ARRAY<INT>")
    assert failing(arrays, "unique") == [2]


def test_maps_cannot_be_compared(spark):
    maps = frame(spark, [({"a": 1},)], "c MAP<STRING,INT>")
    assert failing(maps, "unique") == "error"
    assert failing(maps, "duplicate_row", column="_all") == "error"


def test_range(spark):
    assert failing(longs(spark, 5, -1, 200, None), "range", min=0, max=120) == [1, 2]
    assert failing(texts(spark, "5", "x", "999"), "range", min=0, max=120) == [2]
    assert failing(longs(spark, -10**18, 10**18), "range") == []
    assert failing(longs(spark, 1, 5), "range", min=2) == [0]
    assert failing(doubles(spark, float("inf"), float("nan"), 1.0), "range", max=10) == [0]


def test_regex(spark):
    assert failing(texts(spark, "AB", "abc", None, "", "ABC"), "regex", pattern="^[A-Z]{2}$") == [1, 4]
    assert failing(texts(spark, "ABC"), "regex", pattern="[A-Z]{2}") == []
    assert failing(texts(spark, "AB"), "regex", pattern="[bad") == "error"
    assert failing(longs(spark, 12, 3), "regex", pattern=r"\d\d") == [1]


def test_email(spark):
    assert failing(texts(spark, "a@b.co", "a@b", "a b@c.de", None, "", "a@b.c1"), "email") == [1, 2, 5]


def test_dates(spark):
    data = texts(spark, "2024-01-15", "2024-13-01", "15/01/2024", None, "", " 2024-2-3 ")
    assert failing(data, "date") == [1, 2]
    assert failing(data, "date_format", format="%d/%m/%Y") == [0, 1, 5]
    assert failing(data, "date", format="%Q") == "error"
    typed = frame(spark, [(dt.date(2024, 1, 1),), (None,)], "c DATE")
    assert failing(typed, "date") == []
    stamps = frame(spark, [(dt.datetime(2030, 1, 1, 5),), (dt.datetime(2020, 1, 1),)], "c TIMESTAMP")
    assert failing(stamps, "future_date") == [0]


def test_future_and_fresh(spark):
    data = texts(spark, "2024-12-01", "2024-12-02", "bad", "2023-12-01", "2023-12-02", None)
    assert failing(data, "future_date") == [1, 2]
    # 2024 is a leap year: 2023-12-01 is 366 days back.
    assert failing(data, "data_freshness", max_age_days=365) == [2, 3]
    assert failing(data, "data_freshness", max_age_days=366) == [2]


def test_phone(spark):
    data = texts(spark, "+1-555-0101", "5550101", None, "+1-555-01011")
    assert failing(data, "phone") == [1, 3]
    assert failing(data, "phone", pattern=r"^\d+$") == [0, 3]


def test_phone_with_a_bad_pattern_warns(spark):
    run = validate(texts(spark, "+1-555-0101", "x"), [Rule("R", "c", "phone", params={"pattern": "("})])
    result = run.rule_results.first()
    assert (result["status"], result["failed_count"]) == ("ok", 1)
    assert "default pattern" in result["error"]


def test_allowed_values(spark):
    assert failing(texts(spark, "a", "A", "a ", None), "allowed_values", values=["a"]) == [1, 2]
    assert failing(texts(spark, "1", "2"), "allowed_values", values=[1, "2"]) == [0]
    assert failing(longs(spark, 1, 2), "allowed_values", values=[1.0, "2"]) == [1]
    assert failing(texts(spark, "a", None), "allowed_values") == [0]


def test_long_lists_are_joined(spark):
    many = [f"v{i}" for i in range(2000)]
    assert failing(texts(spark, "v1999", "v2000", None, "v0"), "allowed_values", values=many) == [1]
    assert failing(longs(spark, 5, 5000), "allowed_values", values=list(range(2000))) == [1]
    pairs = {str(i): str(i * 2) for i in range(2000)}
    data = frame(spark, [("7", "14"), ("7", "15"), ("x", "1"), (None, "1")], "c STRING, d STRING")
    assert failing(data, "data_consistency", check_column="d", mappings=pairs) == [1]


def test_numeric(spark):
    assert failing(texts(spark, "1", "1e3", " 2 ", "10d", "1,000", None, "", "nan"), "numeric") == [3, 4, 7]
    assert failing(longs(spark, 1, None), "numeric") == []


def test_positive(spark):
    data = doubles(spark, 1.0, 0.0, -0.00005, -1.0, None)
    assert failing(data, "positive") == [1, 2, 3]
    assert failing(data, "positive", allow_zero=True) == [3]


def test_lengths(spark):
    data = texts(spark, "a", "abc", "", None, " é")
    assert failing(data, "min_length", min_length=2) == [0]
    assert failing(data, "max_length", max_length=2) == [1]
    assert failing(longs(spark, 7, 12345), "max_length", max_length=3) == [1]


def test_duplicate_row(spark):
    data = frame(spark, [(1, "x"), (1, "x"), (2, "x"), (None, "y"), (None, "y")], "a BIGINT, b STRING")
    assert failing(data, "duplicate_row", column="_all", columns=["a", "b"]) == [1, 4]
    assert failing(data, "duplicate_row", column="_all", columns=["b"]) == [1, 2, 4]
    assert failing(data, "duplicate_row", column="_all") == []  # the row number differs
    assert failing(data, "duplicate_row", column="_all", columns=["nope"]) == "error"


def test_placeholder(spark):
    data = texts(spark, "N/A", "todo", " TODO ", "fine", None, "-")
    assert failing(data, "placeholder") == [0, 1, 5]
    assert failing(data, "placeholder", values=["FINE"]) == [3]


def test_missing_threshold(spark):
    data = texts(spark, "a", None, "", "b")
    assert failing(data, "missing_threshold", max_null_pct=24.9) == [1]
    assert failing(data, "missing_threshold", max_null_pct=25) == []
    message = validate(data, [Rule("R", "c", "missing_threshold", params={"max_null_pct": 5})], key=["rk"])
    assert message.violations.first()["reason"] == "Column 'c' has 25.0% nulls (threshold: 5.0%)"


def test_customer_id_pattern(spark):
    assert failing(longs(spark, 12, None), "customer_id_pattern") == []
    assert failing(texts(spark, "12", "a1"), "customer_id_pattern") == [1]


def test_email_domain(spark):
    data = texts(spark, "a@x.com", "a@X.COM ", "a@y.com", "none", "a@@x.com", None)
    assert failing(data, "email_domain", domains=["x.com"]) == [2, 3, 4]
    assert failing(data, "email_domain") == [3]


def test_codes(spark):
    data = texts(spark, "usd", "USD", "XXX", None)
    assert failing(data, "currency") == [2]
    assert failing(data, "currency", currencies=["usd"]) == [0, 1, 2]
    countries = texts(spark, "us", "UK", "GB", "")
    assert failing(countries, "country") == [2]
    assert failing(countries, "country", valid_countries=["gb"]) == [0, 1]


def test_date_order(spark):
    data = frame(spark, [("2024-01-02", "2024-01-01"), ("2024-01-01", "2024-01-01"), ("bad", "2024-01-01"), (None, "x")],
                 "c STRING, d STRING")
    assert failing(data, "date_order", end_column="d") == [0]
    assert failing(data, "date_order", end_column="d", start_column="nope") == "error"


def test_amounts(spark):
    assert failing(longs(spark, -1, 0, 130, None), "age") == [0, 2]
    assert failing(longs(spark, -1, 10**8), "salary") == [0, 1]
    assert failing(texts(spark, "5", "x", "0", "", None), "transaction_amount") == [1, 2]
    assert failing(doubles(spark, 5.0, 50.0), "transaction_amount", max=10) == [1]


def test_rule_types_keep_their_name(spark):
    assert validate(longs(spark, 1), [Rule("R", "c", "age")]).rule_results.first()["rule_type"] == "age"


def test_outlier(spark):
    data = longs(spark, 10, 11, 12, 13, 14, 1000, None)
    assert failing(data, "outlier") == [5]
    assert failing(data, "outlier", factor=1000) == []
    assert failing(texts(spark, "x", None), "outlier") == []


def test_cross_field(spark):
    data = frame(spark, [(1, 2), (2, 1), (None, 1), (2, 2)], "c BIGINT, d BIGINT")
    assert failing(data, "cross_field", column_b="d", operator="<") == [1, 3]
    assert failing(data, "cross_field", column_b="d", operator="!=") == [3]
    assert failing(data, "cross_field", column_b="d", operator="~") == "error"


def test_business_rule(spark):
    data = frame(spark, [(1, 0), (-1, 2), (None, 1)], "c BIGINT, d BIGINT")
    assert failing(data, "business_rule", expression="c >= 0") == [1, 2]
    # A division by zero fails its row, not the job.
    assert failing(data, "business_rule", expression="c / d < 0 or d = 1 and c is null") == [0]
    assert failing(data, "business_rule", expression="no_such_column > 1") == "error"
    assert failing(data, "business_rule", expression="c >>> ") == "error"
    assert failing(data, "business_rule") == []


def test_data_consistency(spark):
    data = frame(spark, [("US", "USD"), (" US ", "EUR"), ("DE", "X"), ("US", None), (None, "USD")], "c STRING, d STRING")
    assert failing(data, "data_consistency", check_column="d", mappings={"US": "USD"}) == [1, 3]
    assert failing(data, "data_consistency", check_column="d", mappings={"nan": "EUR"}) == [4]
    numbers = frame(spark, [(1, 2), (1, 3)], "c BIGINT, d BIGINT")
    assert failing(numbers, "data_consistency", check_column="d", mappings={1: 2}) == [1]


@pytest.mark.parametrize(
    "rule_type, params",
    [("cross_field", {"column_b": "nope"}), ("date_order", {"end_column": "nope"}), ("data_consistency", {"check_column": "nope", "mappings": {"a": "b"}})],
)
def test_absent_second_column_is_skipped(spark, rule_type, params):
    result = validate(texts(spark, "a"), [Rule("R", "c", rule_type, params=params)]).rule_results.first()
    assert (result["status"], result["passed"], result["failed_count"]) == ("skipped", True, 0)


@pytest.mark.parametrize("rule_type", ["not_null", "email", "missing_threshold", "data_freshness", "outlier", "unique"])
def test_absent_column(spark, rule_type):
    assert failing(texts(spark, "a", "b"), rule_type, column="nope") == "error"


def test_bad_parameters_are_errors(spark):
    assert failing(texts(spark, "a"), "min_length", min_length="many") == "error"
    assert failing(longs(spark, 1), "range", min="low") == "error"


def test_empty_table(spark):
    empty = longs(spark).limit(0)
    rules = [Rule("A", "c", "not_null"), Rule("B", "c", "unique"), Rule("C", "c", "missing_threshold"),
             Rule("D", "c", "outlier"), Rule("E", "nope", "not_null"), Rule("F", "_all", "duplicate_row")]
    found = {r["rule_id"]: r for r in validate(empty, rules, key=["rk"]).rule_results.collect()}
    assert all(r["total_rows"] == 0 and r["failed_count"] == 0 for r in found.values())
    assert [k for k, r in sorted(found.items()) if not r["passed"]] == ["E"]
    assert validate(empty, rules, key=["rk"]).violations.count() == 0


def test_no_rules_and_no_key(spark):
    run = validate(longs(spark, 1), [])
    assert run.rule_results.count() == 0
    with pytest.raises(ValueError):
        validate(longs(spark, 1), [Rule("R", "c", "not_null")]).violations


def test_all_null_column(spark):
    data = texts(spark, None, None)
    assert failing(data, "not_null") == [0, 1]
    assert failing(data, "email") == []
    assert failing(data, "unique") == [1]


def test_odd_column_names(spark):
    data = frame(spark, [("a",), (None,), ("a",)], "`my.col name` STRING")
    assert failing(data, "not_null", column="my.col name") == [1]
    assert failing(data, "unique", column="my.col name") == [2]


def test_many_rules_in_several_passes(spark):
    rules = [Rule(f"R{i}", "c", "range", params={"max": i}) for i in range(230)]
    found = {r["rule_id"]: r["failed_count"] for r in validate(longs(spark, 100, 200), rules).rule_results.collect()}
    assert found == {f"R{i}": (i < 100) + (i < 200) for i in range(230)}


@pytest.mark.parametrize("kind", ["BIGINT", "DOUBLE", "DECIMAL(20,2)", "STRING"])
def test_a_list_gives_one_answer_at_any_length(spark, kind, monkeypatch):
    """In the expression or joined, the same rows fail."""
    numbers = [0, 5, 5.0, 2.5, 1e7, 10_000_000, 2**53 + 1, -3, 1e-5, float("inf"), 10**30]
    values = [str(v) for v in (5, "abc", "1e7", "")] if kind == "STRING" else numbers
    cells_ = ["5", "abc", "ABC", "1e7", None] if kind == "STRING" else ["0", "5", "2.5", "2.25", "10000000", "9007199254740993", "9007199254740992", "-3", "7", None]
    data = spark.createDataFrame([(c,) for c in cells_], "c STRING").selectExpr(f"try_cast(c AS {kind}) AS c", "c AS k")
    found = []
    for length in (500, 1):
        monkeypatch.setattr(validators, "INLINE_LIST", length)
        rules = [Rule("R", "c", "allowed_values", params={"values": values})]
        found.append(sorted(r["row_key"]["k"] for r in validate(data, rules, key=["k"]).violations.collect()))
    assert found[0] == found[1] and found[0]
