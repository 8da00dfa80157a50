"""Repairs one by one, rounds of repairs, and the loop."""

from __future__ import annotations

import datetime as dt

import pytest
from helpers import doubles, frame, longs, texts
from pyspark.sql import functions as F

from plumbline import Rule, run_loop, validate
from plumbline.operators import loop, repair
from plumbline.operators.reports import problem_report, report_statistics, sample_per_rule, solution_report


def cells(df, column="c"):
    return [r[column] for r in df.orderBy("rk").collect()]


def test_fill_median(spark):
    assert cells(repair.fill_median(longs(spark, 1, None, 4), "c")) == [1.0, 2.5, 4.0]
    assert cells(repair.fill_median(longs(spark, 1, None, 3), "c")) == [1, 2, 3]
    assert cells(repair.fill_median(doubles(spark, 1.0, float("nan"), 2.0), "c")) == [1.0, 1.5, 2.0]
    assert cells(repair.fill_missing(longs(spark, None), "c")) == [None]


def test_fill_mode(spark):
    assert cells(repair.fill_missing(texts(spark, "b", None, "a", " ", "b", "a"), "c")) == ["b", "a", "a", "a", "b", "a"]
    assert cells(repair.fill_mode(texts(spark, None, ""), "c")) == ["Unknown", "Unknown"]


def test_suffixes(spark):
    data = texts(spark, "a", "b", "a", "a", None, None)
    assert cells(repair.suffix_repeats(data, "c", ["rk"])) == ["a", "b", "a_dup", "a_dup", None, "nan_dup"]
    assert cells(repair.suffix_groups(data, "c")) == ["a_dup", "b", "a_dup", "a_dup", "nan_dup", "nan_dup"]
    assert cells(repair.suffix_repeats(longs(spark, 5, 5), "c", ["rk"])) == ["5", "5_dup"]


def test_null_repairs(spark):
    assert cells(repair.null_non_numeric(texts(spark, "5", "x", "-3", None), "c")) == ["5", None, "-3", None]
    assert cells(repair.null_invalid_email(texts(spark, "a@b.co", "a@b", ""), "c")) == ["a@b.co", None, ""]
    assert cells(repair.null_placeholders(texts(spark, " todo ", "x", "-"), "c")) == [None, "x", None]
    assert cells(repair.null_outside(longs(spark, 1, 5, 9), "c", 2, None)) == [None, 5, 9]
    assert cells(repair.zero_negatives(longs(spark, -1, 0, 3, None), "c")) == [0, 0, 3, None]
    assert cells(repair.null_bad_addresses(texts(spark, "a@b.c", "a.b@c", None), "c")) == ["a@b.c", None, None]


def test_date_repairs(spark):
    data = texts(spark, "2024/01/05", "Jan 6, 2024", "x", None, "2024-02-30")
    assert cells(repair.standardize_dates(data, "c")) == ["2024-01-05", "2024-01-06", None, None, None]
    assert cells(repair.text_to_date(texts(spark, "2024-1-5", "x"), "c")) == [dt.date(2024, 1, 5), None]
    assert cells(repair.drop_bad_dates(data, "c")) == [dt.date(2024, 1, 5), dt.date(2024, 1, 6)]
    assert cells(repair.drop_future(texts(spark, "2024-01-01", "2025-01-01", "x"), "c", "2024-06-01")) == ["2024-01-01", "x"]


def test_flags(spark):
    flagged = repair.flag_mismatch(texts(spark, "12", "x", None), "c", r"\d+$")
    assert cells(flagged, "needs_review") == [False, True, False]
    assert cells(repair.flag_outliers(longs(spark, 1, 2, 3, 2, 99), "c"), "needs_review") == [False] * 4 + [True]


def test_row_repairs(spark):
    assert cells(repair.drop_missing(texts(spark, "a", None, ""), ["c"])) == ["a", ""]
    assert cells(repair.keep_between(longs(spark, 1, 5, None), "c", 2, 9)) == [5]
    assert cells(repair.drop_bad_phones(texts(spark, "+1 (555) 0101", "12345", "555-INVALID", None), "c")) == ["+1 (555) 0101"]
    assert cells(repair.drop_placeholders(texts(spark, "TODO", "todo", "x", None), "c", ["TODO"])) == ["x", None]
    assert cells(repair.keep_allowed(texts(spark, "a", "b", None), "c", ["a"])) == ["a"]
    assert cells(repair.drop_negative(longs(spark, -1, 0, None), "c")) == [0]
    assert cells(repair.drop_outliers(longs(spark, 1, 2, 3, 2, 99), "c")) == [1, 2, 3, 2]
    assert cells(repair.keep_domains(texts(spark, "a@x.com", "b@y.com", "c"), "c", ["x.com"])) == ["a@x.com"]
    data = frame(spark, [("a", 1), ("a", 1), ("a", 2)], "c STRING, d BIGINT")
    assert cells(repair.drop_repeated_rows(data, ["rk"], ["c", "d"]), "rk") == [0, 2]
    assert cells(repair.keep_first(data, ["c"], ["rk"]), "rk") == [0]


def test_value_repairs(spark):
    assert cells(repair.replace_known(texts(spark, " a@@b ", "x-at-y", None), "c", {"@@": "@", "-at-": "@"})) == ["a@b", "x@y", None]
    assert cells(repair.replace_values(texts(spark, "a", "b", None), "c", {"a": "A"})) == ["A", "b", None]
    twice = spark.createDataFrame([("a", "B"), ("a", "A")], "wrong STRING, right STRING")
    assert cells(repair.replace_values(texts(spark, "a", "b"), "c", twice)) == ["A", "b"]
    values = longs(spark, *range(1, 100), 10**6)
    top = cells(repair.cap_above(values, "c", 0.99))[-1]
    assert top == pytest.approx(99 + 0.01 * (10**6 - 99))
    assert cells(repair.cap_above(values, "c", 0.5, only_above=100))[98] == 99
    assert cells(repair.impute_outside(longs(spark, 1, 20, 30, 400), "c", 18, 100)) == [25, 20, 30, 25]


def test_user_fix(spark):
    data = texts(spark, "a")
    fixed, why = repair.apply_user_fix(data, lambda d: d.withColumn("c", F.upper("c")))
    assert cells(fixed) == ["A"] and why is None
    for fix in (lambda d: d.select("nope"), lambda d: d.withColumn("c", F.raise_error(F.lit("bad row")))):
        same, why = repair.apply_user_fix(data, fix)
        assert cells(same) == ["a"] and why


PEOPLE = [
    ("Alice", "a@b.com", 25),
    (None, "bad", 30),
    ("Charlie", "c@d.com", 150),
    (None, "e@f.com", -5),
    ("Eve", None, 45),
]


@pytest.fixture
def people(spark):
    return frame(spark, PEOPLE, "name STRING, email STRING, age BIGINT")


def test_loop_stops_when_all_rules_pass(people):
    done = run_loop(people, [Rule("R", "rk", "not_null")], ["rk"])
    assert done.status == "completed"
    assert [(r["iteration"], r["status"]) for r in done.iterations.collect()] == [(1, "all_passed")]
    assert done.attempts.count() == done.analyses.count() == 0


def test_loop_repairs(people):
    rules = [Rule("R1", "name", "not_null", "high"), Rule("R2", "age", "range", params={"min": 0, "max": 120})]
    done = run_loop(people, rules, ["rk"])
    assert done.status == "completed"
    steps = [(r["iteration"], r["total_failures"], r["fixes_applied"], r["status"]) for r in done.iterations.orderBy("iteration").collect()]
    # The rows without a name go first, so one age is left to repair.
    assert steps == [(1, 4, 2, "fixes_applied"), (2, 0, 0, "all_passed")]
    tried = [(r["rule_id"], r["fix"], r["changed_rows"]) for r in done.attempts.collect()]
    assert tried == [("R1", "drop_missing", 2), ("R2", "null_outside", 1)]
    assert [tuple(r) for r in done.final.select("name", "age").orderBy("rk").collect()] == [("Alice", 25), ("Charlie", None), ("Eve", 45)]
    gain = done.improvement().first()
    assert (gain["initial_failures"], gain["final_failures"], gain["reduction_pct"]) == (4, 0, 100.0)
    assert done.analyses.count() == 2


def test_specific_repairs(people):
    done = run_loop(people, [Rule("R1", "name", "not_null")], ["rk"], prefer="typed")
    assert cells(done.final, "name") == ["Alice", "Alice", "Charlie", "Alice", "Eve"]


def test_specific_repair_when_the_general_one_has_no_effect(spark):
    data = texts(spark, "a", " ", "a", "")  # blanks fail, but there is no null to drop
    done = run_loop(data, [Rule("R1", "c", "not_null")], ["rk"])
    assert cells(done.final) == ["a", "a", "a", "a"]
    assert done.attempts.first()["fix"] == "fill_missing"


def test_loop_stalls_on_review_rules(people):
    done = run_loop(people, [Rule("R1", "name", "regex", params={"pattern": "^[A-E]$"})], ["rk"])
    assert done.status == "stalled"
    attempt = done.attempts.first()
    assert (attempt["fix"], attempt["success"], attempt["needs_review"]) == ("none", False, True)


def test_last_round_is_validated(people):
    rules = [Rule("R1", "email", "email"), Rule("R2", "email", "not_null"),
             Rule("R3", "age", "positive", params={"allow_zero": True})]
    done = run_loop(people, rules, ["rk"], max_iterations=1)
    steps = [(r["iteration"], r["status"]) for r in done.iterations.orderBy("iteration").collect()]
    assert steps == [(1, "fixes_applied"), (2, "all_passed")] and done.status == "completed"
    short = run_loop(people, [Rule("R1", "age", "business_rule", params={"expression": "age > 0"}), rules[0]], ["rk"], max_iterations=1)
    assert short.status == "max_reached"
    assert [r["status"] for r in short.iterations.orderBy("iteration").collect()] == ["fixes_applied", "failures_remain"]


def test_round_with_every_kind_of_repair(spark):
    data = frame(
        spark,
        [(1, "x@y.com", "2024-01-01", "todo", 5.0), (1, "x@y", "2024/01/02", "ok", -2.0), (2, "bad", "x", "ok", 500.0),
         (2, "bad", "x", "ok", 500.0), (3, None, None, None, None)],
        "k BIGINT, mail STRING, day STRING, note STRING, x DOUBLE",
    )
    rules = [
        Rule("R1", "_all", "duplicate_row", params={"columns": ["k", "mail", "day", "note", "x"]}),
        Rule("R2", "k", "unique"),
        Rule("R3", "mail", "email"),
        Rule("R4", "day", "date"),
        Rule("R5", "note", "placeholder"),
        Rule("R6", "x", "positive"),
        Rule("R7", "x", "range", params={"min": 0, "max": 100}),
        Rule("R8", "nope", "not_null"),
    ]
    repaired, attempts = loop.repair_round(data, rules, ["rk"])
    assert {a["rule"].id: a["changed_rows"] for a in attempts} == {"R1": 1, "R2": 1, "R3": 1, "R4": 1, "R5": 1, "R6": 0, "R7": 1}
    rows = [tuple(r) for r in repaired.orderBy("rk").select("k", "mail", "day", "note", "x").collect()]
    assert rows == [(1, "x@y.com", dt.date(2024, 1, 1), None, 5.0), (2, None, None, "ok", None), (3, None, None, None, None)]


def test_reports(spark):
    data = texts(spark, *["bad"] * 15, "a@b.com", None)
    rules = [Rule("R1", "c", "email", "low"), Rule("R2", "c", "not_null", "high"), Rule("R3", "c", "max_length")]
    run = validate(data, rules, key=["rk"])
    problems = {r["id"]: r for r in problem_report(run.rule_results, run.violations).collect()}
    assert sorted(problems) == ["P001", "P002"]
    assert [k["rk"] for k in problems["P001"]["affected"]] == list(range(10))
    assert problems["P001"]["sample_values"] == ["bad"] * 3
    assert sample_per_rule(run.violations, 4).count() == 5
    done = run_loop(data, rules, ["rk"])
    solutions = solution_report(done.analyses)
    assert [r["id"] for r in solutions.orderBy("id").collect()][:2] == ["S001", "S002"]
    stats = report_statistics(problem_report(run.rule_results, run.violations), solutions).first()
    assert (stats["total_problems"], stats["high_severity"], stats["low_severity"]) == (2, 1, 1)


def test_equal_rules_keep_their_places(spark):
    from plumbline import Rule

    data = spark.createDataFrame([(1, None), (2, "x")], "k INT, c STRING")
    done = run_loop(data, [Rule("R", "c", "not_null")] * 3, row_key=["k"], max_iterations=1)
    assert sorted(r["position"] for r in done.attempts.collect()) == [0, 1, 2]
