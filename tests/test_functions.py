"""Reading single cells: presence, numbers, text, patterns, dates, salvaged JSON, e-mail verdicts."""

from __future__ import annotations

import datetime as dt
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import cells, dates, mailbox, salvage
from plumbline.functions.patterns import PatternError, match_start, to_spark

S, D = T.StringType(), T.DoubleType()


def column(spark, values, ddl, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, c {ddl}")
    return [r["x"] for r in df.select("i", build(F.col("c")).alias("x")).orderBy("i").collect()]


def test_present(spark):
    values = ["a", " a ", "", "  ", "\t\n", " ", "　", "\x1c", None, "é", "\x7f", " x"]
    expected = [v is not None and v.strip() != "" for v in values]
    assert column(spark, values, "STRING", lambda c: cells.present(c, S)) == expected
    assert column(spark, [1.0, float("nan"), None], "DOUBLE", lambda c: cells.present(c, D)) == [True, False, False]


def test_number(spark):
    values = ["1", " 12 ", "1e3", "-.5", "5.", "+7", "inf", "-Infinity", "10d", "10f", "1,000", "abc", "", "nan", None, "0x1", "1e", "1_0"]
    expected = [1, 12, 1000, -0.5, 5, 7, float("inf"), float("-inf")] + [None] * 10
    assert column(spark, values, "STRING", lambda c: cells.number(c, S)) == expected
    assert column(spark, [True, False, None], "BOOLEAN", lambda c: cells.number(c, T.BooleanType())) == [1, 0, None]
    assert column(spark, [1.5, float("nan")], "DOUBLE", lambda c: cells.number(c, D)) == [1.5, None]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, allow_subnormal=False), min_size=1, max_size=50))
def test_float_text_is_pythons(spark, values):
    values = [float(f"{v:.14g}") for v in values]  # Java writes some longer numbers with a digit too many
    assert column(spark, values, "DOUBLE", lambda c: cells.text(c, D)) == [str(v) for v in values]


def test_other_text(spark):
    assert column(spark, [True, None], "BOOLEAN", lambda c: cells.text(c, T.BooleanType())) == ["True", None]
    assert column(spark, [12], "BIGINT", lambda c: cells.text(c, T.LongType())) == ["12"]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet=" \t\n\x1c\x85\xa0　​ab.é", max_size=8), min_size=1, max_size=40))
def test_strip_and_present_are_pythons(spark, values):
    assert column(spark, values, "STRING", cells.strip) == [v.strip() for v in values]
    assert column(spark, values, "STRING", lambda c: cells.present(c, S)) == [v.strip() != "" for v in values]


PATTERNS = [
    r"^\d+$", r"[A-Z]{2}", r"(?P<x>a)(?P=x)", r"a\Z", r"[^\d\s]+$", r"[]a]+$", r"[[]x", r"a{,2}b", r"a{b", r"(?i)ab",
    r"\w+@\w+\.\w+", r"[&&a]+$", r"(?a)\d+$", r"a|b$", r"^[\d\+\-\(\)\s]+$", r"x*", r".+$",
]
SUBJECTS = ["12", "AB", "aa", "ab", "a", "x y", "]a", "[x", "aab", "a{b", "AB1", "me@ex.org", "&&a", "٣", "b", "", "12\n",
            "12\r", "a\nb", "+1 (2)-3", "[a", "^a"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_match_start_is_pythons(spark, pattern):
    expected = [re.match(pattern, s) is not None for s in SUBJECTS]
    assert column(spark, SUBJECTS, "STRING", lambda c: match_start(c, pattern)) == expected


@pytest.mark.parametrize("pattern", ["[unclosed", "a**", "(", r"(a)(?(1)b|c)", r"(?<=a+)b"])
def test_bad_patterns(spark, pattern):
    with pytest.raises(PatternError):
        to_spark(pattern)


DATES = ["2024-01-15", "2024-1-5", "0000-01-01", "2024-13-45", "2024-02-30", "2024-02-29", "2024/08/30", " 2024-05-01 ",
         "20240115", "2024115", "12024-01-01", "2024-001-05", "01/02/2024", "Jan 5, 2024", "5 March 2021", "05 mar 99",
         "2024-05-06 07:08:09", "69", "68", "2024-060", "2023-366", "07:08 PM", "12:30 AM", "2024-1-5x", "", "100%",
         "2024-05-06 07:08:09.5"]
FORMATS = ["%Y-%m-%d", "%Y/%m/%d", "%m/%d/%Y", "%b %d, %Y", "%d %B %Y", "%d %b %y", "%Y-%m-%d %H:%M:%S", "%y", "%Y-%j",
           "%I:%M %p", "%Y%m%d", "100%%", "%Y-%m-%d %H:%M:%S.%f"]


@pytest.mark.parametrize("fmt", FORMATS)
def test_parse_is_strptime(spark, fmt):
    def python(text):
        try:
            parsed = dt.datetime.strptime(text.strip(), fmt)
        except ValueError:
            return None
        return parsed if dates.has_time(fmt) else parsed.date()

    assert column(spark, DATES, "STRING", lambda c: dates.parse(c, S, fmt)) == [python(d) for d in DATES]


def test_typed_dates_are_valid(spark):
    days = [dt.date(2024, 1, 2), None]
    assert column(spark, days, "DATE", lambda c: dates.parse(c, T.DateType(), "%d/%m/%Y")) == days
    with pytest.raises(dates.FormatError):
        dates.parse(F.col("c"), S, "%Y %z")
    with pytest.raises(dates.FormatError):
        dates.parse(F.col("c"), S, "%Y %Y")


def test_lenient_dates(spark):
    found = column(spark, ["2024/8/30", "03/04/2024", "Jan 5, 2024", "2024-05-06T07:08:09", "x", None], "STRING",
                   lambda c: dates.parse_lenient(c, S))
    assert [str(d) for d in found] == ["2024-08-30", "2024-03-04", "2024-01-05", "2024-05-06", "None", "None"]


def salvage_one(spark, text):
    texts = spark.createDataFrame([(text,)], "t STRING")
    found = salvage.with_analysis(texts, "t", "a", F.lit("name"), F.lit("not_null"), F.lit("high"), F.lit(2)).first()["a"]
    return found.asDict() if found is not None else None


def test_salvage_clean_and_defaults(spark):
    found = salvage_one(spark, '{"root_cause": "cause", "confidence": 90, "severity": "low", "estimated_affected_rows": 7}')
    assert (found["root_cause"], found["confidence"], found["severity"], found["estimated_affected_rows"]) == (
        "cause", 90, "low", 7)
    found = salvage_one(spark, "{}")
    assert found["root_cause"] == salvage.DEFAULT_ROOT_CAUSE and found["explanation"] == "{}"
    assert (found["confidence"], found["severity"], found["estimated_affected_rows"]) == (70, "high", 2)
    assert found["sql_fix"] == "-- Fix for name not_null" and found["code_fix"] == "# Fix for name"


@pytest.mark.parametrize(
    "text",
    [
        '```json\n{"root_cause": "x"}\n```',
        '```{"root_cause": "x"}```',
        'Sure:\n{"root_cause": "x", "list": [1, 2,],}\nBye',
        '  {"root_cause": "x"}  ',
    ],
)
def test_salvage_repairs(spark, text):
    assert salvage_one(spark, text)["root_cause"] == "x"


def test_salvage_raw_line_break_and_clamp(spark):
    assert salvage_one(spark, '{"root_cause": "a\nb", "confidence": 900}')["root_cause"] == "a b"
    assert salvage_one(spark, '{"confidence": 900}')["confidence"] == 100
    assert salvage_one(spark, '{"confidence": -4}')["confidence"] == 0


@pytest.mark.parametrize("text", ["no object", "", None, "[1, 2]", "{broken", "} {"])
def test_salvage_nothing(spark, text):
    assert salvage_one(spark, text) is None


def test_email_verdicts(spark):
    found = column(spark, ["a@b.com", "a@b", "none", "", None], "STRING", mailbox.verify_email)
    assert [(r["is_valid"], r["api_status"], r["confidence"]) for r in found] == [
        (True, "unavailable", 60), (False, "unavailable", 40), (False, "skipped", 100), (False, "skipped", 100),
        (False, "skipped", 100),
    ]
