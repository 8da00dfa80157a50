"""Patterns written in Python's regular-expression dialect, run by Spark's."""

from __future__ import annotations

import re
from functools import lru_cache

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


class PatternError(ValueError):
    """The pattern is invalid, or uses something Spark's dialect cannot express."""


def to_spark(pattern: str) -> str:
    """Rewrite the few constructs that the two dialects spell differently."""
    try:
        re.compile(pattern)
    except re.error as e:
        raise PatternError(f"Invalid regex: {e}") from None
    if re.search(r"\(\?\(", pattern):
        raise PatternError("Invalid regex: conditional groups are not supported")
    out, in_class, class_empty, i = [], False, False, 0
    while i < len(pattern):
        pair = pattern[i : i + 2]
        if pair[0] == "\\":
            out.append(r"\z" if pair == r"\Z" and not in_class else pair)
            class_empty = False
            i += 2
            continue
        if in_class:
            if pair[0] == "]" and not class_empty:
                in_class = False
                out.append("]")
            else:
                out.append("\\" + pair[0] if pair[0] in "[]&^" else pair[0])
            class_empty = False
            i += 1
            continue
        if pair[0] == "[":
            in_class, class_empty = True, True
            negated = pattern[i + 1 : i + 2] == "^"
            out.append("[^" if negated else "[")
            i += 2 if negated else 1
            continue
        if pattern.startswith("(?P<", i):
            out.append("(?<")
            i += 4
            continue
        if pattern.startswith("(?P=", i):
            end = pattern.index(")", i)
            out.append(rf"\k<{pattern[i + 4 : end]}>")
            i = end + 1
            continue
        if pair[0] == "{":
            # A brace that opens no repetition is a plain character; an absent minimum is 0.
            counted = re.match(r"\{(\d*)(,?)(\d*)\}", pattern[i:])
            if counted and (counted[1] or counted[3]):
                out.append(f"{{{counted[1] or 0}{counted[2]}{counted[3]}}}")
                i += counted.end()
                continue
            out.append(r"\{")
            i += 1
            continue
        out.append(pair[0])
        i += 1
    return re.sub(r"\A\(\?([a-zA-Z]+)\)", _inline_flags, "".join(out))


def _inline_flags(m: re.Match) -> str:
    kept = "".join(f for f in m.group(1) if f in "imsx")
    ascii_only = "a" in m.group(1)
    return f"(?{kept}{'-U' if ascii_only else ''})" if kept or ascii_only else ""


@lru_cache(maxsize=1000)
def _anchored(pattern: str) -> str:
    """The pattern in Spark's dialect, anchored at the start, after a try on one empty text."""
    anchored = rf"(?dU)\A(?:{to_spark(pattern)})"
    try:
        # A projection of a literal row is folded away: no job runs.
        SparkSession.active().sql("SELECT ''").select(F.lit("").rlike(anchored)).collect()
    except (PySparkException, Py4JError) as e:
        raise PatternError(f"Invalid regex: {str(e).splitlines()[0]}") from None
    return anchored


def match_start(c: Column, pattern: str) -> Column:
    """True where the pattern matches from the first character on (not necessarily to the last)."""
    return c.rlike(_anchored(pattern))
