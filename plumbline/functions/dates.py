"""Strict date parsing by a strptime format, and lenient parsing over a list of formats."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.cells import is_date, is_string, strip

DEFAULT_FORMAT = "%Y-%m-%d"

# What each directive accepts.
_DIRECTIVES = {
    "Y": r"(?!0000)[0-9]{4}",
    "y": r"[0-9]{2}",
    "m": r"1[0-2]|0[1-9]|[1-9]",
    "d": r"3[01]|[12][0-9]|0[1-9]|[1-9]| [1-9]",
    "j": r"36[0-6]|3[0-5][0-9]|[12][0-9]{2}|0[1-9][0-9]|00[1-9]|[1-9][0-9]|0[1-9]|[1-9]",
    "H": r"2[0-3]|[01][0-9]|[0-9]",
    "I": r"1[0-2]|0[1-9]|[1-9]",
    "M": r"[0-5][0-9]|[0-9]",
    "S": r"6[01]|[0-5][0-9]|[0-9]",
    "f": r"[0-9]{1,6}",
    "p": r"(?i:am|pm)",
    "b": r"(?i:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)",
    "B": r"(?i:january|february|march|april|may|june|july|august|september|october|november|december)",
    "a": r"(?i:mon|tue|wed|thu|fri|sat|sun)",
    "A": r"(?i:monday|tuesday|wednesday|thursday|friday|saturday|sunday)",
}
_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_TIME = set("HIMSfp")


class FormatError(ValueError):
    """The format has a directive that is not supported."""


def _shape(fmt: str) -> tuple[str, list[str]]:
    """The format as an anchored pattern with one group per directive, and the directives."""
    pattern, groups, i = [], [], 0
    while i < len(fmt):
        if fmt[i] == "%":
            d = fmt[i + 1 : i + 2]
            i += 2
            if d == "%":
                pattern.append("%")
                continue
            if d not in _DIRECTIVES:
                raise FormatError(f"Unsupported date directive: %{d}")
            if d in groups:
                raise FormatError(f"Date directive %{d} is used twice")
            pattern.append(f"({_DIRECTIVES[d]})")
            groups.append(d)
        elif fmt[i].isspace():
            pattern.append(r"\s+")
            while i < len(fmt) and fmt[i].isspace():
                i += 1
        else:
            pattern.append(re.escape(fmt[i]) if not fmt[i].isalnum() else fmt[i])
            i += 1
    return r"\A" + "".join(pattern) + r"\z", groups


def has_time(fmt: str) -> bool:
    return any(d in _TIME for d in re.findall(r"%(.)", fmt))


def parse(c: Column, dtype: T.DataType, fmt: str = DEFAULT_FORMAT) -> Column:
    """The cell as DATE (TIMESTAMP_NTZ when the format has a time part); null when it does not parse.

    Typed dates and timestamps are valid as they are.
    """
    shape, groups = _shape(fmt)
    if is_date(dtype):
        return c.cast("timestamp_ntz") if has_time(fmt) else c.cast("date")
    value = strip(c if is_string(dtype) else c.cast("string"))
    if sorted(groups) == ["Y", "d", "m"]:
        # The common case: put into ISO order by one replacement, unless it already is.
        iso = "-".join(f"${groups.index(d) + 1}" for d in "Ymd")
        ordered = value if fmt == DEFAULT_FORMAT else F.regexp_replace(value, shape, iso)
        return F.when(value.rlike(shape), ordered.try_cast("date"))

    def part(d: str, default: str) -> Column:
        if d not in groups:
            return F.lit(default)
        return F.trim(F.regexp_extract(value, shape, groups.index(d) + 1))

    if "Y" in groups:
        year = part("Y", "1900")
    elif "y" in groups:
        year = F.concat(F.when(part("y", "00") >= "69", "19").otherwise("20"), part("y", "00"))
    else:
        year = F.lit("1900")
    if "m" in groups:
        month = part("m", "1")
    elif "b" in groups or "B" in groups:
        name = F.lower(F.substring(part("b" if "b" in groups else "B", ""), 1, 3))
        month = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), name).cast("string")
    else:
        month = F.lit("1")
    if "j" in groups:
        day = F.date_add(F.concat(year, F.lit("-01-01")).try_cast("date"), part("j", "1").try_cast("int") - 1)
    else:
        day = F.concat_ws("-", year, month, part("d", "1")).try_cast("date")
    if not has_time(fmt):
        return F.when(value.rlike(shape), day)
    hour = part("H", "0").try_cast("int")
    if "I" in groups:
        hour = part("I", "12").try_cast("int") % 12
        if "p" in groups:
            hour = hour + F.when(F.lower(part("p", "am")) == "pm", 12).otherwise(0)
    # Second 60 and 61 pass the shape but make no time of day, so the cast below rejects them.
    second = F.concat_ws(".", part("S", "0"), F.rpad(part("f", "0"), 6, "0"))
    clock = F.concat_ws(":", hour.cast("string"), part("M", "0"), second)
    return F.when(value.rlike(shape), F.concat_ws(" ", day.cast("string"), clock).try_cast("timestamp_ntz"))


# Formats tried in turn by the lenient parser.
LENIENT_FORMATS = (
    "%Y-%m-%d",
    "%Y/%m/%d",
    "%Y.%m.%d",
    "%Y%m%d",
    "%m/%d/%Y",
    "%m-%d-%Y",
    "%d.%m.%Y",
    "%d %b %Y",
    "%d %B %Y",
    "%b %d, %Y",
    "%B %d, %Y",
    "%Y-%m-%d %H:%M:%S",
    "%Y-%m-%dT%H:%M:%S",
)


def parse_lenient(c: Column, dtype: T.DataType, formats: tuple[str, ...] = LENIENT_FORMATS) -> Column:
    """The cell as DATE by the first format that fits."""
    if is_date(dtype):
        return c.cast("date")
    first, *rest = [lambda v, f=f: parse(v, dtype, f).cast("date") for f in formats]
    if not rest:
        return first(c)
    # The other formats stand in a lambda. It is not compiled, so a dozen of them do not push a whole
    # stage over the size limit of generated code; values in the first format never get there.
    others = F.transform(F.array(c), lambda v: F.coalesce(*[p(v) for p in rest]))
    return F.coalesce(first(c), F.get(others, F.lit(0)))
