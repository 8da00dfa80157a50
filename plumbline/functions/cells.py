"""How one cell is read: missing or present, as a number, as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Any character that is not white space (Unicode white space plus the four ASCII separators).
_NON_BLANK = r"[^\x1c-\x1f\p{IsWhite_Space}]"

# Fixed value: the characters that count as white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Shape of a number in text. Spark's own cast also takes '10d' and '10f', so the shape comes first.
_NUMBER = (
    r"\A[ \t-\r]*[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
    r"|(?i:inf|infinity))[ \t-\r]*\z"
)


def is_string(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def is_date(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def clean(c: Column, dtype: T.DataType) -> Column:
    """NaN becomes null, so that it counts as missing and stays out of comparisons."""
    return F.nanvl(c, F.lit(None).cast(dtype)) if is_float(dtype) else c


def missing(c: Column, dtype: T.DataType) -> Column:
    """Null or NaN; blank text is not missing here."""
    return (c.isNull() | F.isnan(c)) if is_float(dtype) else c.isNull()


def present(c: Column, dtype: T.DataType) -> Column:
    """Not null, not NaN and, for text, not blank. Never null itself."""
    if not is_string(dtype):
        return ~missing(c, dtype)
    # Text that starts with a printable ASCII character is settled by comparing one byte;
    # only the rest is decoded for the pattern.
    ascii_start = (c >= F.lit("!")) & (c < F.lit("\x7f"))
    return F.coalesce(ascii_start | c.rlike(_NON_BLANK), F.lit(False))


def number(c: Column, dtype: T.DataType) -> Column:
    """The cell as a number; text that is not a number becomes null."""
    if is_float(dtype):
        return clean(c, dtype)
    if is_numeric(dtype):
        return c
    if isinstance(dtype, T.BooleanType):
        return c.cast("int")
    if is_string(dtype):
        return F.when(c.rlike(_NUMBER), c.try_cast("double"))
    return F.lit(None).cast("double")


def double(c: Column, dtype: T.DataType) -> Column:
    return number(c, dtype).cast("double")


def text(c: Column, dtype: T.DataType) -> Column:
    """The cell as text, with floats and booleans written as Python writes them."""
    if is_string(dtype):
        return c
    if isinstance(dtype, T.BooleanType):
        return F.initcap(c.cast("string"))
    if is_float(dtype):
        return _float_text(clean(c, dtype))
    return c.cast("string")


def _float_text(c: Column) -> Column:
    raw = c.cast("string")
    size = F.abs(c)
    plain = F.regexp_replace(raw.try_cast("decimal(38,22)").cast("string"), r"(\.[0-9]+?)0+$", "$1")
    short = F.regexp_replace(raw, r"\.0E", "E")
    signed = F.regexp_replace(short, r"E([0-9])", "e+$1")
    scientific = F.regexp_replace(F.regexp_replace(signed, r"E-", "e-"), r"e([+-])([0-9])$", "e$10$2")
    return (
        F.when((size >= 1e-3) & (size < 1e7), raw)
        .when(size == 0, raw)
        .when(size == float("inf"), F.when(c > 0, F.lit("inf")).otherwise(F.lit("-inf")))
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(scientific)
    )


def strip(c: Column) -> Column:
    """Text without white space at either end (all Unicode white space, not only U+0020)."""
    # Text between two printable ASCII characters, which is nearly all text, is left as it is.
    tight = (c >= F.lit("!")) & (c < F.lit("\x7f")) & F.right(c, F.lit(1)).between("!", "~")
    return F.when(tight, c).otherwise(F.btrim(c, F.lit(WHITE_SPACE)))


def count_where(test: Column) -> Column:
    """How many rows pass a test, for aggregates with many such counts.

    `count_if` puts the tests of all counts into one projection, and some dozen of them make a method too
    large for the JVM to compile. Written like this, every count gets a generated method of its own.
    """
    return F.count(F.when(test, F.lit(1)))
