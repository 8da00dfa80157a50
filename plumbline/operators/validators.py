"""The rule types. Each one turns a rule into a check on columns, keys or groups."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import cells, dates
from plumbline.functions.cells import is_numeric, is_string
from plumbline.functions.patterns import PatternError, match_start
from plumbline.operators.group_rules import MEASURES, Measure, levels_of, summable
from plumbline.operators.references import common_type
from plumbline.plans.checks import (
    NO_VALUE,
    Broken,
    Check,
    GroupCheck,
    GroupOutlierCheck,
    Message,
    ReferenceCheck,
    RepeatCheck,
    RowCheck,
    SequenceCheck,
    ShareCheck,
    Skipped,
    Value,
    data_columns,
)
from plumbline.plans.rules import Rule

# ---- fixed values ----------------------------------------------------------------------------
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PHONE_PATTERN = r"^\+\d{1,3}-\d{3}-\d{4}$"
CUSTOMER_ID_PATTERN = r"^\d+$"
PLACEHOLDERS = ("N/A", "NA", "null", "none", "TODO", "TBD", "XXX", "test", "dummy", "placeholder", "-", ".")
CURRENCIES = ("USD", "EUR", "GBP", "JPY", "CAD", "AUD", "INR", "CNY")
COUNTRIES = (
    "US", "UK", "CA", "AU", "DE", "FR", "JP", "CN", "IN", "BR", "MX",
    "IT", "ES", "NL", "SE", "NO", "DK", "FI", "CH", "AT", "BE", "IE",
    "NZ", "SG", "KR", "ZA", "RU", "AR", "CL", "CO",
)
ZERO_TOLERANCE = -0.0001
OUTLIER_PROBS = (0.25, 0.75)

# Lists longer than this are joined instead of being written into the expression.
INLINE_LIST = 500
BROADCAST_BYTES = 8 << 20


class Shared:
    """Parsed forms of text columns that several predicates use, each computed once per row.

    They become columns of a projection below the predicates. Its code is one method, so there is a limit;
    what is beyond it is parsed where it is used.
    """

    LIMIT = 10

    def __init__(self):
        self.columns: dict[str, Column] = {}
        self._names: dict[tuple, str] = {}

    def use(self, key: tuple, build: Callable[[], Column]) -> Column:
        if key not in self._names:
            if len(self._names) >= self.LIMIT:
                return build()
            name = f"__shared_{len(self._names)}_{uuid.uuid4().hex}"
            self._names[key] = name
            self.columns[name] = build()
        return F.col(self._names[key])


@dataclass
class Target:
    """A rule together with what it is bound to."""

    rule: Rule
    schema: T.StructType
    as_of: Column
    # Quartiles by column, filled in before the checks are built.
    quartiles: dict[str, list[float | None]] = field(default_factory=dict)
    shared: Shared = field(default_factory=Shared)
    # The tables that `reference` rules may name.
    tables: Mapping[str, DataFrame] = field(default_factory=dict)

    def param(self, name: str, default: Any = None) -> Any:
        return self.rule.params.get(name, default)

    def has(self, name: str) -> bool:
        return name in self.schema.names

    def col(self, name: str | None = None) -> Column:
        return F.col(f"`{name or self.rule.column}`")

    def dtype(self, name: str | None = None) -> T.DataType:
        return self.schema[name or self.rule.column].dataType

    def present(self, name: str | None = None) -> Column:
        return cells.present(self.col(name), self.dtype(name))

    def number(self, name: str | None = None) -> Column:
        dtype = self.dtype(name)
        if not is_string(dtype):
            return cells.number(self.col(name), dtype)
        return self.shared.use(("number", name or self.rule.column), lambda: cells.number(self.col(name), dtype))

    def text(self, name: str | None = None) -> Column:
        return cells.text(self.col(name), self.dtype(name))

    def value(self, name: str | None = None) -> Value:
        dtype = self.dtype(name)
        if cells.is_float(dtype):
            return Value(lambda: cells.clean(self.col(name), dtype).cast("string"), is_float=True)
        return Value(lambda: self.text(name))

    def date(self, name: str | None = None) -> Column:
        fmt, dtype = self.param("format", dates.DEFAULT_FORMAT), self.dtype(name)
        if not is_string(dtype):
            return dates.parse(self.col(name), dtype, fmt)
        key = ("date", name or self.rule.column, fmt)
        return self.shared.use(key, lambda: dates.parse(self.col(name), dtype, fmt))

    def reason(self, ending: str) -> Message:
        """Row i: 'column' value 'v' <ending>"""
        return Message(f": '{self.rule.column}' value '", f"' {ending}")

    def row_check(self, fails: Column, ending: str, **extra) -> RowCheck:
        return RowCheck(F.coalesce(fails, F.lit(False)), self.value(), self.reason(ending), **extra)


VALIDATORS: dict[str, Callable[[Target], Check]] = {}

# These types look their columns up themselves, so an absent rule column is not an error up front.
_FINDS_OWN_COLUMNS = {"duplicate_row", "cross_field", "business_rule", "data_consistency", "date_order", "reference", "aggregate", "sequence"}


def _type(*names: str):
    def register(build: Callable[[Target], Check]):
        for name in names:
            VALIDATORS[name] = build
        return build

    return register


def bind(target: Target) -> Check:
    """The check for a rule; a rule that cannot run becomes `Broken`, never an exception."""
    rule = target.rule
    if rule.type not in _FINDS_OWN_COLUMNS and not target.has(rule.column):
        return Broken(f"Column '{rule.column}' not in dataset")
    build = VALIDATORS.get(rule.type)
    if build is None:
        return Broken(f"Unknown rule type: {rule.type}")
    try:
        return build(target)
    except (PatternError, dates.FormatError) as e:
        return Broken(str(e))
    except (KeyError, TypeError, ValueError) as e:
        return Broken(f"Validator error: {e}")


# ---- missing and repeated values -------------------------------------------------------------


@_type("not_null")
def _not_null(t: Target) -> Check:
    return RowCheck(
        ~t.present(), t.value(),
        Message(f": '{t.rule.column}' is null or empty"),
    )


@_type("missing_threshold")
def _missing_threshold(t: Target) -> Check:
    return ShareCheck(
        cells.missing(t.col(), t.dtype()), t.value(), float(t.param("max_null_pct", 20.0)), t.rule.column
    )


@_type("unique")
def _unique(t: Target) -> Check:
    if isinstance(t.dtype(), T.MapType):
        return Broken(f"Column '{t.rule.column}' is a map and cannot be compared")
    return RepeatCheck((t.rule.column,), t.value(), t.reason("is duplicated"))


@_type("duplicate_row")
def _duplicate_row(t: Target) -> Check:
    keys = tuple(t.param("columns") or data_columns(t.schema.names))
    for k in keys:
        if not t.has(k):
            return Broken(f"Column '{k}' not in dataset")
        if isinstance(t.dtype(k), T.MapType):
            return Broken(f"Column '{k}' is a map and cannot be compared")
    return RepeatCheck(keys, NO_VALUE, Message(": Entire row is a duplicate"))


# ---- numbers ---------------------------------------------------------------------------------


def outside(n: Column, low: Any, high: Any) -> Column:
    """Below the lower or above the upper bound; an absent or infinite bound is no bound."""
    tests = []
    if low is not None and float(low) != float("-inf"):
        tests.append(n < F.lit(low))
    if high is not None and float(high) != float("inf"):
        tests.append(n > F.lit(high))
    if not tests:
        return F.lit(False)
    return tests[0] if len(tests) == 1 else tests[0] | tests[1]


def _show(bound: Any, infinite: str) -> str:
    return infinite if bound is None else str(bound)


# type -> (lower, upper, what the message calls the interval)
_BOUNDS = {
    "range": (None, None, "outside"),
    "age": (0, 120, "outside"),
    "salary": (0, 10000000, "outside salary range"),
}


@_type("range", "age", "salary")
def _range(t: Target) -> Check:
    low, high, words = _BOUNDS[t.rule.type]
    low, high = t.param("min", low), t.param("max", high)
    ending = f"{words} [{_show(low, '-inf')}, {_show(high, 'inf')}]"
    return t.row_check(outside(t.number(), low, high), ending)


@_type("transaction_amount")
def _transaction_amount(t: Target) -> Check:
    n = t.number()
    bad = n.isNull() | outside(n, t.param("min", 0.01), t.param("max"))
    return t.row_check(t.present() & bad, "invalid transaction amount")


@_type("numeric")
def _numeric(t: Target) -> Check:
    return t.row_check(t.present() & t.number().isNull(), "is not numeric")


@_type("positive")
def _positive(t: Target) -> Check:
    floor = ZERO_TOLERANCE if t.param("allow_zero", False) else 0
    return t.row_check(t.number() <= F.lit(floor), "is not positive")


def outlier_bounds(quartiles: list[float | None], factor: float) -> tuple[float, float] | None:
    q1, q3 = quartiles
    if q1 is None or q3 is None:
        return None
    return q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)


@_type("outlier")
def _outlier(t: Target) -> Check:
    """With a parameter `by` the quartiles are those of the row's own group."""
    if t.param("by"):
        by = _groupable(t, t.param("by"))
        return by if isinstance(by, Broken) else GroupOutlierCheck(by, t.number().cast("double"), float(t.param("factor", 1.5)), t.value(), t.reason("is an outlier of its group"))
    bounds = outlier_bounds(t.quartiles.get(t.rule.column, [None, None]), float(t.param("factor", 1.5)))
    if bounds is None:
        return t.row_check(F.lit(False), "is an outlier")
    low, high = bounds
    ending = f"is an outlier (IQR bounds: [{low:.1f}, {high:.1f}])"
    n = t.number().cast("double")
    return t.row_check((n < F.lit(low)) | (n > F.lit(high)), ending)


_OPERATORS: dict[str, Callable[[Column, Column], Column]] = {
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
    ">=": lambda a, b: a >= b,
    "<=": lambda a, b: a <= b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
}


@_type("cross_field")
def _cross_field(t: Target) -> Check:
    left, right = t.param("column_a", t.rule.column), t.param("column_b", "")
    op = t.param("operator", ">")
    for name in (left, right):
        if not t.has(name):
            return Skipped(f"Column '{name}' not in dataset")
    if op not in _OPERATORS:
        return Broken(f"Unknown operator: {op}")
    a, b = t.number(left), t.number(right)
    return RowCheck(
        # A missing operand makes the comparison null, and null does not fail.
        F.coalesce(~_OPERATORS[op](a, b), F.lit(False)),
        t.value(left),
        Message(note=lambda: F.concat(
            F.lit(f": {left} ("), a.cast("string"), F.lit(f") not {op} {right} ("), b.cast("string"), F.lit(")"),
        )),
    )


# ---- patterns and lengths --------------------------------------------------------------------


@_type("regex")
def _regex(t: Target) -> Check:
    pattern = t.param("pattern", ".*")
    return t.row_check(t.present() & ~match_start(t.text(), pattern), f"doesn't match '{pattern}'")


@_type("email")
def _email(t: Target) -> Check:
    return t.row_check(t.present() & ~match_start(t.text(), EMAIL_PATTERN), "is not a valid email")


@_type("phone")
def _phone(t: Target) -> Check:
    pattern, warning = t.param("pattern", PHONE_PATTERN), None
    try:
        matched = match_start(t.text(), pattern)
    except PatternError as e:
        matched, warning = match_start(t.text(), PHONE_PATTERN), f"{e}; the default pattern was used"
    return t.row_check(t.present() & ~matched, "is not a valid phone", warning=warning)


@_type("customer_id_pattern")
def _customer_id_pattern(t: Target) -> Check:
    matched = match_start(t.text(), t.param("pattern", CUSTOMER_ID_PATTERN))
    return t.row_check(t.present() & ~matched, "doesn't match ID pattern")


@_type("min_length")
def _min_length(t: Target) -> Check:
    least = int(t.param("min_length", 1))
    return t.row_check(t.present() & (F.length(t.text()) < least), f"length < {least}")


@_type("max_length")
def _max_length(t: Target) -> Check:
    most = int(t.param("max_length", 255))
    return RowCheck(
        t.present() & (F.length(t.text()) > most), t.value(),
        Message(f": '{t.rule.column}' value length > {most}"),
    )


# ---- lists and lookups -----------------------------------------------------------------------


def joined_lookup(
    key: Column, pairs: list[tuple], key_type: T.DataType, value_type: T.DataType
) -> tuple[Column, Callable[[DataFrame], DataFrame]]:
    """The value that a long mapping gives for a key, as a column that a join on the key's own type adds.

    The mapping comes from the rule text, so its size in bytes is known; it is broadcast up to BROADCAST_BYTES
    and left to the optimizer beyond.
    """
    k, v = f"__key_{uuid.uuid4().hex}", f"__value_{uuid.uuid4().hex}"
    schema = T.StructType([T.StructField(k, key_type), T.StructField(v, value_type)])

    def prepare(df: DataFrame) -> DataFrame:
        table = df.sparkSession.createDataFrame(pairs, schema)
        size = sum(len(str(x)) + 16 for pair in pairs for x in pair)
        return df.join(F.broadcast(table) if size <= BROADCAST_BYTES else table, key == F.col(k), "left").drop(k)

    return F.col(v), prepare


def listed(key: Column, values: list, key_type: T.DataType) -> tuple[Column, Callable[[DataFrame], DataFrame] | None]:
    """Whether the key is among the values, which are of its type: one answer, in the expression or by a join."""
    values = list(dict.fromkeys(values))
    if not values:
        return F.lit(False), None
    if len(values) <= INLINE_LIST:
        return key.isin([F.lit(v).cast(key_type) for v in values]), None
    found, prepare = joined_lookup(key, [(v, True) for v in values], key_type, T.BooleanType())
    return found.isNotNull(), prepare


def of_number_type(values: list, dtype: T.DataType) -> tuple[list, T.DataType]:
    """The numbers of a list that a column of this type can hold, exactly, and the type to compare them in.

    A whole number equals 5 and 5.0, and no fraction; a float column is compared as doubles.
    """
    numbers = [v for v in values if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool) and v == v]
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return [float(v) for v in numbers], T.DoubleType()
    finite = [v for v in numbers if not isinstance(v, float) or abs(v) != float("inf")]
    if isinstance(dtype, T.DecimalType):
        step = Decimal(1).scaleb(-dtype.scale)
        exact = [v if isinstance(v, Decimal) else Decimal(str(v)) for v in finite]
        room = Decimal(10) ** (dtype.precision - dtype.scale)
        return [v.quantize(step) for v in exact if abs(v) < room and v == v.quantize(step)], dtype
    return [int(v) for v in finite if v == int(v) and -(2**63) <= v < 2**63], T.LongType()


@_type("allowed_values")
def _allowed_values(t: Target) -> Check:
    values = list(t.param("values") or [])
    dtype = t.dtype()
    # A number never equals a text, so values of the other kind cannot match.
    if is_numeric(dtype):
        values, kind = of_number_type(values, dtype)
        key = t.number().cast(kind)
    elif isinstance(dtype, T.BooleanType):
        values, key, kind = [v for v in values if isinstance(v, bool)], t.col(), dtype
    else:
        values = [v for v in values if isinstance(v, str)] if is_string(dtype) else [str(v) for v in values]
        key, kind = t.text(), T.StringType()
    found, prepare = listed(key, values, kind)
    return t.row_check(t.present() & ~found, "not in the allowed values", prepare=prepare)


@_type("placeholder")
def _placeholder(t: Target) -> Check:
    words = sorted({str(v).lower() for v in t.param("values", PLACEHOLDERS)})
    found, prepare = listed(F.lower(t.text()), words, T.StringType())
    return t.row_check(t.present() & found, "is a placeholder", prepare=prepare)


@_type("currency")
def _currency(t: Target) -> Check:
    # The codes are taken as written: a lower-case code in the list never matches.
    found, prepare = listed(F.upper(t.text()), [str(c) for c in t.param("currencies", CURRENCIES)], T.StringType())
    return t.row_check(t.present() & ~found, "is not a valid currency code", prepare=prepare)


@_type("country")
def _country(t: Target) -> Check:
    codes = [str(c).upper() for c in t.param("valid_countries", COUNTRIES)]
    found, prepare = listed(F.upper(t.text()), codes, T.StringType())
    return t.row_check(t.present() & ~found, "is not a recognized country", prepare=prepare)


@_type("email_domain")
def _email_domain(t: Target) -> Check:
    address = cells.strip(t.text())
    has_at = address.contains("@")
    domain = F.lower(F.get(F.split(address, "@"), F.lit(1)))
    allowed = sorted({str(d).lower() for d in t.param("domains") or []})
    known, prepare = listed(domain, allowed, T.StringType()) if allowed else (F.lit(True), None)

    def note() -> Column:
        return F.when(~has_at, F.concat(F.lit(f": '{t.rule.column}' value '"), address, F.lit("' is not a valid email"))
        ).otherwise(F.concat(F.lit(f": '{t.rule.column}' domain '"), domain, F.lit("' not in the allowed domains")))

    fails = F.coalesce(t.present() & (~has_at | ~known), F.lit(False))
    return RowCheck(fails, t.value(), Message(note=note), prepare)


@_type("data_consistency")
def _data_consistency(t: Target) -> Check:
    reference, checked = t.param("reference_column", t.rule.column), t.param("check_column", "")
    for name in (checked, reference):
        if not name or not t.has(name):
            return Skipped(f"Column '{name}' not in dataset")
    pairs = {str(k): str(v) for k, v in (t.param("mappings") or {}).items()}
    if not pairs:
        return Skipped("The rule has no mappings")
    # A missing value reads as the text 'nan' on both sides.
    key = F.coalesce(cells.strip(t.text(reference)), F.lit("nan"))
    actual = F.coalesce(cells.strip(t.text(checked)), F.lit("nan"))
    if len(pairs) <= INLINE_LIST:
        entries = [F.lit(x) for pair in pairs.items() for x in pair]
        expected, prepare = F.try_element_at(F.create_map(*entries), key), None
    else:
        expected, prepare = joined_lookup(key, list(pairs.items()), T.StringType(), T.StringType())
    return RowCheck(
        F.coalesce(actual != expected, F.lit(False)), t.value(checked),
        Message(note=lambda: F.concat(
            F.lit(f": {reference}='"), key, F.lit(f"' expects {checked}='"), expected, F.lit("', got '"), actual,
            F.lit("'"),
        )),
        prepare,
    )


# ---- dates -----------------------------------------------------------------------------------


@_type("date", "date_format")
def _date(t: Target) -> Check:
    fmt = t.param("format", dates.DEFAULT_FORMAT)
    return t.row_check(t.present() & t.date().isNull(), f"invalid date (expected {fmt})")


def _date_reason(t: Target, parsed: Column, invalid: str, ending: Callable[[], Column]) -> Message:
    return Message(note=lambda: F.concat(
        F.lit(f": '{t.rule.column}' value '"), t.text(), F.lit("' "),
        F.when(parsed.isNull(), F.lit(invalid)).otherwise(ending()),
    ))


@_type("future_date")
def _future_date(t: Target) -> Check:
    day = t.date().cast("date")
    return RowCheck(
        F.coalesce(t.present() & (day.isNull() | (day > t.as_of)), F.lit(False)), t.value(),
        _date_reason(t, day, "is not a valid date", lambda: F.lit("is a future date")),
    )


@_type("data_freshness")
def _data_freshness(t: Target) -> Check:
    most = t.param("max_age_days", 365)
    day = t.date().cast("date")
    age = F.datediff(t.as_of, day)
    return RowCheck(
        F.coalesce(t.present() & (day.isNull() | (age > F.lit(most))), F.lit(False)), t.value(),
        _date_reason(
            t, day, "invalid date",
            lambda: F.concat(F.lit("is "), age.cast("string"), F.lit(f" days old (max: {most})")),
        ),
    )


@_type("date_order")
def _date_order(t: Target) -> Check:
    start, end = t.param("start_column", t.rule.column), t.param("end_column", "")
    if not t.has(end):
        return Skipped(f"Column '{end}' not in dataset")
    if not t.has(start):
        return Broken(f"Column '{start}' not in dataset")
    return RowCheck(
        F.coalesce(t.date(start) > t.date(end), F.lit(False)), t.value(start),
        Message(note=lambda: F.concat(
            F.lit(f": {start} '"), t.text(start), F.lit(f"' > {end} '"), t.text(end), F.lit("'"),
        )),
    )


# ---- expressions -----------------------------------------------------------------------------


@_type("business_rule")
def _business_rule(t: Target) -> Check:
    expression = str(t.param("expression", "true"))
    name = f"__rule_{uuid.uuid4().hex}"

    def prepare(df: DataFrame) -> DataFrame:
        # Without ANSI errors a division by zero or a bad cast is null, so that row fails and not the job.
        spark = df.sparkSession
        ansi = spark.conf.get("spark.sql.ansi.enabled")
        spark.conf.set("spark.sql.ansi.enabled", "false")
        try:
            return df.withColumn(name, F.expr(expression).cast("boolean"))
        finally:
            spark.conf.set("spark.sql.ansi.enabled", ansi)

    return RowCheck(
        ~F.coalesce(F.col(name), F.lit(False)), NO_VALUE,
        Message(f": Business rule '{expression}' failed"),
        prepare,
    )


# ---- other tables and groups -----------------------------------------------------------------


def _names(value: Any) -> tuple[str, ...]:
    return (value,) if isinstance(value, str) else tuple(value)


@_type("reference")
def _reference(t: Target) -> Check:
    """params: `table` (a name among the tables given to `validate`; absent: the table itself), `columns`, `to`."""
    columns = _names(t.param("columns") or t.rule.column)
    name, to = t.param("table"), _names(t.param("to") or columns)
    if name is not None and name not in t.tables:
        return Broken(f"Table '{name}' is not given")
    schema = t.schema if name is None else t.tables[name].schema
    if len(columns) != len(to):
        return Broken(f"{len(columns)} columns refer to {len(to)}")
    for c in columns:
        if not t.has(c):
            return Broken(f"Column '{c}' not in dataset")
    for c in to:
        if c not in schema.names:
            return Broken(f"Column '{c}' not in table '{name}'")
    types = []
    for a, b in zip(columns, to):
        kind = common_type(t.dtype(a), schema[b].dataType)
        if kind is None:
            return Broken(f"Column '{a}' ({t.dtype(a).simpleString()}) cannot equal '{b}' ({schema[b].dataType.simpleString()})")
        types.append(kind)
    if len(columns) == 1:
        value = t.value(columns[0])
    else:
        value = Value(lambda: F.concat_ws(", ", *[t.text(c) for c in columns]))
    where = f"{name or 'the table'}.{'+'.join(to)}"
    reason = Message(f": '{'+'.join(columns)}' value '", f"' is not in {where}")
    return ReferenceCheck(columns, None if name is None else t.tables[name], to, tuple(types), value, reason)


def _groupable(t: Target, by: Any) -> tuple[str, ...] | Broken:
    """The grouping columns, or why rows cannot be grouped by them."""
    by = _names(by or ())
    for c in by:
        if not t.has(c):
            return Broken(f"Column '{c}' not in dataset")
        if isinstance(t.dtype(c), T.MapType):
            return Broken(f"Column '{c}' is a map and cannot be compared")
    return by


@_type("aggregate")
def _aggregate(t: Target) -> Check:
    """params: `measure`, `by`, `levels` (group, total, rollup, cube or lists of columns), `min`, `max`."""
    kind, by = str(t.param("measure", "count")), _groupable(t, t.param("by"))
    if isinstance(by, Broken):
        return by
    low, high = t.param("min"), t.param("max")
    if kind not in MEASURES:
        return Broken(f"Unknown measure: {kind}")
    if low is None and high is None:
        return Broken("The rule has no bounds")
    everything = t.rule.column == "_all"
    if not everything and not t.has(t.rule.column):
        return Broken(f"Column '{t.rule.column}' not in dataset")
    if everything and kind != "count":
        return Broken(f"'{kind}' needs a column")
    if kind == "count":
        value = F.lit(True) if everything else t.present()
    else:
        value = t.number()
        value = summable(value, t.dtype()) if kind in ("sum", "mean") else value
    levels = levels_of(by, t.param("levels", "group"))
    bounds = f"[{_show(low, '-inf')}, {_show(high, 'inf')}]"
    return GroupCheck(by, tuple(levels), Measure(kind, t.rule.column, value), low, high, f"outside {bounds}")


SEQUENCES = ("increasing", "gap", "overlap")


@_type("sequence")
def _sequence(t: Target) -> Check:
    """Rows of a group (`by`) in the order of column `order`.

    params: `check` is increasing (the rule's column never falls; with `strict` it always grows), gap (steps of the
    order column between `min` and `max`; seconds for times, days for dates), or overlap (intervals from the rule's
    column to column `end` do not overlap; they may touch).
    """
    kind, by = str(t.param("check", "increasing")), _groupable(t, t.param("by"))
    if isinstance(by, Broken):
        return by
    order, end = t.param("order", t.rule.column), t.param("end")
    if kind not in SEQUENCES:
        return Broken(f"Unknown check of a sequence: {kind}")
    wanted = [order, t.rule.column, *([end] if kind == "overlap" else [])]
    for c in wanted:
        if not c or not t.has(c):
            return Broken(f"Column '{c}' not in dataset")
        if not (is_numeric(t.dtype(c)) or cells.is_date(t.dtype(c)) or (is_string(t.dtype(c)) and kind == "increasing")):
            return Broken(f"Column '{c}' has no order that can be checked")
    if kind == "overlap" and t.dtype(end) != t.dtype():
        return Broken(f"Columns '{t.rule.column}' and '{end}' have two types")
    low, high = t.param("min"), t.param("max")
    if kind == "gap" and low is None and high is None:
        return Broken("The rule has no bounds")
    if kind == "overlap":
        order = t.rule.column
    return SequenceCheck(by, order, kind, order if kind == "gap" else t.rule.column, end if kind == "overlap" else None, bool(t.param("strict", False)), low, high)


def as_of_date(as_of: dt.date | str | None) -> Column:
    """The day that counts as today."""
    return F.current_date() if as_of is None else F.lit(str(as_of)).cast("date")
