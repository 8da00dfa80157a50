"""The thirty rule types, over the dirty customers, and rule lists over the other tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import Rule, validate
from plumbline.operators import reports
from registry.inputs import AS_OF, dirty, table, with_dirty

EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def _present(c: str) -> str:
    return f"({c} IS NOT NULL AND trim({c}) <> '')"


def _day(c: str, fmt: str = "%Y-%m-%d") -> str:
    return f"CAST(try_strptime(trim({c}), '{fmt}') AS DATE)"


def _num(c: str) -> str:
    return f"(CASE WHEN regexp_matches({c}, '{NUMBER}') THEN TRY_CAST(trim({c}) AS DOUBLE) END)"


@dataclass(frozen=True)
class Case:
    """A rule, and when a row of `source` fails it, in SQL."""

    rule: Rule
    fails: str
    value: str | None = None
    source: str = "d"

    def rows_sql(self) -> str:
        value = self.value or f"CAST({self.rule.column} AS VARCHAR)"
        return f"SELECT row_key, {value} AS value FROM {self.source} WHERE {self.fails}"


def _copies(columns: str) -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY {columns} ORDER BY row_key) AS rn FROM d)"


def _case(rule_type: str, column: str, fails: str, severity: str = "medium", value=None, source="d", **params) -> Case:
    rule = Rule(f"R_{rule_type}", column, rule_type, severity, f"{column}: {rule_type}", params)
    return Case(rule, fails, value, source)


def _placeholders(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


CASES = [
    _case("not_null", "name", "name IS NULL OR trim(name) = ''", "high"),
    _case("unique", "email", "rn > 1", "high", source=_copies("email")),
    _case("range", "age", "age < 0 OR age > 120", min=0, max=120),
    _case("regex", "country", f"{_present('country')} AND NOT regexp_matches(country, '^[A-Z]{{2}}$')", "low",
          pattern="^[A-Z]{2}$"),
    _case("email", "email", f"{_present('email')} AND NOT regexp_matches(email, '{EMAIL}')"),
    _case("date", "signup_date", f"{_present('signup_date')} AND {_day('signup_date')} IS NULL", "low"),
    _case("phone", "phone", f"{_present('phone')} AND NOT regexp_matches(phone, '^\\+\\d{{1,3}}-\\d{{3}}-\\d{{4}}$')",
          "low"),
    _case("allowed_values", "country", f"{_present('country')} AND country NOT IN ('US', 'UK', 'DE')",
          values=["US", "UK", "DE"]),
    _case("numeric", "amount_text", f"{_present('amount_text')} AND {_num('amount_text')} IS NULL"),
    _case("positive", "salary", "salary <= 0", allow_zero=False),
    _case("min_length", "name", f"{_present('name')} AND length(name) < 2", "low", min_length=2),
    _case("max_length", "email", f"{_present('email')} AND length(email) > 19", "low", max_length=19),
    _case("duplicate_row", "_all", "rn > 1", "high", value="CAST(NULL AS VARCHAR)",
          source=_copies("country, currency, age, end_date"), columns=["country", "currency", "age", "end_date"]),
    _case("future_date", "signup_date",
          f"{_present('signup_date')} AND ({_day('signup_date')} IS NULL OR {_day('signup_date')} > DATE '{AS_OF}')"),
    _case("date_format", "signup_date", f"{_present('signup_date')} AND {_day('signup_date', '%Y/%m/%d')} IS NULL",
          "low", format="%Y/%m/%d"),
    _case("placeholder", "name",
          f"{_present('name')} AND lower(name) IN "
          "('n/a','na','null','none','todo','tbd','xxx','test','dummy','placeholder','-','.')"),
    _case("missing_threshold", "email",
          "email IS NULL AND (SELECT 100.0 * count(*) FILTER (WHERE email IS NULL) / count(*) FROM d) > 5", "high",
          max_null_pct=5),
    _case("customer_id_pattern", "amount_text",
          f"{_present('amount_text')} AND NOT regexp_matches(amount_text, '^\\d+$')"),
    _case("email_domain", "email",
          f"{_present('email')} AND (NOT contains(email, '@') OR "
          "lower(split_part(trim(email), '@', 2)) NOT IN ('example.com'))", domains=["Example.com"]),
    _case("currency", "currency",
          f"{_present('currency')} AND upper(currency) NOT IN ('USD','EUR','GBP','JPY','CAD','AUD','INR','CNY')"),
    _case("country", "country",
          f"{_present('country')} AND upper(country) NOT IN ('US','UK','CA','AU','DE','FR','JP','CN','IN','BR','MX',"
          "'IT','ES','NL','SE','NO','DK','FI','CH','AT','BE','IE','NZ','SG','KR','ZA','RU','AR','CL','CO')", "low"),
    _case("date_order", "signup_date", f"{_day('signup_date')} > {_day('end_date')}",
          start_column="signup_date", end_column="end_date"),
    _case("age", "age", "age < 18 OR age > 100", min=18, max=100),
    _case("salary", "salary", "salary < 0 OR salary > 10000000"),
    _case("transaction_amount", "amount_text",
          f"{_present('amount_text')} AND ({_num('amount_text')} IS NULL OR {_num('amount_text')} < 0.01 OR "
          f"{_num('amount_text')} > 1000)", "high", max=1000),
    _case("outlier", "age",
          "age < (SELECT quantile_cont(age, 0.25) - 1.5 * (quantile_cont(age, 0.75) - quantile_cont(age, 0.25)) FROM d) "
          "OR age > (SELECT quantile_cont(age, 0.75) + 1.5 * (quantile_cont(age, 0.75) - quantile_cont(age, 0.25)) FROM d)"),
    _case("cross_field", "customer_id", "NOT (customer_id > age)", "high", column_b="age", operator=">"),
    _case("business_rule", "age", "NOT coalesce(age >= 18 AND salary > 0, FALSE)", "high",
          value="CAST(NULL AS VARCHAR)", expression="age >= 18 AND salary > 0"),
    _case("data_consistency", "country",
          "(trim(country) = 'US' AND coalesce(trim(currency), 'nan') <> 'USD') OR "
          "(trim(country) = 'UK' AND coalesce(trim(currency), 'nan') <> 'GBP')", "high",
          value="currency", check_column="currency", mappings={"US": "USD", "UK": "GBP"}),
    _case("data_freshness", "signup_date",
          f"{_present('signup_date')} AND ({_day('signup_date')} IS NULL OR "
          f"date_diff('day', {_day('signup_date')}, DATE '{AS_OF}') > 365)", "low"),
]

RULES = [c.rule for c in CASES]
RESULT_COLUMNS = [
    "rule_id", "rule_type", "column_name", "severity", "status", "passed", "total_rows", "passed_count", "failed_count",
]


def results_sql(cases: list[Case]) -> str:
    """The rule results as UNION ALL of counts (needs `d`)."""
    parts = []
    for i, c in enumerate(cases):
        r = c.rule
        parts.append(
            f"SELECT {i} AS position, '{r.id}' AS rule_id, '{r.type}' AS rule_type, '{r.column}' AS column_name, "
            f"'{r.severity}' AS severity, '{r.description}' AS description, {bool(r.params)} AS has_params, "
            f"'ok' AS status, t.n AS total_rows, f.n AS failed_count "
            f"FROM (SELECT count(*) AS n FROM d) t, (SELECT count(*) AS n FROM ({c.rows_sql()})) f"
        )
    body = " UNION ALL ".join(parts)
    return f"SELECT *, failed_count = 0 AS passed, total_rows - failed_count AS passed_count FROM ({body})"


def run(spark: SparkSession, sf_dir: str, cases: list[Case] = CASES):
    return validate(dirty(spark, sf_dir), [c.rule for c in cases], key=["row_key"], as_of=AS_OF, run_id="run")


def _one(case: Case) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(spark, sf_dir, [case]).violations.select(F.col("row_key.row_key").alias("row_key"), "value")

    return query


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

for _c in CASES:
    QUERIES[f"rule_{_c.rule.type}"] = _one(_c)
    ORACLES[f"rule_{_c.rule.type}"] = with_dirty(_c.rows_sql())


def rule_results_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir).rule_results.select(*RESULT_COLUMNS)


QUERIES["rule_results_all"] = rule_results_all
ORACLES["rule_results_all"] = with_dirty(f"SELECT {', '.join(RESULT_COLUMNS)} FROM ({results_sql(CASES)})")


def violations_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir).violations.select(
        "rule_id", "column_name", F.col("row_key.row_key").alias("row_key"), "value"
    )


QUERIES["violations_all"] = violations_all
ORACLES["violations_all"] = with_dirty(
    " UNION ALL ".join(
        f"SELECT '{c.rule.id}' AS rule_id, '{c.rule.column}' AS column_name, row_key, value FROM ({c.rows_sql()})"
        for c in CASES
    )
)

# ---- messages ------------------------------------------------------------------------------------

_MESSAGES = {
    "not_null": "concat('Row ', row_key, ': ''name'' is null or empty')",
    "unique": "concat('Row ', row_key, ': ''email'' value ''', coalesce(value, 'null'), ''' is duplicated')",
    "range": "concat('Row ', row_key, ': ''age'' value ''', value, ''' outside [0, 120]')",
    "email": "concat('Row ', row_key, ': ''email'' value ''', value, ''' is not a valid email')",
    "date": "concat('Row ', row_key, ': ''signup_date'' value ''', value, ''' invalid date (expected %Y-%m-%d)')",
    "max_length": "concat('Row ', row_key, ': ''email'' value length > 19')",
    "duplicate_row": "concat('Row ', row_key, ': Entire row is a duplicate')",
    "business_rule": "concat('Row ', row_key, ': Business rule ''age >= 18 AND salary > 0'' failed')",
}
_WITH_MESSAGE = [c for c in CASES if c.rule.type in _MESSAGES]


def violation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, _WITH_MESSAGE).violations.select("rule_id", "reason")


QUERIES["violation_messages"] = violation_messages
ORACLES["violation_messages"] = with_dirty(
    " UNION ALL ".join(
        f"SELECT '{c.rule.id}' AS rule_id, {_MESSAGES[c.rule.type]} AS reason FROM ({c.rows_sql()})"
        for c in _WITH_MESSAGE
    )
)

# ---- reports ---------------------------------------------------------------------------------------


def rule_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.run_summary(run(spark, sf_dir).rule_results)


QUERIES["rule_summary"] = rule_summary
ORACLES["rule_summary"] = with_dirty(f"""
SELECT count(*) AS total_rules, count(*) FILTER (WHERE passed) AS passed_rules,
  count(*) FILTER (WHERE NOT passed) AS failed_rules,
  CAST(coalesce(sum(failed_count), 0) AS BIGINT) AS total_failures, bool_and(passed) AS all_passed,
  CAST(coalesce(sum(failed_count) FILTER (WHERE severity = 'high'), 0) AS BIGINT) AS high_failures,
  CAST(coalesce(sum(failed_count) FILTER (WHERE severity = 'medium'), 0) AS BIGINT) AS medium_failures,
  CAST(coalesce(sum(failed_count) FILTER (WHERE severity = 'low'), 0) AS BIGINT) AS low_failures
FROM ({results_sql(CASES)})""")


def rule_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.display_table(run(spark, sf_dir).rule_results)


QUERIES["rule_display"] = rule_display
ORACLES["rule_display"] = with_dirty(f"""
SELECT rule_id AS "Rule ID", column_name AS "Column", rule_type AS "Type", severity AS "Severity",
  CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END AS "Status", passed_count AS "Passed", failed_count AS "Failed",
  total_rows AS "Total" FROM ({results_sql(CASES)})""")


def rule_summary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.summary_lines(run(spark, sf_dir).rule_results).select("rule_id", "line")


QUERIES["rule_summary_lines"] = rule_summary_lines
ORACLES["rule_summary_lines"] = with_dirty(f"""
SELECT rule_id, concat('[', CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END, '] ', rule_id, ' | ', column_name, ' → ',
  rule_type, ' | ', failed_count, '/', total_rows, ' failed') AS line FROM ({results_sql(CASES)})""")


def failed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir).failed().select("rule_id", "failed_count")


QUERIES["failed_rules"] = failed_rules
ORACLES["failed_rules"] = with_dirty(f"SELECT rule_id, failed_count FROM ({results_sql(CASES)}) WHERE NOT passed")


def failed_rows_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.failed_rows(run(spark, sf_dir).violations).select(
        "rule_id", F.col("row_key.row_key").alias("row_key")
    )


QUERIES["failed_rows_by_rule"] = failed_rows_by_rule
ORACLES["failed_rows_by_rule"] = with_dirty(
    " UNION ALL ".join(f"SELECT '{c.rule.id}' AS rule_id, row_key FROM ({c.rows_sql()})" for c in CASES)
)


def failure_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.failure_list(run(spark, sf_dir).rule_results)


QUERIES["failure_list"] = failure_list
ORACLES["failure_list"] = with_dirty(f"""
SELECT concat(rule_id, ': ', column_name, ' → ', rule_type) AS rule,
  concat(description, ' — ', failed_count, ' rows affected') AS description, severity
FROM ({results_sql(CASES)}) WHERE NOT passed""")

SAMPLES_SQL = " UNION ALL ".join(
    f"SELECT {i} AS position, '{c.rule.id}' AS rule_id, row_key, value FROM ({c.rows_sql()})"
    for i, c in enumerate(CASES)
)


def violation_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sample_per_rule(run(spark, sf_dir).violations).select(
        "rule_id", F.col("row_key.row_key").alias("row_key"), "value", "sample_no"
    )


QUERIES["violation_samples"] = violation_samples
ORACLES["violation_samples"] = with_dirty(f"""
SELECT rule_id, row_key, value, CAST(sample_no AS INTEGER) AS sample_no FROM (
  SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY row_key) AS sample_no FROM ({SAMPLES_SQL}))
WHERE sample_no <= 10""")


def problem_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = run(spark, sf_dir)
    report = reports.problem_report(outcome.rule_results, outcome.violations)
    return report.select(
        "id", "rule_id", "rule_type", "column", "severity", "failed_count", "total_rows",
        F.array_join(F.transform("affected", lambda k: k["row_key"].cast("string")), ",").alias("affected"),
        F.array_join("sample_values", ",", "null").alias("sample_values"),
    )


QUERIES["problem_report"] = problem_report
ORACLES["problem_report"] = with_dirty(f"""
WITH res AS ({results_sql(CASES)}),
s AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY row_key) AS n FROM ({SAMPLES_SQL})),
a AS (SELECT position, string_agg(CAST(row_key AS VARCHAR), ',' ORDER BY n) FILTER (WHERE n <= 10) AS affected,
  string_agg(coalesce(value, 'null'), ',' ORDER BY n) FILTER (WHERE n <= 3) AS sample_values FROM s GROUP BY position)
SELECT concat('P', lpad(CAST(row_number() OVER (ORDER BY res.position) AS VARCHAR), 3, '0')) AS id, rule_id, rule_type,
  column_name AS "column", severity, failed_count, total_rows, affected, sample_values
FROM res JOIN a ON res.position = a.position WHERE NOT passed""")

# ---- rule lists over the other tables ---------------------------------------------------------------


@dataclass(frozen=True)
class Plain:
    """A rule over a test table as it is, and the number of failures in SQL."""

    rule: Rule
    failed: str


def _plain(rule_id: str, column: str, rule_type: str, failed: str, severity: str = "medium", **params) -> Plain:
    return Plain(Rule(rule_id, column, rule_type, severity, "", params), failed)


def _count(table_name: str, where: str) -> str:
    return f"SELECT count(*) FROM {table_name} WHERE {where}"


def _extra(table_name: str, columns: str) -> str:
    return f"SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM {table_name} GROUP BY {columns})"


def _beyond(table_name: str, column: str) -> str:
    return (
        f"WITH q AS (SELECT quantile_cont({column}, 0.25) AS a, quantile_cont({column}, 0.75) AS b FROM {table_name}) "
        f"SELECT count(*) FROM {table_name}, q WHERE {column} < a - 1.5 * (b - a) OR {column} > b + 1.5 * (b - a)"
    )


TABLE_RULES = {
    "lineitem": [
        _plain("L1", "l_orderkey", "not_null", _count("lineitem", "l_orderkey IS NULL"), "high"),
        _plain("L2", "l_quantity", "range", _count("lineitem", "l_quantity < 2 OR l_quantity > 49"), min=2, max=49),
        _plain("L3", "l_discount", "range", _count("lineitem", "l_discount < 0 OR l_discount > 0.08"), min=0, max=0.08),
        _plain("L4", "l_extendedprice", "positive", _count("lineitem", "l_extendedprice <= 0")),
        _plain("L5", "l_returnflag", "allowed_values", _count("lineitem", "l_returnflag NOT IN ('A', 'N')"),
               values=["A", "N"]),
        _plain("L6", "l_extendedprice", "outlier", _beyond("lineitem", "l_extendedprice")),
        _plain("L7", "l_tax", "transaction_amount", _count("lineitem", "l_tax < 0.01 OR l_tax > 0.07"), max=0.07),
        _plain("L8", "l_orderkey", "unique", _extra("lineitem", "l_orderkey"), "high"),
        _plain("L9", "_all", "duplicate_row", _extra("lineitem", "l_orderkey, l_linenumber"), "high",
               columns=["l_orderkey", "l_linenumber"]),
        _plain("L10", "_all", "duplicate_row", "SELECT (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem))", "high"),
        _plain("L11", "l_partkey", "cross_field", _count("lineitem", "NOT (l_partkey >= l_suppkey)"),
               column_b="l_suppkey", operator=">="),
        _plain("L12", "l_shipdate", "future_date", _count("lineitem", "l_shipdate::DATE > DATE '1998-01-01'")),
        _plain("L13", "l_shipdate", "date", "SELECT 0"),
        _plain("L14", "l_quantity", "business_rule",
               _count("lineitem", "NOT (l_quantity * l_discount < 3 OR l_returnflag = 'R')"),
               expression="l_quantity * l_discount < 3 OR l_returnflag = 'R'"),
    ],
    "orders": [
        _plain("O1", "o_orderkey", "unique", _extra("orders", "o_orderkey"), "high"),
        _plain("O2", "o_custkey", "unique", _extra("orders", "o_custkey")),
        _plain("O3", "o_orderstatus", "allowed_values", _count("orders", "o_orderstatus NOT IN ('F', 'O')"),
               values=["F", "O"]),
        _plain("O4", "o_totalprice", "salary", _count("orders", "o_totalprice < 5000 OR o_totalprice > 400000"),
               min=5000, max=400000),
        _plain("O5", "o_orderpriority", "regex",
               _count("orders", "NOT regexp_matches(o_orderpriority, '^[1-3]-[A-Z]+$')"), pattern="^[1-3]-[A-Z]+$"),
        _plain("O6", "o_orderdate", "data_freshness",
               _count("orders", "date_diff('day', o_orderdate::DATE, DATE '1998-01-01') > 365"), max_age_days=365),
        _plain("O7", "o_totalprice", "outlier", _beyond("orders", "o_totalprice")),
        _plain("O8", "nothing", "not_null", _count("orders", "TRUE"), "high"),
    ],
    "documents": [
        _plain("D1", "text", "not_null", _count("documents", "text IS NULL OR NOT regexp_matches(text, '\\S')"), "high"),
        _plain("D2", "text", "min_length", _count("documents", "length(text) < 200 AND regexp_matches(text, '\\S')"),
               min_length=200),
        _plain("D3", "text", "max_length", _count("documents", "length(text) > 5000"), max_length=5000),
        _plain("D4", "text", "unique", _extra("documents", "text"), "high"),
        _plain("D5", "lang", "allowed_values", _count("documents", "lang NOT IN ('en', 'fr')"), values=["en", "fr"]),
        _plain("D6", "text", "regex",
               _count("documents", "regexp_matches(text, '\\S') AND NOT regexp_matches(text, '^[A-Z]')"),
               pattern="[A-Z]"),
        _plain("D7", "n_chars", "outlier", _beyond("documents", "n_chars")),
        _plain("D8", "source", "customer_id_pattern", _count("documents", "NOT regexp_matches(source, '^src\\d$')"),
               pattern="^src\\d$"),
    ],
    "pages": [
        _plain("P1", "page_id", "unique", _extra("pages", "page_id"), "high"),
        _plain("P2", "url", "unique", _extra("pages", "url")),
        _plain("P3", "url", "regex", _count("pages", "NOT regexp_matches(url, '^https://[a-z.]+/')"),
               pattern="https://[a-z.]+/"),
        _plain("P4", "html", "regex", _count("pages", "NOT starts_with(html, '<!DOCTYPE html>')"),
               pattern="<!DOCTYPE html>"),
        _plain("P5", "html", "max_length", _count("pages", "length(html) > 4000"), max_length=4000),
    ],
    "events": [
        _plain("E1", "event_id", "unique", _extra("events", "event_id"), "high"),
        _plain("E2", "user_id", "unique", _extra("events", "user_id")),
        _plain("E3", "event_type", "allowed_values", _count("events", "event_type NOT IN ('click', 'view')"),
               values=["click", "view"]),
        _plain("E4", "value", "outlier", _beyond("events", "value")),
        _plain("E5", "props", "regex", _count("events", """NOT regexp_matches(props, '^\\{"k": \\d\\}$')"""),
               pattern=r'^\{"k": \d\}$'),
        _plain("E6", "value", "positive", _count("events", "value <= 0")),
    ],
    "conversations": [
        _plain("C1", "_all", "duplicate_row", _extra("conversations", "conv_id, turn"), "high",
               columns=["conv_id", "turn"]),
        _plain("C2", "role", "allowed_values", _count("conversations", "role NOT IN ('user', 'assistant')"),
               values=["user", "assistant"]),
        _plain("C3", "text", "min_length",
               _count("conversations", "length(text) < 100 AND regexp_matches(text, '\\S')"), min_length=100),
        _plain("C4", "text", "unique", _extra("conversations", "text")),
        _plain("C5", "turn", "range", _count("conversations", "turn < 0 OR turn > 8"), min=0, max=8),
    ],
}


def _over(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rules = [p.rule for p in TABLE_RULES[name]]
        return validate(table(spark, sf_dir, name), rules, as_of="1998-01-01").rule_results.select(
            "rule_id", "rule_type", "column_name", "status", "passed", "total_rows", "failed_count"
        )

    return query


def _over_sql(name: str) -> str:
    parts = []
    for p in TABLE_RULES[name]:
        r, error = p.rule, p.rule.column == "nothing"
        parts.append(
            f"SELECT '{r.id}' AS rule_id, '{r.type}' AS rule_type, '{r.column}' AS column_name, "
            f"'{'error' if error else 'ok'}' AS status, (SELECT count(*) FROM {name}) AS total_rows, "
            f"CAST(({p.failed}) AS BIGINT) AS failed_count"
        )
    body = " UNION ALL ".join(parts)
    return f"SELECT *, status = 'ok' AND failed_count = 0 AS passed FROM ({body})"


for _name in TABLE_RULES:
    QUERIES[f"results_{_name}"] = _over(_name)
    ORACLES[f"results_{_name}"] = _over_sql(_name)


def shipped_before_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`date_order` over two typed dates that a join brings together."""
    joined = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    rule = Rule("J1", "o_orderdate", "date_order", params={"end_column": "l_shipdate"})
    return validate(joined, [rule]).rule_results.select("rule_id", "total_rows", "failed_count")


QUERIES["results_order_dates"] = shipped_before_ordered
ORACLES["results_order_dates"] = """
SELECT 'J1' AS rule_id, count(*) AS total_rows, count(*) FILTER (WHERE o_orderdate > l_shipdate) AS failed_count
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


# ---- lists above the size of an expression, and rules that cannot run -------------------------------------


def allowed_values_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1200 allowed numbers, some above 10 million and some fractions, over three types of column."""
    whole = [k * 4 for k in range(400)]
    values = [*whole, *[10_000_000 + k for k in range(400)], *[k + 0.5 for k in range(400)]]
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_orderkey") + 10_000_000).alias("large"), (F.col("o_orderkey") / 2).alias("halves")
    )
    rules = [Rule(f"A{k}", c, "allowed_values", params={"values": values}) for k, c in enumerate(orders.columns)]
    return validate(orders, rules).rule_results.select("rule_id", "total_rows", "failed_count")


QUERIES["rule_allowed_values_long"] = allowed_values_long
ORACLES["rule_allowed_values_long"] = """
WITH v AS (SELECT (k * 4)::DOUBLE AS x FROM range(400) t(k) UNION ALL SELECT 10000000 + k FROM range(400) t(k)
  UNION ALL SELECT k + 0.5 FROM range(400) t(k))
SELECT 'A0' AS rule_id, count(*) AS total_rows, count(*) FILTER (WHERE o_orderkey NOT IN (SELECT x FROM v)) AS failed_count FROM orders
UNION ALL SELECT 'A1', count(*), count(*) FILTER (WHERE o_orderkey + 10000000 NOT IN (SELECT x FROM v)) FROM orders
UNION ALL SELECT 'A2', count(*), count(*) FILTER (WHERE o_orderkey / 2.0 NOT IN (SELECT x FROM v)) FROM orders"""


def violations_of_broken_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that cannot run fail on every row, in the results and in the violations alike."""
    rules = [Rule("B1", "nothing", "not_null"), Rule("B2", "o_totalprice", "positive"), Rule("B3", "nowhere", "email")]
    done = validate(table(spark, sf_dir, "orders"), rules, key=["o_orderkey"])
    listed = done.violations.groupBy("rule_id").agg(F.count("*").alias("listed"), F.min("reason").alias("reason"))
    return done.rule_results.join(listed, "rule_id", "left").select(
        "rule_id", "status", "failed_count", F.coalesce("listed", F.lit(0)).alias("listed"), "reason"
    )


QUERIES["violations_broken_rules"] = violations_of_broken_rules
ORACLES["violations_broken_rules"] = """
SELECT 'B1' AS rule_id, 'error' AS status, count(*) AS failed_count, count(*) AS listed, 'Column ''nothing'' not in dataset' AS reason FROM orders
UNION ALL SELECT 'B2', 'ok', count(*) FILTER (WHERE o_totalprice <= 0), count(*) FILTER (WHERE o_totalprice <= 0), NULL FROM orders
UNION ALL SELECT 'B3', 'error', count(*), count(*), 'Column ''nowhere'' not in dataset' FROM orders"""
