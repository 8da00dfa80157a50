"""Repairs, the clean-up sequence and the validate-repair loop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import Rule, run_loop
from plumbline.operators import loop, repair
from registry.inputs import AS_OF, dirty, table, with_dirty
from registry.rule_queries import EMAIL, _day, _num, _present

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KEY = ["row_key"]


def register(name: str, sql: str | None = None):
    def add(query):
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = with_dirty(sql)
        return query

    return add


def _fix(name: str, sql: str, fix: Callable[[DataFrame], DataFrame], *columns: str) -> None:
    """Register a repair of the dirty customers that is compared on the row key and some columns."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fix(dirty(spark, sf_dir)).select("row_key", *columns)

    QUERIES[f"fix_{name}"] = query
    ORACLES[f"fix_{name}"] = with_dirty(sql)


_LENIENT = f"coalesce({_day('signup_date')}, {_day('signup_date', '%Y/%m/%d')})"
_MODE = (
    "(SELECT name FROM d WHERE name IS NOT NULL AND trim(name) <> '' GROUP BY name ORDER BY count(*) DESC, name LIMIT 1)"
)
_Q = "(SELECT quantile_cont(age, {0}) FROM d)"
_LOW = f"({_Q.format(0.25)} - 1.5 * ({_Q.format(0.75)} - {_Q.format(0.25)}))"
_HIGH = f"({_Q.format(0.75)} + 1.5 * ({_Q.format(0.75)} - {_Q.format(0.25)}))"
_PLACEHOLDER_SQL = "('n/a','na','null','none','todo','tbd','xxx','test','dummy','placeholder','-','.')"

# Cells, by rule type.
_fix("fill_median", "SELECT row_key, coalesce(age, (SELECT median(age) FROM d)) AS age FROM d",
     lambda d: repair.fill_median(d, "age").withColumn("age", F.col("age").cast("double")), "age")
_fix("fill_mode", f"SELECT row_key, CASE WHEN {_present('name')} THEN name ELSE {_MODE} END AS name FROM d",
     lambda d: repair.fill_missing(d, "name"), "name")
_fix("suffix_repeats",
     """SELECT row_key, CASE WHEN row_number() OVER (PARTITION BY email ORDER BY row_key) > 1
     THEN concat(coalesce(email, 'nan'), '_dup') ELSE email END AS email FROM d""",
     lambda d: repair.suffix_repeats(d, "email", KEY), "email")
_fix("null_non_numeric",
     f"""SELECT row_key, CASE WHEN {_present('amount_text')} AND {_num('amount_text')} IS NULL THEN NULL
     ELSE amount_text END AS amount_text FROM d""",
     lambda d: repair.null_non_numeric(d, "amount_text"), "amount_text")
_fix("flag_mismatch",
     rf"SELECT row_key, phone, coalesce({_present('phone')} AND NOT regexp_matches(phone, '^\+\d{{1,3}}-\d{{3}}-\d{{4}}$'), FALSE) AS needs_review FROM d",
     lambda d: repair.flag_mismatch(d, "phone", r"^\+\d{1,3}-\d{3}-\d{4}$"), "phone", "needs_review")
_fix("null_invalid_email",
     f"SELECT row_key, CASE WHEN regexp_matches(email, '{EMAIL}') THEN email END AS email FROM d",
     lambda d: repair.null_invalid_email(d, "email"), "email")
_fix("standardize_dates",
     f"SELECT row_key, CASE WHEN {_present('signup_date')} THEN CAST({_LENIENT} AS VARCHAR) ELSE signup_date END AS signup_date FROM d",
     lambda d: repair.standardize_dates(d, "signup_date"), "signup_date")
_fix("null_placeholders",
     f"SELECT row_key, CASE WHEN lower(trim(name)) IN {_PLACEHOLDER_SQL} THEN NULL ELSE name END AS name FROM d",
     lambda d: repair.null_placeholders(d, "name"), "name")
_fix("drop_repeated_rows",
     """SELECT row_key, country, currency, age, end_date FROM (SELECT *, row_number() OVER
     (PARTITION BY country, currency, age, end_date ORDER BY row_key) AS rn FROM d) WHERE rn = 1""",
     lambda d: repair.drop_repeated_rows(d, KEY, ["country", "currency", "age", "end_date"]),
     "country", "currency", "age", "end_date")

# Cells and rows, by template.
_fix("drop_missing", "SELECT row_key, name FROM d WHERE name IS NOT NULL",
     lambda d: repair.drop_missing(d, ["name"]), "name")
_fix("keep_first",
     "SELECT row_key, email FROM (SELECT *, row_number() OVER (PARTITION BY email ORDER BY row_key) AS rn FROM d) WHERE rn = 1",
     lambda d: repair.keep_first(d, ["email"], KEY), "email")
_fix("null_outside", "SELECT row_key, CASE WHEN age < 0 OR age > 120 THEN NULL ELSE age END AS age FROM d",
     lambda d: repair.null_outside(d, "age", 0, 120), "age")
_fix("zero_negatives", "SELECT row_key, CASE WHEN age < 0 THEN 0 ELSE age END AS age FROM d",
     lambda d: repair.zero_negatives(d, "age"), "age")
_fix("flag_outliers",
     f"SELECT row_key, age, coalesce(age < {_LOW} OR age > {_HIGH}, FALSE) AS needs_review FROM d",
     lambda d: repair.flag_outliers(d, "age"), "age", "needs_review")
_fix("null_bad_addresses",
     r"SELECT row_key, CASE WHEN regexp_matches(email, '@.*\.') THEN email END AS email FROM d",
     lambda d: repair.null_bad_addresses(d, "email"), "email")
_fix("text_to_date", f"SELECT row_key, {_day('signup_date')} AS signup_date FROM d",
     lambda d: repair.text_to_date(d, "signup_date"), "signup_date")

# Rows.
_fix("drop_missing_contact", "SELECT row_key, name, email FROM d WHERE name IS NOT NULL AND email IS NOT NULL",
     lambda d: repair.drop_missing(d, ["name", "email"]), "name", "email")
_fix("drop_missing_country", "SELECT row_key, country FROM d WHERE country IS NOT NULL",
     lambda d: repair.drop_missing(d, ["country"]), "country")
_fix("keep_first_customer",
     """SELECT row_key, customer_id FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY row_key) AS rn
     FROM d) WHERE rn = 1""",
     lambda d: repair.keep_first(d, ["customer_id"], KEY), "customer_id")
_CORRECTIONS = {"-at-example.com": "@example.com", "@@": "@", "@other.org": "@example.org"}
_fix("replace_known",
     "SELECT row_key, replace(replace(replace(trim(email), '-at-example.com', '@example.com'), '@@', '@'), "
     "'@other.org', '@example.org') AS email FROM d",
     lambda d: repair.replace_known(d, "email", _CORRECTIONS), "email")
_fix("keep_between", "SELECT row_key, age FROM d WHERE age >= 18 AND age <= 100",
     lambda d: repair.keep_between(d, "age", 18, 100), "age")
_fix("drop_bad_phones",
     r"SELECT row_key, phone FROM d WHERE regexp_matches(phone, '^[\d\+\-\(\)\s]+$') AND length(phone) >= 7",
     lambda d: repair.drop_bad_phones(d, "phone"), "phone")
_fix("drop_bad_dates", f"SELECT row_key, {_LENIENT} AS signup_date FROM d WHERE {_LENIENT} IS NOT NULL",
     lambda d: repair.drop_bad_dates(d, "signup_date"), "signup_date")
_fix("drop_future",
     f"SELECT row_key, signup_date FROM d WHERE coalesce({_day('signup_date')} <= DATE '{AS_OF}', TRUE)",
     lambda d: repair.drop_future(d, "signup_date", AS_OF), "signup_date")
_fix("drop_placeholders",
     "SELECT row_key, name FROM d WHERE coalesce(lower(name) NOT IN ('n/a','todo','test','placeholder','unknown'), TRUE)",
     lambda d: repair.drop_placeholders(d, "name", ["N/A", "TODO", "test", "placeholder", "unknown"]), "name")
_fix("keep_allowed", "SELECT row_key, country FROM d WHERE country IN ('US','UK','CA','AU','DE','JP','FR','CN')",
     lambda d: repair.keep_allowed(d, "country", ["US", "UK", "CA", "AU", "DE", "JP", "FR", "CN"]),
     "country")
_fix("drop_negative", "SELECT row_key, salary FROM d WHERE salary >= 0",
     lambda d: repair.drop_negative(d, "salary"), "salary")
_P = "(SELECT quantile_cont({0}, {1}) FROM d)"
_fix("cap_extreme",
     f"SELECT row_key, CASE WHEN salary > 2 * {_P.format('salary', 0.95)} THEN {_P.format('salary', 0.95)} ELSE salary END AS salary FROM d",
     lambda d: repair.cap_above(d, "salary", 0.95, only_above=2), "salary")
_fix("cap_above",
     f"SELECT row_key, least(salary, {_P.format('salary', 0.99)}) AS salary FROM d",
     lambda d: repair.cap_above(d, "salary", 0.99), "salary")
_fix("impute_outside",
     """SELECT row_key, CAST(CASE WHEN age < 18 OR age > 100
     THEN (SELECT quantile_cont(age, 0.5) FROM d WHERE age >= 18 AND age <= 100) ELSE age END AS DOUBLE) AS age FROM d""",
     lambda d: repair.impute_outside(d, "age", 18, 100).withColumn("age", F.col("age").cast("double")),
     "age")
_fix("keep_domains",
     "SELECT row_key, email, regexp_extract(email, '@(.+)$', 1) AS domain FROM d "
     "WHERE regexp_extract(email, '@(.+)$', 1) IN ('example.com', 'other.org')",
     lambda d: repair.keep_domains(d, "email", ["example.com", "other.org"]), "email", "domain")
_fix("drop_outliers", f"SELECT row_key, age FROM d WHERE age >= {_LOW} AND age <= {_HIGH}",
     lambda d: repair.drop_outliers(d, "age"), "age")
_fix("drop_above", f"SELECT row_key, salary FROM d WHERE salary <= 2 * {_P.format('salary', 0.95)}",
     lambda d: repair.drop_above(d, "salary", 0.95, only_above=2), "salary")
_fix("suffix_groups",
     """SELECT row_key, CASE WHEN count(*) OVER (PARTITION BY email) > 1 THEN concat(coalesce(email, 'nan'), '_copy')
     ELSE email END AS email FROM d""",
     lambda d: repair.suffix_groups(d, "email", "_copy"), "email")


@register("fix_replace_values", """
SELECT row_key, CASE WHEN n_name IS NOT NULL THEN n_name ELSE country END AS country FROM d
LEFT JOIN (SELECT CASE n_nationkey WHEN 0 THEN 'ZZ' WHEN 1 THEN 'XX' ELSE concat('#', n_nationkey) END AS wrong, n_name
  FROM nation) ON country = wrong""")  # fmt: skip
def fix_replace_values(spark, sf_dir):
    """Corrections from a table."""
    wrong = F.when(F.col("n_nationkey") == 0, "ZZ").when(F.col("n_nationkey") == 1, "XX").otherwise(
        F.concat(F.lit("#"), "n_nationkey")
    )
    corrections = table(spark, sf_dir, "nation").select(wrong.alias("wrong"), F.col("n_name").alias("right"))
    return repair.replace_values(dirty(spark, sf_dir), "country", corrections).select("row_key", "country")


@register("fix_before_after", """
SELECT n AS rows_before, k AS rows_after, n - k AS rows_removed, round((n - k) * 100.0 / n, 1) AS removed_pct
FROM (SELECT count(*) AS n, count(*) FILTER (WHERE age >= 18 AND age <= 100) AS k FROM d)""")  # fmt: skip
def fix_before_after(spark, sf_dir):
    data = dirty(spark, sf_dir)
    return repair.before_after(data, repair.keep_between(data, "age", 18, 100))


@register("fix_user_function", "SELECT row_key, upper(trim(country)) AS country FROM d")
def fix_user_function(spark, sf_dir):
    data = dirty(spark, sf_dir)
    fixed, _ = repair.apply_user_fix(data, lambda df: df.withColumn("country", F.upper(F.trim("country"))))
    unchanged, _ = repair.apply_user_fix(fixed, lambda df: df.withColumn("country", F.col("no such column")))
    return unchanged.select("row_key", "country")


@register("fix_user_function_fails", "SELECT row_key, country, TRUE AS failed FROM d")
def fix_user_function_fails(spark, sf_dir):
    """A fix that fails on a row while it runs changes nothing and is reported."""
    data, why = repair.apply_user_fix(dirty(spark, sf_dir), lambda df: df.withColumn("country", F.raise_error(F.lit("no"))))
    return data.select("row_key", "country", F.lit(why is not None).alias("failed"))


# ---- the clean-up sequence ------------------------------------------------------------------------------

_CLEAN_SQL = f"""
WITH a AS (SELECT * FROM d WHERE name IS NOT NULL AND email IS NOT NULL),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY row_key) AS rn FROM a) WHERE rn = 1),
c AS (SELECT * REPLACE (replace(replace(trim(email), '-at-example.com', '@example.com'), '@@', '@') AS email) FROM b),
e AS (SELECT * FROM c WHERE age >= 18 AND age <= 100),
f AS (SELECT * FROM e WHERE regexp_matches(phone, '^[\\d\\+\\-\\(\\)\\s]+$') AND length(phone) >= 7),
g AS (SELECT * REPLACE ({_LENIENT} AS signup_date) FROM f WHERE {_LENIENT} IS NOT NULL),
h AS (SELECT * FROM g WHERE signup_date <= DATE '{AS_OF}'),
i AS (SELECT * FROM h WHERE lower(name) NOT IN ('n/a', 'todo', 'test', 'placeholder', 'unknown')),
j AS (SELECT * FROM i WHERE country IN ('US','UK','CA','AU','DE','JP','FR','CN') AND salary >= 0),
p AS (SELECT quantile_cont(salary, 0.99) AS top FROM j),
z AS (SELECT j.* REPLACE (CASE WHEN salary > 2 * top THEN top ELSE salary END AS salary) FROM j, p)"""


def _clean(data: DataFrame) -> DataFrame:
    data = repair.drop_missing(data, ["name", "email"])
    data = repair.keep_first(data, ["customer_id"], KEY)
    data = repair.replace_known(data, "email", {"-at-example.com": "@example.com", "@@": "@"})
    data = repair.keep_between(data, "age", 18, 100)
    data = repair.drop_bad_phones(data, "phone")
    data = repair.drop_bad_dates(data, "signup_date")
    data = repair.drop_future(data, "signup_date", AS_OF)
    data = repair.drop_placeholders(data, "name", ["N/A", "TODO", "test", "placeholder", "unknown"])
    data = repair.keep_allowed(data, "country", ["US", "UK", "CA", "AU", "DE", "JP", "FR", "CN"])
    data = repair.drop_negative(data, "salary")
    return repair.cap_above(data, "salary", 0.99, only_above=2)


@register("clean_customers", f"{_CLEAN_SQL} SELECT row_key, customer_id, name, email, signup_date, salary FROM z")
def clean_customers(spark, sf_dir):
    cleaned = _clean(dirty(spark, sf_dir))
    return cleaned.select("row_key", "customer_id", "name", "email", "signup_date", "salary")


@register("clean_customers_report", f"""{_CLEAN_SQL}
SELECT n AS rows_before, k AS rows_after, n - k AS rows_removed, round((n - k) * 100.0 / n, 1) AS removed_pct
FROM (SELECT count(*) AS n FROM d), (SELECT count(*) AS k FROM z)""")  # fmt: skip
def clean_customers_report(spark, sf_dir):
    data = dirty(spark, sf_dir)
    return repair.before_after(data, _clean(data))


# ---- the loop ---------------------------------------------------------------------------------------------

# In rule order: nulls are dropped; copies of a customer are dropped; ages out of range become null; bad
# e-mails lose their value first by the general and then by the specific repair; the phone is only flagged.
LOOP_RULES = [
    Rule("R1", "country", "not_null", "medium"),
    Rule("R2", "customer_id", "unique", "high"),
    Rule("R3", "age", "range", "medium", params={"min": 0, "max": 120}),
    Rule("R4", "email", "email", "medium"),
    Rule("R5", "amount_text", "transaction_amount", "high"),
    Rule("R6", "name", "placeholder", "medium", params={"values": ["N/A", "TODO"]}),
    Rule("R7", "phone", "phone", "low"),
]
_PHONE_OK = r"regexp_matches(phone, '^\+\d{1,3}-\d{3}-\d{4}$')"


def _count_failures(source: str) -> str:
    return f"""SELECT
  count(*) FILTER (WHERE NOT coalesce({_present('country')}, FALSE)) AS f1,
  (SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM {source} GROUP BY customer_id)) AS f2,
  count(*) FILTER (WHERE age < 0 OR age > 120) AS f3,
  count(*) FILTER (WHERE {_present('email')} AND NOT regexp_matches(email, '{EMAIL}')) AS f4,
  count(*) FILTER (WHERE {_present('amount_text')} AND ({_num('amount_text')} IS NULL OR {_num('amount_text')} < 0.01)) AS f5,
  count(*) FILTER (WHERE lower(name) IN ('n/a', 'todo')) AS f6,
  count(*) FILTER (WHERE {_present('phone')} AND NOT {_PHONE_OK}) AS f7 FROM {source}"""


_LOOP_SQL = f"""
WITH a AS (SELECT * FROM d WHERE country IS NOT NULL),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY row_key) AS rn FROM a) WHERE rn = 1),
r1 AS (SELECT * REPLACE (
    CASE WHEN age < 0 OR age > 120 THEN NULL ELSE age END AS age,
    CASE WHEN regexp_matches(email, '@.*\\.') THEN email END AS email,
    CASE WHEN {_present('amount_text')} AND {_num('amount_text')} IS NULL THEN NULL ELSE amount_text END AS amount_text,
    CASE WHEN lower(trim(name)) IN ('n/a', 'todo') THEN NULL ELSE name END AS name) FROM b),
r2 AS (SELECT * REPLACE (CASE WHEN regexp_matches(email, '{EMAIL}') THEN email END AS email) FROM r1),
v AS (SELECT 1 AS iteration, * FROM ({_count_failures('d')}) UNION ALL
  SELECT 2, * FROM ({_count_failures('r1')}) UNION ALL SELECT 3, * FROM ({_count_failures('r2')})),
w AS (SELECT iteration, CAST(f1 + f2 + f3 + f4 + f5 + f6 + f7 AS BIGINT) AS total_failures,
  CAST((f1 > 0) AS INT) + CAST((f2 > 0) AS INT) + CAST((f3 > 0) AS INT) + CAST((f4 > 0) AS INT)
    + CAST((f5 > 0) AS INT) + CAST((f6 > 0) AS INT) + CAST((f7 > 0) AS INT) AS failed_rules FROM v)"""


def _loop(spark, sf_dir):
    return run_loop(dirty(spark, sf_dir), LOOP_RULES, KEY, as_of=AS_OF, run_id="run")


@register("loop_iterations", f"""{_LOOP_SQL}
SELECT iteration, 7 AS total_rules, 7 - failed_rules AS passed_rules, failed_rules, total_failures,
  CASE WHEN iteration < 3 THEN 'fixes_applied' ELSE 'no_fixes' END AS status FROM w""")  # fmt: skip
def loop_iterations(spark, sf_dir):
    return _loop(spark, sf_dir).iterations.select(
        "iteration", "total_rules", "passed_rules", "failed_rules", "total_failures", "status"
    )


@register("loop_improvement", f"""{_LOOP_SQL}
SELECT 3 AS validations, i AS initial_failures, k AS final_failures, 'no_fixes' AS final_status,
  round((i - k) * 100.0 / i, 1) AS reduction_pct
FROM (SELECT max(total_failures) FILTER (WHERE iteration = 1) AS i,
  max(total_failures) FILTER (WHERE iteration = 3) AS k FROM w)""")  # fmt: skip
def loop_improvement(spark, sf_dir):
    return _loop(spark, sf_dir).improvement().drop("run_id")


@register("loop_final_rows", f"""{_LOOP_SQL}
SELECT row_key, customer_id, age, email, amount_text, name FROM r2""")  # fmt: skip
def loop_final_rows(spark, sf_dir):
    return _loop(spark, sf_dir).final.select("row_key", "customer_id", "age", "email", "amount_text", "name")


_ATTEMPTS_SQL = f"""{_LOOP_SQL},
attempts AS (
  SELECT 1 AS iteration, 'R1' AS rule_id, 'drop_missing' AS fix, (SELECT count(*) FROM d) - (SELECT count(*) FROM a) AS changed_rows
  UNION ALL SELECT 1, 'R2', 'drop_column_copies', (SELECT count(*) FROM a) - (SELECT count(*) FROM b)
  UNION ALL SELECT 1, 'R3', 'null_outside', (SELECT count(*) FROM b WHERE age < 0 OR age > 120)
  UNION ALL SELECT 1, 'R4', 'null_bad_addresses', (SELECT count(*) FROM b WHERE NOT regexp_matches(email, '@.*\\.'))
  UNION ALL SELECT 1, 'R5', 'null_non_numeric',
    (SELECT count(*) FROM b WHERE {_present('amount_text')} AND {_num('amount_text')} IS NULL)
  UNION ALL SELECT 1, 'R6', 'null_placeholders', (SELECT count(*) FROM b WHERE lower(trim(name)) IN ('n/a', 'todo'))
  UNION ALL SELECT 1, 'R7', 'none', 0
  UNION ALL SELECT 2, 'R4', 'null_invalid_email', (SELECT count(*) FROM r1 WHERE NOT regexp_matches(email, '{EMAIL}'))
  UNION ALL SELECT 2, 'R7', 'none', 0 UNION ALL SELECT 3, 'R7', 'none', 0)"""


@register("loop_attempts", f"""{_ATTEMPTS_SQL}
SELECT iteration, rule_id, fix, CAST(changed_rows AS BIGINT) AS changed_rows, changed_rows > 0 AS success,
  rule_id = 'R7' AS needs_review FROM attempts""")  # fmt: skip
def loop_attempts(spark, sf_dir):
    return _loop(spark, sf_dir).attempts.select(
        "iteration", "rule_id", "fix", "changed_rows", "success", "needs_review"
    )


@register("fix_summary", f"""{_ATTEMPTS_SQL}
SELECT count(*) AS total_fixes, count(*) FILTER (WHERE changed_rows > 0) AS successful,
  count(*) FILTER (WHERE changed_rows = 0) AS failed,
  'age,amount_text,country,customer_id,email,name' AS columns_fixed FROM attempts""")  # fmt: skip
def fix_summary(spark, sf_dir):
    found = repair.fix_summary(_loop(spark, sf_dir).attempts)
    return found.withColumn("columns_fixed", F.array_join("columns_fixed", ","))


@register("loop_typed", f"""
SELECT row_key, concat(customer_id, CASE WHEN rn > 1 THEN '_dup' ELSE '' END) AS customer_id,
  CASE WHEN regexp_matches(email, '{EMAIL}') THEN email END AS email
FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY row_key) AS rn FROM d)""")  # fmt: skip
def loop_typed(spark, sf_dir):
    """One round of the specific repairs only."""
    done = run_loop(dirty(spark, sf_dir), [LOOP_RULES[1], LOOP_RULES[3]], KEY, as_of=AS_OF, prefer="typed")
    return done.final.select("row_key", "customer_id", "email")


@register("repair_round", f"""{_LOOP_SQL} SELECT row_key, age, email, amount_text, name FROM r1""")
def repair_round(spark, sf_dir):
    """The repairs of one round, chosen rule by rule."""
    repaired, _ = loop.repair_round(dirty(spark, sf_dir), LOOP_RULES, KEY)
    return repaired.select("row_key", "age", "email", "amount_text", "name")
