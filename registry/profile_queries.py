"""Profiles, scores, explanations, suggestions and rule tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import suggest_rules
from plumbline.operators import explain, profile, reports, scoring
from plumbline.operators.quantiles import exact_quantiles
from plumbline.plans import rules as rule_tables
from plumbline.sources import files
from registry import expected
from registry.inputs import dirty, table, with_dirty
from registry.rule_queries import CASES, RULES, results_sql, run

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(query):
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return add


# ---- tables -----------------------------------------------------------------------------------------

DIRTY_COLUMNS = ["row_key", "customer_id", "name", "email", "age", "amount_text", "phone", "signup_date",
                 "end_date", "country", "currency", "salary"]
LINEITEM_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def _nulls(columns: list[str]) -> str:
    return " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in columns)


def _summary_sql(source: str, columns: list[str], numeric: list[str], text: list[str], date: list[str]) -> str:
    return f"""
SELECT total_rows, {len(columns)} AS total_columns, total_rows * {len(columns)} AS total_cells, null_count,
  round(null_count * 100.0 / (total_rows * {len(columns)}), 2) AS null_percentage,
  total_rows - (SELECT count(*) FROM (SELECT DISTINCT * FROM {source})) AS duplicated_rows,
  '{",".join(numeric)}' AS numeric_columns, '{",".join(text)}' AS text_columns, '{",".join(date)}' AS date_columns
FROM (SELECT count(*) AS total_rows, {_nulls(columns)} AS null_count FROM {source})"""


def _joined(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.array_join(n, ",") for n in names})


@register(
    "dataset_summary",
    with_dirty(
        _summary_sql("d", DIRTY_COLUMNS, ["row_key", "customer_id", "age", "salary"],
                     ["name", "email", "amount_text", "phone", "signup_date", "end_date", "country", "currency"], [])
    ),
)
def dataset_summary(spark, sf_dir):
    found = profile.dataset_summary(dirty(spark, sf_dir))
    return _joined(found, "numeric_columns", "text_columns", "date_columns")


@register(
    "dataset_summary_lineitem",
    _summary_sql("lineitem", LINEITEM_COLUMNS, LINEITEM_COLUMNS[:8], ["l_returnflag", "l_linestatus"], ["l_shipdate"]),
)
def dataset_summary_lineitem(spark, sf_dir):
    found = profile.dataset_summary(table(spark, sf_dir, "lineitem"))
    return _joined(found, "numeric_columns", "text_columns", "date_columns")


_DIRTY_TYPES = "bigint,bigint,string,string,bigint,string,string,string,string,string,string,double"


@register(
    "dataset_metadata",
    with_dirty(f"""
SELECT count(*) AS rows, {len(DIRTY_COLUMNS)} AS columns, '{",".join(DIRTY_COLUMNS)}' AS column_names,
  '{_DIRTY_TYPES}' AS dtypes, {_nulls(DIRTY_COLUMNS)} AS null_count,
  concat_ws(',', {", ".join(f"concat('{c}=', count(*) FILTER (WHERE {c} IS NULL))" for c in DIRTY_COLUMNS)})
    AS null_per_column,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS duplicated_rows
FROM d"""),
)
def dataset_metadata(spark, sf_dir):
    found = files.dataset_metadata(dirty(spark, sf_dir))
    pairs = F.transform(F.map_entries("null_per_column"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return _joined(found.withColumn("null_per_column", F.array_join(pairs, ",")), "column_names", "dtypes")


@register(
    "null_profile",
    with_dirty(
        " UNION ALL ".join(
            f"SELECT {i} AS position, '{c}' AS \"column\", '{t}' AS dtype, count(*) FILTER (WHERE {c} IS NULL) AS nulls "
            "FROM d"
            for i, (c, t) in enumerate(zip(DIRTY_COLUMNS, _DIRTY_TYPES.split(",")))
        )
    ),
)
def null_profile(spark, sf_dir):
    return profile.null_profile(dirty(spark, sf_dir))


# ---- columns ----------------------------------------------------------------------------------------


def _numeric_sql(source: str, c: str, dtype: str) -> str:
    return f"""
SELECT '{c}' AS "column", '{dtype}' AS dtype, count(*) FILTER (WHERE {c} IS NULL) AS null_count,
  round(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*), 2) AS null_percentage,
  count(DISTINCT {c}) AS unique_count, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
  round(avg({c}), 2) AS mean, CAST(quantile_cont({c}, 0.5) AS DOUBLE) AS median, round(stddev_samp({c}), 2) AS std
FROM {source}"""


@register("column_profile_numeric", with_dirty(_numeric_sql("d", "age", "bigint")))
def column_profile_numeric(spark, sf_dir):
    return profile.column_profile(dirty(spark, sf_dir), "age")


@register("column_profile_price", _numeric_sql("lineitem", "l_extendedprice", "double"))
def column_profile_price(spark, sf_dir):
    return profile.column_profile(table(spark, sf_dir, "lineitem"), "l_extendedprice")


def _text_sql(source: str, c: str) -> str:
    return f"""
SELECT '{c}' AS "column", 'string' AS dtype, count(*) FILTER (WHERE {c} IS NULL) AS null_count,
  round(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*), 2) AS null_percentage,
  count(DISTINCT {c}) AS unique_count, CAST(max(length({c})) AS INTEGER) AS max_length,
  CAST(min(length({c})) AS INTEGER) AS min_length,
  (SELECT string_agg(concat(v, '=', n), ';' ORDER BY n DESC, v) FROM
    (SELECT {c} AS v, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, v LIMIT 5))
    AS top_values
FROM {source}"""


def _flat_top(df: DataFrame) -> DataFrame:
    shown = F.transform("top_values", lambda x: F.concat(x["value"], F.lit("="), x["n"]))
    return df.withColumn("top_values", F.array_join(shown, ";"))


@register("column_profile_text", with_dirty(_text_sql("d", "country")))
def column_profile_text(spark, sf_dir):
    return _flat_top(profile.column_profile(dirty(spark, sf_dir), "country"))


@register("column_profile_documents", _text_sql("documents", "text"))
def column_profile_documents(spark, sf_dir):
    return _flat_top(profile.column_profile(table(spark, sf_dir, "documents"), "text"))


@register(
    "column_profile_date",
    """SELECT 'o_orderdate' AS "column", 'timestamp_ntz' AS dtype,
  count(*) FILTER (WHERE o_orderdate IS NULL) AS null_count, 0.0::DOUBLE AS null_percentage,
  count(DISTINCT o_orderdate) AS unique_count FROM orders""",
)
def column_profile_date(spark, sf_dir):
    return profile.column_profile(
        table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz")),
        "o_orderdate",
    )


@register(
    "top_values",
    """SELECT event_type AS value, count(*) AS n FROM events WHERE event_type IS NOT NULL
GROUP BY event_type ORDER BY n DESC, value LIMIT 5""",
)
def top_values(spark, sf_dir):
    return profile.top_values(table(spark, sf_dir, "events"), "event_type")


@register(
    "distinct_counts",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_values FROM lineitem" for c in LINEITEM_COLUMNS
    ),
)
def distinct_counts(spark, sf_dir):
    return profile.distinct_counts(table(spark, sf_dir, "lineitem"), LINEITEM_COLUMNS)


def _column_summary_sql(source: str, fields: list[tuple[str, str]], key: str) -> str:
    parts = []
    for i, (c, t) in enumerate(fields):
        numeric = t in ("bigint", "double", "int")
        stats = (
            f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 2) AS mean"
            if numeric
            else "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS mean"
        )
        parts.append(f"""SELECT {i} AS position, '{c}' AS "column", '{t}' AS dtype,
  count(*) - count({c}) AS nulls, round((count(*) - count({c})) * 100.0 / count(*), 1) AS null_pct,
  count(DISTINCT {c}) AS distinct_values, {stats},
  (SELECT string_agg(CAST(v AS VARCHAR), '|' ORDER BY k) FROM
    (SELECT {c} AS v, {key} AS k FROM {source} WHERE {c} IS NOT NULL ORDER BY {key} LIMIT 5)) AS samples
FROM {source}""")
    return " UNION ALL ".join(parts)


@register(
    "column_summary", with_dirty(_column_summary_sql("d", list(zip(DIRTY_COLUMNS, _DIRTY_TYPES.split(","))), "row_key"))
)
def column_summary(spark, sf_dir):
    return _joined_samples(profile.column_summary(dirty(spark, sf_dir), ["row_key"]))


@register(
    "column_summary_parts",
    _column_summary_sql(
        "part",
        [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"), ("p_size", "int"),
         ("p_retailprice", "double")],
        "p_partkey",
    ),
)
def column_summary_parts(spark, sf_dir):
    return _joined_samples(profile.column_summary(table(spark, sf_dir, "part"), ["p_partkey"]))


def _joined_samples(df: DataFrame) -> DataFrame:
    return df.withColumn("samples", F.array_join("samples", "|"))


@register(
    "exact_quantiles",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({p} AS DOUBLE) AS p, CAST(quantile_cont({c}, {p}) AS DOUBLE) AS value FROM lineitem"
        for c in ("l_quantity", "l_extendedprice")
        for p in (0.01, 0.25, 0.5, 0.75, 0.99)
    ),
)
def quantiles(spark, sf_dir):
    names, probs = ["l_quantity", "l_extendedprice"], (0.01, 0.25, 0.5, 0.75, 0.99)
    found = exact_quantiles(table(spark, sf_dir, "lineitem"), {n: F.col(n) for n in names}, probs)
    rows = [(n, p, v) for n in names for p, v in zip(probs, found[n])]
    return spark.createDataFrame(rows, "column STRING, p DOUBLE, value DOUBLE")


# ---- scores -----------------------------------------------------------------------------------------

_HEALTH = """
CASE WHEN n = 0 THEN 0 ELSE greatest(0, CAST(trunc(100.0 - least(40.0::DOUBLE, nulls / (n * 10) * 100 * 2)
  - least(20.0::DOUBLE, dups / n * 100 * 2) - least(40.0::DOUBLE, failed / n * 100 * 2)) AS INTEGER)) END"""


@register(
    "health_score",
    with_dirty(f"""
SELECT {_HEALTH} AS score FROM (SELECT CAST(count(*) AS DOUBLE) AS n, CAST({_nulls(DIRTY_COLUMNS)} AS DOUBLE) AS nulls,
  CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS DOUBLE) AS dups,
  (SELECT CAST(sum(failed_count) AS DOUBLE) FROM ({results_sql(CASES)})) AS failed FROM d)"""),
)
def health_score(spark, sf_dir):
    summary = profile.dataset_summary(dirty(spark, sf_dir))
    failed = reports.run_summary(run(spark, sf_dir).rule_results).select("total_failures").scalar()
    return summary.select(
        scoring.health_score(F.col("total_rows"), F.col("null_count"), F.col("duplicated_rows"), failed).alias("score")
    )


@register(
    "health_trend",
    f"""
WITH days AS (SELECT event_type, CAST(ts AS DATE) AS day, CAST(count(*) AS DOUBLE) AS n,
    CAST(count(*) FILTER (WHERE value < 1) AS DOUBLE) AS nulls,
    CAST(count(*) - count(DISTINCT user_id) AS DOUBLE) AS dups,
    CAST(count(*) FILTER (WHERE value > 50) AS DOUBLE) AS failed FROM events GROUP BY ALL),
s AS (SELECT event_type AS dataset_name, day, {_HEALTH} AS score FROM days)
SELECT dataset_name, CAST(day AS VARCHAR) AS day, score,
  score - lag(score) OVER (PARTITION BY dataset_name ORDER BY day) AS delta FROM s""",
)
def health_trend(spark, sf_dir):
    """Daily scores per event type: low values count as nulls, repeated users as copies, high ones as failures."""
    events = table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date"))
    days = events.groupBy(F.col("event_type").alias("dataset_name"), "day").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("value") < 1).alias("nulls"),
        (F.count(F.lit(1)) - F.count_distinct("user_id")).alias("dups"),
        F.count_if(F.col("value") > 50).alias("failed"),
    )
    score = scoring.health_score(F.col("n"), F.col("nulls"), F.col("dups"), F.col("failed"))
    runs = days.select(
        "dataset_name", F.col("day").alias("validation_timestamp"), F.col("day").cast("string").alias("run_id"),
        score.alias("score"),
    )
    return scoring.health_trend(runs).select("dataset_name", F.col("run_id").alias("day"), "score", "delta")


_SCORED_SQL = f"""
rates(rule_type, rate) AS (VALUES {expected.RATES}),
defaults(rule_type, base) AS (VALUES {expected.SEVERITIES}),
raw AS (SELECT r.*, CAST(coalesce(rates.rate, 0.75) AS DOUBLE) AS rate, defaults.base,
    CAST(failed_count AS DOUBLE) / greatest(total_rows, 1) AS share
  FROM res r LEFT JOIN rates USING (rule_type) LEFT JOIN defaults USING (rule_type)),
scored AS (SELECT *, CASE WHEN share > 0.5 AND severity = 'low' THEN 'medium'
    WHEN share > 0.8 AND severity = 'medium' THEN 'high' ELSE severity END AS adjusted,
  least(100, greatest(0, CAST(trunc((rate * 0.4::DOUBLE
    + CASE WHEN has_params THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END * 0.3::DOUBLE
    + (1.0::DOUBLE - share) * 0.3::DOUBLE) * 100) AS INTEGER))) AS confidence FROM raw)"""


@register(
    "severity_and_confidence",
    with_dirty(f"""
WITH res AS ({results_sql(CASES)}), {_SCORED_SQL}
SELECT rule_id, adjusted AS severity, confidence FROM scored"""),
)
def severity_and_confidence(spark, sf_dir):
    return scoring.scored(run(spark, sf_dir).rule_results).select("rule_id", "severity", "confidence")


# Scores of made-up rule outcomes, one per part: the rule type and the failure rate follow from the key.
_TYPES = [t for t, _, _ in expected.TYPE_SCORES]
_PART_RESULTS = f"""
SELECT concat('R', CAST(p_partkey AS STRING)) AS rule_id,
  CASE CAST(p_partkey % 31 AS INT) {" ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TYPES))} ELSE 'other' END
    AS rule_type,
  CASE p_size % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE NULL END AS severity,
  p_size % 2 = 0 AS has_params, CAST((p_partkey * 7919) % 1001 AS BIGINT) AS failed_count,
  CAST(CASE WHEN p_size = 50 THEN 0 ELSE 1000 END AS BIGINT) AS total_rows
FROM part"""


@register(
    "score_parts",
    f"""
WITH res AS (SELECT rule_id, rule_type, severity AS given, has_params, failed_count, total_rows FROM ({_PART_RESULTS})),
rates(rule_type, rate) AS (VALUES {expected.RATES}),
defaults(rule_type, base) AS (VALUES {expected.SEVERITIES}),
raw AS (SELECT res.*, CAST(coalesce(rate, 0.75) AS DOUBLE) AS rate, coalesce(given, base, 'medium') AS start,
    CASE WHEN total_rows > 0 THEN CAST(failed_count AS DOUBLE) / total_rows END AS share,
    CAST(failed_count AS DOUBLE) / greatest(total_rows, 1) AS uncovered
  FROM res LEFT JOIN rates USING (rule_type) LEFT JOIN defaults USING (rule_type))
SELECT rule_id, CASE WHEN share > 0.5 AND start = 'low' THEN 'medium'
    WHEN share > 0.8 AND start = 'medium' THEN 'high' ELSE start END AS severity,
  least(100, greatest(0, CAST(trunc((least(1.0::DOUBLE, rate + 0.1::DOUBLE) * 0.4::DOUBLE
    + CASE WHEN has_params THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END * 0.3::DOUBLE
    + (1.0::DOUBLE - uncovered) * 0.3::DOUBLE) * 100) AS INTEGER))) AS confidence FROM raw""",
)
def score_parts(spark, sf_dir):
    results = spark.sql(_PART_RESULTS.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))
    return scoring.scored(results, model=True).select("rule_id", "severity", "confidence")


# ---- explanations -------------------------------------------------------------------------------------


def _template_sql(n: int) -> str:
    """The template of a result row, with its fields filled in."""
    texts = [(kind, parts[n].replace(chr(39), chr(39) * 2)) for kind, *parts in expected.EXPLANATIONS]
    cases = " ".join(f"WHEN '{kind}' THEN '{text}'" for kind, text in texts[:-1])
    text = f"CASE rule_type {cases} ELSE '{texts[-1][1]}' END"
    for name, value in (("type", "rule_type"), ("column", "column_name"), ("failed", "CAST(failed_count AS VARCHAR)"),
                        ("min", "'0'"), ("max", "'120'")):
        text = f"replace({text}, '{{{name}}}', {value})"
    return text


_EXPLAINED_SQL = f"""SELECT position, rule_id, {_template_sql(0)} AS root_cause,
  concat('The ', rule_type, ' check on ''', column_name, ''' found ', failed_count, ' issues.') AS explanation,
  'Data quality issues may cause incorrect reporting or downstream errors.' AS business_impact,
  {_template_sql(1)} AS sql_fix, {_template_sql(2)} AS code_fix,
  concat('Add ', rule_type, ' validation at data ingestion.') AS prevention, 60 AS confidence,
  failed_count AS estimated_affected_rows, concat('Implement automated ', rule_type, ' checks.') AS permanent_fix
FROM res WHERE NOT passed"""
_EXPLAINED_COLUMNS = ["rule_id", "root_cause", "explanation", "business_impact", "sql_fix", "code_fix", "prevention",
                      "confidence", "estimated_affected_rows", "permanent_fix"]


@register(
    "explain_failures",
    with_dirty(f"WITH res AS ({results_sql(CASES)}) SELECT {', '.join(_EXPLAINED_COLUMNS)} FROM ({_EXPLAINED_SQL})"),
)
def explain_failures(spark, sf_dir):
    return explain.explain_failures(run(spark, sf_dir).rule_results, RULES).select(*_EXPLAINED_COLUMNS)


@register(
    "analyse_top5",
    with_dirty(f"""
WITH res AS ({results_sql(CASES)}), {_SCORED_SQL}
SELECT rule_id, rule_type, adjusted AS severity, confidence, failed_count FROM scored WHERE NOT passed
ORDER BY position LIMIT 5"""),
)
def analyse_top5(spark, sf_dir):
    found = explain.analyse_failures(run(spark, sf_dir).rule_results, RULES)
    return found.select("rule_id", "rule_type", "severity", "confidence", "failed_count")


_SOLUTIONS_SQL = f"""
WITH res AS ({results_sql(CASES)}), {_SCORED_SQL},
e AS ({_EXPLAINED_SQL}),
solutions AS (SELECT concat('S', lpad(CAST(row_number() OVER (ORDER BY e.position) AS VARCHAR), 3, '0')) AS id,
  1 AS iteration, e.rule_id, rule_type, column_name AS "column", e.root_cause, e.explanation, e.code_fix,
  scored.confidence, adjusted AS severity FROM e JOIN scored USING (rule_id))"""


def _solutions(spark, sf_dir) -> DataFrame:
    explained = explain.analyse_failures(run(spark, sf_dir).rule_results, RULES, top=None)
    return reports.solution_report(explained.withColumn("iteration", F.lit(1)))


@register("solution_report", with_dirty(f"{_SOLUTIONS_SQL} SELECT * FROM solutions"))
def solution_report(spark, sf_dir):
    return _solutions(spark, sf_dir)


@register(
    "report_statistics",
    with_dirty(f"""{_SOLUTIONS_SQL}
SELECT count(*) AS total_problems, (SELECT count(*) FROM solutions) AS total_solutions,
  count(*) FILTER (WHERE severity = 'high') AS high_severity,
  count(*) FILTER (WHERE severity = 'medium') AS medium_severity,
  count(*) FILTER (WHERE severity = 'low') AS low_severity,
  (SELECT avg(confidence) FROM solutions) AS average_confidence FROM res WHERE NOT passed"""),
)
def report_statistics(spark, sf_dir):
    outcome = run(spark, sf_dir)
    problems = reports.problem_report(outcome.rule_results, outcome.violations)
    return reports.report_statistics(problems, _solutions(spark, sf_dir))


# ---- suggested rules ------------------------------------------------------------------------------------


def _suggested(df: DataFrame, spark: SparkSession) -> DataFrame:
    found = suggest_rules(df).to_dataframe(spark)
    shown = F.transform(F.array_sort(F.map_entries("params")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.select("id", "column", "type", "severity", "description", F.array_join(shown, ";").alias("params"))


def _widened_sql(c: str, source: str) -> str:
    return (
        f"(SELECT concat('max=', round(max({c}) + (max({c}) - min({c})) / 10, 2)::DOUBLE, ';min=', "
        f"round(min({c}) - (max({c}) - min({c})) / 10, 2)::DOUBLE) FROM (SELECT {c}::DOUBLE AS {c} FROM {source}))"
    )


_PART_SUGGESTIONS = [
    ("p_partkey", "range", "medium", "Ensure p_partkey is within expected range", _widened_sql("p_partkey", "part")),
    ("p_partkey", "outlier", "medium", "Detect outliers in p_partkey", "''"),
    ("p_type", "allowed_values", "medium", "Ensure p_type has valid values",
     "(SELECT concat('values=[', string_agg(concat('\"', v, '\"'), ', ' ORDER BY v), ']') "
     "FROM (SELECT DISTINCT p_type AS v FROM part))"),
    ("p_size", "range", "medium", "Ensure p_size is within expected range", _widened_sql("p_size", "part")),
    ("p_size", "outlier", "medium", "Detect outliers in p_size", "''"),
    ("p_retailprice", "range", "medium", "Ensure p_retailprice is within expected range",
     _widened_sql("p_retailprice", "part")),
    ("p_retailprice", "positive", "high", "Ensure p_retailprice is positive", "''"),
    ("p_retailprice", "outlier", "medium", "Detect outliers in p_retailprice", "''"),
    ("_all", "duplicate_row", "high", "Check for duplicate rows", "''"),
]


@register(
    "suggest_rules_parts",
    " UNION ALL ".join(
        f"SELECT 'R{n:03d}' AS id, '{c}' AS \"column\", '{t}' AS type, '{s}' AS severity, '{d}' AS description, "
        f"{p} AS params"
        for n, (c, t, s, d, p) in enumerate(_PART_SUGGESTIONS, 1)
    ),
)
def suggest_rules_parts(spark, sf_dir):
    return _suggested(table(spark, sf_dir, "part"), spark)


def _missing_sql(c: str) -> str:
    """The severity of a `not_null` suggestion."""
    return f"(SELECT CASE WHEN count(*) FILTER (WHERE {c} IS NULL) > count(*) * 0.3 THEN 'high' ELSE 'medium' END FROM d)"


def _values_sql(c: str) -> str:
    return (
        f"(SELECT concat('values=[', string_agg(concat('\"', v, '\"'), ', ' ORDER BY v), ']') "
        f"FROM (SELECT DISTINCT {c} AS v FROM d WHERE {c} IS NOT NULL))"
    )


def _is_missing(c: str) -> tuple[str, str, str, str, str]:
    return (c, "not_null", _missing_sql(c), f"Ensure {c} is not null", "''")


def _in_range(c: str) -> tuple[str, str, str, str, str]:
    return (c, "range", "'medium'", f"Ensure {c} is within expected range", _widened_sql(c, "d"))


def _has_outliers(c: str) -> tuple[str, str, str, str, str]:
    return (c, "outlier", "'medium'", f"Detect outliers in {c}", "''")


_DIRTY_SUGGESTIONS = [
    _in_range("row_key"), _has_outliers("row_key"),
    _in_range("customer_id"), _has_outliers("customer_id"),
    _is_missing("name"),
    _is_missing("email"), ("email", "email", "'medium'", "Validate email format in email", "''"),
    _is_missing("age"), _in_range("age"), ("age", "range", "'high'", "Ensure age is valid", "'max=120;min=0'"),
    _has_outliers("age"),
    _is_missing("amount_text"), ("amount_text", "positive", "'high'", "Ensure amount_text is positive", "''"),
    _is_missing("phone"), ("phone", "phone", "'low'", "Validate phone format in phone", "''"),
    _is_missing("signup_date"), ("signup_date", "date", "'low'", "Validate date format in signup_date", "''"),
    _is_missing("end_date"), ("end_date", "date", "'low'", "Validate date format in end_date", "''"),
    _is_missing("country"),
    ("country", "allowed_values", "'medium'", "Ensure country has valid values", _values_sql("country")),
    ("currency", "allowed_values", "'medium'", "Ensure currency has valid values", _values_sql("currency")),
    _in_range("salary"), ("salary", "positive", "'high'", "Ensure salary is positive", "''"), _has_outliers("salary"),
    ("_all", "duplicate_row", "'high'", "Check for duplicate rows", "''"),
]


@register(
    "suggest_rules_dirty",
    with_dirty(
        " UNION ALL ".join(
            f"SELECT 'R{n:03d}' AS id, '{c}' AS \"column\", '{t}' AS type, {s} AS severity, '{d}' AS description, "
            f"{p} AS params"
            for n, (c, t, s, d, p) in enumerate(_DIRTY_SUGGESTIONS, 1)
        )
    ),
)
def suggest_rules_dirty(spark, sf_dir):
    return _suggested(dirty(spark, sf_dir), spark)


# ---- rules kept in a table --------------------------------------------------------------------------------

# One rule per part; some have no id, no column, an unknown type or an unknown severity.
RULE_TABLE_SQL = f"""
SELECT CASE WHEN p_partkey % 41 = 0 THEN NULL ELSE concat('R', CAST(p_partkey AS STRING)) END AS id,
  CASE p_size % 7 WHEN 0 THEN '' WHEN 1 THEN 'email' WHEN 2 THEN 'age' WHEN 3 THEN 'nowhere' WHEN 4 THEN 'name'
    ELSE p_brand END AS col,
  CASE CAST(p_partkey % 32 AS INT)
    {" ".join(f"WHEN {i} THEN '{t if i % 2 else t.upper()}'" for i, t in enumerate(_TYPES))}
    ELSE 'Sorted' END AS type,
  CASE p_partkey % 5 WHEN 0 THEN 'HIGH' WHEN 1 THEN NULL WHEN 2 THEN 'urgent' WHEN 3 THEN 'low' ELSE 'medium' END
    AS severity,
  p_name AS description, p_type AS dataset FROM part"""

_CHECKED_SQL = f"""
SELECT id, col AS "column", lower(type) AS type, lower(coalesce(severity, 'medium')) AS severity, description, dataset,
  CASE WHEN id IS NULL THEN 'missing keys: id'
    WHEN lower(type) NOT IN ({", ".join(f"'{t}'" for t in _TYPES)}) THEN concat('invalid type ''', lower(type), '''')
    WHEN lower(coalesce(severity, 'medium')) NOT IN ('low', 'medium', 'high')
      THEN concat('invalid severity ''', lower(severity), '''')
    WHEN col = '' THEN 'column name is empty' END AS error
FROM ({RULE_TABLE_SQL})"""


def _rule_table(spark, sf_dir) -> DataFrame:
    text = RULE_TABLE_SQL.replace("FROM part", "FROM {part}").replace(" AS col,", " AS column,")
    rules = spark.sql(text, part=table(spark, sf_dir, "part"))
    return rules.withColumn("params", F.expr("CAST(map() AS MAP<STRING,STRING>)"))


@register("rules_check", f'SELECT id, "column", type, severity, description, error FROM ({_CHECKED_SQL})')
def rules_check(spark, sf_dir):
    return rule_tables.check_rules(_rule_table(spark, sf_dir)).drop("params")


@register(
    "rules_errors",
    f'SELECT id, "column", type, severity, description, error FROM ({_CHECKED_SQL}) WHERE error IS NOT NULL',
)
def rules_errors(spark, sf_dir):
    return rule_tables.rule_errors(rule_tables.check_rules(_rule_table(spark, sf_dir))).drop("params")


_VALID_SQL = f'SELECT id, "column", type, severity, description FROM ({_CHECKED_SQL}) WHERE error IS NULL'


@register("rules_for_column", f"SELECT * FROM ({_VALID_SQL}) WHERE \"column\" = 'email'")
def rules_for_column(spark, sf_dir):
    checked = rule_tables.check_rules(_rule_table(spark, sf_dir))
    return rule_tables.select_rules(checked, column="email").drop("params")


@register("rules_of_type", f"SELECT * FROM ({_VALID_SQL}) WHERE type = 'outlier'")
def rules_of_type(spark, sf_dir):
    checked = rule_tables.check_rules(_rule_table(spark, sf_dir))
    return rule_tables.select_rules(checked, rule_type="outlier").drop("params")


@register("rules_with_severity", f"SELECT * FROM ({_VALID_SQL}) WHERE severity = 'high'")
def rules_with_severity(spark, sf_dir):
    checked = rule_tables.check_rules(_rule_table(spark, sf_dir))
    return rule_tables.select_rules(checked, severity="high").drop("params")


@register(
    "rules_summary",
    f"""WITH c AS ({_CHECKED_SQL}), v AS (SELECT * FROM c WHERE error IS NULL)
SELECT 'type' AS measure, type AS name, count(*) AS n FROM v GROUP BY type
UNION ALL SELECT 'severity', severity, count(*) FROM v GROUP BY severity
UNION ALL SELECT 'column', "column", count(*) FROM v GROUP BY "column"
UNION ALL SELECT 'total', 'rules', count(*) FROM v
UNION ALL SELECT 'total', 'errors', count(*) FROM c WHERE error IS NOT NULL""",
)
def rules_summary(spark, sf_dir):
    return rule_tables.rules_summary(rule_tables.check_rules(_rule_table(spark, sf_dir)))


@register(
    "rule_lines",
    f"""SELECT id, concat('[', id, '] ', "column", ' → ', type, ' (', severity, ')') AS line FROM ({_VALID_SQL})""",
)
def rule_lines(spark, sf_dir):
    checked = rule_tables.check_rules(_rule_table(spark, sf_dir))
    return rule_tables.rule_lines(rule_tables.select_rules(checked))


@register(
    "rule_coverage",
    f"""
WITH r AS (SELECT DISTINCT dataset, col FROM ({RULE_TABLE_SQL})),
have AS (SELECT DISTINCT p_type AS dataset, CASE WHEN p_size > 25 THEN p_brand ELSE 'rest' END AS col FROM part),
f AS (SELECT r.dataset, r.col, have.col IS NOT NULL AS found FROM r
  LEFT JOIN have ON r.dataset = have.dataset AND r.col = have.col),
c AS (SELECT dataset, count(*) FILTER (WHERE found) AS matching, count(*) FILTER (WHERE NOT found) AS absent
  FROM f GROUP BY dataset)
SELECT *, CASE WHEN absent = 0 THEN 'ok' WHEN matching = 0 THEN 'error' ELSE 'warning' END AS verdict FROM c""",
)
def rule_coverage(spark, sf_dir):
    """Each part type is a dataset; the brands of its larger parts are columns, smaller parts share one."""
    have = table(spark, sf_dir, "part").select(
        F.col("p_type").alias("dataset"),
        F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise("rest").alias("column"),
    )
    return rule_tables.rule_coverage(_rule_table(spark, sf_dir), have)
