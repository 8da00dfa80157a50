"""The run history, file input and output, and text functions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import History, Rule, run_loop, validate
from plumbline.functions import mailbox, salvage
from plumbline.operators import explain
from plumbline.sources import files, history
from plumbline.sources.storage import scratch_path
from registry import expected
from registry.inputs import AS_OF, dirty, table, with_dirty
from registry.rule_queries import CASES, EMAIL, RULES, results_sql, run

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(query):
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return add


# ---- a history with one run per order -----------------------------------------------------------------
#
# Every order is a run, every line a rule result, every event an e-mail verdict. The texts run in both engines.

RUNS_SQL = """
SELECT concat('run-', CAST(o_orderkey AS STRING)) AS run_id, o_orderpriority AS dataset_name,
  CAST(floor(o_totalprice) AS BIGINT) AS total_rows, 10 AS total_columns, CAST(30 AS BIGINT) AS total_rules,
  CAST(o_custkey % 31 AS BIGINT) AS passed_rules, CAST(30 - o_custkey % 31 AS BIGINT) AS failed_rules,
  CAST((30 - o_custkey % 31) * 7 AS BIGINT) AS total_failures,
  CASE WHEN o_custkey % 31 = 30 THEN 'passed' ELSE 'failed' END AS overall_status,
  CAST(o_orderdate AS TIMESTAMP) AS validation_timestamp FROM orders"""
RESULTS_SQL = """
SELECT concat('run-', CAST(l_orderkey AS STRING)) AS run_id,
  concat('R', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING)) AS rule_id,
  l_returnflag AS column_name, l_linestatus AS rule_type, 'medium' AS severity, l_quantity > 25 AS passed,
  CAST(100 AS BIGINT) AS total_rows, CAST(100 - CASE WHEN l_quantity > 25 THEN 0 ELSE l_quantity END AS BIGINT)
    AS passed_count,
  CAST(CASE WHEN l_quantity > 25 THEN 0 ELSE l_quantity END AS BIGINT) AS failed_count FROM lineitem"""
SAMPLES_SQL = """
SELECT concat('run-', CAST(l_orderkey AS STRING)) AS run_id,
  concat('R', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING)) AS rule_id, l_returnflag AS column_name,
  l_linenumber AS sample_no, CAST(l_suppkey AS STRING) AS row_key, CAST(l_partkey AS STRING) AS value,
  concat('Row ', CAST(l_suppkey AS STRING), ' failed') AS reason FROM lineitem"""
ROUNDS_SQL = """
SELECT concat('run-', CAST(o_orderkey AS STRING)) AS run_id, CAST(1 + o_custkey % 3 AS INT) AS iteration,
  20 AS passed_rules, 10 AS failed_rules, CAST(o_custkey AS BIGINT) AS total_failures, 9 AS fixes_attempted,
  8 AS fixes_applied, 'fixes_applied' AS status FROM orders"""
EXPLAINED_SQL = """
SELECT concat('run-', CAST(o_orderkey AS STRING)) AS run_id, concat('R', CAST(o_custkey AS STRING)) AS rule_id,
  o_orderstatus AS rule_type, o_orderpriority AS column_name, 'cause' AS root_cause, 'why' AS explanation,
  'impact' AS business_impact, 'guard' AS prevention, 'high' AS severity, 60 AS confidence,
  CAST(o_custkey AS BIGINT) AS estimated_affected_rows, 'forever' AS permanent_fix, 'template' AS provider,
  CASE WHEN o_custkey % 2 = 0 THEN 'DELETE' ELSE '' END AS sql_fix, CAST(NULL AS STRING) AS code_fix FROM orders"""


def _rows(spark: SparkSession, sf_dir: str, sql: str, source: str) -> DataFrame:
    text = sql.replace("{", "{{").replace("}", "}}").replace(f"FROM {source}", "FROM {src}")
    return spark.sql(text, src=table(spark, sf_dir, source))


def _runs(spark, sf_dir) -> DataFrame:
    runs = _rows(spark, sf_dir, RUNS_SQL, "orders")
    return runs.withColumn("metadata", F.expr("CAST(map() AS MAP<STRING,STRING>)"))


def _new_store(spark: SparkSession) -> History:
    return History(spark, scratch_path(spark, "history"))


_STORES: dict[tuple[str, str], History] = {}


def _filled(spark: SparkSession, sf_dir: str) -> History:
    """The store that the reading queries share; queries that change a store fill their own."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        store = _new_store(spark)
        _fill(store, spark, sf_dir)
        _STORES[key] = store
    return _STORES[key]


def _fill(store: History, spark: SparkSession, sf_dir: str) -> None:
    store.append("validation_runs", _runs(spark, sf_dir))
    store.save_results(_rows(spark, sf_dir, RESULTS_SQL, "lineitem"))
    store.save_failed_records(_rows(spark, sf_dir, SAMPLES_SQL, "lineitem"))
    store.save_iterations(_rows(spark, sf_dir, ROUNDS_SQL, "orders"))
    store.save_analyses(_rows(spark, sf_dir, EXPLAINED_SQL, "orders"))
    verdicts = table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@"), "event_type").alias("email")
    )
    store.save_email_verdicts(verdicts.withColumn("verdict", mailbox.verify_email(F.col("email"))))


@register("history_save_run", f"SELECT * REPLACE (CAST(validation_timestamp AS VARCHAR)[:10] AS validation_timestamp) FROM ({RUNS_SQL})")
def history_save_run(spark, sf_dir):
    saved = _filled(spark, sf_dir).table("validation_runs").drop("metadata")
    return saved.withColumn("validation_timestamp", F.col("validation_timestamp").cast("date").cast("string"))


@register("history_save_results", f"""
SELECT concat(run_id, ':', rule_id) AS result_id, run_id, rule_id, column_name, rule_type AS validation_type, severity,
  0 AS confidence_score, passed, total_rows, passed_count, failed_count AS failed_rows,
  CAST([] AS VARCHAR[]) AS failed_keys, CAST([] AS VARCHAR[]) AS error_details FROM ({RESULTS_SQL})""")  # fmt: skip
def history_save_results(spark, sf_dir):
    return _filled(spark, sf_dir).table("validation_results")


@register("history_save_failed_records", f"""
SELECT concat(run_id, ':', rule_id, ':', sample_no) AS record_id, run_id, concat(run_id, ':', rule_id) AS result_id,
  rule_id, column_name, sample_no, row_key, value AS invalid_value, reason AS failure_reason
FROM ({SAMPLES_SQL})""")  # fmt: skip
def history_save_failed_records(spark, sf_dir):
    return _filled(spark, sf_dir).table("failed_records")


@register("history_save_analyses", f"""
SELECT run_id, concat(run_id, ':', rule_id) AS result_id, rule_id, rule_type AS validation_type, column_name,
  root_cause, explanation, business_impact, prevention AS recommendation, severity, confidence AS confidence_score,
  estimated_affected_rows, permanent_fix, provider FROM ({EXPLAINED_SQL})""")  # fmt: skip
def history_save_analyses(spark, sf_dir):
    return _filled(spark, sf_dir).table("ai_analysis").drop("analysis_id", "created_at")


_REMEDIES_SQL = f"""
SELECT run_id, concat(run_id, ':', rule_id) AS result_id, rule_id, rule_type AS validation_type, column_name, sql_fix,
  code_fix, confidence AS confidence_score, FALSE AS fix_applied FROM ({EXPLAINED_SQL})
WHERE coalesce(sql_fix, '') <> '' OR coalesce(code_fix, '') <> ''"""


@register("history_save_remediations", _REMEDIES_SQL)
def history_save_remediations(spark, sf_dir):
    return _filled(spark, sf_dir).table("remediation_suggestions").drop("remediation_id", "created_at")


@register("history_save_iterations", f"""
SELECT concat(run_id, ':', iteration) AS iteration_id, run_id, iteration AS iteration_number,
  concat('Iteration ', iteration, ': ', status) AS action_taken, passed_rules, failed_rules, total_failures,
  fixes_applied, status AS validation_status FROM ({ROUNDS_SQL})""")  # fmt: skip
def history_save_iterations(spark, sf_dir):
    return _filled(spark, sf_dir).table("agent_iterations").drop("timestamp", "details")


@register("history_save_email_verdicts", """
SELECT concat('u', user_id, '@', event_type) AS email, 'unavailable' AS api_status, FALSE AS is_valid,
  40 AS confidence_score FROM events""")  # fmt: skip
def history_save_email_verdicts(spark, sf_dir):
    saved = _filled(spark, sf_dir).table("api_validation_results")
    return saved.select("email", "api_status", "is_valid", "confidence_score")


@register("history_update_status", f"""
SELECT run_id, CASE WHEN passed_rules > 15 THEN 'archived' ELSE overall_status END AS overall_status
FROM ({RUNS_SQL})""")  # fmt: skip
def history_update_status(spark, sf_dir):
    """Two changes of status for the better runs: the last one counts."""
    store = _new_store(spark)
    store.append("validation_runs", _runs(spark, sf_dir))
    better = F.col("passed_rules") > 15
    store.change_rows("validation_runs", better, "overall_status", F.lit("reviewed"))
    store.change_rows("validation_runs", better, "overall_status", F.lit("archived"))
    return store.table("validation_runs").select("run_id", "overall_status")


@register("history_mark_applied", f"""
SELECT run_id, rule_id, confidence_score, rule_id LIKE '%4' AS fix_applied FROM ({_REMEDIES_SQL})""")  # fmt: skip
def history_mark_applied(spark, sf_dir):
    store = _new_store(spark)
    store.save_analyses(_rows(spark, sf_dir, EXPLAINED_SQL, "orders"))
    store.change_rows("remediation_suggestions", F.col("rule_id").like("%4"), "fix_applied", F.lit(True))
    return store.table("remediation_suggestions").select("run_id", "rule_id", "confidence_score", "fix_applied")


@register("history_recent_runs", f"""
SELECT run_id, dataset_name, total_rows, overall_status FROM ({RUNS_SQL})
ORDER BY validation_timestamp DESC, run_id LIMIT 20""")  # fmt: skip
def history_recent_runs(spark, sf_dir):
    return _filled(spark, sf_dir).recent_runs().select("run_id", "dataset_name", "total_rows", "overall_status")


_NEWEST = f"(SELECT run_id FROM ({RUNS_SQL}) ORDER BY validation_timestamp DESC, run_id LIMIT 1)"


def _newest(store: History) -> str:
    return store.recent_runs(1).first()["run_id"]


@register("history_run_details", f"""
SELECT 'validation_runs' AS part, run_id AS key, dataset_name AS what FROM ({RUNS_SQL}) WHERE run_id = {_NEWEST}
UNION ALL SELECT 'validation_results', concat(run_id, ':', rule_id), column_name FROM ({RESULTS_SQL}) WHERE run_id = {_NEWEST}
UNION ALL SELECT 'failed_records', concat(run_id, ':', rule_id, ':', sample_no), value FROM ({SAMPLES_SQL}) WHERE run_id = {_NEWEST}
UNION ALL SELECT 'ai_analysis', concat(run_id, ':', rule_id, ':0'), root_cause FROM ({EXPLAINED_SQL}) WHERE run_id = {_NEWEST}
UNION ALL SELECT 'remediation_suggestions', concat(run_id, ':', rule_id, ':0'), sql_fix FROM ({_REMEDIES_SQL}) WHERE run_id = {_NEWEST}
UNION ALL SELECT 'agent_iterations', concat(run_id, ':', iteration), status FROM ({ROUNDS_SQL}) WHERE run_id = {_NEWEST}""")  # fmt: skip
def history_run_details(spark, sf_dir):
    """Everything recorded for the newest run, row by row."""
    store = _filled(spark, sf_dir)
    shown = {
        "validation_runs": "dataset_name", "validation_results": "column_name", "failed_records": "invalid_value",
        "ai_analysis": "root_cause", "remediation_suggestions": "sql_fix", "agent_iterations": "validation_status",
    }
    parts = [
        rows.select(F.lit(name).alias("part"), F.col(history.KEYS[name]).alias("key"), F.col(shown[name]).alias("what"))
        for name, rows in store.run_details(_newest(store)).items()
    ]
    return reduce(DataFrame.unionAll, parts)


@register("history_run_overview", f"""
SELECT n.run_id, coalesce(a.k, 0) AS results, coalesce(b.k, 0) AS failed_records, coalesce(c.k, 0) AS iterations
FROM ({RUNS_SQL}) n LEFT JOIN (SELECT run_id, count(*) AS k FROM ({RESULTS_SQL}) GROUP BY run_id) a USING (run_id)
LEFT JOIN (SELECT run_id, count(*) AS k FROM ({SAMPLES_SQL}) GROUP BY run_id) b USING (run_id)
LEFT JOIN (SELECT run_id, count(*) AS k FROM ({ROUNDS_SQL}) GROUP BY run_id) c USING (run_id)""")  # fmt: skip
def history_run_overview(spark, sf_dir):
    store = _filled(spark, sf_dir)
    found = history.run_overview({n: store.table(n) for n in ("validation_runs", *history.CHILDREN)})
    return found.select(
        "run_id", F.col("validation_results").alias("results"), "failed_records",
        F.col("agent_iterations").alias("iterations"),
    )


@register("history_analyses", f"SELECT run_id, rule_id FROM ({EXPLAINED_SQL}) WHERE run_id = {_NEWEST}")
def history_analyses(spark, sf_dir):
    store = _filled(spark, sf_dir)
    return store.analyses(_newest(store)).select("run_id", "rule_id")


_ID = "concat(run_id, ':', rule_id, ':0')"


@register("history_recent_analyses", f"""
SELECT {_ID} AS analysis_id, root_cause FROM ({EXPLAINED_SQL}) ORDER BY analysis_id LIMIT 50""")  # fmt: skip
def history_recent_analyses(spark, sf_dir):
    """All were written at the same time: the first by id."""
    return _filled(spark, sf_dir).analyses().select("analysis_id", "root_cause")


@register("history_recent_remediations", f"""
SELECT {_ID} AS remediation_id, sql_fix FROM ({_REMEDIES_SQL}) ORDER BY remediation_id LIMIT 50""")  # fmt: skip
def history_recent_remediations(spark, sf_dir):
    return _filled(spark, sf_dir).remediations().select("remediation_id", "sql_fix")


@register("history_recent_iterations", f"""
SELECT concat(run_id, ':', iteration) AS iteration_id, status AS validation_status FROM ({ROUNDS_SQL})
ORDER BY iteration_id LIMIT 50""")  # fmt: skip
def history_recent_iterations(spark, sf_dir):
    return _filled(spark, sf_dir).iterations().select("iteration_id", "validation_status")


@register("history_remediations", f"SELECT run_id, rule_id, sql_fix FROM ({_REMEDIES_SQL}) WHERE run_id = {_NEWEST}")
def history_remediations(spark, sf_dir):
    store = _filled(spark, sf_dir)
    return store.remediations(_newest(store)).select("run_id", "rule_id", "sql_fix")


@register("history_iterations", f"SELECT run_id, iteration AS iteration_number FROM ({ROUNDS_SQL}) WHERE run_id = {_NEWEST}")
def history_iterations(spark, sf_dir):
    store = _filled(spark, sf_dir)
    return store.iterations(_newest(store)).select("run_id", "iteration_number")


@register("history_email_verdicts", """
SELECT concat('u', user_id, '@', event_type) AS email, 'unavailable' AS api_status FROM events
ORDER BY sha256(concat('u', user_id, '@', event_type)) LIMIT 50""")
def history_email_verdicts(spark, sf_dir):
    return _filled(spark, sf_dir).email_verdicts().select("email", "api_status")


@register("history_failed_records", f"""
SELECT rule_id, sample_no, value AS invalid_value FROM ({SAMPLES_SQL}) WHERE run_id = {_NEWEST}
ORDER BY rule_id, sample_no""")  # fmt: skip
def history_failed_records(spark, sf_dir):
    store = _filled(spark, sf_dir)
    return store.failed_records(_newest(store)).select("rule_id", "sample_no", "invalid_value")


@register("history_delete", f"""
SELECT (SELECT count(*) FROM ({RUNS_SQL}) WHERE overall_status <> 'passed') AS runs,
  (SELECT count(*) FROM ({RESULTS_SQL}) r JOIN ({RUNS_SQL}) n USING (run_id) WHERE overall_status <> 'passed') AS results,
  (SELECT count(*) FROM ({ROUNDS_SQL}) r JOIN ({RUNS_SQL}) n USING (run_id) WHERE overall_status <> 'passed') AS iterations,
  (SELECT count(*) FROM events) AS verdicts""")  # fmt: skip
def history_delete(spark, sf_dir):
    """All passed runs are deleted and the store is compacted; e-mail verdicts stay."""
    store = _new_store(spark)
    _fill(store, spark, sf_dir)
    store.delete_runs(store.table("validation_runs").filter("overall_status = 'passed'"))
    kept = store.compact(scratch_path(spark, "history"))

    def size(name: str):
        return kept._stored(name).agg(F.count(F.lit(1)).alias("n")).scalar()

    return kept._stored("validation_runs").agg(F.count(F.lit(1)).alias("runs")).select(
        "runs", size("validation_results").alias("results"), size("agent_iterations").alias("iterations"),
        size("api_validation_results").alias("verdicts"),
    )


_STATS_SQL = f"""
SELECT count(*) AS validation_runs, (SELECT count(*) FROM lineitem) AS validation_results,
  (SELECT count(*) FROM lineitem) AS failed_records, (SELECT count(*) FROM orders) AS ai_analysis,
  (SELECT count(*) FROM ({_REMEDIES_SQL})) AS remediation_suggestions, (SELECT count(*) FROM orders) AS agent_iterations,
  (SELECT count(*) FROM events) AS api_validation_results,
  CAST(sum(passed_rules) + sum(failed_rules) AS BIGINT) AS total_rules_checked,
  round(sum(passed_rules) * 100.0 / greatest(1, sum(passed_rules) + sum(failed_rules)), 1) AS pass_rate
FROM ({RUNS_SQL})"""


@register("history_statistics", _STATS_SQL)
def history_statistics(spark, sf_dir):
    return _filled(spark, sf_dir).statistics()


@register("history_clear", "SELECT count(*) AS before, 0 AS after FROM orders")
def history_clear(spark, sf_dir):
    store = _new_store(spark)
    store.append("validation_runs", _runs(spark, sf_dir))
    before = store.table("validation_runs").count()
    store.clear()
    after = store.table("validation_runs").agg(F.count(F.lit(1)).cast("int").alias("after"))
    return after.select(F.lit(before).cast("bigint").alias("before"), "after")


@register("history_whole_run", with_dirty(f"""
WITH res AS ({results_sql(CASES)})
SELECT (SELECT count(*) FROM d) AS total_rows, count(*) AS total_rules, count(*) FILTER (WHERE passed) AS passed_rules,
  CAST(sum(failed_count) AS BIGINT) AS total_failures, 'failed' AS overall_status,
  CAST(sum(failed_count) AS BIGINT) AS failed_records, count(*) FILTER (WHERE NOT passed) AS analyses
FROM res"""))  # fmt: skip
def history_whole_run(spark, sf_dir):
    """A validation of the dirty customers, saved with all its violations and explanations."""
    store, outcome = _new_store(spark), run(spark, sf_dir)
    store.save_run("customers", outcome.rule_results, outcome.violations, total_columns=12, run_id="run")
    store.save_analyses(explain.analyse_failures(outcome.rule_results, RULES, top=None))

    def size(name: str):
        return store.table(name).agg(F.count(F.lit(1)).alias("n")).scalar()

    return store.table("validation_runs").select(
        "total_rows", "total_rules", "passed_rules", "total_failures", "overall_status",
        size("failed_records").alias("failed_records"), size("ai_analysis").alias("analyses"),
    )


# ---- files --------------------------------------------------------------------------------------------

_TOKENS = ", ".join(f"'{t}'" for t in expected.NO_VALUE_SPELLINGS)
_TEXTS = ["name", "email", "amount_text", "phone", "signup_date", "end_date", "country", "currency"]
_NULLED = ", ".join(f"CASE WHEN {c} NOT IN ({_TOKENS}) THEN {c} END AS {c}" for c in _TEXTS)


@register("csv_null_tokens", with_dirty(f"SELECT * REPLACE ({_NULLED}) FROM d"))
def csv_null_tokens(spark, sf_dir):
    return files.null_tokens_to_null(dirty(spark, sf_dir))


@register("csv_roundtrip", with_dirty(f"SELECT * REPLACE ({_NULLED}) FROM d"))
def csv_roundtrip(spark, sf_dir):
    """Written as CSV, then read back with detected separator, encoding and types."""
    path = scratch_path(spark, "csv")
    files.write_csv(dirty(spark, sf_dir), path)
    return files.read_csv(spark, path)


@register("csv_semicolon", "SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part")
def csv_semicolon(spark, sf_dir):
    """Another separator and encoding, found from the file."""
    path = scratch_path(spark, "csv")
    part = table(spark, sf_dir, "part")
    part.write.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").csv(path)
    return files.read_csv(spark, path)


_SUFFIXES = {"UTF-8": "é€日", "ISO-8859-1": "éÿ£", "windows-1252": "é€“”"}
_MIXED = "CASE p_partkey % 3 WHEN 0 THEN 'é€日' WHEN 1 THEN 'éÿ£' ELSE 'é€“”' END"


def _mixed_folder(spark, sf_dir) -> str:
    """The parts in one folder, a third of them in each of three encodings."""
    path, part = scratch_path(spark, "csv"), table(spark, sf_dir, "part")
    for k, (encoding, suffix) in enumerate(_SUFFIXES.items()):
        rows = part.filter(F.col("p_partkey") % 3 == k).select("p_partkey", F.concat("p_name", F.lit(suffix)).alias("name"), "p_size")
        if encoding == files.WINDOWS:  # its bytes from 0x80 to 0x9F, written as those of Latin-1
            rows, encoding = rows.withColumn("name", F.translate("name", "€“”", "\x80\x93\x94")), "ISO-8859-1"
        rows.write.mode("append").option("header", True).option("encoding", encoding).csv(path)
    return path


@register("csv_mixed_encodings", f"SELECT p_partkey, concat(p_name, {_MIXED}) AS name, CAST(p_size AS BIGINT) AS p_size FROM part")
def csv_mixed_encodings(spark, sf_dir):
    """Every file of a folder is read in its own encoding."""
    return files.read_csv(spark, _mixed_folder(spark, sf_dir))


@register("csv_file_formats", f"""
SELECT CASE p_partkey % 3 WHEN 0 THEN 'UTF-8' WHEN 1 THEN 'ISO-8859-1' ELSE 'windows-1252' END AS encoding, count(*) AS rows, false AS multiline
FROM part GROUP BY 1""")
def csv_file_formats(spark, sf_dir):
    """The rows by encoding: all lines but a header in each file."""
    found = files.file_formats(spark, _mixed_folder(spark, sf_dir)).groupBy("encoding")
    return found.agg(F.sum(F.col("lines") - 1).alias("rows"), F.bool_or("multiline").alias("multiline"))


@register("csv_malformed_rows", """
SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, concat(p_partkey, ',', p_brand, CASE WHEN p_partkey % 10 = 3 THEN '' ELSE concat(',', p_size, ',more') END) AS value
FROM part WHERE p_partkey % 10 IN (3, 7)""")
def csv_malformed_rows(spark, sf_dir):
    """Lines with too few or too many values, as violations of a rule."""
    path, part = scratch_path(spark, "csv"), table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    line = F.concat_ws(",", "p_partkey", "p_brand", F.when(key % 10 != 3, F.col("p_size")), F.when(key % 10 == 7, F.lit("more")))
    header = spark.createDataFrame([("p_partkey,p_brand,p_size",)], "line STRING")
    header.unionAll(part.select(line.alias("line"))).coalesce(1).write.text(path)
    rows = files.read_csv(spark, path, malformed_column="line").withColumn("line", F.coalesce("line", F.lit("")))
    found = validate(rows, [Rule("M", "line", "max_length", "high", params={"max_length": 0})], key=["p_partkey"]).violations
    return found.select(F.col("row_key.p_partkey").cast("string").alias("p_partkey"), "value")


@register("csv_infer", with_dirty("""
SELECT * FROM (VALUES ('row_key', 'bigint'), ('customer_id', 'bigint'), ('name', 'string'), ('email', 'string'),
  ('age', 'bigint'), ('amount_text', 'string'), ('phone', 'string'), ('signup_date', 'string'), ('end_date', 'string'),
  ('country', 'string'), ('currency', 'string'), ('salary', 'double')) AS t("column", dtype)"""))  # fmt: skip
def csv_infer(spark, sf_dir):
    data = dirty(spark, sf_dir)
    found = files.infer_types(data.select(*[F.col(c).cast("string") for c in data.columns]))
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in found], "column STRING, dtype STRING")


@register("csv_documents", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_documents(spark, sf_dir):
    """Whole texts with line breaks and quotes survive the round trip."""
    path = scratch_path(spark, "csv")
    documents = table(spark, sf_dir, "documents")
    files.write_csv(documents, path)
    return files.read_csv(spark, path, null_tokens=[])


@register("parquet_scan", "SELECT o_orderstatus, count(*) AS n, sum(o_custkey)::BIGINT AS s FROM orders GROUP BY ALL")
def parquet_scan(spark, sf_dir):
    orders = files.read_parquet(spark, f"{sf_dir}/orders.parquet")
    return orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("s"))


@register("json_report", with_dirty(f"""
SELECT rule_id, failed_count, passed FROM ({results_sql(CASES)})"""))  # fmt: skip
def json_report(spark, sf_dir):
    path = scratch_path(spark, "report")
    files.write_report(run(spark, sf_dir).rule_results, path)
    return spark.read.json(path).select("rule_id", "failed_count", "passed")


@register("preview", "SELECT * FROM events ORDER BY event_id LIMIT 50")
def preview(spark, sf_dir):
    return files.preview(table(spark, sf_dir, "events"), ["event_id"])


@register("safe_sample", "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 5")
def safe_sample(spark, sf_dir):
    return files.safe_sample(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", "text")


@register("generated_row_key", """
SELECT count(*) AS total_rows, CAST(count(*) - count(DISTINCT o_custkey) AS BIGINT) AS failed_rows FROM orders""")  # fmt: skip
def generated_row_key(spark, sf_dir):
    """Rows without a key of their own are told apart by where they are stored."""
    from plumbline.sources.row_keys import with_row_key

    keyed = with_row_key(table(spark, sf_dir, "orders"))
    found = validate(keyed, [Rule("R1", "o_custkey", "unique")], key=["row_file", "row_index"]).violations
    total = keyed.select("row_file", "row_index").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    return found.select("row_key").distinct().agg(F.count(F.lit(1)).alias("failed_rows")).select(
        total.alias("total_rows"), "failed_rows"
    )


# ---- text -----------------------------------------------------------------------------------------------

# The JSON of an event as a model might return it: bare, fenced, inside prose, with a trailing comma, or not at all.
_REPLY_SQL = """
SELECT event_id, event_type, value, CASE CAST(event_id % 6 AS INT)
  WHEN 0 THEN concat('{"root_cause": "', event_type, '", "confidence": ', CAST(user_id AS STRING), '}')
  WHEN 1 THEN concat('```json', chr(10), '{"root_cause": "', event_type, '", "sql_fix": "DELETE"}', chr(10), '```')
  WHEN 2 THEN concat('Here it is: {"root_cause": "', event_type, '", "confidence": 85, "sql_fix": "DELETE",} Bye.')
  WHEN 3 THEN concat('{"root_cause": "', event_type, chr(10), 'again", "confidence": -3}')
  WHEN 4 THEN concat('no object for ', event_type) ELSE concat('  ', props, '  ') END AS reply FROM events"""


@register("json_salvage", f"""
SELECT event_id, CASE event_id % 6 WHEN 4 THEN FALSE ELSE TRUE END AS found,
  CASE event_id % 6 WHEN 3 THEN concat(event_type, ' again') WHEN 4 THEN NULL
    WHEN 5 THEN 'Unable to determine root cause' ELSE event_type END AS root_cause,
  CASE event_id % 6 WHEN 0 THEN CAST(least(100, user_id) AS INT) WHEN 2 THEN 85 WHEN 3 THEN 0 WHEN 4 THEN NULL
    ELSE 70 END AS confidence,
  CASE event_id % 6 WHEN 1 THEN 'DELETE' WHEN 2 THEN 'DELETE' WHEN 4 THEN NULL ELSE '-- Fix for value range' END AS sql_fix,
  CASE event_id % 6 WHEN 4 THEN NULL ELSE left(reply, 200) END AS explanation
FROM (SELECT e.*, r.reply FROM events e JOIN ({_REPLY_SQL}) r USING (event_id))""")  # fmt: skip
def json_salvage(spark, sf_dir):
    replies = _rows(spark, sf_dir, _REPLY_SQL, "events")
    found = salvage.with_analysis(replies, "reply", "a", F.lit("value"), F.lit("range"), F.lit("medium"), F.lit(3))
    return found.select(
        "event_id", F.col("a").isNotNull().alias("found"), "a.root_cause", "a.confidence", "a.sql_fix", "a.explanation"
    )


@register("email_verify", with_dirty(f"""
SELECT row_key, email, coalesce(contains(email, '@') AND regexp_matches(email, '{EMAIL}'), FALSE) AS is_valid,
  CASE WHEN contains(email, '@') THEN 'unavailable' ELSE 'skipped' END AS api_status,
  CASE WHEN NOT coalesce(contains(email, '@'), FALSE) THEN 100 WHEN regexp_matches(email, '{EMAIL}') THEN 60 ELSE 40 END
    AS confidence FROM d"""))  # fmt: skip
def email_verify(spark, sf_dir):
    verdict = mailbox.verify_email(F.col("email"))
    return dirty(spark, sf_dir).select("row_key", "email", verdict.alias("v")).select(
        "row_key", "email", "v.is_valid", "v.api_status", "v.confidence"
    )


def _failures_sql(source: str) -> str:
    """Failures of the first five rules: name, email (copies), age, country, email (format)."""
    return f"""SELECT count(*) FILTER (WHERE name IS NULL OR trim(name) = '')
  + (SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM {source} GROUP BY email))
  + count(*) FILTER (WHERE age < 0 OR age > 120)
  + count(*) FILTER (WHERE NOT regexp_matches(country, '^[A-Z]{{2}}$'))
  + count(*) FILTER (WHERE NOT regexp_matches(email, '{EMAIL}')) AS n FROM {source}"""


def _first_of(source: str) -> str:
    return f"(SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY email ORDER BY row_key) = 1)"


# Round 1 drops missing names and copies of e-mails and empties bad ages and addresses; round 2 fills blank names,
# drops the copies that the empty addresses made, and empties malformed addresses; round 3 drops copies again.
_LOOP_HISTORY_SQL = f"""
WITH named AS (SELECT * FROM d WHERE name IS NOT NULL),
r1 AS (SELECT * REPLACE (CASE WHEN age < 0 OR age > 120 THEN NULL ELSE age END AS age,
  CASE WHEN regexp_matches(email, '@.*\\.') THEN email END AS email) FROM {_first_of("named")}),
r2 AS (SELECT * REPLACE (CASE WHEN trim(name) = '' THEN 'filled' ELSE name END AS name,
  CASE WHEN regexp_matches(email, '{EMAIL}') THEN email END AS email) FROM {_first_of("r1")}),
r3 AS (SELECT * FROM {_first_of("r2")})
SELECT 1 AS iteration_number, 'Iteration 1: fixes_applied' AS action_taken,
  CAST(n AS BIGINT) AS total_failures, 4 AS fixes_applied FROM ({_failures_sql("d")})
UNION ALL SELECT 2, 'Iteration 2: fixes_applied', CAST(n AS BIGINT), 3 FROM ({_failures_sql("r1")})
UNION ALL SELECT 3, 'Iteration 3: fixes_applied', CAST(n AS BIGINT), 1 FROM ({_failures_sql("r2")})
UNION ALL SELECT 4, 'Iteration 4: failures_remain', CAST(n AS BIGINT), 0 FROM ({_failures_sql("r3")})"""


@register("loop_history", with_dirty(_LOOP_HISTORY_SQL))
def loop_history(spark, sf_dir):
    """A loop whose rounds and explanations are kept in the history."""
    store = _new_store(spark)
    done = run_loop(dirty(spark, sf_dir), RULES[:5], ["row_key"], as_of=AS_OF, run_id="run")
    store.save_iterations(done.iterations)
    store.save_analyses(done.analyses)
    return store.iterations("run").select("iteration_number", "action_taken", "total_failures", "fixes_applied")
