"""Rules that look beyond one row of one table: references, groups and totals, sequences, outliers of groups; and snapshots."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import History, Rule, snapshot_diff, validate
from plumbline.operators.ordered import grouped_quantiles
from plumbline.operators.sketches import column_sketches, merged_sketches, sketched_profile
from plumbline.sources.storage import scratch_path
from registry.inputs import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str):
    def add(query):
        QUERIES[name], ORACLES[name] = query, sql
        return query

    return add


def _from(spark: SparkSession, sf_dir: str, sql: str, source: str) -> DataFrame:
    return spark.sql(sql.replace(f"FROM {source}", "FROM {src}"), src=table(spark, sf_dir, source))


# ---- references ------------------------------------------------------------------------------

# Lines whose order is missing for a third of them (one key), null for some, and right or cut off for the others.
LINES_SQL = """
SELECT l_orderkey AS line_order, l_linenumber AS line_number,
  CASE WHEN l_orderkey % 3 = 0 THEN 900000000 WHEN l_linenumber = 7 THEN NULL ELSE l_orderkey END AS order_ref,
  l_partkey, CASE WHEN l_linenumber = 6 THEN NULL ELSE l_suppkey END AS supp_ref,
  CASE WHEN l_linenumber = 5 THEN NULL ELSE concat(l_returnflag, '/', l_linestatus) END AS code,
  CASE WHEN l_linenumber = 4 THEN NULL ELSE l_returnflag END AS flag, l_linestatus AS status,
  CAST(l_linenumber AS BIGINT) AS line, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, l_quantity AS quantity
FROM lineitem"""
ORDERS_SQL = "SELECT CAST(o_orderkey AS INT) AS o_orderkey FROM orders WHERE o_orderkey % 50 <> 0"
PAIRS_SQL = "SELECT l_partkey AS p, l_suppkey AS s FROM lineitem WHERE l_quantity > 3"
CODES_SQL = "SELECT DISTINCT concat(l_returnflag, '/', l_linestatus) AS code FROM lineitem WHERE l_returnflag <> 'R'"

REFERENCES = [
    Rule("X1", "order_ref", "reference", "high", params={"table": "orders", "to": "o_orderkey"}),
    Rule("X2", "l_partkey", "reference", params={"table": "pairs", "columns": ["l_partkey", "supp_ref"], "to": ["p", "s"]}),
    Rule("X3", "code", "reference", "low", params={"table": "codes", "to": "code"}),
    Rule("X4", "line", "reference", params={"to": "quantity"}),
    Rule("X5", "code", "reference", params={"table": "orders", "to": "o_orderkey"}),
]


def _referred(spark: SparkSession, sf_dir: str):
    tables = {"orders": _from(spark, sf_dir, ORDERS_SQL, "orders"), "pairs": _from(spark, sf_dir, PAIRS_SQL, "lineitem"), "codes": _from(spark, sf_dir, CODES_SQL, "lineitem")}
    return validate(_from(spark, sf_dir, LINES_SQL, "lineitem"), REFERENCES, key=["line_order", "line_number"], run_id="X", tables=tables)


_BROKEN_SQL = f"""
WITH lines AS ({LINES_SQL}), parents AS ({ORDERS_SQL}), pairs AS ({PAIRS_SQL}), codes AS ({CODES_SQL}),
broken AS (
  SELECT 'X1' AS rule_id, line_order, line_number, CAST(order_ref AS VARCHAR) AS value FROM lines
  WHERE order_ref IS NOT NULL AND order_ref NOT IN (SELECT o_orderkey FROM parents)
  UNION ALL SELECT 'X2', line_order, line_number, concat(l_partkey, ', ', supp_ref) FROM lines
  WHERE supp_ref IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pairs WHERE p = l_partkey AND s = supp_ref)
  UNION ALL SELECT 'X3', line_order, line_number, code FROM lines WHERE code IS NOT NULL AND code NOT IN (SELECT code FROM codes)
  UNION ALL SELECT 'X4', line_order, line_number, CAST(line AS VARCHAR) FROM lines WHERE line NOT IN (SELECT quantity FROM lines)
  UNION ALL SELECT 'X5', line_order, line_number, NULL FROM lines)"""


@register("reference_results", _BROKEN_SQL + """
SELECT rule_id, CASE WHEN rule_id = 'X5' THEN 'error' ELSE 'ok' END AS status, failed_count = 0 AND rule_id <> 'X5' AS passed,
  total_rows, total_rows - failed_count AS passed_count, failed_count
FROM (SELECT 'X' || k AS rule_id, (SELECT count(*) FROM lines) AS total_rows, (SELECT count(*) FROM broken WHERE rule_id = 'X' || k) AS failed_count
      FROM range(1, 6) r(k))""")  # fmt: skip
def reference_results(spark, sf_dir):
    return _referred(spark, sf_dir).rule_results.select("rule_id", "status", "passed", "total_rows", "passed_count", "failed_count")


@register("reference_violations", _BROKEN_SQL + """
SELECT rule_id, line_order, line_number, value,
  CASE rule_id WHEN 'X5' THEN 'Column ''code'' (string) cannot equal ''o_orderkey'' (int)' ELSE concat('Row ', line_order, '/', line_number, ': ''', CASE rule_id WHEN 'X1' THEN 'order_ref' WHEN 'X2' THEN 'l_partkey+supp_ref' WHEN 'X3' THEN 'code' ELSE 'line' END,
    ''' value ''', value, ''' is not in ', CASE rule_id WHEN 'X1' THEN 'orders.o_orderkey' WHEN 'X2' THEN 'pairs.p+s' WHEN 'X3' THEN 'codes.code' ELSE 'the table.quantity' END) END AS reason
FROM broken""")  # fmt: skip
def reference_violations(spark, sf_dir):
    return _referred(spark, sf_dir).violations.select("rule_id", "row_key.line_order", "row_key.line_number", "value", F.regexp_replace("reason", "^Row [0-9/]+: Column|^Row [0-9/]+Column", "Column").alias("reason"))


# ---- groups and totals -----------------------------------------------------------------------

_FLAGS = ["flag", "status"]
GROUPS = [
    Rule("G1", "cents", "aggregate", "high", params={"measure": "sum", "by": _FLAGS, "levels": "rollup", "max": 20_000_000_000}),
    Rule("G2", "_all", "aggregate", params={"measure": "count", "by": _FLAGS, "levels": "cube", "min": 9_000}),
    Rule("G3", "cents", "aggregate", params={"measure": "mean", "by": _FLAGS, "levels": [["status"], []], "min": 3_818_000, "max": 3_830_000}),
    Rule("G4", "quantity", "aggregate", params={"measure": "max", "by": _FLAGS, "max": 49}),
    Rule("G5", "flag", "aggregate", params={"measure": "count", "by": ["line"], "min": 1}),
    Rule("G6", "quantity", "aggregate", params={"measure": "min", "levels": "total", "min": 2}),
    Rule("G7", "cents", "aggregate", params={"measure": "median", "by": _FLAGS, "min": 0}),
]


def _groups(spark: SparkSession, sf_dir: str):
    return validate(_from(spark, sf_dir, LINES_SQL, "lineitem"), GROUPS, run_id="G")


_GROUPS_SQL = f"""
WITH lines AS ({LINES_SQL}),
g AS (
  SELECT flag, status, grouping(flag, status) AS gid, sum(cents) AS total, count(*) AS n, CAST(sum(cents) AS DOUBLE) / count(cents) AS mean, max(quantity) AS most
  FROM lines GROUP BY CUBE (flag, status)),
named AS (
  SELECT *, CASE gid WHEN 0 THEN 'flag,status' WHEN 1 THEN 'flag' WHEN 2 THEN 'status' ELSE '' END AS level,
    CASE gid WHEN 0 THEN concat(coalesce(flag, 'null'), '/', coalesce(status, 'null')) WHEN 1 THEN coalesce(flag, 'null') WHEN 2 THEN coalesce(status, 'null') ELSE '' END AS members
  FROM g),
judged AS (
  SELECT 'G1' AS rule_id, level, members, CAST(total AS DOUBLE) AS value, total > 20000000000 AS fails FROM named WHERE gid IN (0, 1, 3)
  UNION ALL SELECT 'G2', level, members, CAST(n AS DOUBLE), n < 9000 FROM named
  UNION ALL SELECT 'G3', level, members, mean, mean < 3818000 OR mean > 3830000 FROM named WHERE gid IN (2, 3)
  UNION ALL SELECT 'G4', level, members, most, most > 49 FROM named WHERE gid = 0
  UNION ALL SELECT 'G5', 'line', CAST(line AS VARCHAR), CAST(count(flag) AS DOUBLE), count(flag) < 1 FROM lines GROUP BY line
  UNION ALL SELECT 'G6', '', '', min(quantity), min(quantity) < 2 FROM lines)"""


@register("group_rule_results", _GROUPS_SQL + """
SELECT rule_id, 'ok' AS status, count_if(fails) = 0 AS passed, count(*) AS total_rows, count_if(fails)::BIGINT AS failed_count FROM judged GROUP BY rule_id
UNION ALL SELECT 'G7', 'error', false, count(*), count(*) FROM lines""")
def group_rule_results(spark, sf_dir):
    return _groups(spark, sf_dir).rule_results.select("rule_id", "status", "passed", "total_rows", "failed_count")


@register("group_rule_violations", _GROUPS_SQL + " SELECT rule_id, level, members, value FROM judged WHERE fails")
def group_rule_violations(spark, sf_dir):
    found = _groups(spark, sf_dir).group_violations
    return found.select("rule_id", "level", F.array_join("group", "/", "null").alias("members"), "value")


# ---- snapshots -------------------------------------------------------------------------------

OLD_SQL = """
SELECT * FROM orders WHERE o_orderkey % 211 <> 0
UNION ALL SELECT * FROM orders WHERE o_orderkey % 40 = 0"""
# Changes stand among the orders below 700: prices, nulls, lost rows, and other numbers of copies; new orders at both ends.
NEW_SQL = """
SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 AND o_orderkey < 700 THEN NULL ELSE o_custkey END AS o_custkey, o_orderstatus,
  CASE WHEN o_orderkey % 7 = 0 AND o_orderkey < 500 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority
FROM orders WHERE o_orderkey % 211 <> 0 AND NOT (o_orderkey % 17 = 0 AND o_orderkey < 600)
UNION ALL SELECT * FROM orders WHERE o_orderkey % 40 = 0 AND o_orderkey >= 400
UNION ALL SELECT * FROM orders WHERE o_orderkey % 60 = 0 AND o_orderkey < 300
UNION ALL SELECT CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE -o_orderkey END, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
FROM orders WHERE o_orderkey < 20"""
_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _diff(spark: SparkSession, sf_dir: str):
    return snapshot_diff(_from(spark, sf_dir, OLD_SQL, "orders"), _from(spark, sf_dir, NEW_SQL, "orders"), ["o_orderkey"])


_ROWS_SQL = f"""
WITH old_rows AS ({OLD_SQL}), new_rows AS ({NEW_SQL}),
changes AS (
  SELECT 'removed' AS change, count(*) AS copies, * FROM (SELECT * FROM old_rows EXCEPT ALL SELECT * FROM new_rows) GROUP BY ALL
  UNION ALL SELECT 'added', count(*), * FROM (SELECT * FROM new_rows EXCEPT ALL SELECT * FROM old_rows) GROUP BY ALL)"""


@register("snapshot_rows", _ROWS_SQL + f" SELECT change, copies, {', '.join(_COLUMNS)} FROM changes")
def snapshot_rows(spark, sf_dir):
    return _diff(spark, sf_dir).rows


_KEYS_SQL = _ROWS_SQL + f""",
keyed AS (
  SELECT o_orderkey, sum(copies) FILTER (change = 'removed') AS r, sum(copies) FILTER (change = 'added') AS a,
    {', '.join(f"max({c}) FILTER (change = 'removed') IS DISTINCT FROM max({c}) FILTER (change = 'added') AS d{k}" for k, c in enumerate(_COLUMNS[1:]))}
  FROM changes GROUP BY o_orderkey),
named AS (
  SELECT o_orderkey, CASE WHEN a IS NULL THEN 'removed' WHEN r IS NULL THEN 'added' ELSE 'changed' END AS change,
    coalesce(r, 0)::BIGINT AS removed_rows, coalesce(a, 0)::BIGINT AS added_rows,
    CASE WHEN r = 1 AND a = 1 THEN concat_ws(',', {', '.join(f"CASE WHEN d{k} THEN '{c}' END" for k, c in enumerate(_COLUMNS[1:]))}) END AS changed_columns
  FROM keyed)"""


@register("snapshot_keys", _KEYS_SQL + " SELECT * FROM named")
def snapshot_keys(spark, sf_dir):
    return _diff(spark, sf_dir).keys.withColumn("changed_columns", F.when(F.col("changed_columns").isNotNull(), F.array_join("changed_columns", ",")))


@register("snapshot_summary", _KEYS_SQL + """
SELECT (SELECT count(*) FROM old_rows) AS old_rows, (SELECT count(*) FROM new_rows) AS new_rows, sum(removed_rows)::BIGINT AS removed_rows, sum(added_rows)::BIGINT AS added_rows,
  count_if(change = 'removed')::BIGINT AS removed_keys, count_if(change = 'added')::BIGINT AS added_keys, count_if(change = 'changed')::BIGINT AS changed_keys FROM named""")
def snapshot_summary(spark, sf_dir):
    return _diff(spark, sf_dir).summary.drop("n_ranges", "unequal_ranges", "compared_rows")


# ---- sequences -------------------------------------------------------------------------------

# Events with a third of the rows under one user, some without a user, some without a time, and a counter that falls.
EVENTS_SQL = """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 31 = 0 THEN NULL ELSE user_id END AS who,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE ts END AS ts, ts AS began, ts + make_interval_minutes AS ended,
  CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 11 = 0 THEN event_id - 40 ELSE event_id END AS counter, value
FROM events"""
_EVENTS_SPARK = EVENTS_SQL.replace("make_interval_minutes", "make_interval(0, 0, 0, 0, 0, event_id % 50, 0)")
_EVENTS_DUCK = EVENTS_SQL.replace("make_interval_minutes", "to_minutes(event_id % 50)")

SEQUENCES = [
    Rule("S1", "counter", "sequence", "high", params={"by": "who", "order": "ts"}),
    Rule("S2", "counter", "sequence", params={"order": "event_id", "strict": True}),
    Rule("S3", "ts", "sequence", params={"check": "gap", "by": "who", "max": 7200, "min": 1}),
    Rule("S4", "began", "sequence", params={"check": "overlap", "by": "who", "end": "ended"}),
    Rule("S5", "event_id", "sequence", params={"check": "gap", "by": ["who"], "max": 300}),
    Rule("S6", "counter", "sequence", params={"check": "sorted"}),
]


def _sequences(spark: SparkSession, sf_dir: str):
    return validate(_from(spark, sf_dir, _EVENTS_SPARK, "events"), SEQUENCES, key=["event_id"], run_id="S")


_BROKEN_ORDER_SQL = f"""
WITH e AS ({_EVENTS_DUCK}),
s1 AS (SELECT event_id, counter, lag(counter) OVER (PARTITION BY who ORDER BY ts, event_id) AS p FROM e WHERE ts IS NOT NULL AND counter IS NOT NULL),
s2 AS (SELECT event_id, counter, lag(counter) OVER (ORDER BY event_id) AS p FROM e WHERE counter IS NOT NULL),
s3 AS (SELECT event_id, ts, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY who ORDER BY ts, event_id))) / 1e6 AS step FROM e WHERE ts IS NOT NULL),
s4 AS (SELECT event_id, began, max(ended) OVER (PARTITION BY who ORDER BY began, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM e),
s5 AS (SELECT event_id, event_id - lag(event_id) OVER (PARTITION BY who ORDER BY event_id) AS step FROM e),
broken AS (
  SELECT 'S1' AS rule_id, event_id FROM s1 WHERE counter < p UNION ALL SELECT 'S2', event_id FROM s2 WHERE counter <= p
  UNION ALL SELECT 'S3', event_id FROM s3 WHERE step < 1 OR step > 7200 UNION ALL SELECT 'S4', event_id FROM s4 WHERE began < p
  UNION ALL SELECT 'S5', event_id FROM s5 WHERE step > 300 UNION ALL SELECT 'S6', event_id FROM e)"""


@register("sequence_results", _BROKEN_ORDER_SQL + """
SELECT 'S' || k AS rule_id, CASE k WHEN 6 THEN 'error' ELSE 'ok' END AS status, (SELECT count(*) FROM e) AS total_rows,
  (SELECT count(*) FROM broken WHERE rule_id = 'S' || k) AS failed_count FROM range(1, 7) r(k)""")
def sequence_results(spark, sf_dir):
    return _sequences(spark, sf_dir).rule_results.select("rule_id", "status", "total_rows", "failed_count")


@register("sequence_violations", _BROKEN_ORDER_SQL + " SELECT rule_id, event_id FROM broken")
def sequence_violations(spark, sf_dir):
    return _sequences(spark, sf_dir).violations.select("rule_id", "row_key.event_id")


_STAYS = "SELECT o_custkey % 50 AS who, o_orderkey, o_orderdate, o_totalprice FROM orders"


@register("sequence_order_prices", f"""
WITH o AS ({_STAYS}), p AS (SELECT *, lag(o_totalprice) OVER (PARTITION BY who ORDER BY o_orderdate, o_orderkey) AS before FROM o)
SELECT o_orderkey, o_totalprice, before FROM p WHERE o_totalprice < before""")
def sequence_order_prices(spark, sf_dir):
    """Orders of a customer group that cost less than the one before, with that one's price."""
    found = validate(_from(spark, sf_dir, _STAYS, "orders"), [Rule("P", "o_totalprice", "sequence", params={"by": "who", "order": "o_orderdate"})], key=["o_orderkey"]).violations
    before = F.regexp_extract("reason", "falls from '(.*)'$", 1).cast("double")
    return found.select("row_key.o_orderkey", F.col("value").cast("double").alias("o_totalprice"), before.alias("before"))


# ---- quantiles and outliers of groups --------------------------------------------------------

# A third of the lines is one group; prices with nulls, and a few far off.
PRICES_SQL = """
SELECT l_orderkey AS line_order, l_linenumber AS line_number, CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_suppkey END AS seller,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE l_returnflag END AS flag,
  CASE WHEN l_orderkey % 97 = 0 THEN NULL WHEN l_orderkey % 89 = 0 THEN l_extendedprice * 20 ELSE l_extendedprice END AS price
FROM lineitem"""


@register("grouped_quantiles", f"""
WITH p AS ({PRICES_SQL})
SELECT seller, flag, count(price) AS n, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS q2, quantile_cont(price, 0.99) AS q99
FROM p GROUP BY seller, flag""")
def group_quantiles(spark, sf_dir):
    rows = _from(spark, sf_dir, PRICES_SQL, "lineitem")
    found = grouped_quantiles(rows, ["seller", "flag"], F.col("price"), (0.25, 0.5, 0.99))
    return found.select(F.col("group.g0").alias("seller"), F.col("group.g1").alias("flag"), "n", *[F.col("quantiles")[k].alias(c) for k, c in enumerate(("q1", "q2", "q99"))])


_OUTLIERS_SQL = f"""
WITH p AS ({PRICES_SQL}),
q AS (SELECT seller, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM p GROUP BY seller),
bad AS (SELECT p.* FROM p JOIN q USING (seller) WHERE price < q1 - 1.5 * (q3 - q1) OR price > q3 + 1.5 * (q3 - q1))"""
_OUTLIERS = [Rule("O", "price", "outlier", params={"by": "seller"})]


@register("group_outlier_results", _OUTLIERS_SQL + " SELECT 'O' AS rule_id, (SELECT count(*) FROM p) AS total_rows, (SELECT count(*) FROM bad) AS failed_count")
def group_outlier_results(spark, sf_dir):
    return validate(_from(spark, sf_dir, PRICES_SQL, "lineitem"), _OUTLIERS).rule_results.select("rule_id", "total_rows", "failed_count")


@register("group_outlier_violations", _OUTLIERS_SQL + " SELECT line_order, line_number, price FROM bad")
def group_outlier_violations(spark, sf_dir):
    found = validate(_from(spark, sf_dir, PRICES_SQL, "lineitem"), _OUTLIERS, key=["line_order", "line_number"]).violations
    return found.select("row_key.line_order", "row_key.line_number", F.col("value").cast("double").alias("price"))


# ---- sketches that merge ---------------------------------------------------------------------

_SKETCHED = "SELECT *, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders"


@register("sketches_of_merged_runs", f"""
WITH o AS ({_SKETCHED}), c AS (
  {" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) - count({c}) AS nulls, min({v}) AS low, max({v}) AS high FROM o"
                      for c, v in (("o_custkey", "CAST(o_custkey AS DOUBLE)"), ("price", "price"), ("o_orderpriority", "CAST(NULL AS DOUBLE)")))})
SELECT *, true AS distinct_near, true AS median_near, true AS top_near FROM c""")
def sketches_of_merged_runs(spark, sf_dir):
    """Three runs, sketched apart, stored and merged: exact counts and bounds, and estimates held against exact values."""
    rows, names = _from(spark, sf_dir, _SKETCHED, "orders"), ["o_custkey", "price", "o_orderpriority"]
    store = History(spark, scratch_path(spark, "history"))
    for k in range(3):
        store.save_sketches("orders", f"run{k}", column_sketches(rows.filter(F.col("o_orderkey") % 3 == k), names), f"2024-0{k + 1}-15")
    found = sketched_profile(merged_sketches(store.sketches(), ["dataset_name"]))
    exact = []
    for c in names:
        counts = rows.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
        ranks = rows.select(F.percentile(F.col(c).cast("double"), F.array(F.lit(0.46), F.lit(0.54)))).scalar() if c != "o_orderpriority" else F.lit(None)
        exact.append(counts.agg(F.count(F.lit(1)).alias("d"), F.max("n").alias("most")).select(F.lit(c).alias("column"), "d", "most", ranks.cast("array<double>").alias("middle")))
    joined = found.join(F.broadcast(reduce(DataFrame.unionAll, exact)), "column")
    median, top = F.col("quantiles")[1], F.get(F.col("top_values"), F.lit(0))["n"]
    return joined.select(
        F.col("column").alias("column_name"), "rows", "nulls", "low", "high", (F.abs(F.col("distinct_values") - F.col("d")) <= 0.08 * F.col("d")).alias("distinct_near"),
        F.coalesce(median.between(F.col("middle")[0], F.col("middle")[1]), F.lit(True)).alias("median_near"),
        F.coalesce(F.col("most") - top <= F.col("rows") / 256, F.lit(True)).alias("top_near"),
    )
