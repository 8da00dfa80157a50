"""Inputs shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-12-01"

# Customers with faults put in. The text runs unchanged in Spark SQL and in DuckDB.
DIRTY_SQL = """
SELECT c_custkey AS row_key,
  CASE WHEN c_custkey % 50 = 49 THEN c_custkey - 1 ELSE c_custkey END AS customer_id,
  CASE c_custkey % 20 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  ' WHEN 3 THEN 'N/A' WHEN 4 THEN 'TODO'
    WHEN 5 THEN 'x' ELSE c_name END AS name,
  CASE c_custkey % 12 WHEN 0 THEN NULL
    WHEN 1 THEN concat('user', CAST(c_custkey AS STRING), '-at-example.com')
    WHEN 2 THEN concat('user', CAST(c_custkey AS STRING), '@example')
    WHEN 3 THEN concat('user', CAST(c_custkey AS STRING), '@@example.com')
    WHEN 4 THEN concat('user', CAST(c_custkey AS STRING), '@other.org')
    ELSE concat('user', CAST(c_custkey AS STRING), '@example.com') END AS email,
  CASE c_custkey % 25 WHEN 0 THEN 200 WHEN 1 THEN -5 WHEN 2 THEN 999 WHEN 3 THEN NULL
    ELSE 18 + (c_custkey * 37) % 60 END AS age,
  CASE c_custkey % 16 WHEN 0 THEN NULL WHEN 1 THEN 'abc' WHEN 2 THEN '10d' WHEN 3 THEN ' 12 ' WHEN 4 THEN '1e3'
    WHEN 5 THEN '' WHEN 6 THEN '1,000' ELSE CAST(c_custkey AS STRING) END AS amount_text,
  CASE c_custkey % 15 WHEN 0 THEN NULL WHEN 1 THEN '12345' WHEN 2 THEN '555-INVALID'
    ELSE concat('+1-555-', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')) END AS phone,
  CASE c_custkey % 18 WHEN 0 THEN NULL WHEN 1 THEN '2024-13-45' WHEN 2 THEN '2024-02-30' WHEN 3 THEN 'not-a-date'
    WHEN 4 THEN '2024/08/30' WHEN 5 THEN '2028-01-01' WHEN 6 THEN '2024-1-5'
    ELSE CAST(DATE '2023-01-01' + CAST(c_custkey % 1200 AS INT) AS STRING) END AS signup_date,
  CASE c_custkey % 9 WHEN 0 THEN NULL WHEN 1 THEN '2022-06-01'
    ELSE CAST(DATE '2023-03-01' + CAST(c_custkey % 1200 AS INT) AS STRING) END AS end_date,
  CASE c_custkey % 14 WHEN 0 THEN NULL WHEN 1 THEN 'ZZ' WHEN 2 THEN 'us' WHEN 3 THEN 'XX' WHEN 4 THEN 'UK'
    WHEN 5 THEN 'DE' ELSE 'US' END AS country,
  CASE c_custkey % 7 WHEN 0 THEN 'eur' WHEN 1 THEN 'GBP' WHEN 2 THEN 'XXX' WHEN 3 THEN 'EUR'
    ELSE 'USD' END AS currency,
  CASE WHEN c_custkey % 40 = 0 THEN 15000000.0 ELSE c_acctbal * 10 END AS salary
FROM customer
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dirty customers, read through a query that names its input instead of a global view."""
    return spark.sql(DIRTY_SQL.replace("FROM customer", "FROM {customer}"), customer=table(spark, sf_dir, "customer"))


def with_dirty(sql: str) -> str:
    """DuckDB text over a CTE `d` with the dirty customers."""
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH d AS ({DIRTY_SQL}), {body[5:]}"
    return f"WITH d AS ({DIRTY_SQL}) {body}"
