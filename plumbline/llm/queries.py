"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import reachable
from plumbline.llm.bloom_lines import lines_deduplicated
from plumbline.llm.decontamination import contaminated, contamination
from plumbline.llm.filter_audit import filter_audit
from plumbline.llm.fingerprints import edited_fingerprints
from plumbline.llm.language_id import languages
from plumbline.llm.line_dedup import repeated_spans
from plumbline.llm.lm_scores import lm_scores
from plumbline.llm.packing import pack
from plumbline.llm.sharding import shards
from plumbline.llm.simhash import simhash_components
from plumbline.llm.token_alignment import alignments
from plumbline.llm.token_counts import token_counts
from plumbline.llm.toxicity import toxicity as toxic_scores


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(_documents(spark, sf_dir))


def sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shards(_documents(spark, sf_dir), 8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    listed = F.sha2(F.array_join(F.sort_array("items"), ","), 256)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), contaminated().alias("contaminated"), "spans"
    )


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_scores(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(_documents(spark, sf_dir)).drop("copy")


def lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_documents(spark, sf_dir))


def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(_documents(spark, sf_dir))


def bloom_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_deduplicated(_documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": fingerprints,
    "op2_sharding": sharding,
    "op3_decontamination": decontamination,
    "op4_toxicity": toxicity,
    "op5_substring_dedup": substring_dedup,
    "op6_lm_scoring": lm_scoring,
    "op7_simhash": simhash,
    "op8_token_counts": token_count,
    "op9_packing": packing,
    "op10_language_id": language_id,
    "op11_bloom_lines": bloom_lines,
    "op12_token_alignment": token_alignment,
    "op13_filter_audit": filter_interactions,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = r"[ \t\n\x0B\f\r]+"

ORACLES: dict[str, str] = {
    "op5_substring_dedup": rf"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k
            FROM documents WHERE text IS NOT NULL),
        placed AS (
            SELECT doc_id, line, k,
                coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begins
            FROM lines),
        pieces AS (
            SELECT doc_id, k, begins, unnest(regexp_split_to_array(line, '[ \t\x0B\f\r]')) AS piece, generate_subscripts(regexp_split_to_array(line, '[ \t\x0B\f\r]'), 1) AS j
            FROM placed),
        words AS (
            SELECT doc_id, k, j, translate(piece, '{_UPPER}', '{_LOWER}') AS word, length(piece) AS n,
                begins + coalesce(sum(length(piece) + 1) OVER (PARTITION BY doc_id, k ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
            FROM pieces QUALIFY piece <> ''),
        marked AS (
            SELECT *, list_sum(list_transform(string_split(word, ''), lambda c: unicode(c))) % 2 = 0
                OR lead(k) OVER (PARTITION BY doc_id ORDER BY k, j) IS DISTINCT FROM k AS stops
            FROM words),
        numbered AS (
            SELECT *, coalesce(sum(stops::INT) OVER (PARTITION BY doc_id ORDER BY k, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS unit FROM marked),
        units AS (
            SELECT doc_id, unit, min(start) AS start, max(start + n) AS stop, string_agg(word, ' ' ORDER BY k, j) AS text FROM numbered GROUP BY doc_id, unit),
        passages AS (
            SELECT doc_id, start, max(stop) OVER w AS stop, string_agg(text, ' ') OVER w AS text FROM units
            WINDOW w AS (PARTITION BY doc_id ORDER BY unit ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) QUALIFY count(*) OVER w = 16),
        ranked AS (
            SELECT *, first_value(doc_id) OVER w AS kept_doc_id, first_value(start) OVER w AS kept_start FROM passages
            WINDOW w AS (PARTITION BY text ORDER BY doc_id, start)),
        lost AS (
            SELECT *, max(stop) OVER (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
            FROM ranked WHERE kept_doc_id < doc_id),
        runs AS (SELECT *, sum(CASE WHEN start <= before THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY start) AS run FROM lost)
        SELECT doc_id, min(start) AS start, max(stop) - min(start) AS length, count(*) AS n_passages,
            arg_min(kept_doc_id, start) AS kept_doc_id, arg_min(kept_start, start) AS kept_start
        FROM runs GROUP BY doc_id, run""",
    "op11_bloom_lines": rf"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS k
            FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
        keyed AS (SELECT *, translate(regexp_replace(line, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g'), '{_UPPER}', '{_LOWER}') AS key FROM lines),
        marked AS (
            SELECT *, length(key) >= 10 AND min(doc_id) OVER (PARTITION BY key) < doc_id AS gone FROM keyed)
        SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op13_filter_audit": rf"""
        WITH RECURSIVE texts AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda w: w <> '') AS words FROM documents),
        marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        failing AS (
            SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words),
                 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t), regexp_matches(t, '[#$%&*|]'),
                 doc_id > min(doc_id) OVER (PARTITION BY t)] AS fails
            FROM texts LEFT JOIN marks USING (doc_id)),
        kinds AS (SELECT part, good, toxic, fails, count(*) AS n FROM failing GROUP BY ALL),
        letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest(range(1, 6)) AS i),
        orders(filter_order, seq) AS (
            SELECT '', []::BIGINT[]
            UNION ALL SELECT filter_order || l, list_append(seq, i) FROM orders, letters WHERE NOT list_contains(seq, i) AND len(seq) < 5),
        steps AS (SELECT filter_order, seq, unnest(range(1, 6)) AS step FROM orders WHERE len(seq) = 5),
        judged AS (
            SELECT part, filter_order, step, n, good, toxic, seq[step] AS own, fails[seq[step]] AS now,
                list_bool_or(list_append(list_transform(seq[1:step - 1], lambda j: fails[j]), false)) AS earlier,
                len(list_filter(fails, lambda f: f)) AS n_fails
            FROM kinds, steps),
        counted AS (
            SELECT part, filter_order, step, own, sum(CASE WHEN NOT earlier AND NOT now THEN n ELSE 0 END)::BIGINT AS kept,
                sum(CASE WHEN NOT earlier AND now THEN n ELSE 0 END)::BIGINT AS removed,
                sum(CASE WHEN earlier AND now THEN n ELSE 0 END)::BIGINT AS redundant,
                sum(CASE WHEN now AND n_fails = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
                sum(CASE WHEN NOT earlier AND now AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
                sum(CASE WHEN NOT earlier AND now AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
            FROM judged GROUP BY ALL)
        SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
            (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
        FROM counted""",
}
