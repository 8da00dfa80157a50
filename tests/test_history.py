"""The run history: append, latest version, delete, compact, read back."""

from __future__ import annotations

import os
import time

import pytest
from helpers import texts
from pyspark.sql import functions as F

from plumbline import History, Rule, run_loop, validate
from plumbline.functions.mailbox import verify_email
from plumbline.operators.explain import analyse_failures
from plumbline.sources.history import SCHEMAS
from plumbline.sources.storage import CLEANUP, shared_dir

RULES = [Rule("R1", "c", "not_null", "high"), Rule("R2", "c", "email"), Rule("R3", "c", "max_length")]


@pytest.fixture
def store(spark, tmp_path):
    return History(spark, str(tmp_path / "history"))


@pytest.fixture
def outcome(spark):
    return validate(texts(spark, "a@b.com", None, "bad", "x" * 250, *["bad"] * 120), RULES, key=["rk"])


def test_empty_store(store):
    assert store.recent_runs().count() == 0
    assert all(rows.isEmpty() for rows in store.run_details("nope").values())
    assert store.iterations().count() == store.failed_records("nope").count() == 0
    row = store.statistics().first()
    assert {row[n] for n in SCHEMAS} == {0} and row["pass_rate"] == 0


def test_save_run(store, outcome):
    run_id = store.save_run("customers", outcome.rule_results, outcome.violations, 2, {"source": "test"})
    run = store.table("validation_runs").first()
    assert (run["run_id"], run["dataset_name"], run["total_rows"], run["total_columns"]) == (run_id, "customers", 124, 2)
    assert (run["total_rules"], run["passed_rules"], run["failed_rules"], run["overall_status"]) == (3, 1, 2, "failed")
    assert run["metadata"] == {"source": "test"}
    results = {r["rule_id"]: r for r in store.table("validation_results").collect()}
    assert results["R1"]["failed_keys"] == ["1"] and results["R3"]["failed_keys"] == []
    assert len(results["R2"]["failed_keys"]) == 50 and len(results["R2"]["error_details"]) == 20
    records = store.failed_records(run_id).collect()
    # All are kept, with their whole values.
    assert [r["rule_id"] for r in records] == ["R1"] + ["R2"] * 122
    assert {r["invalid_value"] for r in records} == {"nan", "bad", "x" * 250}
    assert {r["result_id"] for r in records} == {f"{run_id}:R1", f"{run_id}:R2"}
    assert len({r["record_id"] for r in records}) == 123


def test_a_sample_is_kept_where_asked_for(store, outcome):
    run_id = store.save_run("customers", outcome.rule_results, outcome.violations, sample=10)
    records = store.failed_records(run_id).collect()
    assert [(r["rule_id"], r["sample_no"]) for r in records] == [("R1", 1)] + [("R2", k) for k in range(1, 11)]


def test_filters_on_a_run_reach_the_files(store, outcome):
    run_id = store.save_run("customers", outcome.rule_results)
    store.save_analyses(analyse_failures(outcome.rule_results.withColumn("run_id", F.lit(run_id)), RULES))
    for name in ("validation_runs", "remediation_suggestions"):
        rows = store.table(name).filter(F.col("run_id") == run_id)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert f"EqualTo(run_id,{run_id})" in plan and not rows.isEmpty()


def test_what_is_written_on_the_way_does_not_stay(store, outcome, spark):
    """Shuffle files of an append go with it, scratch copies too, and the caller's settings are as they were."""
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def shuffled():
        files = disk.getAllFiles()
        return {files.apply(k).getName() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_")}

    rows = spark.range(300).selectExpr(
        "concat('r', id % 7) AS run_id", "concat('R', id) AS rule_id", "'c' AS column_name", "int(id) AS sample_no", "string(id) AS row_key", "'v' AS value", "'w' AS reason"
    )
    explained = analyse_failures(outcome.rule_results.withColumn("run_id", F.lit("r1")), RULES)
    store.save_failed_records(rows)  # what is listed below is new
    store.save_analyses(explained)
    before, held = shuffled(), set(os.listdir(shared_dir(spark).removeprefix("file:")))
    store.save_failed_records(rows)
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before
    store.save_analyses(explained)
    assert not {x for x in set(os.listdir(shared_dir(spark).removeprefix("file:"))) - held if x.startswith("explained")}
    assert spark.conf.get(CLEANUP, "false") == "false"
    found = store.table("failed_records").where("rule_id = 'R8'").collect()
    assert [(r.record_id, r.result_id, r.row_key) for r in found] == [("r1:R8:8", "r1:R8", "8")] * 2


def test_nothing_is_shuffled_to_read_rows_without_removed_runs(store, outcome):
    run_id = store.save_run("customers", outcome.rule_results, outcome.violations)
    rows = store.table("failed_records")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    store.delete_run(run_id)
    assert rows.count() > 0 and store.table("failed_records").count() == 0


def test_the_last_change_wins_whatever_the_clock_says(store, outcome):
    run_id = store.save_run("customers", outcome.rule_results)
    for status in "abcde":
        store.update_run_status(run_id, status)
    assert store._stored("validation_runs").agg(F.max("version")).first()[0] == 6
    assert [r["overall_status"] for r in store.recent_runs().collect()] == ["e"]


def test_analyses_and_remediations(store, outcome):
    run_id = store.save_run("customers", outcome.rule_results)
    explained = analyse_failures(outcome.rule_results.withColumn("run_id", F.lit(run_id)), RULES)
    store.save_analyses(explained)
    assert store.analyses(run_id).count() == store.analyses().count() == 2
    assert store.analyses("other").count() == 0
    suggestion = store.remediations(run_id).orderBy("rule_id").first()
    assert suggestion["fix_applied"] is False
    store.mark_remediation_applied(suggestion["remediation_id"])
    applied = {r["rule_id"]: r["fix_applied"] for r in store.remediations().collect()}
    assert applied == {"R1": True, "R2": False}
    no_fix = explained.withColumns({"sql_fix": F.lit(""), "code_fix": F.lit(None).cast("string")})
    store.save_analyses(no_fix)
    assert store.remediations().count() == 2 and store.analyses().count() == 4


def test_status_changes(store, outcome):
    run_id = store.save_run("customers", outcome.rule_results)
    store.update_run_status(run_id, "reviewed")
    store.update_run_status(run_id, "closed")
    assert [r["overall_status"] for r in store.recent_runs().collect()] == ["closed"]
    store.update_run_status("unknown", "x")
    assert store.recent_runs().count() == 1


def test_delete_and_details(store, outcome, spark):
    keep = store.save_run("a", outcome.rule_results, outcome.violations)
    gone = store.save_run("b", outcome.rule_results, outcome.violations)
    verdicts = texts(spark, "a@b.com", "x").select(F.col("c").alias("email"), verify_email(F.col("c")).alias("verdict"))
    store.save_email_verdicts(verdicts, gone)
    details = {name: rows.collect() for name, rows in store.run_details(gone).items()}
    assert [r["dataset_name"] for r in details["validation_runs"]] == ["b"]
    assert len(details["validation_results"]) == 3 and len(details["failed_records"]) == 123
    assert details["ai_analysis"] == []
    store.delete_run(gone)
    assert [r["run_id"] for r in store.recent_runs().collect()] == [keep]
    assert all(rows.isEmpty() for rows in store.run_details(gone).values()) and store.failed_records(gone).isEmpty()
    assert store.email_verdicts().count() == 2  # they outlive the run
    stats = store.statistics().first()
    assert (stats["validation_runs"], stats["validation_results"], stats["api_validation_results"]) == (1, 3, 2)
    assert (stats["total_rules_checked"], stats["pass_rate"]) == (3, 33.3)


def test_compact_and_clear(store, outcome, tmp_path):
    run_id = store.save_run("a", outcome.rule_results)
    store.update_run_status(run_id, "closed")
    gone = store.save_run("b", outcome.rule_results)
    store.delete_run(gone)
    small = store.compact(str(tmp_path / "compact"))
    assert small._stored("validation_runs").count() == 1
    assert small.recent_runs().first()["overall_status"] == "closed"
    store.clear()
    assert store.recent_runs().count() == 0 and store.table("validation_results").count() == 0
    again = store.save_run("c", outcome.rule_results)
    assert [r["run_id"] for r in store.recent_runs().collect()] == [again]


def test_loop_rounds(store, spark):
    done = run_loop(texts(spark, "a", None, "b"), [Rule("R1", "c", "not_null")], ["rk"], run_id="run")
    store.save_iterations(done.iterations)
    store.save_analyses(done.analyses)
    rounds = store.iterations("run").collect()
    assert [(r["iteration_number"], r["action_taken"]) for r in rounds] == [(1, "Iteration 1: fixes_applied"), (2, "Iteration 2: all_passed")]
    assert store.iterations(limit=1).count() == 1


def test_recent_runs_are_newest_first(store, outcome):
    ids = [store.save_run(name, outcome.rule_results) for name in "abc"]
    assert [r["run_id"] for r in store.recent_runs(2).collect()] == ids[:0:-1]
