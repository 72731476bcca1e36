"""Properties that matter on a large cluster: scans, shuffles, hot keys."""

from __future__ import annotations

from contextlib import contextmanager

import pytest
from plan_audit import audit, final_plan
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators.joins import salted_left_join
from tidemark.plans import cleaning, facts, funnel, trials
from tidemark.sources import schemas
from tidemark.sources.tables import write_table


@contextmanager
def settings(spark, values):
    before = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


ONE_LOG_SCAN = [
    "funnel_summary", "funnel_transitions", "cohort_retention", "trial_dropoff_curve", "dropoff_cliff", "feature_adoption",
    "user_segmentation", "user_segments", "lifetime_stats", "weekly_conversion", "advanced_analytics", "adoption_chi2",
]


@pytest.mark.parametrize("name", ONE_LOG_SCAN)
def test_marts_read_the_log_once(spark, sf_dir, name):
    found = audit(entry.queries()[name](spark, sf_dir))
    assert found["scans"]["events"] == 1
    assert found["nested_loop"] == 0


@pytest.mark.parametrize("name", ["join_semantics", "window_rank_family", "roc_auc", "ab_test_results", "clean_events", "class_weights"])
def test_no_cross_joins_and_no_python_in_plans(spark, sf_dir, name):
    plan = final_plan(entry.queries()[name](spark, sf_dir))
    for node in ("NestedLoopJoin", "CartesianProduct", "EvalPython", "InPandas", "InArrow"):
        assert node not in plan


def test_funnel_scan_reads_only_what_it_needs(spark, tmp_path, make_users, make_events):
    write_table(make_events((1, "install", 0)), str(tmp_path / "events"))
    events = spark.read.schema(schemas.EVENTS).parquet(str(tmp_path / "events"))
    stages = tuple(f"reached_{stage}" for stage, _ in facts.STAGES)
    plan = final_plan(funnel.funnel_summary(facts.user_facts(make_users({"user_id": 1}), events, flags=stages)))
    scan = next(line for line in plan.split("\n") if "FileScan" in line)
    assert "ReadSchema: struct<user_id:bigint,event_name:string>" in scan


def test_drop_off_scan_pushes_the_event_filter(spark, tmp_path, make_users, make_events):
    write_table(make_events((1, "trial_started", 0)), str(tmp_path / "events"))
    events = spark.read.schema(schemas.EVENTS).parquet(str(tmp_path / "events"))
    plan = final_plan(trials.trial_dropoff_curve(make_users({"user_id": 1}), events))
    scan = next(line for line in plan.split("\n") if "FileScan" in line)
    assert "In(event_name, [feature_used,session_start,trial_started])" in scan
    assert "event_timestamp" not in scan.split("ReadSchema")[1]


def hot_log(spark, n=60_000, users=500):
    """A third of all events belongs to user 0."""
    i = F.col("id")
    uid = F.when(i % 3 == 0, F.lit(0)).otherwise(F.pmod(F.xxhash64("id"), F.lit(users)))
    name = F.element_at(
        F.array(*[F.lit(e) for e in ("session_start", "feature_used", "trial_started", "purchase_completed", "install")]),
        (F.pmod(F.xxhash64("id", F.lit(7)), F.lit(5)) + 1).cast("int"),
    )
    day = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(90)).cast("int")
    return spark.range(0, n, 1, 16).select(
        i.alias("event_id"), uid.alias("user_id"), F.lit(1).alias("app_id"), name.alias("event_name"),
        F.when(name == "feature_used", "collaboration_feature").alias("event_subtype"),
        F.date_add(F.lit("2024-01-01").cast("date"), day).cast("timestamp_ntz").alias("event_timestamp"),
        day.alias("day_offset"),
    )


def test_hot_user_is_combined_before_the_shuffle(spark):
    """What leaves the map side of the facts: at most one row per user and task."""
    log = hot_log(spark)
    written = facts.event_facts(log)
    written.collect()
    per_task_users = log.select("user_id", F.spark_partition_id().alias("task")).distinct().count()
    node = written._jdf.queryExecution().executedPlan().executedPlan()
    while node.nodeName() != "Exchange":
        node = node.plan() if "QueryStage" in node.nodeName() else node.children().apply(0)
    rows = node.metrics().apply("shuffleRecordsWritten").value()
    assert rows == per_task_users < log.count() / 6


def test_clean_events_splits_a_hot_user(spark):
    """With the user side too large to broadcast and the engine's own skew join off, the hot user's events are spread."""
    log = hot_log(spark, n=200_000)
    users = spark.range(500).select(F.col("id").alias("user_id"))
    plain = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.enabled": "false",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "64",
    }
    with settings(spark, plain):
        kept = cleaning.clean_events(log, users, at_most=200)
        sizes = [r["count"] for r in kept.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 200_000 == kept.select("event_id").distinct().count()
        assert max(sizes) < 200_000 / 20  # a third of all events without the split
        assert cleaning.heavy_users(log, 200).count() < 200


def test_hot_device_is_spread(spark):
    users = spark.range(9_000).select(
        F.col("id").alias("user_id"), F.when(F.col("id") % 3 == 0, "farm").otherwise(F.concat(F.lit("d"), F.col("id"))).alias("device_id")
    )
    shared = spark.createDataFrame([("farm", True)], "device_id string, on_shared_device boolean")
    wide = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "64",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    with settings(spark, wide):
        joined = salted_left_join(users, shared, "device_id", F.col("user_id"))
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert joined.filter("on_shared_device").count() == 3_000
    assert max(sizes) < 3_000 / 3  # without salting one task gets all 3,000


def test_hot_user_results_are_whole(spark):
    """The folded plans against the definition, on a log with a hot user."""
    log = hot_log(spark)
    users = spark.createDataFrame(
        [(i, 1, None, None, None, "US", "ads", None, None, False) for i in range(400)], schemas.USERS
    )
    curve = {r.day_offset: r.pct_active for r in trials.trial_dropoff_curve(users, log).collect()}
    kept = log.join(users.select("user_id"), "user_id", "left_semi")
    trial = kept.filter("event_name = 'trial_started'").select("user_id", F.col("day_offset").alias("start"))
    active = kept.filter("event_name IN ('session_start', 'feature_used')").select("user_id", "day_offset").distinct()
    n = trial.count()
    direct = (
        trial.distinct().join(active, "user_id").select("user_id", (F.col("day_offset") - F.col("start")).alias("d"))
        .filter("d BETWEEN 0 AND 30").groupBy("d").agg(F.countDistinct("user_id").alias("users")).collect()
    )
    assert curve == {r.d: pytest.approx(100 * r.users / n, abs=0.0051) for r in direct}
