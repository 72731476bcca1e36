"""Tables that are replaced whole, logs laid out by user, facts that grow by load, exports of any size, quarantine."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest
from plan_audit import final_plan
from pyspark.sql import functions as F
from test_scale import hot_log, settings

from tidemark.operators import bitmaps
from tidemark.plans import cleaning, daily, experiments, facts, quality, trials
from tidemark.sources import export, schemas, tables, userlog, versions

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
NO_BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "-1"}


# --- versions ----------------------------------------------------------------


def test_a_failed_write_leaves_the_old_table(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    versions.replace(spark.range(5), path)
    half = spark.range(0, 100, 1, 10).select(F.when(F.col("id") < 60, F.col("id")).otherwise(F.raise_error(F.lit("half-way")).cast("long")).alias("id"))
    with pytest.raises(Exception, match="half-way"):
        versions.replace(half, path)
    assert rows(versions.read_current(spark, path)) == [(i,) for i in range(5)]
    left = versions.children(spark, path)
    assert len(left) == 3  # the markers, the table, and what the failed write left
    versions.replace(spark.range(3), path)
    assert len(versions.prune(spark, path, keep=1)) == 2
    assert rows(versions.read_current(spark, path)) == [(i,) for i in range(3)]


def test_a_plan_may_replace_what_it_reads(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    old = versions.replace(spark.range(4), path)
    new = versions.replace(old.unionAll(versions.read_current(spark, path)), path)
    assert rows(new) == sorted([(i,) for i in range(4)] * 2) and rows(old) == [(i,) for i in range(4)]


def test_no_table_no_read(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        versions.read_current(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        versions.prune(spark, str(tmp_path / "none"), keep=0)


# --- log by user -------------------------------------------------------------


@pytest.fixture(scope="module")
def laid(spark, tmp_path_factory):
    """A log with a hot user, a few heavy ones and events without a user, laid out in two writes."""
    log = hot_log(spark, n=20_000, users=200).withColumn("user_id", F.when(F.col("event_id") % 50 != 7, F.col("user_id")))
    path = str(tmp_path_factory.mktemp("log") / "user-log")
    userlog.lay_out(log.filter("day_offset < 60"), path, buckets=8, at_most=50)
    return log, userlog.append(log.filter("day_offset >= 60"), path), path


def above(lines, at):
    """The lines of the operators above one, the nearest first."""
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    out, here = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < here:
            out.append(line)
            here = depth(line)
    return out


def moves_events(plan):
    """Whether rows of the bucketed log cross an exchange before they are folded, if they are."""
    lines = plan.split("\n")
    for at, line in enumerate(lines):
        if "FileScan" in line and "Bucketed: true" in line:
            for operator in above(lines, at):
                if "Aggregate(" in operator and "partial_" not in operator:
                    break
                if "Exchange" in operator:
                    return True
    return False


def test_folds_of_a_bucketed_log_move_no_event(spark, laid, make_users):
    log, by_user, _ = laid
    users = make_users(*[{"user_id": i} for i in range(0, 220, 2)])
    with settings(spark, NO_BROADCAST):
        for make in (
            lambda events: facts.user_facts(users, events).drop("install_timestamp"),
            lambda events: trials.trial_dropoff_curve(users, events),
            lambda events: cleaning.clean_events(events, users),
        ):
            plan = final_plan(make(by_user))
            assert "Bucketed: true" in plan and not moves_events(plan)
            assert sorted(map(tuple, make(by_user).collect()), key=repr) == sorted(map(tuple, make(log).collect()), key=repr)


def test_heavy_users_lie_apart_and_nothing_is_lost(spark, laid, rows):
    log, by_user, path = laid
    heavy = {r["user_id"] for r in by_user.heavy_users.collect()}
    assert 0 in heavy and len(heavy) < 50
    assert by_user.ordinary.filter(F.col("user_id").isin(*heavy) | F.col("user_id").isNull()).count() == 0
    assert rows(by_user.all.select("event_id", "user_id")) == rows(log.select("event_id", "user_id"))
    again = userlog.open_log(spark, path)
    assert again.all.count() == log.count()


def test_a_session_that_did_not_write_the_log_reads_its_buckets(spark, laid):
    _, by_user, path = laid
    spark.sql(f"DROP TABLE {userlog.table_name(path + '/ordinary')}")
    reopened = userlog.open_log(spark, path)
    assert reopened.ordinary.count() == by_user.all.count() - by_user.heavy.count()
    assert "Bucketed: true" in final_plan(reopened.ordinary.groupBy("user_id").count())


# --- facts by load -----------------------------------------------------------


def plain(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_loads_give_what_the_whole_log_gives(spark, tmp_path, make_users):
    """Loads of a random week each, so days come in any order and late; folds between them; one load delivered twice."""
    log = hot_log(spark, n=6_000, users=80)
    users = make_users(*[{"user_id": i} for i in range(0, 100)])
    store = daily.DailyFacts(spark, str(tmp_path / "facts"), buckets=4)
    assert plain(store.user_facts(users)) == plain(facts.user_facts(users, log.limit(0)))
    part = F.pmod(F.xxhash64("event_id", F.lit(3)), F.lit(6))
    for load in range(6):
        if load == 4:
            store.add("l4", log.filter(part == 0))  # a wrong delivery, replaced below
        store.add(f"l{load}", log.filter(part == load))
        so_far = log.filter(part <= load)
        if load in (1, 3):
            store.fold()
        if load in (0, 3, 5):
            assert plain(store.user_facts(users)) == plain(facts.user_facts(users, so_far))
            assert plain(store.dropoff_curve(users)) == plain(trials.trial_dropoff_curve(users, so_far))
    assert store.folded_loads() == {"l0", "l1", "l2", "l3"} and store.loads() == [f"l{i}" for i in range(6)]
    with pytest.raises(ValueError, match="folded"):
        store.add("l0", log)


def test_a_new_load_does_not_move_the_folded_state(spark, tmp_path, make_users):
    log = hot_log(spark, n=3_000, users=60)
    store = daily.DailyFacts(spark, str(tmp_path / "facts"), buckets=4)
    store.add("a", log.filter("day_offset < 70"))
    store.fold()
    store.add("b", log.filter("day_offset >= 70"))
    with settings(spark, NO_BROADCAST):
        plan = final_plan(store.state())
    lines = plan.split("\n")
    base = next(i for i, line in enumerate(lines) if "FileScan" in line and "Bucketed: true" in line)
    up = above(lines, base)
    assert not [line for line in up[: next(i for i, line in enumerate(up) if "Join" in line)] if "Exchange" in line]


def test_a_failed_load_or_fold_changes_nothing(spark, tmp_path, make_users, monkeypatch):
    users, log = make_users({"user_id": 1}), hot_log(spark, n=500, users=5)
    store = daily.DailyFacts(spark, str(tmp_path / "facts"), buckets=2)
    store.add("a", log)
    before = plain(store.user_facts(users))
    with pytest.raises(Exception, match="broken"):
        store.add("b", log.withColumn("event_name", F.raise_error(F.lit("broken"))))
    monkeypatch.setattr(daily, "write_bucketed", lambda *a, **k: (_ for _ in ()).throw(OSError("disk full")))
    with pytest.raises(OSError):
        store.fold()
    assert store.loads() == ["a"] and store.folded_loads() == set() and plain(store.user_facts(users)) == before


def test_states_merge_blocks_of_one_number(spark, make_events):
    early = daily.state_of(make_events((1, "trial_started", 3), (1, "session_start", 5), (1, "session_start", 70)))
    late = daily.state_of(make_events((1, "session_start", 4), (1, "trial_started", 66), (2, "install", 0)))
    for merged in (daily.merge([early, late]), daily.merge_into(early, late)):
        row = {r["user_id"]: r for r in merged.collect()}
        blocks = {b["block"]: (b["n_trials"], b["trial_bits"], b["active_bits"]) for b in row[1]["blocks"]}
        assert blocks == {0: (1, 1 << 3, (1 << 4) | (1 << 5)), 1: (1, 1 << 2, 1 << 6)}
        assert row[2]["blocks"] == [] and row[2]["n_events"] == 1


# --- export ------------------------------------------------------------------


def test_marts_of_any_size(spark, tmp_path):
    many = spark.range(0, 5_000, 1, 7).select((4_999 - F.col("id")).alias("k"), F.lit("a,b").alias("text"))
    done = export.write_marts({"many": many, "few": spark.range(3), "none": spark.range(0)}, str(tmp_path), rows_per_file=1_000)
    assert {n: (d.n_rows, d.n_files) for n, d in done.items()} == {"many": (5_000, 5), "few": (3, 1), "none": (0, 1)}
    parts = sorted(p for p in (tmp_path / "many").iterdir() if p.name.startswith("part-"))
    assert len(parts) == 5
    keys = [[int(line.split(",")[0]) for line in p.read_text().splitlines()[1:]] for p in parts]
    assert [k for part in keys for k in part] == list(range(5_000))  # ranges in order, each in order
    assert all(p.read_text().startswith("k,text\n") for p in parts)
    back = spark.read.schema(many.schema).option("header", True).csv(str(tmp_path / "many"))
    assert back.agg(F.sum(export.row_checksum(back.columns))).first()[0] == done["many"].checksum != 0


def test_checksum_notices_changes_and_ignores_order(spark):
    def total(*values):
        df = spark.createDataFrame(list(values), "a string, b double, c int")
        return df.agg(F.sum(export.row_checksum(df.columns))).first()[0]

    base = total(("x", 0.5, 1), ("y", None, 2))
    assert base == total(("y", None, 2), ("x", 0.5, 1))
    assert len({base, total(("x", 0.5, 2), ("y", None, 1)), total(("x", 0.500001, 1), ("y", None, 2)), total(("x", 0.5, 1))}) == 4


# --- quarantine --------------------------------------------------------------


def test_bad_lines_go_to_the_side_table(spark, tmp_path):
    header = ",".join(schemas.EVENTS.names)
    good = ["1,1,1,install,,2024-01-01T00:00:00,0", '2,1,1,"a, b",x,2024-01-02T00:00:00,1', ",,,,,,"]
    bad = ["x,1,1,install,,2024-01-01T00:00:00,0", "4,1,1,install,,someday,0", "5,1,1,install,,2024-01-01T00:00:00,0,9", "6,1,1", '"7,1,1']
    (tmp_path / "a.csv").write_text("\n".join([header, *good[:2], *bad[:3]]) + "\n")
    (tmp_path / "b.csv").write_text("\n".join([header, good[2], *bad[3:]]) + "\n")
    scan = tables.scan_csv(spark, str(tmp_path), schemas.EVENTS)
    assert sorted((r["event_id"] or 0, r["event_name"]) for r in scan.good.collect()) == [(0, None), (1, "install"), (2, "a, b")]
    found = {r["record"]: (os.path.basename(r["file"]), r["reason"]) for r in scan.quarantined.collect()}
    assert found == {
        bad[0]: ("a.csv", "event_id is no bigint"), bad[1]: ("a.csv", "event_timestamp is no timestamp_ntz"), bad[2]: ("a.csv", tables.TOO_MANY),
        bad[3]: ("b.csv", tables.UNFIT), bad[4]: ("b.csv", found[bad[4]][1]),
    }
    report = quality.quality_report([quality.none_quarantined("clean_input", scan.quarantined), quality.none_quarantined("ok", scan.quarantined.limit(0))])
    assert quality.failed(report) == [("clean_input", 5)]


# --- distinct counts ---------------------------------------------------------


def test_bitmaps_count_and_roll_up(spark, rows):
    df = spark.createDataFrame(
        [("a", "x", 1), ("a", "x", 1), ("a", "y", 40_000), ("a", "y", 1), ("b", "x", 40_000), ("b", "x", None), (None, "y", 3), ("c", "x", 5)],
        "g string, h string, n long",
    )
    sets = {"all": F.lit(True), "in_x": F.col("h") == "x"}
    maps = bitmaps.id_bitmaps(df, ["g", "h"], "n", sets)
    assert rows(bitmaps.distinct_counts(bitmaps.roll_up(maps, ["g"], list(sets)), ["g"], list(sets))) == sorted(
        [("a", 2, 1), ("b", 1, 1), (None, 1, 0), ("c", 1, 1)], key=repr
    )
    assert rows(bitmaps.distinct_counts(bitmaps.roll_up(maps, [], list(sets)), [], list(sets))) == [(4, 3)]
    plan = final_plan(bitmaps.distinct_counts(maps, ["g"], list(sets)))
    assert "Expand" not in plan and "partial_bitmap_construct_agg" in plan


# --- registry and command line ----------------------------------------------


def test_core_queries_stay_without_the_packages_of_the_optional_part():
    code = (
        "import sys, warnings; sys.modules['ahocorasick'] = None; warnings.simplefilter('ignore');"
        "import __spark_entry__ as e; q = e.queries(); assert 'funnel_summary' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_models_are_forgotten_with_their_tables(spark, sf_dir, monkeypatch):
    from tidemark.checks import queries

    app = spark.sparkContext.applicationId
    monkeypatch.setattr(queries, "_MODELS", {(app, "x"): "fitted here", ("other", "x"): "fitted there"})
    queries._forget_models(app)
    assert list(queries._MODELS) == [("other", "x")]
    assert versions.stamp(spark, f"{sf_dir}/customer.parquet") != versions.stamp(spark, f"{sf_dir}/nation.parquet")


def test_failed_checks_are_said(spark):
    report = spark.createDataFrame([("b", 2, False), ("a", 0, True), ("c", 1, False)], "check string, n_bad long, passed boolean")
    assert quality.failed(report) == [("b", 2), ("c", 1)]


def test_labels_by_group(spark):
    arms = spark.createDataFrame(
        [("x", "control", 1000, 100), ("x", "treatment", 1000, 200), ("y", "control", 1000, 100), ("y", "treatment", 1000, 101)],
        "channel string, ab_group string, n_users long, n_purchases long",
    )
    readout = experiments.ab_test_results(arms, ("channel",))
    chi2 = spark.createDataFrame([], "p_value double, is_significant boolean")
    flags = {r["channel"]: r["significance_flag"] for r in experiments.ab_labels(readout, chi2, ("channel",)).collect()}
    assert flags["x"].startswith("Statistically") and flags["y"] == "Not Significant"
