from __future__ import annotations

import datetime as dt
import sys

import pytest
from pyspark.sql import functions as F, types as T

from tidemark.plans import catalog, facts, propensity, quality
from tidemark.sources import export, schemas, staging, tables, testbed

RAW_HEADER = "App,Category,Rating,Reviews,Installs,Price\n"


def raw(spark, tmp_path, *lines):
    path = tmp_path / "raw.csv"
    path.write_text(RAW_HEADER + "\n".join(lines) + "\n")
    return tables.read_raw_catalog(spark, str(path), schemas.RAW_CATALOG)


def test_catalog_rules(spark, tmp_path):
    table = raw(
        spark,
        tmp_path,
        'Zed,PRODUCTIVITY,4.5,1,"10,000+",0',
        "Old,PRODUCTIVITY,3.9,1,5+,0",
        "Gratis,PRODUCTIVITY,4.5,1,Free,0",
        "NoStars,PRODUCTIVITY,NaN,1,5+,0",
        "Edge,PRODUCTIVITY,4.0,1,5+,$1.99",
        '"Ed, ge",PRODUCTIVITY,4.1,1,7+,Everyone',
        'Zed,PRODUCTIVITY,4.9,1,"20,000+",0',
        "Late,PRODUCTIVITY,3.0,1,5+,0",
        "Late,PRODUCTIVITY,4.2,1,6+,",
        "Game,GAME,4.5,1,5+,0",
        "Junk,PRODUCTIVITY,4.4,1,many,0",
    )
    got = [tuple(r) for r in catalog.catalog_clean(table, buckets=3).orderBy("app_id").collect()]
    assert got == [
        (1, "Zed", "PRODUCTIVITY", 4.5, 10000, 0.0),
        (2, "Edge", "PRODUCTIVITY", 4.0, 5, 1.99),
        (3, "Ed, ge", "PRODUCTIVITY", 4.1, 7, None),
        (4, "Late", "PRODUCTIVITY", 4.2, 6, None),  # the first copy that passes the filters
    ]


def test_catalog_with_missing_columns_is_refused(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text("App,Rating\nx,4\n")
    with pytest.raises(ValueError, match="Category"):
        tables.read_raw_catalog(spark, str(path), schemas.RAW_CATALOG)


def test_csv_keeps_types_and_nulls(spark, tmp_path, make_users, rows):
    users = make_users({"user_id": 1, "ab_group": None}, {"user_id": 2, "ab_group": "control", "device_id": 'a,"b"'})
    tables.write_table(users, str(tmp_path / "u"), fmt="csv")
    back = tables.read_table(spark, str(tmp_path / "u"), schemas.USERS, "csv")
    assert back.schema == schemas.USERS and rows(back) == rows(users)


def test_csv_as_a_data_frame_library_writes_it(spark, tmp_path):
    users = tmp_path / "users.csv"
    users.write_text(
        ",".join(schemas.USERS.names) + "\n"
        "7,3,2024-03-05 10:11:12.131415,2024-03-01,abc,US,paid_search,x@y.com,,True\n"
        "8,3,2024-03-06 00:00:00,2024-03-01,,IN,referral,,treatment,False\n"
    )
    got = [tuple(r) for r in tables.read_csv(spark, str(users), schemas.USERS).collect()]
    assert got == [
        (7, 3, dt.datetime(2024, 3, 5, 10, 11, 12, 131415), dt.date(2024, 3, 1), "abc", "US", "paid_search", "x@y.com", None, True),
        (8, 3, dt.datetime(2024, 3, 6), dt.date(2024, 3, 1), None, "IN", "referral", None, "treatment", False),
    ]
    events = tmp_path / "events.csv"
    events.write_text(",".join(schemas.EVENTS.names) + "\n1,7,3,install,,2024-03-05 10:11:12.131415,0\n")
    assert tables.read_csv(spark, str(events), schemas.EVENTS).first().event_subtype is None


def test_malformed_csv_fails(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("app_id,app_name,category,Rating,Installs,Price\nx,a,b,1,2,3\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        tables.read_csv(spark, str(path), schemas.APPS).collect()


def test_required_tables(spark, make_users):
    tables.register({"t_users": make_users({"user_id": 1})})
    tables.require_tables(spark, ["t_users"])
    assert "t_users" in {r.name for r in tables.list_tables(spark).collect()}
    with pytest.raises(FileNotFoundError, match="t_absent"):
        tables.require_tables(spark, ["t_users", "t_absent"])


def test_partitioned_write(spark, tmp_path, make_events):
    tables.write_table(make_events((1, "install", 0), (1, "install", 2)), str(tmp_path / "e"), partition_by=["day_offset"])
    assert spark.read.parquet(str(tmp_path / "e")).filter("day_offset = 2").count() == 1


def test_export_keeps_names_apart(spark, tmp_path):
    marts = {"a" * 40: spark.range(3), "a" * 31 + "b": spark.range(100), "b": spark.range(0)}
    folders = export.export_marts(marts, str(tmp_path))
    got = sorted(tuple(r) for r in export.manifest(spark, marts, folders).collect())
    assert got == [("a" * 40, "a" * 31, 3, 1), ("a" * 31 + "b", "a" * 29 + "_2", 100, 1), ("b", "b", 0, 1)]
    assert len([p for p in (tmp_path / ("a" * 40)).iterdir() if p.name.startswith("part-")]) == 1


def test_staging_goes_to_the_configured_folder(spark):
    configured = spark.conf.get("spark.checkpoint.dir")
    assert staging.shared_dir(spark) == configured.rstrip("/")
    staged = staging.stage(spark.range(5), "numbers")
    assert all(f.removeprefix("file://").removeprefix("file:").startswith(configured) for f in staged.inputFiles())


def test_release_deletes_what_was_staged(spark, tmp_path):
    import os

    path = staging.stage(spark.range(5), "gone").inputFiles()[0].removeprefix("file://").removeprefix("file:")
    assert os.path.exists(path)
    staging.release(spark)
    assert not os.path.exists(path)


def report(checks):
    return {r["check"]: (r.n_bad, r.passed) for r in quality.quality_report(checks).collect()}


def test_quality_checks_find_planted_faults(spark, make_users, make_events):
    users = make_users({"user_id": 1}, {"user_id": 1}, {"user_id": None}, {"user_id": 4, "install_timestamp": None})
    funnel = spark.createDataFrame(
        [(10, 8, 9, 3, 3, 4, 80.0, 112.5, 33.33, 100.0, 99.0)],
        "n_install long, n_signup long, n_first_session long, n_feature long, n_trial long, n_purchase long,"
        "pct_install_to_signup double, pct_signup_to_session double, pct_session_to_feature double,"
        "pct_feature_to_trial double, pct_trial_to_purchase double",
    )
    kept = spark.createDataFrame(
        [(10.0, 20.0, None), (101.0, 5.0, -1.0)], "d1_retention_pct double, d7_retention_pct double, d14_retention_pct double"
    )
    curve = spark.createDataFrame(
        [(7, 1.0), (8, 50.0), (9, 40.0), (11, 45.0), (12, 45.0)], "day_offset int, pct_active double"
    )
    assert report(
        [
            quality.unique_key("key", users, "user_id"),
            quality.required_values("filled", users, ["user_id", "install_timestamp"]),
            quality.funnel_monotone(funnel),
            quality.step_rates_consistent(funnel),
            quality.retention_in_range(kept),
            quality.d1_at_least_d7(kept),
            quality.curve_non_increasing(curve),
            quality.segments_sum_to_100(spark.createDataFrame([(60.0,), (39.95,)], "pct_of_total double")),
            quality.importances_sum_to_one(spark.createDataFrame([(0.5,), (0.4,)], "Importance double")),
            quality.present("columns", users, ["user_id", "nope"]),
            quality.cliff_on_day(spark.createDataFrame([(6,)], "cliff_day int"), 6),
        ]
    ) == {
        "key": (2, False),
        "filled": (2, False),
        "funnel_monotone": (2, False),
        "step_rates_consistent": (1, False),
        "retention_pct_in_range": (2, False),
        "d1_retention_at_least_d7": (1, False),
        "curve_non_increasing_after_peak": (1, False),
        "segment_pct_sums_to_100": (0, True),
        "importances_sum_to_1": (1, False),
        "columns": (1, False),
        "cliff_on_expected_day": (0, True),
    }


def test_leakage_check_can_fail(make_users, make_events):
    users = make_users({"user_id": 1, "ab_group": "control"}, {"user_id": 2, "ab_group": "control"})
    events = make_events((1, "purchase_completed", 2), (1, "trial_started", 0), (2, "purchase_completed", 9))
    guarded = propensity.propensity_features(facts.user_facts(users, events))
    assert report([quality.no_leakage(guarded, events)]) == {"no_label_leakage": (0, True)}
    assert report([quality.no_leakage(users.select("user_id"), events)]) == {"no_label_leakage": (1, False)}


def test_command_line_builds_everything(spark, tmp_path, make_users, make_events, monkeypatch, capsys):
    from tidemark import __main__ as cli

    users = make_users(*[{"user_id": i, "ab_group": "control" if i % 2 else "treatment"} for i in range(60)])
    events = make_events(
        *[(i, "trial_started", 0) for i in range(60)],
        *[(i, "session_start", d) for i in range(60) for d in range(i % 5)],
        *[(i, "purchase_completed", 8) for i in range(0, 60, 3)],
    )
    tables.write_table(users, str(tmp_path / "users"))
    tables.write_table(events, str(tmp_path / "events"))
    (tmp_path / "apps.csv").write_text(RAW_HEADER + "Zed,PRODUCTIVITY,4.5,1,5+,0\n")
    out = tmp_path / "out"
    monkeypatch.setattr(
        sys, "argv",
        ["tidemark", "--users", str(tmp_path / "users"), "--events", str(tmp_path / "events"), "--out", str(out), "--trees", "3", "--apps", str(tmp_path / "apps.csv")],
    )
    cli.main()
    names = {p.name for p in out.iterdir()}
    assert {"funnel_summary", "ab_test_results", "kpi_summary", "model_feature_importance", "model_metrics"} <= names
    assert {"apps", "quality_report", "bot_filter_quality", "ab_labels"} <= names
    kpi = spark.read.option("header", True).csv(str(out / "kpi_summary")).first()
    assert kpi.top_feature and 0 < float(kpi.top_feature_importance) <= 1
    funnel = spark.read.option("header", True).csv(str(out / "funnel_summary")).first()
    assert (funnel.n_install, funnel.n_trial, funnel.n_purchase) == ("60", "60", "20")
    assert "funnel_summary" in capsys.readouterr().out


def test_quality_checks_fail_on_nothing(spark, make_users, make_events):
    nothing = make_users()
    funnel = spark.createDataFrame(
        [],
        "n_install long, n_signup long, n_first_session long, n_feature long, n_trial long, n_purchase long,"
        "pct_install_to_signup double, pct_signup_to_session double, pct_session_to_feature double,"
        "pct_feature_to_trial double, pct_trial_to_purchase double",
    )
    kept = spark.createDataFrame([], "d1_retention_pct double, d7_retention_pct double, d14_retention_pct double")
    curve = spark.createDataFrame([], "day_offset int, pct_active double")
    ab = "control_rate double, treatment_rate double, has_srm boolean"
    null_ab = spark.createDataFrame([(None, 0.3, None)], ab)
    checks = [
        quality.present("present", nothing, ["user_id"]),
        quality.unique_key("key", nothing, "user_id"),
        quality.required_values("filled", nothing, ["user_id"]),
        quality.bots_removed(nothing.selectExpr("true AS is_suspected_bot")),
        quality.funnel_monotone(funnel),
        quality.step_rates_consistent(funnel),
        quality.rate_near("rate", funnel, F.col("n_signup") / F.col("n_install"), 0.8, 0.1),
        quality.no_srm(null_ab),
        quality.plausible_rates(null_ab),
        quality.no_leakage(nothing.select("user_id"), make_events()),
        quality.retention_in_range(kept),
        quality.d1_at_least_d7(kept),
        quality.segments_sum_to_100(spark.createDataFrame([], "pct_of_total double")),
        quality.importances_sum_to_one(spark.createDataFrame([], "Importance double")),
        quality.curve_non_increasing(curve),
        quality.cliff_on_day(spark.createDataFrame([], "cliff_day int"), 6),
    ]
    found = report(checks)
    assert len(found) == len(checks) and {name for name, (n_bad, passed) in found.items() if passed or not n_bad} == set()
    assert report([quality.no_srm(null_ab.limit(0)), quality.cliff_on_day(spark.createDataFrame([(None,)], "cliff_day int"), 6)]) == {
        "no_sample_ratio_mismatch": (1, False), "cliff_on_expected_day": (1, False)
    }


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01", "sf0.1"])
def test_the_adapter_keeps_every_event(spark, scale):
    path = f"/root/testdata/{scale}"
    assert testbed.events(spark, path).count() == spark.read.parquet(f"{path}/events.parquet").count()
    assert testbed.events(spark, path).filter("day_offset < 0").count() == 0


def test_catalogue_files_need_an_order(spark, tmp_path):
    spark.range(10).selectExpr("id AS App").repartition(3).write.option("header", True).csv(str(tmp_path / "c"))
    schema = T.StructType([T.StructField("App", T.StringType())])
    with pytest.raises(ValueError, match="order"):
        tables.read_raw_catalog(spark, str(tmp_path / "c"), schema)
    assert tables.read_raw_catalog(spark, str(tmp_path / "c"), schema, order_by="App").count() == 10
