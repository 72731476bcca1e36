"""Registered queries: every operator and mart over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import dates, text
from tidemark.functions.numeric import round_to, to_number
from tidemark.operators.bitmaps import distinct_counts, id_bitmaps, roll_up
from tidemark.operators.joins import id_overlap
from tidemark.operators.ordering import SMALL, exact_percentiles
from tidemark.plans import (
    catalog, cleaning, daily, engagement, experiments, facts, funnel, kpis, propensity, retention, segments, trials,
)
from tidemark.plans.facts import STAGES
from tidemark.sources import schemas, tables, testbed, userlog, versions
from tidemark.sources.export import checksums, manifest_of, write_marts
from tidemark.sources.staging import new_path, on_release, stage
from tidemark.warehouse import Warehouse

Query = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


STAGE_FLAGS = tuple(f"reached_{stage}" for stage, _ in STAGES)


def warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    log = testbed.events(spark, sf_dir)
    return Warehouse(testbed.users(spark, sf_dir, log), log, testbed.MAX_USERS_PER_DEVICE)


def _rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """Doubles to fixed digits, so that the last bits of exp or asin do not matter."""
    return df.select(
        *[round_to(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


# --- sources and sinks -------------------------------------------------------


@query
def scan_csv_roundtrip(spark, sf_dir):
    """Users written as CSV and scanned back under the declared schema."""
    path = new_path(spark, "users_csv")
    tables.write_table(testbed.users(spark, sf_dir), path, fmt="csv")
    return tables.read_csv(spark, path, schemas.USERS)


def _faulty_lines(spark, sf_dir) -> DataFrame:
    """Users as CSV lines, of which some have a fault each: a word for a number, for a time or for a flag, a field too
    many, or too few."""
    uid, texts = F.col("user_id"), [F.col(f.name).cast("string") for f in schemas.USERS]
    names = schemas.USERS.names

    def faulty(name: str, text):
        planted = {"user_id": (5, "none"), "install_timestamp": (7, "soon"), "is_bot_ground_truth": (9, "perhaps")}
        if name not in planted:
            return text.alias(name)
        place, word = planted[name]
        return F.when(uid % 41 == place, word).otherwise(text).alias(name)

    line = F.to_csv(F.struct(*[faulty(name, text) for name, text in zip(names, texts)]))
    cut = F.substring_index(line, ",", 3)
    return testbed.users(spark, sf_dir).select(F.when(uid % 41 == 11, F.concat(line, F.lit(",more"))).when(uid % 41 == 13, cut).otherwise(line).alias("value"))


def _scanned(spark, sf_dir) -> tables.Scan:
    path = new_path(spark, "faulty-csv")
    _faulty_lines(spark, sf_dir).write.text(path)
    return tables.scan_csv(spark, path, schemas.USERS, header=False)


@query
def scan_csv_quarantine(spark, sf_dir):
    """The faulty lines by their first field, and what is wrong with each."""
    return _scanned(spark, sf_dir).quarantined.select(F.substring_index("record", ",", 1).alias("first_field"), "reason")


@query
def scan_csv_kept(spark, sf_dir):
    """The users of the other lines."""
    return _scanned(spark, sf_dir).good


@query
def export_manifest(spark, sf_dir):
    return manifest_of(spark, write_marts(warehouse(spark, sf_dir).marts(), new_path(spark, "export")))


@query
def export_checksums(spark, sf_dir):
    """Files, rows and checksums of all marts as written, orders among them as a mart of many files."""
    orders = testbed.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.to_date("o_orderdate").alias("o_day"))
    marts = {**warehouse(spark, sf_dir).marts(), "orders": orders}
    return checksums(spark, write_marts(marts, new_path(spark, "export"), rows_per_file=4_000))


# --- cleaning ----------------------------------------------------------------


@query
def device_reuse(spark, sf_dir):
    return cleaning.device_reuse(testbed.users(spark, sf_dir))


@query
def bot_flags(spark, sf_dir):
    return warehouse(spark, sf_dir).flagged_users.select("user_id", "is_suspected_bot")


@query
def clean_users(spark, sf_dir):
    return warehouse(spark, sf_dir).clean_users


@query
def clean_events(spark, sf_dir):
    return warehouse(spark, sf_dir).clean_events


@query
def bot_filter_quality(spark, sf_dir):
    return cleaning.bot_filter_quality(warehouse(spark, sf_dir).flagged_users)


@query
def id_set_overlap(spark, sf_dir):
    """Labelled bots against flagged users, as id sets."""
    flagged = warehouse(spark, sf_dir).flagged_users
    return id_overlap(flagged.filter("is_bot_ground_truth"), flagged.filter("is_suspected_bot"), "user_id")


# --- marts -------------------------------------------------------------------


@query
def user_facts(spark, sf_dir):
    return warehouse(spark, sf_dir).user_facts.drop("install_timestamp", "last_event_ts")


def _daily_store(spark, sf_dir) -> daily.DailyFacts:
    """The log arriving in weekly loads. One event in eleven is up to nine days late, so loads hold earlier days too; half-way
    the loads so far are folded, and the last load is delivered twice."""
    log = testbed.events(spark, sf_dir)
    late = F.when(F.col("event_id") % 11 == 0, (F.col("event_id") % 10).cast("int")).otherwise(0)
    arrived = F.date_add(F.to_date("event_timestamp"), late)
    path = new_path(spark, "arrivals")
    tables.write_table(log.withColumn("load", dates.week_start(arrived).cast("string")), path, partition_by=["load"])
    arrivals = spark.read.parquet(path)
    loads = [row["load"] for row in arrivals.select(F.col("load").cast("string")).distinct().orderBy("load").collect()]
    store = daily.DailyFacts(spark, new_path(spark, "daily-facts"), buckets=8)
    for i, load in enumerate([*loads, *loads[-1:]]):
        store.add(load, arrivals.filter(F.col("load") == load).drop("load"))
        if i == len(loads) // 2:
            store.fold()
    return store


@query
def user_facts_incremental(spark, sf_dir):
    """User facts folded load by load, late events included."""
    users = warehouse(spark, sf_dir).clean_users
    return _daily_store(spark, sf_dir).user_facts(users).drop("install_timestamp", "last_event_ts")


@query
def dropoff_incremental(spark, sf_dir):
    """The drop-off curve from the same store."""
    return _daily_store(spark, sf_dir).dropoff_curve(warehouse(spark, sf_dir).clean_users)


def _laid_out(spark, sf_dir) -> userlog.UserLog:
    """The log in buckets of users, laid out in two writes. The threshold is low, so that some users are heavy here."""
    log, path = testbed.events(spark, sf_dir), new_path(spark, "user-log")
    early = F.col("day_offset") < 20
    userlog.lay_out(log.filter(early), path, buckets=8, at_most=100)
    return userlog.append(log.filter(~early), path)


@query
def user_facts_bucketed(spark, sf_dir):
    """User facts from a log laid out by user: no event moves."""
    users = warehouse(spark, sf_dir).clean_users
    return facts.user_facts(users, _laid_out(spark, sf_dir)).drop("install_timestamp", "last_event_ts")


@query
def dropoff_bucketed(spark, sf_dir):
    return trials.trial_dropoff_curve(warehouse(spark, sf_dir).clean_users, _laid_out(spark, sf_dir))


@query
def clean_events_bucketed(spark, sf_dir):
    return cleaning.clean_events(_laid_out(spark, sf_dir), warehouse(spark, sf_dir).clean_users)


@query
def replaced_table(spark, sf_dir):
    """Customers, replaced by a plan that reads the table it replaces, twice; old versions are deleted."""
    path = new_path(spark, "replaced")
    versions.replace(testbed.read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.lit(0).alias("n_writes")), path)
    for _ in range(2):
        table = versions.read_current(spark, path)
        kept = table.filter((F.col("c_custkey") + F.col("n_writes")) % 5 != 0)
        versions.replace(kept.withColumn("n_writes", F.col("n_writes") + 1), path)
    versions.prune(spark, path, keep=1)
    return versions.read_current(spark, path)


@query
def funnel_summary(spark, sf_dir):
    return funnel.funnel_summary(warehouse(spark, sf_dir).facts_with(*STAGE_FLAGS))


@query
def funnel_transitions(spark, sf_dir):
    return funnel.funnel_transitions(funnel_summary(spark, sf_dir))


@query
def cohort_retention(spark, sf_dir):
    facts = warehouse(spark, sf_dir).facts_with("has_core_activity", *[f"active_d{d}" for d in retention.RETENTION_DAYS])
    return retention.cohort_retention(facts)


@query
def retention_long(spark, sf_dir):
    return retention.retention_long(cohort_retention(spark, sf_dir))


@query
def trial_dropoff_curve(spark, sf_dir):
    return warehouse(spark, sf_dir).dropoff_curve


@query
def dropoff_cliff(spark, sf_dir):
    return trials.dropoff_cliff(trial_dropoff_curve(spark, sf_dir))


@query
def feature_adoption(spark, sf_dir):
    return funnel.feature_adoption(
        warehouse(spark, sf_dir).facts_with("reached_trial", "reached_purchase", "used_collab")
    )


@query
def user_segmentation(spark, sf_dir):
    return segments.user_segmentation(warehouse(spark, sf_dir).facts_with("reached_purchase"))


@query
def user_segments(spark, sf_dir):
    return segments.assign_segments(warehouse(spark, sf_dir).facts_with("reached_purchase"))


@query
def lifetime_stats(spark, sf_dir):
    return engagement.lifetime_stats(warehouse(spark, sf_dir).facts_with())


def _orders_per_customer(spark, sf_dir) -> DataFrame:
    """Customers with their number of orders, 0 included; orders are folded before the join."""
    orders = testbed.read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    customer = testbed.read(spark, sf_dir, "customer").select("c_custkey")
    return customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey", F.coalesce("n_orders", F.lit(0)).alias("n_orders")
    )


@query
def engagement_bands(spark, sf_dir):
    """Bands over orders per customer: unlike sessions, few customers have none."""
    facts = _orders_per_customer(spark, sf_dir).select(
        F.col("n_orders").alias("session_count"), F.lit(-1).alias("purchase_day")
    )
    return engagement.engagement_bands(facts)


@query
def weekly_conversion(spark, sf_dir):
    return engagement.weekly_conversion(warehouse(spark, sf_dir).facts_with())


@query
def weekly_order_conversion(spark, sf_dir):
    """Distinct customers per order week, and those with a finished order. Both distinct
    counts follow from one fold by (week, customer)."""
    per_customer = (
        testbed.read(spark, sf_dir, "orders")
        .groupBy(dates.week_start(F.col("o_orderdate")).alias("cohort_week"), "o_custkey")
        .agg(F.max(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("converted"))
    )
    return per_customer.groupBy("cohort_week").agg(
        F.count(F.lit(1)).alias("customers"), F.sum("converted").alias("conversions")
    )


@query
def advanced_analytics(spark, sf_dir):
    return engagement.advanced_analytics(warehouse(spark, sf_dir).facts_with())


@query
def kpi_summary(spark, sf_dir):
    wh = warehouse(spark, sf_dir)
    stored, curve = wh.stored_facts, stage(wh.dropoff_curve, "curve")
    return _rounded(
        kpis.kpi_summary(
            funnel.funnel_summary(stored),
            curve,
            segments.user_segmentation(stored),
            funnel.feature_adoption(stored),
            engagement.advanced_analytics(stored),
        )
    )


@query
def catalog_csv(spark, sf_dir):
    """The raw catalogue as CSV, with columns nobody asked for, read back in the order of a number it holds."""
    path = new_path(spark, "catalog_csv")
    raw = testbed.raw_catalog(spark, sf_dir)
    tables.write_table(raw.select(F.lit("x").alias("Reviews"), "*", F.lit(None).cast("string").alias("Size")), path, fmt="csv")
    return tables.read_raw_catalog(spark, path, schemas.RAW_CATALOG, order_by="source_order")


@query
def catalog_clean(spark, sf_dir):
    return catalog.catalog_clean(testbed.raw_catalog(spark, sf_dir))


# --- experiments -------------------------------------------------------------


def _arms(spark, sf_dir, by=()):
    return experiments.arm_counts(warehouse(spark, sf_dir).facts_with("reached_purchase"), by)


@query
def ab_arm_counts(spark, sf_dir):
    return _arms(spark, sf_dir)


@query
def ab_srm(spark, sf_dir):
    sides = experiments.srm_check(experiments.arms_side_by_side(_arms(spark, sf_dir)))
    return _rounded(sides.select("n_c", "n_t", "srm_chi2", "srm_p_value", "has_srm"))


@query
def ab_power(spark, sf_dir):
    sides = experiments.power_check(experiments.arms_side_by_side(_arms(spark, sf_dir)))
    return _rounded(sides.select("n_c", "n_t", "required_n", "is_adequately_powered", "effect_h", "power"))


@query
def ab_ztest(spark, sf_dir):
    return _rounded(experiments.z_test(experiments.arms_side_by_side(_arms(spark, sf_dir))))


@query
def ab_test_results(spark, sf_dir):
    return _rounded(experiments.ab_test_results(_arms(spark, sf_dir)))


@query
def ab_test_by_channel(spark, sf_dir):
    """The same readout once per acquisition channel."""
    by = ("acquisition_channel",)
    return _rounded(experiments.ab_test_results(_arms(spark, sf_dir, by), by))


@query
def adoption_chi2(spark, sf_dir):
    return _rounded(experiments.adoption_chi2(feature_adoption(spark, sf_dir)))


@query
def ab_labels(spark, sf_dir):
    stored = warehouse(spark, sf_dir).stored_facts
    return experiments.ab_labels(
        experiments.ab_test_results(experiments.arm_counts(stored)),
        experiments.adoption_chi2(funnel.feature_adoption(stored)),
    )


@query
def ab_labels_by_channel(spark, sf_dir):
    """The display strings of each channel's readout."""
    stored, by = warehouse(spark, sf_dir).stored_facts, ("acquisition_channel",)
    readout = experiments.ab_test_results(experiments.arm_counts(stored, by), by)
    return experiments.ab_labels(readout, experiments.adoption_chi2(funnel.feature_adoption(stored)), by)


@query
def revenue_impact(spark, sf_dir):
    return _rounded(experiments.revenue_impact(experiments.ab_test_results(_arms(spark, sf_dir))), 6)


# --- propensity model --------------------------------------------------------


def _features(spark, sf_dir):
    return propensity.propensity_features(
        warehouse(spark, sf_dir).facts_with("used_collab_early", "purchased_early", "reached_purchase")
    )


@query
def propensity_features(spark, sf_dir):
    return _features(spark, sf_dir)


@query
def propensity_onehot(spark, sf_dir):
    features = stage(_features(spark, sf_dir), "features")
    encoder = propensity.fit_encoder(features)
    return propensity.encoded_long(encoder.transform(features), encoder)


@query
def stratified_split(spark, sf_dir):
    return propensity.stratified_split(_features(spark, sf_dir)).select(
        "user_id", propensity.LABEL, "is_test", "fold"
    )


@query
def class_weights(spark, sf_dir):
    return _rounded(propensity.class_weights(_features(spark, sf_dir)))


_MODELS: dict[tuple, propensity.FittedModel] = {}
#: Tables that users and events are drawn from.
_MODEL_TABLES = ("customer", "nation", "events")


def _forget_models(application: str) -> None:
    for key in [key for key in _MODELS if key[0] == application]:
        del _MODELS[key]


on_release(_forget_models)


def _model(spark, sf_dir) -> propensity.FittedModel:
    """The model of these tables as their files are now, fitted once per application and until its tables are released."""
    key = (spark.sparkContext.applicationId, sf_dir, *(versions.stamp(spark, f"{sf_dir}/{t}.parquet") for t in _MODEL_TABLES))
    if key not in _MODELS:
        _MODELS[key] = propensity.fit(_features(spark, sf_dir))
    return _MODELS[key]


@query
def propensity_cv(spark, sf_dir):
    return _model(spark, sf_dir).validation


@query
def propensity_scores(spark, sf_dir):
    return _model(spark, sf_dir).scores


@query
def feature_importance(spark, sf_dir):
    return _model(spark, sf_dir).importances


@query
def top_feature(spark, sf_dir):
    return propensity.top_feature(_model(spark, sf_dir).importances)


@query
def model_metrics(spark, sf_dir):
    """Hold-out figures of the model."""
    return propensity.model_metrics(_model(spark, sf_dir).scores)


@query
def model_checks(spark, sf_dir):
    """What SQL can say about the fitted model: rows and positives of the hold-out and of each fold, the features it
    knows, and that scores, predictions and importances are what they should be."""
    return propensity.model_checks(_model(spark, sf_dir))


def _labelled_documents(spark, sf_dir):
    labels = testbed.read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    documents = testbed.read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return documents.join(labels, "doc_id")


@query
def roc_auc(spark, sf_dir):
    """Document length modulo 50 as the score of the quality label: many ties, 50 values."""
    scored = _labelled_documents(spark, sf_dir).withColumn("score", (F.col("n_chars") % 50).cast("double"))
    return _rounded(propensity.roc_auc(scored, buckets=SMALL))


@query
def roc_auc_continuous(spark, sf_dir):
    """The document length itself as the score: as many values as the data has."""
    scored = _labelled_documents(spark, sf_dir).withColumn("score", F.col("n_chars").cast("double"))
    return _rounded(propensity.roc_auc(scored))


@query
def classification_report(spark, sf_dir):
    scored = _labelled_documents(spark, sf_dir).withColumn(
        "prediction", F.when(F.col("n_chars") % 50 >= 25, 1).otherwise(0)
    )
    return _rounded(propensity.classification_report(scored))


# --- primitives --------------------------------------------------------------


@query
def join_semantics(spark, sf_dir):
    """Left, left with a right-side condition, inner, semi and anti joins per segment.

    Orders are folded to one row per customer first, so a customer with a third
    of all orders is no hot key; pair counts are sums of the folded counts.
    """
    orders = testbed.read(spark, sf_dir, "orders")
    folded = orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("finished")
    )
    customer = testbed.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    n, finished = (F.coalesce(F.col(c), F.lit(0)) for c in ("n", "finished"))
    per_join = {
        "left": F.greatest(n, F.lit(1)),
        "left_with_condition": F.greatest(finished, F.lit(1)),
        "inner": n,
        "left_semi": (finished > 0).cast("int"),
        "left_anti": (finished == 0).cast("int"),
    }
    sums = customer.join(folded, "o_custkey", "left").groupBy("c_mktsegment").agg(
        *[F.sum(rows).alias(name) for name, rows in per_join.items()]
    )
    # a segment without a row of some join has no line there
    return sums.unpivot(["c_mktsegment"], list(per_join), "join_type", "n_rows").filter("n_rows > 0").select(
        "join_type", "c_mktsegment", "n_rows"
    )


@query
def distinct_rollup(spark, sf_dir):
    """Distinct users in all, with a session and with a purchase: a week and app, a week, an app and in all, from the
    bitmaps of the finest groups."""
    name = F.col("event_name")
    sets = {"users": F.lit(True), "session_users": name == "session_start", "buyers": name == "purchase_completed"}
    log = testbed.events(spark, sf_dir).withColumn("week", dates.week_start(F.col("event_timestamp")))
    finest = stage(id_bitmaps(log, ["week", "app_id"], "user_id", sets), "id-bitmaps")
    levels = [distinct_counts(finest, ["week", "app_id"], list(sets))]
    for by in (["week"], ["app_id"], []):
        counts = distinct_counts(roll_up(finest, by, list(sets)), by, list(sets))
        gone = {c: F.lit(None).cast(finest.schema[c].dataType) for c in ("week", "app_id") if c not in by}
        levels.append(counts.withColumns(gone).select(*levels[0].columns))
    return reduce(DataFrame.unionByName, levels)


@query
def agg_primitives(spark, sf_dir):
    """Counts, distinct counts, sums, extremes and flag pivots per event type, from one
    fold by (type, user)."""
    value, kind = F.col("value"), F.col("event_type")
    high = value >= 50
    per_user = (
        testbed.read(spark, sf_dir, "events")
        .groupBy("event_type", "user_id")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count("value").alias("filled"),
            F.count(F.when(high, 1)).alias("high"),
            F.sum("value").alias("total"),
            F.min("value").alias("low"),
            F.max("value").alias("top"),
        )
    )
    return per_user.groupBy("event_type").agg(
        F.sum("rows").alias("n_rows"),
        F.sum("filled").alias("n_values"),
        F.count("user_id").alias("n_users"),
        F.count_if(F.col("high") > 0).alias("n_high_users"),
        F.sum("high").alias("n_high"),
        round_to(F.sum("total"), 2).alias("sum_value"),
        round_to(F.sum("total") / F.sum("filled"), 6).alias("avg_value"),
        F.min("low").alias("min_value"),
        F.max("top").alias("max_value"),
        F.max(F.when(kind == "purchase", 1).otherwise(0)).alias("is_purchase"),
        F.max(F.when(kind == "view", 1).otherwise(0)).alias("is_view"),
    )


@query
def value_counts(spark, sf_dir):
    features = _features(spark, sf_dir)
    return features.groupBy(propensity.LABEL).agg(F.count(F.lit(1)).alias("n"))


@query
def percentile_exact(spark, sf_dir):
    """Percentiles of a count (small histogram) and of a price (range by range)."""
    orders = _orders_per_customer(spark, sf_dir).agg(
        F.percentile("n_orders", 0.5).alias("orders_p50"), F.percentile("n_orders", 0.9).alias("orders_p90")
    )
    price = exact_percentiles(
        testbed.read(spark, sf_dir, "lineitem"),
        "l_extendedprice",
        {"price_p10": 0.1, "price_p50": 0.5, "price_p90": 0.9},
    )
    return _rounded(
        reduce(
            DataFrame.unionByName, [df.unpivot([], df.columns, "metric", "value") for df in (orders, price)]
        ),
        6,
    )


@query
def window_rank_family(spark, sf_dir):
    ranked = engagement.rank_distribution(_orders_per_customer(spark, sf_dir), "n_orders")
    return _rounded(ranked)


@query
def scalar_dates(spark, sf_dir):
    day = F.col("o_orderdate")
    return testbed.read(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.to_date(day).alias("order_date"),
        dates.week_start(day).alias("week_start"),
        dates.month_start(day).alias("month_start"),
        dates.month_label(day).alias("month_label"),
        dates.days_between(day, F.lit("1998-12-31").cast("date")).alias("days_to_end"),
        F.unix_date(F.to_date(day)).cast("string").alias("day_number"),
    )


@query
def scalar_strings(spark, sf_dir):
    part = F.col("p_partkey")
    installs = F.concat(F.format_number(F.col("p_size") * 1000, 0), F.lit("+"))
    p = (part + 1) / F.lit(2_000_003.0)
    tiny = p * F.col("p_size") / 1e9
    return testbed.read(spark, sf_dir, "part").select(
        "p_partkey",
        F.translate(installs, "+,", "").alias("installs_text"),
        to_number(installs, "+,").cast("long").alias("installs"),
        to_number(F.col("p_name")).alias("not_a_number"),
        text.p_value_text(p).alias("p_text"),
        text.chi2_p_value_text(tiny).alias("chi2_p_text"),
        text.thousands((part + 1) * 12345).alias("with_thousands"),
        text.clip(F.col("p_name"), 5).alias("name_clip"),
        text.contains_any(F.col("p_name"), "RED", "blue").alias("is_red_or_blue"),
    )


# --- data quality ------------------------------------------------------------


@query
def quality_report(spark, sf_dir):
    wh = warehouse(spark, sf_dir)
    return wh.quality_report(wh.marts(), _model(spark, sf_dir).importances)
