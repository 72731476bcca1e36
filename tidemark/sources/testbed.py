"""Users, events and a raw catalogue derived from the star-schema test tables.

The test tables hold no installs, bots or trials, so they are mapped by rule:
every customer is a user, the event stream is thinned by ``value`` into product
events, parts are apps. Customers outnumber event users ten to one, which gives
users without any event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark.sources.versions import stamp

LAST_INSTALL = "2024-01-01"  # the log's first day: no event precedes its user's install
INSTALL_DAYS = 45
N_APPS = 20
MAX_USERS_PER_DEVICE = 20  # lower than the library default so the rule fires on small data


_KNOWN_SCHEMAS: dict[tuple, T.StructType] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A test table. Its schema is looked up once for the files as they are: every look-up is a small job."""
    path = f"{sf_dir}/{table}.parquet"
    known = (path, stamp(spark, path))
    if known not in _KNOWN_SCHEMAS:
        _KNOWN_SCHEMAS[known] = spark.read.parquet(path).schema
    return spark.read.schema(_KNOWN_SCHEMAS[known]).parquet(path)


def _install_date(user_id: Column) -> Column:
    return F.date_sub(F.lit(LAST_INSTALL).cast("date"), (INSTALL_DAYS - 1 - user_id % INSTALL_DAYS).cast("int"))


def _app_id(user_id: Column) -> Column:
    return (user_id % N_APPS + 1).cast("int")


def _event_name(kind: Column, value: Column) -> Column:
    return (
        F.when((kind == "signup") & (value >= 40), "account_created")
        .when(kind == "signup", "install")
        .when((kind == "view") & (value >= 60), "first_session")
        .when(kind == "view", "session_start")
        .when((kind == "click") & (value >= 60), "feature_used")
        .when((kind == "error") & (value >= 90), "trial_started")
        .when(kind == "error", "trial_expired_no_purchase")
        .when((kind == "purchase") & (value >= 120), "purchase_completed")
        .otherwise("trial_reminder_shown")
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw product event log. The install day follows from the user id, so
    no join is needed to place an event on the user's day axis."""
    user_id, ts = F.col("user_id"), F.col("event_timestamp")
    low = F.get_json_object("props", "$.k").cast("int") < 30
    subtype = F.when(F.col("event_name") == "feature_used", F.when(low, "collaboration_feature").otherwise("standard_feature")).when(
        (F.col("event_name") == "trial_reminder_shown") & low, "day6_trial_extension"
    )
    return (
        read(spark, sf_dir, "events")
        .select(
            "event_id",
            "user_id",
            F.col("ts").cast("timestamp_ntz").alias("event_timestamp"),
            _event_name(F.col("event_type"), F.col("value")).alias("event_name"),
            "props",
            _install_date(user_id).alias("installed"),
        )
        .select(
            "event_id",
            "user_id",
            _app_id(user_id).alias("app_id"),
            "event_name",
            subtype.alias("event_subtype"),
            "event_timestamp",
            F.datediff(F.to_date(ts), F.col("installed")).alias("day_offset"),
        )
    )


def users(spark: SparkSession, sf_dir: str, log: DataFrame | None = None) -> DataFrame:
    """The raw user table; arm assignment exists exactly for users who reached a trial."""
    trial_users = (
        (log or events(spark, sf_dir))
        .filter(F.col("event_name") == "trial_started")
        .groupBy("user_id")
        .agg(F.lit(True).alias("in_trial"))
    )
    uid, installed = F.col("user_id"), F.col("installed")
    is_bot = uid % 25 == 0
    with_country = read(spark, sf_dir, "customer").join(
        read(spark, sf_dir, "nation").select(
            F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("country")
        ),
        "c_nationkey",
    )
    return (
        with_country.select(
            F.col("c_custkey").alias("user_id"),
            _install_date(F.col("c_custkey")).alias("installed"),
            F.col("c_custkey").cast("string").alias("text_id"),
            "country",
            "c_mktsegment",
        )
        .join(trial_users, "user_id", "left")
        .select(
            "user_id",
            _app_id(uid).alias("app_id"),
            installed.cast("timestamp_ntz").alias("install_timestamp"),
            F.trunc(installed, "month").alias("cohort_month"),
            F.when(is_bot, "dev-shared")
            .when(uid % 40 != 9, F.concat(F.lit("dev-"), "text_id"))
            .alias("device_id"),
            "country",
            F.when(uid % 50 == 0, "internal_qa").otherwise(F.col("c_mktsegment")).alias("acquisition_channel"),
            F.when(is_bot, F.format_string("TEST_bot_%s@example.com", "text_id"))
            .when(uid % 40 != 19, F.format_string("user%s@example.com", "text_id"))
            .alias("email"),
            F.when(F.col("in_trial"), F.when(uid % 2 == 0, "control").otherwise("treatment")).alias("ab_group"),
            # the labels disagree with the filter rules on two residue classes
            ((is_bot & (uid % 100 != 50)) | (uid % 200 == 13)).alias("is_bot_ground_truth"),
        )
    )


def raw_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as untidy app listings: text numbers, repeated names, missing ratings."""
    part = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        part.alias("source_order"),
        F.col("p_name").alias("App"),
        F.when(part % 3 == 0, F.col("p_type")).otherwise("PRODUCTIVITY").alias("Category"),
        F.when(part % 11 == 0, "NaN")
        .otherwise(F.concat((part % 4 + 2).cast("string"), F.lit("."), (part % 10).cast("string")))
        .alias("Rating"),
        F.when(F.col("p_size") == 50, "Free")
        .when(F.col("p_size") == 49, "Varies")
        .otherwise(F.concat(F.col("p_size").cast("string"), F.lit(",000+")))
        .alias("Installs"),
        F.when(part % 7 != 0, F.concat(F.lit("$"), F.col("p_retailprice").cast("string"))).alias("Price"),
    )
