"""Bot filtering and its quality against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.numeric import ratio_or_zero
from tidemark.functions.text import contains_any
from tidemark.operators.joins import salted_left_join
from tidemark.sources.userlog import MOST_HEAVY_USERS, UserLog, heavy_users

# Fixed values of the filter rules.
MAX_USERS_PER_DEVICE = 200
QA_CHANNEL = "internal_qa"
QA_EMAIL_FRAGMENT = "test"
BOT_EMAIL_FRAGMENTS = ("test", "qa", "bot")
USERS_PER_SALT = 100_000


def device_reuse(users: DataFrame) -> DataFrame:
    """(device_id, distinct_users_on_device). The distinct runs on (device, user)
    pairs first, so one device with a third of all users is still spread out."""
    return users.groupBy("device_id").agg(F.countDistinct("user_id").alias("distinct_users_on_device"))


def flag_bots(
    users: DataFrame,
    max_users_per_device: int = MAX_USERS_PER_DEVICE,
    qa_channel: str = QA_CHANNEL,
    email_fragments: tuple[str, ...] = BOT_EMAIL_FRAGMENTS,
) -> DataFrame:
    """Users plus ``is_suspected_bot``; missing devices and emails raise no suspicion.

    Only over-shared devices enter the join. There are at most
    ``n_users / max_users_per_device`` of them, and the users of one device are
    salted, as a farm device is by definition a hot key.
    """
    shared = (
        device_reuse(users.filter(F.col("device_id").isNotNull()))
        .filter(F.col("distinct_users_on_device") > max_users_per_device)
        .select("device_id", "distinct_users_on_device", F.lit(True).alias("on_shared_device"))
    )
    # as many salts as the largest farm needs
    salts = shared.agg(F.greatest(F.lit(1), F.ceil(F.max("distinct_users_on_device") / USERS_PER_SALT))).scalar()
    email = F.col("email")
    suspected = (
        F.when(F.col("on_shared_device"), True)
        .when((F.col("acquisition_channel") == qa_channel) & contains_any(email, QA_EMAIL_FRAGMENT), True)
        .when(contains_any(email, *email_fragments), True)
        .otherwise(False)
    )
    return salted_left_join(users, shared.drop("distinct_users_on_device"), "device_id", F.col("user_id"), salts).select(
        *users.columns, suspected.alias("is_suspected_bot")
    )


def clean_users(flagged: DataFrame) -> DataFrame:
    return flagged.filter(~F.col("is_suspected_bot")).drop("is_suspected_bot")


def clean_events(events: DataFrame | UserLog, clean: DataFrame, at_most: int = MOST_HEAVY_USERS) -> DataFrame:
    """Events of clean users; events of bots and of unknown users go.

    This is the only plan that moves raw events across the cluster, and only
    when the user side is too large to broadcast. The marts do not use it: they
    aggregate the log per user first and meet the clean users afterwards. The
    log is folded to counts first, so that the events of heavy users can be
    dealt to as many tasks as they need; their list is bounded by ``at_most``.

    A log laid out by user stays where it is: users come to its buckets, and the
    clean ones of the few heavy users to every file of theirs.
    """
    if isinstance(events, UserLog):
        users = clean.select("user_id")
        few = users.join(F.broadcast(events.heavy_users.select("user_id")), "user_id", "left_semi")
        heavy_part = events.heavy.join(F.broadcast(few), "user_id", "left_semi")
        return events.ordinary.join(users, "user_id", "left_semi").select(*events.ordinary.columns).unionByName(heavy_part)
    heavy = F.broadcast(heavy_users(events, at_most))
    part = F.coalesce(F.pmod(F.xxhash64("event_id"), F.col("parts")), F.lit(0)).cast("int").alias("_part")
    dealt = events.join(heavy, "user_id", "left").select(*events.columns, part)
    parts = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
    users = clean.select("user_id").join(heavy, "user_id", "left").select("user_id", F.explode(parts).alias("_part"))
    return dealt.join(users, ["user_id", "_part"], "left_semi").select(*events.columns)


def bot_filter_quality(flagged: DataFrame) -> DataFrame:
    """One row: confusion counts, precision and recall of the filter."""
    bot = F.coalesce(F.col("is_bot_ground_truth"), F.lit(False))
    hit = F.col("is_suspected_bot")
    counts = flagged.agg(
        F.count_if(bot & hit).alias("true_positives"),
        F.count_if(~bot & hit).alias("false_positives"),
        F.count_if(bot & ~hit).alias("false_negatives"),
        F.count_if(hit).alias("n_flagged"),
        F.count_if(bot).alias("n_bots"),
    )
    return counts.select(
        "true_positives",
        "false_positives",
        "false_negatives",
        ratio_or_zero(F.col("true_positives"), F.col("n_flagged")).alias("precision"),
        ratio_or_zero(F.col("true_positives"), F.col("n_bots")).alias("recall"),
        "n_flagged",
        "n_bots",
    )
