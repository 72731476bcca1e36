"""The event log laid out by user, so that folds by user move no event.

Events of ordinary users lie in buckets of the user id: one file a bucket and write, and any fold or join by user finds
its rows together already. Users with a large share of all events would make one bucket, and so one task, too large;
theirs lie in a table of their own in as many files as they fill, and are folded before they move. Which users these are
is settled when the log is laid out and stored with it (at most ``MOST_HEAVY_USERS``); appended events follow it.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tidemark.sources import schemas

KEY = "user_id"
MOST_HEAVY_USERS = 10_000
EVENTS_PER_BUCKET = 5_000_000
MOST_BUCKETS = 50_000


def table_name(path: str) -> str:
    return f"tidemark_{hashlib.md5(path.encode()).hexdigest()}"


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int, mode: str = "error") -> None:
    """One file a bucket, sorted by the key."""
    writer = df.repartition(buckets, key).write.mode(mode).format("parquet").option("path", path)
    writer.bucketBy(buckets, key).sortBy(key).saveAsTable(table_name(path))


def read_bucketed(spark: SparkSession, path: str, schema: StructType, key: str, buckets: int) -> DataFrame:
    """A bucketed table from its files; a session that didn't write it has no entry for it yet."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table_name(path)} ({columns}) USING parquet OPTIONS (path '{path}')"
        f" CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS"
    )
    return spark.table(table_name(path))


@dataclass(frozen=True)
class UserLog:
    """Events in two parts without a user in common."""

    ordinary: DataFrame  # bucketed by user
    heavy: DataFrame  # of heavy users, and without a user
    heavy_users: DataFrame

    @property
    def all(self) -> DataFrame:
        return self.ordinary.unionByName(self.heavy)


def log_parts(log: DataFrame | UserLog) -> list[DataFrame]:
    """Parts that can be folded by user one by one."""
    return [log.ordinary, log.heavy] if isinstance(log, UserLog) else [log]


def fold_parts(log: DataFrame | UserLog, fold) -> DataFrame:
    return reduce(DataFrame.unionByName, [fold(part) for part in log_parts(log)])


def heavy_users(events: DataFrame, at_most: int = MOST_HEAVY_USERS) -> DataFrame:
    """(user_id, parts): users with more than one ``at_most``-th of all events, of whom there are fewer than ``at_most``,
    and into how many parts of that size their events go."""
    counts = events.filter(F.col(KEY).isNotNull()).groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))
    share = F.ceil(counts.agg(F.sum("n")).scalar() / at_most)
    return counts.filter(F.col("n") > share).select(KEY, F.ceil(F.col("n") / share).cast("int").alias("parts"))


def _split(events: DataFrame, heavy: DataFrame) -> tuple[DataFrame, DataFrame]:
    marked = events.join(F.broadcast(heavy.select(KEY, F.lit(True).alias("_heavy"))), KEY, "left").select(*events.columns, "_heavy")
    own = F.col("_heavy").isNotNull() | F.col(KEY).isNull()
    return marked.filter(~own).drop("_heavy"), marked.filter(own).drop("_heavy")


def lay_out(events: DataFrame, path: str, buckets: int | None = None, at_most: int = MOST_HEAVY_USERS) -> UserLog:
    """Write the log at ``path``, by default in as many buckets as it fills with ``EVENTS_PER_BUCKET`` each."""
    spark = events.sparkSession
    heavy_users(events, at_most).write.parquet(f"{path}/heavy_users")
    heavy = spark.read.parquet(f"{path}/heavy_users")
    if buckets is None:
        buckets = min(MOST_BUCKETS, max(1, -(-events.count() // EVENTS_PER_BUCKET)))
    ordinary, own = _split(events, heavy)
    own.write.parquet(f"{path}/heavy")
    write_bucketed(ordinary, f"{path}/ordinary", KEY, buckets)
    # the layout is complete once this is there
    spark.createDataFrame([(buckets,)], "buckets int").write.parquet(f"{path}/layout")
    return open_log(spark, path, events.schema)


def open_log(spark: SparkSession, path: str, schema: StructType = schemas.EVENTS) -> UserLog:
    buckets = spark.read.parquet(f"{path}/layout").first()["buckets"]
    return UserLog(
        read_bucketed(spark, f"{path}/ordinary", schema, KEY, buckets),
        spark.read.schema(schema).parquet(f"{path}/heavy"),
        spark.read.parquet(f"{path}/heavy_users"),
    )


def append(events: DataFrame, path: str) -> UserLog:
    """Add events: a file more a bucket they fall into. Users keep the part they are in."""
    spark = events.sparkSession
    log = open_log(spark, path, events.schema)
    buckets = spark.read.parquet(f"{path}/layout").first()["buckets"]
    ordinary, own = _split(events, log.heavy_users)
    own.write.mode("append").parquet(f"{path}/heavy")
    write_bucketed(ordinary, f"{path}/ordinary", KEY, buckets, "append")
    spark.catalog.refreshTable(table_name(f"{path}/ordinary"))
    return open_log(spark, path, events.schema)
