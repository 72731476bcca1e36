"""User facts that grow by load: a new day reads that day, not the log.

The facts of a user are a mergeable state: marks combine by OR, counts by sum, days by minimum and maximum, and the trial
and active days of each 64-day block by OR. ``DailyFacts`` keeps one such state a load (a day, say). A load that is
delivered again replaces its state, and events that come late simply belong to the load they came with, whatever day they
are from. ``fold`` merges the open loads into the folded state, which lies in buckets of the user id: loads are brought
to it, it is not shuffled to be read. Loads and folds are written as versions, so a failed one leaves what was there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark.plans import facts, trials
from tidemark.sources import versions
from tidemark.sources.userlog import read_bucketed, write_bucketed

KEY = "user_id"
BITS = ("trial_bits", "active_bits")
BLOCKS = T.ArrayType(
    T.StructType([T.StructField("block", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("n_trials", *BITS)]])
)
STATE = T.StructType(
    [
        T.StructField(KEY, T.LongType()),
        T.StructField("marks", T.IntegerType()),
        *[T.StructField(c, T.LongType()) for c in ("n_events", "session_count", "early_sessions")],
        *[T.StructField(c, T.IntegerType()) for c in ("first_event_day", "last_event_day")],
        T.StructField("last_event_ts", T.TimestampNTZType()),
        T.StructField("purchase_day", T.IntegerType()),
        T.StructField("blocks", BLOCKS),
    ]
)
#: Two values of a column, of which either may be missing, to one.
_PAIRS = {
    F.bit_or: lambda a, b: F.coalesce(a.bitwiseOR(b), a, b),
    F.sum: lambda a, b: F.coalesce(a + b, a, b),
    F.min: F.least,
    F.max: F.greatest,
}


def _either(blocks: Column, bits: str) -> Column:
    """Bits that are set in any of the blocks, null where none has any."""
    return F.aggregate(blocks, F.lit(None).cast("long"), lambda so_far, b: F.coalesce(so_far.bitwiseOR(b[bits]), so_far, b[bits]))


def _merged_blocks(blocks: Column) -> Column:
    """One entry a block number; a user has as many as the log has 64-day periods."""

    def merged(number: Column) -> Column:
        same = F.filter(blocks, lambda b: b["block"].eqNullSafe(number))
        trials_ = F.aggregate(same, F.lit(0).cast("long"), lambda n, b: n + b["n_trials"])
        return F.struct(number.alias("block"), trials_.alias("n_trials"), *[_either(same, c).alias(c) for c in BITS])

    return F.transform(F.array_distinct(F.transform(blocks, lambda b: b["block"])), merged)


def _of_users(parts: DataFrame, blocks: Column) -> DataFrame:
    """One state a user from several."""
    folded = parts.groupBy(KEY).agg(*[how(c).alias(c) for c, how in facts.MERGED_FACTS.items()], blocks.alias("blocks"))
    return folded.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in STATE])


def state_of(events: DataFrame, retention_days: tuple[int, ...] = facts.RETENTION_DAYS, early_day: int = facts.EARLY_DAY) -> DataFrame:
    """The state of each user in some events, combined before it moves; events without a user belong to nobody."""
    per_block = (
        events.filter(F.col(KEY).isNotNull())
        .groupBy(KEY, trials.block_number())
        .agg(*facts.fact_columns(retention_days, early_day), *trials.block_columns())
    )
    told = (F.col("n_trials") > 0) | F.col("active_bits").isNotNull()
    return _of_users(per_block, F.collect_list(F.when(told, F.struct("block", "n_trials", *BITS))))


def merge(states: list[DataFrame]) -> DataFrame:
    """One state of several, each with a row a user."""
    if len(states) == 1:
        return states[0]
    together = _of_users(reduce(DataFrame.unionByName, states), F.flatten(F.collect_list("blocks")))
    return together.withColumn("blocks", _merged_blocks(F.col("blocks")))


def merge_into(base: DataFrame, news: DataFrame) -> DataFrame:
    """``news`` merged into ``base`` by a join, so that a base in buckets of the user id stays where it is."""
    joined = base.alias("base").join(news.alias("news"), KEY, "full_outer")
    old, new = (lambda c: F.col(f"base.{c}")), (lambda c: F.col(f"news.{c}"))
    none = F.array().cast(BLOCKS)
    both = F.concat(F.coalesce(old("blocks"), none), F.coalesce(new("blocks"), none))
    merged = [_PAIRS[how](old(c), new(c)).alias(c) for c, how in facts.MERGED_FACTS.items()]
    # most users are not in the news
    blocks = F.when(new("blocks").isNull(), old("blocks")).otherwise(_merged_blocks(both)).alias("blocks")
    return joined.select(KEY, *merged, blocks)


class DailyFacts:
    """User facts stored below ``path``; other retention days or another early day are another store below it."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        retention_days: tuple[int, ...] = facts.RETENTION_DAYS,
        early_day: int = facts.EARLY_DAY,
        buckets: int = 64,
    ):
        self.spark, self.retention_days, self.early_day, self.buckets = spark, retention_days, early_day, buckets
        self.path = f"{path.rstrip('/')}/days-{'-'.join(map(str, retention_days))}-early-{early_day}"

    def add(self, load: str, events: DataFrame) -> None:
        """Store the state of a load, in place of what the same load brought before."""
        if load in self.folded_loads():
            raise ValueError(f"load {load} is folded; bring its corrections as a load of their own")
        versions.replace(state_of(events, self.retention_days, self.early_day), f"{self.path}/loads/{load}")

    def loads(self) -> list[str]:
        """Complete loads, folded ones included."""
        present = versions.children(self.spark, f"{self.path}/loads")
        return [load for load in present if versions.current_path(self.spark, f"{self.path}/loads/{load}")]

    def folded_loads(self) -> set[str]:
        folded = versions.current_path(self.spark, f"{self.path}/folded")
        return {row["load"] for row in self.spark.read.parquet(f"{folded}/loads").collect()} if folded else set()

    def _open_states(self) -> list[DataFrame]:
        done = self.folded_loads()
        return [versions.read_current(self.spark, f"{self.path}/loads/{load}", STATE) for load in self.loads() if load not in done]

    def state(self) -> DataFrame:
        """The state of every user: the folded one with the open loads merged in."""
        folded, news = versions.current_path(self.spark, f"{self.path}/folded"), self._open_states()
        if not folded:
            return merge(news) if news else self.spark.createDataFrame([], STATE)
        base = read_bucketed(self.spark, f"{folded}/state", STATE, KEY, self._buckets_of(folded))
        return merge_into(base, merge(news)) if news else base

    def _buckets_of(self, folded: str) -> int:
        return self.spark.read.parquet(f"{folded}/layout").first()["buckets"]

    def fold(self) -> None:
        """Merge the open loads into a new folded state; nothing changes for readers until it is complete."""
        loads, state = sorted(set(self.loads()) | self.folded_loads()), self.state()

        def write(to: str) -> None:
            write_bucketed(state, f"{to}/state", KEY, self.buckets)
            self.spark.createDataFrame([(load,) for load in loads], "load string").write.parquet(f"{to}/loads")
            self.spark.createDataFrame([(self.buckets,)], "buckets int").write.parquet(f"{to}/layout")

        versions.write_version(self.spark, f"{self.path}/folded", write)

    def user_facts(self, clean_users: DataFrame) -> DataFrame:
        """What ``facts.user_facts`` finds in all events of all loads."""
        return facts.join_facts(clean_users, self.state().drop("blocks"), self.retention_days, self.early_day)

    def dropoff_curve(self, clean_users: DataFrame, last_day: int = trials.LAST_TRIAL_DAY) -> DataFrame:
        """What ``trials.trial_dropoff_curve`` finds in all events of all loads."""
        n_trials = F.aggregate("blocks", F.lit(0).cast("long"), lambda n, b: n + b["n_trials"])
        return trials.curve_of_blocks(clean_users, self.state().select(KEY, n_trials.alias("n_trials"), "blocks"), last_day)
