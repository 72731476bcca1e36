"""Session settings for large clusters."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Sized for a log of tens of terabytes: many small shuffle partitions that
# adaptive execution merges to the advisory size, so no partition outgrows an
# executor core's memory, and joins switch to broadcast only on measured sizes.
TIME_ZONE = "spark.sql.session.timeZone"
CLUSTER_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "16000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a small build side per partition saves sorting the event side of a join
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    "spark.sql.shuffle.partitions": "16000",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    TIME_ZONE: "UTC",
    # recording a call site for every Column built from Python doubles planning time
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def cluster_session(app: str = "tidemark") -> SparkSession:
    """A session with the settings above; values given to spark-submit win."""
    builder = SparkSession.builder.appName(app)
    spark = builder.getOrCreate()
    given = {key for key, _ in spark.sparkContext.getConf().getAll()}
    for key, value in CLUSTER_SETTINGS.items():
        # the time zone is about results, the rest about speed
        if key == TIME_ZONE or (key not in given and not spark.sparkContext.master.startswith("local")):
            spark.conf.set(key, value)
    return spark
