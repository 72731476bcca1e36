"""Local session for tests and trial runs."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def session(cores: int = 8, app: str = "tidemark-tests") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", os.environ.get("TIDEMARK_SHARED_DIR") or tempfile.mkdtemp(prefix="tidemark-test-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
