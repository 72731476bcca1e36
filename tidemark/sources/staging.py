"""Write an intermediate once to the cluster's shared folder and read it back.

A written table cuts lineage, survives the loss of executors, and keeps column
pruning and filter pushdown for every later reader.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}  # by application
_ON_RELEASE: list[Callable[[str], None]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; in local mode only, a temporary folder when unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[context.applicationId] = tempfile.mkdtemp(prefix="tidemark-")
    return _LOCAL_DIRS[context.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    """A path for output of this process below the shared folder; :func:`release` deletes it."""
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet and return the stored table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def together(jobs: Iterable[Callable[[], object]], at_once: int = 6) -> list:
    """Run independent Spark actions side by side, so that the small tail stages of
    one leave no executors idle; results in order."""
    with ThreadPoolExecutor(at_once) as pool:
        return [future.result() for future in [pool.submit(job) for job in jobs]]


def stage_all(frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """:func:`stage` for several independent frames at once."""
    return dict(zip(frames, together([lambda n=n, f=f: stage(f, n) for n, f in frames.items()])))


def on_release(forget: Callable[[str], None]) -> None:
    """Have ``forget`` called with the application id when its tables are deleted: what reads them is of no use then."""
    _ON_RELEASE.append(forget)


def release(spark: SparkSession) -> None:
    """Delete what this application wrote below the shared folder; call when all results are out."""
    for forget in _ON_RELEASE:
        forget(spark.sparkContext.applicationId)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    written = _WRITTEN.get(spark.sparkContext.applicationId, [])
    while written:
        path = jvm.org.apache.hadoop.fs.Path(written.pop())
        path.getFileSystem(conf).delete(path, True)
