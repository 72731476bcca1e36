"""Tables that are replaced whole or not at all.

A table is a folder of version folders. A version is written beside the others and counts only once an empty marker with
its name stands in ``_current``: creating one file is atomic on every file system that Spark writes to, renames are not.
Readers take the largest marker, so they see the old table until the new one is complete, a write that fails half-way
leaves no trace that anyone reads, and a plan may replace the table it reads from. Of two writers at once the later
name wins; no reader sees a mix.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

MARKERS = "_current"


class _Folder:
    """The few file operations needed, on whatever file system the path is."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.path = path.rstrip("/")

    def names(self, below: str = "") -> list[str]:
        folder = self._path(f"{self.path}/{below}" if below else self.path)
        return sorted(s.getPath().getName() for s in self._files.listStatus(folder)) if self._files.exists(folder) else []

    def stamps(self) -> tuple:
        whole = self._path(self.path)
        found = self._files.listStatus(whole) if self._files.exists(whole) else []
        return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in found))

    def mark(self, name: str) -> None:
        self._files.create(self._path(f"{self.path}/{MARKERS}/{name}"), False).close()

    def delete(self, below: str) -> None:
        self._files.delete(self._path(f"{self.path}/{below}"), True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies below a folder, none if it isn't there."""
    return _Folder(spark, path).names()


def stamp(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of a table's files: another stamp, another content. Runs no job."""
    return _Folder(spark, path).stamps()


def current_path(spark: SparkSession, path: str) -> str | None:
    """Folder of the version that counts, if there is any."""
    marked = _Folder(spark, path).names(MARKERS)
    return f"{path.rstrip('/')}/{marked[-1]}" if marked else None


def write_version(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """Let ``write`` fill a new folder, then make it the current one; what it raises leaves the old one current."""
    folder = _Folder(spark, path)
    # behind whatever is there, finished or not
    begun = [name for name in folder.names() if name != MARKERS]
    name = f"{int(begun[-1].split('-')[0]) + 1 if begun else 1:010d}-{uuid.uuid4().hex}"
    write(f"{folder.path}/{name}")
    folder.mark(name)
    return f"{folder.path}/{name}"


def replace(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Make ``df`` the table at ``path``, which ``df`` itself may read; returns the new table."""
    spark = df.sparkSession
    return spark.read.parquet(write_version(spark, path, lambda to: df.write.partitionBy(*partition_by).parquet(to)))


def read_current(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    found = current_path(spark, path)
    if found is None:
        raise FileNotFoundError(f"no complete table at {path}")
    return (spark.read.schema(schema) if schema else spark.read).parquet(found)


def prune(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete all but the newest ``keep`` versions, and what failed writes left behind them; returns the deleted names.
    Markers go before folders, so a reader that comes meanwhile finds no marker without its table."""
    if keep < 1:
        raise ValueError("the current version stays")
    folder = _Folder(spark, path)
    marked = folder.names(MARKERS)
    kept = set(marked[-keep:])
    for name in marked:
        if name not in kept:
            folder.delete(f"{MARKERS}/{name}")
    # of writes still under way only such go as would come before the current one, and so would never be read
    gone = [n for n in folder.names() if n != MARKERS and n not in kept and marked and n < marked[-1]]
    for name in gone:
        folder.delete(name)
    return gone
