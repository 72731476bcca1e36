"""Small helpers shared by the operators: Arrow batches in, Arrow batches out, and spread numbering."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 24 << 20


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over batches bounded in bytes, so that long texts don't fill a worker.

    The bound is a setting of the session, which is the only place where Spark takes it from.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING) != f"{BATCH_BYTES}b":
        conf.set(BATCH_SETTING, f"{BATCH_BYTES}b")
    return df.mapInArrow(function, schema)


def batch(names: Sequence[str], types: Sequence[pa.DataType], columns: Sequence) -> pa.RecordBatch:
    """A record batch from Python lists or arrays."""
    arrays = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, t) for c, t in zip(columns, types)]
    return pa.RecordBatch.from_arrays(arrays, names=list(names))


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of a text column, null as the empty text."""
    return [text or "" for text in column.to_pylist()]


def empty_if_null(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; whatever else the table holds can't clash with an operator's own names."""
    return df.select(*(df[name] for name in names))
