"""Readers and writers for the base tables and marts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark.sources.staging import stage

CORRUPT = "_corrupt_record"
TOO_MANY, UNFIT = "more fields than columns", "fewer fields than columns, or a value that doesn't fit"


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header row; an empty field is NULL; malformed numbers fail the job."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


@dataclass(frozen=True)
class Scan:
    """Rows that fit the schema, and the others with their file and what is wrong with them."""

    good: DataFrame
    quarantined: DataFrame


def _fault(schema: T.StructType) -> Column:
    """Why a line doesn't fit: read again as plain texts, which columns hold something else?"""
    names = [f"c{i}" for i in range(len(schema) + 1)]
    fields = F.from_csv(F.col(CORRUPT), ", ".join(f"{n} string" for n in names))
    fault = F.when(fields[names[-1]].isNotNull(), TOO_MANY)
    for name, column in zip(names, schema):
        unfit = fields[name].isNotNull() & fields[name].try_cast(column.dataType).isNull()
        fault = fault.when(unfit, f"{column.name} is no {column.dataType.simpleString()}")
    return fault.otherwise(UNFIT)


def scan_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> Scan:
    """CSV of which some lines may be malformed: those that fit are typed rows, the rest goes to a side table.

    The files are read once: every line is parsed and written with the line itself where it doesn't fit, so that both
    tables are reads of the same parse. A missing field, a surplus one and a value of another type make a line unfit.
    """
    kept = T.StructType([*schema, T.StructField(CORRUPT, T.StringType())])
    reader = spark.read.schema(kept).option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    parsed = stage(reader.csv(path).select("*", F.col("_metadata.file_path").alias("_file")), "scanned-csv")
    bad = parsed.filter(F.col(CORRUPT).isNotNull())
    return Scan(
        parsed.filter(F.col(CORRUPT).isNull()).select(*[F.col(f"`{f.name}`") for f in schema]),
        bad.select(F.col("_file").alias("file"), F.col(CORRUPT).alias("record"), _fault(schema).alias("reason")),
    )


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    if fmt == "csv":
        return read_csv(spark, path, schema)
    return spark.read.schema(schema).parquet(path)


def read_raw_catalog(
    spark: SparkSession, path: str, schema: T.StructType, order_by: str | None = None, multi_line: bool = False
) -> DataFrame:
    """Raw app catalogue as text, by header name, with ``source_order``.

    The file may carry more columns than needed and fields may hold quotes, so columns are picked by name after a
    header-only look. The order is that of the numeric column ``order_by``; without one it is that of the file, of
    which there may be only one then. ``multi_line`` allows line breaks in fields, but then each
    file is read by one task.
    """
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line).csv(path)
    missing = [f.name for f in schema if f.name not in raw.columns]
    if missing:
        raise ValueError(f"catalogue {path} lacks columns {missing}")
    return raw.select(
        *[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema],
        _source_order(raw, order_by).alias("source_order"),
    )


def _source_order(raw: DataFrame, order_by: str | None) -> Column:
    """A number that grows in the order of rows."""
    if order_by:
        return F.col(f"`{order_by}`").cast("long")
    if len(raw.inputFiles()) > 1:
        raise ValueError("several files have no order of their own: name the column that gives it")
    return F.monotonically_increasing_id()  # parts of one file are read in its order


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Replace the table at ``path``."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def register(tables: dict[str, DataFrame]) -> None:
    """Make base tables addressable from ``spark.sql``."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def list_tables(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW TABLES").select(F.col("tableName").alias("name"))


def require_tables(spark: SparkSession, names: list[str]) -> None:
    """Fail before any job runs when an input is absent."""
    missing = [n for n in names if not spark.catalog.tableExists(n)]
    if missing:
        raise FileNotFoundError(f"missing tables: {missing}")
