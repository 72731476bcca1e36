"""Hand-over of the marts to BI tools.

A mart is computed once, in parallel, into the shared folder. Rows and checksum are those of what lies there, and how many
rows there are decides the files: few go into one file, many into one file a range of the leading columns, each with a
header. So no unbounded frame meets one task, and no mart is computed again for the manifest.

(Observed metrics would spare the look at the stored mart, but a session that has observed once can't run the evaluators of
the model any more: their tasks don't serialise with it.)
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.sources.staging import stage, together

SHEET_NAME_LENGTH = 31  # longest sheet name a spreadsheet accepts


ROWS_PER_FILE = 1_000_000
CHECKSUM_SCALE = 1_000_000  # numbers enter the checksum as millionths


@dataclass(frozen=True)
class Exported:
    """What was written for a mart."""

    folder: str
    n_rows: int
    n_cols: int
    n_files: int
    checksum: int


def _cell(name: str) -> Column:
    """A value as text that every engine writes alike: numbers in millionths, others as they are."""
    as_text = F.col(f"`{name}`").cast("string")
    scaled = F.round(as_text.try_cast("double") * CHECKSUM_SCALE).try_cast("long")
    return F.coalesce(scaled.cast("string"), as_text, F.lit(""))


def row_checksum(columns: list[str]) -> Column:
    """Number of 32 bits from a row; the sum over rows doesn't depend on their order."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[_cell(c) for c in columns])), 1, 8), 16, 10).cast("long")


def export_mart(df: DataFrame, name: str, path: str, fmt: str = "csv", rows_per_file: int = ROWS_PER_FILE) -> Exported:
    """Write one mart into its folder below ``path``: one file, or with more rows than ``rows_per_file`` one a range."""
    stored = stage(df, f"export-{name}")
    n_rows, checksum = stored.agg(F.count(F.lit(1)), F.coalesce(F.sum(row_checksum(df.columns)), F.lit(0).cast("long"))).first()
    files = max(1, -(-n_rows // rows_per_file))
    # coalesce only where the rows are known to be few
    dealt = stored.coalesce(1) if files == 1 else stored.repartitionByRange(files, *df.columns)
    writer = dealt.sortWithinPartitions(*df.columns).write.mode("overwrite")
    folder = f"{path}/{name}"
    writer.option("header", True).csv(folder) if fmt == "csv" else writer.parquet(folder)
    return Exported(folder, n_rows, len(df.columns), files, checksum)


def write_marts(
    marts: dict[str, DataFrame], path: str, fmt: str = "csv", rows_per_file: int = ROWS_PER_FILE
) -> dict[str, Exported]:
    """Every mart in its own folder below ``path``."""
    names = sorted(marts)
    return dict(zip(names, together([lambda n=n: export_mart(marts[n], n, path, fmt, rows_per_file) for n in names])))


def export_marts(marts: dict[str, DataFrame], path: str, fmt: str = "csv") -> dict[str, str]:
    """:func:`write_marts`; returns name -> folder."""
    return {name: done.folder for name, done in write_marts(marts, path, fmt).items()}


def sheet_names(marts: Iterable[str]) -> dict[str, str]:
    """Names short enough for a spreadsheet, unique: of those cut alike, later ones end in a number."""
    out: dict[str, str] = {}
    taken: set[str] = set()
    for name in sorted(marts):
        sheet, n = name[:SHEET_NAME_LENGTH], 1
        while sheet.lower() in taken:
            n += 1
            sheet = name[: SHEET_NAME_LENGTH - len(str(n)) - 1] + f"_{n}"
        taken.add(sheet.lower())
        out[name] = sheet
    return out


def manifest(spark: SparkSession, marts: dict[str, DataFrame], folders: dict[str, str], fmt: str = "csv") -> DataFrame:
    """(mart, sheet, n_rows, n_cols) as found in the exported files."""

    def found(name: str) -> Exported:
        reader = spark.read.schema(marts[name].schema)
        stored = reader.option("header", True).csv(folders[name]) if fmt == "csv" else reader.parquet(folders[name])
        return Exported(folders[name], stored.count(), len(marts[name].columns), 0, 0)

    names = sorted(folders)
    return manifest_of(spark, dict(zip(names, together([lambda n=n: found(n) for n in names]))))


def manifest_of(spark: SparkSession, exported: dict[str, Exported]) -> DataFrame:
    """(mart, sheet, n_rows, n_cols) of what was written."""
    sheets = sheet_names(exported)
    rows = [(name, sheets[name], done.n_rows, done.n_cols) for name, done in sorted(exported.items())]
    return spark.createDataFrame(rows, "mart string, sheet string, n_rows long, n_cols int")


def checksums(spark: SparkSession, exported: dict[str, Exported]) -> DataFrame:
    """(mart, n_files, n_rows, checksum): a reader that sums ``row_checksum`` over the files must find the same."""
    rows = [(name, done.n_files, done.n_rows, done.checksum) for name, done in sorted(exported.items())]
    return spark.createDataFrame(rows, "mart string, n_files int, n_rows long, checksum long")
