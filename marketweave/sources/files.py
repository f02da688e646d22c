"""Raw file scans (S1-S4): CSV with header, CSV after a preamble, CSV with
supplied column names, and a sheet export with lead rows.

Cells are read as text and coerced later with ``try_*`` functions (ANSI
mode raises on a plain cast of malformed text). Supplying a schema avoids
the extra inference pass over the data.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def text_schema(names: Sequence[str]) -> StructType:
    return StructType([StructField(n, StringType(), True) for n in names])


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """CSV with a header row; without a schema every column is text."""
    r = spark.read.option("header", True).option("mode", "PERMISSIVE")
    return r.schema(schema).csv(path) if schema is not None else r.csv(path)


def read_csv_named(spark: SparkSession, path: str, names: Sequence[str], is_data: Column | None = None) -> DataFrame:
    """S3: no header, text columns named by position; ``is_data`` tells data
    rows from lead rows by their content, so a folder of files, each with lead
    rows of its own, reads alike. One distributed scan by Spark's CSV reader."""
    df = spark.read.option("header", False).option("mode", "PERMISSIVE").schema(text_schema(names)).csv(path)
    return df.filter(is_data) if is_data is not None else df


def read_csv_after_preamble(spark: SparkSession, path: str, names: Sequence[str], is_data: Column | None = None) -> DataFrame:
    """A CSV whose header row (``names``) follows preamble lines. Rows that
    ``is_data`` tells; without it, the rows after the header row of their file,
    whatever their cells hold (all rows of a file without that header)."""
    header = F.lit(True)
    for n in names:
        header = header & F.col(f"`{n}`").eqNullSafe(F.lit(n))
    if is_data is not None:
        return read_csv_named(spark, path, names, is_data & ~header)
    # a row's place: ids grow along a block, blocks along a file
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    placed = read_csv_named(spark, path, names).select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("_row"), header.alias("_header"),
                                                       F.col("_metadata.file_path").alias("_file"), place.alias("_place"))
    # one row a file, and the driver lists the files
    first = placed.filter("_header").groupBy(F.col("_file").alias("_of")).agg(F.min("_place").alias("_first"))
    rows = placed.join(F.broadcast(first), F.col("_file") == F.col("_of"), "left")
    rows = rows.filter(~F.col("_header") & (F.col("_first").isNull() | (F.col("_place") > F.col("_first"))))
    return rows.select(*[F.col("_row").getField(n).alias(n) for n in names])


def read_sheet_export(spark: SparkSession, path: str, names: Sequence[str], is_data: Column,
                      drop: Sequence[str] = ()) -> DataFrame:
    """A spreadsheet exported to CSV: lead rows and footnotes dropped by
    content, columns named, some dropped."""
    return read_csv_named(spark, path, names, is_data).drop(*drop)
