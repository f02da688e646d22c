"""Small helpers of the operators: table reads, row keys, written steps."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

__all__ = ["materialize", "read", "n_words", "small", "WORD"]

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))


def n_words(text: Column) -> Column:
    """Number of words, null text 0 (JVM regular expression)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def small(written: DataFrame, weight: Column | None = None, most: int = 200_000) -> DataFrame:
    """A written table, marked for broadcast if it has at most ``most`` rows
    (or sum of ``weight``); beyond that Spark chooses the join."""
    total = F.count("*") if weight is None else F.sum(weight)
    return F.broadcast(written) if (written.agg(total).first()[0] or 0) <= most else written
