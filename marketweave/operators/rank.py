"""Consecutive ranks in a total order without a single-partition window.

``row_number().over(Window.orderBy(...))`` moves every row into one task.
Here the rows are range-partitioned by the order (a distributed sort), each
row gets its partition-local position from ``monotonically_increasing_id``
(partition index in the upper 31 bits), the sorted rows are written once to
the shared checkpoint folder so that position is fixed (a lineage cut that
survives executor loss), and the per-partition counts (one row per
partition: a proven bound) become offsets.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

_LOW_BITS = (1 << 33) - 1


def global_rank(df: DataFrame, order_by: Sequence[str | Column], name: str = "rank") -> DataFrame:
    """Add a 1-based consecutive rank in ``order_by``.

    A unique row id taken before the sort is appended to the sort key, so a
    single value held by a large share of the rows is still split across
    range partitions (ties get an arbitrary but fixed order; give a unique
    tie-break in ``order_by`` where the order of ties matters).
    """
    s = (df.withColumn("_tb", F.monotonically_increasing_id())
           .orderBy(*order_by, "_tb").drop("_tb")
           .withColumn("_mid", F.monotonically_increasing_id()))
    s = materialize(s, "rank")
    s = s.withColumn("_pid", F.shiftright("_mid", 33)).withColumn(
        "_local", F.col("_mid").bitwiseAND(F.lit(_LOW_BITS)))
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"))
    return (s.join(F.broadcast(offsets), "_pid")
             .withColumn(name, F.col("_off") + F.col("_local") + F.lit(1))
             .drop("_mid", "_pid", "_local", "_off"))
