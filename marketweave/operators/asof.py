"""As-of join of two irregular series without a dense calendar.

Both sides are cut into time buckets, so a key holding a third of all rows is
many tasks, and no bucket is gathered across keys. Inside a bucket a window
runs over the two sides in time order; what a bucket takes over from the ones
before it is carried by a second window over one row per key and bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def day_buckets(days: int) -> Callable[[Column], Column]:
    """Buckets of so many days, for a DATE column."""
    return lambda t: F.floor(F.unix_date(t) / days)


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str,
              bucket: Callable[[Column], Column], name: str = "match") -> DataFrame:
    """``left`` (all rows and columns) with ``name``: a struct of the columns of
    the latest row of ``right`` with equal ``keys`` and ``right_time`` not after
    ``left_time``; null where there is none.

    Of several such rows of one time the greatest (in the order of its columns)
    counts. Null keys or times match nothing. ``bucket`` must not fall when time rises.
    """
    ks = [f"_k{i}" for i in range(len(keys))]
    match = F.struct(*[F.col(f"`{c}`") for c in right.columns])
    rows = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    r = (right.select(*[F.col(f"`{k}`").alias(a) for k, a in zip(keys, ks, strict=True)], F.col(f"`{right_time}`").alias("_t"), match.alias("_r"))
         .na.drop(subset=[*ks, "_t"]).withColumns({"_side": F.lit(0), "_l": F.lit(None).cast(left.schema)}))
    side = left.select(*[F.col(f"`{k}`").alias(a) for k, a in zip(keys, ks, strict=True)], F.col(f"`{left_time}`").alias("_t"),
                       F.lit(None).cast(right.schema).alias("_r"), F.lit(1).alias("_side"), rows.alias("_l"))
    both = r.unionByName(side).withColumn("_b", bucket(F.col("_t")))
    upto = Window.partitionBy(*ks, "_b").orderBy("_t", "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("_m", F.last("_r", ignorenulls=True).over(upto)).filter("_side = 1")
    ends = both.groupBy(*ks, "_b").agg(F.max(F.when(F.col("_side") == 0, F.struct("_t", "_r"))).alias("_e"))
    before = Window.partitionBy(*ks).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_c", F.last("_e", ignorenulls=True).over(before)).select(*ks, "_b", F.col("_c._r").alias("_c"))
    out = inside.join(carried, [*ks, "_b"], "left")
    found = F.when(F.col("_t").isNotNull(), F.coalesce("_m", "_c"))
    return out.select(*[F.col("_l").getField(c).alias(c) for c in left.columns], found.alias(name))
