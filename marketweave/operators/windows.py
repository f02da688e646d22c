"""Ordered-series operators.

All are row-based, like the reference (``shift(n)`` is n rows, not n days).
``partition_by`` gives one series per key; without it the frame is one
series, which callers only use on calendar-bounded inputs (one row per day,
month or year), never on a fact table.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _window(order_by: Sequence[str], partition_by: Sequence[str] = ()):
    w = Window.orderBy(*order_by)
    return w.partitionBy(*partition_by) if partition_by else w


def lag_rows(df: DataFrame, col: str, n: int, order_by: Sequence[str],
             partition_by: Sequence[str] = (), name: str | None = None) -> DataFrame:
    """Value ``n`` rows earlier in the order (NULL for the first n rows)."""
    w = _window(order_by, partition_by)
    return df.withColumn(name or f"{col}_lag_{n}", F.lag(col, n).over(w))


def rolling_mean_full(df: DataFrame, col: str, n: int, order_by: Sequence[str],
                      partition_by: Sequence[str] = (), name: str | None = None,
                      scale: int = 4) -> DataFrame:
    """Mean of the last ``n`` rows, NULL until the frame holds n non-NULL values.

    The mean is an exact sum divided by n, rounded (stable across engines).
    """
    w = _window(order_by, partition_by).rowsBetween(-(n - 1), 0)
    mean = F.round(F.sum(col).over(w).cast("double") / F.lit(float(n)), scale)
    return df.withColumn(name or f"{col}_rolling_{n}_mean",
                         F.when(F.count(col).over(w) == n, mean))


def ffill(df: DataFrame, cols: Sequence[str], order_by: Sequence[str],
          partition_by: Sequence[str] = ()) -> DataFrame:
    """Carry the last non-NULL value forward; leading NULLs stay NULL."""
    w = _window(order_by, partition_by).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def dense_days(bounds: DataFrame, start: str = "start", end: str = "end",
               name: str = "date") -> DataFrame:
    """G1: one row per day between each row's ``start`` and ``end`` (inclusive).

    ``bounds`` is normally a one-row min/max aggregate; an empty range
    (start > end) yields no rows rather than a backwards sequence.
    """
    seq = F.when(F.col(start) <= F.col(end),
                 F.sequence(F.col(start), F.col(end), F.expr("INTERVAL 1 DAY")))
    return bounds.select(F.explode(seq).alias(name))


def int_range(bounds: DataFrame, start: str, end: str, name: str = "year") -> DataFrame:
    """Integers start..end inclusive; start > end gives no rows."""
    seq = F.when(F.col(start) <= F.col(end), F.sequence(F.col(start), F.col(end)))
    return bounds.select(F.explode(seq).alias(name))


def linear_fit(df: DataFrame, x: str, y: str, x_center: float = 0.0) -> DataFrame:
    """Least-squares slope / intercept (one row); x is centred for stability."""
    xc = F.col(x).cast("double") - F.lit(x_center)
    yy = F.col(y).cast("double")
    return df.agg(F.regr_slope(yy, xc).alias("slope"),
                  F.regr_intercept(yy, xc).alias("intercept"),
                  F.regr_count(yy, xc).alias("n_points"))


def poly1(x: Column, slope: Column, intercept: Column, x_center: float = 0.0) -> Column:
    """degree-1 polynomial evaluation."""
    return slope * (x.cast("double") - F.lit(x_center)) + intercept
