"""Reshape / set operators: pivot with fixed values (A11, A12), unpivot of
all-digit columns (G3), one-hot columns (G5, G6), union by name (U1),
deduplication (U2, U3)."""

from __future__ import annotations

from typing import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import ratio


def pivot_fixed(df: DataFrame, index: Sequence[str], pivot_col: str,
                values: Mapping, agg: str | Callable[[Column], Column],
                value_col: str) -> DataFrame:
    """Pivot with the pivot values given up front (no extra job to find them).

    ``values`` maps pivot value -> output column name. ``agg`` is ``"mean"``
    (exact sum / count, rounded) or a function of the masked value column.
    One pass, partial aggregation per index key.
    """
    aggs = []
    for v, name in values.items():
        masked = F.when(F.col(pivot_col) == F.lit(v), F.col(value_col))
        if agg == "mean":
            aggs.append(ratio(F.sum(masked), F.count(masked), 4).alias(name))
        elif agg == "sum":
            aggs.append(F.sum(masked).alias(name))
        else:
            aggs.append(agg(masked).alias(name))
    return df.groupBy(*index).agg(*aggs)


def digit_columns(df: DataFrame) -> list[str]:
    """Columns whose name is all digits (year columns of a wide table)."""
    return [c for c in df.columns if c.isdigit()]


def unpivot_digit_columns(df: DataFrame, ids: Sequence[str], name: str = "year",
                          value: str = "value") -> DataFrame:
    """Wide -> long over all-digit columns; NULL cells are kept; the
    column name becomes an int (C19)."""
    cols = digit_columns(df)
    long = df.unpivot(list(ids), cols, name, value)
    return long.withColumn(name, F.col(name).cast("int"))


def one_hot(df: DataFrame, col: str, levels: Sequence[str], prefix: str | None = None) -> DataFrame:
    """G5 (SQL form): one 0/1 column per level, no level dropped; NULL -> all 0."""
    prefix = prefix or col
    return df.withColumns({f"{prefix}_{lv}": F.when(F.col(col) == lv, 1).otherwise(0)
                           for lv in levels})


def feature_vector_columns(names: Sequence[str]) -> list[Column]:
    """Fixed-order feature columns, missing -> 0."""
    return [F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names]


def union_by_name(*frames: DataFrame) -> DataFrame:
    """Union all by column name, missing columns NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def first_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column | str]) -> DataFrame:
    """Keep one row per key, the first in ``order_by`` (deterministic).

    Implemented as ``min_by`` over a struct so it aggregates partially per
    partition (a hot key never gathers all its rows in one buffer).
    """
    cols = [c for c in df.columns if c not in keys]
    ordk = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order_by])
    packed = F.struct(*[F.col(c) for c in cols])
    return (df.groupBy(*keys).agg(F.min_by(packed, ordk).alias("_row"))
              .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in cols]))
