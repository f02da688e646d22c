"""Data-quality expectations (V1-V3): the reference declares keys, UNIQUE,
NOT NULL, CHECK and REFERENCES in its DDL but loses them on load; here they
are checks that report violations instead of constraints."""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """V2: key values that occur more than once, with their copy count.

    Partial aggregation per partition keeps a hot key from gathering its rows.
    """
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_copies"))
              .filter(F.col("n_copies") > 1))


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """V3: child rows whose non-NULL key has no parent (left anti join)."""
    c = child.filter(F.col(child_key).isNotNull())
    p = parent.select(F.col(parent_key).alias("_pk")).distinct()
    return c.join(p, c[child_key] == p["_pk"], "left_anti")


def count_check(name: str, violations: DataFrame) -> DataFrame:
    """One row (check, n_violations) for a violation set."""
    return violations.agg(F.count(F.lit(1)).alias("n_violations")).select(
        F.lit(name).alias("check"), "n_violations")


def not_null_check(name: str, df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """V3: rows with a NULL in any of the NOT NULL columns."""
    cond = None
    for c in cols:
        cond = F.col(c).isNull() if cond is None else (cond | F.col(c).isNull())
    return count_check(name, df.filter(cond))


def error_list(checks: Sequence[tuple[str, Column]]) -> Column:
    """V1: array of the names of failed checks (``cond`` true = failure)."""
    return F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in checks]),
                    lambda x: x.isNotNull())
