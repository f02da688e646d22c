"""Least squares from sufficient statistics.

The rows are read twice, for the column means and for the centred products of
all columns with each other: two distributed aggregates of a few hundred
numbers, whatever the number of rows. The normal equations, scaled to
correlations, are solved on the driver through their eigenvectors. Directions
without variance (collinear or constant columns) get no weight, so the
coefficients are the unique ones of smallest norm in scaled columns.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LinearModel:
    """``level`` + sum of coefficient * (column - centre); ``level`` is None
    without training rows, then predictions are NULL."""

    columns: list[str]
    coefficients: list[float]
    centres: list[float]
    level: float | None
    rank: int = 0

    def predicted(self) -> Column:
        terms = [F.lit(b) * (F.col(c) - F.lit(m)) for c, b, m in zip(self.columns, self.coefficients, self.centres, strict=True)]
        return reduce(lambda a, t: a + t, terms, F.lit(self.level).cast("double"))

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``prediction``: a column expression, NULL where an input is."""
        return rows.withColumn("prediction", self.predicted())

    def save(self, spark: SparkSession, path: str) -> None:
        """Written as one row; doubles are kept exactly."""
        spark.createDataFrame([(self.columns, self.coefficients, self.centres, self.level, self.rank)],
                              "columns array<string>, coefficients array<double>, centres array<double>, level double, rank int"
                              ).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> LinearModel:
        r = spark.read.parquet(path).first()
        return LinearModel(list(r["columns"]), list(r["coefficients"]), list(r["centres"]), r["level"], r["rank"])


def least_squares(rows: DataFrame, columns: list[str], label: str, weight: str | None = None, tolerance: float = 1e-10) -> LinearModel:
    """The weighted least-squares fit of ``label`` on ``columns`` and an intercept.

    Rows with a NULL among these columns, or a weight that is NULL or not above
    0, take no part. A direction whose variance is below ``tolerance`` of the
    largest counts as none. ``rows`` should be a written table: it is read twice.
    """
    names, p = [*columns, label], len(columns)
    x = F.array(*[F.col(c).cast("double") for c in names])
    known = rows.select(x.alias("x"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")).filter("w > 0")
    known = known.filter(~F.exists("x", lambda v: v.isNull()))
    at = range(p + 1)
    first = known.selectExpr("sum(w)", *[f"sum(w * x[{k}])" for k in at]).first()
    if first[0] is None:
        return LinearModel(list(columns), [0.0] * p, [0.0] * p, None)
    mean = [s / first[0] for s in first[1:]]
    centred = known.select("w", F.zip_with("x", F.lit(mean), lambda v, m: v - m).alias("z"))
    sides = centred.selectExpr("w", "z", "posexplode(z) AS (i, zi)")
    sums = sides.groupBy("i").agg(*[F.expr(f"sum(w * zi * z[{k}])") for k in at]).collect()
    gram = np.zeros((p + 1, p + 1))     # p + 1 rows
    for r in sums:
        gram[r["i"]] = r[1:]
    # a column that varies by less than 1e-10 of its mean is constant but for rounding
    spread = np.sqrt(np.diag(gram)[:p])
    varies = spread > 1e-10 * np.sqrt(first[0]) * np.abs(mean[:p])
    scale = np.where(varies, spread, 1.0)
    part = np.outer(varies, varies) * gram[:p, :p] / np.outer(scale, scale)
    values, vectors = np.linalg.eigh((part + part.T) / 2)
    kept = values > tolerance * max(values.max(initial=0.0), 1e-300)
    v = vectors[:, kept]
    b = (v @ ((v.T @ (varies * gram[:p, p] / scale)) / values[kept])) / scale
    return LinearModel(list(columns), [float(c) for c in b], [float(m) for m in mean[:p]], float(mean[p]), int(kept.sum()))
