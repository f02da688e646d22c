"""Sales regression (M2), hold-out evaluation (M3, A16), persistence (K3)
and batch scoring of prediction requests (M5).

Every feature is a function of (day, category, region), so the least-squares
fit needs one row per such cell: the number of its lines as weight and their
mean as label give the same normal equations as the lines themselves. The
fact is aggregated once; only the day that holds the train / test cut is
ranked line by line. The fit (``operators.leastsq``) needs only the cells' means
and products. With every one-hot level plus an intercept the design is
collinear; of the solutions the one of smallest norm is taken, predictions are
the same for all.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import date

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import calendar_columns
from ..operators import windows as W
from ..operators.leastsq import LinearModel, least_squares
from ..operators.rank import global_rank
from ..operators.reshape import feature_vector_columns
from ..session import materialize
from . import features as fe
from . import requests as rq

ORDER = ["date", "order_id", "product_id", "sales"]
CELL = ["date", "category", "region"]
WARNING = "An extrapolation of past sales: the further from the training period, the less reliable."


def model_columns(spark: SparkSession, sf_dir: str) -> list[str]:
    """The fixed, ordered model input list (features + one-hots)."""
    return fe.FEATURES + fe.one_hot_columns(fe.region_levels(spark, sf_dir))


@dataclass
class Split:
    """The ordered inputs, and the lines before and after the train / test cut."""

    columns: list[str]
    cells: DataFrame        # features of each (day, category, region) with lines
    cut_day: date | None    # first day with test lines
    cut_rows: DataFrame     # lines of that day with is_test


@dataclass
class Fitted(Split):
    """A trained model and the split it was trained on."""

    model: LinearModel

    def test_lines(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """Held-out lines (ORDER + category, region) with ``prediction``."""
        known = self.cells.select(*[F.col(c).alias(f"_{c}") for c in CELL], *self.columns)
        grid = self.model.transform(known.filter(F.col("_date") >= F.lit(self.cut_day)))
        grid = grid.select(*[f"_{c}" for c in CELL], "prediction")
        days = self.cells.select("date").distinct()
        later = (_lines(spark, sf_dir, date_start=str(self.cut_day)).filter(F.col("date") > F.lit(self.cut_day))
                 .join(F.broadcast(days), "date", "left_semi"))
        rows = later.unionByName(self.cut_rows.filter("is_test = 1").drop("is_test"))
        # days x categories x regions: bounded
        return rows.join(F.broadcast(grid), [rows[c].eqNullSafe(grid[f"_{c}"]) for c in CELL]).drop(*[f"_{c}" for c in CELL])


def _lines(spark: SparkSession, sf_dir: str, **days) -> DataFrame:
    return fe.line_facts(spark, sf_dir, **days).select(
        "date", "order_id", "product_id", F.col("revenue").alias("sales"), "category", "region")


def build_pipeline(cols: list[str], weight: str | None = None) -> Pipeline:
    """The same regression as a Spark ML pipeline, for other estimators' stages."""
    va = VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="error")
    lr = LinearRegression(featuresCol="features", labelCol="label", predictionCol="prediction",
                          regParam=0.0, elasticNetParam=0.0, solver="normal", fitIntercept=True)
    return Pipeline(stages=[va, lr.setWeightCol(weight) if weight else lr])


def split_sales(spark: SparkSession, sf_dir: str, test_fraction: float = 0.2) -> Split:
    """The cut before the last ``test_fraction`` of the lines in the order
    of ORDER (lines of days with a missing feature take no part)."""
    regions = fe.region_levels(spark, sf_dir)
    cols = fe.FEATURES + fe.one_hot_columns(regions)
    sums = materialize(_lines(spark, sf_dir).groupBy(*CELL).agg(F.count("sales").alias("n"), F.sum("sales").alias("total")), "cell_sums")
    daily = sums.groupBy("date").agg(F.sum("total").cast("decimal(38,4)").alias("sales"))
    days = fe.daily_features(spark, sf_dir, daily).na.drop(subset=fe.FEATURES)
    cells = materialize(fe.with_one_hots(sums.join(F.broadcast(days), "date"), regions)
                        .withColumns({c: F.col(c).cast("double") for c in cols}), "model_cells")
    per_day = cells.groupBy("date").agg(F.sum("n").alias("n"))
    n = per_day.agg(F.sum("n")).first()[0] or 0
    n_train = n - math.ceil(round(test_fraction * n, 9))
    upto = F.sum("n").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    cut = per_day.withColumn("upto", upto).filter(F.col("upto") > n_train).orderBy("date").limit(1).collect()
    cut_day, before = (cut[0]["date"], n_train - (cut[0]["upto"] - cut[0]["n"])) if cut else (None, 0)
    day = str(cut_day) if cut else "0001-01-01"
    on_cut = global_rank(_lines(spark, sf_dir, date_start=day, date_end=day).filter("sales is not null"), ORDER[1:], "_r")
    on_cut = materialize(on_cut.withColumn("is_test", (F.col("_r") > before).cast("int")).drop("_r"), "cut_day")
    return Split(cols, cells, cut_day, on_cut)


def fit_sales_model(spark: SparkSession, sf_dir: str, test_fraction: float = 0.2) -> Fitted:
    """M2 + W7: fit on the lines before the cut."""
    s = split_sales(spark, sf_dir, test_fraction)
    cols, cells, cut_day, on_cut = s.columns, s.cells, s.cut_day, s.cut_rows
    label = (F.col("total").cast("double") / F.col("n")).alias("label")
    train = cells.filter(F.col("date") < F.lit(cut_day) if cut_day else F.lit(True)).select("n", label, *cols)
    some = (on_cut.filter("is_test = 0").groupBy(*CELL).agg(F.count("sales").alias("n"), F.sum("sales").alias("total"))
            .select(*[F.col(c).alias(f"_{c}") for c in CELL], F.col("n").alias("_n"), F.col("total").alias("_t")))
    first = cells.join(F.broadcast(some), [cells[c].eqNullSafe(some[f"_{c}"]) for c in CELL]).select(
        F.col("_n").alias("n"), (F.col("_t").cast("double") / F.col("_n")).alias("label"), *cols)
    model = least_squares(train.unionByName(first), cols, "label", "n")
    return Fitted(cols, cells, cut_day, on_cut, model)


def save_model(fitted: Fitted, path: str) -> None:
    """K3: the model and its ordered feature list, for any later application."""
    fitted.model.save(fitted.cells.sparkSession, f"{path}/model")


def load_model(spark: SparkSession, path: str) -> tuple[LinearModel, list[str]]:
    """The model and feature list that ``save_model`` wrote."""
    model = LinearModel.load(spark, f"{path}/model")
    return model, model.columns


def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W7 of the model: lines and sales on both sides of the cut (one row),
    counted from the cells and the cut's day; nothing is fitted."""
    s = split_sales(spark, sf_dir)
    later = F.col("date") > F.lit(s.cut_day) if s.cut_day else F.lit(False)
    sums = lambda n, t: (F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("n"), F.coalesce(F.sum(t), F.lit(0)).cast("decimal(38,4)").alias("s"))
    parts = s.cells.select("n", "total", later.alias("test")).groupBy("test").agg(*sums("n", "total"))
    on = s.cut_rows.groupBy((F.col("is_test") == 1).alias("test")).agg(*sums(F.lit(1), "sales"))
    moved = on.filter("test").select(F.lit(True).alias("test"), "n", "s").union(on.filter("test").selectExpr("false", "-n", "-s"))
    total = lambda side, c: F.coalesce(F.sum(F.when(side, F.col(c))), F.lit(0))
    return parts.union(moved).agg(total(~F.col("test"), "n").alias("n_train"), total(F.col("test"), "n").alias("n_test"),
                                  total(~F.col("test"), "s").cast("decimal(38,4)").alias("sales_train"),
                                  total(F.col("test"), "s").cast("decimal(38,4)").alias("sales_test"))


def ols_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: predictions for the held-out rows."""
    rows = fit_sales_model(spark, sf_dir).test_lines(spark, sf_dir)
    return rows.select(*ORDER, F.round("prediction", 4).alias("prediction"))


def ols_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3 + A16: mean absolute error on the last 20 % (one row)."""
    fitted = fit_sales_model(spark, sf_dir)
    all_ = fitted.cells.agg(F.sum("n").alias("n"))
    test = fitted.test_lines(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n_test"), F.round(F.avg(F.abs(F.col("sales").cast("double") - F.col("prediction"))), 4).alias("mae"))
    return test.join(F.broadcast(all_)).select((F.col("n") - F.col("n_test")).alias("n_train"), "n_test", "mae")   # one row each


def ols_optimality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2 checked: for each input (and the intercept) the training residuals'
    product with it, relative to the label's, rounded: all 0 at the optimum."""
    fitted = fit_sales_model(spark, sf_dir)
    cells = fitted.cells.filter(F.col("date") < F.lit(fitted.cut_day)) if fitted.cut_day else fitted.cells
    cells = cells.select(*CELL, "n", "total", *fitted.columns)
    some = fitted.cut_rows.filter("is_test = 0").groupBy(*CELL).agg(F.count("sales").alias("_n"), F.sum("sales").alias("_t"))
    some = some.select(*[F.col(c).alias(f"_{c}") for c in CELL], "_n", "_t")
    first = fitted.cells.join(F.broadcast(some), [fitted.cells[c].eqNullSafe(some[f"_{c}"]) for c in CELL]).select(
        *CELL, F.col("_n").alias("n"), F.col("_t").alias("total"), *fitted.columns)
    scored = fitted.model.transform(cells.unionByName(first)).withColumn("intercept", F.lit(1.0))
    y, e = F.col("total").cast("double"), F.col("total").cast("double") - F.col("n") * F.col("prediction")
    names = [*fitted.columns, "intercept"]
    row = scored.agg(*[F.round(F.sum(e * F.col(c)) / F.greatest(F.sum(F.abs(y * F.col(c))), F.lit(1.0)), 4).alias(c) for c in names])
    # -0.0 and 0.0 print alike
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("input"), (F.col(c) + 0.0).alias("slope")) for c in names])).alias("r")).select("r.*")


def request_features(spark: SparkSession, sf_dir: str, cols: list[str], valid: DataFrame | None = None) -> DataFrame:
    """M5 feature rows for valid requests.

    Calendar features of the basis date; lag proxies from the context row
    (x0.95, x0.90, x1.0); the close routed by ticker; macro and commodity
    features *as of* the basis date (D9: the reference leaves them at 0) from
    the dense, forward-filled daily table (basis dates past its end take the
    last day); one-hots from the request's category and region, mapped to
    the labels of the training rows.
    """
    valid = valid if valid is not None else materialize(rq.valid_requests(spark, sf_dir), "requests")
    ctx = rq.context_fallback(spark, sf_dir, valid)
    req = valid.select("request_id", "holiday", "ticker", "cat_stored", F.col("region_stored").alias("region"))
    market = ["inflation_india", "interest_rate", "lithium_price_usd",
              "price_aluminum", "price_copper", "price_crude_oil"]
    # As-of values: last known value on or before each day (one row per day).
    daily = W.ffill(fe.daily_features(spark, sf_dir), market, ["date"])
    last_day = daily.agg(F.max("date").alias("_last"))
    r = (ctx.join(req, "request_id")
            .withColumn("_one", F.lit(1))
            .join(F.broadcast(last_day.withColumn("_one", F.lit(1))), "_one")   # one row
            .withColumn("_asof", F.least("basis_date", "_last")))
    r = r.join(F.broadcast(daily.select(F.col("date").alias("_asof"), *market)), "_asof", "left")
    rev = F.coalesce(F.col("context_revenue").cast("double"), F.lit(0.0))
    close = F.coalesce(F.col("stock_close"), F.lit(0.0))
    base = {k: v for k, v in calendar_columns("basis_date").items() if k != "year"}
    base.update({
        "is_holiday": F.when(F.col("holiday").isNotNull(), 1).otherwise(0),
        "sales_lag_7": rev * 0.95,
        "sales_lag_30": rev * 0.90,
        "sales_rolling_7_mean": rev,
        "nvidia_close": F.when(F.col("ticker") == "NVDA", close).otherwise(0.0),
        "samsung_close": F.when(F.col("ticker") == "SAMSUNG", close).otherwise(0.0),
    })
    base.update({m: F.coalesce(F.col(m), F.lit(0.0)) for m in market})
    r = r.withColumns(base).withColumnRenamed("cat_stored", "category")
    r = fe.with_one_hots(r, fe.region_levels(spark, sf_dir))
    return r.select("request_id", "sample_size", "level_used", "basis_date",
                    *feature_vector_columns(cols))


def score_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5 before the model: the feature row of each valid request."""
    cols = model_columns(spark, sf_dir)
    return request_features(spark, sf_dir, cols).select(
        "request_id", "sample_size", "level_used", "basis_date", *cols)


def score_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: one prediction per valid request, rounded to 2 decimals."""
    fitted = fit_sales_model(spark, sf_dir)
    valid = materialize(rq.valid_requests(spark, sf_dir), "requests")
    pred = fitted.model.transform(request_features(spark, sf_dir, fitted.columns, valid))
    # The response echoes the (cleaned) request as its input context.
    ctx = valid.select(
        "request_id", *[F.col(c).alias(f"request_{c}") for c in
                        ("category", "region", "holiday", "ticker", "commodity", "year", "date")])
    pred = pred.join(ctx, "request_id")
    return pred.select(
        "request_id", *[c for c in ctx.columns if c != "request_id"],
        F.round("prediction", 2).alias("estimated_revenue"),
        F.lit("INR").alias("currency"),
        F.col("sample_size").alias("historical_sample_size"),
        "level_used",
        F.date_format("basis_date", "yyyy-MM-dd").alias("basis_date"),
        F.lit(WARNING).alias("warning"))
