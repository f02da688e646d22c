"""Daily revenue forecast with an interval (M6-M9).

An additive regression stands in for the reference's forecasting library:
linear trend + yearly and weekly Fourier terms + one indicator per holiday,
fitted by least squares. The design matrix is built with DataFrame
expressions (one row per day: bounded by the calendar, not by the data) and
fitted with Spark ML; the interval is yhat +/- z * sigma(residuals) at 80 %.
The library's piecewise trend, priors and simulated intervals are not
reproduced, so numbers differ from it by design.

Many series (one per region) are fitted in parallel with
``groupBy(region).applyInPandas``: each group is one region's daily series,
whose length is the number of days, so no group grows with the fact size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from ..sources import catalog as cat
from . import timeseries as ts

Z80 = 1.2815515655446004          # two-sided 80 % normal quantile
YEARLY_ORDER = 10                 # Fourier orders of the usual additive model
WEEKLY_ORDER = 3
MAX_DAYS = 365


def _holiday_names(spark) -> list[str]:
    return [t[2] for t in cat.HOLIDAY_TEMPLATES]


def _hcol(name: str) -> str:
    return "hol_" + "".join(ch if ch.isalnum() else "_" for ch in name.lower())


def design(df: DataFrame, origin: str, holidays: DataFrame, names: list[str]) -> DataFrame:
    """Add trend, Fourier and holiday columns for ``ds`` (origin = first day)."""
    t = F.datediff(F.col("ds"), F.to_date(F.lit(origin))).cast("double")
    cols = {"trend": t / 365.25}
    for k in range(1, YEARLY_ORDER + 1):
        a = F.lit(2.0 * math.pi * k) * t / 365.25
        cols[f"yearly_s{k}"], cols[f"yearly_c{k}"] = F.sin(a), F.cos(a)
    for k in range(1, WEEKLY_ORDER + 1):
        a = F.lit(2.0 * math.pi * k) * t / 7.0
        cols[f"weekly_s{k}"], cols[f"weekly_c{k}"] = F.sin(a), F.cos(a)
    out = df.withColumns(cols)
    # Holiday indicators: (ds, name) pairs pivoted with fixed names (bounded calendar).
    hw = (holidays.select(F.col("date").alias("ds"), "name")
          .groupBy("ds").agg(*[F.max(F.when(F.col("name") == n, 1.0)).alias(_hcol(n)) for n in names]))
    out = out.join(F.broadcast(hw), "ds", "left")
    return out.fillna(0.0, subset=[_hcol(n) for n in names])


def design_columns(names: list[str]) -> list[str]:
    return (["trend"] + [f"yearly_{s}{k}" for k in range(1, YEARLY_ORDER + 1) for s in ("s", "c")]
            + [f"weekly_{s}{k}" for k in range(1, WEEKLY_ORDER + 1) for s in ("s", "c")]
            + [_hcol(n) for n in names])


def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ds, y): daily revenue (NULL days dropped)."""
    d = cat.daily_totals(spark, sf_dir)
    return d.select(F.col("date").alias("ds"), F.col("revenue").cast("double").alias("y")).na.drop()


def _check_days(days: int) -> None:
    if days > MAX_DAYS:
        raise ValueError(f"days must be at most {MAX_DAYS}, not {days}")


def _fit_single(spark, sf_dir, days):
    _check_days(days)
    # One row per day (bounded); written once because the fit, the residual
    # spread and the bounds all read it.
    hist = materialize(daily_series(spark, sf_dir), "daily_series")
    bounds = hist.agg(F.min("ds").alias("first"), F.max("ds").alias("last")).first()
    origin = bounds["first"].isoformat()
    names = _holiday_names(spark)
    hol = cat.sales_holidays(spark, sf_dir)
    cols = design_columns(names)
    # M7: future frame = history + `days` new dates after the last one.
    fut = spark.range(1, days + 1).select(
        F.date_add(F.lit(bounds["last"]), F.col("id").cast("int")).alias("ds"),
        F.lit(None).cast("double").alias("y"))
    frame = design(hist.unionByName(fut), origin, hol, names)
    va = VectorAssembler(inputCols=cols, outputCol="features")
    lr = LinearRegression(featuresCol="features", labelCol="y", regParam=0.0, solver="normal")
    model = lr.fit(va.transform(frame.filter(F.col("y").isNotNull())))
    scored = model.transform(va.transform(frame))
    sigma = (scored.filter(F.col("y").isNotNull())
             .agg(F.stddev_samp(F.col("y") - F.col("prediction")).alias("s")).first()["s"] or 0.0)
    return model, cols, scored, sigma, bounds["last"]


def forecast_frame(spark: SparkSession, sf_dir: str, days: int = 90) -> DataFrame:
    """M7 + M8: what the forecast is fitted on and predicted from: sales days
    and the ``days`` after them, with trend and holiday regressors."""
    _, cols, scored, _, last = _fit_single(spark, sf_dir, days)
    return scored.select("ds", (F.col("ds") > F.lit(last)).cast("int").alias("is_future"), "trend",
                         *[c for c in cols if c.startswith("hol_")]).orderBy("ds")


def forecast_balance(spark: SparkSession, sf_dir: str, days: int = 90) -> DataFrame:
    """M6 checked: for each input (and the intercept) the product of the
    residuals with it over the sales days, relative to the sales', rounded: all
    0 at the least-squares optimum of the whole design, and only there."""
    _, cols, scored, _, last = _fit_single(spark, sf_dir, days)
    names = [*cols, "intercept"]
    e = F.col("y") - F.col("prediction")
    known = scored.filter(F.col("ds") <= F.lit(last)).withColumn("intercept", F.lit(1.0))
    row = known.agg(F.count(F.lit(1)).alias("n_days"), F.round(F.sum("y"), 2).alias("total"),
                    *[F.round(F.sum(e * F.col(c)) / F.greatest(F.sum(F.abs(F.col("y") * F.col(c))), F.lit(1.0)), 6).alias(c) for c in names])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("input"), (F.col(c) + 0.0).alias("slope")) for c in names])).alias("r")
    return row.select("n_days", "total", each).select("n_days", "total", "r.input", "r.slope")


def forecast(spark: SparkSession, sf_dir: str, days: int = 90) -> DataFrame:
    """M6: ds, yhat, yhat_lower, yhat_upper for the ``days`` after the last sale."""
    model, cols, scored, sigma, last = _fit_single(spark, sf_dir, days)
    out = scored.filter(F.col("ds") > F.lit(last)).select(
        "ds", F.col("prediction").alias("yhat"),
        (F.col("prediction") - F.lit(Z80 * sigma)).alias("yhat_lower"),
        (F.col("prediction") + F.lit(Z80 * sigma)).alias("yhat_upper"))
    return out.orderBy("ds")


def forecast_components(spark: SparkSession, sf_dir: str, days: int = 90) -> DataFrame:
    """M9: additive contribution of trend, yearly, weekly and holiday blocks per day."""
    model, cols, scored, sigma, last = _fit_single(spark, sf_dir, days)
    coef = dict(zip(cols, model.coefficients.toArray().tolist()))

    def block(prefix):
        terms = [F.lit(w) * F.col(c) for c, w in coef.items() if c.startswith(prefix)]
        out = terms[0]
        for t in terms[1:]:
            out = out + t
        return out

    return scored.select(
        "ds", (F.lit(model.intercept) + block("trend")).alias("trend"),
        block("yearly_").alias("yearly"), block("weekly_").alias("weekly"),
        block("hol_").alias("holidays"), F.col("prediction").alias("yhat")).orderBy("ds")


# ---------------------------------------------------------------------------
# Many series: one least-squares fit per region, in parallel
# ---------------------------------------------------------------------------
def _np_design(ds: pd.Series, origin: pd.Timestamp, hol_dates: dict) -> np.ndarray:
    t = ((ds - origin).dt.days.to_numpy(dtype=float))
    cols = [np.ones_like(t), t / 365.25]
    for k in range(1, YEARLY_ORDER + 1):
        a = 2.0 * np.pi * k * t / 365.25
        cols += [np.sin(a), np.cos(a)]
    for k in range(1, WEEKLY_ORDER + 1):
        a = 2.0 * np.pi * k * t / 7.0
        cols += [np.sin(a), np.cos(a)]
    for name, dates in hol_dates.items():
        cols.append(ds.isin(dates).to_numpy(dtype=float))
    return np.column_stack(cols)


def forecast_by_region(spark: SparkSession, sf_dir: str, days: int = 90) -> DataFrame:
    """M6 per region: ``applyInPandas`` fits each region's daily series."""
    _check_days(days)
    series = ts.region_daily(spark, sf_dir).select(
        "region", F.col("date").alias("ds"), F.col("sales").cast("double").alias("y"))
    hol_rows = cat.sales_holidays(spark, sf_dir).select("name", "date").collect()   # bounded calendar
    hol_dates: dict[str, list] = {}
    for r in hol_rows:
        hol_dates.setdefault(r["name"], []).append(pd.Timestamp(r["date"]))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ds")
        ds = pd.to_datetime(pdf["ds"])
        origin = ds.iloc[0]
        X = _np_design(ds, origin, hol_dates)
        y = pdf["y"].to_numpy(dtype=float)
        beta, *_ = np.linalg.lstsq(X, y, rcond=None)
        resid = y - X @ beta
        sigma = float(np.std(resid, ddof=1)) if len(y) > 1 else 0.0
        fut = pd.Series(pd.date_range(ds.iloc[-1] + pd.Timedelta(days=1), periods=days, freq="D"))
        yhat = _np_design(fut, origin, hol_dates) @ beta
        return pd.DataFrame({"region": pdf["region"].iloc[0], "ds": fut.dt.date, "yhat": yhat,
                             "yhat_lower": yhat - Z80 * sigma, "yhat_upper": yhat + Z80 * sigma})

    schema = "region string, ds date, yhat double, yhat_lower double, yhat_upper double"
    return series.groupBy("region").applyInPandas(fit, schema).orderBy("region", "ds")
