"""Time-series feature jobs: calendar, lags, rolling means, forward fill,
gap-filled calendars, annual -> daily alignment, extension and extrapolation.

Fact-sized inputs are always aggregated to a series grain first (day, or
(region, day)); single-series windows therefore run over calendar-bounded
frames (one row per day / year), and per-key series use ``partition_by``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import calendar_columns, month_key, to_day
from ..operators import windows as W
from ..operators.reshape import pivot_fixed, unpivot_digit_columns
from ..session import materialize
from ..sources import catalog as cat
from ..sources.tables import read_table

# Commodity name -> feature column (fixed values of the reference script).
COMMODITY_COLUMNS = {
    "Aluminum": "price_aluminum",
    "Copper": "price_copper",
    "Nickel": "price_nickel",
    "Crude oil, Brent": "price_crude_oil",
    "Natural gas, US": "price_natural_gas",
}


def holiday_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, is_holiday=1) for distinct holiday dates (bounded calendar)."""
    return cat.sales_holidays(spark, sf_dir).select("date").distinct().withColumn("is_holiday", F.lit(1))


def calendar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1-F5 + J12 per order: year, month, ISO week, weekday (Mon=0), quarter,
    month key and the holiday flag (existence join on distinct holiday dates)."""
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").select(
        F.col("o_orderkey").alias("order_id"), to_day("o_orderdate").alias("date"))
    o = o.join(F.broadcast(holiday_flags(spark, sf_dir)), "date", "left")
    return o.select("order_id", "date", *[v.alias(k) for k, v in calendar_columns("date").items()],
                    month_key("date").alias("month_key"),
                    F.coalesce("is_holiday", F.lit(0)).alias("is_holiday"))


def lag_rolling(df: DataFrame, value: str, order_by=("date",), partition_by=()) -> DataFrame:
    """W1 + W2 with the reference's windows: lag 7, lag 30, 7-row full mean."""
    df = W.lag_rows(df, value, 7, order_by, partition_by, "sales_lag_7")
    df = W.lag_rows(df, value, 30, order_by, partition_by, "sales_lag_30")
    return W.rolling_mean_full(df, value, 7, order_by, partition_by, "sales_rolling_7_mean")


def lag_rolling_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lag / rolling features of the daily revenue series (D12: daily grain)."""
    d = cat.daily_totals(spark, sf_dir).select("date", F.col("revenue").alias("sales"))
    return lag_rolling(d, "sales").orderBy("date")


def region_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region, date, sales): daily revenue per sales region."""
    o = cat.order_totals(spark, sf_dir, with_region=True)
    r = cat.regions(spark, sf_dir).select(F.col("id").alias("region_id"), "region")
    return (o.join(F.broadcast(r), "region_id", "left")   # 25 rows: proven bound
             .groupBy("region", "date")
             .agg(F.sum("revenue").cast("decimal(38,4)").alias("sales")))


def lag_rolling_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same features, one series per region (windows partitioned by region)."""
    return lag_rolling(region_daily(spark, sf_dir), "sales", partition_by=("region",)).orderBy(
        "region", "date")


def stock_close_wide(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> DataFrame:
    """(date, nvidia_close, samsung_close): one row per quote day."""
    sp = cat.stock_prices(spark, sf_dir, base, ["NVDA", "SAMSUNG"])
    return pivot_fixed(sp, ["date"], "ticker", {"NVDA": "nvidia_close", "SAMSUNG": "samsung_close"},
                       lambda c: F.max(c), "close")


def ffill_stock_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J11 + W3: sales days with the last known NVDA / Samsung close."""
    d = cat.daily_totals(spark, sf_dir).select("date", F.col("revenue").alias("total_revenue"))
    j = d.join(stock_close_wide(spark, sf_dir), "date", "left")
    return W.ffill(j, ["nvidia_close", "samsung_close"], ["date"]).orderBy("date")


def sales_calendar(spark: SparkSession, sf_dir: str, extra_days: int = 0) -> DataFrame:
    """G1: every day from the first to ``extra_days`` after the last sales day."""
    bounds = read_table(spark, sf_dir, "orders", "o_orderdate").agg(
        to_day(F.min("o_orderdate")).alias("start"),
        F.date_add(to_day(F.max("o_orderdate")), extra_days).alias("end"))
    return W.dense_days(bounds)


def commodity_wide(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> DataFrame:
    """(date, price_<commodity> ...) mean price per date and commodity."""
    cp = cat.commodity_prices(spark, sf_dir, base, list(COMMODITY_COLUMNS))
    return pivot_fixed(cp, ["date"], "commodity_name", COMMODITY_COLUMNS, "mean", "price_usd")


def gapfill_commodity_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly prices spread over the dense sales calendar by forward fill."""
    cal = sales_calendar(spark, sf_dir)
    j = cal.join(commodity_wide(spark, sf_dir), "date", "left")
    return W.ffill(j, list(COMMODITY_COLUMNS.values()), ["date"]).orderBy("date")


def annual_to_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual inflation broadcast onto every calendar day by year."""
    cal = sales_calendar(spark, sf_dir).withColumn("year", F.year("date"))
    a = cat.annual_series(spark, sf_dir, "inflation").withColumnRenamed("value", "inflation_india")
    return cal.join(F.broadcast(a), "year", "left").select("date", "year", "inflation_india").orderBy("date")


def _one_row(*frames: DataFrame) -> DataFrame:
    """Combine single-row aggregates into one row without a join."""
    cols = sorted({c for f in frames for c in f.columns})
    out = None
    for f in frames:
        g = f.select(*[F.col(c) if c in f.columns else F.lit(None).alias(c) for c in cols])
        out = g if out is None else out.unionByName(g)
    return out.agg(*[F.max(c).alias(c) for c in cols])


def _horizon_year(last_day) -> Column:
    """The last year that a forecast from ``last_day`` reaches."""
    return F.year(F.date_add(last_day, cat.HORIZON_DAYS)).alias("max_year")


def _max_sales_year(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "orders", "o_orderdate").agg(_horizon_year(to_day(F.max("o_orderdate"))))


def annual_extend(spark: SparkSession, sf_dir: str, annual: DataFrame | None = None,
                  max_year: DataFrame | None = None) -> DataFrame:
    """W6 + G2: extend the annual interest series to the horizon's year and
    carry the last value forward. ``annual`` / ``max_year`` may be passed in
    when the caller already has them (no second scan)."""
    a = annual if annual is not None else materialize(cat.annual_series(spark, sf_dir, "interest"), "annual")
    mx = max_year if max_year is not None else _max_sales_year(spark, sf_dir)
    bounds = _one_row(a.agg(F.max("year").alias("last_year")), mx)
    ext = (W.int_range(bounds.select((F.col("last_year") + 1).alias("s"), F.col("max_year").alias("e")),
                       "s", "e", "year")
           .select("year", F.lit(None).cast(a.schema["value"].dataType).alias("value"),
                   F.lit(1).alias("is_extended")))
    allv = a.withColumn("is_extended", F.lit(0)).unionByName(ext)
    out = W.ffill(allv, ["value"], ["year"])
    return out.select("year", F.col("value").alias("interest_rate"), "is_extended").orderBy("year")


def linear_extrapolate(spark: SparkSession, sf_dir: str, fit_from: int | None = None,
                       fit_to: int | None = None, annual: DataFrame | None = None,
                       max_year: DataFrame | None = None) -> DataFrame:
    """Fit a line to the annual inflation series over [fit_from, fit_to]
    (P6, NULLs dropped; without bounds over all its years) and append
    predictions up to the horizon's year."""
    a = annual if annual is not None else materialize(cat.annual_series(spark, sf_dir, "inflation"), "annual")
    mx = max_year if max_year is not None else _max_sales_year(spark, sf_dir)
    fit_rows = a.na.drop(subset=["value"])
    if fit_from is not None and fit_to is not None:
        fit_rows = fit_rows.filter(F.col("year").between(fit_from, fit_to))
    fit = W.linear_fit(fit_rows, "year", "value", x_center=2000.0).drop("n_points")
    last = a.agg(F.max("year").alias("last_year"))
    row = _one_row(fit, last, mx)
    years = F.when(F.col("last_year") + 1 <= F.col("max_year"),
                   F.sequence(F.col("last_year") + 1, F.col("max_year")))
    ext = row.select(F.explode(years).alias("year"), "slope", "intercept").select(
        "year", F.round(W.poly1(F.col("year"), F.col("slope"), F.col("intercept"), 2000.0), 2).alias("value"),
        F.lit(1).alias("is_extrapolated"))
    hist = a.select("year", F.round(F.col("value").cast("double"), 2).alias("value"),
                    F.lit(0).alias("is_extrapolated"))
    return hist.unionByName(ext).orderBy("year")


def yearly_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(year, inflation_india, interest_rate, lithium_price_usd): every yearly
    feature from one scan of orders, up to the horizon's year."""
    every = materialize(cat.annual_all(spark, sf_dir), "annual_all")
    series = lambda kind: every.select("year", F.col(kind).alias("value"))
    mx = _max_sales_year(spark, sf_dir)
    ext = annual_extend(spark, sf_dir, series("interest"), mx).select("year", F.col("interest_rate").cast("double"))
    lith = linear_extrapolate(spark, sf_dir, annual=series("lithium"), max_year=mx).select(
        "year", F.col("value").alias("lithium_price_usd"))
    inf = series("inflation").select("year", F.col("value").cast("double").alias("inflation_india"))
    return lith.join(inf, "year", "left").join(ext, "year", "full_outer")


def unpivot_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G3 + G4 + C19: wide yearly tables -> long (all-digit columns) -> outer
    alignment of the two indicators on year."""
    inf = unpivot_digit_columns(cat.annual_wide(spark, sf_dir, "inflation"), ["country", "indicator"],
                                "year", "inflation_india").drop("indicator")
    intr = unpivot_digit_columns(cat.annual_wide(spark, sf_dir, "interest"), ["country", "indicator"],
                                 "year", "interest_india").drop("indicator")
    return (inf.join(intr, ["country", "year"], "full_outer")
               .select("country", "year", "inflation_india", "interest_india").orderBy("year"))
