"""M1: the sales feature table, and its one-hot (G5, G6) and ordered
train / test split (W7) pieces.

Every market feature is a function of the day, so all of them are built on
one *daily* table (one row per calendar day: bounded, broadcastable) and
attached to the line-grain fact by a single broadcast hash join on date.
Lag and rolling features are computed on the daily revenue total (D12).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import calendar_columns
from ..operators import windows as W
from ..operators.rank import global_rank
from ..operators.reshape import one_hot
from ..session import materialize
from ..sources import catalog as cat
from ..sources.tables import read_table
from . import timeseries as ts

# Model inputs in the reference's order (fixed values).
FEATURES = ["month", "week", "day_of_week", "quarter", "is_holiday",
            "sales_lag_7", "sales_lag_30", "sales_rolling_7_mean",
            "nvidia_close", "samsung_close", "inflation_india", "interest_rate",
            "lithium_price_usd", "price_aluminum", "price_copper", "price_crude_oil"]

CATEGORY_LEVELS = ["component", "end_product", "raw_material"]


def level_name(v: str) -> str:
    return "".join(ch if ch.isalnum() else "_" for ch in v)


def region_levels(spark: SparkSession, sf_dir: str) -> list[str]:
    """Region names from the region dimension (a handful of rows)."""
    return sorted(r[0] for r in cat.regions(spark, sf_dir).select("region").distinct().collect())


def daily_features(spark: SparkSession, sf_dir: str, daily: DataFrame | None = None) -> DataFrame:
    """One row per calendar day, up to the horizon, with every day-level feature
    (days after the last sale have only calendar, yearly and price features).

    The shared day / year grain inputs (daily revenue, calendar, yearly
    series) are each computed once and written to the shared folder (all are
    bounded by the calendar), so the fact is joined once for the daily
    totals, and the quote and commodity series are the only other fact passes.
    ``daily`` (date, sales): the daily revenue, if the caller has it already.
    """
    if daily is None:
        daily = cat.daily_totals(spark, sf_dir).select("date", F.col("revenue").alias("sales"))
    daily = materialize(daily, "daily_revenue")
    cal = materialize(ts.sales_calendar(spark, sf_dir, cat.HORIZON_DAYS), "calendar").withColumn("year", F.year("date"))
    lags = ts.lag_rolling(daily, "sales").drop("sales")
    # Quotes and commodity prices share one lineitem x part pass.
    lp = materialize(cat.line_part_daily(spark, sf_dir), "line_part_daily")
    stock = W.ffill(daily.select("date").join(ts.stock_close_wide(spark, sf_dir, lp), "date", "left"),
                    ["nvidia_close", "samsung_close"], ["date"])
    prices = W.ffill(cal.select("date").join(ts.commodity_wide(spark, sf_dir, lp), "date", "left"),
                     ["price_aluminum", "price_copper", "price_crude_oil"], ["date"]).select(
        "date", "price_aluminum", "price_copper", "price_crude_oil")
    yearly = ts.yearly_features(spark, sf_dir)
    hol = ts.holiday_flags(spark, sf_dir)
    d = (cal.join(F.broadcast(hol), "date", "left")
            .join(lags, "date", "left").join(stock, "date", "left").join(prices, "date", "left")
            .join(F.broadcast(yearly), "year", "left"))
    return d.select(
        "date", *[v.alias(k) for k, v in calendar_columns("date").items() if k != "year"],
        F.coalesce("is_holiday", F.lit(0)).alias("is_holiday"),
        *[F.col(c).cast("double").alias(c) for c in FEATURES[5:]])


def line_facts(spark: SparkSession, sf_dir: str, date_start=None, date_end=None) -> DataFrame:
    """Line-grain target with its category and region labels, of the days given."""
    s = cat.sales(spark, sf_dir, with_region=True, date_start=date_start, date_end=date_end).select(
        "date", "order_id", "product_id", "region_id", "quantity", "revenue")
    p = cat.products(spark, sf_dir).select(F.col("id").alias("product_id"), "category")
    r = cat.regions(spark, sf_dir).select(F.col("id").alias("region_id"), "region")
    return (s.join(p, "product_id", "left")
             .join(F.broadcast(r), "region_id", "left"))   # 25 rows: proven bound


def with_one_hots(df: DataFrame, regions: list[str]) -> DataFrame:
    df = one_hot(df, "category", CATEGORY_LEVELS, "Category")
    df = df.withColumnsRenamed({f"Category_{v}": f"Category_{level_name(v)}" for v in CATEGORY_LEVELS})
    df = one_hot(df, "region", regions, "Region")
    return df.withColumnsRenamed({f"Region_{v}": f"Region_{level_name(v)}" for v in regions})


def one_hot_columns(regions: list[str]) -> list[str]:
    return ([f"Category_{level_name(v)}" for v in CATEGORY_LEVELS]
            + [f"Region_{level_name(v)}" for v in regions])


def one_hot_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per line, one 0/1 column per category and per region level."""
    regions = region_levels(spark, sf_dir)
    df = with_one_hots(line_facts(spark, sf_dir), regions)
    return df.select("order_id", "product_id", "revenue", *one_hot_columns(regions))


def feature_table(spark: SparkSession, sf_dir: str, drop_incomplete: bool = True) -> DataFrame:
    """M1: line target ``sales`` + the 16 features + one-hots.

    The daily feature table is bounded by the calendar, so the broadcast is
    size-proven; rows with a NULL feature are dropped like the reference.
    """
    regions = region_levels(spark, sf_dir)
    f = line_facts(spark, sf_dir).join(F.broadcast(daily_features(spark, sf_dir)), "date", "left")
    f = with_one_hots(f, regions)
    out = f.select("date", "order_id", "product_id", F.col("revenue").alias("sales"),
                   *FEATURES, *one_hot_columns(regions))
    return out.na.drop(subset=FEATURES) if drop_incomplete else out


def train_test_split(df: DataFrame, order_by, test_fraction: float = 0.2) -> DataFrame:
    """Ordered split, the last ceil(fraction * n) rows are the test set.

    The rank comes from a distributed sort (``global_rank``), not a global
    window; n is a scalar aggregate.
    """
    ranked = global_rank(df, order_by, "row_rank")
    n = ranked.count()
    n_test = math.ceil(round(test_fraction * n, 9))
    return ranked.withColumn("is_test", (F.col("row_rank") > F.lit(n - n_test)).cast("int"))


def ordered_split(df: DataFrame, day_col: str, order_by, test_fraction: float = 0.2) -> DataFrame:
    """W7 without sorting the whole table: adds ``is_test`` only.

    ``order_by`` must start with ``day_col``. Rows per day (one row per day:
    bounded) locate the day that holds the cut; rows before it are training
    rows, rows after it test rows, and only the rows of that one day are
    ranked (distributed) to place the cut inside it.
    """
    per_day = materialize(df.groupBy(day_col).agg(F.count(F.lit(1)).alias("_n")), "per_day")
    n = per_day.agg(F.sum("_n")).first()[0] or 0
    n_train = n - math.ceil(round(test_fraction * n, 9))
    w = Window.orderBy(day_col).rowsBetween(Window.unboundedPreceding, 0)
    cut = (per_day.withColumn("_cum", F.sum("_n").over(w))
           .filter(F.col("_cum") >= n_train).orderBy(day_col).limit(1).collect())
    if not cut:
        return df.withColumn("is_test", F.lit(0))
    cut_day, k = cut[0][day_col], n_train - (cut[0]["_cum"] - cut[0]["_n"])
    day = F.col(day_col)
    others = df.filter(day != F.lit(cut_day)).withColumn("is_test", (day > F.lit(cut_day)).cast("int"))
    on_cut = global_rank(df.filter(day == F.lit(cut_day)), order_by[1:] or order_by, "_r")
    on_cut = on_cut.withColumn("is_test", (F.col("_r") > F.lit(k)).cast("int")).drop("_r")
    return others.unionByName(on_cut)


def order_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W7 on orders ordered by (order date, order key)."""
    o = (read_table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
         .select(F.col("o_orderkey").alias("order_id"), F.to_date("o_orderdate").alias("date")))
    return train_test_split(o, ["date", "order_id"]).select("order_id", "date", "row_rank", "is_test")
