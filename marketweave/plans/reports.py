"""Shaped outputs behind the reference's charts and dashboard tables:
region x month pivot (A12), box-plot statistics (A14), top / latest rows
(O3-O6) and the NULL -> 0, 2-decimal display form (C17, C18, F7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import missing_to_zero, total
from ..operators.asof import asof_join, day_buckets
from ..operators.reshape import pivot_fixed
from ..operators.select import grouped_quantiles
from ..sources import catalog as cat
from ..plans import analytics as an

# Heat-map column labels of the reference chart (fixed values).
MONTH_LABELS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun",
                "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def region_month_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue per region (rows) and calendar month (12 named columns).

    Months are given explicitly, so an absent month is a NULL column, not a
    missing one. Aggregated to (region_id, month) before the pivot.
    """
    o = cat.order_totals(spark, sf_dir, with_region=True)
    rm = o.groupBy("region_id", F.month("date").alias("m")).agg(F.sum("revenue").alias("revenue"))
    r = cat.regions(spark, sf_dir).select(F.col("id").alias("region_id"), "region")
    rm = rm.join(F.broadcast(r), "region_id", "left")   # 25 rows: proven bound
    wide = pivot_fixed(rm, ["region"], "m", {i + 1: m for i, m in enumerate(MONTH_LABELS)},
                       lambda c: total(F.sum(c)), "revenue")
    return wide.orderBy("region")


def category_values(spark: SparkSession, sf_dir: str, measure: str = "revenue") -> DataFrame:
    """(category, order_id, product_id, date, <measure>, v): lines by product
    category, those without a value left out."""
    s = cat.sales(spark, sf_dir).select("date", "order_id", "product_id", measure).na.drop(subset=[measure])
    p = cat.products(spark, sf_dir).select(F.col("id").alias("product_id"), "category")
    return s.join(p, "product_id").withColumn("v", F.col(measure).cast("double"))


def box_stats_raw(values: DataFrame, group: str = "category", value: str = "v") -> DataFrame:
    """Exact quartiles (linear interpolation), 1.5 IQR fences, whiskers and
    outlier counts per group, unrounded.

    Quartiles come from a selection (``operators.select``): no sort and no
    write of the rows. Whiskers and outlier counts are one more combinable
    aggregate. ``group`` is a dimension-sized key (here: product category):
    the per-group statistics are broadcast back to the rows.
    """
    quart = (grouped_quantiles(values, group, value, (0.25, 0.5, 0.75))
             .select(group, "n", *[F.get("q", F.lit(i)).alias(c) for i, c in enumerate(("q1", "median", "q3"))])
             .withColumn("iqr", F.col("q3") - F.col("q1"))
             .withColumn("lower_fence", F.col("q1") - F.lit(1.5) * F.col("iqr"))
             .withColumn("upper_fence", F.col("q3") + F.lit(1.5) * F.col("iqr")))
    v = F.col(value)
    inside_lo = v >= F.col("lower_fence")
    inside_hi = v <= F.col("upper_fence")
    # One row per group: broadcast is bounded by the number of groups.
    fences = quart.select(F.col(group).alias("_g"), "lower_fence", "upper_fence")
    wh = (values.join(F.broadcast(fences), F.col(group).eqNullSafe(F.col("_g")))
          .groupBy("_g").agg(F.min(F.when(inside_lo, v)).alias("whisker_low"),
                             F.max(F.when(inside_hi, v)).alias("whisker_high"),
                             F.count_if(~(inside_lo & inside_hi)).alias("n_outliers")))
    return quart.join(wh, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


BOX_COLUMNS = ("q1", "median", "q3", "iqr", "lower_fence", "upper_fence",
               "whisker_low", "whisker_high")


def category_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14 table: the numbers a box plot of line revenue by category draws."""
    b = box_stats_raw(category_values(spark, sf_dir))
    return b.select("category", "n", *[F.round(c, 4).alias(c) for c in BOX_COLUMNS],
                    "n_outliers").orderBy("category")


def category_outliers(spark: SparkSession, sf_dir: str, measure: str = "profit") -> DataFrame:
    """A14 outlier rows: lines whose profit (a skewed measure) lies outside
    their category's fences."""
    values = category_values(spark, sf_dir, measure)
    # fences are one row per category
    fences = box_stats_raw(values).select("category", "lower_fence", "upper_fence")
    j = values.join(F.broadcast(fences), "category")
    out = j.filter((F.col("v") < F.col("lower_fence")) | (F.col("v") > F.col("upper_fence")))
    return out.select("category", "date", "order_id", "product_id", measure).orderBy(
        "category", measure, "date", "order_id", "product_id")


# ---------------------------------------------------------------------------
# Sort / limit
# ---------------------------------------------------------------------------
def latest_100(spark: SparkSession, sf_dir: str, n: int = 100) -> DataFrame:
    """The most recent ``n`` sales rows with macro context (the reference's
    guaranteed fallback). Top-k is distributed (per-partition top n, merged);
    every output column is in the order, so ties cannot change the result."""
    s = cat.sales(spark, sf_dir).select("date", "order_id", "product_id", "quantity", "revenue", "profit")
    mi = cat.macro_indicators(spark, sf_dir).select("date", "usd_inr", "inflation_india", "interest_india")
    order = [F.col(c).desc_nulls_last() for c in ("date", "order_id", "product_id", "quantity",
                                                  "revenue", "profit")]
    # The rows first: macro has one row per day, so the join adds none.
    return s.orderBy(*order).limit(n).join(F.broadcast(mi), "date", "left").orderBy(*order)


def first_15(spark: SparkSession, sf_dir: str, n: int = 15) -> DataFrame:
    """O3: first ``n`` rows of the daily series in date order."""
    return an.daily_sales(spark, sf_dir).orderBy("date").limit(n)


def latest_per_ticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last quote per ticker (``max_by`` aggregates partially)."""
    sp = cat.stock_prices(spark, sf_dir)
    return (sp.groupBy("ticker")
              .agg(F.max("date").alias("date"),
                   F.max_by("close", "date").alias("close"),
                   F.max_by("volume", "date").alias("volume"))
              .orderBy("ticker"))


def null_to_zero_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C17 + C18 + F7: the stock dashboard rows as served: NULL -> 0, money
    rounded to 2 decimals (exact decimal rounding, half up)."""
    d = an.stock_sales_daily(spark, sf_dir, "NVDA")
    return d.select(
        "date",
        F.round(F.coalesce("total_revenue", F.lit(0)), 2).cast("decimal(38,2)").alias("total_revenue"),
        F.round(missing_to_zero("stock_close").cast("decimal(18,4)"), 2).cast("decimal(38,2)")
         .alias("stock_close"),
        F.coalesce("stock_volume", F.lit(0)).cast("decimal(38,4)").alias("stock_volume"),
    ).orderBy("date")


def price_at_sale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a quoted brand's product with the price known at its sale:
    the latest quote of its ticker up to the order's day (none before the first)."""
    s = cat.sales(spark, sf_dir).select("order_id", "product_id", "date")
    brands = cat.quoted_products(spark, sf_dir)
    lines = s.join(brands, "product_id").select("order_id", "product_id", "date", "ticker")
    quotes = cat.stock_prices(spark, sf_dir).select("ticker", F.col("date").alias("quote_date"), "close")
    out = asof_join(lines, quotes, ["ticker"], "date", "quote_date", day_buckets(30))
    return out.select("order_id", "product_id", "date", "ticker", "match.quote_date", "match.close")
