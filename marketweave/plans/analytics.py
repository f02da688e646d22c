"""Fixed analytics of the reference (A1-A5, A9, A13), pre-aggregated.

Every series is brought to its join grain *before* it meets the fact, so a
day or month that matches several series rows can never multiply a sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import month_key
from ..functions.exprs import contains_ci, ratio, total
from ..session import materialize
from ..sources import catalog as cat


def holiday_sales_summary(spark: SparkSession, sf_dir: str, holiday: str | None = None) -> DataFrame:
    """A2: per (holiday, date): is_public, matched line count and sums.

    Holidays with no sale are kept (left join from the holiday side). The
    holiday dates (a bounded calendar) are broadcast and semi-joined into
    orders first, so only orders on holiday dates meet lineitem.
    """
    h = cat.sales_holidays(spark, sf_dir)
    if holiday:
        h = h.filter(contains_ci("name", holiday))
    days = h.select("date").distinct()
    # Orders of holiday dates first; lineitem is reduced to their keys before
    # it is aggregated (a semi-join pushed below the shuffle by its filter).
    orders = (cat._orders(spark, sf_dir).join(F.broadcast(days), "date", "left_semi")
              .select(F.col("o_orderkey").alias("l_orderkey"), "date"))
    per_day = (cat._lines(spark, sf_dir).join(orders, "l_orderkey")
               .groupBy("date").agg(F.count(F.lit(1)).alias("n_lines"),
                                    F.sum("quantity").alias("quantity"),
                                    F.sum("revenue").alias("revenue"),
                                    F.sum("profit").alias("profit")))
    out = (h.join(per_day, "date", "left")
            .groupBy(F.col("name").alias("holiday"), "date")
            .agg(F.max("is_public").alias("is_public"),
                 F.coalesce(F.sum("n_lines"), F.lit(0)).cast("long").alias("num_transactions"),
                 total(F.sum("quantity")).alias("total_quantity"),
                 total(F.sum("revenue")).alias("total_revenue"),
                 total(F.sum("profit")).alias("total_profit")))
    return out.orderBy(F.col("total_revenue").desc_nulls_last(), "holiday", "date")


def daily_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: per day line count and sums of quantity, revenue, profit."""
    d = cat.daily_totals(spark, sf_dir)
    return d.select("date", F.col("n_lines").alias("num_transactions"),
                    F.col("quantity").alias("total_quantity"),
                    F.col("revenue").alias("total_revenue"),
                    F.col("profit").alias("total_profit")).orderBy("date")


def monthly_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly revenue total ('yyyy-MM')."""
    d = cat.daily_totals(spark, sf_dir)
    return (d.groupBy(month_key("date").alias("month"))
             .agg(total(F.sum("revenue")).alias("total_revenue"),
                  F.sum("n_lines").alias("num_transactions"))
             .orderBy("month"))


def stock_sales_daily(spark: SparkSession, sf_dir: str, ticker: str = "NVDA") -> DataFrame:
    """A3: daily revenue next to the ticker's close and volume (left join).

    The ticker predicate sits on the stock side (the reference puts it in ON),
    so days without a quote keep NULLs.
    """
    d = cat.daily_totals(spark, sf_dir)
    sp = (cat.stock_prices(spark, sf_dir, tickers=[ticker.upper()])
          .select("date", F.col("close").alias("stock_close"),
                  F.col("volume").alias("stock_volume")))
    return (d.join(F.broadcast(sp), "date", "left")   # one row per day
             .select("date", F.col("revenue").alias("total_revenue"), "stock_close", "stock_volume")
             .orderBy("date"))


def stock_sales_corr(spark: SparkSession, sf_dir: str, ticker: str = "NVDA") -> DataFrame:
    """Pearson correlation of daily revenue and close over complete pairs."""
    s = stock_sales_daily(spark, sf_dir, ticker).na.drop(subset=["total_revenue", "stock_close"])
    return s.agg(
        F.lit(ticker.upper()).alias("ticker"),
        F.count(F.lit(1)).alias("n_pairs"),
        F.round(F.corr(F.col("total_revenue").cast("double"), F.col("stock_close")), 6).alias("pearson_r"),
    )


def commodity_code_for(commodities: DataFrame, pattern: str) -> DataFrame:
    """The code of the first commodity whose name matches (deterministic: min)."""
    return (commodities.filter(contains_ci("commodity_name", pattern))
            .agg(F.min("commodity_code").alias("commodity_code")))


def commodity_impact(spark: SparkSession, sf_dir: str, commodity: str = "Copper",
                     category: str = "end_product") -> DataFrame:
    """A4: monthly revenue of a product category vs one commodity's price.

    Revenue is summed per month before the join and the commodity side is
    averaged per month, so the join is 1:1 (D5).
    """
    # Months x commodities (bounded) and read twice (code lookup, prices):
    # written once so the fact-derived series is computed once.
    cp = materialize(cat.commodity_prices(spark, sf_dir, names=cat.commodity_names(commodity)), "commodity_prices")
    code = commodity_code_for(cp, commodity)
    cp_month = (cp.join(code, "commodity_code", "left_semi")
                .groupBy(month_key("date").alias("month"))
                .agg(ratio(F.sum("price_usd"), F.count("price_usd"), 4).alias("avg_commodity_price"),
                     F.round(F.avg("price_yoy_pct"), 4).alias("commodity_yoy_pct")))
    p = cat.products(spark, sf_dir).filter(F.col("category") == category).select("id", "category")
    s = cat.sales(spark, sf_dir).select("date", "product_id", "revenue")
    rev = (s.join(p, s.product_id == p.id)
            .groupBy(month_key("date").alias("month"), "category")
            .agg(total(F.sum("revenue")).alias("total_revenue")))
    return (rev.join(cp_month, "month", "left")
               .select("month", "category", "total_revenue", "avg_commodity_price", "commodity_yoy_pct")
               .orderBy("month"))


def macro_sales_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: day totals -> left join daily macro (weekend NULLs kept, D11) -> month."""
    d = cat.daily_totals(spark, sf_dir).select("date", "revenue")
    mi = cat.macro_indicators(spark, sf_dir).select("date", "usd_inr", "inflation_india", "interest_india")
    j = d.join(F.broadcast(mi), "date", "left")   # one row per day
    return (j.groupBy(month_key("date").alias("month"))
             .agg(total(F.sum("revenue")).alias("total_revenue"),
                  ratio(F.sum("usd_inr"), F.count("usd_inr"), 4).alias("avg_usd_inr"),
                  ratio(F.sum("inflation_india"), F.count("inflation_india"), 4).alias("inflation"),
                  ratio(F.sum("interest_india"), F.count("interest_india"), 4).alias("interest_rate"))
             .orderBy("month"))
