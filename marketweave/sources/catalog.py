"""Conformed tables of the retail / market model, derived from the input tables.

The reference loads eight tables from files (products, regions, holidays,
sales, stock_prices, commodity_prices, macro_indicators, lithium / annual
series). Here each is a lazy DataFrame derived from the TPC-H-like inputs, so
every query's work grows with the data:

* ``sales``            lineitem x orders (x customer only when a region is asked for)
* ``products``         part
* ``regions``          nation x region
* ``holidays``         a fixed holiday calendar expanded over the years of sales and horizon
* ``stock_prices``     per (ship day, ticker) extremes of three part brands
* ``commodity_prices`` per (ship month, part type) average unit price
* ``macro_indicators`` per order day highest order price + annual series
* annual series        per order year counts (World-Bank-like yearly values)

Scale notes: the fact (``sales``) is never materialised whole by a query; the
daily / order grain pre-aggregations below are what the analytics use. The
series tables are bounded by the calendar (days x tickers, months x types,
years), not by the fact size.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import month_start, ts_day_range, to_day
from ..functions.exprs import MONEY, money, ratio, tag_by_lists
from ..session import materialize
from .tables import read_table

# ---------------------------------------------------------------------------
# Fixed values (test-data conventions and the reference's lookup lists).
# ---------------------------------------------------------------------------
# Holiday calendar templates: (month, day, name, is_public).
HOLIDAY_TEMPLATES = [
    (1, 1, "New Year", 1),
    (8, 15, "Independence Day", 1),
    (11, 12, "Diwali (Deepavali)", 0),
    (12, 25, "Christmas Day", 1),
]
# Days after the last sale that calendars and yearly series reach (the
# longest forecast).
HORIZON_DAYS = 365

# Part type -> stored product category.
PRODUCT_CATEGORY = {
    "ECONOMY": "end_product",
    "STANDARD": "end_product",
    "SMALL": "component",
    "PROMO": "raw_material",
}
PRODUCT_CATEGORY_DEFAULT = "end_product"

# Part brand -> stock ticker.
BRAND_TICKER = {"Brand#1": "NVDA", "Brand#2": "SAMSUNG", "Brand#3": "SONY"}

# Part type -> commodity name.
TYPE_COMMODITY = {
    "ECONOMY": "Aluminum",
    "LARGE": "Copper",
    "MEDIUM": "Nickel",
    "PROMO": "Crude oil, Brent",
    "SMALL": "Natural gas, US",
    "STANDARD": "Tin",
}

# Commodity relevance lists of the reference loader.
ELECTRONICS_MATERIALS = ["Aluminum", "Copper", "Nickel", "Tin", "Silver",
                         "Gold", "Platinum", "Lithium"]
ENERGY = ["Crude oil, Brent", "Crude oil, WTI", "Natural gas, US",
          "Coal, Australian"]


def _case(c, mapping, default=None):
    expr = None
    for k, v in mapping.items():
        expr = F.when(F.col(c) == k, v) if expr is None else expr.when(F.col(c) == k, v)
    return expr.otherwise(F.lit(default)) if default is not None else expr


# ---------------------------------------------------------------------------
# Dimensions
# ---------------------------------------------------------------------------
def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """products(id, name, category)."""
    return read_table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type").select(
        F.col("p_partkey").alias("id"),
        F.concat(F.col("p_name"), F.lit(" #"), F.col("p_partkey").cast("string")).alias("name"),
        _case("p_type", PRODUCT_CATEGORY, PRODUCT_CATEGORY_DEFAULT).alias("category"),
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """regions(id, state, region): nation x region (25 x 5 rows, bounded)."""
    n = read_table(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    r = read_table(spark, sf_dir, "region", "r_regionkey", "r_name")
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("state"),
        F.col("r_name").alias("region"))


def sales_span(spark: SparkSession, sf_dir: str) -> tuple[date, date] | None:
    """First and last sales day (one aggregate row), None without sales."""
    r = read_table(spark, sf_dir, "orders", "o_orderdate").agg(
        to_day(F.min("o_orderdate")).alias("first"), to_day(F.max("o_orderdate")).alias("last")).first()
    return (r["first"], r["last"]) if r["first"] is not None else None


def holidays(spark: SparkSession, years: tuple[int, int]) -> DataFrame:
    """holidays(name, date, is_public, country, weekday) of the years, both included.

    Size is templates x years (a calendar, bounded), so joins may broadcast it.
    """
    t = spark.createDataFrame(HOLIDAY_TEMPLATES, "m int, d int, name string, is_public int")
    t = t.withColumn("year", F.explode(F.sequence(F.lit(years[0]), F.lit(years[1]))))
    day = F.make_date("year", "m", "d")
    return t.select(
        "name", day.alias("date"), F.col("is_public").cast("int").alias("is_public"),
        F.lit("India").alias("country"), F.date_format(day, "EEEE").alias("weekday"))


def sales_holidays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The holidays of every year that has sales or lies within the horizon."""
    span = sales_span(spark, sf_dir)
    if span is None:
        return holidays(spark, (1970, 1970)).limit(0)
    return holidays(spark, (span[0].year, (span[1] + timedelta(days=HORIZON_DAYS)).year))


# ---------------------------------------------------------------------------
# Sales fact
# ---------------------------------------------------------------------------
def _lines(spark, sf_dir) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_quantity",
                    "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    price = money("l_extendedprice")
    return li.select(
        "l_orderkey",
        F.col("l_partkey").alias("product_id"),
        money("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / F.nullif(F.col("l_quantity"), F.lit(0.0))).alias("unit_price"),
        (price * (F.lit(1) - money("l_discount"))).cast(MONEY).alias("revenue"),
        F.when(F.col("l_returnflag") == "R", F.lit(None).cast(MONEY))
         .otherwise((price * money("l_tax")).cast(MONEY)).alias("profit"),
        F.when(F.col("l_linestatus") == "O", "ecommerce").otherwise("updated_sales").alias("source"),
    )


def _orders(spark, sf_dir, date_start=None, date_end=None, with_cust=False) -> DataFrame:
    cols = ["o_orderkey", "o_orderdate"] + (["o_custkey"] if with_cust else [])
    o = read_table(spark, sf_dir, "orders", *cols)
    rng = ts_day_range("o_orderdate", date_start, date_end)
    if rng is not None:
        o = o.filter(rng)
    return o.withColumn("date", to_day("o_orderdate"))


def _attach_region(spark, sf_dir, df: DataFrame, key: str = "o_custkey") -> DataFrame:
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    return df.join(c, df[key] == c.c_custkey, "left").withColumn(
        "region_id", F.col("c_nationkey").cast("long"))


def sales(spark: SparkSession, sf_dir: str, *, with_region: bool = False,
          date_start=None, date_end=None) -> DataFrame:
    """sales(date, order_id, product_id, [region_id], quantity, unit_price,
    revenue, profit, source) at line grain.

    Date bounds are applied to the stored order timestamp so they reach the
    Parquet scan; the runtime Bloom filter then trims lineitem before the join
    shuffle. The customer join (for ``region_id``) is added only on request.
    """
    o = _orders(spark, sf_dir, date_start, date_end, with_cust=with_region)
    if with_region:
        o = _attach_region(spark, sf_dir, o)
    li = _lines(spark, sf_dir)
    out = li.join(o, li.l_orderkey == o.o_orderkey)
    cols = ["date", F.col("l_orderkey").alias("order_id"), "product_id"]
    if with_region:
        cols.append("region_id")
    cols += ["quantity", "unit_price", "revenue", "profit", "source"]
    return out.select(*cols)


def order_totals(spark: SparkSession, sf_dir: str, *, date_start=None, date_end=None,
                 with_region: bool = False) -> DataFrame:
    """Sales pre-aggregated to the order grain, with the order's day.

    lineitem is aggregated per ``l_orderkey`` first: lines of one order sit
    together in the files, so the map-side partial aggregate shrinks the
    shuffle ~4x, and the join with orders reuses that hash partitioning
    instead of shuffling line rows.
    """
    li = _lines(spark, sf_dir).groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum("quantity").alias("quantity"),
        F.sum("revenue").alias("revenue"),
        F.sum("profit").alias("profit"),
    )
    o = _orders(spark, sf_dir, date_start, date_end, with_cust=with_region)
    if with_region:
        o = _attach_region(spark, sf_dir, o)
    out = li.join(o, li.l_orderkey == o.o_orderkey)
    cols = ["date", F.col("l_orderkey").alias("order_id")]
    if with_region:
        cols.append("region_id")
    return out.select(*cols, "n_lines", "quantity", "revenue", "profit")


def daily_totals(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    """A1 base: (date, n_lines, quantity, revenue, profit) per sales day."""
    return (order_totals(spark, sf_dir, **kw).groupBy("date").agg(
        F.sum("n_lines").alias("n_lines"),
        F.sum("quantity").cast("decimal(38,4)").alias("quantity"),
        F.sum("revenue").cast("decimal(38,4)").alias("revenue"),
        F.sum("profit").cast("decimal(38,4)").alias("profit"),
    ))


# ---------------------------------------------------------------------------
# Market series
# ---------------------------------------------------------------------------
def line_part_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, p_type, ticker, sp, sq, lo, hi): lineitem x part aggregated to
    ship day x part type x ticker (NULL ticker = not a quoted brand).

    Only for callers that need both market series: it is written once
    (bounded by days x types x tickers) and the fact is joined once. A caller
    of one series passes no base and gets its own filtered plan.
    """
    li = read_table(spark, sf_dir, "lineitem", "l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
    p = read_table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type")
    j = li.join(p, li.l_partkey == p.p_partkey)
    return j.groupBy(to_day("l_shipdate").alias("day"), "p_type", _case("p_brand", BRAND_TICKER).alias("ticker")).agg(
        F.sum(money("l_extendedprice")).alias("sp"), F.sum(money("l_quantity")).alias("sq"),
        F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))


def quoted_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(product_id, ticker): products of the quoted brands."""
    p = read_table(spark, sf_dir, "part", "p_partkey", "p_brand").filter(F.col("p_brand").isin(list(BRAND_TICKER)))
    return p.select(F.col("p_partkey").alias("product_id"), _case("p_brand", BRAND_TICKER).alias("ticker"))


def stock_prices(spark: SparkSession, sf_dir: str, base: DataFrame | None = None,
                 tickers: list[str] | None = None) -> DataFrame:
    """stock_prices(date, ticker, open, high, low, close, volume); unique per (date, ticker).

    ``tickers`` restricts the quoted brands; without a base the restriction
    reaches the part scan.
    """
    brands = {b: t for b, t in BRAND_TICKER.items() if tickers is None or t in tickers}
    if base is not None:
        b = base.filter(F.col("ticker").isin(list(brands.values()))).withColumnRenamed("day", "date")
    else:
        li = read_table(spark, sf_dir, "lineitem", "l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
        p = read_table(spark, sf_dir, "part", "p_partkey", "p_brand").filter(F.col("p_brand").isin(list(brands)))
        b = li.join(p, li.l_partkey == p.p_partkey).select(
            to_day("l_shipdate").alias("date"), _case("p_brand", BRAND_TICKER).alias("ticker"),
            F.col("l_extendedprice").alias("lo"), F.col("l_extendedprice").alias("hi"), money("l_quantity").alias("sq"))
    return b.groupBy("date", "ticker").agg(
        F.min("lo").alias("open"), F.max("hi").alias("high"),
        F.min("lo").alias("low"), F.max("hi").alias("close"),
        F.sum("sq").cast("decimal(38,4)").alias("volume"))


def commodity_names(pattern: str) -> list[str]:
    """Names of the commodities that contain ``pattern``, in any case."""
    return [n for n in TYPE_COMMODITY.values() if pattern.strip().lower() in n.lower()]


def commodity_prices(spark: SparkSession, sf_dir: str, base: DataFrame | None = None,
                     names: list[str] | None = None) -> DataFrame:
    """commodity_prices(date, commodity_name, category, price_usd, unit,
    price_mom_pct, price_yoy_pct, price_12m_avg, price_volatility,
    commodity_code, relevant_for); unique per (month, commodity).

    ``names`` restricts the commodities; without a base the restriction
    reaches the part scan. The per-commodity windows run over one row per
    month (bounded).
    """
    types = [t for t, n in TYPE_COMMODITY.items() if names is None or n in names]
    if base is not None:
        b = base.withColumn("month", month_start("day"))
    else:
        li = read_table(spark, sf_dir, "lineitem", "l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
        p = read_table(spark, sf_dir, "part", "p_partkey", "p_type")
        if names is not None:
            p = p.filter(F.col("p_type").isin(types))
        b = li.join(p, li.l_partkey == p.p_partkey).select(
            month_start(to_day("l_shipdate")).alias("month"), "p_type",
            money("l_extendedprice").alias("sp"), money("l_quantity").alias("sq"))
    if names is not None:
        b = b.filter(F.col("p_type").isin(types))
    monthly = (b.groupBy(F.col("month").alias("date"), "p_type")
               .agg(F.sum("sp").alias("sp"), F.sum("sq").alias("sq")))
    price = ratio("sp", "sq", 4)
    w = Window.partitionBy("p_type").orderBy("date")
    w12 = w.rowsBetween(-11, 0)
    pd_ = F.col("price_usd").cast("double")
    name = _case("p_type", TYPE_COMMODITY)
    out = monthly.select(
        "date", "p_type", name.alias("commodity_name"),
        price.cast(MONEY).alias("price_usd"))
    out = out.select(
        "date", "commodity_name",
        F.when(F.col("commodity_name").isin(ENERGY), "Energy").otherwise("Metals").alias("category"),
        "price_usd",
        F.lit("USD per unit").alias("unit"),
        F.round(F.lit(100.0) * (pd_ / F.lag(pd_, 1).over(w) - F.lit(1.0)), 4).alias("price_mom_pct"),
        F.round(F.lit(100.0) * (pd_ / F.lag(pd_, 12).over(w) - F.lit(1.0)), 4).alias("price_yoy_pct"),
        ratio(F.sum("price_usd").over(w12), F.count("price_usd").over(w12), 4).alias("price_12m_avg"),
        F.round(F.stddev_samp(pd_).over(w12), 4).alias("price_volatility"),
        F.concat(F.lit("C_"), F.col("p_type")).alias("commodity_code"),
        tag_by_lists("commodity_name", [(ELECTRONICS_MATERIALS, "electronics_raw_material"),
                                        (ENERGY, "energy_cost")], "other").alias("relevant_for"),
    )
    return out


def _annual_values() -> dict:
    """Yearly indicators from orders: number of orders, of finished ones, and
    mean price in thousands (a stand-in for a yearly price series)."""
    return {"inflation": F.count(F.lit(1)).cast(MONEY), "interest": F.count_if(F.col("o_orderstatus") == "F").cast(MONEY),
            "lithium": ratio(F.sum(money("o_totalprice")), F.count(F.lit(1)) * 1000, 2).cast(MONEY)}


def annual_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(year, inflation, interest, lithium): all yearly series from one scan,
    one row per year with sales (bounded)."""
    o = read_table(spark, sf_dir, "orders", "o_orderdate", "o_orderstatus", "o_totalprice")
    return o.groupBy(F.year("o_orderdate").alias("year")).agg(*[v.alias(k) for k, v in _annual_values().items()])


def annual_series(spark: SparkSession, sf_dir: str, kind: str = "inflation") -> DataFrame:
    """(year, value): one yearly indicator."""
    return annual_all(spark, sf_dir).select("year", F.col(kind).alias("value"))


def annual_wide(spark: SparkSession, sf_dir: str, kind: str = "inflation") -> DataFrame:
    """One row per country, one column per year with sales: the World-Bank layout."""
    s = materialize(annual_series(spark, sf_dir, kind), "annual")
    years = sorted(r["year"] for r in s.select("year").collect())   # one number per year
    return (s.withColumn("country", F.lit("India"))
            .withColumn("indicator", F.lit(kind))
            .groupBy("country", "indicator")
            .pivot("year", years).agg(F.first("value"))
            .select("country", "indicator", *[F.col(str(y)) for y in years]))


def macro_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """macro_indicators(date, usd_inr, usd_inr_sma7, usd_inr_sma30,
    usd_inr_rsi14, usd_inr_volatility, inflation_india, interest_india).

    Daily (one row per day, bounded by the calendar); the moving statistics
    are row windows over that single daily series.
    """
    o = read_table(spark, sf_dir, "orders", "o_orderdate", "o_totalprice")
    fx = (o.groupBy(to_day("o_orderdate").alias("date"))
          .agg(F.max("o_totalprice").cast("decimal(18,2)").alias("usd_inr")))
    w = Window.orderBy("date")
    w7, w14, w30 = w.rowsBetween(-6, 0), w.rowsBetween(-13, 0), w.rowsBetween(-29, 0)
    x = F.col("usd_inr").cast("double")
    diff = x - F.lag(x, 1).over(w)
    fx = fx.withColumn("_gain", F.greatest(diff, F.lit(0.0))).withColumn(
        "_loss", F.greatest(-diff, F.lit(0.0))).withColumn("_ret", diff / F.lag(x, 1).over(w))
    avg_gain, avg_loss = F.avg("_gain").over(w14), F.avg("_loss").over(w14)
    fx = fx.select(
        "date", "usd_inr",
        ratio(F.sum("usd_inr").over(w7), F.count("usd_inr").over(w7), 4).alias("usd_inr_sma7"),
        ratio(F.sum("usd_inr").over(w30), F.count("usd_inr").over(w30), 4).alias("usd_inr_sma30"),
        F.round(F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + avg_gain / F.nullif(avg_loss, F.lit(0.0))), 4)
         .alias("usd_inr_rsi14"),
        F.round(F.stddev_samp("_ret").over(w30), 6).alias("usd_inr_volatility"),
    )
    fx = fx.withColumn("year", F.year("date"))
    # One row per year, both series from one scan: broadcast is size-bounded.
    yearly = annual_all(spark, sf_dir).select("year", F.col("inflation").alias("inflation_india"), F.col("interest").alias("interest_india"))
    return fx.join(F.broadcast(yearly), "year", "left").drop("year")
