"""One regression test per divergence rule (D1-D10, D12): asserts *our* rule."""

from decimal import Decimal

from pyspark.sql import functions as F

from marketweave.plans import analytics as an
from marketweave.plans import requests as rq
from marketweave.plans import timeseries as ts
from marketweave.plans.smart_query import smart_query
from marketweave.sources import catalog as cat
from conftest import SF001


def test_d1_state_filters_and_returns_state(spark):
    df = smart_query(spark, SF001, state="nation_3")
    states = {r.state for r in df.select("state").distinct().collect()}
    assert states == {"NATION_3"}
    s = cat.sales(spark, SF001, with_region=True).filter("region_id = 3").count()
    assert df.count() == s


def test_d2_holiday_and_commodity_bind_by_name(spark):
    both = smart_query(spark, SF001, holiday="Christmas", commodity="copper")
    hol = smart_query(spark, SF001, holiday="Christmas")
    # Copper is one commodity per month: the left join neither drops nor multiplies rows.
    assert both.count() == hol.count()
    assert both.filter(F.col("holiday_name") != "Christmas Day").count() == 0


def test_d3_date_end_inclusive(spark):
    last = cat.sales(spark, SF001).agg(F.max("date")).first()[0]
    df = smart_query(spark, SF001, date_start=str(last), date_end=str(last))
    assert df.count() > 0 and df.filter(F.col("date") != F.lit(last)).count() == 0


def test_d4_api_category_maps_to_stored(spark):
    v = rq.valid_requests(spark, SF001).select("category", "cat_stored").distinct().collect()
    m = {r.category: r.cat_stored for r in v}
    assert m.get("Electronics") == "end_product" and m.get("Accessories") == "component"


def test_d5_no_fan_out_in_totals(spark):
    imp = an.commodity_impact(spark, SF001, "a", "end_product")   # 'a' matches several names
    p = cat.products(spark, SF001).filter("category = 'end_product'")
    total = cat.sales(spark, SF001).join(p, F.col("product_id") == F.col("id")).agg(F.sum("revenue")).first()[0]
    assert imp.agg(F.sum("total_revenue")).first()[0] == total
    daily = an.stock_sales_daily(spark, SF001)
    assert daily.agg(F.sum("total_revenue")).first()[0] == cat.sales(spark, SF001).agg(F.sum("revenue")).first()[0]


def test_d6_level4_takes_most_recent(spark):
    ctx = rq.context_fallback(spark, SF001).filter("level_used = 4")
    last = cat.sales(spark, SF001).agg(F.max("date")).first()[0]
    assert ctx.filter(F.col("context_date") != F.lit(last)).count() == 0 < ctx.count()


def test_d7_ticker_upper_cased_once(spark):
    lower = smart_query(spark, SF001, ticker="nvda").filter("stock_close IS NOT NULL").count()
    upper = smart_query(spark, SF001, ticker="NVDA").filter("stock_close IS NOT NULL").count()
    assert lower == upper > 0


def test_d8_dates_compared_as_dates(spark):
    req = spark.createDataFrame([(1, "2001-10-01"), (2, "2001-9-30"), (3, "2001-09-30")], "request_id long, date string")
    for c in ("state", "region", "holiday", "ticker", "commodity", "category"):
        req = req.withColumn(c, F.lit(None).cast("string"))
    req = req.withColumn("year", F.lit(None).cast("int"))
    out = {r.request_id: r.errors for r in rq.validate_requests(req, "2001-09-30", (1995, 2001)).collect()}
    assert out[1] == ["date_range"] and out[3] == []


def test_d9_scoring_uses_market_values(spark):
    from marketweave.plans import model as ml
    cols = ml.model_columns(spark, SF001)
    f = ml.request_features(spark, SF001, cols)
    assert f.filter("inflation_india > 0 AND price_copper > 0").count() == f.count() > 0


def test_d10_orderings_are_total(spark):
    a = [tuple(r) for r in an.holiday_sales_summary(spark, SF001).collect()]
    b = [tuple(r) for r in an.holiday_sales_summary(spark, SF001).collect()]
    assert a == b


def test_d12_lags_are_on_daily_totals(spark):
    f = ts.lag_rolling_features(spark, SF001).orderBy("date").collect()
    assert f[7].sales_lag_7 == f[0].sales
    assert isinstance(f[0].sales, Decimal)
