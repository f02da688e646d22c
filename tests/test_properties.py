"""Properties on the real test data: no fan-out, pivots preserve totals,
splits partition the rows, forward fill never rewrites a known value."""

from pyspark.sql import functions as F

from marketweave.plans import analytics as an
from marketweave.plans import reports as rp
from marketweave.plans import timeseries as ts
from marketweave.sources import catalog as cat
from conftest import SF001


def _fact_total(spark):
    return cat.sales(spark, SF001).agg(F.sum("revenue")).first()[0]


def test_preaggregated_totals_equal_fact_total(spark):
    total = _fact_total(spark)
    assert cat.daily_totals(spark, SF001).agg(F.sum("revenue")).first()[0] == total
    assert an.monthly_sales(spark, SF001).agg(F.sum("total_revenue")).first()[0] == total
    assert an.macro_sales_trend(spark, SF001).agg(F.sum("total_revenue")).first()[0] == total
    assert ts.region_daily(spark, SF001).agg(F.sum("sales")).first()[0] == total


def test_region_month_pivot_preserves_total(spark):
    wide = rp.region_month_pivot(spark, SF001)
    s = sum((r[m] or 0) for r in wide.collect() for m in rp.MONTH_LABELS)
    assert s == _fact_total(spark)


def test_holiday_summary_counts_match_fact(spark):
    h = an.holiday_sales_summary(spark, SF001)
    days = cat.holidays(spark, (1995, 2002)).select("date").distinct()
    n = cat.sales(spark, SF001).join(days, "date", "left_semi").count()
    # each holiday date appears once in the calendar templates
    assert h.agg(F.sum("num_transactions")).first()[0] == n


def test_ffill_never_changes_known_values(spark):
    raw = ts.stock_close_wide(spark, SF001)
    filled = ts.ffill_stock_daily(spark, SF001)
    j = raw.join(filled, "date").filter(
        (raw.nvidia_close.isNotNull() & (raw.nvidia_close != filled.nvidia_close)) |
        (raw.samsung_close.isNotNull() & (raw.samsung_close != filled.samsung_close)))
    assert j.count() == 0


def test_order_split_partitions_all_rows(spark):
    from marketweave.plans.features import order_split
    s = order_split(spark, SF001)
    n = s.count()
    assert s.filter("is_test = 1").count() + s.filter("is_test = 0").count() == n
    assert s.agg(F.countDistinct("row_rank")).first()[0] == n


def test_results_do_not_depend_on_session_time_zone(spark):
    from marketweave.plans import ingest
    from marketweave.plans.smart_query import smart_query

    def snapshot():
        a = sorted(tuple(r) for r in ingest.sales_clean(spark, SF001).groupBy("date").count().collect())
        b = smart_query(spark, SF001, date_start="1997-01-01", date_end="1997-12-31").count()
        return a, b

    base = snapshot()
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
        assert snapshot() == base
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        assert snapshot() == base
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
