"""Physical-plan checks: broadcasts where a side is calendar-bounded,
pushed filters on date predicates, no single-partition exchange under a
fact-sized input, partial aggregation before the fact join."""

from marketweave.plans import analytics as an
from marketweave.plans import timeseries as ts
from marketweave.plans.smart_query import smart_query
from conftest import SF001


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_holiday_join_broadcasts_calendar(spark):
    p = plan(smart_query(spark, SF001, holiday="Diwali"))
    assert "BroadcastHashJoin" in p


def test_year_filter_reaches_scan(spark):
    df = smart_query(spark, SF001, year=1998)
    p = plan(df)
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in p
    assert "LessThan(o_orderdate" in p


def test_daily_totals_preaggregate_lines_per_order(spark):
    p = plan(an.daily_sales(spark, SF001))
    assert "partial_sum(revenue" in p
    # the line-level partial aggregate sits directly on the lineitem scan side
    assert p.index("partial_count(1)") > p.index("BroadcastHashJoin") or "SortMergeJoin" in p


def test_no_single_partition_below_fact(spark):
    for df in (an.daily_sales(spark, SF001), an.commodity_impact(spark, SF001),
               smart_query(spark, SF001, ticker="NVDA", include_macro=True)):
        p = plan(df)
        # global windows only appear above day-grain aggregates, never on lines
        for line in p.splitlines():
            if "SinglePartition" in line:
                assert "lineitem" not in line


def test_single_series_window_is_on_daily_grain(spark):
    opt = optimized(ts.lag_rolling_features(spark, SF001))
    w = opt.index("Window")
    assert "Aggregate [date" in opt[w:]


def test_columns_pruned_at_scan(spark):
    p = plan(an.monthly_sales(spark, SF001))
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in p
    assert "l_shipdate" not in p


def final_plan(df):
    df.collect()   # runs this DataFrame's own query execution
    return df._jdf.queryExecution().executedPlan().toString()


def test_dimension_and_quote_joins_broadcast_at_runtime(spark):
    # J1 (products), J4 (stock quotes), J7 (macro day): small sides are
    # broadcast once AQE has measured them; the fact is never broadcast.
    df = smart_query(spark, SF001, ticker="NVDA", include_macro=True)
    p = final_plan(df)
    assert "isFinalPlan=true" in p
    assert p.count("BroadcastHashJoin") >= 3
    for line in p.splitlines():
        if "BroadcastExchange" in line:
            assert "lineitem" not in line


def test_built_catalog_prunes_partitions_and_matches(spark, tmp_dir):
    import os
    from marketweave.sources.sinks import build_catalog
    cat_dir = os.path.join(tmp_dir, "catalog")
    build_catalog(spark, SF001, cat_dir)
    args = dict(year=1998, ticker="nvda", commodity="copper", include_macro=True, state="nation_7")
    built = smart_query(spark, catalog_dir=cat_dir, **args)
    p = plan(built)
    assert "PartitionFilters: [isnotnull(year" in p and "(year" in p and "= 1998)" in p
    raw = smart_query(spark, SF001, **args)
    assert sorted(map(tuple, built.collect())) == sorted(map(tuple, raw.collect()))
    rng = dict(date_start="1997-03-01", date_end="1997-04-30", holiday="", category="end_product")
    a = smart_query(spark, catalog_dir=cat_dir, **rng)
    b = smart_query(spark, SF001, **rng)
    assert a.count() == b.count() > 0
