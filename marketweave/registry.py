"""Query registry: name -> callable(spark, sf_dir) -> DataFrame.

Each key is one operator family of the reference re-expressed as a Spark
job over the given tables; ``oracle.QUERIES`` holds the matching SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracle
from .sources import tables as tb
from .plans import analytics as an
from .plans import smart_query as sq
from .plans import timeseries as ts
from .plans import reports as rp
from .plans import ingest as ig
from .plans import requests as rq
from .plans import quality_checks as qc
from .plans import features as fe
from .plans import model as ml
from .plans import forecast as fc
from .plans import endpoints as ep

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {
    "holiday_sales_summary": lambda s, d: an.holiday_sales_summary(s, d),
    "holiday_sales_filtered": lambda s, d: an.holiday_sales_summary(s, d, holiday="diwali"),
    "daily_sales": an.daily_sales,
    "monthly_sales": an.monthly_sales,
    "stock_sales_daily": lambda s, d: an.stock_sales_daily(s, d, "NVDA"),
    "stock_sales_corr": lambda s, d: an.stock_sales_corr(s, d, "NVDA"),
    "commodity_impact": lambda s, d: an.commodity_impact(s, d, "Copper", "end_product"),
    "macro_sales_trend": an.macro_sales_trend,
    "calendar_features": ts.calendar_features,
    "lag_rolling_features": ts.lag_rolling_features,
    "lag_rolling_by_region": ts.lag_rolling_by_region,
    "ffill_stock_daily": ts.ffill_stock_daily,
    "gapfill_commodity_daily": ts.gapfill_commodity_daily,
    "commodity_pivot": ts.commodity_wide,
    "annual_to_daily": ts.annual_to_daily,
    "annual_extend": ts.annual_extend,
    "linear_extrapolate": ts.linear_extrapolate,
    "unpivot_years": ts.unpivot_years,
    "region_month_pivot": rp.region_month_pivot,
    "category_distribution": rp.category_distribution,
    "category_outliers": rp.category_outliers,
    "latest_100": rp.latest_100,
    "first_15": rp.first_15,
    "latest_per_ticker": rp.latest_per_ticker,
    "null_to_zero_rounded": rp.null_to_zero_rounded,
    "price_at_sale": rp.price_at_sale,
    "sales_clean": ig.sales_clean,
    "null_profile": ig.null_profile,
    "sales_loaded": ig.sales_loaded,
    "nation_orders": tb.nation_orders,
    "product_catalog": ig.product_catalog,
    "commodity_tagging": ig.commodity_tagging,
    "duplicate_keys": qc.duplicate_line_keys,
    "orphan_keys": qc.orphan_keys,
    "request_validation": rq.request_validation,
    "context_fallback": rq.context_fallback,
    "one_hot": fe.one_hot_lines,
    "train_test_split": fe.order_split,
    "feature_table": fe.feature_table,
    "holiday_analytics": ep.holiday_analytics,
    "commodity_analytics": lambda s, d: ep.commodity_analytics(s, d, "Copper"),
    "macro_analytics": ep.macro_analytics,
    "stock_analytics": lambda s, d: ep.stock_analytics(s, d, "nvda"),
    # Model fits and forecasts. Single predictions have no SQL; their inputs,
    # splits, mean error and optimality conditions have (split_sizes, ols_mae,
    # score_features, ols_optimality, forecast_frame, forecast_balance).
    "ols_predict": ml.ols_predict,
    "ols_mae": ml.ols_mae,
    "ols_optimality": ml.ols_optimality,
    "split_sizes": ml.split_sizes,
    "score_features": ml.score_features,
    "score_requests": ml.score_requests,
    "forecast_frame": lambda s, d: fc.forecast_frame(s, d, 90),
    "forecast_balance": lambda s, d: fc.forecast_balance(s, d, 90),
    "forecast_90d": lambda s, d: fc.forecast(s, d, 90),
    "forecast_components": lambda s, d: fc.forecast_components(s, d, 90),
    "forecast_by_region": lambda s, d: fc.forecast_by_region(s, d, 90),
}

for _name, _args in oracle.SMART_CASES.items():
    QUERIES[_name] = (lambda a: lambda s, d: sq.smart_query(s, d, **a))(_args)

FLAGSHIP = "holiday_sales_summary"
