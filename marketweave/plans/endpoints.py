"""The reference's analytics endpoints as batch jobs: each serves one of the
fixed analytics with every numeric NULL replaced by 0 (C17). The HTTP layer
itself is not built; results are DataFrames (``sources.sinks.to_json_records``
gives the record form)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import analytics as an
from .requests import VALID_TICKERS


def _zero_nulls(df: DataFrame) -> DataFrame:
    return df.na.fill(0)


def holiday_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _zero_nulls(an.holiday_sales_summary(spark, sf_dir))


def commodity_analytics(spark: SparkSession, sf_dir: str, commodity: str = "Copper") -> DataFrame:
    return _zero_nulls(an.commodity_impact(spark, sf_dir, commodity, "end_product"))


def macro_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _zero_nulls(an.macro_sales_trend(spark, sf_dir))


def stock_analytics(spark: SparkSession, sf_dir: str, ticker: str = "nvda") -> DataFrame:
    t = ticker.upper()
    if t not in VALID_TICKERS:
        raise ValueError(f"Invalid ticker. Choose from: {VALID_TICKERS}")
    return _zero_nulls(an.stock_sales_daily(spark, sf_dir, t))
