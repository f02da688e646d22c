"""Sinks (K1, K2, K4, K5): table writes, the query audit log, record output,
and the full catalog build job. K3 (model persistence) lives with the model.
"""

from __future__ import annotations

import json
from typing import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import catalog as cat

LOG_SCHEMA = ("timestamp timestamp, query_type string, conditions string, "
              "tables_used string, rows_returned long")


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                mode: str = "overwrite") -> None:
    """K1: replace (or append to) a Parquet table, optionally partitioned."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def append_query_log(spark: SparkSession, log_path: str, query_type: str, conditions: dict,
                     tables_used: list[str], rows_returned: int) -> None:
    """K2: append one audit row (type, arguments, tables, row count)."""
    row = [(query_type, json.dumps(conditions, sort_keys=True, default=str),
            json.dumps(sorted(set(tables_used))), int(rows_returned))]
    df = spark.createDataFrame(row, "query_type string, conditions string, tables_used string, "
                                    "rows_returned long")
    df.select(F.current_timestamp().alias("timestamp"), "*").write.mode("append").parquet(log_path)


def write_logged(df: DataFrame, out_path: str, log_path: str, query_type: str,
                 conditions: dict, tables_used: list[str]) -> int:
    """Write a query result and log it; the row count is observed during the
    write (no second pass over the result)."""
    obs = Observation("rows")
    df.observe(obs, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(out_path)
    n = int(obs.get["n"])
    append_query_log(df.sparkSession, log_path, query_type, conditions, tables_used, n)
    return n


def to_json_records(df: DataFrame) -> DataFrame:
    """K4: one JSON object per row (``orient='records'`` of the reference)."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("record"))


BUILD: dict[str, tuple[Callable, list[str]]] = {
    "regions": (lambda s, d: cat.regions(s, d), []),
    "holidays": (lambda s, d: cat.sales_holidays(s, d), []),
    "products": (lambda s, d: cat.products(s, d), []),
    "sales": (lambda s, d: cat.sales(s, d, with_region=True).withColumn("year", F.year("date")), ["year"]),
    "stock_prices": (lambda s, d: cat.stock_prices(s, d), []),
    "macro_indicators": (lambda s, d: cat.macro_indicators(s, d), []),
    "commodity_prices": (lambda s, d: cat.commodity_prices(s, d), []),
    "annual_inflation": (lambda s, d: cat.annual_series(s, d, "inflation"), []),
    "annual_interest": (lambda s, d: cat.annual_series(s, d, "interest"), []),
    "annual_lithium": (lambda s, d: cat.annual_series(s, d, "lithium"), []),
}


def build_catalog(spark: SparkSession, sf_dir: str, out_dir: str) -> dict[str, int]:
    """K5: build every conformed table as Parquet (the fact partitioned by
    year for partition pruning) and return row counts, observed while writing."""
    counts = {}
    for name, (fn, parts) in BUILD.items():
        obs = Observation(name)
        df = fn(spark, sf_dir).observe(obs, F.count(F.lit(1)).alias("n"))
        write_table(df, f"{out_dir.rstrip('/')}/{name}", parts)
        counts[name] = int(obs.get["n"])
    return counts
