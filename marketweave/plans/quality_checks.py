"""Registered data-quality jobs (V2, V3) over the input and conformed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality as Q
from ..sources import catalog as cat
from ..sources.tables import read_table


def duplicate_line_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: (l_orderkey, l_linenumber) is declared as a key but repeats."""
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber")
    return Q.duplicate_keys(li.select(F.col("l_orderkey").alias("order_id"),
                                      F.col("l_linenumber").alias("line_number")),
                            ["order_id", "line_number"])


def orphan_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2 + V3: one row per expectation with its violation count."""
    r = lambda t, *c: read_table(spark, sf_dir, t, *c)
    checks = [
        Q.count_check("lineitem.l_partkey -> part",
                      Q.orphans(r("lineitem", "l_partkey"), "l_partkey", r("part", "p_partkey"), "p_partkey")),
        Q.count_check("lineitem.l_orderkey -> orders",
                      Q.orphans(r("lineitem", "l_orderkey"), "l_orderkey", r("orders", "o_orderkey"), "o_orderkey")),
        Q.count_check("orders.o_custkey -> customer",
                      Q.orphans(r("orders", "o_custkey"), "o_custkey", r("customer", "c_custkey"), "c_custkey")),
        Q.count_check("customer.c_nationkey -> nation",
                      Q.orphans(r("customer", "c_nationkey"), "c_nationkey", r("nation", "n_nationkey"),
                                "n_nationkey")),
        Q.not_null_check("sales not null (date, product_id, revenue)",
                         cat.sales(spark, sf_dir), ["date", "product_id", "revenue"]),
        Q.count_check("lineitem unique (order, line)",
                      Q.duplicate_keys(r("lineitem", "l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])),
        Q.count_check("part unique (name)", Q.duplicate_keys(r("part", "p_name"), ["p_name"])),
        Q.count_check("events.user_id -> customer",
                      Q.orphans(r("events", "user_id"), "user_id", r("customer", "c_custkey"), "c_custkey")),
    ]
    return reduce(DataFrame.unionByName, checks)
