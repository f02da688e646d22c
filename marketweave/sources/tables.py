"""Scans of the given input tables.

Only the columns a caller names are read: every scan goes through
``spark.read.parquet(...).select(...)`` so the Parquet reader gets a pruned
``ReadSchema`` and Catalyst can push filters into it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Declared columns (S7), checked when a table is read: a file whose column
# has another type fails at load, not in the middle of a job.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
                "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
}
TABLES = tuple(SCHEMAS)


def declared(name: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[name])


def check_schema(df: DataFrame, name: str) -> DataFrame:
    """``df`` itself; ValueError naming the columns that are missing or have
    another type than declared (time stamps with or without zone are alike)."""
    found = {k: v.replace("timestamp_ntz", "timestamp") for k, v in df.dtypes}
    wrong = [f"{f.name} {found.get(f.name, 'missing')}, not {f.dataType.simpleString()}" for f in declared(name)
             if found.get(f.name) != f.dataType.simpleString()]
    if wrong:
        raise ValueError(f"table {name}: {'; '.join(wrong)}")
    return df


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """Scan one input table, optionally pruned to ``cols``."""
    df = check_schema(spark.read.parquet(table_path(sf_dir, name)), name)
    return df.select(*cols) if cols else df


def register_views(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Catalog of named inputs as temp views (for ``spark.sql``)."""
    for name in names:
        read_table(spark, sf_dir, name).createOrReplaceTempView(name)


def query(spark: SparkSession, sf_dir: str, text: str, **args) -> DataFrame:
    """SQL over the named inputs; ``:name`` markers take the arguments as
    values (never as SQL text)."""
    register_views(spark, sf_dir)
    return spark.sql(text, args=args)


NATION_ORDERS = """
SELECT n.n_name AS state, year(o.o_orderdate) AS year, count(*) AS n_orders,
       CAST(sum(CAST(o.o_totalprice AS DECIMAL(18,4))) AS DECIMAL(38,4)) AS total
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
WHERE o.o_orderstatus = :status AND o.o_totalprice >= :least
GROUP BY n.n_name, year(o.o_orderdate)
"""


def nation_orders(spark: SparkSession, sf_dir: str, status: str = "F", least: float = 1000.0) -> DataFrame:
    """S6 as a registered query: finished orders by nation and year."""
    return query(spark, sf_dir, NATION_ORDERS, status=status, least=least)
