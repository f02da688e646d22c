"""Ingestion and cleaning jobs (C1-C22, U1-U4, J2) over raw text-typed sales.

The reference reads CSVs whose cells arrive as text: repeated header rows,
non-numeric numbers, blank and mixed-format dates, tz-aware timestamps. Here
the same dirt is derived from the input tables (``raw_updated_sales``,
``raw_ecommerce_sales``) and cleaned with ANSI-safe ``try_*`` functions, so the
cleaning work grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import parse_utc_day
from ..functions.exprs import MONEY, map_values, money, safe_div, try_number
from ..operators.rank import global_rank
from ..operators.reshape import first_per_key, union_by_name
from ..sources import catalog as cat
from ..sources.tables import read_table

# Header labels of the reference's "updated sales" file (fixed values).
HEADER = {"order_date": "Order Date", "product": "Product",
          "quantity_ordered": "Quantity Ordered", "price_each": "Price Each"}

# Date layouts seen in the raw files, tried in order.
DATE_FORMATS = ["yyyy-MM-dd", "MM/dd/yyyy HH:mm", "yyyy-MM-dd HH:mm:ssXXX"]

# Raw e-commerce and API category labels -> stored product category (fixed
# values); anything else becomes the default, or no category in a request.
CATEGORY_MAP = {"electronics": "end_product", "accessories": "component", "office": "end_product"}
CATEGORY_DEFAULT = "end_product"

# Part type -> raw e-commerce category label (test-data convention).
TYPE_LABEL = {"ECONOMY": "Electronics", "STANDARD": "ELECTRONICS", "SMALL": "accessories",
              "MEDIUM": "Office", "LARGE": "Furniture", "PROMO": "Toys"}


def _lines_orders_parts(spark, sf_dir, linestatus: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_quantity",
                    "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"
                    ).filter(F.col("l_linestatus") == linestatus)
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", "o_orderpriority")
    p = read_table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_retailprice")
    return li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)


def raw_updated_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text-typed 'updated sales' rows (finished lines) with the file's dirt."""
    j = _lines_orders_parts(spark, sf_dir, "F")
    pr, rf = F.col("o_orderpriority"), F.col("l_returnflag")
    header = (pr == "5-LOW") & (rf == "R")
    d = F.col("o_orderdate")
    date_txt = (F.when(pr == "2-HIGH", F.date_format(d, "MM/dd/yyyy HH:mm"))
                 .when(pr == "3-MEDIUM", F.concat(F.date_format(d, "yyyy-MM-dd HH:mm:ss"), F.lit("+05:30")))
                 .when((pr == "4-NOT SPECIFIED") & (rf == "N"), F.lit(None).cast("string"))
                 .when((pr == "4-NOT SPECIFIED") & (rf == "A"), F.lit("not a date"))
                 .otherwise(F.date_format(d, "yyyy-MM-dd")))
    qty_txt = F.when((pr == "1-URGENT") & (rf == "R"), F.lit("abc")).otherwise(
        F.col("l_quantity").cast("string"))
    price_txt = F.when((pr == "1-URGENT") & (rf == "N"), F.lit("")).otherwise(
        F.col("p_retailprice").cast("decimal(18,2)").cast("string"))
    cols = {"order_date": date_txt, "product": F.col("p_name"),
            "quantity_ordered": qty_txt, "price_each": price_txt}
    return j.select(*[F.when(header, F.lit(HEADER[k])).otherwise(v).alias(k) for k, v in cols.items()])


def raw_ecommerce_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """'E-commerce' rows (open lines): product name and raw category label."""
    j = _lines_orders_parts(spark, sf_dir, "O")
    label = None
    for k, v in TYPE_LABEL.items():
        label = F.when(F.col("p_type") == k, v) if label is None else label.when(F.col("p_type") == k, v)
    price = money("l_extendedprice")
    return j.select(F.to_date("o_orderdate").alias("order_date"), F.col("p_name").alias("product_name"),
                    label.alias("category"), F.col("l_quantity").alias("quantity"),
                    (price * (F.lit(1) - money("l_discount"))).cast(MONEY).alias("revenue"),
                    F.when(F.col("l_returnflag") != "R", (price * money("l_tax")).cast(MONEY)).alias("profit"))


def parse_updated_sales(raw: DataFrame) -> DataFrame:
    """C4 + C7 + C8/C9 + C14 + C15 + C16 before the NULL-date drop."""
    s = raw.filter(F.col("order_date").isNull() | (F.col("order_date") != HEADER["order_date"]))
    qty = try_number(F.col("quantity_ordered"), "decimal(18,4)")
    price = try_number(F.col("price_each"), "decimal(18,4)")
    return s.select(
        parse_utc_day("order_date", DATE_FORMATS).alias("date"),
        F.col("product"),
        qty.alias("quantity"),
        price.alias("unit_price"),
        (qty * price).cast(MONEY).alias("revenue"),
    )


def sales_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned 'updated sales' rows in the sales-table layout (C6 drops
    rows without a date; constant / NULL columns per C16)."""
    s = parse_updated_sales(raw_updated_sales(spark, sf_dir)).na.drop(subset=["date"])
    return s.select(
        "date", "product", F.lit("end_product").alias("category"), "quantity", "unit_price", "revenue",
        F.lit(None).cast(MONEY).alias("profit"), F.lit(None).cast("long").alias("region_id"),
        F.lit("updated_sales").alias("source"))


def product_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1-U4 + C10-C12: (id, name, category), one row per product name.

    E-commerce names carry a raw label mapped through the category map with
    a default; updated-sales names are all end products. The union keeps one
    row per name, e-commerce first (then smallest category); ids are 1..n in
    name order (distributed rank).
    """
    ec = (raw_ecommerce_sales(spark, sf_dir)
          .select("order_date", "product_name", "category", "quantity").na.drop("any")          # C5
          .select(F.col("product_name").alias("name"), "category")
          .distinct()
          .select("name", map_values(F.trim("category"), CATEGORY_MAP, CATEGORY_DEFAULT, lower=True)
                  .alias("category"), F.lit(0).alias("src")))
    us = (sales_clean(spark, sf_dir).select(F.col("product").alias("name")).distinct()
          .select("name", F.lit("end_product").alias("category"), F.lit(1).alias("src")))
    allp = union_by_name(ec, us).na.drop(subset=["name"])
    first = first_per_key(allp, ["name"], ["src", "category"]).drop("src")
    return global_rank(first, ["name"], "id").select("id", "name", "category")


def product_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1-U4 + C10-C12 + J2: unified product catalog with surrogate ids and
    the number of sales lines of each name (pre-aggregated before the join)."""
    lines = read_table(spark, sf_dir, "lineitem", "l_partkey")
    names = read_table(spark, sf_dir, "part", "p_partkey", "p_name")
    per_name = (lines.join(names, lines.l_partkey == names.p_partkey)
                .groupBy(F.col("p_name").alias("name")).agg(F.count(F.lit(1)).alias("n_lines")))
    return (product_ids(spark, sf_dir).join(per_name, "name", "left")
               .select("id", "name", "category", F.coalesce("n_lines", F.lit(0)).alias("n_lines"))
               .orderBy("id"))


def sales_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unified fact: cleaned lines of both files with the product's id on
    each, rows without a date dropped (U1, C6, C15, J2)."""
    ec = (raw_ecommerce_sales(spark, sf_dir).na.drop(subset=["order_date"])
          .select(F.col("order_date").alias("date"), F.col("product_name").alias("product"), money("quantity").alias("quantity"),
                  safe_div(F.col("revenue").cast("double"), F.col("quantity")).alias("unit_price"), "revenue", "profit",
                  F.lit("ecommerce").alias("source")))
    us = sales_clean(spark, sf_dir).select("date", "product", "quantity", F.col("unit_price").cast("double").alias("unit_price"),
                                           "revenue", "profit", "source")
    ids = product_ids(spark, sf_dir).select(F.col("id").alias("product_id"), F.col("name").alias("product"))
    return (union_by_name(ec, us).join(ids, "product", "left")
            .select("date", "product_id", "quantity", "unit_price", "revenue", "profit", "source"))


def commodity_tagging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C13 + P5 + A8: rows, distinct commodities and date span per relevance tag."""
    cp = cat.commodity_prices(spark, sf_dir)
    return (cp.groupBy("relevant_for")
              .agg(F.count(F.lit(1)).alias("n_rows"),
                   F.count_distinct("commodity_name").alias("n_commodities"),
                   F.min("date").alias("first_date"), F.max("date").alias("last_date"))
              .orderBy("relevant_for"))


def null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C20 + C21: data type, rows and NULL count per column of the parsed sales
    (one pass, then one row per column)."""
    s = parse_updated_sales(raw_updated_sales(spark, sf_dir))
    cols = s.columns
    wide = s.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = wide.unpivot(["_rows"], cols, "column_name", "null_count")
    kind = F.create_map(*[F.lit(x) for c, t in s.dtypes for x in (c, t)])[F.col("column_name")]
    return long.select("column_name", kind.alias("data_type"), "null_count", F.col("_rows").alias("total_rows"),
                       (F.col("_rows") - F.col("null_count")).alias("non_null_count")).orderBy("column_name")
