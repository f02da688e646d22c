"""Prediction requests in batch: validation (V1, C22) and the historical
context fallback cascade (M4).

The reference serves one request at a time and runs up to four smart
queries per request. Here requests are a DataFrame (derived from orders, so
their number grows with the data) and the cascade is answered with joins:
sales are summarised once at (date, category) grain, each distinct request
key is matched against that summary, and every request picks the first level
with data - no per-request query, no driver loop.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import parse_mixed
from ..functions.exprs import blank_to_null, map_values
from ..operators.quality import error_list
from ..session import materialize
from ..sources import catalog as cat
from ..sources.tables import read_table
from .ingest import CATEGORY_MAP

# Validation constants of the reference API (fixed values).
VALID_CATEGORIES = ["Electronics", "Accessories", "Office"]
VALID_REGIONS = ["North", "East", "South", "West"]
VALID_TICKERS = ["NVDA", "SAMSUNG", "SONY"]
# Layouts of a request's date, tried in this order.
REQUEST_DATES = ["yyyy-MM-dd", "MM/dd/yyyy", "d MMM yyyy", "MMMM d, yyyy", "yyyy/MM/dd", "yyyyMMdd", "dd.MM.yyyy",
                 "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "MM/dd/yyyy HH:mm"]

# API region -> sales region of the model's one-hot columns.
API_REGION = {"north": "EUROPE", "east": "ASIA", "south": "AFRICA", "west": "AMERICA"}

# Days after the last sale that a request's date may lie.
REQUEST_DAYS = 90

REQUEST_FIELDS = ["state", "region", "holiday", "ticker", "commodity", "category", "year", "date"]


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per order, with the input dirt a web form produces (blank
    fields, lower-case tickers, unknown values, dates in several layouts, bad or late ones)."""
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate",
                   "o_orderstatus", "o_orderpriority")
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    j = o.join(c, o.o_custkey == c.c_custkey, "left")
    pr, st, m = F.col("o_orderpriority"), F.col("o_orderstatus"), F.month("o_orderdate")
    category = (F.when(pr == "1-URGENT", "Electronics").when(pr == "2-HIGH", "Accessories")
                 .when(pr == "3-MEDIUM", "Office").when(pr == "4-NOT SPECIFIED", "").otherwise("Toys"))
    seg = F.col("c_mktsegment")
    region = (F.when(seg == "AUTOMOBILE", "North").when(seg == "BUILDING", "East")
               .when(seg == "FURNITURE", "South").when(seg == "MACHINERY", "West").otherwise("Central"))
    ticker = (F.when(st == "F", "nvda").when(st == "O", "SAMSUNG").when(pr == "5-LOW", "xyz").otherwise("sony"))
    holiday = (F.when(m == 11, "Diwali").when(m == 1, "new year").when(m == 12, "Christmas")
                .otherwise(""))
    commodity = F.when(st == "O", "copper").when(st == "P", "oil").otherwise("")
    year = (F.when(pr == "3-MEDIUM", F.lit(None).cast("int"))
             .otherwise(F.year("o_orderdate") + F.when((pr == "5-LOW") | (st == "P"), 1).otherwise(0)))
    written = lambda d: (F.when(st == "O", F.date_format(d, "MM/dd/yyyy")).when(st == "P", F.date_format(d, "d MMM yyyy"))
                         .otherwise(F.date_format(d, "yyyy-MM-dd")))
    date = (F.when(pr == "2-HIGH", F.lit(""))
             .when((pr == "5-LOW") & (st == "P"), F.lit("not-a-date"))
             .otherwise(written(F.date_add(F.to_date("o_orderdate"), F.when((pr == "1-URGENT") & (st == "P"), 400).otherwise(90)))))
    return j.select(F.col("o_orderkey").alias("request_id"), F.lit("").alias("state"),
                    region.alias("region"), holiday.alias("holiday"), ticker.alias("ticker"),
                    commodity.alias("commodity"), category.alias("category"),
                    year.cast("int").alias("year"), date.alias("date"))


def clean_requests(req: DataFrame) -> DataFrame:
    """Blank strings -> NULL; ticker upper-cased once."""
    out = req
    for c in ("state", "region", "holiday", "ticker", "commodity", "category", "date"):
        out = out.withColumn(c, blank_to_null(c))
    return out.withColumn("ticker", F.upper("ticker"))


def validate_requests(req: DataFrame, max_date: str, years: tuple[int, int]) -> DataFrame:
    """V1: adds ``errors`` (array of failed checks), ``is_valid`` and the parsed
    ``req_date``. Dates are compared as dates (D8)."""
    r = clean_requests(req).withColumn("req_date", F.to_date(parse_mixed("date", REQUEST_DATES)))
    mx = _dt.date.fromisoformat(max_date)
    checks = [
        ("category", F.col("category").isNotNull() & ~F.col("category").isin(VALID_CATEGORIES)),
        ("region", F.col("region").isNotNull() & ~F.col("region").isin(VALID_REGIONS)),
        ("ticker", F.col("ticker").isNotNull() & ~F.col("ticker").isin(VALID_TICKERS)),
        ("date_format", F.col("date").isNotNull() & F.col("req_date").isNull()),
        ("date_range", F.col("req_date").isNotNull() & (F.col("req_date") > F.lit(mx))),
        ("year", F.col("year").isNotNull() & ((F.col("year") < years[0]) | (F.col("year") > years[1]))),
    ]
    r = r.withColumn("errors", error_list(checks))
    return r.withColumn("is_valid", (F.size("errors") == 0).cast("int"))


def validated_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1 with the bounds of the sales span: dates up to REQUEST_DAYS after the
    last sale, years from the first sale to the horizon's."""
    span = cat.sales_span(spark, sf_dir) or (_dt.date.max, _dt.date.min + _dt.timedelta(days=cat.HORIZON_DAYS))
    last, horizon = (_dt.timedelta(days=d) for d in (REQUEST_DAYS, cat.HORIZON_DAYS))
    return validate_requests(requests(spark, sf_dir), (span[1] + last).isoformat(), (span[0].year, (span[1] + horizon).year))


def request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = validated_requests(spark, sf_dir)
    return v.select("request_id", "is_valid", F.size("errors").alias("n_errors"),
                    F.nullif(F.array_join("errors", ";"), F.lit("")).alias("errors"))


def valid_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = validated_requests(spark, sf_dir).filter("is_valid = 1")
    return (v.withColumn("cat_stored", map_values(F.col("category"), CATEGORY_MAP, lower=True))
             .withColumn("region_stored", map_values(F.col("region"), API_REGION, lower=True)))


# ---------------------------------------------------------------------------
# M4: context fallback cascade
# ---------------------------------------------------------------------------
ALL = "*"


def _sales_with_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = cat.sales(spark, sf_dir).select("date", "order_id", "product_id", "quantity", "revenue")
    p = cat.products(spark, sf_dir).select(F.col("id").alias("product_id"), "category")
    return s.join(p, "product_id")


def day_category_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, cat_key, year_key, n) with cat_key / year_key also '*'.

    A hash aggregate (counts only) to one row per (day, category), expanded
    to the four (category | *, year | *) combinations: bounded by
    days x categories x 4.
    """
    dc = (_sales_with_category(spark, sf_dir).groupBy("date", "category")
          .agg(F.count(F.lit(1)).alias("n"))
          .withColumn("year", F.year("date").cast("string")))
    combos = F.array(
        F.struct(F.col("category").alias("c"), F.col("year").alias("y")),
        F.struct(F.col("category").alias("c"), F.lit(ALL).alias("y")),
        F.struct(F.lit(ALL).alias("c"), F.col("year").alias("y")),
        F.struct(F.lit(ALL).alias("c"), F.lit(ALL).alias("y")))
    x = dc.select("date", "n", F.explode(combos).alias("kk"))
    return (x.groupBy("date", F.col("kk.c").alias("cat_key"), F.col("kk.y").alias("year_key"))
             .agg(F.sum("n").alias("n")))


def last_rows(spark: SparkSession, sf_dir: str, wanted: DataFrame) -> DataFrame:
    """Last sales row (D10 tie-break) of each wanted (date, cat_key).

    Only rows on the wanted days are read past the date filter (a semi join
    with a small, distinct day list), so the struct ``max_by`` - which cannot
    use hash aggregation - never runs over the whole fact.
    """
    days = wanted.select("date").distinct()
    s = _sales_with_category(spark, sf_dir).join(F.broadcast(days), "date", "left_semi")
    key = F.struct("order_id", "product_id", "quantity", "revenue")
    per_cat = s.groupBy("date", F.col("category").alias("cat_key")).agg(
        F.max_by("revenue", key).alias("revenue"))
    per_day = s.groupBy("date").agg(F.max_by("revenue", key).alias("revenue")).withColumn(
        "cat_key", F.lit(ALL))
    return per_cat.unionByName(per_day).join(wanted.distinct(), ["date", "cat_key"], "left_semi")


def context_fallback(spark: SparkSession, sf_dir: str, valid: DataFrame | None = None) -> DataFrame:
    """M4: per valid request: level used (1-4), sample size, latest context
    date / revenue and the ticker close on that date (level 1 only).

    ``valid``: the valid requests, where the caller has them written."""
    valid = valid if valid is not None else materialize(valid_requests(spark, sf_dir), "requests")
    req = valid.select(
        "request_id", "holiday", "ticker", "commodity", "cat_stored", "year", "req_date")
    req = req.withColumn("cat_key", F.coalesce("cat_stored", F.lit(ALL))).withColumn(
        "year_key", F.coalesce(F.col("year").cast("string"), F.lit(ALL)))
    # Bounded (days x categories x 4) and read by every level: write it once.
    dcx = materialize(day_category_summary(spark, sf_dir), "day_category")

    # ---- level 1: (holiday, commodity, category, year); a ticker restricts
    # no rows, so it is only looked up at the end ----------------------------
    keys = req.select("holiday", "commodity", "cat_key", "year_key").distinct()
    hol = cat.sales_holidays(spark, sf_dir).select("name", "date")
    hpat = keys.select("holiday").where("holiday IS NOT NULL").distinct()
    # distinct patterns x a bounded holiday calendar: both sides small.
    hmatch = (hpat.join(F.broadcast(hol), F.expr("name ILIKE concat('%', holiday, '%')"))
              .groupBy("holiday", "date").agg(F.count(F.lit(1)).alias("m_h")))
    # Quotes and commodity prices share one lineitem x part pass.
    lp = materialize(cat.line_part_daily(spark, sf_dir), "line_part_daily")
    cp = cat.commodity_prices(spark, sf_dir, lp).select(F.col("date").alias("month"), "commodity_name")
    cpat = keys.select("commodity").where("commodity IS NOT NULL").distinct()
    # Free-text patterns are unbounded; the commodity names are not: broadcast
    # the names, match, then equi-join the matched names to the monthly rows.
    names = cp.select("commodity_name").distinct()
    matched = cpat.join(F.broadcast(names), F.expr("commodity_name ILIKE concat('%', commodity, '%')"))
    cmatch = (matched.join(cp, "commodity_name")
              .groupBy("commodity", "month").agg(F.count(F.lit(1)).alias("m_c")))
    k1 = keys.join(dcx, ["cat_key", "year_key"])
    k1 = (k1.join(hmatch, ["holiday", "date"], "left")
            .filter(F.col("holiday").isNull() | F.col("m_h").isNotNull())
            .withColumn("month", F.trunc("date", "month"))
            .join(cmatch, ["commodity", "month"], "left")
            .withColumn("w", F.col("n") * F.coalesce("m_h", F.lit(1)) * F.coalesce("m_c", F.lit(1))))
    l1 = (k1.groupBy("holiday", "commodity", "cat_key", "year_key")
            .agg(F.sum("w").alias("n1"), F.max("date").alias("d1")))
    # One row per distinct request key; read twice below.
    l1 = materialize(l1, "level1")
    sp = cat.stock_prices(spark, sf_dir, lp).select(F.col("date").alias("d1"), "ticker",
                                                    F.col("close").alias("close1"))

    # ---- levels 2 / 3 / 4 ----------------------------------------------------
    lv = dcx.groupBy("cat_key", "year_key").agg(F.sum("n").alias("n"), F.max("date").alias("d"))
    l2 = lv.select("cat_key", "year_key", F.col("n").alias("n2"), F.col("d").alias("d2"))
    l3 = lv.filter(F.col("year_key") == ALL).select("cat_key", F.col("n").alias("n3"), F.col("d").alias("d3"))
    l4 = lv.filter((F.col("cat_key") == ALL) & (F.col("year_key") == ALL)).select(
        F.lit(1).alias("_one"), F.least(F.col("n"), F.lit(100)).alias("n4"), F.col("d").alias("d4"))

    # The only (day, category) pairs whose last row can be needed come from
    # the per-level tables (bounded by distinct keys), not from the requests.
    wanted = (l1.select(F.col("d1").alias("date"), "cat_key")
              .unionByName(l2.select(F.col("d2").alias("date"), "cat_key"))
              .unionByName(l3.select(F.col("d3").alias("date"), "cat_key"))
              .unionByName(l4.select(F.col("d4").alias("date"), F.lit(ALL).alias("cat_key")))
              .where("date IS NOT NULL").distinct())
    lr = materialize(last_rows(spark, sf_dir, wanted), "last_rows").select(
        F.col("date").alias("context_date"), F.col("cat_key").alias("_cat"),
        F.col("revenue").alias("context_revenue"))

    # Absent arguments are NULL in both tables: match them null-safely.
    kcols = ["holiday", "commodity", "cat_key", "year_key"]
    l1 = l1.select(*[F.col(c).alias(f"_k_{c}") for c in kcols], "n1", "d1")
    cond = [req[c].eqNullSafe(l1[f"_k_{c}"]) for c in kcols]
    r = (req.join(l1, cond, "left").drop(*[f"_k_{c}" for c in kcols])
            .join(F.broadcast(sp), ["d1", "ticker"], "left")   # days x tickers
            .join(l2, ["cat_key", "year_key"], "left")
            .join(l3, ["cat_key"], "left")
            .withColumn("_one", F.lit(1))
            .join(F.broadcast(l4), "_one", "left"))   # one row
    use1 = F.coalesce(F.col("n1"), F.lit(0)) > 0
    use2 = F.coalesce(F.col("n2"), F.lit(0)) > 0
    use3 = F.col("cat_stored").isNotNull() & (F.coalesce(F.col("n3"), F.lit(0)) > 0)
    level = F.when(use1, 1).when(use2, 2).when(use3, 3).otherwise(4)
    ctx_date = (F.when(use1, F.col("d1")).when(use2, F.col("d2"))
                 .when(use3, F.col("d3")).otherwise(F.col("d4")))
    size = (F.when(use1, F.col("n1")).when(use2, F.col("n2"))
             .when(use3, F.col("n3")).otherwise(F.col("n4")))
    # Levels 1-3 are restricted to the request category (or all), level 4 never.
    ctx_cat = F.when(use1 | use2 | use3, F.col("cat_key")).otherwise(F.lit(ALL))
    out = r.select(
        "request_id", level.alias("level_used"), size.cast("long").alias("sample_size"),
        ctx_date.alias("context_date"), ctx_cat.alias("_cat"),
        F.when(use1, F.col("close1")).alias("stock_close"), "req_date")
    # lr holds one row per wanted (day, category): bounded, broadcastable.
    return (out.join(F.broadcast(lr), ["context_date", "_cat"], "left")
               .select("request_id", "level_used", "sample_size", "context_date", "context_revenue",
                       "stock_close", F.coalesce("req_date", "context_date").alias("basis_date")))
