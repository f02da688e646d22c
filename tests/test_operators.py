"""Operator unit tests on hand-made inputs of a few rows (NULLs, ties,
unmatched keys, duplicate keys, empty ranges, malformed strings)."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from marketweave.functions import dates as D
from marketweave.functions import exprs as X
from marketweave.operators import reshape as R
from marketweave.operators import windows as W
from marketweave.operators.quality import duplicate_keys, error_list, orphans
from marketweave.operators.rank import global_rank


def d(s):
    return dt.date.fromisoformat(s)


def test_ffill_keeps_values_and_leading_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, None), (4, None), (5, 7.0), (6, None)],
                               "t int, v double")
    out = [r.v for r in W.ffill(df, ["v"], ["t"]).orderBy("t").collect()]
    assert out == [None, 5.0, 5.0, 5.0, 7.0, 7.0]


def test_ffill_partitioned(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, None), ("b", 1, None), ("b", 2, 3.0)],
                               "k string, t int, v double")
    out = {(r.k, r.t): r.v for r in W.ffill(df, ["v"], ["t"], ["k"]).collect()}
    assert out == {("a", 1): 1.0, ("a", 2): 1.0, ("b", 1): None, ("b", 2): 3.0}


def test_lag_rows_is_row_based(spark):
    df = spark.createDataFrame([(d("2020-01-01"), 1), (d("2020-01-05"), 2), (d("2020-01-06"), 3)],
                               "date date, v int")
    out = [r.v_lag_1 for r in W.lag_rows(df, "v", 1, ["date"]).orderBy("date").collect()]
    assert out == [None, 1, 2]


def test_rolling_mean_needs_full_frame(spark):
    rows = [(i, Decimal(i)) for i in range(1, 10)]
    df = spark.createDataFrame(rows, "t int, v decimal(18,4)")
    out = [r.m for r in W.rolling_mean_full(df, "v", 7, ["t"], name="m").orderBy("t").collect()]
    assert out[:6] == [None] * 6
    assert out[6:] == [4.0, 5.0, 6.0]


def test_rolling_mean_null_in_frame(spark):
    rows = [(i, None if i == 8 else float(i)) for i in range(1, 10)]
    df = spark.createDataFrame(rows, "t int, v double")
    out = [r.m for r in W.rolling_mean_full(df, "v", 7, ["t"], name="m").orderBy("t").collect()]
    assert out[6] == 4.0 and out[7] is None and out[8] is None


def test_dense_days_and_empty_range(spark):
    b = spark.createDataFrame([(d("2020-02-27"), d("2020-03-01"))], "start date, end date")
    assert [r.date for r in W.dense_days(b).collect()] == [d("2020-02-27"), d("2020-02-28"),
                                                            d("2020-02-29"), d("2020-03-01")]
    b2 = spark.createDataFrame([(d("2020-03-02"), d("2020-03-01"))], "start date, end date")
    assert W.dense_days(b2).count() == 0


def test_int_range_backwards_is_empty(spark):
    b = spark.createDataFrame([(2005, 2003)], "s int, e int")
    assert W.int_range(b, "s", "e").count() == 0
    b = spark.createDataFrame([(2003, 2005)], "s int, e int")
    assert [r.year for r in W.int_range(b, "s", "e").collect()] == [2003, 2004, 2005]


def test_linear_fit_recovers_line(spark):
    df = spark.createDataFrame([(y, 3.0 * (y - 2000) + 10.0) for y in range(1995, 2005)], "year int, v double")
    r = W.linear_fit(df, "year", "v", 2000.0).first()
    assert abs(r.slope - 3.0) < 1e-9 and abs(r.intercept - 10.0) < 1e-9 and r.n_points == 10


def test_unpivot_digit_columns_keeps_nulls(spark):
    df = spark.createDataFrame([("India", "x", 1.0, None)], "country string, name string, `1995` double, `1996` double")
    out = R.unpivot_digit_columns(df, ["country"], "year", "value").orderBy("year").collect()
    assert [(r.year, r.value) for r in out] == [(1995, 1.0), (1996, None)]
    assert dict(R.unpivot_digit_columns(df, ["country"]).dtypes)["year"] == "int"


def test_pivot_fixed_sum_equals_total(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 2, 3), ("b", 1, 4), ("b", 3, 5)], "k string, m int, v int")
    wide = R.pivot_fixed(df, ["k"], "m", {1: "m1", 2: "m2", 3: "m3", 4: "m4"}, "sum", "v")
    rows = {r.k: r for r in wide.collect()}
    assert rows["a"].m4 is None and rows["b"].m2 is None
    total = sum((r.m1 or 0) + (r.m2 or 0) + (r.m3 or 0) + (r.m4 or 0) for r in rows.values())
    assert total == 14


def test_one_hot_all_levels_null_is_zero(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    out = R.one_hot(df, "c", ["a", "b"]).collect()
    assert [(r.c_a, r.c_b) for r in out] == [(1, 0), (0, 1), (0, 0)]


def test_first_per_key_is_deterministic(spark):
    df = spark.createDataFrame([("x", "end_product", 1), ("x", "component", 0), ("x", "end_product", 0),
                                ("y", "end_product", 1)], "name string, category string, src int")
    out = {r.name: (r.category, r.src) for r in R.first_per_key(df, ["name"], ["src", "category"]).collect()}
    assert out == {"x": ("component", 0), "y": ("end_product", 1)}


def test_global_rank_consecutive_with_skewed_key(spark):
    rows = [("hot", i) for i in range(300)] + [("cold", i) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(7)
    out = global_rank(df, ["k", "v"], "r").orderBy("r").collect()
    assert [r.r for r in out] == list(range(1, 306))
    assert [(r.k, r.v) for r in out[:5]] == [("cold", i) for i in range(5)]
    assert out[5].k == "hot" and out[5].v == 0


def test_map_values_default_and_miss(spark):
    df = spark.createDataFrame([("Electronics",), ("ACCESSORIES",), ("toys",), (None,)], "c string")
    m = {"electronics": "end_product", "accessories": "component"}
    out = [r.x for r in df.select(X.map_values("c", m, "end_product", lower=True).alias("x")).collect()]
    assert out == ["end_product", "component", "end_product", "end_product"]
    out = [r.x for r in df.select(X.map_values("c", m, lower=True).alias("x")).collect()]
    assert out == ["end_product", "component", None, None]


def test_tag_by_lists(spark):
    df = spark.createDataFrame([("Copper",), ("Crude oil, WTI",), ("Cocoa",)], "n string")
    out = [r.t for r in df.select(X.tag_by_lists("n", [(["Copper"], "metal"), (["Crude oil, WTI"], "energy")],
                                                 "other").alias("t")).collect()]
    assert out == ["metal", "energy", "other"]


def test_coercing_casts_and_safe_division(spark):
    df = spark.createDataFrame([("12.5", "0"), ("abc", "2"), ("", None)], "a string, b string")
    out = df.select(X.try_number(F.col("a")).alias("a"), X.safe_div(X.try_number(F.col("a")),
                                                                   X.try_number(F.col("b"))).alias("q")).collect()
    assert [(r.a, r.q) for r in out] == [(12.5, None), (None, None), (None, None)]


def test_blank_to_null(spark):
    df = spark.createDataFrame([("",), ("  ",), (" x ",), (None,)], "a string")
    assert [r.a for r in df.select(X.blank_to_null("a").alias("a")).collect()] == [None, None, "x", None]


def test_contains_ci_keeps_wildcards(spark):
    df = spark.createDataFrame([("Diwali (Deepavali)",), ("New Year",), ("a_b",)], "n string")
    assert df.filter(X.contains_ci("n", "diwali")).count() == 1
    assert df.filter(X.contains_ci("n", "w_y")).count() == 1   # '_' matches any char
    assert df.filter(X.contains_ci("n", "")).count() == 3


def test_parse_mixed_formats_and_offsets(spark):
    df = spark.createDataFrame([("2020-03-05",), ("03/05/2020 10:30",), ("2020-03-05 00:00:00+05:30",),
                                ("not a date",), (None,)], "s string")
    fmts = ["yyyy-MM-dd", "MM/dd/yyyy HH:mm", "yyyy-MM-dd HH:mm:ssXXX"]
    out = [r.d for r in df.select(D.parse_utc_day("s", fmts).alias("d")).collect()]
    assert out == [d("2020-03-05"), d("2020-03-05"), d("2020-03-04"), None, None]


def test_calendar_columns_iso_week_monday_zero(spark):
    df = spark.createDataFrame([(d("2021-01-03"),), (d("2021-01-04"),)], "date date")
    out = df.select(*[v.alias(k) for k, v in D.calendar_columns("date").items()]).collect()
    assert (out[0].week, out[0].day_of_week) == (53, 6)
    assert (out[1].week, out[1].day_of_week, out[1].quarter) == (1, 0, 1)


def test_day_range_end_inclusive(spark):
    df = spark.createDataFrame([(dt.datetime(1999, 12, 31, 23, 59),), (dt.datetime(2000, 1, 1, 0, 0),)],
                               "ts timestamp_ntz")
    assert df.filter(D.ts_day_range("ts", "1999-12-31", "1999-12-31")).count() == 1
    assert df.filter(D.ts_year("ts", 2000)).count() == 1


def test_quality_helpers(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (None, 3)], "k int, l int")
    assert [tuple(r) for r in duplicate_keys(df, ["k", "l"]).collect()] == [(1, 1, 2)]
    parent = spark.createDataFrame([(1,)], "id int")
    child = spark.createDataFrame([(1,), (2,), (None,)], "fk int")
    assert [r.fk for r in orphans(child, "fk", parent, "id").collect()] == [2]
    e = spark.createDataFrame([(5,), (50,)], "x int").select(
        error_list([("big", F.col("x") > 10), ("odd", F.col("x") % 2 == 1)]).alias("e")).collect()
    assert [r.e for r in e] == [["odd"], ["big"]]


def test_box_stats_against_numpy(spark):
    import numpy as np
    from marketweave.plans.reports import box_stats_raw
    rng = np.random.default_rng(7)
    rows = [("a", float(x)) for x in rng.normal(100, 10, 301)] + [("a", 500.0), ("a", -300.0)]
    rows += [("b", float(x)) for x in [1, 2, 2, 2, 3, 4, 50]]
    df = spark.createDataFrame(rows, "category string, v double").repartition(5)
    stats = box_stats_raw(df)
    got = {r.category: r for r in stats.collect()}
    for cat in ("a", "b"):
        v = np.array([x for c, x in rows if c == cat])
        q1, med, q3 = np.percentile(v, [25, 50, 75])
        lf, uf = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        r = got[cat]
        assert abs(r.q1 - q1) < 1e-9 and abs(r.median - med) < 1e-9 and abs(r.q3 - q3) < 1e-9
        assert r.whisker_low == v[v >= lf].min() and r.whisker_high == v[v <= uf].max()
        assert r.n_outliers == int(((v < lf) | (v > uf)).sum()) and r.n == len(v)
    assert got["a"].n_outliers >= 2 and got["b"].n_outliers == 1
