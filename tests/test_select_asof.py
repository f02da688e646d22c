"""Exact selection of quantiles, and the as-of join, against plain Python."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketweave.functions.exprs import missing_to_zero
from marketweave.operators.asof import asof_join, day_buckets
from marketweave.operators.select import grouped_quantiles

PROBS = (0.0, 0.25, 0.5, 0.75, 0.99, 1.0)


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_quantiles_are_exact(spark, accuracy):
    r = random.Random(accuracy)
    rows = [("normal", r.gauss(0, 9)) for _ in range(4000)] + [("ties", float(r.choice([1, 1, 1, 2, 5]))) for _ in range(3000)]
    rows += [("one", 3.5), ("two", 1.0), ("two", 2.0), (None, 7.0), (None, 8.0), (None, None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {x.g: (x.n, x.q) for x in grouped_quantiles(df, "g", "x", PROBS, accuracy).collect()}
    assert set(got) == {"normal", "ties", "one", "two", None}
    for g, (n, q) in got.items():
        v = np.array([x for k, x in rows if k == g and x is not None])
        assert n == len(v) and np.allclose(q, np.quantile(v, PROBS), rtol=0, atol=1e-9)


def test_quantiles_neither_sort_nor_write_the_rows(spark):
    df = spark.range(20_000).select(F.lit("a").alias("g"), F.xxhash64("id").cast("double").alias("x"))
    plan = grouped_quantiles(df, "g", "x", (0.25, 0.5, 0.75))._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Range (0" not in plan  # what is left reads the written counts


def plain(left, right):
    out = []
    for k, t, x in left:
        found = [(u, y) for j, u, y in right if j == k and k is not None and t is not None and u is not None and u <= t]
        out.append((k, t, x, max(found, key=lambda m: (m[0], m[1] is not None, m[1] or 0)) if found else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("days", [1, 7, 10_000])
def test_asof_join_matches_plain_search(spark, days):
    r = random.Random(days)
    day = lambda: dt.date(1999, 12, 1) + dt.timedelta(days=r.randint(0, 200))
    key = lambda: r.choice(["hot", "hot", "hot", "a", "b"])
    left = [(key(), day(), i) for i in range(400)] + [(None, day(), 900), ("a", None, 901), ("alone", day(), 902)]
    right = [(key(), day(), r.choice([None, r.randint(0, 99)])) for _ in range(60)] + [(None, day(), 1), ("b", None, 2), ("other", day(), 3)]
    right += right[:5]
    a = spark.createDataFrame(left, "k string, t date, match int").repartition(4)
    b = spark.createDataFrame(right, "k string, u date, y int")
    out = asof_join(a, b, ["k"], "t", "u", day_buckets(days), name="found")
    assert out.columns == ["k", "t", "match", "found"]
    got = sorted(((x.k, x.t, x.match, (x.found.u, x.found.y) if x.found else None) for x in out.collect()), key=str)
    assert got == plain(left, right)


def test_asof_join_spreads_a_hot_key_and_has_no_loop(spark):
    a = spark.range(1000).select(F.lit("hot").alias("k"), F.date_add(F.lit("2000-01-01"), F.col("id").cast("int")).alias("t"))
    out = asof_join(a, a.withColumnRenamed("t", "u").filter(F.dayofmonth("u") == 1), ["k"], "t", "u", day_buckets(30))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert out.filter("match.u <> trunc(t, 'month') OR match IS NULL").count() == 0
    assert asof_join(a.limit(0), a, ["k"], "t", "t", day_buckets(30)).count() == 0


def test_missing_numbers_become_zero(spark):
    df = spark.createDataFrame([(1.5,), (float("nan"),), (None,)], "x double")
    assert [x.z for x in df.select(missing_to_zero("x").alias("z")).collect()] == [1.5, 0.0, 0.0]


def test_requests_in_any_layout(spark):
    from marketweave.plans import requests as rq
    texts = ["2001-03-05", "03/05/2001", "5 Mar 2001", "05 Mar 2001", "March 5, 2001", "2001/03/05", "20010305", "05.03.2001", "2001-03-05 10:20:30",
             "2001-03-05T10:20:30", "03/05/2001 10:20", "not-a-date", "2001-13-05", "", None]
    rows = [(i, "", "North", "", "nvda", "", "Office", 2001, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "request_id long, state string, region string, holiday string, ticker string, commodity string, category string, year int, date string")
    got = {x.request_id: (x.req_date, x.errors) for x in rq.validate_requests(df, "2001-12-31", (2000, 2002)).collect()}
    for i, t in enumerate(texts):
        bad = t in ("not-a-date", "2001-13-05")
        assert got[i] == (None if bad or not t else dt.date(2001, 3, 5), ["date_format"] if bad else []), t
