"""Model and forecast: recovery of known signals, shapes, bounds, persistence."""

import datetime as dt
import math
import os

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from marketweave.plans import features as fe
from marketweave.plans import forecast as fc
from marketweave.plans import model as ml
from conftest import SF001


def test_ols_recovers_linear_signal(spark, tmp_dir):
    rows = [(float(i % 7), float(i % 5), 2.0 * (i % 7) - 3.0 * (i % 5) + 4.0) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, label double")
    m = ml.build_pipeline(["a", "b"]).fit(df)
    path = os.path.join(tmp_dir, "m")
    m.write().overwrite().save(path)
    back = PipelineModel.load(path)
    pred = back.transform(spark.createDataFrame([(1.0, 2.0, 0.0)], "a double, b double, label double")).first()
    assert abs(pred.prediction - (2.0 - 6.0 + 4.0)) < 1e-6


def test_train_test_split_counts(spark):
    o = spark.range(0, 101).select(F.col("id").alias("k"), (F.col("id") % 3).alias("g"))
    s = fe.train_test_split(o, ["g", "k"])
    assert s.count() == 101
    assert s.filter("is_test = 1").count() == math.ceil(0.2 * 101)
    last_train = s.filter("is_test = 0").agg(F.max("row_rank")).first()[0]
    assert last_train == 101 - math.ceil(0.2 * 101)


def test_feature_table_has_no_null_features(spark):
    f = fe.feature_table(spark, SF001)
    cond = " OR ".join(f"{c} IS NULL" for c in fe.FEATURES)
    assert f.filter(cond).count() == 0 and f.count() > 0


def test_mae_and_scores(spark):
    r = ml.ols_mae(spark, SF001).first()
    assert r.n_test == math.ceil(0.2 * (r.n_train + r.n_test)) and r.mae > 0
    s = ml.score_requests(spark, SF001)
    assert s.filter("estimated_revenue IS NULL").count() == 0
    assert set(s.columns) >= {"estimated_revenue", "currency", "historical_sample_size", "basis_date"}


def test_forecast_shape_and_bounds(spark):
    f = fc.forecast(spark, SF001, 30)
    rows = f.collect()
    assert len(rows) == 30
    assert all(r.yhat_lower <= r.yhat <= r.yhat_upper for r in rows)
    assert [r.ds for r in rows] == sorted(r.ds for r in rows)
    with pytest.raises(ValueError):
        fc.forecast(spark, SF001, 400)


def test_forecast_design_recovers_trend_and_weekly(spark):
    start = dt.date(2020, 1, 1)
    rows = []
    for i in range(730):
        day = start + dt.timedelta(days=i)
        rows.append((day, 100.0 + 10.0 * i / 365.25 + 5.0 * math.sin(2 * math.pi * i / 7.0)))
    df = spark.createDataFrame(rows, "ds date, y double")
    names = fc._holiday_names(spark)
    from marketweave.sources import catalog as cat
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    frame = fc.design(df, "2020-01-01", cat.holidays(spark, (2020, 2021)), names)
    cols = fc.design_columns(names)
    m = LinearRegression(featuresCol="f", labelCol="y", regParam=0.0, solver="normal").fit(
        VectorAssembler(inputCols=cols, outputCol="f").transform(frame))
    coef = dict(zip(cols, m.coefficients.toArray()))
    assert abs(coef["trend"] - 10.0) < 1e-3 and abs(coef["weekly_s1"] - 5.0) < 1e-3


def test_forecast_components_add_up(spark):
    c = fc.forecast_components(spark, SF001, 10)
    bad = c.filter(F.abs(F.col("trend") + F.col("yearly") + F.col("weekly") + F.col("holidays") - F.col("yhat")) > 1e-3)
    assert bad.count() == 0


def test_forecast_by_region(spark):
    f = fc.forecast_by_region(spark, SF001, 14)
    assert f.groupBy("region").count().filter("count != 14").count() == 0
    assert f.filter("yhat_lower > yhat OR yhat > yhat_upper").count() == 0


def test_ordered_split_matches_full_rank(spark):
    rows = [(d, k, float(k % 7)) for d in range(10) for k in range(d * 3 + 1)]
    df = spark.createDataFrame(rows, "day int, k int, v double")
    by_day = {(r.day, r.k): r.is_test for r in fe.ordered_split(df, "day", ["day", "k"]).collect()}
    full = {(r.day, r.k): r.is_test for r in fe.train_test_split(df, ["day", "k"]).collect()}
    assert by_day == full
    assert sum(by_day.values()) == math.ceil(0.2 * len(rows))


def test_saved_model_scores_alike(spark, tmp_dir):
    fitted = ml.fit_sales_model(spark, SF001)
    ml.save_model(fitted, os.path.join(tmp_dir, "sales"))
    model, columns = ml.load_model(spark, os.path.join(tmp_dir, "sales"))
    assert columns == fitted.columns
    some = fitted.cells.limit(20)
    a = [r.prediction for r in fitted.model.transform(some).orderBy(*ml.CELL).collect()]
    assert a == [r.prediction for r in model.transform(some).orderBy(*ml.CELL).collect()]


def test_region_and_category_change_the_prediction(spark):
    """Requests that differ in one label only get another estimate."""
    fitted = ml.fit_sales_model(spark, SF001)
    base = dict.fromkeys(fitted.columns, 1.0)
    hots = [c for c in fitted.columns if c.startswith(("Category_", "Region_"))]
    rows = [tuple(0.0 if c in hots and c not in on else base[c] for c in fitted.columns)
            for on in (("Category_component", "Region_ASIA"), ("Category_component", "Region_EUROPE"), ("Category_end_product", "Region_ASIA"))]
    got = [r.prediction for r in fitted.model.transform(spark.createDataFrame(rows, fitted.columns).coalesce(1)).collect()]
    assert got[0] != got[1] and got[0] != got[2]
    s = ml.score_features(spark, SF001)
    regions = [c for c in s.columns if c.startswith("Region_")]
    assert s.filter(" + ".join(regions) + " = 1").count() == s.count() > 0


def test_weighted_cells_predict_like_lines(spark):
    """The fit on cells equals the least-squares fit on the lines."""
    import numpy as np
    fitted = ml.fit_sales_model(spark, SF001)
    f = fe.feature_table(spark, SF001).toPandas().sort_values(["date", "order_id", "product_id", "sales"])
    n = len(f) - math.ceil(0.2 * len(f))
    x = np.column_stack([f[fitted.columns].to_numpy(float), np.ones(len(f))])
    scale = np.abs(x).max(axis=0) + 1e-12
    beta, *_ = np.linalg.lstsq(x[:n] / scale, f["sales"].to_numpy(float)[:n], rcond=None)
    want = sorted((x[n:] / scale) @ beta)
    got = sorted(r.prediction for r in fitted.test_lines(spark, SF001).select("prediction").collect())
    assert len(got) == len(want) and np.allclose(got, want, rtol=1e-3)
