"""Least squares from sufficient statistics against numpy and Spark ML."""

import numpy as np
import pytest

from marketweave.operators.leastsq import LinearModel, least_squares
from marketweave.plans import model as ml

COLUMNS = ["a", "b", "twice_a", "same", "hot", "cold"]
SCHEMA = ", ".join(f"{c} double" for c in [*COLUMNS, "y", "w"])


def table(seed, n=300):
    r = np.random.default_rng(seed)
    a, b, hot = r.normal(1e5, 10, n), r.normal(0, 1e-3, n), r.integers(0, 2, n).astype(float)
    x = np.column_stack([a, b, 2 * a, np.full(n, 0.1), hot, 1 - hot])
    return x, 3 * a - 500 * b + 7 * hot + r.normal(0, 5, n), r.integers(1, 9, n).astype(float)


def frame(spark, x, y, w):
    return spark.createDataFrame([(*map(float, row), float(t), float(k)) for row, t, k in zip(x, y, w, strict=True)], SCHEMA)


@pytest.mark.parametrize("seed", [1, 2])
def test_collinear_weighted_rows_predict_like_lstsq(spark, seed):
    x, y, w = table(seed)
    df = frame(spark, x, y, w)
    m = least_squares(df, COLUMNS, "y", "w")
    z = (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1)
    z, root = np.column_stack([z, np.ones(len(x))]), np.sqrt(w)
    want = z @ np.linalg.lstsq(z * root[:, None], y * root, rcond=1e-9)[0]
    got = [r.prediction for r in m.transform(df.coalesce(1)).collect()]
    assert m.rank == 3 and np.allclose(sorted(got), sorted(want), rtol=1e-9)
    back = [c.coefficients for c in (m, least_squares(df.repartition(7), COLUMNS, "y", "w"))]
    assert np.allclose(*back, rtol=1e-6, atol=1e-9)


def test_agrees_with_spark_ml(spark):
    x, y, w = table(3)
    df = frame(spark, x, y, w).coalesce(1)
    ours = [r.prediction for r in least_squares(df, ["b", "hot"], "y", "w").transform(df).collect()]
    theirs = ml.build_pipeline(["b", "hot"], "w").fit(df.withColumnRenamed("y", "label")).transform(df)
    assert np.allclose(ours, [r.prediction for r in theirs.collect()], rtol=1e-9)


def test_nulls_weights_empty_and_repeats(spark):
    rows = [(float(i), 2.0 * i + 1, 1.0) for i in range(9)]
    odd = [(None, 5.0, 1.0), (4.0, None, 1.0), (4.0, 900.0, 0.0), (4.0, 900.0, None), (4.0, 900.0, -1.0)]
    df = spark.createDataFrame([*rows, *rows, *odd], "a double, y double, w double")
    m = least_squares(df, ["a"], "y", "w")
    assert np.allclose(m.coefficients, [2.0]) and np.isclose(m.level, 9.0)
    assert [r.prediction for r in m.transform(spark.createDataFrame([(None,)], "a double")).collect()] == [None]
    none = least_squares(df.limit(0), ["a"], "y", "w")
    assert none.level is None and none.transform(df).filter("prediction IS NOT NULL").count() == 0
    flat = least_squares(df.filter("a = 3"), ["a"], "y", "w")
    assert flat.rank == 0 and flat.coefficients == [0.0] and flat.level == 7.0


def test_saved_exactly(spark, tmp_dir):
    m = LinearModel(["a", "b"], [0.1, -1e-300], [1 / 3, 1e300], 2 / 7, 2)
    m.save(spark, f"{tmp_dir}/m")
    assert LinearModel.load(spark, f"{tmp_dir}/m") == m
