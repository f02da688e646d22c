"""Property tests: window operators against a plain-Python model on random
series (NULLs included)."""

from hypothesis import given, settings
from hypothesis import strategies as st

from marketweave.operators import windows as W

series = st.lists(st.one_of(st.none(), st.integers(-1000, 1000)), min_size=1, max_size=40)


def _df(spark, values):
    return spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)],
                                 "t int, v double")


@settings(max_examples=15, deadline=None)
@given(series)
def test_ffill_matches_model(spark, values):
    out = [r.v for r in W.ffill(_df(spark, values), ["v"], ["t"]).orderBy("t").collect()]
    last, expect = None, []
    for v in values:
        last = float(v) if v is not None else last
        expect.append(last)
    assert out == expect


@settings(max_examples=15, deadline=None)
@given(series, st.integers(1, 8))
def test_lag_and_full_rolling_mean_match_model(spark, values, n):
    df = W.rolling_mean_full(W.lag_rows(_df(spark, values), "v", n, ["t"], name="lag"),
                             "v", n, ["t"], name="m")
    rows = df.orderBy("t").collect()
    for i, r in enumerate(rows):
        assert r.lag == (None if i < n or values[i - n] is None else float(values[i - n]))
        frame = values[max(0, i - n + 1): i + 1]
        if len(frame) == n and all(v is not None for v in frame):
            assert abs(r.m - round(sum(frame) / n, 4)) < 1e-9
        else:
            assert r.m is None
