"""Frames, frequency, lag, filling, smoothing, exponential weights, rolling windows."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tideline.operators import association, ewm, rolling
from tideline.operators.series import SeriesFrame, fit_spline, kalman
from tideline.sources.tables import from_arrays, from_pandas

N = None


def series(spark, values, freq="D"):
    days = pd.date_range("2024-01-01", periods=len(values), freq=freq)
    return SeriesFrame(spark.createDataFrame([(d.to_pydatetime(), v if v is None else float(v)) for d, v in zip(days, values, strict=True)], "ts timestamp, value double"), "ts")


def values(frame, column="value"):
    df = frame.df if isinstance(frame, SeriesFrame) else frame
    return [r[column] for r in df.orderBy(df.columns[0]).collect()]


@pytest.mark.parametrize("freq", ["D", "h", "15min", "2D", "MS", "ME", "B", "W-WED", "QS-OCT", "YS-JAN"])
def test_frequency_of_dates(spark, freq):
    assert series(spark, range(14), freq).freq == freq


def test_frequency_of_other_axes(spark):
    number = SeriesFrame(spark.createDataFrame([(i, 1.0) for i in (0, 2, 4, 6)], "idx long, v double"), "idx")
    assert number.freq == 2 and number.is_regular and number.dimension == "numeric"
    assert number.lag(4).start == 4
    with pytest.raises(ValueError):
        number.lag(3)
    odd = SeriesFrame(spark.createDataFrame([(i, 1.0) for i in (0, 2, 5)], "idx long, v double"), "idx")
    assert odd.freq == "irregular numeric"
    with pytest.raises(ValueError):
        odd.lag(1)
    text = SeriesFrame(spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "k string, v double"), "k")
    assert text.freq == "unknown" and text.is_regular and values(text.lag(1), "v") == [None, 1.0, 2.0]
    assert values(text.lag(-1), "v") == [2.0, 3.0, None]


def test_lag_moves_the_axis(spark):
    f = series(spark, [1, 2, 3, 4])
    assert f.lag(2).start == dt.datetime(2024, 1, 3) and values(f.lag(2)) == [1, 2, 3, 4]
    assert values(f) == [1, 2, 3, 4] and len(f) == 4
    with pytest.raises(AttributeError):
        f._nothing


@pytest.mark.parametrize(
    "method,limit,given,wanted",
    [
        ("mean", N, [1, N, 3, N, 5], [1, 3, 3, 3, 5]),
        ("median", N, [1, N, 3, N, 8], [1, 3, 3, 3, 8]),
        ("mean", 1, [N, 1, N, N, 4, N], [2.5, 1, N, N, 4, N]),
        ("ffill", N, [N, 1, N, N, 4], [N, 1, 1, 1, 4]),
        ("ffill", 1, [1, N, N, N, 5], [1, 1, N, N, 5]),
        ("bfill", N, [1, N, N, 4, N], [1, 4, 4, 4, N]),
        ("bfill", 1, [1, N, N, 4, 5], [1, N, 4, 4, 5]),
        ("linear", N, [N, 1, N, 3, N, 5, N], [N, 1, 2, 3, 4, 5, 5]),
        ("linear", 1, [1, N, N, 4, 5], [1, 2, N, 4, 5]),
        ("mean", N, [N, N, N], [N, N, N]),
    ],
)
def test_fill(spark, method, limit, given, wanted):
    assert values(series(spark, given).fill_missing(method, limit=limit)) == wanted


def test_unknown_methods(spark):
    with pytest.raises(ValueError, match="Unknown filling method"):
        series(spark, [1, 2]).fill_missing("guess")
    with pytest.raises(ValueError, match="Unknown smoothing method"):
        series(spark, [1, 2]).smooth("guess")


def test_fill_spline_of_a_polynomial(spark):
    got = values(series(spark, [1, N, 5, N, 5, 3, 2]).fill_missing("spline"))
    assert got[1] == pytest.approx(3.78, abs=0.02) and got[3] == pytest.approx(5.31, abs=0.02)


def test_spline_reaches_its_budget():
    x = np.linspace(0, 10, 200)
    y = np.sin(x) + np.random.RandomState(0).normal(0, 0.1, 200)
    f = fit_spline(x, y, 3, 2.5)
    assert ((f(x) - y) ** 2).sum() <= 2.5 and np.abs(f(x) - np.sin(x)).max() < 0.3


def test_rolling_mean_frames(spark):
    f = series(spark, [1, 2, 3, 4, 5])
    assert values(f.smooth("rolling_mean", 3)) == [1.5, 2, 3, 4, 4.5]
    assert values(f.smooth("rolling_mean", 3, center=False)) == [1, 1.5, 2, 3, 4]
    assert values(series(spark, range(6)).smooth("rolling_mean", 4)) == [0.5, 1, 1.5, 2.5, 3.5, 4]


def test_kalman(spark):
    y = [5, 5.1, N, 4.9, 5.2, N, N, 5]
    got = values(series(spark, y).smooth("kalman"))
    assert got == pytest.approx(kalman(np.array([np.nan if v is None else v for v in y]), 1e-5, 1e-2).tolist())
    assert got[2] == got[1] and all(v is not None for v in got)


def test_ewm_equals_pandas_also_over_blocks(spark):
    x = np.random.RandomState(0).normal(size=9000)
    frame = SeriesFrame(spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, x double"), "i")
    assert values(ewm.mean(frame, 0.9), "x") == pytest.approx(pd.Series(x).ewm(alpha=0.1).mean().tolist(), abs=1e-9)
    assert values(ewm.mean(frame, 1.0), "x")[-1] == pytest.approx(x.mean())


def test_ewm_std_and_correlation(spark):
    x = np.random.RandomState(1).normal(size=80)
    y = 0.5 * x + 0.1 * np.random.RandomState(2).normal(size=80)
    frame = SeriesFrame(spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "i long, x double, y double"), "i")
    m = pd.Series(x).ewm(alpha=0.05).mean()
    wanted = np.sqrt(((pd.Series(x) - m) ** 2).ewm(alpha=0.05).mean())
    assert values(ewm.std(frame, 0.95), "x") == pytest.approx(wanted.tolist(), abs=1e-9)
    r = ewm.correlation(frame, 0.95)
    assert values(r, "x_y") == values(r, "y_x") and values(r, "x_x")[-1] == pytest.approx(1) and values(r, "x_y")[-1] > 0.9 and values(r, "x_y")[0] == 0


def test_ewm_missing_values_and_calendar_steps(spark):
    f = SeriesFrame(spark.createDataFrame([(0, 1.0), (1, None), (2, 3.0)], "i long, x double"), "i")
    assert values(ewm.mean(f, 0.5), "x") == [1.0, None, None]
    assert values(ewm.mean(f, 0.5, propagate=False), "x") == [1.0, 1.0, pytest.approx((0.25 + 3) / 1.25)]
    with pytest.raises(ValueError):
        ewm.mean(series(spark, range(5), "MS"), 0.9)


def test_rolling_equals_pandas(spark):
    a, b = np.random.RandomState(2).normal(size=(2, 60))
    b = 0.3 * a + 0.7 * b
    frame = SeriesFrame(spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))], "i long, a double, b double"), "i")
    nan = lambda v: [None if np.isnan(x) else pytest.approx(x) for x in v]
    assert values(rolling.unary(frame, "std", 10), "a") == nan(pd.Series(a).rolling(10).std())
    assert values(rolling.unary(frame, lambda v: float(v.max() - v.min()), 10, python=True), "a") == nan(pd.Series(a).rolling(10).apply(lambda v: v.max() - v.min()))
    assert values(rolling.correlation(frame, window=10), "a>b") == nan(pd.Series(a).rolling(10).corr(pd.Series(b)))
    s = values(rolling.correlation(frame, association.SPEARMAN, 10), "b>a")
    assert s[20] == pytest.approx(pd.Series(a[11:21]).rank().corr(pd.Series(b[11:21]).rank()))
    auto = rolling.auto_correlation(frame, lags=3, window=10)
    assert "a_lag(2)>b" in auto.columns and values(auto, "a_lag(2)>b")[10] is None
    assert values(auto, "a_lag(2)>b")[30] == pytest.approx(np.corrcoef(a[19:29], b[21:31])[0, 1])


def test_keys_are_series_of_their_own(spark):
    rows = [(k, i, float(i * k)) for k in (1, 2) for i in range(6)]
    frame = SeriesFrame(spark.createDataFrame(rows, "k long, i long, x double"), "i", ["x"], ["k"])
    got = {(r["k"], r["i"]): r["x"] for r in frame.smooth("rolling_mean", 3, center=False).df.collect()}
    assert got[1, 5] == 4 and got[2, 5] == 8 and got[2, 0] == 0


def test_sources(spark):
    df = from_pandas(spark, pd.DataFrame({"x": [1.0, float("nan")]}, index=pd.date_range("2024-01-01", periods=2)))
    assert [r["x"] for r in df.orderBy("index").collect()] == [1.0, None]
    assert from_arrays(spark, np.eye(2), [1, 2]).count() == 2
    with pytest.raises(ValueError):
        from_arrays(spark, np.eye(2), [1])


def test_rank_windows_agree_with_single_frames(spark):
    import numpy as np

    from tideline.operators import association as A
    from tideline.operators import rolling

    rng = np.random.RandomState(8)
    rows = [(k, i, float(rng.randint(0, 6)), None if rng.uniform() < 0.05 else float(rng.normal())) for k in range(3) for i in range(40 if k else 4)]
    frame = SeriesFrame(spark.createDataFrame(rows, "g long, i long, a double, b double"), "i", ["a", "b"], ["g"])
    for metric in (A.SPEARMAN, A.KENDALL, A.XI, A.STEPANOV):
        whole = {(r["g"], r["i"]): tuple(r)[2:] for r in rolling.correlation(frame, metric, 7).collect()}
        one = {(r["g"], r["i"]): tuple(r)[2:] for r in rolling.correlation(frame, metric, 7, min_periods=6).collect()}
        known = {(k, i): [x[2:] for x in rows if x[0] == k and i - 7 < x[1] <= i] for k, i, _, _ in rows}
        assert len(whole) == len(rows)
        for at, held in known.items():
            full = len(held) == 7
            for c, (x, y) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1))):
                if full and all(h[x] is not None and h[y] is not None for h in held):
                    assert whole[at][c] == (None if one[at][c] is None else pytest.approx(one[at][c])), (metric.name, at, c)
                else:
                    assert whole[at][c] is None
