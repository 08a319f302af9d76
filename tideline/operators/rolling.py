"""Rolling statistics over row or time windows."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.numeric import number, ratio
from tideline.operators.association import PEARSON, Metric, discordant, tau_b, tied
from tideline.operators.series import SeriesFrame, fixed_length

#: Window forms of aggregates that have one.
NATIVE: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "std": F.stddev_samp,
    "variance": F.var_samp,
    "median": lambda x: F.percentile(x, F.lit(0.5)),
    "iqr": None,
}


def _frame(frame: SeriesFrame, window: int | str):
    """(window, least number of values): rows, or a duration that is open on the left."""
    if isinstance(window, int):
        return frame.window.rowsBetween(1 - window, 0), window
    micros = fixed_length(re.sub(r"\s", "", window))
    if micros is None:
        raise ValueError(f"not a duration: {window}")
    by_time = Window.partitionBy(*frame.keys).orderBy(frame.position().cast("long"))
    return by_time.rangeBetween(1 - micros, 0), 1


def unary(frame: SeriesFrame, metric: str | Callable[[Column], Column] | Callable[[pd.Series], float], window: int | str, min_periods: int | None = None, python: bool = False) -> DataFrame:
    """metric of each value column over the last `window` rows or duration ('7D'); missing until min_periods values are there.

    metric: a name of NATIVE, a function of a Column that gives an aggregate, or (python) a function of
    a pandas Series, which runs as a grouped-aggregate pandas UDF over the frame.
    """
    w, least = _frame(frame, window)
    least = least if min_periods is None else min_periods
    if python:
        build = F.pandas_udf(_as_udaf(metric), "double")
    elif metric == "iqr":
        build = lambda x: None
    else:
        build = NATIVE[metric] if isinstance(metric, str) else metric

    def value(c: str) -> Column:
        x = number(c)
        v = F.percentile(x, F.lit(0.75)).over(w) - F.percentile(x, F.lit(0.25)).over(w) if metric == "iqr" else build(x).over(w)
        return F.when(F.count(x).over(w) >= least, v).alias(c)

    return frame.df.select(*frame.keys, frame.order, *[value(c) for c in frame.values])


def _as_udaf(function: Callable[[pd.Series], float]):
    def over(v: pd.Series) -> float:
        v = v.dropna()
        return float(function(v)) if len(v) else float("nan")

    return over


def _rank_udaf(metric: Metric):
    """A pair metric over a frame, in pandas: ranks change with every frame, so there is no running form."""
    name = metric.name

    def over(a: pd.Series, b: pd.Series) -> float:
        ok = a.notna() & b.notna()
        a, b = a[ok], b[ok]
        n = len(a)
        if n < 2:
            return float("nan")
        tau = rho = float("nan")
        if name in ("spearman", "stepanov"):
            rho = np.corrcoef(a.rank(), b.rank())[0, 1] if a.nunique() > 1 and b.nunique() > 1 else float("nan")
        if name in ("kendall", "stepanov"):
            x, y = a.to_numpy(), b.to_numpy()
            tau = tau_b(n, discordant(x, y), tied(x)[0], tied(y)[0], tied(x, y)[0])[1]
            tau = float("nan") if tau is None else tau
        if name == "xi":
            y = b.to_numpy()[np.argsort(a.to_numpy(), kind="stable")]
            r = np.searchsorted(np.sort(y), y, side="right")
            m = n - np.searchsorted(np.sort(y), y, side="left")
            below = 2 * (m * (n - m)).sum()
            return float(1 - n * np.abs(np.diff(r)).sum() / below) if below else float("nan")
        return float({"spearman": rho, "kendall": tau, "stepanov": (3 * tau - rho) / 2}[name])

    return F.pandas_udf(over, "double")


def _pair(metric: Metric, a: Column, b: Column, w, least: int) -> Column:
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    if metric is PEARSON:
        v = ratio(F.covar_pop(x, y).over(w), F.stddev_pop(x).over(w) * F.stddev_pop(y).over(w))
    else:
        v = F.nanvl(_rank_udaf(metric)(x, y).over(w), F.lit(None).cast("double"))
    return F.when(F.count(x).over(w) >= least, v)


#: Comparisons of two values of a window that are held at once.
HELD = 4_000_000


def _window_values(name: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A rank metric of each row of x and y (windows by values, none missing), by comparing all values of a window; NaN where one is constant."""
    out = np.empty(len(x))
    step = max(1, HELD // (x.shape[1] ** 2 if len(x) else 1))
    for i in range(0, len(x), step):
        out[i : i + step] = _compared(name, x[i : i + step], y[i : i + step])
    return out


def _compared(name: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    n = x.shape[1]
    with np.errstate(divide="ignore", invalid="ignore"):
        if name == "xi":
            order = np.argsort(x, axis=1, kind="stable")
            y = np.take_along_axis(y, order, axis=1)
            upto, from_ = (y[:, None, :] <= y[:, :, None]).sum(axis=2), (y[:, None, :] >= y[:, :, None]).sum(axis=2)
            below = 2.0 * (from_ * (n - from_)).sum(axis=1)
            return np.where(below > 0, 1 - n * np.abs(np.diff(upto, axis=1)).sum(axis=1) / below, np.nan)
        sx, sy = (np.sign(v[:, :, None] - v[:, None, :]) for v in (x, y))
        # mean ranks less their mean are half the sums of the signs
        rx, ry = sx.sum(axis=2), sy.sum(axis=2)
        rho = (rx * ry).sum(axis=1) / np.sqrt((rx**2).sum(axis=1) * (ry**2).sum(axis=1))
        tau = (sx * sy).sum(axis=(1, 2)) / np.sqrt((sx**2).sum(axis=(1, 2)) * (sy**2).sum(axis=(1, 2)))
    return {"spearman": rho, "kendall": tau, "stepanov": (3 * tau - rho) / 2}[name]


def _rank_windows(frame: SeriesFrame, pairs: dict[str, tuple[str, str]], metric: Metric, window: int) -> DataFrame:
    """keys, order and for each name the metric of a pair of columns over full windows without missing values, else NULL: a series at a time, all its windows at once."""
    keys, order, name = frame.keys, frame.order, metric.name
    columns = sorted({c for p in pairs.values() for c in p})
    rows = frame.df.select(*keys, order, *[number(c).alias(c) for c in columns])
    types = dict(rows.dtypes)

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        out = pdf[[*keys, order]].copy()
        views = {}
        for c in columns:
            values = pdf[c].to_numpy(float)
            views[c] = np.lib.stride_tricks.sliding_window_view(values, window) if len(values) >= window else np.empty((0, window))
        for made, (a, b) in pairs.items():
            found = np.full(len(pdf), np.nan)
            x, y = views[a], views[b]
            whole = np.flatnonzero(~(np.isnan(x) | np.isnan(y)).any(axis=1))
            found[window - 1 + whole] = _window_values(name, x[whole], y[whole])
            out[made] = found
        return out

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in [*keys, order]), *(f"`{m}` double" for m in pairs)])
    out = rows.groupBy(*keys).applyInPandas(go, schema)
    return out.withColumns({m: F.nanvl(F.col(f"`{m}`"), F.lit(None).cast("double")) for m in pairs})


def correlation(frame: SeriesFrame, metric: Metric = PEARSON, window: int | str = 10, min_periods: int | None = None) -> DataFrame:
    """Columns {a}>{b} for all ordered pairs, each with itself too; symmetric metrics are computed once a pair.

    Rank metrics over full windows of rows are computed a series at a time; over durations, or with
    fewer values than the window, by a pandas function for each frame.
    """
    w, least = _frame(frame, window)
    least = least if min_periods is None else min_periods
    v = frame.values
    if metric is not PEARSON and isinstance(window, int) and least == window and metric.name in ("spearman", "kendall", "stepanov", "xi"):
        wanted = {f"_r{i}_{j}": (a, b) for i, a in enumerate(v) for j, b in enumerate(v) if j >= i or not metric.symmetric}
        out = _rank_windows(frame, wanted, metric, window)
        own = lambda i, j: f"_r{i}_{j}" if f"_r{i}_{j}" in wanted else f"_r{j}_{i}"
        return out.select(*frame.keys, frame.order, *[F.col(own(i, j)).alias(f"{a}>{b}") for i, a in enumerate(v) for j, b in enumerate(v)])
    made = {}
    for i, a in enumerate(v):
        for j, b in enumerate(v):
            if j >= i or not metric.symmetric:
                made[f"_r{i}_{j}"] = _pair(metric, number(a), number(b), w, least)
    out = frame.df.select(*frame.keys, frame.order, *[c.alias(n) for n, c in made.items()])
    place = lambda i, j: f"_r{i}_{j}" if f"_r{i}_{j}" in made else f"_r{j}_{i}"
    return out.select(*frame.keys, frame.order, *[F.col(place(i, j)).alias(f"{a}>{b}") for i, a in enumerate(v) for j, b in enumerate(v)])


def auto_correlation(frame: SeriesFrame, metric: Metric = PEARSON, lags: int | list[int] = 3, window: int | str = 10, min_periods: int | None = None) -> DataFrame:
    """Columns {a}_lag({k})>{b}: metric of a, k rows before, and b. An int means lags 0 .. lags - 1; frames that reach before the start are missing."""
    w, least = _frame(frame, window)
    least = least if min_periods is None else min_periods
    steps = list(range(lags)) if isinstance(lags, int) else list(lags)
    v = frame.values
    base = frame.df.withColumns({f"_l{i}_{k}": F.lag(number(a), k).over(frame.window) for i, a in enumerate(v) for k in steps})
    cols = [_pair(metric, F.col(f"_l{i}_{k}"), number(b), w, least).alias(f"{a}_lag({k})>{b}") for i, a in enumerate(v) for k in steps for b in v]
    return base.select(*frame.keys, frame.order, *cols)
