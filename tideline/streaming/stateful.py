"""Streaming forms: per-key state over arriving rows, the same numbers as the batch operators for rows in order.

Instants without a zone can't carry a watermark; they are cast to TIMESTAMP. Rows of a key are sorted
inside each micro-batch; rows older than the key's last one are dropped (late).
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tideline.operators.clustering import OnlineState, Rule
from tideline.operators.online import LOSSES, Learner


def timed(df: DataFrame, ts: str, delay: str = "10 minutes") -> DataFrame:
    """ts as TIMESTAMP with a watermark."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def keyed(df: DataFrame, keys: list[str], ts: str, start: Callable[[], object], step: Callable[[object, pd.Series], tuple], out: str, columns: list[str]) -> DataFrame:
    """Runs step(state, row) -> (state, values of `out`) over the rows of each key in order of ts; state is kept pickled.

    out: schema of the values, e.g. "smooth double". The result has keys, ts and the values.
    """
    types = dict(df.dtypes)
    names = [part.split()[0] for part in out.split(", ")]
    schema = "".join(f"`{k}` {types[k]}, " for k in keys) + f"`{ts}` {types[ts]}, {out}"

    def go(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, held = (pickle.loads(state.get[1]), state.get[0]) if state.exists else (start(), None)
        rows = pd.concat(list(batches)).sort_values(ts, kind="stable")
        if held is not None:
            rows = rows[rows[ts].astype("int64") >= held]
        made = []
        for row in rows.to_dict("records"):
            last, values = step(last, row)
            made.append((*key, row[ts], *values))
        if len(rows):
            state.update((int(rows[ts].astype("int64").iloc[-1]), pickle.dumps(last)))
        yield pd.DataFrame(made, columns=[*keys, ts, *names])

    return df.select(*keys, ts, *columns).groupBy(*keys).applyInPandasWithState(go, schema, "at long, state binary", "append", GroupStateTimeout.NoTimeout)


def kalman(df: DataFrame, keys: list[str], ts: str, value: str, q: float = 1e-5, r: float = 1e-2) -> DataFrame:
    """smooth: the random-walk filter of operators.series; missing before the first value."""

    def step(s, row):
        z = row[value]
        seen = z is not None and z == z
        if s is None:
            if not seen:
                return None, (None,)
            s = (z, 1.0)
        at, spread = s[0], s[1] + q
        if seen:
            gain = spread / (spread + r)
            at, spread = at + gain * (z - at), (1 - gain) * spread
        return (at, spread), (float(at),)

    return keyed(df, keys, ts, lambda: None, step, "smooth double", [value])


def ewm_mean(df: DataFrame, keys: list[str], ts: str, value: str, p: float) -> DataFrame:
    """ewm: the exponentially weighted mean with one period between rows; missing values are skipped but age the others."""

    def step(s, row):
        z = row[value]
        top, below = s[0] * p, s[1] * p
        if z is not None and z == z:
            top, below = top + z, below + 1
        return (top, below), (top / below if below else None,)

    return keyed(df, keys, ts, lambda: (0.0, 0.0), step, "ewm double", [value])


def learn(df: DataFrame, keys: list[str], ts: str, target: str, learner: Learner, features: str | None = None, loss: str = "squared") -> DataFrame:
    """prediction, loss, regret of a learner that is kept for each key (operators.online)."""
    import numpy as np

    f = LOSSES[loss]

    def step(own, row):
        x = np.asarray(row[features], float) if features else np.ones(1)
        p, y, v = own.predict(x), row[target], None
        if y is not None and y == y:
            v = f(p, float(y))
            own.learn(x, p, v, float(y))
        return own, (np.atleast_1d(p).astype(float).tolist(), None if v is None else float(np.mean(v)), float(own.regret))

    return keyed(df, keys, ts, learner.fresh, step, "prediction array<double>, loss double, regret double", [target, *([features] if features else [])])


def cluster(df: DataFrame, keys: list[str], ts: str, features: str, rule: Rule, start: OnlineState) -> DataFrame:
    """centers (flattened) after each row of an online clustering rule (operators.clustering), kept for each key."""
    import copy

    import numpy as np

    def step(s, row):
        rule(s, np.asarray(row[features], float))
        return s, (s.centers.ravel().tolist(),)

    return keyed(df, keys, ts, lambda: copy.deepcopy(start), step, "centers array<double>", [features])


def windowed(df: DataFrame, ts: str, every: str, keys: list[str], value: str, delay: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Tumbling or sliding windows with a watermark: count, mean, standard deviation by key."""
    w = F.window(ts, every, slide) if slide else F.window(ts, every)
    return timed(df, ts, delay).groupBy(w, *keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
