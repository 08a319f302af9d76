"""Exponentially weighted statistics: weights p ** (distance along the axis).

The sums of f(row) p ** (-tau) overflow on long series. The axis is cut into blocks in which the weight
falls by exp(-BLOCK); sums run inside a block from its own base, and the totals of the block before are
carried in (older ones weigh nothing in double precision). So even one long series is spread over tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.numeric import number
from tideline.operators.series import IRREGULAR_TIME, NUMERIC, TIME, SeriesFrame, fixed_length

BLOCK = 300.0


def _distance(frame: SeriesFrame) -> tuple[DataFrame, Column]:
    """df with _tau: place on the axis from the first row, in periods."""
    df = frame.df
    if frame.dimension == TIME:
        if frame.freq == IRREGULAR_TIME or fixed_length(str(frame.freq)) is None:
            raise ValueError(f"exponential weights need periods of fixed length, not {frame.freq}")
        unit = float(fixed_length(str(frame.freq)))
    elif frame.dimension == NUMERIC:
        unit = float(frame.freq) if frame.is_regular else 1.0
    else:
        return df.withColumn("_tau", (F.row_number().over(frame.window) - 1).cast("double")), F.col("_tau")
    df = df.withColumn("_p", frame.position().cast("double"))
    if frame.keys:
        first = F.min("_p").over(Window.partitionBy(*frame.keys))
    else:
        first = F.lit(df.agg(F.min("_p")).first()[0] or 0.0)
    return df.withColumn("_tau", (F.col("_p") - first) / unit).drop("_p"), F.col("_tau")


def transform_estimator(frame: SeriesFrame, made: dict[str, Column], p: float = 1.0, propagate: bool = True) -> DataFrame:
    """The exponentially weighted mean of each Column of `made` at every row, as columns of its name beside keys and order.

    0 < p <= 1. With propagate, a missing value makes all later results of its column missing; else it
    is skipped (its weight too).
    """
    if not 0 < p <= 1:
        raise ValueError("p must be in (0, 1]")
    df, tau = _distance(frame)
    keys, order = frame.keys, frame.order
    rate = -math.log(p)
    names = list(made)
    rows = df.select(*[F.col(f"`{c}`") for c in frame.df.columns], tau.alias("_tau"), *[made[n].alias(f"_f{i}") for i, n in enumerate(names)])
    rows = rows.withColumn("_block", F.floor(F.col("_tau") * rate / BLOCK) if rate > 0 else F.lit(0).cast("long"))
    grow = F.exp((F.col("_tau") * rate) - F.col("_block") * BLOCK) if rate > 0 else F.lit(1.0)
    rows = rows.withColumn("_g", grow)
    sums: dict[str, Column] = {}
    for i in range(len(names)):
        f = F.col(f"_f{i}")
        sums |= {f"_s{i}": F.when(f.isNotNull(), f * F.col("_g")), f"_n{i}": F.when(f.isNotNull(), F.col("_g"))}
    rows = rows.withColumns(sums)
    inside = Window.partitionBy(*keys, "_block").orderBy(F.col(f"`{order}`"))
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    run = {f"{s}_r": F.coalesce(F.sum(s).over(upto), F.lit(0.0)) for s in sums}
    out = rows.withColumns(run)
    if rate > 0:
        totals = rows.groupBy(*keys, (F.col("_block") + 1).alias("_block")).agg(*[(F.coalesce(F.sum(s), F.lit(0.0)) * math.exp(-BLOCK)).alias(f"{s}_c") for s in sums])
        out = out.join(totals, [*keys, "_block"], "left")
    else:
        out = out.withColumns({f"{s}_c": F.lit(0.0) for s in sums})
    value = {}
    for i, n in enumerate(names):
        top = F.col(f"_s{i}_r") + F.coalesce(F.col(f"_s{i}_c"), F.lit(0.0))
        below = F.col(f"_n{i}_r") + F.coalesce(F.col(f"_n{i}_c"), F.lit(0.0))
        value[n] = F.when(below > 0, top / below)
    if propagate:
        first = rows.groupBy(*keys).agg(*[F.min(F.when(F.col(f"_f{i}").isNull(), F.col("_tau"))).alias(f"_x{i}") for i in range(len(names))])
        out = out.join(first, keys) if keys else out.crossJoin(F.broadcast(first))  # one row
        value = {n: F.when(F.col(f"_x{i}").isNull() | (F.col("_tau") < F.col(f"_x{i}")), v) for i, (n, v) in enumerate(value.items())}
    return out.select(*keys, F.col(f"`{order}`"), *[F.col(f"`{c}`") for c in frame.df.columns if c not in (*keys, order) and c not in value], *[v.alias(n) for n, v in value.items()])


def _only(frame: SeriesFrame, out: DataFrame, names: list[str]) -> DataFrame:
    return out.select(*frame.keys, frame.order, *[F.col(f"`{n}`") for n in names])


def moment(frame: SeriesFrame, p: float = 1.0, power: float = 1.0, absolute: bool = False, propagate: bool = True) -> DataFrame:
    """Exponentially weighted mean of x ** power or |x| ** power of each value column."""
    f: Callable[[Column], Column] = lambda x: F.pow(F.abs(x) if absolute else x, F.lit(power))
    made = {c: (number(c) if power == 1 and not absolute else f(number(c))) for c in frame.values}
    return _only(frame, transform_estimator(frame, made, p, propagate), frame.values)


def mean(frame: SeriesFrame, p: float = 1.0, propagate: bool = True) -> DataFrame:
    return moment(frame, p, propagate=propagate)


def _centred(frame: SeriesFrame, p: float, propagate: bool) -> SeriesFrame:
    """The frame with _e0, _e1, ...: each value less the weighted mean up to its own row."""
    means = transform_estimator(frame, {f"_m{i}": number(c) for i, c in enumerate(frame.values)}, p, propagate)
    means = means.withColumns({f"_e{i}": number(c) - F.col(f"_m{i}") for i, c in enumerate(frame.values)})
    return SeriesFrame(means, frame.order, frame.values, frame.keys, frame.freq)


def std(frame: SeriesFrame, p: float = 1.0, propagate: bool = True) -> DataFrame:
    """Root of the weighted mean of squared deviations, each from the mean of its own time."""
    e = _centred(frame, p, propagate)
    out = transform_estimator(e, {c: F.col(f"_e{i}") * F.col(f"_e{i}") for i, c in enumerate(frame.values)}, p, propagate)
    return _only(frame, out.withColumns({c: F.sqrt(F.col(f"`{c}`")) for c in frame.values}), frame.values)


def _products(frame: SeriesFrame, p: float, propagate: bool) -> DataFrame:
    e = _centred(frame, p, propagate)
    m = len(frame.values)
    return transform_estimator(e, {f"_p{i}_{j}": F.col(f"_e{i}") * F.col(f"_e{j}") for i in range(m) for j in range(i, m)}, p, propagate)


def covariance(frame: SeriesFrame, p: float = 1.0, propagate: bool = True) -> DataFrame:
    """Columns {a}_{b} for all ordered pairs; the lower triangle repeats the upper one."""
    out = _products(frame, p, propagate)
    cols = [F.col(f"_p{min(i, j)}_{max(i, j)}").alias(f"{a}_{b}") for i, a in enumerate(frame.values) for j, b in enumerate(frame.values)]
    return out.select(*frame.keys, frame.order, *cols)


def correlation(frame: SeriesFrame, p: float = 1.0, propagate: bool = True) -> DataFrame:
    """Covariances over products of deviations; a product of 0 counts as 1e-12."""
    out = _products(frame, p, propagate)

    def r(i: int, j: int) -> Column:
        below = F.sqrt(F.col(f"_p{i}_{i}")) * F.sqrt(F.col(f"_p{j}_{j}"))
        return F.col(f"_p{min(i, j)}_{max(i, j)}") / F.when(below == 0, F.lit(1e-12)).otherwise(below)

    cols = [r(i, j).alias(f"{a}_{b}") for i, a in enumerate(frame.values) for j, b in enumerate(frame.values)]
    return out.select(*frame.keys, frame.order, *cols)
