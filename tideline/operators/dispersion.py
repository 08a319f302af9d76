"""Dispersion aggregates; the same calling convention as `location`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.numeric import ratio, sample
from tideline.functions.scan import running
from tideline.operators import location
from tideline.operators.location import Keys, weighted_average


def _agg(rows: DataFrame, keys: Keys, value: Column) -> DataFrame:
    return (rows.groupBy(*keys) if keys else rows).agg(value.alias("value"))


def _beside(rows: DataFrame, small: DataFrame, keys: Keys) -> DataFrame:
    """Rows with their group's row of `small`, which has one row for each group (one in all without keys)."""
    return rows.join(small, list(keys)) if keys else rows.crossJoin(F.broadcast(small))


def mirror_variability(df: DataFrame, value: str, transform: Callable[[Column], Column], inverse: Callable[[Column], Column], centre: Callable[..., DataFrame] = location.mean, spread: Callable[..., DataFrame] = location.mean, bias: Callable[[Column], Column] | None = None, weight: str | None = None, keys: Keys = ()) -> DataFrame:
    """inverse(bias(spread(transform(|x - centre|)))): two passes, the centre is a row for each group."""
    w = None if weight is None else "w"
    rows = sample(df, value, weight, keys)
    off = _beside(rows, centre(rows, "x", w, keys).withColumnRenamed("value", "_c"), keys).withColumn("x", F.abs(F.col("x") - F.col("_c")))
    return location.mirror_centrality(off, "x", transform, inverse, spread, bias, w, keys)


def _std(rows: DataFrame, weight: str | None, keys: Keys) -> DataFrame:
    if weight is None:
        return _agg(rows, keys, F.stddev_samp("x"))
    m = _agg(rows, keys, weighted_average(F.col("x"), F.col("w"))).withColumnRenamed("value", "_m")
    off = _beside(rows, m, keys)
    n = F.count("x")
    square = weighted_average((F.col("x") - F.col("_m")) * (F.col("x") - F.col("_m")), F.col("w"))
    return _agg(off, keys, F.sqrt(ratio(n * square, n - 1)))


def std(df: DataFrame, value: str, weight: str | None = None, keys: Keys = ()) -> DataFrame:
    """sqrt(n / (n - 1) * weighted mean of squares about the weighted mean); NULL for fewer than two rows."""
    return _std(sample(df, value, weight, keys), weight, keys)


def variance(df: DataFrame, value: str, weight: str | None = None, keys: Keys = ()) -> DataFrame:
    return std(df, value, weight, keys).withColumn("value", F.col("value") * F.col("value"))


def quantile_spread(df: DataFrame, value: str, q0: float, q1: float | None = None, weight: str | None = None, keys: Keys = ()) -> DataFrame:
    """Distance of two quantiles; with q1 missing, q0 is the share of rows between them."""
    if q1 is None:
        q0 = (1 - q0) / 2
        q1 = 1 - q0
    out = location.quantiles(df, value, [q0, q1], weight, keys)
    return out.select(*keys, (F.col("values")[1] - F.col("values")[0]).alias("value"))


def iqr(df: DataFrame, value: str, weight: str | None = None, keys: Keys = ()) -> DataFrame:
    return quantile_spread(df, value, 0.25, 0.75, weight, keys)


def decile_range(df: DataFrame, value: str, weight: str | None = None, keys: Keys = ()) -> DataFrame:
    return quantile_spread(df, value, 0.1, 0.9, weight, keys)


def semi_interquartile_range(df: DataFrame, value: str, weight: str | None = None, keys: Keys = ()) -> DataFrame:
    return iqr(df, value, weight, keys).withColumn("value", F.col("value") / 2)


def normalized_iqr(df: DataFrame, value: str, weight: str | None = None, keys: Keys = ()) -> DataFrame:
    """iqr / |median|; NULL for a median of 0."""
    out = location.quantiles(df, value, [0.25, 0.5, 0.75], weight, keys)
    v = F.col("values")
    return out.select(*keys, ratio(v[2] - v[0], F.abs(v[1])).alias("value"))


def mad(df: DataFrame, value: str, weight: str | None = None, keys: Keys = ()) -> DataFrame:
    """Mean absolute deviation about the mean."""
    same = lambda c: c
    return mirror_variability(df, value, same, same, weight=weight, keys=keys)


def median_absolute_deviation(df: DataFrame, value: str, weight: str | None = None, keys: Keys = ()) -> DataFrame:
    """Median of |x - median|, not scaled."""
    same = lambda c: c
    return mirror_variability(df, value, same, same, location.median, location.median, None, weight, keys)


def coefficient_of_variation(df: DataFrame, value: str, weight: str | None = None, keys: Keys = ()) -> DataFrame:
    """std / |mean|; NULL for a mean of 0."""
    rows = sample(df, value, weight, keys)
    if weight is None:
        return _agg(rows, keys, ratio(F.stddev_samp("x"), F.abs(F.avg("x"))))
    m = location.mean(df, value, weight, keys).withColumnRenamed("value", "_m")
    return _beside(std(df, value, weight, keys), m, keys).select(*keys, ratio(F.col("value"), F.abs("_m")).alias("value"))


def data_range(df: DataFrame, value: str, weight: str | None = None, keys: Keys = ()) -> DataFrame:
    return _agg(sample(df, value, None, keys), keys, F.max("x") - F.min("x"))


def gini_coefficient(df: DataFrame, value: str, weight: str | None = None, keys: Keys = ()) -> DataFrame:
    """2 sum(i x_(i)) / (n sum x) - (n + 1) / n; weights aren't supported."""
    if weight is not None:
        raise NotImplementedError("gini_coefficient has no weighted form")
    ranked = running(sample(df, value, None, keys), ["x"], {}, keys)
    n, total = F.count("x"), F.sum("x")
    return _agg(ranked, keys, ratio(2 * F.sum(F.col("rn") * F.col("x")), n * total) - (n + 1) / n)
