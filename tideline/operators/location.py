"""Location aggregates, unweighted and weighted, of a whole table or for each group.

Every function takes (df, value, weight=None, keys=()) and returns a row for each group with the keys and
`value`. NULL and NaN values are skipped. Sums are one aggregate with partial sums; what needs an order
uses `functions.scan`, so a table without groups is no single-task window.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.numeric import number, ratio, sample
from tideline.functions.scan import bucketed, running

Keys = list[str] | tuple[str, ...]
#: Rows from which on a quantile of a whole table is selected in a few scans instead of a map of all values.
SELECT_ROWS = 5_000_000


def _agg(rows: DataFrame, keys: Keys, value: Column) -> DataFrame:
    return (rows.groupBy(*keys) if keys else rows).agg(value.alias("value"))


def weighted_average(x: Column, w: Column) -> Column:
    return ratio(F.sum(w * x), F.sum(w))


def mean(df: DataFrame, value: str, weight: str | None = None, keys: Keys = ()) -> DataFrame:
    rows = sample(df, value, weight, keys)
    return _agg(rows, keys, F.avg("x") if weight is None else weighted_average(F.col("x"), F.col("w")))


def _check_weights(rows: DataFrame) -> None:
    low, total = rows.agg(F.min("w"), F.sum("w")).first()
    if low is not None and (low < 0 or total <= 0):
        raise ValueError("weights must not be negative and must have a positive sum")


def quantiles(df: DataFrame, value: str, q: list[float], weight: str | None = None, keys: Keys = ()) -> DataFrame:
    """Exact quantiles as an array `values`, one for each q (clamped to 0 .. 1).

    Unweighted: linear between order statistics. Weighted: on the cumulated share of weights, between
    the last share below q and the first not below; ties are ordered by weight.
    """
    q = [min(1.0, max(0.0, float(x))) for x in q]
    rows = sample(df, value, weight, keys)
    if weight is None:
        if not keys and (found := rows.agg(*ends(["x"])).first())[0] > SELECT_ROWS:
            return _selected(rows, q, found)
        return (rows.groupBy(*keys) if keys else rows).agg(F.percentile("x", F.array(*[F.lit(x) for x in q])).alias("values"))
    _check_weights(rows)
    keys = list(keys)
    share = running(rows, ["x", "w"], {"c": "w"}, keys).withColumn("s", F.col("c") / F.col("c_total"))
    grouped = share.groupBy(*keys) if keys else share
    parts = []
    for i, x in enumerate(q):
        reached = F.col("s") >= x - 1e-15
        after = F.min(F.when(reached, F.struct("rn", "s", "x")))
        before = F.max(F.when(~reached, F.struct("rn", "s", "x")))
        parts += [after.alias(f"a{i}"), before.alias(f"b{i}")]
    found = grouped.agg(*parts, F.max("x").alias("top"))

    def at(i: int, x: float) -> Column:
        a, b = F.col(f"a{i}"), F.col(f"b{i}")
        between = b["x"] + (a["x"] - b["x"]) * ratio(x - b["s"], a["s"] - b["s"])
        return F.coalesce(F.when(b.isNull(), a["x"]), between, F.col("top"))

    return found.select(*keys, F.array(*[at(i, x) for i, x in enumerate(q)]).alias("values"))


def _selected(rows: DataFrame, q: list[float], known: Sequence[float] | None = None) -> DataFrame:
    found = selected(rows, ["x"], q, known)["x"]
    return rows.sparkSession.range(1).select(F.array(*[F.lit(v) for v in found]).alias("values"))


#: Rows of a bracket from which on it is cut instead of read, and buckets of all brackets of one pass (at least 1024 each).
BRACKET_ROWS = 100_000
CUTS = 65_536


@dataclass(frozen=True)
class _Bracket:
    """Values of a column between low and high: the rows below, the rows inside, and whether the last cut took few of them away."""

    column: str
    low: float
    high: float
    below: int
    inside: int
    stuck: bool = False

    def has(self) -> Column:
        return F.col(self.column).between(F.lit(self.low), F.lit(self.high))

    def bucket(self, n: int) -> Column:
        """A number 0 .. n - 1 that doesn't fall as values grow, different at both ends: equal widths, if stuck signs and then logarithms."""
        x, low, high = F.col(self.column), self.low, self.high
        if math.isinf(low) or math.isinf(high):
            return F.when(x == F.lit(low), 0).when(x == F.lit(high), 2).otherwise(1)
        if self.stuck and low <= 0 <= high:
            return F.signum(x).cast("int") + 1
        if self.stuck and max(abs(low), abs(high)) / min(abs(low), abs(high)) > n:
            sign = 1.0 if low > 0 else -1.0
            x, low, high = F.log2(F.abs(x)) * sign, math.log2(abs(low)) * sign, math.log2(abs(high)) * sign
        scale = 0.5 if math.isinf(high - low) else 1.0
        share = (x * scale - low * scale) / (high * scale - low * scale)
        return F.greatest(F.least(F.floor(share * n), F.lit(n - 1)), F.lit(0)).cast("int")


def _inside(rows: DataFrame, brackets: list[_Bracket], key: Callable[[int, _Bracket], Column]) -> DataFrame:
    """Rows (k, x) of the values in brackets, of all columns in one scan; brackets of a column don't overlap."""
    parts = []
    for c in sorted({b.column for b in brackets}):
        k = F.lit(None).cast("int")
        for i, b in enumerate(brackets):
            if b.column == c:
                k = F.when(b.has(), key(i, b)).otherwise(k)
        parts.append(F.struct(k.alias("k"), F.col(c).alias("x")))
    return rows.select(F.explode(F.array(*parts)).alias("s")).select("s.*").where("k IS NOT NULL")


def ends(columns: list[str] | list[Column]) -> list[Column]:
    """Aggregates that `selected` starts from: number of values, least and greatest one of each column in turn."""
    return [f(c) for c in columns for f in (F.count, F.min, F.max)]


def selected(df: DataFrame, columns: list[str], q: list[float], known: Sequence[float] | None = None) -> dict[str, list[float | None]]:
    """Exact quantiles of numeric columns of a large table, all columns at once, in a few scans without any sort or sketch.

    Wanted ranks lie in brackets, at first from the least to the greatest value. A scan counts the rows
    in buckets of all brackets, with the least and greatest value of each, and the bucket of a rank
    is its next bracket. One of a single value is done; the values of one of at most BRACKET_ROWS
    are read with their counts. An empty column has None. known: the `ends` of the columns as numbers,
    where an earlier scan has found them.
    """
    names = {c: f"v{i}" for i, c in enumerate(columns)}
    rows = df.select(*[number(c).alias(v) for c, v in names.items()])
    known = rows.agg(*ends(list(names.values()))).first() if known is None else known
    n = dict(zip(names.values(), known[::3], strict=True))
    value: dict[tuple[str, int], float] = {}
    wanted: dict[_Bracket, set[int]] = {}

    def put(b: _Bracket, ranks: set[int]) -> None:
        if b.low == b.high:
            value.update({(b.column, r): b.low for r in ranks})
        elif ranks:
            wanted.setdefault(b, set()).update(ranks)

    for v, low, high in zip(names.values(), known[1::3], known[2::3], strict=True):
        put(_Bracket(v, low, high, 0, n[v]), {f((n[v] - 1) * x) for x in q for f in (math.floor, math.ceil)} if n[v] else set())
    while wanted:
        ready = [b for b in wanted if b.inside <= BRACKET_ROWS]
        held = _inside(rows, ready, lambda i, b: F.lit(i)).groupBy("k", "x").count().collect() if ready else []
        found: dict[int, list[tuple[float, int]]] = {}
        for i, x, m in held:
            found.setdefault(i, []).append((x, m))
        for i, b in enumerate(ready):
            ranks, upto = sorted(wanted.pop(b)), b.below
            for x, m in sorted(found[i]):
                upto += m
                while ranks and upto > ranks[0]:
                    value[b.column, ranks.pop(0)] = x
        wide, wanted_before = list(wanted), wanted
        if not wide:
            break
        wanted, each = {}, max(1024, CUTS // len(wide))
        counts = _inside(rows, wide, lambda i, b: b.bucket(each) + F.lit(i * each)).groupBy("k").agg(F.count("x"), F.min("x"), F.max("x")).collect()  # noqa: B023
        below = {i: b.below for i, b in enumerate(wide)}
        for k, m, low, high in sorted(map(tuple, counts)):
            b, upto = wide[k // each], below[k // each]
            put(_Bracket(b.column, low, high, upto, m, m * 8 > b.inside), {r for r in wanted_before[b] if upto <= r < upto + m})
            below[k // each] = upto + m

    def at(v: str, x: float) -> float | None:
        if not n[v]:
            return None
        k = (n[v] - 1) * x
        a, b = value[v, math.floor(k)], value[v, math.ceil(k)]
        return a if a == b else a + (b - a) * (k - math.floor(k))

    return {c: [at(v, x) for x in q] for c, v in names.items()}


def quantile(df: DataFrame, value: str, q: float, weight: str | None = None, keys: Keys = ()) -> DataFrame:
    out = quantiles(df, value, [q], weight, keys)
    return out.select(*keys, F.col("values")[0].alias("value"))


def median(df: DataFrame, value: str, weight: str | None = None, keys: Keys = ()) -> DataFrame:
    return quantile(df, value, 0.5, weight, keys)


def lower_quartile(df: DataFrame, value: str, weight: str | None = None, keys: Keys = ()) -> DataFrame:
    return quantile(df, value, 0.25, weight, keys)


def upper_quartile(df: DataFrame, value: str, weight: str | None = None, keys: Keys = ()) -> DataFrame:
    return quantile(df, value, 0.75, weight, keys)


def minimum(df: DataFrame, value: str, weight: str | None = None, keys: Keys = ()) -> DataFrame:
    """Weights have no influence."""
    return _agg(sample(df, value, None, keys), keys, F.min("x"))


def maximum(df: DataFrame, value: str, weight: str | None = None, keys: Keys = ()) -> DataFrame:
    return _agg(sample(df, value, None, keys), keys, F.max("x"))


def midrange(df: DataFrame, value: str, weight: str | None = None, keys: Keys = ()) -> DataFrame:
    return _agg(sample(df, value, None, keys), keys, (F.min("x") + F.max("x")) / 2)


def mode(df: DataFrame, value: str, weight: str | None = None, keys: Keys = ()) -> DataFrame:
    """The value with the most weight, of any type; the smallest of several. Counted by value first, then picked by partial maxima."""
    keys = list(keys)
    w = F.lit(1.0) if weight is None else F.col(f"`{weight}`").cast("double")
    v = F.col(f"`{value}`")
    if dict(df.dtypes)[value] in ("double", "float"):
        v = F.when(~F.isnan(v), v)
    by_value = df.select(*keys, v.alias("x"), w.alias("w")).where("x IS NOT NULL").groupBy(*keys, "x").agg(F.sum("w").alias("w"))
    most = (by_value.groupBy(*keys) if keys else by_value).agg(F.max("w").alias("most"))
    hit = by_value.join(most, keys) if keys else by_value.crossJoin(F.broadcast(most))  # one row
    return (hit.where("w = most").groupBy(*keys) if keys else hit.where("w = most")).agg(F.min("x").alias("value"))


def mirror_centrality(df: DataFrame, value: str, transform: Callable[[Column], Column], inverse: Callable[[Column], Column], centrality: Callable[..., DataFrame] = mean, bias: Callable[[Column], Column] | None = None, weight: str | None = None, keys: Keys = ()) -> DataFrame:
    """inverse(bias(centrality(transform(x)))): a quasi-arithmetic mean from Column functions."""
    rows = sample(df, value, weight, keys).withColumn("x", transform(F.col("x")))
    m = centrality(rows, "x", None if weight is None else "w", keys)
    v = F.col("value") if bias is None else bias(F.col("value"))
    return m.select(*keys, inverse(v).alias("value"))


def geometric_mean(df: DataFrame, value: str, weight: str | None = None, keys: Keys = ()) -> DataFrame:
    """exp of the mean logarithm; 0 if any value with weight is 0, NULL if one is negative."""
    rows = sample(df, value, weight, keys)
    x, w = F.col("x"), F.col("w")
    logs = weighted_average(F.when(x > 0, F.ln(x)), F.when(x > 0, w))
    low = F.min(F.when(w > 0, x))
    return _agg(rows, keys, F.when(low > 0, F.exp(logs)).when(low == 0, 0.0))


def _trimmed_rows(df: DataFrame, value: str, trim: float, weight: str | None, keys: Keys) -> DataFrame:
    if not 0 <= trim < 0.5:
        raise ValueError("trim must be in [0, 0.5)")
    ranked = running(sample(df, value, weight, keys), ["x", "w"], {}, keys)
    k = F.floor(F.col("n") * trim)
    return ranked.where((F.col("rn") > k) & (F.col("rn") <= F.col("n") - k)).select(*keys, "x", "w")


def trimmed_centrality(df: DataFrame, value: str, centrality: Callable[..., DataFrame], trim: float = 0.1, weight: str | None = None, keys: Keys = ()) -> DataFrame:
    """centrality of what is left when floor(n * trim) rows are dropped from each tail; weights go with their rows."""
    return centrality(_trimmed_rows(df, value, trim, weight, keys), "x", None if weight is None else "w", keys)


def trimmed_mean(df: DataFrame, value: str, trim: float = 0.1, weight: str | None = None, keys: Keys = ()) -> DataFrame:
    return trimmed_centrality(df, value, mean, trim, weight, keys)


def winsorized_centrality(df: DataFrame, value: str, centrality: Callable[..., DataFrame], limits: float = 0.1, weight: str | None = None, keys: Keys = ()) -> DataFrame:
    """centrality of the values clipped to the (weighted) quantiles limits and 1 - limits."""
    if not 0 <= limits <= 0.5:
        raise ValueError("limits must be in [0, 0.5]")
    rows, keys = sample(df, value, weight, keys), list(keys)
    edge = quantiles(df, value, [limits, 1 - limits], weight, keys)
    # a row for each group: joined by the keys; a table without groups has one row
    both = rows.join(edge, keys) if keys else rows.crossJoin(F.broadcast(edge))
    clipped = both.withColumn("x", F.greatest(F.least("x", F.col("values")[1]), F.col("values")[0]))
    return centrality(clipped, "x", None if weight is None else "w", keys)


def winsorized_mean(df: DataFrame, value: str, limits: float = 0.1, weight: str | None = None, keys: Keys = ()) -> DataFrame:
    return winsorized_centrality(df, value, mean, limits, weight, keys)


def generalized_midhinge(df: DataFrame, value: str, q1: float = 0.25, q3: float = 0.75, weight: str | None = None, keys: Keys = ()) -> DataFrame:
    out = quantiles(df, value, [q1, q3], weight, keys)
    return out.select(*keys, ((F.col("values")[0] + F.col("values")[1]) / 2).alias("value"))


def midhinge(df: DataFrame, value: str, weight: str | None = None, keys: Keys = ()) -> DataFrame:
    return generalized_midhinge(df, value, 0.25, 0.75, weight, keys)


def power_mean(df: DataFrame, value: str, p: float = 1.0, weight: str | None = None, keys: Keys = ()) -> DataFrame:
    """(mean of x ** p) ** (1 / p); 0: geometric, 1: mean, infinite: maximum or minimum. A negative p needs positive values."""
    if p == 0:
        return geometric_mean(df, value, weight, keys)
    if p == 1:
        return mean(df, value, weight, keys)
    if math.isinf(p):
        return maximum(df, value, weight, keys) if p > 0 else minimum(df, value, weight, keys)
    rows = sample(df, value, weight, keys)
    if p < 0:
        rows = rows.withColumn("x", F.when(F.col("x") > 0, F.col("x")).otherwise(F.raise_error(F.lit("power_mean with a negative p needs positive values")).cast("double")))
    return _agg(rows, keys, F.pow(weighted_average(F.pow("x", F.lit(p)), F.col("w")), F.lit(1 / p)))


def hodges_lehmann(df: DataFrame, value: str, weight: str | None = None, keys: Keys = (), tolerance: float = 1e-12) -> DataFrame:
    """The median of (x_i + x_j) / 2 over all i <= j, each row with itself included; weights have no influence.

    No pairs are made: for a candidate value c, the pairs with a sum of at most 2c are counted by
    merging the sorted values with their mirror image 2c - x, a sort each; candidates are bisected
    until two neighbouring pair sums are left. Groups are processed apart, each in one task; a large
    table without groups is counted by pairs of buckets (`_walsh_median`).
    """
    keys = list(keys)
    rows = sample(df, value, None, keys)
    if not keys and rows.count() > SELECT_ROWS:
        found = _walsh_median(rows)
        return df.sparkSession.range(1).select(F.lit(found).cast("double").alias("value"))

    def of(pdf):
        x = np.sort(pdf["x"].to_numpy())
        n = len(x)
        total = n * (n + 1) // 2

        def count(c: float) -> int:  # pairs i <= j with x_i + x_j <= c
            upto = np.searchsorted(x, c - x, side="right")
            return int(np.maximum(0, upto - np.arange(n)).sum())

        def select(rank: int) -> float:  # the rank-th pair sum, from 1
            lo, hi = 2 * x[0], 2 * x[-1]
            while True:
                mid = lo + (hi - lo) / 2
                if mid <= lo or mid >= hi:
                    break
                if count(mid) >= rank:
                    hi = mid
                else:
                    lo = mid
            return lo if count(lo) >= rank else hi

        a, b = select((total + 1) // 2), select(total // 2 + 1)
        row = {k: [pdf[k].iloc[0]] for k in keys} | {"value": [(a + b) / 4]}
        return pd.DataFrame(row)

    types = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "value double"])
    return rows.groupBy(*keys).applyInPandas(of, schema)


#: Candidates that one pass counts, and pair sums that the driver reads at the end.
CANDIDATES, LAST_SUMS = 64, 100_000


def _walsh_median(rows: DataFrame) -> float | None:
    """The median of all (x_i + x_j) / 2, i <= j, without a task that holds the column.

    Different values with their counts are put into buckets. The buckets' bounds alone enclose the wanted
    sum; only pairs of buckets that can hold sums inside the enclosure are counted, for CANDIDATES
    sums in a pass, until so few are left inside that they are read.
    """
    values = rows.groupBy("x").agg(F.count(F.lit(1)).alias("w"))
    values = bucketed(values, "x")
    stats = sorted(map(tuple, values.groupBy("_bucket").agg(F.min("x"), F.max("x"), F.sum("w"), F.sum(F.col("w").cast("double") * F.col("w"))).collect()))
    if not stats:
        return None
    number, low, high, w = (np.array([r[k] for r in stats]) for k in range(4))
    p, q = np.triu_indices(len(stats))
    weight = np.where(p == q, w[p].astype(float) * (w[p] + 1) / 2, w[p].astype(float) * w[q])
    least, most = low[p] + low[q], high[p] + high[q]
    total = float(weight.sum())

    def held(first: float, last: float) -> DataFrame:
        """Rows (pair, side, x, w) of the pairs of buckets with sums between first and last, and not all of them below or above."""
        open_ = np.flatnonzero((least <= last) & (most > first))
        places = [(int(number[b[k]]), int(k), side) for k in open_ for side, b in enumerate((p, q)) if side == 0 or p[k] != q[k]]
        table = rows.sparkSession.createDataFrame(places, "_bucket int, pair int, side int")
        return values.join(F.broadcast(table), "_bucket")  # bucket pairs: a few for each bucket

    def inside(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]:
        k = int(pdf["pair"].iloc[0])
        pdf = pdf.sort_values("x")
        a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == (0 if p[k] == q[k] else 1)]
        return a["x"].to_numpy(), a["w"].to_numpy(float), b["x"].to_numpy(), np.concatenate([[0.0], np.cumsum(b["w"].to_numpy(float))]), bool(p[k] == q[k])

    def counts(candidates: np.ndarray) -> np.ndarray:
        """Pairs with a sum of at most each candidate."""

        def of(pdf: pd.DataFrame) -> pd.DataFrame:
            x, wx, y, upto, same = inside(pdf)
            found = [float((wx * upto[np.searchsorted(y, c - x, side="right")]).sum()) for c in candidates]
            if same:  # each pair was met from both sides, a value with itself once
                found = [(f + float(wx[2 * x <= c].sum())) / 2 for f, c in zip(found, candidates, strict=True)]
            return pd.DataFrame({"n": [found]})

        below = float(weight[most <= candidates[0]].sum())
        parts = held(candidates[0], candidates[-1]).groupBy("pair").applyInPandas(of, "n array<double>")
        row = parts.agg(*[F.sum(F.col("n")[i]) for i in range(len(candidates))]).first()
        return below + np.array([v or 0.0 for v in row])

    def select(rank: float) -> float:
        order = np.argsort(most, kind="stable")
        hi = float(most[order][np.searchsorted(np.cumsum(weight[order]), rank)])
        order = np.argsort(least, kind="stable")
        lo = math.nextafter(float(least[order][np.searchsorted(np.cumsum(weight[order]), rank)]), -math.inf)
        n_lo, n_hi = counts(np.array([lo, hi]))
        while n_hi - n_lo > LAST_SUMS:
            inner = np.unique(np.linspace(lo, hi, CANDIDATES + 2)[1:-1])
            inner = inner[(inner > lo) & (inner < hi)]
            if not len(inner):
                return hi
            n = counts(inner)
            k = int(np.searchsorted(n, rank))
            if k < len(inner):
                hi, n_hi = float(inner[k]), float(n[k])
            if k:
                lo, n_lo = float(inner[k - 1]), float(n[k - 1])

        def sums(pdf: pd.DataFrame) -> pd.DataFrame:
            x, wx, y, upto, same = inside(pdf)
            a, b = np.searchsorted(y, lo - x, side="right"), np.searchsorted(y, hi - x, side="right")
            i = np.repeat(np.arange(len(x)), b - a)
            j = np.arange(len(i)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)
            n = wx[i] * np.diff(upto)[j]
            if same:
                n, keep = np.where(i == j, wx[i] * (wx[i] + 1) / 2, n), i <= j
                i, j, n = i[keep], j[keep], n[keep]
            return pd.DataFrame({"s": x[i] + y[j], "n": n})

        found = held(lo, hi).groupBy("pair").applyInPandas(sums, "s double, n double").groupBy("s").agg(F.sum("n")).collect()
        for v, n in sorted(map(tuple, found)):
            n_lo += n
            if n_lo >= rank:
                return float(v)
        return hi

    return (select(math.floor((total + 1) / 2)) + select(math.floor(total / 2) + 1)) / 4
