"""Series over a time or order column: frequency, lag, filling of gaps, smoothing.

A SeriesFrame is a DataFrame with an order column, value columns and optional series keys. Nothing
is sorted until an operator needs it. All windows are partitioned by the keys; a frame without keys
is one series and its windows run in one task, except frequency inference and the exponentially
weighted operators, which work in blocks.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.numeric import number, numeric_columns

TIME, NUMERIC, UNKNOWN = "time", "numeric", "unknown"
IRREGULAR_TIME, IRREGULAR_NUMERIC = "irregular time", "irregular numeric"
#: Lengths of units in microseconds, as frequency names have them.
UNITS = (("D", 86_400_000_000), ("h", 3_600_000_000), ("min", 60_000_000), ("s", 1_000_000), ("ms", 1_000), ("us", 1))
WEEKDAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
Unbounded = Window.unboundedPreceding


def fixed_length(freq: str) -> int | None:
    """Microseconds of a frequency of fixed length ('D', '15min'), None for calendar ones."""
    digits = "".join(c for c in freq if c.isdigit())
    unit = freq[len(digits) :]
    return (int(digits) if digits else 1) * dict(UNITS)[unit] if unit in dict(UNITS) else 7 * 86_400_000_000 if unit.startswith("W") and not digits else None


class SeriesFrame:
    """An immutable view of a DataFrame as one or many series."""

    def __init__(self, df: DataFrame, order: str, values: list[str] | None = None, keys: list[str] | tuple[str, ...] = (), freq: str | float | None = None):
        if not isinstance(df, DataFrame):
            raise ValueError("df must be a DataFrame")
        self.df, self.order, self.keys = df, order, list(keys)
        self.values = [c for c in numeric_columns(df) if c != order and c not in keys] if values is None else list(values)
        if freq is not None:
            self.__dict__["freq"] = freq

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        return getattr(self.df, name)

    def __len__(self) -> int:
        return self.df.count()

    def _with(self, df: DataFrame, keep_freq: bool = True) -> SeriesFrame:
        known = self.__dict__.get("freq") if keep_freq else None
        return SeriesFrame(df, self.order, self.values, self.keys, known)

    @property
    def dimension(self) -> str:
        kind = self.df.schema[self.order].dataType
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType, T.DayTimeIntervalType)):
            return TIME
        if isinstance(kind, T.StructType) and {"left", "right"} <= set(kind.names):
            return TIME
        return NUMERIC if isinstance(kind, T.NumericType) else UNKNOWN

    @property
    def window(self):
        return Window.partitionBy(*self.keys).orderBy(self.order)

    def position(self) -> Column:
        """The place on the axis as a number: microseconds for instants, else the value."""
        kind = self.df.schema[self.order].dataType
        c = F.col(f"`{self.order}`")
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return F.unix_micros(c.cast("timestamp"))
        return c.cast("double")

    @cached_property
    def freq(self) -> str | float:
        """A frequency name, a number, or why there is none; one job. Fewer than three instants have an unknown one."""
        kind = self.df.schema[self.order].dataType
        if self.dimension == UNKNOWN or isinstance(kind, (T.DayTimeIntervalType, T.StructType)):
            return "unknown"
        steps = _with_previous(self.df.select(*self.keys, F.col(f"`{self.order}`").alias("o"), self.position().alias("p")), "p", self.keys)
        gap = F.col("p") - F.col("p_before")
        if self.dimension == NUMERIC:
            low, high = steps.agg(F.min(gap), F.max(gap)).first()
            return abs(low) if low is not None and low == high else IRREGULAR_NUMERIC
        day = F.col("o").cast("timestamp")
        before = F.timestamp_micros(F.col("p_before"))
        months = (F.year(day) - F.year(before)) * 12 + F.month(day) - F.month(before)
        weekday = F.weekday(day)
        row = steps.agg(
            F.count(F.lit(1)).alias("n"),
            F.min(gap).alias("low"),
            F.max(gap).alias("high"),
            F.min(months).alias("m_low"),
            F.max(months).alias("m_high"),
            F.max(F.dayofmonth(day)).alias("last_day"),
            F.min(F.dayofmonth(F.date_add(F.to_date(day), 1))).alias("d_low"),
            F.max(F.dayofmonth(F.date_add(F.to_date(day), 1))).alias("d_high"),
            F.max(F.pmod(F.col("p"), F.lit(86_400_000_000))).alias("clock"),
            F.max(weekday).alias("w_high"),
            F.min(weekday).alias("w_low"),
            F.min(F.month(day)).alias("month"),
            F.max((gap == 86_400_000_000) | ((gap == 3 * 86_400_000_000) & (weekday == 0))).alias("b_any"),
            F.min((gap == 86_400_000_000) | ((gap == 3 * 86_400_000_000) & (weekday == 0))).alias("b_all"),
        ).first()
        if row["n"] < 3 or row["low"] is None:
            return "unknown" if row["n"] < 3 else IRREGULAR_TIME
        if row["low"] <= 0:
            return IRREGULAR_TIME
        if row["low"] == row["high"]:
            if row["low"] == 7 * 86_400_000_000:
                return f"W-{WEEKDAYS[row['w_low']]}"
            unit, size = next((u, s) for u, s in UNITS if row["low"] % s == 0)
            k = row["low"] // size
            return unit if k == 1 else f"{k}{unit}"
        if row["clock"] == 0 and row["m_low"] == row["m_high"] and row["m_low"] > 0:
            step, start, end = row["m_low"], row["last_day"] == 1, row["d_low"] == row["d_high"] == 1
            if start or end:
                tail = "S" if start else "E"
                if step % 12 == 0:
                    return f"{step // 12 if step > 12 else ''}Y{tail}-{MONTHS[row['month'] - 1]}"
                if step % 3 == 0:
                    return f"{step // 3 if step > 3 else ''}Q{tail}-{MONTHS[(row['month'] - 1) % 3 + 9]}"
                return f"{step if step > 1 else ''}M{tail}"
        if row["b_all"] and row["w_high"] < 5:
            return "B"
        return IRREGULAR_TIME

    @property
    def is_regular(self) -> bool:
        return self.freq not in (IRREGULAR_TIME, IRREGULAR_NUMERIC)

    @property
    def start(self):
        return self.df.agg(F.min(f"`{self.order}`")).first()[0]

    @property
    def end(self):
        return self.df.agg(F.max(f"`{self.order}`")).first()[0]

    def _stat(self, build: Callable[[Column], Column]) -> dict:
        return self.df.agg(*[build(number(c)).alias(c) for c in self.values]).first().asDict()

    def sum(self) -> dict:
        return self._stat(F.sum)

    def mean(self) -> dict:
        return self._stat(F.avg)

    def min(self) -> dict:
        return self._stat(F.min)

    def max(self) -> dict:
        return self._stat(F.max)

    def std(self) -> dict:
        return self._stat(F.stddev_samp)

    def count_values(self) -> dict:
        """Values that aren't missing, by column (`count` is the table's)."""
        return self._stat(F.count)

    @property
    def shape(self) -> tuple[int, int]:
        """Rows and value columns; one job."""
        return self.df.count(), len(self.values)

    def between(self, low, high) -> SeriesFrame:
        """Rows from low to high, both included."""
        return self._with(self.df.where(F.col(f"`{self.order}`").between(F.lit(low), F.lit(high))))

    def rows(self, first: int, last: int) -> SeriesFrame:
        """Rows first .. last - 1 of each series by position from 0."""
        placed = self.df.withColumn("_rn", F.row_number().over(self.window) - 1)
        return self._with(placed.where((F.col("_rn") >= first) & (F.col("_rn") < last)).drop("_rn"))

    def apply_rowwise(self, build: Callable[..., Column] | None = None, function: Callable | None = None, schema: str | None = None) -> SeriesFrame:
        """New columns from `build(columns by name) -> dict of Columns`; a Python function of pandas batches only with a schema."""
        if build is not None:
            made = build({c: F.col(f"`{c}`") for c in self.df.columns})
            return self._with(self.df.withColumns(made))
        return self._with(self.df.mapInPandas(lambda batches: (function(b) for b in batches), schema))

    def lag(self, k: int) -> SeriesFrame:
        """Regular time and numeric axes move by k (periods; units of the axis), values stay; other axes shift rows."""
        if self.dimension == UNKNOWN:
            shifted = {c: F.lag(f"`{c}`", k).over(self.window) if k >= 0 else F.lead(f"`{c}`", -k).over(self.window) for c in self.values}
            return self._with(self.df.withColumns(shifted))
        if not self.is_regular:
            raise ValueError("lag needs a regular axis")
        c = F.col(f"`{self.order}`")
        if self.dimension == NUMERIC:
            if k % self.freq != 0:
                raise ValueError(f"lag must be a multiple of the frequency {self.freq}")
            return self._with(self.df.withColumn(self.order, c + F.lit(k)))
        return self._with(self.df.withColumn(self.order, shift_time(c, str(self.freq), k, self.df.schema[self.order].dataType)))

    def fill_missing(self, method: str = "linear", order: int = 3, limit: int | None = None) -> SeriesFrame:
        """mean, median, ffill, bfill, linear (by position) or spline.

        limit: rows filled of each gap; for mean and median rows filled of each series in all. Leading
        gaps stay for ffill and linear, trailing ones for bfill; linear carries the last value on. A
        series without values stays so.
        """
        if method == "spline":
            return self._per_series(lambda x, y: fill_spline(x, y, order, limit))
        if method in ("mean", "median"):
            return self._with(self._centred(method, limit))
        made = {c: self._filled(number(c), method, limit) for c in self.values}
        return self._with(self.df.withColumns(made))

    def _centred(self, method: str, limit: int | None) -> DataFrame:
        """Gaps filled by each series' mean or median: one aggregate, whose row for each series is joined; only a limit needs an order."""
        from tideline.operators import location

        df, keys = self.df, self.keys
        if not keys and method == "median" and df.count() > location.SELECT_ROWS:
            found = location.selected(df, self.values, [0.5])
            centre = df.sparkSession.range(1).select(*[F.lit(found[c][0]).cast("double").alias(f"_m{i}") for i, c in enumerate(self.values)])
        else:
            build = F.avg if method == "mean" else lambda x: F.percentile(x, F.lit(0.5))
            centre = df.groupBy(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)]).agg(*[build(number(c)).alias(f"_m{i}") for i, c in enumerate(self.values)])
        if keys:
            same = F.lit(True)
            for i, k in enumerate(keys):
                same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}"))
            df = df.join(centre, same)
        else:
            df = df.crossJoin(F.broadcast(centre))  # one row
        behind = self.window.rowsBetween(Unbounded, 0)

        def fill(i: int, c: str) -> Column:
            x = number(c)
            m = F.col(f"_m{i}")
            return F.coalesce(x, m if limit is None else F.when(F.sum(x.isNull().cast("int")).over(behind) <= limit, m))

        return df.withColumns({c: fill(i, c) for i, c in enumerate(self.values)}).select(*[F.col(f"`{c}`") for c in self.df.columns])

    def _filled(self, x: Column, method: str, limit: int | None) -> Column:
        w = self.window
        behind, ahead = w.rowsBetween(Unbounded, 0), w.rowsBetween(0, Window.unboundedFollowing)
        if method == "ffill":
            return F.last(x, True).over(behind if limit is None else w.rowsBetween(-limit, 0))
        if method == "bfill":
            return F.first(x, True).over(ahead if limit is None else w.rowsBetween(0, limit))
        if method != "linear":
            raise ValueError(f"Unknown filling method: {method}")
        rn = F.row_number().over(w)
        known = F.when(x.isNotNull(), F.struct(rn.alias("rn"), x.alias("x")))
        a, b = F.last(known, True).over(behind), F.first(known, True).over(ahead)
        line = a["x"] + (b["x"] - a["x"]) * (rn - a["rn"]) / F.greatest(b["rn"] - a["rn"], F.lit(1))
        fill = F.when(b.isNull(), a["x"]).otherwise(line)
        if limit is not None:
            fill = F.when(rn - a["rn"] <= limit, fill)
        return F.coalesce(x, fill)

    def smooth(self, method: str = "rolling_mean", window: int = 3, center: bool = True, s: float | None = None, process_variance: float = 1e-5, measurement_variance: float = 1e-2) -> SeriesFrame:
        """rolling_mean (at least one value a window), spline (smoothing, replaces all points) or kalman (random walk, forward)."""
        if method == "rolling_mean":
            frame = self.window.rowsBetween(-(window // 2), (window - 1) // 2) if center else self.window.rowsBetween(1 - window, 0)
            return self._with(self.df.withColumns({c: F.avg(number(c)).over(frame) for c in self.values}))
        if method == "spline":
            return self._per_series(lambda x, y: smooth_spline(x, y, s))
        if method == "kalman":
            return self._per_series(lambda x, y: kalman(y, process_variance, measurement_variance))
        raise ValueError(f"Unknown smoothing method: {method}")

    def _per_series(self, function: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> SeriesFrame:
        """Ordered recursions: one task for each series, doubles in and out."""
        values, order, keys = self.values, self.order, self.keys
        df = self.df.withColumns({c: number(c) for c in values}).withColumn("_p", self.position().cast("double") if self.dimension != UNKNOWN else F.lit(0.0))
        seconds = 1e-6 if self.dimension == TIME else 1.0
        by_row = self.dimension == UNKNOWN

        def go(pdf):
            pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
            x = np.arange(len(pdf), dtype=float) if by_row else (pdf["_p"].to_numpy() - pdf["_p"].iloc[0]) * seconds
            for c in values:
                pdf[c] = function(x, pdf[c].to_numpy(float))
            return pdf.drop(columns="_p")

        schema = T.StructType([f for f in df.schema.fields if f.name != "_p"])
        return self._with(df.groupBy(*keys).applyInPandas(go, schema))


def _with_previous(df: DataFrame, order: str, keys: list[str]) -> DataFrame:
    """Adds `order`_before: the value before in order; without keys in buckets, whose last values are passed on."""
    if keys:
        return df.withColumn(f"{order}_before", F.lag(order).over(Window.partitionBy(*keys).orderBy(order)))
    from tideline.functions.scan import bucketed

    df = bucketed(df.where(F.col(order).isNotNull()), order)
    last = df.groupBy("_bucket").agg(F.max(order).alias("_m")).withColumn("_edge", F.lag("_m").over(Window.orderBy("_bucket"))).drop("_m")
    inside = F.lag(order).over(Window.partitionBy("_bucket").orderBy(order))
    return df.join(F.broadcast(last), "_bucket").withColumn(f"{order}_before", F.coalesce(inside, "_edge")).drop("_bucket", "_edge")


def shift_time(c: Column, freq: str, k: int, kind: T.DataType) -> Column:
    """c moved by k periods of a frequency."""
    digits = "".join(x for x in freq if x.isdigit())
    n, unit = k * (int(digits) if digits else 1), freq[len(digits) :].split("-")[0]
    micros = fixed_length(freq)
    if micros is not None:
        moved = F.timestamp_micros(F.unix_micros(c.cast("timestamp")) + F.lit(k * micros))
    elif unit in ("MS", "ME", "QS", "QE", "YS", "YE"):
        step = n * {"M": 1, "Q": 3, "Y": 12}[unit[0]]
        day = F.add_months(F.to_date(c), step)
        moved = (F.last_day(day) if unit[1] == "E" else day).cast("timestamp")
    elif unit == "B":
        at = F.weekday(c) + n  # weekdays from Monday
        days = n + 2 * F.floor(at / 5)
        moved = F.date_add(F.to_date(c), days.cast("int")).cast("timestamp")
    else:
        raise ValueError(f"can't move by {freq}")
    return moved.cast(kind)


def kalman(y: np.ndarray, q: float, r: float) -> np.ndarray:
    """Forward filter of a random walk with process variance q and measurement variance r; gaps keep the estimate."""
    seen = np.flatnonzero(~np.isnan(y))
    if not len(seen):
        return y
    out, at, spread = np.empty(len(y)), y[seen[0]], 1.0
    for i, z in enumerate(y):
        spread += q
        if z == z:
            gain = spread / (spread + r)
            at += gain * (z - at)
            spread *= 1 - gain
        out[i] = at
    return out


def spline_basis(x: np.ndarray, knots: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """B-splines of degree k over [knots[0], knots[-1]]: for each x the number of the first of k + 1 that aren't zero, and their values (de Boor)."""
    t = np.concatenate([np.repeat(knots[0], k), knots, np.repeat(knots[-1], k)])
    place = np.clip(np.searchsorted(t, x, side="right") - 1, k, len(t) - k - 2)
    b = np.zeros((len(x), k + 1))
    b[:, 0] = 1.0
    for d in range(1, k + 1):
        saved = np.zeros(len(x))
        for r in range(d):
            right, left = t[place + r + 1], t[place + r + 1 - d]
            part = b[:, r] / (right - left)
            b[:, r] = saved + (right - x) * part
            saved = (x - left) * part
        b[:, d] = saved
    return place - k, b


def spline_values(x: np.ndarray, knots: np.ndarray, k: int, coef: np.ndarray) -> np.ndarray:
    first, b = spline_basis(x, knots, k)
    return (b * coef[first[:, None] + np.arange(k + 1)]).sum(axis=1)


def solve_banded(first: np.ndarray, b: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Least squares of n coefficients; row i holds b[i] from column first[i] on, which never falls. Triangles of a few dozen columns are made one after another and passed on, so memory is rows x degree."""
    width, base, i, done = b.shape[1], 0, 0, []
    top = np.zeros((0, 1))  # open rows of the triangle from column base on, with y's last
    while i < len(y):
        j = min(int(np.searchsorted(first, first[i] + 64)), i + 4096)
        if first[i] > base:
            done.append((base, int(first[i]) - base, top))
            top, base = top[first[i] - base :, first[i] - base :], int(first[i])
        columns = max(int(first[j - 1]) + width - base, top.shape[1] - 1)
        a = np.zeros((len(top) + j - i, columns + 1))
        a[: len(top), : top.shape[1] - 1], a[: len(top), -1] = top[:, :-1], top[:, -1]
        a[len(top) + np.arange(j - i)[:, None], first[i:j, None] - base + np.arange(width)] = b[i:j]
        a[len(top) :, -1] = y[i:j]
        top, i = np.linalg.qr(a, mode="r")[:columns], j
    done.append((base, n - base, top))
    coef = np.zeros(n)
    for base, own, top in reversed(done):
        rows = top[:own]
        rest = rows[:, -1] - rows[:, own:-1] @ coef[base + own : base + top.shape[1] - 1]
        coef[base : base + own] = np.linalg.lstsq(rows[:, :own], rest, rcond=None)[0]
    return coef


def fit_spline(x: np.ndarray, y: np.ndarray, k: int, s: float) -> Callable[[np.ndarray], np.ndarray]:
    """A least-squares spline of degree k: a polynomial, with knots added where errors are large until their squares sum to s at most; where that takes as many coefficients as different points, the spline through the points."""
    lo, hi = float(x[0]), float(x[-1])
    scale = (hi - lo) or 1.0
    u = (x - lo) / scale
    points = np.unique(u)
    knots, last = np.array([0.0, 1.0]), False
    while True:
        first, basis = spline_basis(u, knots, k)
        cells = len(knots) - 1
        coef = solve_banded(first, basis, y, cells + k)
        error = ((basis * coef[first[:, None] + np.arange(k + 1)]).sum(axis=1) - y) ** 2
        if error.sum() <= s or last or len(points) <= k + 1:
            break
        sums = np.bincount(np.clip(np.searchsorted(knots, u, side="right") - 1, 0, cells - 1), error, cells)
        at = np.searchsorted(points, knots)
        at[-1] = len(points)
        own = np.diff(at)
        a, b = points[at[:-1] + np.maximum(own - 1, 0) // 2], points[np.minimum(at[:-1] + own // 2, len(points) - 1)]
        middle = (a + b) / 2
        can = (own >= 2) & (knots[:-1] < middle) & (middle < knots[1:])
        # all cells with more than their share of the error are halved; where these have one point each, the others
        new = middle[can & (sums > s / cells)]
        if not len(new):
            new = middle[can]
        last = not len(new) or cells + len(new) + k >= len(points)
        if last:  # knots at the points, or between them for even degrees, are well-conditioned
            new = points[(k + 1) // 2 : len(points) - (k + 1) // 2] if k % 2 else (points[k // 2 : len(points) - k // 2 - 1] + points[k // 2 + 1 : len(points) - k // 2]) / 2
            knots = knots[[0, -1]]
        knots = np.sort(np.concatenate([knots, new]))
    return lambda at: spline_values(np.clip((at - lo) / scale, 0, 1), knots, k, coef)


def fill_spline(x: np.ndarray, y: np.ndarray, order: int, limit: int | None) -> np.ndarray:
    known = ~np.isnan(y)
    if known.sum() <= order:
        return y
    out, f = y.copy(), fit_spline(x[known], y[known], order, float(known.sum()))
    gap = np.flatnonzero(~known & (x >= x[known][0]) & (x <= x[known][-1]))
    if limit is not None and len(gap):
        run = np.arange(len(gap)) - np.maximum.accumulate(np.where(np.diff(gap, prepend=-2) > 1, np.arange(len(gap)), 0))
        gap = gap[run < limit]
    out[gap] = f(x[gap])
    return out


def smooth_spline(x: np.ndarray, y: np.ndarray, s: float | None) -> np.ndarray:
    known = ~np.isnan(y)
    if known.sum() <= 3:
        warnings.warn("too few values for a smoothing spline; left as they are", stacklevel=2)
        return y
    return fit_spline(x[known], y[known], 3, float(known.sum()) if s is None else s)(x)
