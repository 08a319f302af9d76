"""Summaries of the numeric columns of a table: location, dispersion, association, autocorrelation, and series."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.numeric import number, numeric_columns
from tideline.operators import association, ewm, location
from tideline.operators.series import SeriesFrame
from tideline.plans import report



@dataclass(frozen=True)
class Quantiles:
    """A metric made of quantiles: all those of a column's metrics come from one exact percentile aggregate."""

    shares: tuple[float, ...]
    combine: Callable[..., Column] = lambda *v: v[-1] - v[0] if len(v) > 1 else v[0]


ColumnMetric = Callable[[Column], Column] | Quantiles
#: Metrics that are one aggregate each, so a table's summary is one scan.
LOCATION: dict[str, ColumnMetric] = {"mean": F.avg, "median": Quantiles((0.5,))}
DISPERSION: dict[str, ColumnMetric] = {"std": F.stddev_samp, "quantile_spread_90": Quantiles((0.05, 0.95)), "iqr": Quantiles((0.25, 0.75))}


def column_metrics(df: DataFrame, metrics: dict[str, ColumnMetric], columns: list[str] | None = None, keys: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Rows (keys, column, one field for each metric): one aggregate over one scan, then unpivoted.

    Quantiles of a large table without keys are selected in a few scans (`location.selected`), as an
    exact percentile aggregate holds every different value. The scan that counts the rows then gives all
    other metrics and the least and greatest values too, so none follows the selection.
    """
    columns = [c for c in numeric_columns(df) if c not in keys] if columns is None else columns
    shares = sorted({q for m in metrics.values() if isinstance(m, Quantiles) for q in m.shares})
    aggregates = [F.count(F.lit(1)).alias("_rows")]
    aggregates += [m(number(c)).alias(f"_{i}_{n}") for i, c in enumerate(columns) for n, m in metrics.items() if not isinstance(m, Quantiles)]
    large = False
    if shares and not keys:
        # Arrow keeps every type and, unlike rows, needs no Python worker on the way back
        scanned = df.agg(*aggregates, *[e.alias(f"_end{i}") for i, e in enumerate(location.ends([number(c) for c in columns]))]).toArrow()
        rows, *ends = [scanned[n][0].as_py() for n in scanned.column_names if n == "_rows" or n.startswith("_end")]
        large = rows > location.SELECT_ROWS
    if large:
        found = location.selected(df, columns, shares, ends)
        scanned = scanned.select(range(len(aggregates)))
        for i, c in enumerate(columns):
            scanned = scanned.append_column(f"_q{i}", pa.array([found[c]], pa.list_(pa.float64())))
        one = df.sparkSession.createDataFrame(scanned)
    else:
        if shares:
            aggregates += [F.percentile(number(c), F.array(*[F.lit(q) for q in shares])).alias(f"_q{i}") for i, c in enumerate(columns)]
        one = (df.groupBy(*keys) if keys else df).agg(*aggregates)

    def value(i: int, name: str, m: ColumnMetric) -> Column:
        if isinstance(m, Quantiles):
            return m.combine(*[F.col(f"_q{i}")[shares.index(q)] for q in m.shares])
        return F.col(f"_{i}_{name}")

    rows = [F.struct(F.lit(c).alias("column"), *[value(i, n, m).alias(n) for n, m in metrics.items()]) for i, c in enumerate(columns)]
    return one.select(*keys, F.explode(F.array(*rows)).alias("s")).select(*keys, "s.*")


def histogram(df: DataFrame, columns: list[str] | None = None, bins: int = 30) -> DataFrame:
    """Rows (column, bin, low, high, n, density): equal bins between least and greatest value, the last one closed."""
    columns = numeric_columns(df) if columns is None else columns
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), number(c).alias("x")) for c in columns])).alias("s")).select("s.*").where("x IS NOT NULL")
    edge = rows.groupBy("column").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("x").alias("total"))
    # a row for each column of the table
    placed = rows.join(F.broadcast(edge), "column")
    k = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
    counts = placed.groupBy("column", k.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.max("total").alias("total"))
    step = (F.col("hi") - F.col("lo")) / bins
    density = F.when(step > 0, F.col("n") / (F.col("total") * step)).otherwise(F.lit(1.0))
    return counts.select("column", "bin", (F.col("lo") + F.col("bin") * step).alias("low"), (F.col("lo") + (F.col("bin") + 1) * step).alias("high"), "n", density.alias("density"))


def box_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows (column, low, lower, median, upper, high)."""
    return column_metrics(df, {"low": F.min, "lower": Quantiles((0.25,)), "median": Quantiles((0.5,)), "upper": Quantiles((0.75,)), "high": F.max}, columns)


class EDASummary:
    """compute() runs the job and keeps its small result; table() is a DataFrame, plot() a list of SVG charts."""

    name = "Summary"

    def __init__(self, df: DataFrame):
        self.df, self._results = df, None

    @property
    def results_available(self) -> bool:
        return self._results is not None

    def compute(self):
        self._results = self.table().collect()
        return self._results

    def get_results(self):
        if not self.results_available:
            raise ValueError("Compute results first with compute()")
        return self._results

    def table(self) -> DataFrame:
        raise NotImplementedError

    def shown(self) -> list:
        """The rows of a report's table."""
        return self.table().collect()

    def plot(self) -> list[str]:
        return []


class EDACentralitySummary(EDASummary):
    name = "Location"

    def __init__(self, df: DataFrame, metrics: dict[str, ColumnMetric] | None = None):
        super().__init__(df)
        self.metrics = metrics or LOCATION

    def table(self) -> DataFrame:
        return column_metrics(self.df, self.metrics)

    def plot(self) -> list[str]:
        bins: dict[str, list] = {}
        for r in histogram(self.df).orderBy("column", "bin").collect():
            bins.setdefault(r["column"], []).append((r["low"], r["high"], r["density"]))
        marks = {r["column"]: {m: r[m] for m in self.metrics} for r in self.get_results()}
        return [report.histogram_svg(b, marks.get(c, {}), c) for c, b in bins.items()]


class EDAVariabilitySummary(EDACentralitySummary):
    name = "Dispersion"

    def __init__(self, df: DataFrame, metrics: dict[str, ColumnMetric] | None = None):
        super().__init__(df, metrics or DISPERSION)

    def plot(self) -> list[str]:
        return [report.box_svg([(r["column"], [r["low"], r["lower"], r["median"], r["upper"], r["high"]]) for r in box_stats(self.df).collect() if r["low"] is not None])]


class EDACorrelationSummary(EDASummary):
    name = "Association"

    def __init__(self, df: DataFrame, metrics: tuple[association.Metric, ...] | None = None, order: str | None = None):
        super().__init__(df)
        self.metrics = metrics or (association.PEARSON, association.SPEARMAN, association.KENDALL, association.XI)
        self.order = order

    def matrices(self) -> DataFrame:
        out = None
        for m in self.metrics:
            one = association.correlation_matrix(self.df, metric=m, order=self.order).select(F.lit(m.name).alias("metric"), "row", "col", "value")
            out = one if out is None else out.union(one)
        return out

    def table(self) -> DataFrame:
        """Rows (metric, pair 'a > b', value): no diagonal, the upper triangle of symmetric metrics."""
        names = numeric_columns(self.df)
        place = F.create_map(*[x for i, c in enumerate(names) for x in (F.lit(c), F.lit(i))])
        symmetric = F.col("metric").isin([m.name for m in self.metrics if m.symmetric])
        kept = self.matrices().where((F.col("row") != F.col("col")) & (~symmetric | (place[F.col("row")] < place[F.col("col")])))
        return kept.select("metric", F.concat_ws(" > ", "row", "col").alias("pair"), "value")

    def plot(self) -> list[str]:
        names, charts = numeric_columns(self.df), []
        found: dict[str, dict] = {}
        for r in self.matrices().collect():
            found.setdefault(r["metric"], {})[r["row"], r["col"]] = r["value"]
        for m in self.metrics:
            charts += [f"<h3>{m.name}</h3>", report.matrix_svg(names, names, found.get(m.name, {}))]
        points = self.scatter()
        return charts + [report.scatter_svg([(p[x], p[y]) for p in points if p[x] is not None and p[y] is not None], f"{x} > {y}") for i, x in enumerate(names) for y in names[i + 1 :]]

    def scatter(self, points: int = 500) -> list[dict]:
        """About this many rows, chosen by chance, of the numeric columns: a chart's dots, not a result."""
        rows = self.df.select(*[number(c).alias(c) for c in numeric_columns(self.df)])
        share = min(1.0, 1.2 * points / max(1, rows.count()))
        return [r.asDict() for r in rows.sample(share, seed=0).limit(points).collect()]


class EDAAutoCorrelationSummary(EDASummary):
    name = "Autocorrelation"

    def __init__(self, df: DataFrame, order: str, lags: int | list[int] | None = None, metrics: tuple[association.Metric, ...] | None = None):
        super().__init__(df)
        self.order = order
        self.lags = min(20, df.count() - 10) if lags is None else lags
        self.metrics = metrics or (association.PEARSON, association.SPEARMAN)

    def table(self) -> DataFrame:
        """Rows (metric, column, lag, value)."""
        columns = [c for c in numeric_columns(self.df) if c != self.order]
        out = None
        for m in self.metrics:
            one = association.auto_correlation(self.df, columns, self.lags, self.order, m).select(F.lit(m.name).alias("metric"), "column", "lag", "value")
            out = one if out is None else out.union(one)
        return out

    def plot(self) -> list[str]:
        series: dict[str, dict[str, list]] = {}
        for r in sorted(self.get_results(), key=lambda r: r["lag"]):
            series.setdefault(r["metric"], {}).setdefault(r["column"], []).append((r["lag"], r["value"]))
        return [report.lines_svg(s, m) for m, s in series.items()]


SeriesMetric = Callable[[SeriesFrame, float], DataFrame]


def weighted_mean(frame: SeriesFrame, p: float) -> DataFrame:
    return ewm.mean(frame, p, propagate=False)


class TimeSeriesCentralitySummary(EDASummary):
    """Exponentially weighted metrics (p = 0.9; the mean if none are named) of each column over a series.

    metrics: functions (frame, p) that give the frame's keys, order and value columns. Results are
    DataFrames with all rows; only charts thin them, to `points` rows.
    """

    name = "Series location"

    def __init__(self, frame: SeriesFrame, metrics: dict[str, SeriesMetric] | None = None, p: float = 0.9, points: int = 2000):
        super().__init__(frame.df)
        self.frame, self.p, self.points = frame, p, points
        self.metrics = metrics or {"weighted mean": weighted_mean}

    def compute(self) -> dict[str, DataFrame]:
        self._results = {name: metric(self.frame, self.p) for name, metric in self.metrics.items()}
        return self._results

    def table(self) -> DataFrame:
        """Rows (metric, keys, order, columns) of all metrics."""
        out = None
        for name, found in (self._results or self.compute()).items():
            one = found.select(F.lit(name).alias("metric"), *self.frame.keys, self.frame.order, *self.frame.values)
            out = one if out is None else out.union(one)
        return out

    def shown(self) -> list:
        """Thinned rows: a page has no room for a series."""
        rows = []
        for name, df in self.get_results().items():
            rows += self._thinned(df.select(F.lit(name).alias("metric"), *self.frame.keys, self.frame.order, *self.frame.values))
        return rows

    def _thinned(self, df: DataFrame) -> list:
        """Evenly spaced rows, at most `points`: a chart's resolution."""
        every = max(1, -(-len(self.frame) // self.points))
        rows = df.withColumn("_k", F.row_number().over(self.frame.window) - 1)
        return rows.where(F.col("_k") % every == 0).drop("_k").orderBy(self.frame.order).collect()

    def plot(self) -> list[str]:
        """A chart for each column: its own values and each metric's."""
        lines = {"original": self._thinned(self.frame.df)} | {name: self._thinned(df) for name, df in self.get_results().items()}
        return [report.lines_svg({name: [(i, r[c]) for i, r in enumerate(rows)] for name, rows in lines.items()}, c) for c in self.frame.values]


def centre_lines(df: DataFrame, value: str) -> dict[str, float]:
    """All location metrics of one column, collected: a row of the location module's functions at their defaults."""
    names = ("mean", "median", "midhinge", "midrange", "trimmed_mean", "winsorized_mean", "geometric_mean")
    return {n: getattr(location, n)(df, value).first()["value"] for n in names}
