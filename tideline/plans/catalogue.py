"""The registered queries over the driver's tables, each with its SQL twin where SQL can express it.

Results are rounded on both sides. Sources: lineitem (samples), orders summed by day (one series), the
same densified over the calendar (gaps), events by user (many short series), embeddings, labels.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators import association as A
from tideline.operators import backtest as B
from tideline.operators import clustering as C
from tideline.operators import dispersion as V
from tideline.operators import ewm, experts, online, rolling
from tideline.operators import location as L
from tideline.operators.series import SeriesFrame
from tideline.plans import recursions as R
from tideline.plans import summaries as S
from tideline.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
Query = Callable[[SparkSession, str], DataFrame]


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def rounded(df: DataFrame, digits: int = 6, **named: Column) -> DataFrame:
    """Double columns rounded, without negative zeros."""
    return df.select(*[(F.round(F.col(f"`{c}`"), digits) + 0.0).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes])


def labelled(parts: dict[str, DataFrame], digits: int = 4) -> DataFrame:
    """Rows (metric, value) of one-row results."""
    out = None
    for name, df in parts.items():
        one = df.select(F.lit(name).alias("metric"), F.col("value").cast("double").alias("value"))
        out = one if out is None else out.union(one)
    return rounded(out, digits)


def sample(column: str, parts: dict[str, Callable[..., DataFrame]], digits: int = 4, **more) -> Query:
    return lambda spark, d: labelled({n: f(table(spark, d, "lineitem"), column, **more) for n, f in parts.items()}, digits)


# samples: location

COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_UNPIVOT = "FROM (UNPIVOT (SELECT CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(l_extendedprice AS DOUBLE) AS l_extendedprice, CAST(l_discount AS DOUBLE) AS l_discount, CAST(l_tax AS DOUBLE) AS l_tax FROM lineitem) ON COLUMNS(*) INTO NAME \"column\" VALUE x) GROUP BY \"column\""


@register("location_summary", f'SELECT "column", round(avg(x), 4) AS mean, round(median(x), 4) AS median {_UNPIVOT}')
def _(spark, d):
    return rounded(S.column_metrics(table(spark, d, "lineitem"), S.LOCATION, list(COLS)), 4)


@register("dispersion_summary", f'SELECT "column", round(stddev_samp(x), 4) AS std, round(quantile_cont(x, 0.95) - quantile_cont(x, 0.05), 4) AS quantile_spread_90, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 4) AS iqr {_UNPIVOT}')
def _(spark, d):
    return rounded(S.column_metrics(table(spark, d, "lineitem"), S.DISPERSION, list(COLS)), 4)


@register("location_by_group", "SELECT l_returnflag, round(avg(l_extendedprice), 4) AS mean, round(median(l_extendedprice), 4) AS median FROM lineitem GROUP BY l_returnflag")
def _(spark, d):
    t = table(spark, d, "lineitem")
    m = L.mean(t, "l_extendedprice", keys=["l_returnflag"]).withColumnRenamed("value", "mean")
    return rounded(m.join(L.median(t, "l_extendedprice", keys=["l_returnflag"]).withColumnRenamed("value", "median"), "l_returnflag"), 4)


def scalar(name: str, f: Callable[..., DataFrame], sql: str, column: str = "l_extendedprice", digits: int = 4, **more) -> None:
    """A query of one metric of one lineitem column; sql: an expression or a whole SELECT of `value`."""
    sql = sql if sql.lstrip().upper().startswith(("SELECT", "WITH")) else f"SELECT {sql} AS value FROM lineitem"
    register(name, f"SELECT round(CAST(value AS DOUBLE), {digits}) AS value FROM ({sql})")(lambda spark, d: rounded(f(table(spark, d, "lineitem"), column, **more), digits))


_RANKED = "SELECT l_extendedprice AS x, row_number() OVER (ORDER BY l_extendedprice) AS rn, count(*) OVER () AS n FROM lineitem"
_WQ = """WITH s AS (SELECT l_extendedprice AS x, l_quantity AS w FROM lineitem),
c AS (SELECT x, sum(w) OVER (ORDER BY x, w ROWS UNBOUNDED PRECEDING) / sum(w) OVER () AS c, row_number() OVER (ORDER BY x, w) AS rn FROM s),
p AS (SELECT x, c, rn, lag(x) OVER (ORDER BY rn) AS px, lag(c) OVER (ORDER BY rn) AS pc FROM c)
SELECT CASE WHEN pc IS NULL THEN x ELSE px + (x - px) * (0.3 - pc) / (c - pc) END AS value FROM p WHERE c >= 0.3 ORDER BY rn LIMIT 1"""
scalar("mean", L.mean, "avg(l_extendedprice)")
scalar("weighted_mean", L.mean, "sum(l_extendedprice * l_quantity) / sum(l_quantity)", weight="l_quantity")
scalar("geometric_mean", L.geometric_mean, "exp(avg(ln(l_extendedprice)))")
scalar("power_mean_2", lambda t, c: L.power_mean(t, c, 2), "sqrt(avg(l_extendedprice * l_extendedprice))")
scalar("power_mean_m1", lambda t, c: L.power_mean(t, c, -1), "1 / avg(1 / l_extendedprice)")
scalar("midrange", L.midrange, "(min(l_extendedprice) + max(l_extendedprice)) / 2")
scalar("minimum", L.minimum, "min(l_extendedprice)")
scalar("maximum", L.maximum, "max(l_extendedprice)")
scalar("median", L.median, "median(l_extendedprice)")
scalar("lower_quartile", L.lower_quartile, "quantile_cont(l_extendedprice, 0.25)")
scalar("upper_quartile", L.upper_quartile, "quantile_cont(l_extendedprice, 0.75)")
scalar("midhinge", L.midhinge, "(quantile_cont(l_extendedprice, 0.25) + quantile_cont(l_extendedprice, 0.75)) / 2", digits=6)
scalar("generalized_midhinge", lambda t, c: L.generalized_midhinge(t, c, 0.1, 0.8), "(quantile_cont(l_extendedprice, 0.1) + quantile_cont(l_extendedprice, 0.8)) / 2")
scalar("weighted_quantile", lambda t, c: L.quantile(t, c, 0.3, "l_quantity"), _WQ)
scalar("mode_value", L.mode, "SELECT l_quantity AS value FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1", "l_quantity")
scalar("mode_weighted", L.mode, "SELECT l_discount AS value FROM lineitem GROUP BY 1 ORDER BY sum(l_quantity) DESC, 1 LIMIT 1", "l_discount", weight="l_quantity")
scalar("trimmed_mean", L.trimmed_mean, f"SELECT avg(x) AS value FROM ({_RANKED}) WHERE rn > floor(n * 0.1) AND rn <= n - floor(n * 0.1)")
scalar("winsorized_mean", L.winsorized_mean, "WITH q AS (SELECT quantile_cont(l_extendedprice, 0.1) AS lo, quantile_cont(l_extendedprice, 0.9) AS hi FROM lineitem) SELECT avg(greatest(least(l_extendedprice, hi), lo)) AS value FROM lineitem, q")
scalar("mirror_centrality", lambda t, c: L.mirror_centrality(t, c, F.sqrt, lambda v: v * v), "pow(avg(sqrt(l_extendedprice)), 2)")
scalar("std", V.std, "stddev_samp(l_extendedprice)")
scalar("variance", V.variance, "var_samp(l_quantity)", "l_quantity")
scalar("weighted_std", V.std, "WITH m AS (SELECT sum(l_quantity * l_extendedprice) / sum(l_quantity) AS m FROM lineitem) SELECT sqrt(count(*) / (count(*) - 1.0) * sum(l_quantity * (l_extendedprice - m) * (l_extendedprice - m)) / sum(l_quantity)) AS value FROM lineitem, m", weight="l_quantity")
scalar("mean_abs_dev", V.mad, "WITH m AS (SELECT avg(l_extendedprice) AS m FROM lineitem) SELECT avg(abs(l_extendedprice - m)) AS value FROM lineitem, m")
scalar("median_abs_dev", V.median_absolute_deviation, "mad(l_extendedprice)")
scalar("mirror_variability", lambda t, c: V.mirror_variability(t, c, lambda x: x * x, F.sqrt), "stddev_pop(l_extendedprice)")
scalar("coefficient_of_variation", V.coefficient_of_variation, "stddev_samp(l_extendedprice) / abs(avg(l_extendedprice))", digits=6)
scalar("quantile_spread", lambda t, c: V.quantile_spread(t, c, 0.8), "quantile_cont(l_extendedprice, 0.9) - quantile_cont(l_extendedprice, 0.1)")
scalar("iqr", V.iqr, "quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)")
scalar("decile_range", V.decile_range, "quantile_cont(l_extendedprice, 0.9) - quantile_cont(l_extendedprice, 0.1)")
scalar("semi_interquartile_range", V.semi_interquartile_range, "(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)) / 2", digits=6)
scalar("normalized_iqr", V.normalized_iqr, "(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)) / abs(median(l_extendedprice))", digits=6)
scalar("data_range", V.data_range, "max(l_extendedprice) - min(l_extendedprice)")
scalar("gini_coefficient", V.gini_coefficient, f"SELECT 2 * sum(rn * x) / (max(n) * sum(x)) - (max(n) + 1.0) / max(n) AS value FROM ({_RANKED})", digits=6)


@register("quantiles", "SELECT q, round(v, 4) AS value FROM (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9]::DOUBLE[]) AS q, unnest(quantile_cont(l_extendedprice, [0.1, 0.25, 0.5, 0.75, 0.9])) AS v FROM lineitem)")
def _(spark, d):
    q = [0.1, 0.25, 0.5, 0.75, 0.9]
    one = L.quantiles(table(spark, d, "lineitem"), "l_extendedprice", q)
    return rounded(one.select(F.explode(F.arrays_zip(F.array(*[F.lit(x) for x in q]).alias("q"), F.col("values").alias("value"))).alias("s")).select("s.*"), 4)


@register("hodges_lehmann", "SELECT round(median((a.p_retailprice + b.p_retailprice) / 2), 4) AS value FROM (SELECT p_retailprice, row_number() OVER (ORDER BY p_retailprice) AS rn FROM part) a JOIN (SELECT p_retailprice, row_number() OVER (ORDER BY p_retailprice) AS rn FROM part) b ON a.rn <= b.rn")
def _(spark, d):
    return rounded(L.hodges_lehmann(table(spark, d, "part"), "p_retailprice"), 4)


_HIST = """WITH x AS (SELECT l_extendedprice AS x FROM lineitem), e AS (SELECT min(x) AS lo, max(x) AS hi, count(*) AS total FROM x),
k AS (SELECT CAST(least(floor((x - lo) / (hi - lo) * 30), 29) AS INTEGER) AS bin, lo, hi, total FROM x, e)
SELECT 'l_extendedprice' AS "column", bin, round(lo + bin * ((hi - lo) / 30), 4) AS low, round(lo + (bin + 1) * ((hi - lo) / 30), 4) AS high, count(*) AS n, round(count(*) / (total * ((hi - lo) / 30)), 4) AS density FROM k GROUP BY bin, lo, hi, total"""


@register("histogram_30", _HIST)
def _(spark, d):
    return rounded(S.histogram(table(spark, d, "lineitem"), ["l_extendedprice"]), 4)


@register("boxplot_stats", f'SELECT "column", round(min(x), 4) AS low, round(quantile_cont(x, 0.25), 4) AS lower, round(median(x), 4) AS median, round(quantile_cont(x, 0.75), 4) AS upper, round(max(x), 4) AS high {_UNPIVOT}')
def _(spark, d):
    return rounded(S.box_stats(table(spark, d, "lineitem"), list(COLS)), 4)


# pairs

_D = "(SELECT CAST(o_orderdate AS DATE) AS day, CAST(sum(o_totalprice) AS DOUBLE) AS total, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1)"


def daily(spark: SparkSession, d: str) -> DataFrame:
    """Orders summed by day: day, total, n."""
    return table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").cast("double").alias("total"), F.count(F.lit(1)).cast("double").alias("n"))


_MATRIX_PAIRS = [(a, b) for a in COLS for b in COLS]


def _matrix_sql(source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS \"row\", '{b}' AS col, round(covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})), 6) + 0.0 AS value, count(*) AS n FROM {source}" for a, b in _MATRIX_PAIRS)


@register("pearson_matrix", _matrix_sql("lineitem"))
def _(spark, d):
    return rounded(A.correlation_matrix(table(spark, d, "lineitem"), list(COLS)))


_RANKS = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS {c}" for c in COLS)


@register("spearman_matrix", f"WITH r AS (SELECT {_RANKS} FROM lineitem) {_matrix_sql('r')}")
def _(spark, d):
    return rounded(A.correlation_matrix(table(spark, d, "lineitem"), list(COLS), metric=A.SPEARMAN))


_TAU = f"""d AS (SELECT * FROM {_D}), p AS (SELECT sum(sign(a.total - b.total) * sign(a.n - b.n)) AS s, sum(CASE WHEN a.total <> b.total THEN 1 ELSE 0 END) AS x, sum(CASE WHEN a.n <> b.n THEN 1 ELSE 0 END) AS y
FROM d a JOIN d b ON a.day < b.day), t AS (SELECT s / (sqrt(CAST(x AS DOUBLE)) * sqrt(CAST(y AS DOUBLE))) AS tau FROM p)"""


@register("kendall_pair", f"WITH {_TAU} SELECT round(tau, 6) AS value, (SELECT count(*) FROM d) AS n FROM t")
def _(spark, d):
    return rounded(A.associate(daily(spark, d), "total", "n", A.KENDALL))


@register("stepanov_pair", f"WITH {_TAU}, r AS (SELECT rank() OVER (ORDER BY total) + (count(*) OVER (PARTITION BY total) - 1) / 2.0 AS x, rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0 AS y FROM d) SELECT round((3 * (SELECT tau FROM t) - corr(x, y)) / 2, 6) AS value, count(*) AS n FROM r")
def _(spark, d):
    return rounded(A.associate(daily(spark, d), "total", "n", A.STEPANOV))


def _xi_sql(x: str, y: str, name: str) -> str:
    return f"""SELECT '{name}' AS direction, round(1 - n * sum(abs(nr - r)) / (2 * sum(l * (n - l))), 6) AS value, CAST(n AS BIGINT) AS n FROM (
SELECT r, l, n, lead(r) OVER (ORDER BY a, i) AS nr FROM (SELECT {x} AS a, event_id AS i, CAST(count(*) OVER (ORDER BY {y} RANGE UNBOUNDED PRECEDING) AS DOUBLE) AS r,
CAST(count(*) OVER (ORDER BY {y} DESC RANGE UNBOUNDED PRECEDING) AS DOUBLE) AS l, CAST(count(*) OVER () AS DOUBLE) AS n FROM events)) GROUP BY n"""


@register("xi_pair", _xi_sql("value", "user_id", "value>user") + " UNION ALL " + _xi_sql("user_id", "value", "user>value"))
def _(spark, d):
    e = table(spark, d, "events")
    a = A.associate(e, "value", "user_id", A.XI, order="event_id").select(F.lit("value>user").alias("direction"), "value", "n")
    return rounded(a.union(A.associate(e, "user_id", "value", A.XI, order="event_id").select(F.lit("user>value"), "value", "n")))


_C = "(SELECT quality AS r, toxic AS c, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1, 2)"


@register("somers_d", f"WITH t AS (SELECT * FROM {_C}) SELECT round(sum(sign(b.c - a.c) * a.n * b.n) / sum(a.n * b.n), 6) AS value, CAST((SELECT sum(n) FROM t) AS BIGINT) AS n FROM t a JOIN t b ON b.r > a.r")
def _(spark, d):
    found = A.somers_d(A.contingency(table(spark, d, "labels"), "quality", "toxic"))
    value = F.lit(found["value"]).cast("double")
    return rounded(spark.range(1).select(value.alias("value"), F.lit(found["n"]).cast("long").alias("n")))


_ERR = f"(SELECT total, n * 150000.0::DOUBLE AS other, lag(total) OVER (ORDER BY day) AS base FROM {_D})"


def _models(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    return daily(spark, d).select("day", "total", (F.col("n") * 150000.0).alias("other"), F.lag("total").over(Window.orderBy("day")).alias("base"))


@register("relative_improvement", f"SELECT round(avg((total - base) * (other - base)) / (sqrt(avg((total - base) * (total - base))) * sqrt(avg((other - base) * (other - base)))), 6) AS value FROM {_ERR} WHERE base IS NOT NULL")
def _(spark, d):
    return rounded(A.relative_model_improvement(_models(spark, d), "total", "other", "base"))


@register("error_correlation", f"SELECT round(corr(total - base, other - base), 6) AS value, count(*) AS n FROM {_ERR} WHERE base IS NOT NULL")
def _(spark, d):
    return rounded(A.error_correlation(_models(spark, d), "total", "other", "base"))


def _auto_sql(columns: tuple[str, ...], lags: range) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {k} AS lag, round(corr(x, y), 6) AS value, count(*) AS n FROM (SELECT {c} AS x, lead({c}, {k}) OVER (ORDER BY day) AS y FROM {_D}) WHERE y IS NOT NULL" for c in columns for k in lags)


@register("autocorrelation_series", _auto_sql(("total",), range(1, 8)))
def _(spark, d):
    return rounded(A.auto_correlation(daily(spark, d), "total", 7, "day"))


@register("autocorrelation_matrix", _auto_sql(("total", "n"), range(1, 5)))
def _(spark, d):
    return rounded(A.auto_correlation(daily(spark, d), ["total", "n"], 4, "day"))


# series

_G = f"(SELECT c.day, d.total FROM (SELECT CAST(unnest(generate_series((SELECT min(day) FROM {_D}), (SELECT max(day) FROM {_D}), INTERVAL 1 DAY)) AS DATE) AS day) c LEFT JOIN {_D} d ON c.day = d.day)"
_GN = f"(SELECT day, CASE WHEN dayofyear(day) % 11 < 3 THEN NULL ELSE total END AS total FROM {_G})"


def calendar(spark: SparkSession, d: str) -> DataFrame:
    """Every day of the calendar with the day's total, missing where there are no orders, and on three days of eleven."""
    t = daily(spark, d)
    days = t.agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    total = F.when(F.dayofyear("day") % 11 < 3, None).otherwise(F.col("total"))
    return days.join(t.select("day", "total"), "day", "left").select("day", total.alias("total"))


def gaps(spark: SparkSession, d: str) -> SeriesFrame:
    return SeriesFrame(calendar(spark, d), "day", ["total"], freq="D")


@register("frequency_inference", f"SELECT CASE WHEN min(g) = max(g) THEN CASE WHEN min(g) = 1 THEN 'D' ELSE CAST(min(g) AS VARCHAR) || 'D' END ELSE 'irregular time' END AS daily, (SELECT CASE WHEN min(g) = 1 AND max(g) = 1 THEN 'D' ELSE 'irregular time' END FROM (SELECT day - lag(day) OVER (ORDER BY day) AS g FROM {_G})) AS calendar FROM (SELECT day - lag(day) OVER (ORDER BY day) AS g FROM {_D})")
def _(spark, d):
    a, b = SeriesFrame(daily(spark, d), "day").freq, SeriesFrame(calendar(spark, d), "day").freq
    return spark.range(1).select(F.lit(a).alias("daily"), F.lit(b).alias("calendar"))


@register("lag_time", f"SELECT day + 3 AS day, round(total, 4) AS total FROM {_GN}")
def _(spark, d):
    return rounded(gaps(spark, d).lag(3).df, 4)


_E = "(SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"


def by_user(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, d, "events")
    return e.select("user_id", "event_id", "value", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("rn"))


def users(spark: SparkSession, d: str) -> SeriesFrame:
    return SeriesFrame(by_user(spark, d), "rn", ["value"], ["user_id"], freq=1)


@register("lag_rows", f"SELECT user_id, rn, round(lag(value, 2) OVER (PARTITION BY user_id ORDER BY rn), 6) AS value FROM {_E}")
def _(spark, d):
    f = SeriesFrame(by_user(spark, d).withColumn("key", F.format_string("%06d", "rn")), "key", ["value"], ["user_id"])
    return rounded(f.lag(2).df.select("user_id", "rn", "value"))


_FILLS = {
    "mean": "coalesce(total, avg(total) OVER ())",
    "median": "coalesce(total, (SELECT median(total) FROM g))",
    "ffill": "last_value(total IGNORE NULLS) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING)",
    "bfill": "first_value(total IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)",
}
for _m, _sql in _FILLS.items():
    register(f"fill_{_m}", f"WITH g AS (SELECT * FROM {_GN}) SELECT day, round({_sql}, 4) AS total FROM g")(lambda spark, d, m=_m: rounded(gaps(spark, d).fill_missing(m).df, 4))
register("fill_ffill_limit", f"WITH g AS (SELECT * FROM {_GN}) SELECT day, round(last_value(total IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), 4) AS total FROM g")(lambda spark, d: rounded(gaps(spark, d).fill_missing("ffill", limit=1).df, 4))
register("fill_mean_limit", f"WITH g AS (SELECT * FROM {_GN}) SELECT day, round(CASE WHEN total IS NULL AND sum(CASE WHEN total IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) <= 5 THEN avg(total) OVER () ELSE total END, 4) AS total FROM g")(lambda spark, d: rounded(gaps(spark, d).fill_missing("mean", limit=5).df, 4))
register("fill_linear", f"""WITH g AS (SELECT day, total, row_number() OVER (ORDER BY day) AS rn FROM {_GN}),
k AS (SELECT *, last_value(CASE WHEN total IS NOT NULL THEN rn END IGNORE NULLS) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS ra, last_value(total IGNORE NULLS) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS xa,
first_value(CASE WHEN total IS NOT NULL THEN rn END IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rb, first_value(total IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS xb FROM g)
SELECT day, round(CASE WHEN total IS NOT NULL THEN total WHEN rb IS NULL THEN xa ELSE xa + (xb - xa) * (rn - ra) / (rb - ra) END, 6) AS total FROM k""")(lambda spark, d: rounded(gaps(spark, d).fill_missing("linear").df, 6))
def millions(spark: SparkSession, d: str) -> SeriesFrame:
    """The calendar series in millions."""
    return SeriesFrame(calendar(spark, d).withColumn("total", F.col("total") / 1e6), "day", ["total"], freq="D")


register("fill_spline")(lambda spark, d: rounded(millions(spark, d).fill_missing("spline").df, 6))
register("smooth_spline")(lambda spark, d: rounded(millions(spark, d).smooth("spline", s=150.0).df, 6))
register("rolling_mean_centered", f"SELECT day, round(avg(total) OVER (ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 4) AS total FROM {_GN}")(lambda spark, d: rounded(gaps(spark, d).smooth("rolling_mean", 5).df, 4))
register("rolling_mean_trailing", f"SELECT day, round(avg(total) OVER (ORDER BY day ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 4) AS total FROM {_GN}")(lambda spark, d: rounded(gaps(spark, d).smooth("rolling_mean", 4, center=False).df, 4))


def _roll(expr: str, rows: int) -> str:
    return f"SELECT user_id, rn, round(CASE WHEN count(value) OVER w >= {rows} THEN {expr} OVER w END, 6) AS value FROM {_E} WINDOW w AS (PARTITION BY user_id ORDER BY rn ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"


for _m, _e in {"median": "median(value)", "std": "stddev_samp(value)", "max": "max(value)"}.items():
    register(f"rolling_{_m}", _roll(_e, 10))(lambda spark, d, m=_m: rounded(rolling.unary(users(spark, d), m, 10)))
register("rolling_time_window", f"SELECT day, round(avg(total) OVER (ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW), 4) AS total FROM {_D}")(
    lambda spark, d: rounded(rolling.unary(SeriesFrame(daily(spark, d).withColumn("day", F.col("day").cast("timestamp")), "day", ["total"]), "mean", "7D").withColumn("day", F.to_date("day")), 4)
)
register("kalman_smooth", f"""WITH RECURSIVE e AS (SELECT user_id, rn, value FROM {_E} WHERE user_id % 10 = 1),
k AS (SELECT user_id, rn, value AS x, (1 + 0.00001::DOUBLE) * 0.01::DOUBLE / (1 + 0.00001::DOUBLE + 0.01::DOUBLE) AS p FROM e WHERE rn = 1
UNION ALL SELECT e.user_id, e.rn, k.x + (k.p + 0.00001::DOUBLE) / (k.p + 0.00001::DOUBLE + 0.01::DOUBLE) * (e.value - k.x), (k.p + 0.00001::DOUBLE) * 0.01::DOUBLE / (k.p + 0.00001::DOUBLE + 0.01::DOUBLE) FROM k JOIN e ON e.user_id = k.user_id AND e.rn = k.rn + 1)
SELECT user_id, rn, round(x, 6) AS value FROM k""")(lambda spark, d: rounded(SeriesFrame(by_user(spark, d).where("user_id % 10 = 1").drop("event_id"), "rn", ["value"], ["user_id"], 1).smooth("kalman").df.select("user_id", "rn", "value")))
# the query above has the users of its fixed SQL only; this one has all
register("kalman_smooth_all", ORACLES["kalman_smooth"].replace(" WHERE user_id % 10 = 1", ""))(lambda spark, d: rounded(SeriesFrame(by_user(spark, d).drop("event_id"), "rn", ["value"], ["user_id"], 1).smooth("kalman").df.select("user_id", "rn", "value")))

_EW = "sum({f} * pow(0.9::DOUBLE, -(rn - 1))) OVER w / sum(pow(0.9::DOUBLE, -(rn - 1))) OVER w"
_W = "WINDOW w AS (PARTITION BY user_id ORDER BY rn ROWS UNBOUNDED PRECEDING)"
_CENTRED = f"(SELECT user_id, rn, value - {_EW.format(f='value')} AS e, rn - {_EW.format(f='rn')} AS g FROM {_E} {_W})"
register("ewm_mean", f"SELECT user_id, rn, round({_EW.format(f='value')}, 6) AS value FROM {_E} {_W}")(lambda spark, d: rounded(ewm.mean(users(spark, d), 0.9)))
register("ewm_moment", f"SELECT user_id, rn, round({_EW.format(f='pow(abs(value), 2)')}, 4) AS value FROM {_E} {_W}")(lambda spark, d: rounded(ewm.moment(users(spark, d), 0.9, 2, True), 4))
register("ewm_std", f"SELECT user_id, rn, round(sqrt({_EW.format(f='e * e')}), 6) AS value FROM {_CENTRED} {_W}")(lambda spark, d: rounded(ewm.std(users(spark, d), 0.9)))


def _two(spark, d) -> SeriesFrame:
    return SeriesFrame(by_user(spark, d).withColumn("seq", F.col("rn").cast("double")), "rn", ["value", "seq"], ["user_id"], freq=1)


_SQ = {(a, b): _EW.format(f=f"{x} * {y}") for a, x in (("value", "e"), ("seq", "g")) for b, y in (("value", "e"), ("seq", "g"))}
register("ewm_cov", "SELECT user_id, rn, " + ", ".join(f"round({s}, 4) + 0.0 AS {a}_{b}" for (a, b), s in _SQ.items()) + f" FROM {_CENTRED} {_W}")(lambda spark, d: rounded(ewm.covariance(_two(spark, d), 0.9), 4))
register("ewm_corr", "SELECT user_id, rn, " + ", ".join(f"round(c_{a}_{b} / (CASE WHEN sqrt(c_{a}_{a}) * sqrt(c_{b}_{b}) = 0 THEN 1e-12 ELSE sqrt(c_{a}_{a}) * sqrt(c_{b}_{b}) END), 4) + 0.0 AS {a}_{b}" for a, b in _SQ) + " FROM (SELECT user_id, rn, " + ", ".join(f"{s} AS c_{a}_{b}" for (a, b), s in _SQ.items()) + f" FROM {_CENTRED} {_W})")(lambda spark, d: rounded(ewm.correlation(_two(spark, d), 0.9), 4))

_PAIR = "CASE WHEN count(*) OVER w >= 20 THEN covar_pop({x}, {y}) OVER w / nullif(stddev_pop({x}) OVER w * stddev_pop({y}) OVER w, 0) END"
register("rolling_corr", f"SELECT day, round(CASE WHEN count(*) OVER w >= 20 THEN 1.0 END, 5) AS \"total>total\", round({_PAIR.format(x='total', y='n')}, 5) AS \"total>n\", round({_PAIR.format(x='n', y='total')}, 5) AS \"n>total\", round(CASE WHEN count(*) OVER w >= 20 THEN 1.0 END, 5) AS \"n>n\" FROM {_D} WINDOW w AS (ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")(
    lambda spark, d: rounded(rolling.correlation(SeriesFrame(daily(spark, d), "day", ["total", "n"]), window=20), 5)
)
register("rolling_corr_spearman", f"SELECT user_id, rn, CASE WHEN rn >= 10 AND max(value) OVER w > min(value) OVER w THEN 1.0::DOUBLE END AS \"value>value\" FROM {_E} WINDOW w AS (PARTITION BY user_id ORDER BY rn ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")(lambda spark, d: rounded(rolling.correlation(users(spark, d), A.SPEARMAN, 10), 6))
_FRAMES = f"(SELECT a.user_id, a.rn, b.value AS x, (b.event_id * 7919 % 1009)::DOUBLE AS y FROM {_E} a JOIN {_E} b ON a.user_id = b.user_id AND b.rn BETWEEN a.rn - 9 AND a.rn WHERE a.rn >= 10)"
_FRAME_RANKS = f"(SELECT user_id, rn, rank() OVER (PARTITION BY user_id, rn ORDER BY x) + (count(*) OVER (PARTITION BY user_id, rn, x) - 1) / 2.0 AS x, rank() OVER (PARTITION BY user_id, rn ORDER BY y) + (count(*) OVER (PARTITION BY user_id, rn, y) - 1) / 2.0 AS y FROM {_FRAMES})"
register("rolling_rank_pair", f"SELECT e.user_id, e.rn, round(c, 6) + 0.0 AS value FROM {_E} e LEFT JOIN (SELECT user_id, rn, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) AS c FROM {_FRAME_RANKS} GROUP BY user_id, rn) r USING (user_id, rn)")(
    lambda spark, d: rounded(rolling.correlation(SeriesFrame(by_user(spark, d).withColumn("seq", (F.col("event_id") * 7919 % 1009).cast("double")), "rn", ["value", "seq"], ["user_id"], freq=1), A.SPEARMAN, 10).select("user_id", "rn", F.col("`value>seq`").alias("value")))
)
register("rolling_autocorr", f"SELECT day, " + ", ".join(f"round(CASE WHEN count(l{k}) OVER w >= 20 THEN covar_pop(l{k}, CASE WHEN l{k} IS NOT NULL THEN total END) OVER w / nullif(stddev_pop(l{k}) OVER w * stddev_pop(CASE WHEN l{k} IS NOT NULL THEN total END) OVER w, 0) END, 5) AS \"total_lag({k})>total\"" for k in (1, 2)) + f" FROM (SELECT day, total, lag(total, 1) OVER (ORDER BY day) AS l1, lag(total, 2) OVER (ORDER BY day) AS l2 FROM {_D}) WINDOW w AS (ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")(
    lambda spark, d: rounded(rolling.auto_correlation(SeriesFrame(daily(spark, d), "day", ["total"]), lags=[1, 2], window=20), 5)
)

# back-testing


def game(spark: SparkSession, d: str, unit: float = 1.0, **more) -> B.BacktestGame:
    rows = daily(spark, d).withColumns({"day": F.col("day").cast("timestamp"), "total": F.col("total") / unit})
    return B.BacktestGame(SeriesFrame(rows, "day", ["total"], freq="D"), target="total", **more)


def _days(df: DataFrame) -> DataFrame:
    """Midnights as dates."""
    return df.select(*[F.to_date(c).alias(c) if kind.startswith("timestamp") else F.col(c) for c, kind in df.dtypes])


_P = f"(SELECT day, total, row_number() OVER (ORDER BY day) AS rn, count(*) OVER () AS cnt FROM {_D})"
for _align, _where in {"front": "(rn - 1) % 7 = 0", "back": "(cnt - rn) % 7 = 0"}.items():
    register(f"backtest_steps_{_align}", f"SELECT day, CAST(rn AS INTEGER) AS position, CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS step_no, row_number() OVER (ORDER BY day) <= 2 AS is_warmup FROM {_P} WHERE {_where} AND rn >= 10")(
        lambda spark, d, a=_align: _days(game(spark, d, window_length=10, cadence=7, align=a, warmup_periods=2).steps().select("day", "position", "step_no", "is_warmup"))
    )
register("backtest_steps_calendar", f"""WITH RECURSIVE p AS (SELECT * FROM {_P}), s AS (SELECT min(day) AS day FROM p
UNION ALL SELECT (SELECT min(p.day) FROM p WHERE p.day >= s.day + 7) FROM s WHERE s.day + 7 <= (SELECT max(day) FROM p))
SELECT day, CAST(rn AS INTEGER) AS position, CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS step_no FROM s JOIN p USING (day) WHERE rn >= 10""")(lambda spark, d: _days(game(spark, d, window_length=10, cadence="7D").steps().select("day", "position", "step_no")))
register("backtest_windows", f"SELECT day, CAST(len(w) AS INTEGER) AS rows_held, round(w[1], 4) AS first_value, round(list_avg(w), 4) AS mean FROM (SELECT day, rn, list(total) OVER (ORDER BY day ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS w FROM {_P}) WHERE (rn - 1) % 7 = 0 AND rn >= 10")(
    lambda spark, d: rounded(
        _days(game(spark, d, window_length=10, cadence=7).windows(["day", "total"]).select("day", F.size("window").alias("rows_held"), F.col("window")[0]["total"].alias("first_value"), (F.aggregate("window", F.lit(0.0), lambda s, x: s + x["total"]) / F.size("window")).alias("mean"))), 4
    )
)
_TARGET = f"(SELECT s.day, s.total, s.day + 5 AS prediction_at, t.total AS y FROM (SELECT * FROM {_P} WHERE (rn - 1) % 7 = 0 AND rn >= 10) s ASOF LEFT JOIN {_D} t ON s.day + 5 <= t.day)"
register("backtest_targets", f"SELECT day, prediction_at, round(y, 4) AS y FROM {_TARGET}")(lambda spark, d: rounded(_days(game(spark, d, window_length=10, cadence=7, horizon="5D").targets().select("day", "prediction_at", "y")), 4))
register("backtest_persistence", f"SELECT day, prediction_at, round(total, 4) AS prediction, round(coalesce(0.5 * (y / 1000 - total / 1000) * (y / 1000 - total / 1000), 0), 3) AS scaled_loss FROM {_TARGET}")(
    lambda spark, d: rounded(_days(B.Backtester(game(spark, d, window_length=10, cadence=7, horizon="5D")).run(F.col("total")).predictions.select("day", "prediction_at", "prediction", F.round(F.col("loss") / 1e6, 3).alias("scaled_loss"))), 4)
)
_LEARNED = f"""WITH RECURSIVE t AS (SELECT day, prediction_at, y / 1000000 AS y, row_number() OVER (ORDER BY day) AS step_no FROM {_TARGET}),
g AS (SELECT 0::BIGINT AS k, 0.0::DOUBLE AS p, 0.0::DOUBLE AS theta UNION ALL SELECT step_no, theta, CASE WHEN y IS NULL THEN theta ELSE theta - 0.1::DOUBLE * (theta - y) END FROM g JOIN t ON t.step_no = g.k + 1)
SELECT day, CAST(step_no AS INTEGER) AS step_no, false AS is_warmup, prediction_at, round(p, 4) AS prediction, round(y, 4) AS y, round(coalesce(0.5 * (y - p) * (y - p), 0), 4) AS loss FROM g JOIN t ON t.step_no = g.k"""
register("backtest_learner", _LEARNED)(lambda spark, d: rounded(_days(B.Backtester(game(spark, d, window_length=10, cadence=7, horizon="5D", unit=1e6)).run(online.Gradient(1, rate=0.1)).predictions), 4))
register("backtest_monthly", f"""WITH RECURSIVE p AS (SELECT * FROM {_P}), s AS (SELECT min(day) AS day FROM p
UNION ALL SELECT (SELECT min(p.day) FROM p WHERE p.day >= date_trunc('month', s.day) + INTERVAL 1 MONTH) FROM s WHERE date_trunc('month', s.day) + INTERVAL 1 MONTH <= (SELECT max(day) FROM p)),
t AS (SELECT s.day, p.total, CAST(s.day + CAST(8 - isodow(s.day) AS INTEGER) AS DATE) AS prediction_at, rn FROM s JOIN p USING (day) WHERE rn >= 10)
SELECT t.day, CAST(rn AS INTEGER) AS position, CAST(row_number() OVER (ORDER BY t.day) AS INTEGER) AS step_no, prediction_at, round(d.total, 4) AS y FROM t ASOF LEFT JOIN {_D} d ON t.prediction_at <= d.day""")(
    lambda spark, d: rounded(_days(game(spark, d, window_length=10, cadence="MS", horizon="W-MON").targets().select("day", "position", "step_no", "prediction_at", "y")), 4)
)

# experts and online learning

_LOSSES = f"(SELECT CAST(row_number() OVER (PARTITION BY k ORDER BY day) AS BIGINT) AS t, CAST(k AS INTEGER) AS expert, 0.5 * pow(total / 1000000 - k / 5.0::DOUBLE, 2) AS loss FROM {_D}, (SELECT unnest(range(0, 6)) AS k))"


def expert_losses(spark: SparkSession, d: str) -> DataFrame:
    """Six constant experts (0, 0.2 .. 1 million) on the daily totals: t, expert, loss."""
    from pyspark.sql import Window

    k = F.explode(F.sequence(F.lit(0), F.lit(5))).alias("expert")
    rows = daily(spark, d).select("day", "total", k)
    t = F.row_number().over(Window.partitionBy("expert").orderBy("day")).cast("long")
    off = F.col("total") / 1e6 - F.col("expert") / 5.0
    return rows.select(t.alias("t"), "expert", (0.5 * F.pow(off, F.lit(2.0))).alias("loss"))


def _softmax_sql(score: str) -> str:
    return f"SELECT t, expert, loss, exp(s - max(s) OVER (PARTITION BY t)) / sum(exp(s - m)) OVER (PARTITION BY t) AS weight FROM (SELECT *, max(s) OVER (PARTITION BY t) AS m FROM (SELECT t, expert, loss, {score} AS s FROM {_LOSSES}))"


_CUM = "sum({f}) OVER (PARTITION BY expert ORDER BY t ROWS UNBOUNDED PRECEDING)"
register("hedge_weights", f"SELECT t, expert, round(weight, 6) AS weight FROM ({_softmax_sql('-0.5 * ' + _CUM.format(f='loss'))})")(lambda spark, d: rounded(experts.hedge(expert_losses(spark, d), 0.5).select("t", "expert", "weight")))
register("hedge_regret", f"SELECT t, round(c, 6) AS cost, round(sum(c) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING), 5) AS regret FROM (SELECT t, sum(weight * loss) AS c FROM ({_softmax_sql('-0.5 * ' + _CUM.format(f='loss'))}) GROUP BY t)")(
    lambda spark, d: rounded(experts.hedge_regret(experts.hedge(expert_losses(spark, d), 0.5)).select("t", F.round("cost", 6).alias("cost"), F.round("regret", 5).alias("regret")))
)
register("aggregating_loss", f"SELECT t, round(-ln(sum(weight * exp(-loss))), 6) AS cost FROM ({_softmax_sql('-' + _CUM.format(f='loss'))}) GROUP BY t")(lambda spark, d: rounded(experts.hedge_regret(experts.hedge(expert_losses(spark, d), 1.0), mixture=True).select("t", "cost")))
register("time_hedge", f"SELECT t, expert, round(weight, 5) AS weight FROM ({_softmax_sql('-(0.5 * ' + _CUM.format(f='loss') + ' + 0.5 * ' + _CUM.format(f='loss * sin(t / 10.0)') + ' * sin(t / 10.0))')})")(
    lambda spark, d: rounded(experts.time_hedge(expert_losses(spark, d), [F.lit(1.0), F.sin(F.col("t") / 10.0)], 0.5).select("t", "expert", "weight"), 5)
)


def _scaled(spark: SparkSession, d: str) -> DataFrame:
    return daily(spark, d).select("day", (F.col("total") / 1e6).alias("y"))


def _online(make: Callable[[], online.Learner], digits: int = 6) -> Query:
    def run(spark, d):
        out = online.run_online(_scaled(spark, d), make(), "day", "y")
        return rounded(out.select("day", F.col("prediction")[0].alias("prediction"), "loss", "regret"), digits)

    return run


def _constants() -> list:
    return [online.Constant(k / 5) for k in range(6)]


register("gradient_descent", f"""WITH RECURSIVE y AS (SELECT day, total / 1000000 AS y, row_number() OVER (ORDER BY day) AS rn FROM {_D}),
g AS (SELECT day, rn, 0.0::DOUBLE AS p, y, 0.1::DOUBLE * y AS theta FROM y WHERE rn = 1
UNION ALL SELECT y.day, y.rn, g.theta, y.y, g.theta - 0.1::DOUBLE * (g.theta - y.y) FROM g JOIN y ON y.rn = g.rn + 1)
SELECT day, round(p, 6) AS prediction, round(0.5 * (p - y) * (p - y), 6) AS loss, round(sum(0.5 * (p - y) * (p - y)) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING), 6) AS regret FROM g""")(_online(lambda: online.Gradient(1, rate=0.1)))
register("adam", f"""WITH RECURSIVE y AS (SELECT day, total / 1000000 AS y, row_number() OVER (ORDER BY day) AS rn FROM {_D}),
g AS (SELECT day, rn, 0.0::DOUBLE AS p, y, -0.1::DOUBLE * y AS m, 0.001::DOUBLE * y * y AS v, 0.1::DOUBLE * y / (abs(y) + 1e-8) AS theta FROM y WHERE rn = 1
UNION ALL SELECT day, rn, theta, y, m, v, theta - 0.1::DOUBLE * (m / (1 - pow(0.9::DOUBLE, rn))) / (sqrt(v / (1 - pow(0.999::DOUBLE, rn))) + 1e-8) FROM
(SELECT y.day, y.rn, g.theta, y.y, 0.9::DOUBLE * g.m + 0.1::DOUBLE * (g.theta - y.y) AS m, 0.999::DOUBLE * g.v + 0.001::DOUBLE * (g.theta - y.y) * (g.theta - y.y) AS v FROM g JOIN y ON y.rn = g.rn + 1))
SELECT day, round(p, 5) AS prediction, round(0.5 * (p - y) * (p - y), 5) AS loss, round(sum(0.5 * (p - y) * (p - y)) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING), 5) AS regret FROM g""")(_online(lambda: online.Adam(1, rate=0.1), 5))
register("newton_step", R.newton(_D))(_online(lambda: online.NewtonStep(1, rate=0.1, epsilon=1.0)))
register("forgetful_newton_step", R.forgetful_newton(_D))(_online(lambda: online.ForgetfulNewtonStep(1, rate=0.1, epsilon=1.0)))
register("mirror_descent", R.gradient(_D, "0.0", {}, "(2 * theta - 0.1::DOUBLE * s) / 2"))(_online(lambda: online.MirrorDescent(1, rate=0.1)))
register("exponential_gradient", R.gradient(_D, "1.0", {}, "theta * exp(-0.1::DOUBLE * s)"))(_online(lambda: online.ExponentialGradient(np.ones(1), rate=0.1)))
register("fkm", R.bandit_descent(_D))(_online(lambda: online.FKM(1, rate=0.001, delta=0.1)))
register("averaged_iterates", R.gradient(_D, "0.0", {}, "theta - 0.1::DOUBLE * s"))(_online(lambda: online.Averaged(online.Gradient(1, rate=0.1))))
register("sign_linear", R.sign_linear(_D))(_online(lambda: online.SignLinear(1)))
register("exp3")(_online(lambda: online.Exp3(_constants(), rate=0.1, seed=1)))
register("exp3_median", R.exp3_median(_D))(_online(lambda: online.Exp3(_constants(), rate=0.1, strategy="median")))
register("ucb", R.upper_bounds(_D))(_online(lambda: online.UCB(_constants())))
register("fixed_share", R.fixed_share(_D))(_online(lambda: online.FixedShare(_constants())))
register("time_fixed_share", R.time_fixed_share(_D))(_online(lambda: online.TimeFixedShare(_constants(), features=_time_features)))


def _time_features(t: int) -> np.ndarray:
    return np.array([1.0, np.sin(t / 10)])


# clustering


def whole_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The embeddings."""
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("seq"), F.transform("embedding", lambda v: v.cast("double")).alias("features"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """The first four dimensions of the embeddings, for queries whose fixed SQL has only these."""
    return whole_vectors(spark, d).withColumn("features", F.slice("features", 1, 4))


def seeds(spark: SparkSession, d: str, of: Query = whole_vectors) -> np.ndarray:
    """The first five vectors by id: fixed centres to begin with."""
    return np.array([r["features"] for r in of(spark, d).orderBy("seq").limit(5).collect()])


def centre_rows(spark: SparkSession, centers: np.ndarray, digits: int = 6) -> DataFrame:
    return rounded(spark.createDataFrame([(k, i, float(v)) for k, row in enumerate(centers) for i, v in enumerate(row)], "cluster int, dim int, value double"), digits)


_VEC = "v AS (SELECT vec_id, CAST(embedding[1:4] AS DOUBLE[]) AS x FROM embeddings), c AS (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS k, x AS m FROM (SELECT * FROM v ORDER BY vec_id LIMIT 5)), dist AS (SELECT vec_id, k, x, m, list_distance(x, m) AS d FROM v, c)"
_OWN = "o AS (SELECT *, min(d) OVER (PARTITION BY vec_id) AS least, sum(d) OVER (PARTITION BY vec_id) AS total, row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1 AS own FROM dist)"
_STEP = "SELECT k AS cluster, CAST(i - 1 AS INTEGER) AS dim, round(sum(w * x[i]) / sum(w), 6) AS value FROM w, (SELECT unnest([1, 2, 3, 4]) AS i) GROUP BY k, i"
register("kmeans_weighted_step", f"WITH {_VEC}, {_OWN}, w AS (SELECT k, x, CASE WHEN own THEN d + 2 * total WHEN d = 0 THEN 0 ELSE least * least / d END AS w FROM o) {_STEP}")(lambda spark, d: centre_rows(spark, C.WeightedKMeans(5).step(vectors(spark, d), seeds(spark, d, vectors))))
register("kmeans_inverse_step", f"WITH {_VEC}, {_OWN}, w AS (SELECT k, x, CASE WHEN d = 0 THEN 0 ELSE 2 * pow(least, 2) / pow(d, 4) END AS w FROM o) {_STEP}")(lambda spark, d: centre_rows(spark, C.InverseWeightedKMeans(5).step(vectors(spark, d), seeds(spark, d, vectors))))
register("kmeans_assign", f"WITH {_VEC}, {_OWN} SELECT vec_id AS seq, k AS cluster FROM o WHERE own")(lambda spark, d: C.WeightedKMeans(5, centers=seeds(spark, d, vectors)).predict(vectors(spark, d)).select("seq", "cluster"))
register("kmeans_score", f"WITH {_VEC} SELECT round(-sum(d2), 4) AS score FROM (SELECT min(d * d) AS d2 FROM dist GROUP BY vec_id)")(lambda spark, d: rounded(spark.range(1).select(F.lit(C.WeightedKMeans(5, centers=seeds(spark, d, vectors)).score(vectors(spark, d))).alias("score")), 4))
register("kmeans_transform", f"WITH {_VEC} SELECT vec_id AS seq, k AS cluster, round(d, 6) AS distance FROM dist")(
    lambda spark, d: rounded(C.WeightedKMeans(5, centers=seeds(spark, d, vectors)).transform(vectors(spark, d)).select("seq", F.posexplode("distances").alias("cluster", "distance")))
)
# the queries above have four dimensions, as their fixed SQL has; these have all
_WHOLE, _WHOLE_STEP = _VEC.replace("embedding[1:4]", "embedding"), _STEP.replace("[1, 2, 3, 4]", "range(1, 1 + (SELECT max(len(embedding)) FROM embeddings))")
register("kmeans_weighted_step_all", f"WITH {_WHOLE}, {_OWN}, w AS (SELECT k, x, CASE WHEN own THEN d + 2 * total WHEN d = 0 THEN 0 ELSE least * least / d END AS w FROM o) {_WHOLE_STEP}")(lambda spark, d: centre_rows(spark, C.WeightedKMeans(5).step(whole_vectors(spark, d), seeds(spark, d))))
register("kmeans_inverse_step_all", f"WITH {_WHOLE}, {_OWN}, w AS (SELECT k, x, CASE WHEN d = 0 THEN 0 ELSE 2 * pow(least, 2) / pow(d, 4) END AS w FROM o) {_WHOLE_STEP}")(lambda spark, d: centre_rows(spark, C.InverseWeightedKMeans(5).step(whole_vectors(spark, d), seeds(spark, d))))
register("kmeans_assign_all", f"WITH {_WHOLE}, {_OWN} SELECT vec_id AS seq, k AS cluster FROM o WHERE own")(lambda spark, d: C.WeightedKMeans(5, centers=seeds(spark, d)).predict(whole_vectors(spark, d)).select("seq", "cluster"))
register("kmeans_score_all", f"WITH {_WHOLE} SELECT round(-sum(d2), 4) AS score FROM (SELECT min(d * d) AS d2 FROM dist GROUP BY vec_id)")(lambda spark, d: rounded(spark.range(1).select(F.lit(C.WeightedKMeans(5, centers=seeds(spark, d)).score(whole_vectors(spark, d))).alias("score")), 4))
register("kmeans_transform_all", f"WITH {_WHOLE} SELECT vec_id AS seq, k AS cluster, round(d, 6) AS distance FROM dist")(
    lambda spark, d: rounded(C.WeightedKMeans(5, centers=seeds(spark, d)).transform(whole_vectors(spark, d)).select("seq", F.posexplode("distances").alias("cluster", "distance")))
)
register("kmeans_weighted", R.weighted_means())(lambda spark, d: centre_rows(spark, C.WeightedKMeans(5).fit(whole_vectors(spark, d), seeds(spark, d)).centers))
register("kmeans_online", R.winner_means())(lambda spark, d: centre_rows(spark, C.OnlineKMeans(5).fit(whole_vectors(spark, d), seeds(spark, d)).centers))
register("kmeans_iw_v1", R.inverse_mass_means())(lambda spark, d: centre_rows(spark, C.InverseWeightedOnlineKMeansV1(5, n=3).fit(whole_vectors(spark, d), seeds(spark, d) + 0.01).centers))
register("kmeans_iw_v2", R.inverse_gradient_means())(lambda spark, d: centre_rows(spark, C.InverseWeightedOnlineKMeansV2(5, learning_rate=0.001).fit(whole_vectors(spark, d), seeds(spark, d) + 0.01).centers))
register("kharmonic", R.harmonic_means())(lambda spark, d: centre_rows(spark, C.KHarmonicMeans(5).fit(whole_vectors(spark, d), seeds(spark, d)).centers))
_XI_DAY = """SELECT 1 - n * sum(abs(nr - r)) / (2 * sum(l * (n - l))) AS value FROM (
SELECT r, l, n, lead(r) OVER (ORDER BY a, day) AS nr FROM (SELECT {x} AS a, day, CAST(count(*) OVER (ORDER BY {y} RANGE UNBOUNDED PRECEDING) AS DOUBLE) AS r,
CAST(count(*) OVER (ORDER BY {y} DESC RANGE UNBOUNDED PRECEDING) AS DOUBLE) AS l, CAST(count(*) OVER () AS DOUBLE) AS n FROM d)) GROUP BY n"""
_ASSOCIATION = f"""WITH {_TAU}, r AS (SELECT rank() OVER (ORDER BY total) + (count(*) OVER (PARTITION BY total) - 1) / 2.0 AS x, rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0 AS y FROM d),
a AS (SELECT 'pearson' AS metric, 'total > n' AS pair, (SELECT corr(total, n) FROM d) AS value UNION ALL SELECT 'spearman', 'total > n', (SELECT corr(x, y) FROM r) UNION ALL SELECT 'kendall', 'total > n', (SELECT tau FROM t)
UNION ALL SELECT 'xi', 'total > n', ({_XI_DAY.format(x="total", y="n")}) UNION ALL SELECT 'xi', 'n > total', ({_XI_DAY.format(x="n", y="total")}))
SELECT metric, pair, round(value, 6) AS value FROM a"""
register("association_summary", _ASSOCIATION)(lambda spark, d: rounded(S.EDACorrelationSummary(daily(spark, d), order="day").table()))
_AUTO_RANK = " UNION ALL ".join(f"SELECT 'spearman' AS metric, '{c}' AS \"column\", {k} AS lag, round(corr(x, y), 6) AS value FROM (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS x, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS y FROM (SELECT {c} AS a, lead({c}, {k}) OVER (ORDER BY day) AS b FROM {_D}) WHERE b IS NOT NULL)" for c in ("total", "n") for k in (1, 2, 3))
register("autocorrelation_summary", "SELECT 'pearson' AS metric, \"column\", lag, value FROM (" + _auto_sql(("total", "n"), range(1, 4)) + ") UNION ALL " + _AUTO_RANK)(lambda spark, d: rounded(S.EDAAutoCorrelationSummary(daily(spark, d), "day", 3).table()))
register("as_of_backward", f"SELECT user_id, event_id, round(total, 4) AS total, CAST(matched AS DATE) AS matched_at FROM (SELECT e.user_id, e.event_id, CAST(e.ts AS DATE) AS day FROM events e) e ASOF LEFT JOIN (SELECT day + 2 AS matched, total FROM {_D}) d ON e.day >= d.matched")(
    lambda spark, d: rounded(B.as_of(table(spark, d, "events").select("user_id", "event_id", F.to_date("ts").alias("day")), daily(spark, d).select(F.date_add("day", 2).alias("at"), "total"), "day", "at", ["total"]).drop("day"), 4)
)
