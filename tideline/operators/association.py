"""Association of pairs of columns: coefficients, p-values, matrices, autocorrelation.

A metric turns rows (keys, i, a, b) into rows (keys, value, n, ...) by DataFrame operations for all groups at
once; matrices put every pair of columns (or lag) into a group of its own, so one job serves a whole matrix.
Groups that are whole columns (a table without keys, the pairs of a matrix) also carry _p and _c, the
buckets of a and b: orders are then made inside buckets and no task holds a column. p-values come
from the few numbers of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import tails
from tideline.functions.numeric import number, numeric_columns, ratio
from tideline.functions.scan import bucket_of, cuts_of, running, single_valued


@dataclass(frozen=True)
class Metric:
    """compute(rows, keys): value, n and what p needs for each group; p(row): its p-value or None; moment(a, b): one aggregate, where there is one.

    hypothesis, description, notes: the null hypothesis, what a small p-value says, and how it is computed.
    """

    name: str
    compute: Callable[[DataFrame, list[str]], DataFrame]
    symmetric: bool = True
    p: Callable[[dict], float | None] | None = None
    moment: Callable[[Column, Column], Column] | None = None
    hypothesis: str = ""
    description: str = ""
    notes: str = ""


def pearson_column(a: Column, b: Column) -> Column:
    """Pearson's r as an aggregate, NULL for a constant column; also for windows by `.over`-able parts (see rolling)."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def _grouped(rows: DataFrame, keys: list[str]):
    return rows.groupBy(*keys) if keys else rows.groupBy()


def _pearson(rows: DataFrame, keys: list[str]) -> DataFrame:
    return _grouped(rows, keys).agg(pearson_column(F.col("a"), F.col("b")).alias("value"), F.count("a").alias("n"))


def _bucket(rows: DataFrame, name: str) -> list[str]:
    """The bucket column as a list, empty where rows have none."""
    return [name] if name in rows.columns else []


def rank_table(rows: DataFrame, column: str, out: str, keys: list[str], bucket: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """keys, column and the mean rank of each value: counts by value first, so that ties and hot values are summed before any order is made."""
    group = [*keys, *bucket, column]
    by_value = rows.groupBy(*group).agg(F.count(F.lit(1)).cast("double").alias("_k"))
    ranked = running(by_value, [column], {"_upto": "_k"}, keys, bucket=bucket[0] if bucket else None)
    return ranked.select(*keys, column, (F.col("_upto") - (F.col("_k") - 1) / 2).alias(out))


def _spearman(rows: DataFrame, keys: list[str]) -> DataFrame:
    ranked = rows
    for c, bucket in (("a", _bucket(rows, "_p")), ("b", _bucket(rows, "_c"))):
        ranked = ranked.join(rank_table(rows, c, f"_r{c}", keys, bucket), [*keys, c])
    return _grouped(ranked, keys).agg(pearson_column(F.col("_ra"), F.col("_rb")).alias("value"), F.count("a").alias("n"))


def discordant(a: np.ndarray, b: np.ndarray) -> int:
    """Pairs whose order in a is opposite to that in b, by merge counting in n log n."""
    n = len(a)
    order = np.lexsort((b, a))
    rank = np.unique(b[order], return_inverse=True)[1].astype(np.int64)
    found, width = 0, 1
    while width < n:  # sort runs of doubled width; a right element passes all larger ones of the left run
        block = np.arange(n) // (2 * width)
        right = (np.arange(n) // width) % 2
        merged = np.lexsort((right, rank, block))
        is_right = right[merged]
        lefts = np.cumsum(1 - is_right)
        of = block[merged]
        first = np.searchsorted(of, of)
        before = np.where(first > 0, lefts[first - 1], 0)
        left_total = np.bincount(block, 1 - right, minlength=int(of[-1]) + 1).astype(np.int64)
        found += int((left_total[of] - (lefts - before))[is_right == 1].sum())
        rank = rank[merged]
        width *= 2
    return found


def tied(*columns: np.ndarray) -> np.ndarray:
    """Sums over groups of t equal rows of t(t-1), t(t-1)(t-2) and t(t-1)(2t+5)."""
    order = np.lexsort(columns)
    new = np.ones(len(order) + 1, bool)
    new[1:-1] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    t = np.diff(np.flatnonzero(new)).astype(float)
    return np.array([(t * (t - 1)).sum(), (t * (t - 1) * (t - 2)).sum(), (t * (t - 1) * (2 * t + 5)).sum()])


def tau_b(n: float, dis: float, ties_a: float, ties_b: float, ties_both: float) -> tuple[float, float | None]:
    """(concordant less discordant, tau-b) from pair counts; ties are numbers of ordered pairs."""
    total = n * (n - 1) / 2
    score = total - ties_a / 2 - ties_b / 2 + ties_both / 2 - 2 * dis
    below = float(np.sqrt((total - ties_a / 2) * (total - ties_b / 2)))
    return score, score / below if below else None


def _typed(df: DataFrame, names: list[str]) -> str:
    types = dict(df.dtypes)
    return "".join(f"`{k}` {types[k]}, " for k in names)


_TIES = [f"{s}{k}" for s in ("ta", "tb", "tab") for k in (1, 2, 3)]
_TAU = ["value", "n", "score", "dis", *_TIES]
_TAU_SCHEMA = "value double, n long, " + ", ".join(f"{c} double" for c in _TAU[2:])


def _tau_row(n: int, dis: float, ties: np.ndarray) -> dict:
    score, value = tau_b(n, dis, ties[0], ties[3], ties[6])
    return dict(zip(_TAU, [value, n, score, dis, *ties], strict=True))


def _kendall(rows: DataFrame, keys: list[str]) -> DataFrame:
    """tau-b, with what its p-value needs. Rows in buckets: see `_kendall_placed`; else each group is sorted in one task (two numbers a row)."""
    if "_p" in rows.columns:
        return _kendall_placed(rows, keys)

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf["a"].to_numpy(), pdf["b"].to_numpy()
        found = _tau_row(len(a), discordant(a, b), np.concatenate([tied(a), tied(b), tied(a, b)]))
        return pd.DataFrame([{k: pdf[k].iloc[0] for k in keys} | found]).astype({"value": "float64"})

    return rows.groupBy(*keys).applyInPandas(of, _typed(rows, keys) + _TAU_SCHEMA)


def _kendall_placed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Discordant pairs in three parts: inside a bucket of a (_p); in different ones inside a bucket of b (_c); and in different ones of both, from a table of counts.

    A bucket of a single value has no discordant pairs of the first or second kind and isn't gathered.
    """

    def inside(of: str, first: str) -> DataFrame:
        def count(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([{k: pdf[k].iloc[0] for k in keys} | {"dis": float(discordant(pdf[first].to_numpy(), pdf["b"].to_numpy()))}])

        found = rows.where(~F.col(f"{of}_one")).select(*keys, of, "b", *({first} - {"b"})).groupBy(*keys, of).applyInPandas(count, _typed(rows, keys) + "dis double")
        return found.select(*keys, "dis")

    def crossed(pdf: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros((int(pdf["_p"].max()) + 1, int(pdf["_c"].max()) + 1))
        table[pdf["_p"], pdf["_c"]] = pdf["k"]
        above = np.zeros_like(table)  # rows in a lower bucket of a and a higher one of b
        above[1:, :-1] = np.cumsum(np.cumsum(table[:, ::-1], axis=1)[:, ::-1], axis=0)[:-1, 1:]
        return pd.DataFrame([{k: pdf[k].iloc[0] for k in keys} | {"dis": float((above * table).sum())}])

    cells = rows.groupBy(*keys, "_p", "_c").agg(F.count(F.lit(1)).cast("double").alias("k"))
    cross = cells.groupBy(*keys).applyInPandas(crossed, _typed(rows, keys) + "dis double")
    parts = inside("_p", "a").union(inside("_c", "_p")).union(cross)
    dis = _grouped(parts, keys).agg(F.sum("dis").alias("dis"))
    t = F.col("t")
    sums = lambda s: [F.sum(t * (t - 1)).alias(f"{s}1"), F.sum(t * (t - 1) * (t - 2)).alias(f"{s}2"), F.sum(t * (t - 1) * (2 * t + 5)).alias(f"{s}3")]
    both = rows.groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).cast("double").alias("t"))
    out = _grouped(both, keys).agg(F.sum("t").alias("n"), *sums("tab"))
    for s, c in (("ta", "a"), ("tb", "b")):
        one = _grouped(both.groupBy(*keys, c).agg(F.sum("t").alias("t")), keys).agg(*sums(s))
        out = out.join(one, keys) if keys else out.crossJoin(one)  # a row for each group
    out = out.join(dis, keys, "left") if keys else out.crossJoin(dis)
    dis, n = F.coalesce("dis", F.lit(0.0)), F.col("n")
    total = n * (n - 1) / 2
    score = total - (F.col("ta1") + F.col("tb1") - F.col("tab1")) / 2 - 2 * dis
    value = ratio(score, F.sqrt(total - F.col("ta1") / 2) * F.sqrt(total - F.col("tb1") / 2))
    return out.where("n IS NOT NULL").select(*keys, value.alias("value"), n.cast("long").alias("n"), score.alias("score"), dis.alias("dis"), *_TIES)


def _xi(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Chatterjee's xi of b on a: ordered by (a, i), r = number of b's not above, l = number not below."""
    by_b, by_a = _bucket(rows, "_c"), _bucket(rows, "_p")
    group = [*keys, *by_b, "b"]
    by_value = rows.groupBy(*group).agg(F.count(F.lit(1)).cast("double").alias("_k"))
    ranked = running(by_value, ["b"], {"_r": "_k"}, keys, bucket=by_b[0] if by_b else None)
    ranked = ranked.select(*group, "_r", (F.col("_r_total") - F.col("_r") + F.col("_k")).alias("_l"), F.col("_r_total").alias("_n"))
    placed = rows.join(ranked, group)
    after = F.lead("_r").over(Window.partitionBy(*keys, *by_a).orderBy("a", "i"))
    if by_a:  # the last row of a bucket is followed by the first one of the next
        heads = placed.groupBy(*keys, *by_a).agg(F.min(F.struct("a", "i", "_r")).alias("_head"))
        heads = heads.select(*keys, *by_a, F.lead("_head._r").over(Window.partitionBy(*keys).orderBy(*by_a)).alias("_beyond"))
        placed = placed.join(F.broadcast(heads), [*keys, *by_a])  # one row for each bucket of each pair
        after = F.coalesce(after, F.col("_beyond"))
    steps = placed.select(*keys, "_r", "_l", "_n", after.alias("_next"))
    gap, ties = F.sum(F.abs(F.col("_next") - F.col("_r"))), F.sum(F.col("_l") * (F.col("_n") - F.col("_l")))
    n = F.max("_n")
    return _grouped(steps, keys).agg((1 - ratio(n * F.coalesce(gap, F.lit(0.0)), 2 * ties)).alias("value"), n.cast("long").alias("n"))


def _stepanov(rows: DataFrame, keys: list[str]) -> DataFrame:
    tau, rho = _kendall(rows, keys).select(*keys, F.col("value").alias("_tau"), "n"), _spearman(rows, keys).select(*keys, F.col("value").alias("_rho"))
    both = tau.join(rho, keys) if keys else tau.crossJoin(rho)  # one row each
    return both.select(*keys, ((3 * F.col("_tau") - F.col("_rho")) / 2).alias("value"), "n")


def _t(row: dict) -> float | None:
    return tails.correlation_p(row["value"], row["n"])


def _tau_p(row: dict) -> float | None:
    return tails.kendall_p(row["score"], row["dis"], row["n"], tuple(row[c] for c in _TIES[:3]), tuple(row[c] for c in _TIES[3:6]))


def _xi_p(row: dict) -> float | None:
    """One-sided, by the limit for continuous b: sqrt(n) xi is normal with variance 2/5."""
    return None if row["value"] is None else tails.normal_upper(row["value"] * (row["n"] / 0.4) ** 0.5)


PEARSON = Metric("pearson", _pearson, True, _t, pearson_column, "the columns are not linearly related", "a small p-value speaks for a linear relation", "two-sided, t distribution with n - 2 degrees of freedom; assumes normal values")
SPEARMAN = Metric("spearman", _spearman, True, _t, None, "the columns' ranks are not related", "a small p-value speaks for a monotonic relation", "two-sided, t distribution with n - 2 degrees of freedom; for some hundred rows at least")
KENDALL = Metric("kendall", _kendall, True, _tau_p, None, "pairs are as often concordant as discordant", "a small p-value speaks for a monotonic relation", "two-sided; exact for up to 33 rows without ties, else normal with the variance corrected for ties")
XI = Metric("xi", _xi, False, _xi_p, None, "b does not depend on a", "a small p-value speaks for b as a function of a, of any form", "one-sided, by the limit for continuous b; ties in a are ordered by the order column")
STEPANOV = Metric("stepanov", _stepanov, True, None, None, "", "", "no test is known")
METRICS = {m.name: m for m in (PEARSON, SPEARMAN, KENDALL, XI, STEPANOV)}


def pairs_of(df: DataFrame, a: str | Column, b: str | Column, keys: list[str] | tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """keys, i, a, b of rows with both values; i breaks ties in a (its order column, else a hash of the pair). Without keys also the buckets of a and b."""
    rows = df.select(*keys, number(a).alias("a"), number(b).alias("b"), (F.col(f"`{order}`") if order else F.lit(0)).alias("i"))
    rows = rows.where("a IS NOT NULL AND b IS NOT NULL")
    rows = rows if order else rows.withColumn("i", F.xxhash64("a", "b"))
    if keys:
        return rows
    return rows.withColumns(_placed(cuts_of(rows, ["a", "b"]), {"a": "_p", "b": "_c"}))


def _placed(cuts: dict[str, list[float]], names: dict[str, str]) -> dict[str, Column]:
    """The bucket of each column under its name, and whether the bucket holds a single value under name_one."""
    own = {n: bucket_of(c, cuts[c]) for c, n in names.items()}
    return own | {f"{n}_one": own[n].isin(alone) if (alone := single_valued(cuts[c])) else F.lit(False) for c, n in names.items()}


def associate(df: DataFrame, a: str, b: str, metric: Metric = PEARSON, keys: list[str] | tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """value and n of a metric for each group."""
    if metric.moment is not None:
        rows = df.select(*keys, number(a).alias("a"), number(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    else:
        rows = pairs_of(df, a, b, keys, order)
    return metric.compute(rows, list(keys)).select(*keys, "value", "n")


def with_p(metric: Metric, df: DataFrame) -> list[dict]:
    """Rows of a small result as dicts with p_value: driver-side maths on a number for each group."""
    out = []
    for row in df.collect():
        d = row.asDict()
        out.append(d | {"p_value": metric.p(d) if metric.p else None})
    return out


def p_column(metric: Metric, df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, value, n and p_value of a metric's result."""
    if metric.p is None:
        return df.select(*keys, "value", "n", F.lit(None).cast("double").alias("p_value"))
    needs = [c for c in df.columns if c not in keys]
    p = metric.p

    def go(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [{c: None if v != v else v for c, v in r.items()} for r in pdf[needs].to_dict("records")]
            yield pdf[[*keys, "value", "n"]].assign(p_value=np.array([p(r) for r in rows], float))

    out = df.select(*keys, *needs).mapInPandas(go, _typed(df, keys) + "value double, n long, p_value double")
    return out.withColumn("p_value", F.when(~F.isnan("p_value"), F.col("p_value")))


def test(df: DataFrame, a: str, b: str, metric: Metric = PEARSON, order: str | None = None) -> dict:
    """name, value, n, p_value and the hypothesis of one pair, with its description and notes."""
    (row,) = with_p(metric, metric.compute(pairs_of(df, a, b, (), order), [])) or [{"value": None, "n": 0, "p_value": None}]
    return {"name": metric.name, "value": row["value"], "n": row["n"], "p_value": row["p_value"]} | _hypothesis(metric)


def _hypothesis(metric: Metric) -> dict:
    return {"hypothesis_test": metric.hypothesis, "hypothesis_test_description": metric.description, "hypothesis_test_notes": metric.notes}


def _place(df: DataFrame, order: str) -> Column:
    """An order column as a number: microseconds for instants."""
    c = F.col(f"`{order}`")
    return F.unix_micros(c.cast("timestamp")).cast("double") if dict(df.dtypes)[order] in ("date", "timestamp", "timestamp_ntz") else c.cast("double")


def _numbered(df: DataFrame, names: list[str], order: str | None) -> tuple[DataFrame, dict[str, list[float]]]:
    """The columns as numbers v0, v1 .., i, and the cuts of each into buckets: one scan."""
    i = _place(df, order) if order else F.lit(0.0)
    base = df.select(*[number(c).alias(f"v{k}") for k, c in enumerate(names)], i.alias("i"))
    return base, cuts_of(base, [f"v{k}" for k in range(len(names))])


def _long_pairs(df: DataFrame, pairs: list[tuple[str, str]], order: str | None) -> DataFrame:
    """Rows (row, col, i, a, b) of all pairs of columns with their buckets: one generator over one scan."""
    names = sorted({c for p in pairs for c in p})
    base, cuts = _numbered(df, names, order)
    base = base.withColumns(_placed(cuts, {f"v{k}": f"b{k}" for k in range(len(names))}))

    def part(x: str, y: str) -> Column:
        j, k = names.index(x), names.index(y)
        fields = {"a": f"v{j}", "b": f"v{k}", "_p": f"b{j}", "_c": f"b{k}", "_p_one": f"b{j}_one", "_c_one": f"b{k}_one", "i": "i"}
        return F.struct(F.lit(x).alias("row"), F.lit(y).alias("col"), *[F.col(c).alias(n) for n, c in fields.items()])

    out = base.select(F.explode(F.array(*[part(x, y) for x, y in pairs])).alias("s")).select("s.*").where("a IS NOT NULL AND b IS NOT NULL")
    return out if order else out.withColumn("i", F.xxhash64("a", "b").cast("double"))


def _moments(df: DataFrame, pairs: list[tuple[str, str]], column: Callable[[str], Column], moment: Callable[[Column, Column], Column]) -> DataFrame:
    """row, col, value, n of all pairs from one aggregate over one scan."""
    both = lambda x, y: F.count(F.when(column(x).isNotNull() & column(y).isNotNull(), 1))
    one = df.agg(*[F.struct(F.lit(x).alias("row"), F.lit(y).alias("col"), moment(column(x), column(y)).alias("value"), both(x, y).alias("n")).alias(f"p{k}") for k, (x, y) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[f"p{k}" for k in range(len(pairs))])).alias("s")).select("s.*")


#: Different values of a column whose ranks are sent to all rows instead of being joined by a shuffle.
FEW_VALUES = 10_000


def _rank_matrix(df: DataFrame, pairs: list[tuple[str, str]], order: str | None) -> DataFrame:
    """Spearman's rho. A column without missing values is ranked once for all its pairs; a pair with one that has some is ranked by its own rows."""
    names = sorted({c for p in pairs for c in p})
    looked = df.agg(*[F.count(F.when(number(c).isNull(), 1)) for c in names], *[F.approx_count_distinct(number(c)) for c in names]).first()
    whole = [c for c, n in zip(names, looked, strict=False) if not n]
    values = dict(zip(names, looked[len(names) :], strict=True))
    clean = [p for p in pairs if p[0] in whole and p[1] in whole]
    out = None
    if clean:
        base, cuts = _numbered(df, whole, None)
        ranked = base = base.drop("i")
        for k, c in enumerate(whole):
            ranks = rank_table(base.select(f"v{k}", bucket_of(f"v{k}", cuts[f"v{k}"]).alias("b")), f"v{k}", f"r{k}", [], ["b"])
            if values[c] < FEW_VALUES / 2 and base.select(f"v{k}").distinct().limit(FEW_VALUES + 1).count() <= FEW_VALUES:
                ranks = F.broadcast(ranks)  # FEW_VALUES rows at most
            ranked = ranked.join(ranks, f"v{k}").drop(f"v{k}")
        out = _moments(ranked, clean, lambda c: F.col(f"r{whole.index(c)}"), pearson_column)
    if rest := [p for p in pairs if p not in clean]:
        more = _spearman(_long_pairs(df, rest, order), ["row", "col"]).select("row", "col", "value", "n")
        out = more if out is None else out.union(more)
    return out


def correlation_matrix(df: DataFrame, columns: list[str] | None = None, others: list[str] | None = None, metric: Metric = PEARSON, order: str | None = None, full: bool = True, p_values: bool = False) -> DataFrame:
    """Rows (row, col, value, n, and p_value if asked) of metric(row, col) over columns x others (columns x columns if none are given).

    The upper triangle is computed and mirrored for symmetric metrics. Pearson's is one aggregate over
    one scan, Spearman's one over columns that are ranked once; the others handle all pairs as groups
    of one job. Diagonals are included.
    """
    columns = numeric_columns(df) if columns is None else columns
    mirror = others is None and metric.symmetric
    pairs = [(x, y) for i, x in enumerate(columns) for j, y in enumerate(columns if others is None else others) if not mirror or j >= i]
    if metric.moment is not None:
        out = _moments(df, pairs, number, metric.moment)
    elif metric is SPEARMAN:
        out = _rank_matrix(df, pairs, order)
    else:
        out = metric.compute(_long_pairs(df, pairs, order), ["row", "col"])
    out = p_column(metric, out, ["row", "col"]) if p_values else out.select("row", "col", "value", "n")
    if mirror and full:
        out = out.union(out.where("row <> col").select(F.col("col").alias("row"), F.col("row").alias("col"), *out.columns[2:]))
    return out


@dataclass(frozen=True)
class MatrixResult:
    """value[i][j] and p_value[i][j] for rows[i] (a column name, or a lag) and columns[j]; missing ones are None."""

    name: str
    rows: list
    columns: list[str]
    value: list[list[float | None]]
    p_value: list[list[float | None]]
    hypothesis_test: str
    hypothesis_test_description: str
    hypothesis_test_notes: str
    symmetric: bool = False


def _matrix_result(metric: Metric, found: DataFrame, row: str, col: str, rows: list, columns: list[str], symmetric: bool = False) -> MatrixResult:
    at = {(r[row], r[col]): (r["value"], r["p_value"]) for r in found.collect()}
    value, p = ([[at.get((x, y), (None, None))[k] for y in columns] for x in rows] for k in (0, 1))
    return MatrixResult(metric.name, rows, columns, value, p, **_hypothesis(metric), symmetric=symmetric)


def matrix_test(df: DataFrame, columns: list[str] | None = None, others: list[str] | None = None, metric: Metric = PEARSON, order: str | None = None) -> MatrixResult:
    """`correlation_matrix` with p-values, collected: a number for each pair of columns."""
    columns = numeric_columns(df) if columns is None else columns
    found = correlation_matrix(df, columns, others, metric, order, p_values=True)
    return _matrix_result(metric, found, "row", "col", columns, columns if others is None else others, others is None and metric.symmetric)


def lagged(df: DataFrame, columns: list[str], lags: int | list[int], order: str, keys: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Rows (keys, column, lag, i, a, b): a value and the one `lag` rows later. An int means 1 .. lags.

    Without keys the whole table is one series, which is read in one task.
    """
    steps = list(range(1, lags + 1)) if isinstance(lags, int) else sorted(lags)
    w = Window.partitionBy(*keys).orderBy(order) if keys else Window.orderBy(order)
    ahead = [F.lead(number(c), k).over(w).alias(f"_b{i}_{k}") for i, c in enumerate(columns) for k in steps]
    wide = df.select(*keys, _place(df, order).alias("i"), *[number(c).alias(f"_c{i}") for i, c in enumerate(columns)], *ahead)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(k).alias("lag"), F.col(f"_c{i}").alias("a"), F.col(f"_b{i}_{k}").alias("b")) for i, c in enumerate(columns) for k in steps])
    out = wide.select(*keys, "i", F.explode(rows).alias("s"))
    return out.select(*keys, "i", "s.*").where("a IS NOT NULL AND b IS NOT NULL")


def auto_correlation(df: DataFrame, columns: str | list[str], lags: int | list[int], order: str, metric: Metric = PEARSON, keys: list[str] | tuple[str, ...] = (), p_values: bool = False) -> DataFrame:
    """Rows (keys, column, lag, value, n, and p_value if asked): metric of each column with itself `lag` rows later."""
    columns = [columns] if isinstance(columns, str) else columns
    group = [*keys, "column", "lag"]
    out = metric.compute(lagged(df, columns, lags, order, keys), group)
    return p_column(metric, out, group) if p_values else out.select(*group, "value", "n")


def auto_test(df: DataFrame, columns: str | list[str], lags: int | list[int], order: str, metric: Metric = PEARSON) -> MatrixResult:
    """`auto_correlation` with p-values, collected: rows are lags."""
    columns = [columns] if isinstance(columns, str) else columns
    steps = list(range(1, lags + 1)) if isinstance(lags, int) else sorted(lags)
    return _matrix_result(metric, auto_correlation(df, columns, steps, order, metric, p_values=True), "lag", "column", steps, columns)


def relative_model_improvement(df: DataFrame, a: str, b: str, baseline: str, keys: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """mean(ea eb) / (rms ea rms eb) of the differences to a baseline, not centred; 0 if one has none."""
    ea, eb = number(a) - number(baseline), number(b) - number(baseline)
    rows = df.select(*keys, ea.alias("a"), eb.alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    below = F.sqrt(F.avg(F.col("a") * F.col("a"))) * F.sqrt(F.avg(F.col("b") * F.col("b")))
    return _grouped(rows, list(keys)).agg(F.coalesce(ratio(F.avg(F.col("a") * F.col("b")), below), F.lit(0.0)).alias("value"))


def error_correlation(df: DataFrame, a: str, b: str, baseline: str, metric: Metric = PEARSON, keys: list[str] | tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """metric of a - baseline and b - baseline."""
    rows = df.select(*keys, *([order] if order else []), (number(a) - number(baseline)).alias("_ea"), (number(b) - number(baseline)).alias("_eb"))
    return associate(rows, "_ea", "_eb", metric, keys, order)


def contingency(df: DataFrame, row: str, col: str) -> DataFrame:
    return df.where(F.col(row).isNotNull() & F.col(col).isNotNull()).groupBy(F.col(row).alias("r"), F.col(col).alias("c")).agg(F.count(F.lit(1)).alias("n"))


#: Cells of a contingency table that are read on the driver.
MOST_CELLS = 1_000_000


def somers_d(table: DataFrame) -> dict:
    """Somers' D of the column variable on the row variable, of a table (r, c, n) of counts: (C - D) / pairs untied in rows.

    The table has a row for each pair of classes. One of more than MOST_CELLS pairs, or of more than four
    times as many places, isn't of classes and raises; KENDALL handles numbers without a table.
    """
    cells = table.select("r", "c", F.col("n").cast("double").alias("n")).limit(MOST_CELLS + 1).collect()
    r, c = ({v: i for i, v in enumerate(sorted({x[k] for x in cells}))} for k in (0, 1))
    if len(cells) > MOST_CELLS or len(r) * len(c) > 4 * MOST_CELLS:
        raise ValueError("too many classes for a contingency table")
    count = np.zeros((len(r) + 2, len(c) + 2))  # with an empty edge all around
    for x in cells:
        count[r[x[0]] + 1, c[x[1]] + 1] += x[2]
    upto = np.cumsum(np.cumsum(count, axis=0), axis=1)
    inner, last = count[1:-1, 1:-1], upto[-1, -1]
    low_low, low_high = upto[:-2, :-2], upto[:-2, -1:] - upto[:-2, 1:-1]
    high_low = upto[-1:, :-2] - upto[1:-1, :-2]
    high_high = last - upto[1:-1, -1:] - upto[-1:, 1:-1] + upto[1:-1, 1:-1]
    same, opposite = low_low + high_high, low_high + high_low
    con, dis = float((inner * high_high).sum()), float((inner * high_low).sum())
    n, rows = float(last), inner.sum(axis=1, keepdims=True)
    untied = float((n * n - (rows * rows).sum()) / 2)
    value = (con - dis) / untied if untied else None
    p = None
    if untied:
        spread = float((inner * (2 * untied * (same - opposite) - 2 * (con - dis) * (n - rows)) ** 2).sum())
        se = (spread * 4) ** 0.5 / (2 * untied) ** 2
        p = tails.normal_two_sided(value / se) if se else 0.0
    notes = "two-sided, normal by the asymptotic standard error"
    return {"name": "somers_d", "value": value, "n": int(n), "p_value": p, "hypothesis_test": "the column variable does not follow the row variable", "hypothesis_test_description": "a small p-value speaks for an ordinal relation", "hypothesis_test_notes": notes}


@dataclass
class CorrelationSuite:
    """Several metrics over one pair of columns, or over all numeric columns."""

    metrics: tuple[Metric, ...] = (PEARSON, SPEARMAN, KENDALL, XI, STEPANOV)

    def results(self, df: DataFrame, a: str | None = None, b: str | None = None, order: str | None = None) -> list:
        """A dict for each metric (two columns named), or a DataFrame (row, col, value, n) for each."""
        if a is not None and b is not None:
            return [test(df, a, b, m, order) for m in self.metrics]
        return [correlation_matrix(df, metric=m, order=order) for m in self.metrics]

    def print(self, df: DataFrame, a: str | None = None, b: str | None = None, order: str | None = None) -> str:
        lines = []
        for m, r in zip(self.metrics, self.results(df, a, b, order), strict=True):
            if isinstance(r, dict):
                lines.append(f"{m.name}: {r['value']} (p {r['p_value']}, n {r['n']}; H0: {r['hypothesis_test'] or '-'})")
            else:
                lines += [m.name, *(f"  {x['row']} > {x['col']}: {x['value']}" for x in sorted(r.collect(), key=lambda x: (x["row"], x["col"])))]
        text = "\n".join(lines)
        print(text)
        return text
