"""Location and dispersion against numpy, and their edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions import tails
from tideline.functions.scan import running
from tideline.operators import dispersion as V
from tideline.operators import location as L


def frame(spark, v, w=None, g=None):
    rows = [(float(x) if x is not None else None, float(w[i]) if w else 1.0, g[i] if g else "a") for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "v double, w double, g string")


def one(df):
    return df.first()["value"]


def test_location_of_a_random_sample(spark):
    x = np.random.RandomState(0).normal(size=50)
    df = frame(spark, x)
    assert one(L.mean(df, "v")) == pytest.approx(x.mean())
    q = [0.0, 0.1, 0.25, 0.33, 0.5, 0.75, 0.9, 1.0, 1.7]
    assert L.quantiles(df, "v", q).first()[0] == pytest.approx([np.quantile(x, min(1, p)) for p in q])
    assert one(L.midrange(df, "v")) == pytest.approx((x.min() + x.max()) / 2)
    pairs = [(x[i] + x[j]) / 2 for i in range(50) for j in range(i, 50)]
    assert one(L.hodges_lehmann(df, "v")) == pytest.approx(np.median(pairs), abs=1e-9)
    s = np.sort(x)
    assert one(L.trimmed_mean(df, "v", 0.1)) == pytest.approx(s[5:45].mean())
    lo, hi = np.quantile(x, [0.1, 0.9])
    assert one(L.winsorized_mean(df, "v", 0.1)) == pytest.approx(np.clip(x, lo, hi).mean())


def test_selected_quantiles_equal_sorted_ones(spark):
    x = np.random.RandomState(3).normal(size=4000).round(2)
    rows = frame(spark, x).select(F.col("v").alias("x"))
    q = [0.0, 0.137, 0.5, 0.9, 1.0]
    assert L._selected(rows, q).first()[0] == pytest.approx([np.quantile(x, p) for p in q])


def test_weighted_location(spark):
    df = frame(spark, [1, 2, 3, 4], [1, 1, 2, 2])
    assert one(L.mean(df, "v", "w")) == pytest.approx(17 / 6)
    # shares 1/6, 1/3, 2/3, 1: between 2 and 3
    assert one(L.quantile(df, "v", 0.5, "w")) == pytest.approx(2.5)
    assert one(L.quantile(df, "v", 0.0, "w")) == 1.0
    with pytest.raises(ValueError):
        L.quantile(frame(spark, [1, 2], [-1, 2]), "v", 0.5, "w")


def test_mode_ties_nulls_and_strings(spark):
    assert one(L.mode(frame(spark, [1, 1, 2, 2]), "v")) == 1
    assert one(L.mode(frame(spark, [1, 2, 2, 3, 3, 3, 4, None, float("nan")]), "v")) == 3
    assert one(L.mode(spark.createDataFrame([(c,) for c in "abbcab"], "v string"), "v")) == "b"


def test_means_of_powers(spark):
    df = frame(spark, [1, 2, 4, 8], [1, 2, 1, 0])
    assert one(L.geometric_mean(df, "v")) == pytest.approx(2**1.5)
    assert one(L.geometric_mean(df, "v", "w")) == pytest.approx(2.0)
    assert one(L.geometric_mean(frame(spark, [0, 1]), "v")) == 0
    assert one(L.power_mean(df, "v", -1)) == pytest.approx(4 / (1 + 0.5 + 0.25 + 0.125))
    assert one(L.power_mean(df, "v", math.inf)) == 8
    with pytest.raises(Exception, match="positive"):
        one(L.power_mean(frame(spark, [0, 1]), "v", -1))
    assert one(L.mirror_centrality(df, "v", F.ln, F.exp)) == pytest.approx(2**1.5)


def test_dispersion(spark):
    x = np.random.RandomState(0).normal(1, 2, 100)
    df = frame(spark, x)
    assert one(V.std(df, "v")) == pytest.approx(x.std(ddof=1))
    assert one(V.mad(df, "v")) == pytest.approx(np.abs(x - x.mean()).mean())
    assert one(V.median_absolute_deviation(df, "v")) == pytest.approx(np.median(np.abs(x - np.median(x))))
    assert one(V.quantile_spread(frame(spark, np.linspace(0, 1, 101)), "v", 0.8)) == pytest.approx(0.8)
    assert one(V.gini_coefficient(frame(spark, [5, 5, 5]), "v")) == pytest.approx(0)
    assert one(V.coefficient_of_variation(frame(spark, [-1, 0, 1]), "v")) is None
    with pytest.raises(NotImplementedError):
        V.gini_coefficient(df, "v", "w")


def test_groups_equal_each_group_alone(spark):
    df = frame(spark, [1, 5, 2, 8, 3, 3], g=list("ababab"))
    got = {r["g"]: r["value"] for r in L.trimmed_mean(df, "v", 0.34, keys=["g"]).collect()}
    assert got == {"a": 2.0, "b": 5.0}
    assert {r["g"]: r["value"] for r in V.iqr(df, "v", keys=["g"]).collect()} == {"a": 1.0, "b": 2.5}


def test_running_sums_in_buckets(spark):
    x = np.random.RandomState(1).randint(0, 50, 500)
    df = spark.createDataFrame([(float(v), 1.0) for v in x], "x double, one double")
    got = sorted((r["rn"], r["x"], r["c"]) for r in running(df, ["x"], {"c": "one"}, buckets=7).collect())
    assert [g[0] for g in got] == list(range(1, 501)) and [g[1] for g in got] == sorted(x) and [g[2] for g in got] == list(range(1, 501))


def test_tails():
    assert tails.correlation_p(0.5, 10) == pytest.approx(0.14111, abs=1e-5)
    assert tails.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert tails.kendall_exact(0, 3) == pytest.approx(1 / 3)
    assert tails.incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248)


def test_selected_quantiles_are_exact(spark, monkeypatch):
    rng = np.random.RandomState(6)
    n = 4000
    rows = [(float(a), None if i % 7 == 0 else float(b), float(i % 3), None) for i, (a, b) in enumerate(zip(rng.normal(size=n), np.round(rng.normal(size=n), 1)))]
    df = spark.createDataFrame(rows, "a double, b double, c double, e double")
    q = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    for bound in (L.BRACKET_ROWS, 3):  # the second narrows brackets again and again
        monkeypatch.setattr(L, "BRACKET_ROWS", bound)
        got = L.selected(df, ["a", "b", "c", "e"], q)
        for k, c in enumerate("abc"):
            assert got[c] == pytest.approx(np.quantile([r[k] for r in rows if r[k] is not None], q))
        assert got["e"] == [None] * len(q)


@pytest.mark.parametrize("read", [100_000, 2])
def test_selected_quantiles_need_no_sketch(spark, monkeypatch, read):
    """A sketch for each rank took most of the time of a large table; buckets that are counted are exact on every scale."""
    monkeypatch.setattr(L.F, "percentile_approx", None)
    monkeypatch.setattr(L, "BRACKET_ROWS", read)
    rng = np.random.RandomState(11)
    powers = 10.0 ** rng.uniform(-300, 300, 900)
    columns = [
        np.concatenate([powers, -powers, np.zeros(200)]),
        np.concatenate([rng.uniform(size=1990), [1e308, -1e308, np.inf, np.inf, -np.inf], np.full(5, 5e-324)]),
        np.concatenate([np.full(1500, 7.0), 7.0 + rng.normal(size=500) * 1e-15]),
        np.concatenate([np.zeros(1000), 10.0 ** -rng.uniform(0, 200, 1000)]),
    ]
    df = spark.createDataFrame([tuple(float(v) for v in r) for r in zip(*columns)], "a double, b double, c double, d double")
    q = [0.0, 0.05, 0.25, 0.5, 0.77, 0.95, 1.0]
    got = L.selected(df, list("abcd"), q)
    for c, x in zip("abcd", map(np.sort, columns)):
        for p, v in zip(q, got[c]):
            k = (len(x) - 1) * p
            low, high = x[int(np.floor(k))], x[int(np.ceil(k))]
            assert v == (low if low == high else low + (high - low) * (k - np.floor(k)))


def test_summaries_of_large_tables_select(spark, monkeypatch):
    from tideline.plans import summaries as S

    df = spark.createDataFrame([(float(i % 17), float(i * i % 101)) for i in range(500)], "a double, b double")
    small = sorted(map(tuple, S.column_metrics(df, S.LOCATION | S.DISPERSION).collect()))
    monkeypatch.setattr(L, "SELECT_ROWS", 100)
    large = sorted(map(tuple, S.column_metrics(df, S.LOCATION | S.DISPERSION).collect()))
    assert [r[0] for r in large] == ["a", "b"]
    for x, y in zip(small, large):
        assert x[1:] == pytest.approx(y[1:])


def test_large_tables_are_read_three_times(spark, monkeypatch):
    """Rows, ends and plain metrics; buckets; the values of the last brackets. A scan after the selection took more time than the selection."""
    from tideline.plans import summaries as S

    monkeypatch.setattr(L, "SELECT_ROWS", 100)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    n = 500
    df = spark.createDataFrame([(float(i % 17), float(i * i)) for i in range(n)], "a double, b double").mapInArrow(counted, "a double, b double")
    for call in (lambda: S.column_metrics(df, S.DISPERSION), lambda: S.column_metrics(df, S.LOCATION), lambda: S.box_stats(df), lambda: L.quantiles(df, "b", [0.1, 0.5])):
        before = seen.value
        call().collect()
        assert seen.value - before <= 3 * n


def test_metrics_of_large_tables_keep_their_types(spark, monkeypatch):
    from tideline.plans import summaries as S

    df = spark.createDataFrame([(float(i % 17), None, float("nan") if i % 3 == 0 else float(i), i) for i in range(500)], "a double, `b.x` double, c double, d long")
    metrics = S.DISPERSION | {
        "n": F.count,
        "list": lambda c: F.sort_array(F.collect_set(c.cast("int") % 3)),
        "ends": lambda c: F.struct(F.min(c).alias("low"), F.max(c).cast("decimal(10,2)").alias("high")),
        "time": lambda c: F.timestamp_seconds(F.max(c)),
        "text": lambda c: F.max(c.cast("string")),
        "map": lambda c: F.map_from_arrays(F.array(F.lit("k")), F.array(F.max(c))),
    }
    for rows in (df, df.where("false")):
        monkeypatch.setattr(L, "SELECT_ROWS", 5_000_000)
        small = S.column_metrics(rows, metrics)
        want = small.orderBy("column").collect()
        monkeypatch.setattr(L, "SELECT_ROWS", -1)
        large = S.column_metrics(rows, metrics)
        assert large.schema.simpleString() == small.schema.simpleString()
        assert large.orderBy("column").collect() == want


@pytest.mark.parametrize("name", ["dispersion_summary", "boxplot_stats", "location_summary"])
def test_summaries_of_large_tables_equal_sql_without_sketches(spark, monkeypatch, name):
    from tests.parity import compare
    from tideline.plans import catalogue

    monkeypatch.setattr(L, "SELECT_ROWS", 100)
    monkeypatch.setattr(L, "BRACKET_ROWS", 50)
    monkeypatch.setattr(L.F, "percentile_approx", None)
    assert compare(catalogue.QUERIES[name](spark, "/root/testdata/sf0.001"), "/root/testdata/sf0.001", catalogue.ORACLES[name]) == ""


@pytest.mark.parametrize("last", [100_000, 50])
def test_pair_medians_by_buckets(spark, monkeypatch, last):
    rng = np.random.RandomState(9)
    for x in (rng.normal(size=301), np.where(rng.uniform(size=400) < 0.4, 2.0, np.round(rng.normal(size=400), 1)), np.array([3.0]), np.full(50, 1.5)):
        i, j = np.triu_indices(len(x))
        monkeypatch.setattr(L, "SELECT_ROWS", 0)
        monkeypatch.setattr(L, "LAST_SUMS", last)
        got = L.hodges_lehmann(spark.createDataFrame([(float(v),) for v in x], "v double"), "v").first()["value"]
        assert got == pytest.approx(np.median((x[i] + x[j]) / 2), abs=1e-12)
    assert L._walsh_median(spark.createDataFrame([], "x double")) is None
