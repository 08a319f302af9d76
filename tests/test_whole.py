"""Queries and operators do the whole job: all rows, all dimensions, all passes, the error asked for."""

import numpy as np
import pytest

from tests.parity import compare
from tideline.operators import clustering as C
from tideline.operators.series import fit_spline
from tideline.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_kalman_of_all_users(spark):
    df = catalogue.QUERIES["kalman_smooth_all"](spark, SF)
    assert df.count() == spark.read.parquet(f"{SF}/events.parquet").count()
    assert compare(df, SF, catalogue.ORACLES["kalman_smooth_all"]) == ""


@pytest.mark.parametrize("name", ["kmeans_weighted_step_all", "kmeans_inverse_step_all", "kmeans_assign_all", "kmeans_score_all", "kmeans_transform_all"])
def test_clusters_of_whole_embeddings(spark, name):
    assert compare(catalogue.QUERIES[name](spark, SF), SF, catalogue.ORACLES[name]) == ""


def embeddings(spark):
    return np.array([r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()], float)


def centres(df):
    return np.array([r["value"] for r in df.orderBy("cluster", "dim").collect()]).reshape(5, -1)


def test_fits_take_all_dimensions_and_default_iterations(spark):
    x = embeddings(spark)
    online = x[:5].copy()
    for _ in range(10):
        for v in x:
            k = ((v - online) ** 2).sum(axis=1).argmin()
            online[k] += 0.05 * (v - online[k])
    assert centres(catalogue.QUERIES["kmeans_online"](spark, SF)) == pytest.approx(online, abs=1e-6)
    batch = x[:5].copy()
    for _ in range(300):
        w = C.distance_weights(C.distances(x, batch))
        new = (w.T @ x) / w.sum(axis=0)[:, None]
        if np.linalg.norm(new - batch) < 1e-4:
            break
        batch = new
    assert centres(catalogue.QUERIES["kmeans_weighted"](spark, SF)) == pytest.approx(batch, abs=1e-5)
    for name in ("kmeans_iw_v1", "kmeans_iw_v2", "kharmonic"):
        assert centres(catalogue.QUERIES[name](spark, SF)).shape == x[:5].shape


@pytest.mark.parametrize("mode", ["paper", "reference"])
def test_harmonic_means_make_all_passes(spark, mode):
    x = np.concatenate([np.random.RandomState(i).normal(0.5 * i, 0.05, (15, 2)) for i in range(3)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "seq long, features array<double>")
    start = x[[0, 15, 30]] + 0.01
    m = start.copy()
    for _ in range(4):
        for v in x:
            diff = v - m
            d = np.sqrt((diff**2).sum(axis=1))
            move = 2 * 3 * diff / (d**4 * (1 / d**2).sum() ** 2)[:, None]
            m += 0.05 * move * (diff if mode == "reference" else 1.0)
    assert C.KHarmonicMeans(3, n_iter=4, mode=mode).fit(df, start).centers == pytest.approx(m)
    assert C.KHarmonicMeans(3, n_iter=1, mode=mode).fit(df, start).centers != pytest.approx(m)


@pytest.mark.parametrize("k", [1, 2, 3])
def test_splines_of_long_noisy_series_reach_their_budget(k):
    r = np.random.RandomState(0)
    x, y = np.arange(4000.0), r.normal(0, 2.3, 4000)
    assert ((fit_spline(x, y, k, 300.0)(x) - y) ** 2).sum() <= 300
    x, y = np.sort(r.uniform(0, 10, 60)), r.normal(size=60)
    assert fit_spline(x, y, k, 0.0)(x) == pytest.approx(y, abs=1e-8)


def test_smoothed_days_are_within_the_budget(spark):
    d = "/root/testdata/sf0.1"
    given = {r["day"]: r["total"] for r in catalogue.millions(spark, d).df.collect() if r["total"] is not None}
    made = {r["day"]: r["total"] for r in catalogue.QUERIES["smooth_spline"](spark, d).collect()}
    assert sum((made[day] - v) ** 2 for day, v in given.items()) <= 150.001
