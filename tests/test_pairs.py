"""Association metrics against direct counts, matrices, autocorrelation."""

import numpy as np
import pytest

from tideline.operators import association as A


def frame(spark, **cols):
    n = len(next(iter(cols.values())))
    return spark.createDataFrame([(i, *(float(c[i]) for c in cols.values())) for i in range(n)], "i long, " + ", ".join(f"{k} double" for k in cols))


def direct_tau(x, y):
    s = lambda v: np.sign(v[:, None] - v[None, :])
    a, b = s(np.array(x)), s(np.array(y))
    return (a * b).sum() / np.sqrt((a != 0).sum() * (b != 0).sum())


def direct_xi(x, y):
    y = np.array(y)[np.argsort(x, kind="stable")]
    r = np.array([(y <= v).sum() for v in y])
    m = np.array([(y >= v).sum() for v in y])
    return 1 - len(y) * np.abs(np.diff(r)).sum() / (2 * (m * (len(y) - m)).sum())


def test_coefficients(spark):
    rng = np.random.RandomState(1)
    x = rng.randint(0, 30, 200).astype(float)
    y = x * 0.5 + rng.randint(0, 20, 200)
    df = frame(spark, x=x, y=y)
    value = lambda m: A.associate(df, "x", "y", m, order="i").first()["value"]
    assert value(A.PEARSON) == pytest.approx(np.corrcoef(x, y)[0, 1])
    rank = lambda v: np.array([(v < t).sum() + ((v == t).sum() + 1) / 2 for t in v])
    rho, tau = np.corrcoef(rank(x), rank(y))[0, 1], direct_tau(x, y)
    assert value(A.SPEARMAN) == pytest.approx(rho)
    assert value(A.KENDALL) == pytest.approx(tau)
    assert value(A.STEPANOV) == pytest.approx((3 * tau - rho) / 2)
    assert value(A.XI) == pytest.approx(direct_xi(x, y))
    assert A.test(df, "x", "y", A.KENDALL)["p_value"] < 1e-6


def test_xi_sees_a_parabola_one_way(spark):
    x = np.random.RandomState(1).uniform(-1, 1, 300)
    df = frame(spark, x=x, y=x * x)
    assert A.associate(df, "x", "y", A.XI).first()["value"] > 0.9
    assert A.associate(df, "y", "x", A.XI).first()["value"] < 0.6


def test_constant_columns_give_nothing(spark):
    df = frame(spark, x=[1, 1, 1], y=[1, 2, 3])
    assert A.associate(df, "x", "y").first()["value"] is None
    assert A.associate(df, "x", "y", A.KENDALL).first()["value"] is None


def test_matrix_is_mirrored_and_named(spark):
    rng = np.random.RandomState(3)
    a, b = rng.normal(size=100), rng.normal(size=100)
    df = frame(spark, a=a, b=b, c=a + b)
    for metric in (A.PEARSON, A.SPEARMAN, A.XI):
        m = {(r["row"], r["col"]): r["value"] for r in A.correlation_matrix(df, ["a", "b", "c"], metric=metric, order="i").collect()}
        assert len(m) == 9
        assert (m["a", "c"] == pytest.approx(m["c", "a"])) == metric.symmetric
    other = A.correlation_matrix(df, ["a", "b"], ["c"]).collect()
    assert {(r["row"], r["col"]) for r in other} == {("a", "c"), ("b", "c")}


def test_autocorrelation(spark):
    x = np.cumsum(np.random.RandomState(5).normal(size=200))
    got = {r["lag"]: r["value"] for r in A.auto_correlation(frame(spark, x=x), "x", 4, "i").collect()}
    assert got == pytest.approx({k: np.corrcoef(x[:-k], x[k:])[0, 1] for k in range(1, 5)})


def test_improvement_and_somers(spark):
    df = frame(spark, a=[1, 2, 3], b=[1, 2, 3], z=[0, 0, 0])
    assert A.relative_model_improvement(df, "a", "b", "z").first()["value"] == pytest.approx(1)
    assert A.relative_model_improvement(df, "a", "z", "z").first()["value"] == 0
    table = spark.createDataFrame([(0, 0, 10), (0, 1, 5), (1, 0, 2), (1, 1, 8)], "r int, c int, n long")
    assert A.somers_d(table)["value"] == pytest.approx((10 * 8 - 5 * 2) / (15 * 10))
    assert len(A.CorrelationSuite().results(df, "a", "b")) == 5 and "pearson" in A.CorrelationSuite((A.PEARSON,)).print(df)


def mixed(n=3000):
    """Values with ties, one value in a third of the rows, and gaps."""
    rng = np.random.RandomState(4)
    x = np.where(rng.uniform(size=n) < 0.35, 7.0, rng.normal(5, 3, n))
    y = np.round(0.4 * x + rng.normal(size=n), 1)
    return x, y, rng.uniform(size=n) < 0.1


def test_whole_columns_in_buckets_agree_with_one_group(spark):
    x, y, _ = mixed()
    df = frame(spark, x=x, y=y).selectExpr("i", "x", "y", "1 AS g")
    for metric in (A.SPEARMAN, A.KENDALL, A.STEPANOV, A.XI):
        whole = A.associate(df, "x", "y", metric, order="i").first()
        one = A.associate(df, "x", "y", metric, keys=["g"], order="i").first()
        assert whole["value"] == pytest.approx(one["value"]) and whole["n"] == one["n"] == len(x)
    assert A.associate(df, "x", "y", A.KENDALL).first()["value"] == pytest.approx(direct_tau(x, y))
    p = [A.with_p(A.KENDALL, A.KENDALL.compute(A.pairs_of(df, "x", "y", keys), keys))[0]["p_value"] for keys in ([], ["g"])]
    assert p[0] == pytest.approx(p[1])


def test_matrices_with_gaps_rank_each_pair_by_its_own_rows(spark):
    x, y, gone = mixed(600)
    rows = [(i, float(a), None if g else float(b), float(-a)) for i, (a, b, g) in enumerate(zip(x, y, gone))]
    df = spark.createDataFrame(rows, "i long, x double, y double, z double")
    for metric in (A.SPEARMAN, A.KENDALL, A.XI):
        got = {(r["row"], r["col"]): (r["value"], r["n"]) for r in A.correlation_matrix(df, ["x", "y", "z"], metric=metric, order="i").collect()}
        for a, b in (("x", "y"), ("x", "z"), ("y", "z"), ("y", "y")):
            one = A.associate(df, a, b, metric, order="i").first()
            assert got[a, b] == (pytest.approx(one["value"]), one["n"])
    assert got["x", "y"][1] == 600 - gone.sum()


def test_p_values_of_matrices_and_lags(spark):
    rng = np.random.RandomState(3)
    a = rng.normal(size=100)
    df = frame(spark, a=a, b=a + rng.normal(size=100), c=rng.normal(size=100))
    for metric in (A.PEARSON, A.SPEARMAN, A.KENDALL, A.XI, A.STEPANOV):
        m = A.matrix_test(df, ["a", "b", "c"], metric=metric, order="i")
        assert (m.name, m.rows, m.columns, m.symmetric) == (metric.name, ["a", "b", "c"], ["a", "b", "c"], metric.symmetric)
        if metric is A.STEPANOV:
            assert m.p_value == [[None] * 3] * 3
            continue
        assert m.p_value[0][1] < 1e-3 < m.p_value[0][2] and m.hypothesis_test and m.hypothesis_test_description and m.hypothesis_test_notes
        assert m.p_value[0][1] == pytest.approx(A.test(df, "a", "b", metric, "i")["p_value"])
        assert (m.p_value[0][1] == m.p_value[1][0]) == metric.symmetric
    other = A.matrix_test(df, ["a", "b"], ["c"])
    assert (other.rows, other.columns, other.symmetric) == (["a", "b"], ["c"], False)
    walk = frame(spark, w=np.cumsum(rng.normal(size=200)))
    lags = A.auto_test(walk, "w", [3, 1], "i")
    assert (lags.rows, lags.columns) == ([1, 3], ["w"]) and lags.p_value[0][0] < 1e-6
    named = A.auto_correlation(walk, "w", 2, "i", p_values=True)
    assert named.columns == ["column", "lag", "value", "n", "p_value"] and named.count() == 2


def test_p_value_of_r_by_the_t_distribution(spark):
    # r = 0.5 of 6 pairs: t = 1.1547 with 4 degrees of freedom; the distribution function has a closed form there
    from tideline.functions.tails import correlation_p

    t = 0.5 * (4 / 0.75) ** 0.5
    z = t / (t * t + 4) ** 0.5
    assert correlation_p(0.5, 6) == pytest.approx(1 - z * (1 + 2 / (t * t + 4)))


def test_somers_by_pairs(spark):
    rng = np.random.RandomState(2)
    r, c = rng.randint(0, 4, 150), rng.randint(0, 3, 150)
    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(r, c)], "r int, c int")
    s = np.sign(r[:, None] - r[None, :]) * np.sign(c[:, None] - c[None, :])
    found = A.somers_d(A.contingency(df, "r", "c"))
    assert found["value"] == pytest.approx(s.sum() / (r[:, None] != r[None, :]).sum()) and 0 < found["p_value"] <= 1
    assert A.somers_d(A.contingency(df.limit(0), "r", "c"))["value"] is None
    many = spark.range(3000).selectExpr("id AS r", "-id AS c", "1 AS n")
    with pytest.raises(ValueError, match="too many"):
        A.somers_d(many)
