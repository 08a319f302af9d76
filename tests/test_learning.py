"""Online learning, experts, clustering, back-testing, streaming, reports."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import backtest as B
from tideline.operators import clustering as C
from tideline.operators import experts, online
from tideline.operators.series import SeriesFrame, kalman
from tideline.plans import summaries
from tideline.plans.report import EDAReport, ReportRenderer
from tideline.streaming import stateful


def constants(k=4):
    return [online.Constant(i / k) for i in range(k)]


def test_aggregating_cost_of_large_losses_is_infinite(spark):
    """exp(-loss) is 0 from some 745 on; the cost is then infinite as in SQL, and was NULL."""
    losses = spark.createDataFrame([(t, k, loss) for t, row in enumerate([(0.5, 2.0), (3000.0, 2000.0), (1.0, 700.0)]) for k, loss in enumerate(row)], "t long, expert long, loss double")
    rows = experts.hedge_regret(experts.hedge(losses), mixture=True).orderBy("t").collect()
    assert [np.isinf(r["cost"]) for r in rows] == [False, True, False]
    assert [np.isinf(r["regret"]) for r in rows] == [False, True, True]


def test_batch_clusterings_read_rows_once(spark, monkeypatch):
    """Each iteration read and converted all rows anew; they are held as blocks, here of ten rows, and nulls are skipped."""
    x = np.random.RandomState(5).normal(size=(203, 3)) + np.arange(203)[:, None] % 3
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(v.tolist(),) for v in x] + [(None,)] * 7, "features array<double>").repartition(3).mapInArrow(count, "features array<double>")
    monkeypatch.setattr(C, "BLOCK", 30)
    model = C.WeightedKMeans(3, max_iter=8, tol=0.0).fit(rows, x[:3])
    assert model.iterations == 8
    assert read.value <= 2 * 210  # counted, then held
    want = x[:3]
    for _ in range(8):
        w = C.distance_weights(C.distances(x, want))
        want = w.T @ x / w.sum(axis=0)[:, None]
    assert model.centers == pytest.approx(want)
    with pytest.raises(Exception, match="different lengths"):
        C.WeightedKMeans(2).step(spark.createDataFrame([([1.0, 2.0],), ([1.0, 2.0, 3.0, 4.0],)], "features array<double>").coalesce(1), np.eye(2))


@pytest.mark.parametrize("kind", ["double", "int", "date", "timestamp", "string"])
@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_as_of_without_keys_is_no_single_task(spark, kind, direction):
    """All rows of both sides went through one window in one task; times with many rows, none and NULL."""
    rng = np.random.RandomState(8)
    t = np.concatenate([rng.randint(1000, 9000, 500), np.full(300, 5000)])
    at = np.sort(rng.choice(np.arange(1500, 8500), 150, replace=False))
    place = {"double": lambda c: c + 0.0, "int": lambda c: c, "date": lambda c: F.date_from_unix_date(c), "timestamp": F.timestamp_seconds, "string": lambda c: c.cast("string")}[kind]
    left = spark.createDataFrame([(i, int(v)) for i, v in enumerate(t)] + [(-1, None)], "id long, n int").select("id", place(F.col("n")).alias("t"))
    right = spark.createDataFrame([(int(v), float(v)) for v in at], "n int, v double").select(place(F.col("n")).alias("at"), "v")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = B.as_of(left, right, "t", "at", ["v"], direction)
        assert out.columns == ["id", "t", "v", "matched_at"]
        got = out.withColumn("task", F.spark_partition_id()).withColumn("same", F.col("matched_at") == place(F.col("v").cast("int"))).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    want = {-1: None}
    for i, v in enumerate(t):
        k = np.searchsorted(at, v, "right") - 1 if direction == "backward" else np.searchsorted(at, v)
        want[i] = float(at[k]) if 0 <= k < len(at) else None
    assert {r["id"]: r["v"] for r in got} == want and len(got) == len(want)
    assert {r["same"] for r in got} == {True, None}
    if kind != "string":  # has no places for buckets
        assert len({r["task"] for r in got}) > 1


def test_hedge_windows_equal_the_recursion(spark):
    y = np.random.RandomState(0).uniform(size=60)
    hedge = online.Hedge(constants(), rate=0.5)
    online.play(hedge, [None] * 60, y, online.squared)
    rows = [(t, k, float(0.5 * (k / 4 - v) ** 2)) for t, v in enumerate(y) for k in range(4)]
    losses = spark.createDataFrame(rows, "t long, expert int, loss double")
    w = experts.hedge(losses, 0.5)
    last = {r["expert"]: r["weight"] for r in w.where("t = 59").collect()}
    assert [last[k] for k in range(4)] == pytest.approx(hedge.weights.tolist())
    assert experts.hedge_regret(w).where("t = 59").first()["regret"] == pytest.approx(hedge.regret)
    agg = online.Aggregating(constants())
    online.play(agg, [None] * 60, y, online.squared)
    assert experts.hedge_regret(experts.hedge(losses), mixture=True).where("t = 59").first()["regret"] == pytest.approx(agg.regret)
    timed = online.TimeHedge(constants(), rate=0.5, features=lambda t: np.array([1.0, np.sin(t)]))
    online.play(timed, [None] * 60, y, online.squared)
    got = experts.time_hedge(losses, [F.lit(1.0), F.sin("t")], 0.5).where("t = 59").orderBy("expert").collect()
    assert [r["weight"] for r in got] == pytest.approx(timed.weights.tolist())


@pytest.mark.parametrize("kind", [online.FixedShare, online.Exp3, online.UCB])
def test_bandits_and_sharing_find_the_good_expert(kind):
    y = np.full(400, 0.5)
    learner = kind(constants(), seed=0) if kind is online.Exp3 else kind(constants())
    online.play(learner, [None] * 400, y, online.squared)
    best = learner.count.argmax() if kind is online.UCB else learner.weights.argmax()
    assert best == 2 and learner.t == 400


def test_time_fixed_share_stays_finite():
    learner = online.TimeFixedShare(constants(), features=lambda t: np.array([1.0, np.cos(t)]))
    online.play(learner, [None] * 50, np.random.RandomState(1).uniform(size=50), online.squared)
    assert np.isfinite(learner.theta).all()


def test_priors_are_checked_and_not_shared():
    with pytest.raises(ValueError):
        online.Hedge(constants(), prior=[0.5, 0.5])
    learner = online.Gradient(np.ones(2), rate=0.1)
    used = online.fit(learner, np.eye(2), [0.0, 0.0], online.squared)
    assert (learner.theta == 1).all() and not (used.theta == 1).all()
    with pytest.raises(ValueError):
        learner.learn(np.ones(2), 1.0, np.ones(2), 1.0)


@pytest.mark.parametrize("make", [lambda: online.Gradient(2, rate=0.1), lambda: online.NewtonStep(2, rate=6.0, epsilon=1.0), lambda: online.ForgetfulNewtonStep(2, rate=0.5, epsilon=1.0), lambda: online.MirrorDescent(2, rate=0.1), lambda: online.Adam(2, rate=0.05), lambda: online.Averaged(online.Gradient(2, rate=0.1), kind="root")])
def test_gradient_learners_fit_a_line(make):
    rng = np.random.RandomState(0)
    x = rng.normal(size=(800, 2))
    y = x @ [1.0, -2.0]
    learner = online.fit(make(), x, y, lambda p, t: float(online.squared(p, t)))
    assert np.mean((np.array([learner.predict(v) for v in x[-100:]]) - y[-100:]) ** 2) < 0.1


def test_functions():
    q = online.quadratic(np.array([[2.0, 1.0], [0.0, 2.0]]), np.ones(2), 1.0)
    x = np.array([0.5, -1.0])
    numeric = [(q(x + h) - q(x - h)) / 2e-6 for h in 1e-6 * np.eye(2)]
    assert q.gradient(x) == pytest.approx(numeric, abs=1e-6)
    h = online.holder_reduction(0.5, np.zeros(2), q)
    numeric = [(h(x + e) - h(x - e)) / 2e-6 for e in 1e-6 * np.eye(2)]
    assert h.gradient(x) == pytest.approx(numeric, abs=1e-6)
    s = online.stochastic(lambda v: float(v.sum()), 50, seed=0)
    assert s.gradient(np.zeros(1)) == pytest.approx([1.0])
    parts = online.additive_stages(np.array([1.0]), [lambda x: np.array([2.0])], 0.1, [1.0])
    assert np.mean([p(x) for p in parts]) == pytest.approx(1.0 - 0.2)


def test_run_online_by_key_equals_each_alone(spark):
    rows = [(k, i, float(np.sin(i * k))) for k in (1, 2) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, i long, y double")
    out = online.run_online(df, online.Gradient(1, rate=0.2), "i", "y", keys=["k"]).where("k = 2").orderBy("i").collect()
    p, losses, _ = online.play(online.Gradient(1, rate=0.2), [np.ones(1)] * 40, [np.sin(i * 2) for i in range(40)], online.squared)
    assert [r["prediction"][0] for r in out] == pytest.approx(p) and [r["loss"] for r in out] == pytest.approx(losses)


def blobs(spark, k=3, n=20):
    x = np.concatenate([np.random.RandomState(i).normal(5 * i, 0.5, (n, 2)) for i in range(k)])
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "seq long, features array<double>")


def test_batch_clustering(spark):
    x, df = blobs(spark)
    start = x[[0, 20, 40]] + 1
    model = C.WeightedKMeans(3).fit(df, start)
    d = C.distances(x, start)
    w = C.distance_weights(d)
    assert C.WeightedKMeans(3).step(df, start) == pytest.approx((w.T @ x) / w.sum(axis=0)[:, None])
    labels = [r["cluster"] for r in model.predict(df).orderBy("seq").collect()]
    assert labels == [0] * 20 + [1] * 20 + [2] * 20
    assert model.score(df) == pytest.approx(-(C.distances(x, model.centers).min(axis=1) ** 2).sum())
    assert len(model.transform(df).first()["distances"]) == 3
    still = C.InverseWeightedKMeans(3, mode="reference").fit(df, x[[0, 20, 40]])
    assert still.centers == pytest.approx(x[[0, 20, 40]])
    with pytest.raises(ValueError):
        C.WeightedKMeans(3).predict(df)
    with pytest.raises(ValueError):
        C.draw_centers(df, "features", 1000)


def test_online_clustering(spark):
    x, df = blobs(spark)
    model = C.OnlineKMeans(3, n_iter=3).fit(df, x[[0, 20, 40]])
    assert C.distances(np.array([[0, 0], [5, 5], [10, 10]]), model.centers).min(axis=1).max() < 0.7
    with pytest.raises(ValueError):
        model.fit(df)
    for other in (C.KHarmonicMeans(3), C.InverseWeightedOnlineKMeansV1(3, n=3), C.InverseWeightedOnlineKMeansV2(3, learning_rate=1e-4)):
        assert other.fit(df, x[[0, 20, 40]] + 0.01).centers.shape == (3, 2)


def ramp(spark, n=30):
    day = dt.datetime(2020, 1, 1)
    return SeriesFrame(spark.createDataFrame([(day + dt.timedelta(days=i), float(i)) for i in range(n)], "ts timestamp, close double"), "ts", ["close"], freq="D")


def test_steps_windows_targets(spark):
    front = [r["position"] for r in B.BacktestGame(ramp(spark), 5, 7).steps().collect()]
    assert front == [8, 15, 22, 29]
    assert [r["position"] for r in B.BacktestGame(ramp(spark), 5, 7, align="back").steps().collect()] == [9, 16, 23, 30]
    assert [r["position"] for r in B.BacktestGame(ramp(spark), 5, "7D").steps().collect()] == front
    w = B.BacktestGame(ramp(spark), 5, 7).windows(["close"]).orderBy("ts").first()["window"]
    assert [v["close"] for v in w] == [3, 4, 5, 6, 7]
    t = B.BacktestGame(ramp(spark), 5, 7, "3D", "close").targets().orderBy("ts").collect()
    assert [r["y"] for r in t] == [10, 17, 24, None]
    assert [r["y"] for r in B.BacktestGame(ramp(spark), 5, 7, 1, "close").targets().orderBy("ts").collect()] == [8, 15, 22, 29]


def test_runs(spark):
    game = B.BacktestGame(ramp(spark), 5, 7, "3D", "close", warmup_periods=1)
    out = B.Backtester(game).run(F.col("close"))
    assert out.metrics["mean_loss"] == pytest.approx(0.75 * 4.5) and out.meta["n_steps"] == 4
    assert [r["is_warmup"] for r in out.predictions.orderBy("ts").collect()] == [True, False, False, False]
    early = B.Backtester(game).run(F.col("close"), end=dt.datetime(2020, 1, 18))
    assert early.meta["n_steps"] == 2
    learned = B.Backtester(game).run(online.Gradient(1, rate=0.5))
    assert learned.predictions.count() == 4 and learned.trades.count() == 0


def test_as_of_both_ways(spark):
    left = spark.createDataFrame([(1,), (5,), (9,)], "t long")
    right = spark.createDataFrame([(2, "a"), (5, "b"), (7, "c")], "t long, v string")
    got = lambda way: [r["v"] for r in B.as_of(left, right, "t", "t", ["v"], way).orderBy("t").collect()]
    assert got("backward") == [None, "b", "c"] and got("forward") == ["a", "b", None]


def test_streams_equal_batches(spark, tmp_path):
    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), float(np.sin(i + k))) for k in (1, 2) for i in range(30)]
    spark.createDataFrame(rows, "k long, ts timestamp, x double").repartition(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("k long, ts timestamp, x double").parquet(str(tmp_path / "in"))
    for name, df in (("kal", stateful.kalman(source, ["k"], "ts", "x")), ("ew", stateful.ewm_mean(source, ["k"], "ts", "x", 0.9)), ("gd", stateful.learn(source, ["k"], "ts", "x", online.Gradient(1, rate=0.1)))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
    x = np.array([np.sin(i + 2) for i in range(30)])
    got = [r["smooth"] for r in spark.table("kal").where("k = 2").orderBy("ts").collect()]
    assert got == pytest.approx(kalman(x, 1e-5, 1e-2).tolist())
    w = 0.9 ** np.arange(30)[::-1]
    assert spark.table("ew").where("k = 2").orderBy(F.desc("ts")).first()["ewm"] == pytest.approx((w @ x) / w.sum())
    assert spark.table("gd").count() == 60


def test_report(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i % 7), float(i * i % 11), "<b>") for i in range(60)], "i long, a double, b double, s string")
    frame = SeriesFrame(df.select("i", "a"), "i")
    report = EDAReport([summaries.EDACentralitySummary(df.select("a", "b", "s")), summaries.EDAVariabilitySummary(df.select("a", "b")), summaries.EDACorrelationSummary(df.select("a", "b")), summaries.EDAAutoCorrelationSummary(df.select("i", "a"), "i", 3), summaries.TimeSeriesCentralitySummary(frame)])
    report.add_summaries().save_html(str(tmp_path / "r.html"))
    page = (tmp_path / "r.html").read_text(encoding="utf-8")
    assert page.count("<section>") == 5 and "<svg" in page
    assert "&lt;b&gt;" in ReportRenderer().add_paragraph("<b>").render_html()
    with pytest.raises(ValueError):
        summaries.EDACentralitySummary(df).get_results()


def test_games_are_played_step_by_step():
    xs, ys = np.arange(10.0)[:, None], np.arange(10.0) * 2
    game = online.DatasetGame(xs, ys, lambda p, y: float(online.squared(p, y)), shuffle=False)
    learner, seen = online.Gradient(1, rate=0.01), []
    for _ in game.step_numbers():
        seen.append(game.step(learner)[0])
    assert game.t == 10 and seen == game.results()["predictions"] and learner.t == 10
    again = online.DatasetGame(xs, ys, lambda p, y: float(online.squared(p, y)), rounds=2, shuffle=True, seed=3)
    found = again.play(online.Gradient(1, rate=0.01))
    assert found["n_steps"] == 20 and found["mean_loss"] == pytest.approx(np.mean(found["losses"]))
    again.reset()
    assert again.t == 0 and again.losses == [] and again.results()["mean_loss"] == 0
    with pytest.raises(ValueError):
        online.DatasetGame(xs, ys[:3], online.squared)


def test_fit_partial_fit_and_predict():
    xs, ys = np.ones((20, 1)), np.full(20, 3.0)
    with pytest.raises(ValueError, match="fitted"):
        online.predictions(online.Gradient(1, rate=0.1), xs)
    loss = lambda p, y: float(online.squared(p, y))
    one = online.fit(online.Gradient(1, rate=0.1), xs, ys, loss)
    two = online.partial_fit(online.fit(online.Gradient(1, rate=0.1), xs, ys, loss), xs, ys, loss)
    assert two.t == 40 and abs(online.predictions(two, xs[:1])[0] - 3) < abs(online.predictions(one, xs[:1])[0] - 3) < 1
    averaged = online.fit(online.Averaged(online.Gradient(1, rate=0.1)), xs, ys, loss)
    assert averaged.inner.fitted and online.predictions(averaged, xs[:1])[0] < online.predictions(one, xs[:1])[0]


class Stump:
    def __init__(self, slope):
        self.slope = slope

    def predict(self, x):
        return self.slope * x[:, 0]


class Boosted:
    """What a fitted boosting model of two parameters looks like."""

    init_params = np.array([1.0, 0.5])
    base_models = [[Stump(1.0), Stump(0.0)], [Stump(-0.5), Stump(0.2)]]
    scalings = [1.0, 0.5]
    col_idxs = [[1], [0]]
    learning_rate = 0.1

    def predict(self, x):
        out = np.tile(self.init_params, (len(x), 1))
        for models, k, cols in zip(self.base_models, self.scalings, self.col_idxs):
            out -= self.learning_rate * k * np.array([m.predict(x[:, cols]) for m in models]).T
        return out


def test_stages_of_a_boosted_model_are_its_parts_and_can_be_reweighed():
    x = np.random.RandomState(0).normal(size=(30, 2))
    parts = online.stages_of(Boosted())
    assert len(parts) == 3
    whole = np.array([np.mean([np.squeeze(f(r)) for f in parts], axis=0) for r in x])
    assert whole == pytest.approx(Boosted().predict(x))
    model = online.StageReweigher(parts, lambda experts: online.Hedge(experts, rate=0.0), lambda p, y: (np.squeeze(p)[0] - y) ** 2)
    with pytest.raises(ValueError, match="fitted"):
        model.predict(x)
    assert model.fit(x, x[:, 0]).predict(x) == pytest.approx(whole)
    y = 3 * np.ones(30)  # the first part alone is three times the start
    model = online.StageReweigher(parts, lambda experts: online.Hedge(experts, rate=1.0), lambda p, t: (np.squeeze(p)[0] - t) ** 2).fit(x, y)
    assert model.experts.weights.argmax() == 0 and model.predict(x)[:, 0] == pytest.approx(y, abs=0.1)


def days(spark, n=60, gap=()):
    from datetime import datetime, timedelta

    rows = [(datetime(2020, 1, 1) + timedelta(days=i), float(i)) for i in range(n) if i not in gap]
    return spark.createDataFrame(rows, "ts timestamp, close double")


@pytest.mark.parametrize("offset", ["7D", "90min", "MS", "2ME", "QS", "QE", "YS", "YE", "W", "2W-MON", "B", "3B"])
def test_moves_by_offsets_are_those_of_pandas(spark, offset):
    import pandas as pd

    from tideline.operators.backtest import moved

    df = spark.sql("SELECT explode(sequence(TIMESTAMP'2020-01-01 06:30:00', TIMESTAMP'2021-01-05 06:30:00', INTERVAL 1 DAY)) AS t")
    step = pd.tseries.frequencies.to_offset(offset)
    for t, to in df.select("t", moved(F.col("t"), offset)).collect():
        assert pd.Timestamp(t) + step == pd.Timestamp(to), t


def test_calendar_cadence_goes_to_the_first_row_at_or_after(spark):
    game = B.BacktestGame(SeriesFrame(days(spark, 100, gap=(31, 32)), "ts", ["close"]), cadence="MS", horizon="W-MON", target="close")
    got = [(r["ts"].month, r["ts"].day, r["prediction_at"].weekday()) for r in game.targets().orderBy("ts").collect()]
    assert got == [(1, 1, 0), (2, 3, 0), (3, 1, 0), (4, 1, 0)]
    with pytest.raises(ValueError, match="offset"):
        B.BacktestGame(game.frame, cadence="soon").steps()


def test_sessions_step_through_a_game(spark):
    game = B.BacktestGame(SeriesFrame(days(spark, 30), "ts", ["close"]), window_length=5, cadence=4, horizon="2D", target="close")
    s = B.BacktestSession(game)
    assert s.available_steps() == s.remaining_steps() == 7 and s.current_date == s.step_date(0) and s.step_date(7) is None
    assert s.state()["close"].tolist() == [0.0, 1, 2, 3, 4]

    class Last(online.Learner):
        def predict(self, x):
            return float(x["close"].iloc[-1])

        def learn(self, x, prediction, loss, y):
            self.t += 1

    p, v = s.step(Last())
    assert v == pytest.approx(2.0) and s.prediction_at > s.current_date and s.truth() == p + 2
    assert s.advance() and s.remaining_steps() == 6
    s.reset()
    found = s.play(Last())
    assert found["n_steps"] == 7 and found["losses"] == [2.0] * 6 + [0.0]
    last = s.window(s.step_date(1)).collect()
    assert len(last) == 5 and last[-1]["ts"] == s.step_date(1)
    absolute = B.BacktestSession(game, loss=lambda y, p: abs(y - p))
    assert absolute.step(Last())[1] == 2.0
    run = B.Backtester(B.BacktestGame(game.frame, 5, 4, "2D", "close", loss=lambda y, p: F.abs(y - p))).run(F.col("close")).predictions.orderBy("ts").collect()
    assert [r["loss"] for r in run] == [2.0] * 6 + [0.0]


def test_text_axes_are_read_as_instants(spark):
    df = days(spark, 20).selectExpr("date_format(ts, 'yyyy-MM-dd') AS ts", "close")
    steps = B.BacktestGame(SeriesFrame(df, "ts", ["close"]), cadence="7D").steps().collect()
    assert sorted(r["ts"].day for r in steps) == [1, 8, 15]


def test_series_metrics_keep_all_rows(spark):
    from tideline.operators import ewm
    from tideline.plans import summaries as S

    frame = SeriesFrame(days(spark, 50), "ts", ["close"], freq="D")
    s = S.TimeSeriesCentralitySummary(frame, {"mean": S.weighted_mean, "std": lambda f, p: ewm.std(f, p)}, points=10)
    with pytest.raises(ValueError):
        s.get_results()
    assert set(s.compute()) == {"mean", "std"} and s.get_results()["mean"].count() == 50
    assert s.table().count() == 100 and len(s.shown()) == 20 and s.plot()[0].count("<polyline") == 3
