"""Mini-batch adapters with a plain numpy model, additive stages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import online
from tideline.operators.adapters import BatchTrainer, predict_batches


class Line:
    """Least squares by gradient steps; counts its updates."""

    def __init__(self):
        self.w, self.updates = np.zeros(2), 0

    def train_batch(self, x, y):
        off = x @ self.w - y
        self.w -= 0.1 * x.T @ off / len(y)
        return float(np.mean(off**2))

    def update(self, loss):
        self.updates += 1

    def predict(self, x):
        return x @ self.w


def test_training_and_inference(spark):
    x = np.random.default_rng(0).normal(size=(200, 2))
    trainer = BatchTrainer(Line()).fit(x, x @ [1.0, -2.0], epochs=20)
    assert trainer.model.w == pytest.approx([1.0, -2.0], abs=0.01) and trainer.model.updates == 20 * 7
    assert BatchTrainer(Line()).fit(x, x @ [1.0, -2.0], max_iterations=450).model.updates == 3 * 7
    df = spark.createDataFrame([([1.0, 1.0],), (None,)], "features array<double>")
    got = [r["prediction"] for r in predict_batches(df, trainer.model).collect()]
    assert got[0] == pytest.approx(-1, abs=0.02) and got[1] is None


def test_sign_layer_learns_and_wrapped_estimators():
    layer = online.SignLinear(2, rate=0.5, seed=1)
    online.play(layer, list(np.random.default_rng(0).normal(size=(50, 2))), np.zeros(50), online.squared)
    assert np.allclose(layer.share.sum(axis=0), 1) and layer.t == 50

    class Mean:
        def partial_fit(self, x, y):
            self.m = float(y[0])

        def predict(self, x):
            return [self.m]

    wrapped = online.PartialFit(estimator=Mean())
    assert wrapped.predict([1.0]) == 0.0
    wrapped.learn([1.0], 0.0, 0.0, 3.0)
    assert wrapped.predict([1.0]) == 3.0


def test_weighed_stages(spark):
    df = spark.createDataFrame([([1.0, 2.0], [0.25, 0.75])], "stages array<double>, weights array<double>")
    assert online.weigh_stages(df, "stages", "weights").select(F.col("combined")).first()[0] == pytest.approx(1.75)
