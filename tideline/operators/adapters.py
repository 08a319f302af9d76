"""Mini-batch models: training by epochs on the driver or per key, inference over DataFrames.

A batch model has train_batch(x, y) -> loss and predict(x), and may have update(loss), which is called
after each batch. `torch_model` makes one of a torch module; torch is imported only then.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class BatchTrainer:
    """fit runs `epochs` passes, or as many as max_iterations rows need; partial_fit runs one."""

    model: object
    batch_size: int = 32
    seed: int | None = 0

    def partial_fit(self, x: np.ndarray, y: np.ndarray) -> float:
        """One shuffled pass; returns the mean loss."""
        x, y = np.asarray(x, float), np.asarray(y, float)
        order, losses = np.random.default_rng(self.seed).permutation(len(x)), []
        for i in range(0, len(x), self.batch_size):
            part = order[i : i + self.batch_size]
            loss = self.model.train_batch(x[part], y[part])
            if hasattr(self.model, "update"):
                self.model.update(loss)
            losses.append(float(loss))
        return float(np.mean(losses)) if losses else 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 10, max_iterations: int | None = None) -> "BatchTrainer":
        for _ in range(epochs if max_iterations is None else max_iterations // max(1, len(x)) + 1):
            self.partial_fit(x, y)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.asarray(self.model.predict(np.asarray(x, float)))


def torch_model(module, optimizer, criterion, device: str = "cpu"):
    """A batch model of a torch module, an optimizer's factory (parameters -> optimizer) and a criterion."""
    import torch

    class Wrapped:
        def __init__(self):
            self.module = module.to(device)
            self.optimizer = optimizer(self.module.parameters())

        def train_batch(self, x, y):
            self.module.train()
            self.optimizer.zero_grad()
            out = self.module(torch.as_tensor(x, dtype=torch.float32, device=device))
            loss = criterion(out.squeeze(-1), torch.as_tensor(y, dtype=torch.float32, device=device))
            loss.backward()
            self.optimizer.step()
            if hasattr(self.module, "update"):
                self.module.update(loss)
            return float(loss.detach())

        def predict(self, x):
            self.module.eval()
            with torch.no_grad():
                return self.module(torch.as_tensor(x, dtype=torch.float32, device=device)).squeeze(-1).cpu().numpy()

    return Wrapped()


def predict_batches(df: DataFrame, model, features: str = "features", out: str = "prediction") -> DataFrame:
    """df with the model's predictions of an array column, a batch at a time on the executors; a null row has a null prediction."""

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in parts:
            made = pd.Series(np.full(len(x), np.nan))
            known = np.flatnonzero(x.notna().to_numpy())
            if len(known):
                made.iloc[known] = np.asarray(model.predict(np.stack(x.iloc[known].to_numpy()).astype(float)), float)
            yield made

    return df.withColumn(out, F.nanvl(run(F.col(features)), F.lit(None).cast("double")))
