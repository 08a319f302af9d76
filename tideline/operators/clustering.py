"""Prototype clustering with distance weights: two batch algorithms and four online ones.

Batch: rows are packed into blocks once. In each iteration every task adds up weights and weighted rows
for each centre (a vectorised pass, a matrix of K rows out), the driver adds the matrices of a few tasks
a core, and K centres go back to the tasks. Nothing of the rows' number is collected. Online rules
depend on the order of rows; they run over one ordered series for each key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Euclidean, rows x centres; differences are formed a centre at a time, so memory is rows x features."""
    return np.stack([np.sqrt(((x - c) ** 2).sum(axis=1)) for c in centers], axis=1)


def distance_weights(d: np.ndarray) -> np.ndarray:
    """A row's weight for its own centre: d + 2 * sum of all; for others: least ** 2 / d, 0 at d = 0."""
    own = d.argmin(axis=1)
    least = d[np.arange(len(d)), own][:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        w = np.where(d > 0, least**2 / d, 0.0)
    rows = np.arange(len(d))
    w[rows, own] = d[rows, own] + 2 * d.sum(axis=1)
    return w


def inverse_weights(d: np.ndarray, n: float, p: float, own_rule: bool) -> np.ndarray:
    """p * least ** n / d ** (p + 2); with own_rule the row's own centre has the derivative's other form (negative, or NaN at d = 0)."""
    own = d.argmin(axis=1)
    rows = np.arange(len(d))
    least = d[rows, own][:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        w = np.where(d > 0, p * least**n / d ** (p + 2), 0.0)
        if own_rule:
            rest = np.where(d != least, 1.0 / d**p, 0.0).sum(axis=1)
            w[rows, own] = -(n - p) * least[:, 0] ** (n - p - 2) - n * least[:, 0] ** (n - 2) * rest
    return w


def draw_centers(df: DataFrame, features: str, k: int, seed: int | None = 0) -> np.ndarray:
    """k different rows at random."""
    rows = df.where(F.col(features).isNotNull()).select(features).orderBy(F.rand(seed)).limit(k).collect()
    if len(rows) < k:
        raise ValueError(f"{k} centres need as many rows; there are {len(rows)}")
    return np.array([r[0] for r in rows], float)


#: Numbers in a block of rows (1 MB).
BLOCK = 1 << 17


def blocks(df: DataFrame, features: str) -> DataFrame:
    """The rows with features as matrices of doubles, one after another: `block` binary, at most BLOCK numbers or one row each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, lengths = b.column(0), np.unique(b.column(0).value_lengths().to_numpy(zero_copy_only=False))
            if len(lengths) > 1:
                raise ValueError(f"rows of different lengths: {lengths.min()} and {lengths.max()}")
            m = x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(x), -1)
            n = max(1, BLOCK // max(1, m.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array([m[i : i + n].tobytes() for i in range(0, len(m), n)], pa.binary())], ["block"])

    return df.where(F.col(features).isNotNull()).select(F.col(features).cast("array<double>").alias("x")).mapInArrow(pack, "block binary")


def _tasks(df: DataFrame) -> int:
    """Tasks of a pass: by the cores, whatever the rows' number, as the driver adds up a matrix from each."""
    return 3 * df.sparkSession.sparkContext.defaultParallelism


@dataclass
class _Clustering:
    """Shared: prediction, distances and score against centers."""

    n_clusters: int = 8
    features: str = "features"
    seed: int | None = 0
    centers: np.ndarray | None = None

    def _fitted(self) -> np.ndarray:
        if self.centers is None:
            raise ValueError("fit first")
        return self.centers

    def transform(self, df: DataFrame) -> DataFrame:
        """df with `distances`, to each centre."""
        c = self._fitted()

        @F.pandas_udf("array<double>")
        def to_all(x: pd.Series) -> pd.Series:
            return pd.Series(list(distances(np.stack(x.to_numpy()).astype(float), c))) if len(x) else pd.Series([], dtype=object)

        return df.withColumn("distances", to_all(F.col(self.features)))

    def predict(self, df: DataFrame) -> DataFrame:
        """df with `cluster`: the nearest centre's number, the first of several. JVM-side: K squared distances of one row."""
        return df.withColumn("cluster", F.array_position(_squares(F.col(self.features), self._fitted()), F.array_min(_squares(F.col(self.features), self._fitted()))).cast("int") - 1)

    def score(self, df: DataFrame) -> float:
        """Minus the sum of squared distances to the nearest centres."""
        found = df.agg(F.sum(F.array_min(_squares(F.col(self.features), self._fitted()))).alias("s")).first()["s"]
        return -(found or 0.0)


def _squares(x, centers: np.ndarray):
    """Squared distances of an array column to each centre, as an array."""
    c = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in centers])
    return F.transform(c, lambda m: F.aggregate(F.zip_with(x, m, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))


@dataclass
class _Batch(_Clustering):
    max_iter: int = 300
    tol: float = 1e-4
    iterations: int = 0

    def weights(self, d: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def _moved(self, held: DataFrame, centers: np.ndarray) -> np.ndarray:
        """New centres from one pass over blocks: each task returns one matrix, weights beside weighted sums."""
        weigh, shape = self.weights, centers.shape

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((shape[0], shape[1] + 1))
            for b in batches:
                for block in b.column(0):
                    x = np.frombuffer(block.as_buffer()).reshape(-1, shape[1])
                    w = weigh(distances(x, centers))
                    total[:, 0] += w.sum(axis=0)
                    total[:, 1:] += w.T @ x
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

        total = np.zeros((shape[0], shape[1] + 1))
        for r in held.mapInArrow(sums, "total binary").collect():  # a row for each task, see _tasks
            total += np.frombuffer(r["total"]).reshape(total.shape)
        new, some = centers.copy(), total[:, 0] > 0
        new[some] = total[some, 1:] / total[some, :1]
        return new

    def step(self, df: DataFrame, centers: np.ndarray) -> np.ndarray:
        """New centres from one pass; a centre whose weights don't have a positive sum stays."""
        return self._moved(blocks(df, self.features).coalesce(_tasks(df)), centers)

    def fit(self, df: DataFrame, init: np.ndarray | None = None):
        """Iterates until the centres move by less than tol together; the last, smaller move is not made.

        The rows are read once and held on the executors' disks as blocks, dealt evenly to the tasks of a pass.
        """
        centers = draw_centers(df, self.features, self.n_clusters, self.seed) if init is None else np.array(init, float)
        n = df.where(F.col(self.features).isNotNull()).count() * centers.shape[1] // BLOCK + 1
        held = blocks(df, self.features).repartition(min(n, _tasks(df))).persist(StorageLevel.DISK_ONLY)
        try:
            for self.iterations in range(1, self.max_iter + 1):
                new = self._moved(held, centers)
                if np.linalg.norm(new - centers) < self.tol:
                    break
                centers = new
        finally:
            held.unpersist()
        self.centers = centers
        return self


@dataclass
class WeightedKMeans(_Batch):
    def weights(self, d: np.ndarray) -> np.ndarray:
        return distance_weights(d)


@dataclass
class InverseWeightedKMeans(_Batch):
    """mode "paper": one rule for all centres; "reference": the own centre by the derivative, which never moves at the defaults."""

    n: float = 2
    p: float = 2
    mode: str = "paper"

    def weights(self, d: np.ndarray) -> np.ndarray:
        return inverse_weights(d, self.n, self.p, self.mode == "reference")


@dataclass
class OnlineState:
    centers: np.ndarray
    mass: np.ndarray = field(default_factory=lambda: np.zeros(0))


Rule = Callable[[OnlineState, np.ndarray], None]


def winner_rule(rate: float) -> Rule:
    def move(s: OnlineState, x: np.ndarray) -> None:
        k = int(((x - s.centers) ** 2).sum(axis=1).argmin())
        s.centers[k] += rate * (x - s.centers[k])

    return move


def inverse_mass_rule(n: float, p: float) -> Rule:
    def move(s: OnlineState, x: np.ndarray) -> None:
        a = inverse_weights(distances(x[None, :], s.centers), n, p, True)[0]
        total = s.mass + a
        with np.errstate(divide="ignore", invalid="ignore"):
            s.centers = (s.centers * s.mass[:, None] + a[:, None] * x) / total[:, None]
        s.mass = total

    return move


def inverse_gradient_rule(rate: float, n: float) -> Rule:
    def move(s: OnlineState, x: np.ndarray) -> None:
        d = distances(x[None, :], s.centers)[0]
        k, least = int(d.argmin()), d.min()
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            a = np.where(d > 0, -(least**n) / d, 0.0)
            a[k] = -(n + 1) * least ** (n - 1) - n * least ** (n - 2) * d[d != least].sum()
            s.centers -= rate * a[:, None] * (x - s.centers)

    return move


def harmonic_rule(rate: float, mode: str) -> Rule:
    """mode "paper": along the difference; "reference": its square, as some implementations have it."""

    def move(s: OnlineState, x: np.ndarray) -> None:
        diff = x - s.centers
        d2 = (diff**2).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            inverse = np.where(d2 > 0, 1 / d2, 0.0).sum()
            pull = np.where((d2 > 0)[:, None], 2 * len(d2) * diff / (d2**2 * inverse**2)[:, None], 0.0)
        s.centers += rate * pull * (diff if mode == "reference" else 1.0)

    return move


@dataclass
class _Online(_Clustering):
    learning_rate: float = 0.05
    n_iter: int = 10
    order: str = "seq"
    state: OnlineState | None = None

    passes = property(lambda self: 1)

    def rule(self) -> Rule:
        raise NotImplementedError

    def start(self, centers: np.ndarray) -> OnlineState:
        return OnlineState(np.array(centers, float), np.ones(len(centers)))

    def partial_fit(self, df: DataFrame, init: np.ndarray | None = None):
        """One ordered pass that continues from the centres that are there."""
        if self.state is None:
            self.state = self.start(draw_centers(df, self.features, self.n_clusters, self.seed) if init is None else init)
        feature, order, state, rule = self.features, self.order, self.state, self.rule()

        def go(pdf: pd.DataFrame) -> pd.DataFrame:
            for x in pdf.sort_values(order, kind="stable")[feature]:
                rule(state, np.asarray(x, float))
            return pd.DataFrame({"k": np.arange(len(state.centers)), "x": list(state.centers), "m": state.mass})

        rows = df.where(F.col(feature).isNotNull()).select(feature, order).groupBy().applyInPandas(go, "k int, x array<double>, m double")
        found = sorted(rows.collect())
        if found:
            self.state = OnlineState(np.array([r["x"] for r in found]), np.array([r["m"] for r in found]))
        self.centers = self.state.centers
        return self

    def fit(self, df: DataFrame, init: np.ndarray | None = None):
        if self.centers is not None:
            raise ValueError("already fitted; continue with partial_fit")
        for _ in range(self.passes):
            self.partial_fit(df, init)
        return self


@dataclass
class OnlineKMeans(_Online):
    passes = property(lambda self: self.n_iter)

    def rule(self) -> Rule:
        return winner_rule(self.learning_rate)


@dataclass
class InverseWeightedOnlineKMeansV1(_Online):
    n: float = 2
    p: float = 2

    def rule(self) -> Rule:
        return inverse_mass_rule(self.n, self.p)


@dataclass
class InverseWeightedOnlineKMeansV2(_Online):
    n: float = 2

    def rule(self) -> Rule:
        return inverse_gradient_rule(self.learning_rate, self.n)


@dataclass
class KHarmonicMeans(_Online):
    mode: str = "paper"

    passes = property(lambda self: self.n_iter)

    def rule(self) -> Rule:
        return harmonic_rule(self.learning_rate, self.mode)
