"""Online learning: learners with an explicit state, run in order over one series for each key.

A learner answers `predict(x)` and learns by `learn(x, prediction, loss, y)`. All it knows is in its
attributes, so it is copied, pickled into a task or kept in a state store as it is. `run_online` is the
one place where rows are visited in order; keys run in parallel, a single key does not. Hedge,
aggregating and time-feature weights have closed forms as windows (`experts`).
"""

from __future__ import annotations

import copy
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Loss = Callable[[np.ndarray, float], np.ndarray]


def squared(p, y):
    return 0.5 * (np.asarray(p, float) - y) ** 2


def absolute(p, y):
    return np.abs(np.asarray(p, float) - y)


def logistic(p, y):
    return np.logaddexp(0.0, -y * np.asarray(p, float))


LOSSES: dict[str, Loss] = {"squared": squared, "absolute": absolute, "logistic": logistic}


# functions with gradients


@dataclass(frozen=True)
class Smooth:
    """A function with its gradient, and its Hessian where known."""

    value: Callable
    slope: Callable
    curve: Callable | None = None

    def __call__(self, *a):
        return self.value(*a)

    def gradient(self, *a):
        return self.slope(*a)

    def hessian(self, *a):
        if self.curve is None:
            raise NotImplementedError("no Hessian is known")
        return self.curve(*a)


def _parts():
    identity = Smooth(_same, _ones, _none)
    total = Smooth(_total, _ones, _none)
    squares = Smooth(_squares, _twice, _two)
    square_loss = Smooth(_half_square, _off, None)
    absolute_loss = Smooth(_abs_sum, _signs, None)
    linear = Smooth(_dot, _second, None)
    return identity, total, squares, square_loss, absolute_loss, linear


def _same(x, *_):
    return x


def _ones(x, *_):
    return np.ones_like(np.asarray(x, float))


def _none(x, *_):
    return np.zeros((np.size(x), np.size(x)))


def _total(x, *_):
    return float(np.sum(x))


def _squares(x, *_):
    return float(np.sum(np.asarray(x) ** 2))


def _twice(x, *_):
    return 2 * np.asarray(x, float)


def _two(x, *_):
    return 2 * np.eye(np.size(x))


def _half_square(p, y):
    return float(np.sum(0.5 * (np.asarray(p) - y) ** 2))


def _off(p, y):
    return np.asarray(p, float) - y


def _abs_sum(p, y):
    return float(np.sum(np.abs(np.asarray(p) - y)))


def _signs(p, y):
    return np.sign(np.asarray(p, float) - y)


def _dot(theta, x):
    return float(np.dot(theta, x))


def _second(theta, x):
    return np.asarray(x, float)


IDENTITY, SUM, SQUARES, SQUARED_LOSS, ABSOLUTE_LOSS, LINEAR = _parts()


def quadratic(a: np.ndarray, b: np.ndarray, c: float) -> Smooth:
    """x'Ax / 2 + b'x + c."""
    sym = (a + a.T) / 2
    return Smooth(lambda x, *_: float(0.5 * x @ a @ x + b @ x + c), lambda x, *_: sym @ x + b, lambda x, *_: sym)


def stochastic(function: Callable, size: int = 1000, seed: int | None = None, delta: float = 0.01) -> Smooth:
    """The gradient by differences over a Gaussian cloud of `size` points of spread delta."""
    rng = np.random.default_rng(seed)

    def slope(x, *a):
        x = np.asarray(x, float)
        off = delta * rng.normal(size=(size, len(x)))
        rise = np.array([function(x + o, *a) for o in off]) - function(x, *a)
        return (rise[:, None] / off).mean(axis=0)

    return Smooth(function, slope)


def holder_reduction(beta: float, start: np.ndarray, f: Smooth, mode: str = "paper") -> Smooth:
    """f + (1 - beta) / 2 * |x - start| ** 2; mode "reference" halves the added gradient."""
    if not 0 < beta <= 1:
        raise ValueError("beta must be in (0, 1]")
    a, k = 1 - beta, 0.5 if mode == "reference" else 1.0
    return Smooth(lambda x, *r: f(x, *r) + a / 2 * float(np.sum((x - start) ** 2)), lambda x, *r: f.gradient(x, *r) + k * a * (x - start), lambda x, *r: f.hessian(x, *r) + k * a * np.eye(len(start)))


# learners


@dataclass
class Learner:
    """t: steps so far; regret: cumulated loss."""

    t: int = field(default=0, init=False)
    regret: float = field(default=0.0, init=False)
    fitted: bool = field(default=False, init=False)

    def predict(self, x):
        raise NotImplementedError

    def learn(self, x, prediction, loss, y) -> None:
        raise NotImplementedError

    def fresh(self) -> Learner:
        """A copy that has learned nothing; priors are never shared."""
        return copy.deepcopy(self)


def _scalar(loss) -> float:
    if np.ndim(loss) != 0:
        raise ValueError("the loss must be a single number")
    return float(loss)


def _vector(loss, n: int) -> np.ndarray:
    loss = np.asarray(loss, float)
    if loss.ndim != 1 or len(loss) != n:
        raise ValueError("the loss must be a vector, one number for each expert")
    return loss


@dataclass
class Constant(Learner):
    value: float = 0.0

    def predict(self, x):
        return self.value

    def learn(self, x, prediction, loss, y) -> None:
        self.t += 1


@dataclass
class PartialFit(Learner):
    """Wraps an estimator with predict and partial_fit; a failing prediction counts as 0.0."""

    estimator: object = None

    def predict(self, x):
        try:
            return float(np.ravel(self.estimator.predict(np.asarray(x, float)[None, :]))[0])
        except Exception:  # an estimator that has seen nothing yet raises what it likes
            return 0.0

    def learn(self, x, prediction, loss, y) -> None:
        if y is not None:
            self.estimator.partial_fit(np.asarray(x, float)[None, :], np.array([y]))


@dataclass
class Experts(Learner):
    """Base of expert algorithms: the prediction is the vector of the experts' predictions."""

    experts: list = field(default_factory=list)
    prior: np.ndarray | None = None
    rate: float = 1.0
    update_experts: bool = True
    skip_zero_loss: bool = False

    def __post_init__(self):
        k = len(self.experts)
        p = np.full(k, 1 / k) if self.prior is None else np.array(self.prior, float)
        if len(p) != k or (p < 0).any() or not np.isclose(p.sum(), 1):
            raise ValueError("a prior has one number for each expert, none negative, of sum 1")
        self.weights = p

    def opinions(self, x) -> np.ndarray:
        return np.array([e.predict(x) for e in self.experts], float)

    def predict(self, x):
        return self.opinions(x)

    def teach(self, x, prediction, loss, y) -> None:
        if self.update_experts:
            for e, p, v in zip(self.experts, prediction, loss, strict=True):
                if not (self.skip_zero_loss and v == 0):
                    e.learn(x, p, v, y)


@dataclass
class Hedge(Experts):
    """Weights proportional to prior * exp(-rate * cumulated loss)."""

    def reweigh(self, loss: np.ndarray) -> None:
        w = self.weights * np.exp(-self.rate * (loss - loss.min()))
        self.weights = w / w.sum()

    def cost(self, loss: np.ndarray) -> float:
        return float(loss @ self.weights)

    def learn(self, x, prediction, loss, y) -> None:
        loss = _vector(loss, len(self.experts))
        self.reweigh(loss)
        self.teach(x, prediction, loss, y)
        self.regret += self.cost(loss)
        self.t += 1


@dataclass
class Aggregating(Hedge):
    """Hedge at rate 1 whose cost is the mixture's: -ln sum w exp(-loss)."""

    def cost(self, loss: np.ndarray) -> float:
        return float(-np.log(self.weights @ np.exp(-(loss - loss.min()))) + loss.min())


@dataclass
class FixedShare(Hedge):
    switching: float = 0.1

    def learn(self, x, prediction, loss, y) -> None:
        super().learn(x, prediction, loss, y)
        k = len(self.experts)
        b = self.switching * k / (k - 1)
        self.weights = (1 - b) * self.weights + b / k
        self.weights /= self.weights.sum()


@dataclass
class Exp3(Experts):
    """One expert is followed and its loss, divided by its weight, is charged. strategy: random, median, max (or mode), or a function."""

    strategy: str | Callable = "random"
    seed: int | None = None
    least: float = 1e-6

    def __post_init__(self):
        super().__post_init__()
        self.rng = np.random.RandomState(self.seed)
        self.chosen = 0

    def predict(self, x):
        p = self.opinions(x)
        if callable(self.strategy):
            self.chosen = int(self.strategy(p, self.weights))
        elif self.strategy == "random":
            self.chosen = int(self.rng.choice(len(p), p=self.weights))
        elif self.strategy == "median":
            order = np.argsort(p)
            self.chosen = int(order[min(np.searchsorted(np.cumsum(self.weights[order]), 0.5), len(p) - 1)])
        elif self.strategy in ("max", "mode"):
            top = np.flatnonzero(self.weights == self.weights.max())
            self.chosen = int(top[self.rng.choice(len(top))])
        else:
            raise ValueError(f"Unknown prediction strategy: {self.strategy}")
        return p[self.chosen]

    def learn(self, x, prediction, loss, y) -> None:
        charged = np.zeros(len(self.experts))
        charged[self.chosen] = _scalar(loss) / self.weights[self.chosen]
        w = self.weights * np.exp(-self.rate * charged)
        w /= w.sum()
        self.regret += float(charged @ w)
        w = np.maximum(w, self.least)
        self.weights = w / w.sum()
        self.t += 1


@dataclass
class UCB(Experts):
    """Follows unseen experts first, then the least of mean loss - sqrt(alpha ln t / n / 2)."""

    alpha: float = 1.001

    def __post_init__(self):
        super().__post_init__()
        self.mean, self.count, self.chosen = np.zeros(len(self.experts)), np.zeros(len(self.experts)), 0

    def predict(self, x):
        if (self.count == 0).any():
            self.chosen = int(self.count.argmin())
        else:
            self.chosen = int((self.mean - np.sqrt(self.alpha * np.log(self.t) / self.count / 2)).argmin())
        return self.opinions(x)[self.chosen]

    def learn(self, x, prediction, loss, y) -> None:
        v, k = _scalar(loss), self.chosen
        self.count[k] += 1
        self.mean[k] += (v - self.mean[k]) / self.count[k]
        if self.update_experts:
            self.experts[k].learn(x, prediction, v, y)
        self.regret += v
        self.t += 1


@dataclass
class TimeHedge(Experts):
    """Weights softmax(-theta f(t)); theta += rate * loss f(t)'. f: features of the step's number."""

    features: Callable[[int], np.ndarray] | None = None

    def __post_init__(self):
        prior, self.prior = self.prior, None
        super().__post_init__()
        k, m = len(self.experts), len(self.features(0))
        theta = np.zeros((k, m)) if prior is None else np.array(prior, float)
        if theta.shape == (m,):
            theta = np.tile(theta, (k, 1))
        if theta.shape != (k, m):
            raise ValueError("a prior has one number for each feature, or a row of them for each expert")
        self.theta = theta

    def softmax(self) -> np.ndarray:
        g = self.theta @ np.asarray(self.features(self.t), float)
        w = np.exp(-(g - g.min()))
        return w / w.sum()

    def move(self, loss: np.ndarray, f: np.ndarray) -> None:
        self.theta = self.theta + self.rate * np.outer(loss, f)

    def learn(self, x, prediction, loss, y) -> None:
        loss = _vector(loss, len(self.experts))
        self.move(loss, np.asarray(self.features(self.t), float))
        self.teach(x, prediction, loss, y)
        self.weights = self.softmax()
        self.regret += float(loss @ self.weights)
        self.t += 1


@dataclass
class TimeFixedShare(TimeHedge):
    switching: float = 0.1

    def move(self, loss: np.ndarray, f: np.ndarray) -> None:
        k = len(self.experts)
        b = self.switching * k / (k - 1)
        g = self.theta @ f
        self.theta = self.theta - np.outer(g + np.log((1 - b) * np.exp(-g - self.rate * loss) + b / k), f)


@dataclass
class Gradient(Learner):
    """theta -= rate(t) * gradient of loss(objective(theta, x), y), then the projection."""

    parameters: int | np.ndarray = 1
    objective: Smooth = LINEAR
    loss: Smooth = SQUARED_LOSS
    rate: float | Callable[[int], float] = 0.01
    projection: Callable | None = None

    def __post_init__(self):
        self.theta = np.zeros(self.parameters) if isinstance(self.parameters, int) else np.array(self.parameters, float)

    def at(self, v) -> float:
        return v(self.t) if callable(v) else v

    def predict(self, x):
        return self.objective(self.theta, x)

    def gradient(self, x, prediction, y) -> np.ndarray:
        return np.atleast_1d(np.dot(self.loss.gradient(prediction, y), self.objective.gradient(self.theta, x))).astype(float)

    def move(self, g: np.ndarray) -> None:
        self.theta = self.theta - self.at(self.rate) * g

    def learn(self, x, prediction, loss, y) -> None:
        v = _scalar(loss)
        self.move(self.gradient(x, prediction, y))
        if self.projection is not None:
            self.theta = self.projection(self.theta)
        self.regret += v
        self.t += 1


@dataclass
class NewtonStep(Gradient):
    """Steps by the inverse of epsilon I + sum g g', kept by rank-one updates."""

    epsilon: float = 1e-8

    def __post_init__(self):
        super().__post_init__()
        self.inverse = np.eye(len(self.theta)) / self.epsilon

    def decay(self, g: np.ndarray) -> np.ndarray:
        return g

    def move(self, g: np.ndarray) -> None:
        g_in = self.decay(g)
        v = self.inverse @ g_in
        self.inverse = self.inverse - np.outer(v, v) / (1 + g_in @ v)
        self.theta = self.theta - self.at(self.rate) * self.inverse @ g


@dataclass
class ForgetfulNewtonStep(NewtonStep):
    """A = beta A + K (1 - beta) g g'; mode "reference" scales g by K (1 - beta) in the inverse's update, "paper" by its root."""

    beta: float = 0.9
    scale: float = 1.0
    mode: str = "paper"

    def decay(self, g: np.ndarray) -> np.ndarray:
        self.inverse = self.inverse / self.beta
        k = self.scale * (1 - self.beta)
        return g * (k if self.mode == "reference" else np.sqrt(k))


@dataclass
class MirrorDescent(Gradient):
    """theta = inverse(regulariser's gradient at theta - rate * g)."""

    regulariser: Smooth = SQUARES
    inverse: Callable = staticmethod(lambda z: z / 2)

    def move(self, g: np.ndarray) -> None:
        self.theta = self.inverse(self.regulariser.gradient(self.theta) - self.at(self.rate) * g)


@dataclass
class ExponentialGradient(Gradient):
    def move(self, g: np.ndarray) -> None:
        self.theta = self.theta * np.exp(-self.at(self.rate) * g)


@dataclass
class Adam(Gradient):
    beta1: float = 0.9
    beta2: float = 0.999
    epsilon: float = 1e-8

    def __post_init__(self):
        super().__post_init__()
        self.m, self.v = np.zeros_like(self.theta), np.zeros_like(self.theta)

    def move(self, g: np.ndarray) -> None:
        self.m = self.beta1 * self.m + (1 - self.beta1) * g
        self.v = self.beta2 * self.v + (1 - self.beta2) * g * g
        n = self.t + 1
        self.theta = self.theta - self.at(self.rate) * (self.m / (1 - self.beta1**n)) / (np.sqrt(self.v / (1 - self.beta2**n)) + self.epsilon)


@dataclass
class FKM(Gradient):
    """Bandit descent: predicts at a random point of distance delta until fitted; the gradient is d / delta * loss * direction."""

    delta: float | Callable[[int], float] = 0.01
    seed: int | None = 0

    def __post_init__(self):
        super().__post_init__()
        self.rng = np.random.default_rng(self.seed)
        self.direction = np.zeros_like(self.theta)
        self.seen_loss = 0.0

    def predict(self, x):
        if self.fitted:
            return self.objective(self.theta, x)
        u = self.rng.normal(0, 1, size=self.theta.shape)
        self.direction = u / np.linalg.norm(u)
        return self.objective(self.theta + self.at(self.delta) * self.direction, x)

    def learn(self, x, prediction, loss, y) -> None:
        self.seen_loss = _scalar(loss)
        super().learn(x, prediction, loss, y)

    def gradient(self, x, prediction, y) -> np.ndarray:
        return len(self.theta) / self.at(self.delta) * self.seen_loss * self.direction


@dataclass
class Averaged(Learner):
    """A gradient learner that predicts with an average of its iterates once fitted: mean (1 / t), exponential (beta) or root (t ** root)."""

    inner: Gradient | None = None
    kind: str = "mean"
    beta: float = 0.9
    root: float = 0.5

    def __post_init__(self):
        if self.kind not in ("mean", "exponential", "root"):
            raise ValueError(f"Unknown average: {self.kind}")
        self.average = np.zeros_like(self.inner.theta)

    def predict(self, x):
        return self.inner.objective(self.average, x) if self.fitted else self.inner.predict(x)

    def learn(self, x, prediction, loss, y) -> None:
        self.inner.learn(x, prediction, loss, y)
        self.t, self.regret = self.inner.t, self.inner.regret
        n = {"mean": self.t, "root": self.t**self.root}.get(self.kind)
        keep = self.beta if n is None else (n - 1) / n
        self.average = keep * self.average + (1 - keep) * self.inner.theta


@dataclass
class SignLinear(Learner):
    """A linear layer whose weights' signs (+, -, and 0 if asked) are followed as experts, by EXP3 with mixing."""

    inputs: int = 1
    outputs: int = 1
    zero: bool = True
    rate: float = 0.1
    alpha: float = 0.1
    seed: int | None = 0

    def __post_init__(self):
        self.rng = np.random.default_rng(self.seed)
        k = 3 if self.zero else 2
        self.share = np.full((k, self.outputs, self.inputs), 1 / k)
        self.size = np.abs(self.rng.normal(size=(2, self.outputs, self.inputs)))
        self.bias = self.rng.normal(size=self.outputs)
        self.choice = np.zeros((self.outputs, self.inputs), int)

    def predict(self, x):
        if self.fitted:
            self.choice = self.share.argmax(axis=0)
        else:
            self.choice = (np.cumsum(self.share, axis=0) >= self.rng.random(self.choice.shape)).argmax(axis=0)
        w = np.select([self.choice == 0, self.choice == 1], [self.size[0], -self.size[1]], 0.0)
        out = w @ np.asarray(x, float) + self.bias
        return out if self.outputs > 1 else float(out[0])

    def learn(self, x, prediction, loss, y) -> None:
        v, k = float(np.mean(loss)), len(self.share)
        p = np.take_along_axis(self.share, self.choice[None], 0)
        np.put_along_axis(self.share, self.choice[None], p * np.exp(-self.rate * v / p), 0)
        b = self.alpha * k / (k - 1)
        self.share = (1 - b) * self.share + b / k
        self.share /= self.share.sum(axis=0)
        self.regret += v
        self.t += 1


# running


def play(learner: Learner, xs, ys, loss: Loss, rounds: int = 1, shuffle: bool = False, seed: int | None = None) -> tuple[list, list, list]:
    """Predictions, losses (loss(prediction, y), as numbers or vectors) and cumulated regrets of rows in order."""
    rng = np.random.RandomState(seed)
    predictions, losses, regrets = [], [], []
    for _ in range(rounds):
        for i in rng.permutation(len(ys)) if shuffle else range(len(ys)):
            p = learner.predict(xs[i])
            v = loss(p, ys[i])
            learner.learn(xs[i], p, v, ys[i])
            predictions.append(p), losses.append(v), regrets.append(learner.regret)
    return predictions, losses, regrets


def run_online(df: DataFrame, learner: Learner, order: str, target: str, features: str | None = None, loss: str | Loss = "squared", keys: list[str] | tuple[str, ...] = (), rounds: int = 1, shuffle: bool = False, seed: int | None = None) -> DataFrame:
    """Every row's prediction (an array), loss (mean of a vector) and regret so far, with a fresh learner for each key.

    features: an array column, else the learner sees [1.0]. Rows without a target are predicted, not
    learned from. Rounds repeat the rows, shuffled anew if asked.
    """
    keys = list(keys)
    f = LOSSES[loss] if isinstance(loss, str) else loss
    types = dict(df.dtypes)

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        own, rng = learner.fresh(), np.random.RandomState(seed)
        xs = [np.asarray(x, float) for x in pdf[features]] if features else [np.ones(1)] * len(pdf)
        out = []
        for turn in range(rounds):
            for i in rng.permutation(len(pdf)) if shuffle else range(len(pdf)):
                y, p = pdf[target].iloc[i], own.predict(xs[i])
                v = None
                if y == y and y is not None:
                    v = f(p, float(y))
                    own.learn(xs[i], p, v, float(y))
                out.append((*(pdf[k].iloc[i] for k in keys), turn, pdf[order].iloc[i], np.atleast_1d(p).astype(float).tolist(), None if v is None else float(np.mean(v)), own.regret))
        return pd.DataFrame(out, columns=[*keys, "round", order, "prediction", "loss", "regret"])

    schema = "".join(f"`{k}` {types[k]}, " for k in keys) + f"round int, `{order}` {types[order]}, prediction array<double>, loss double, regret double"
    rows = df.select(*keys, order, F.col(target).cast("double").alias(target), *([features] if features else []))
    return rows.groupBy(*keys).applyInPandas(go, schema)


class Game:
    """Steps in order: a state is shown, a learner predicts, the loss is told and learned from.

    Subclasses say what is shown (`state`), what a prediction costs (`cost`), the truth if there is one
    (`truth`) and which steps there are (`step_numbers`). `step` plays the current step, so that a caller
    can look in between; `play` plays them all. Games run on the driver, over data that fit there;
    `run_online` and `operators.backtest` are the same steps over tables.
    """

    def __init__(self):
        self.t, self.losses, self.predictions = 0, [], []

    def state(self):
        raise NotImplementedError

    def cost(self, prediction, state):
        raise NotImplementedError

    def truth(self):
        return None

    def step_numbers(self):
        raise NotImplementedError

    def step(self, learner: Learner):
        """(prediction, loss) of the current step."""
        x = self.state()
        p = learner.predict(x)
        v = self.cost(p, x)
        learner.learn(x, p, v, self.truth())
        self.predictions.append(p), self.losses.append(v)
        self.t += 1
        return p, v

    def play(self, learner: Learner) -> dict:
        for _ in self.step_numbers():
            self.step(learner)
        return self.results()

    def results(self) -> dict:
        """Steps played, their predictions and losses, and the mean loss (of numbers; 0 without any)."""
        numbers = [float(np.mean(v)) for v in self.losses if v is not None]
        return {"n_steps": self.t, "predictions": self.predictions, "losses": self.losses, "mean_loss": float(np.mean(numbers)) if numbers else 0.0}

    def reset(self) -> None:
        self.t, self.losses, self.predictions = 0, [], []


class DatasetGame(Game):
    """The rows of a matrix with their targets, `rounds` times, shuffled anew for each round if asked; loss(prediction, y)."""

    def __init__(self, xs, ys, loss: Loss, rounds: int = 1, shuffle: bool = True, seed: int | None = None):
        super().__init__()
        if len(xs) != len(ys):
            raise ValueError("a target is needed for each row")
        self.xs, self.ys, self.loss, self.rounds, self.shuffle, self.seed = xs, ys, loss, rounds, shuffle, seed
        self.at = 0

    def state(self):
        return self.xs[self.at]

    def truth(self):
        return self.ys[self.at]

    def cost(self, prediction, state):
        return self.loss(prediction, self.ys[self.at])

    def step_numbers(self):
        rng = np.random.RandomState(self.seed)
        for _ in range(self.rounds):
            for self.at in rng.permutation(len(self.ys)) if self.shuffle else range(len(self.ys)):
                yield self.at

    def reset(self) -> None:
        super().reset()
        self.at = 0


def _mark_fitted(learner: Learner) -> Learner:
    learner.fitted = True
    if isinstance(learner, Averaged):
        learner.inner.fitted = True
    return learner


def fit(learner: Learner, xs, ys, loss: Loss) -> Learner:
    """A fresh learner after one ordered pass, marked as fitted."""
    return partial_fit(learner.fresh(), xs, ys, loss)


def partial_fit(learner: Learner, xs, ys, loss: Loss) -> Learner:
    """The learner itself after one more ordered pass, marked as fitted."""
    DatasetGame(xs, ys, loss, shuffle=False).play(learner)
    return _mark_fitted(learner)


def predictions(learner: Learner, xs) -> np.ndarray:
    """Predictions of a fitted learner, which learns nothing from them; one that isn't fitted raises."""
    if not learner.fitted:
        raise ValueError("the learner must be fitted before it predicts")
    return np.array([learner.predict(x) for x in xs])


def additive_stages(initial: np.ndarray, stages: list[Callable], rate: float, scales: list[float]) -> list[Callable]:
    """An additive model (initial value, then stages) as experts whose mean is the model: each is its part times the number of parts."""
    n = len(stages) + 1
    parts: list[Callable] = [lambda x: n * np.asarray(initial, float)]
    parts += [lambda x, s=s, k=k: -rate * np.asarray(s(x), float) * k * n for s, k in zip(stages, scales, strict=True)]
    return parts


def stages_of(model) -> list[Callable]:
    """The additive parts of a fitted natural-gradient boosting model (see `additive_stages`), for rows of features.

    model: anything with init_params, base_models (a list of estimators for each stage, one for each
    parameter), scalings, col_idxs and learning_rate, as such models have once fitted.
    """

    def stage(estimators, columns) -> Callable:
        return lambda x: np.array([e.predict(np.atleast_2d(np.asarray(x, float))[:, columns]) for e in estimators]).T

    stages = [stage(e, c) for e, c in zip(model.base_models, model.col_idxs, strict=True)]
    return additive_stages(np.asarray(model.init_params, float), stages, model.learning_rate, list(model.scalings))


@dataclass
class Part(Learner):
    """An expert that is a fixed function and learns nothing."""

    function: Callable | None = None

    def predict(self, x):
        return self.function(x)

    def learn(self, x, prediction, loss, y) -> None:
        self.t += 1


@dataclass
class StageReweigher:
    """An additive model whose parts are weighed by an expert algorithm.

    parts: functions of a row (from `stages_of` or `additive_stages`). algorithm: makes the expert
    algorithm from a list of experts. loss(prediction, y) of one part's prediction. `fit` learns the
    weights over rows in order, `predict` gives each row's weighted sum of the parts, with equal
    weights as the model itself.
    """

    parts: list[Callable]
    algorithm: Callable[[list], Experts]
    loss: Callable

    def fit(self, xs, ys) -> StageReweigher:
        self.experts = self.algorithm([Part(f) for f in self.parts])
        for x, y in zip(xs, ys, strict=True):
            made = [f(x) for f in self.parts]
            self.experts.learn(x, made, np.array([float(np.mean(self.loss(p, y))) for p in made]), y)
        _mark_fitted(self.experts)
        return self

    def predict(self, xs) -> np.ndarray:
        if getattr(self, "experts", None) is None:
            raise ValueError("the weights must be fitted before they are used")
        return np.array([sum(w * np.squeeze(np.asarray(f(x), float)) for w, f in zip(self.experts.weights, self.parts, strict=True)) for x in xs])


def weigh_stages(df: DataFrame, stages: str, weights: str) -> DataFrame:
    """Adds `combined`: the sum of stage predictions times weights, of two array columns."""
    return df.withColumn("combined", F.aggregate(F.zip_with(stages, weights, lambda a, w: a * w), F.lit(0.0), lambda s, v: s + v))
