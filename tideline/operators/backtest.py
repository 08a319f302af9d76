"""Back-testing: steps at a cadence, windows of history, targets at a horizon, runs of strategies.

Steps, windows and targets are DataFrames. A stateless strategy is a Column over its window; a
learner (operators.online) is run in order, one task for each series; BacktestSession plays one
series step by step on the driver. Integers are rows, durations ('7D', '3h') and calendar offsets
('MS', 'W-MON', '2B') are time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.scan import bucketed
from tideline.operators.online import Game, Learner
from tideline.operators.series import SeriesFrame

DAY = 86_400_000_000


def as_of(left: DataFrame, right: DataFrame, left_on: str, right_on: str, columns: list[str], direction: str = "backward", keys: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """left with `columns` and the time of the last right row not after (backward) or the first not before (forward) each left row.

    With keys, both sides are put in one order and the other side's value is carried along a window: one
    shuffle by the keys, no pairs of rows. Without, the different times of left take the place of
    its rows, buckets of times the place of keys, and left is joined to its times: no task holds
    a side. Unmatched rows get NULL.
    """
    keys = list(keys)
    names = list(left.columns)
    taken = F.struct(*[F.col(f"`{c}`").alias(f"r_{i}") for i, c in enumerate(columns)], F.col(f"`{right_on}`").alias("r_at"))
    rights = right.where(F.col(f"`{right_on}`").isNotNull()).select(*[F.col(f"`{k}`").alias(f"k_{i}") for i, k in enumerate(keys)], F.col(f"`{right_on}`").alias("o"), taken.alias("r"))
    lefts = left.select(*[F.col(f"`{c}`").alias(f"l_{i}") for i, c in enumerate(names)], *[F.col(f"`{k}`").alias(f"k_{i}") for i, k in enumerate(keys)], F.col(f"`{left_on}`").alias("o"))
    if keys or not all(_place(df) is not None for df in (lefts, rights)):
        out = _carried(lefts, rights, direction, [f"k_{i}" for i in range(len(keys))])
    else:
        out = lefts.join(_carried_over_times(lefts.select("o").where("o IS NOT NULL").distinct(), rights, direction), "o", "left")
    return out.select(*[F.col(f"l_{i}").alias(c) for i, c in enumerate(names)], *[F.col(f"r.r_{i}").alias(c) for i, c in enumerate(columns)], F.col("r.r_at").alias("matched_at"))


def _sides(lefts: DataFrame, rights: DataFrame, direction: str) -> tuple[DataFrame, list[Column]]:
    """Both sides' rows with is_left, r of the right ones, and the order in which r is carried on."""
    side = lambda is_left: F.lit(int(is_left == (direction == "backward"))).alias("side")
    both = lefts.select("*", side(True), F.lit(None).cast(rights.schema["r"].dataType).alias("r"), F.lit(True).alias("is_left"))
    both = both.unionByName(rights.select("*", side(False), F.lit(False).alias("is_left")), allowMissingColumns=True)
    return both, [F.col("o"), F.col("side")] if direction == "backward" else [F.desc("o"), F.desc("side")]


def _carried(lefts: DataFrame, rights: DataFrame, direction: str, keys: list[str]) -> DataFrame:
    both, order = _sides(lefts, rights, direction)
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("r", F.when(F.col("o").isNotNull(), F.last("r", True).over(upto))).where("is_left")


def _place(df: DataFrame) -> Column | None:
    """The time column o as a double in the same order, for buckets; None for other types."""
    kind = df.schema["o"].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date("o").cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros("o").cast("double")
    return F.col("o").cast("double") if isinstance(kind, T.NumericType) else None


def _carried_over_times(times: DataFrame, rights: DataFrame, direction: str) -> DataFrame:
    """Rows (o, r) of different times: carried inside buckets of time; what reaches a bucket is the last of a bucket before it."""
    both, order = _sides(times, rights, direction)
    both = bucketed(both.withColumn("_place", _place(both)), "_place")
    at, pick = F.when(~F.col("is_left"), F.col("o")), F.max_by if direction == "backward" else F.min_by
    along = Window.orderBy("_bucket" if direction == "backward" else F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    lasts = both.groupBy("_bucket").agg(pick("r", at).alias("_top")).select("_bucket", F.last("_top", True).over(along).alias("_before"))
    inside = Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # a row for each bucket
    return both.join(F.broadcast(lasts), "_bucket").withColumn("r", F.coalesce(F.last("r", True).over(inside), "_before")).where("is_left").select("o", "r")


def micros_of(offset: str) -> int | None:
    """Microseconds of an offset of fixed length ('7D', '90min'), None for calendar ones ('MS', 'W', 'B'); others raise."""
    try:
        step = pd.tseries.frequencies.to_offset(offset)
    except ValueError as e:
        raise ValueError(f"not a duration or calendar offset: {offset}") from e
    try:
        return pd.Timedelta(step) // pd.Timedelta(microseconds=1)
    except (ValueError, TypeError):
        return step.n * DAY if type(step).__name__ == "Day" else None


def moved(c: Column, offset: str) -> Column:
    """An instant moved on by an offset, at the same time of day.

    Calendar offsets go to the next place of their kind: month, quarter and year starts and ends (MS,
    ME, QS, QE, YS, YE), the next such weekday (W, W-MON), the next weekday that isn't Saturday or
    Sunday (B); a number before them goes on as often.
    """
    micros, c = micros_of(offset), c.cast("timestamp")
    if micros is not None:
        return F.timestamp_micros(F.unix_micros(c) + F.lit(micros))
    step = pd.tseries.frequencies.to_offset(offset)
    n, unit = step.n, step.rule_code.split("-")[0]
    day = F.to_date(c)
    if unit in ("MS", "ME", "QS", "QE", "YS", "YE"):
        if unit[0] != "M" and step.rule_code not in (unit, "QS-JAN", "QE-DEC", "YS-JAN", "YE-DEC"):
            raise ValueError(f"only calendar quarters and years are known: {offset}")
        span, width = {"M": ("month", 1), "Q": ("quarter", 3), "Y": ("year", 12)}[unit[0]]
        start = F.to_date(F.date_trunc(span, c))
        if unit[1] == "S":
            to = F.add_months(start, n * width)
        else:
            end = F.last_day(F.add_months(start, width - 1))
            to = F.last_day(F.add_months(start, F.when(day == end, n * width).otherwise((n - 1) * width) + (width - 1)))
    elif unit == "W":
        to = F.date_add(F.next_day(day, (step.rule_code.split("-") + ["SUN"])[1]), 7 * (n - 1))
    elif unit == "B":
        late = F.greatest(F.weekday(day) - 4, F.lit(0))  # a Saturday or Sunday counts as Friday
        to = F.date_add(day, (n + 2 * F.floor((F.weekday(day) - late + n) / 5) - late).cast("int"))
    else:
        raise ValueError(f"can't move by {offset}")
    return F.timestamp_micros(F.unix_micros(to.cast("timestamp")) + F.unix_micros(c) - F.unix_micros(day.cast("timestamp")))


@dataclass
class BacktestResult:
    """predictions (keys, prediction_at, prediction, loss, is_warmup), no trades, a pnl of zeros, and small dicts."""

    predictions: DataFrame
    trades: DataFrame
    pnl: DataFrame
    metrics: dict[str, float]
    meta: dict = field(default_factory=dict)


@dataclass
class BacktestGame:
    """When to predict, from what, and what for. window_overlap is accepted and has no influence.

    loss(y, prediction): a Column of two, half the squared error if none is given. An order column of
    text is read as instants.
    """

    frame: SeriesFrame
    window_length: int | str = 1
    cadence: int | str = 1
    horizon: int | str = 1
    target: str | None = None
    align: str = "front"
    warmup_periods: int = 0
    window_overlap: bool = True
    loss: Callable[[Column, Column], Column] | None = None

    def __post_init__(self):
        if self.align not in ("front", "back"):
            raise ValueError("align must be front or back")
        frame = self.frame
        if isinstance(frame.df.schema[frame.order].dataType, T.StringType):
            df = frame.df.withColumn(frame.order, F.to_timestamp(f"`{frame.order}`"))
            self.frame = SeriesFrame(df, frame.order, frame.values, frame.keys)

    @property
    def keys(self) -> list[str]:
        return self.frame.keys

    def placed(self) -> DataFrame:
        """The frame's rows with _rn (from 1) and _n."""
        w = self.frame.window
        return self.frame.df.withColumns({"_rn": F.row_number().over(w), "_n": F.count(F.lit(1)).over(Window.partitionBy(*self.keys))})

    def _least(self) -> int:
        return self.window_length if isinstance(self.window_length, int) else 1

    def _duration(self) -> int:
        micros = micros_of(self.window_length)
        if micros is None:
            raise ValueError(f"a window needs a fixed length: {self.window_length}")
        return micros

    def steps(self) -> DataFrame:
        """Rows at which a step ends: all columns, with step_no (from 1) and is_warmup.

        Integer cadence: every cadence-th row from the front or back. Duration or calendar offset: from a
        step, the first row at or after the step plus (or minus) the cadence. Steps need a full window
        of rows.
        """
        w = self.frame.window
        if isinstance(self.cadence, int):
            c = max(1, self.cadence)
            walk = (F.col("_rn") - 1) % c if self.align == "front" else (F.col("_n") - F.col("_rn")) % c
            chosen = self.placed().where((walk == 0) & (F.col("_rn") >= self._least()))
        else:
            chosen = self._walk().where(F.col("_rn") >= self._least())
        out = chosen.withColumn("step_no", F.row_number().over(w))
        return out.withColumn("is_warmup", F.col("step_no") <= self.warmup_periods).drop("_n").withColumnRenamed("_rn", "position")

    def _walk(self) -> DataFrame:
        """Rows on a walk by duration. The next step depends on the last, so each series is walked in one task over its sorted times."""
        micros = micros_of(str(self.cadence))
        calendar = pd.tseries.frequencies.to_offset(self.cadence) if micros is None else None
        keys, front, cadence = self.keys, self.align == "front", self.cadence
        times = self.placed().withColumn("_p", self.frame.position().cast("long"))

        def go(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_p", kind="stable")
            p = pdf["_p"].to_numpy()
            at, taken = (0 if front else len(p) - 1), []
            while True:
                taken.append(at)
                if calendar is None:
                    goal = p[at] + (micros if front else -micros)
                else:
                    here = pd.Timestamp(int(p[at]), unit="us")
                    goal = (here + calendar if front else here - calendar).value // 1000
                if goal > p[-1] or goal < p[0]:
                    break
                new = int(np.searchsorted(p, goal, side="left"))
                if new == at:
                    raise ValueError(f"a walk by {cadence} stays at a row: the gap before it is longer")
                at = new
            return pdf.iloc[sorted(set(taken))][[*keys, "_rn"]]

        types = dict(times.dtypes)
        marks = times.select(*keys, "_rn", "_p").groupBy(*keys).applyInPandas(go, "".join(f"`{k}` {types[k]}, " for k in keys) + "_rn int")
        return self.placed().join(marks.distinct(), [*keys, "_rn"])

    def windows(self, columns: list[str] | None = None) -> DataFrame:
        """Steps with `window`: an array of the rows (structs of columns) that end at the step, clipped at the start."""
        columns = columns or [self.frame.order, *self.frame.values]
        item = F.struct(*[F.col(f"`{c}`") for c in columns])
        if isinstance(self.window_length, int):
            w = self.frame.window.rowsBetween(1 - self.window_length, 0)
        else:
            w = Window.partitionBy(*self.keys).orderBy(self.frame.position().cast("long")).rangeBetween(-self._duration(), 0)
        held = self.frame.df.withColumn("window", F.collect_list(item).over(w)).select(*self.keys, self.frame.order, "window")
        return self.steps().join(held, [*self.keys, self.frame.order])

    def targets(self) -> DataFrame:
        """Steps with prediction_at (step + horizon, not snapped to rows) and y: the target of the first row at or after it."""
        order, steps = self.frame.order, self.steps()
        if isinstance(self.horizon, int):
            w = self.frame.window
            ahead = self.frame.df.select(*self.keys, order, F.lead(order, self.horizon).over(w).alias("prediction_at"), (F.lead(self.target, self.horizon).over(w) if self.target else F.lit(None).cast("double")).alias("y"))
            return steps.join(ahead, [*self.keys, order])
        goal = moved(F.col(order), self.horizon).cast(self.frame.df.schema[order].dataType)
        steps = steps.withColumn("prediction_at", goal)
        if not self.target:
            return steps.withColumn("y", F.lit(None).cast("double"))
        right = self.frame.df.select(*self.keys, F.col(order).alias("_at"), F.col(self.target).alias("y"))
        return as_of(steps, right, "prediction_at", "_at", ["y"], "forward", self.keys).drop("matched_at")


class Backtester:
    """Runs strategies over a game."""

    def __init__(self, game: BacktestGame, price: str | None = None):
        self.game, self.price = game, price

    def run(self, strategy: Column | Learner | Callable, features: str | None = None, end=None) -> BacktestResult:
        """strategy: a Column over the frame (with windows of its own, looking back only), or a learner over an array column.

        The loss is the game's, 0 where there is no target; a missing target value gives a missing
        loss. Steps stop after the first whose prediction_at reaches `end`.
        """
        game, keys, order = self.game, self.game.keys, self.game.frame.order
        steps = game.targets()
        if isinstance(strategy, Column):
            made = game.frame.df.select(*keys, order, strategy.cast("double").alias("prediction"))
            steps = steps.drop("prediction").join(made, [*keys, order])
        else:
            steps = self._learn(steps, strategy, features)
        if end is not None:
            stop = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
            reached = F.max((F.col("prediction_at") >= F.lit(end)).cast("int")).over(stop)
            steps = steps.withColumn("_stop", F.coalesce(reached, F.lit(0))).where("_stop = 0").drop("_stop")
        y, made = F.col("y").cast("double"), F.col("prediction")
        cost = 0.5 * (y - made) * (y - made) if game.loss is None else game.loss(y, made)
        no_target = F.lit(0.0) if not game.target else F.when(F.col("prediction_at").isNull() | F.col("y").isNull(), 0.0)
        steps = steps.withColumn("loss", F.coalesce(cost, no_target))
        out = steps.select(*keys, order, "step_no", "is_warmup", "prediction_at", "prediction", "y", "loss")
        row = out.agg(F.avg("loss").alias("m"), F.count(F.lit(1)).alias("n")).first()
        spark = out.sparkSession
        trades = spark.createDataFrame([], "timestamp timestamp, side string, size double, price double")
        return BacktestResult(out, trades, out.select(*keys, "prediction_at", F.lit(0.0).alias("pnl")), {"mean_loss": row["m"] or 0.0}, {"n_steps": row["n"], "price_col": self.price})

    def _learn(self, steps: DataFrame, learner: Learner, features: str | None) -> DataFrame:
        keys, order = self.game.keys, self.game.frame.order
        types = dict(steps.dtypes)

        def go(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(order, kind="stable")
            own, out = learner.fresh(), []
            for i in range(len(pdf)):
                x = np.asarray(pdf[features].iloc[i], float) if features else np.ones(1)
                p, y = own.predict(x), pdf["y"].iloc[i]
                out.append(float(np.mean(p)))
                if y is not None and y == y:
                    own.learn(x, p, 0.5 * (float(y) - p) ** 2, float(y))
            return pdf[[*keys, order]].assign(prediction=out)

        rows = steps.select(*keys, order, F.col("y").cast("double").alias("y"), *([features] if features else []))
        schema = "".join(f"`{k}` {types[k]}, " for k in keys) + f"`{order}` {types[order]}, prediction double"
        return steps.join(rows.groupBy(*keys).applyInPandas(go, schema), [*keys, order])


class BacktestSession(Game):
    """One series of a game, played step by step on the driver: a row for each step is held there.

    A learner sees the current window as a pandas frame (its window_length rows). loss(y, prediction)
    of numbers; half the squared error if none is given, 0 without a target or beyond its end.
    """

    def __init__(self, game: BacktestGame, loss: Callable[[float, float], float] | None = None):
        super().__init__()
        if game.keys:
            raise ValueError("a session plays one series: filter the frame to it and leave out the keys")
        self.game, self.loss, self.at, self.prediction_at = game, loss, 0, None
        order = game.frame.order
        rows = game.targets().select(F.col(f"`{order}`").alias("step"), "position", "is_warmup", "prediction_at", F.col("y").cast("double").alias("y"))
        self._steps = sorted(rows.collect(), key=lambda r: r["position"])

    def available_steps(self) -> int:
        return len(self._steps)

    def remaining_steps(self) -> int:
        return len(self._steps) - self.at

    def step_date(self, i: int):
        """The i-th step's place on the axis (from 0), None where there is none."""
        return self._steps[i]["step"] if 0 <= i < len(self._steps) else None

    @property
    def current_date(self):
        return self.step_date(self.at)

    def step_numbers(self):
        for self.at in range(len(self._steps)):
            yield self.at

    def advance(self) -> bool:
        """Goes to the next step; whether there is one."""
        self.at = min(self.at + 1, len(self._steps))
        return self.at < len(self._steps)

    def reset(self) -> None:
        super().reset()
        self.at, self.prediction_at = 0, None

    def window(self, at) -> DataFrame:
        """The rows that end at a position (an int, from 1) or at the last row not after an instant; none before the first row."""
        order, rows = self.game.frame.order, self.game.placed()
        if not isinstance(at, int):
            at = rows.where(F.col(f"`{order}`") <= F.lit(at)).agg(F.max("_rn")).first()[0] or 0
        if isinstance(self.game.window_length, int):
            held = rows.where(F.col("_rn").between(at - self.game.window_length + 1, at))
        else:
            end = rows.where(F.col("_rn") == at).select(self.game.frame.position().cast("long")).first()
            place = self.game.frame.position().cast("long")
            held = rows.where(F.col("_rn") <= at).where(place >= end[0] - self.game._duration()) if end else rows.where(F.lit(False))
        return held.drop("_rn", "_n").orderBy(order)

    def state(self) -> pd.DataFrame:
        if self.at >= len(self._steps):
            raise StopIteration("no more steps")
        return self.window(int(self._steps[self.at]["position"])).toPandas()

    def truth(self) -> float | None:
        return self._steps[self.at]["y"] if self.game.target and self.at < len(self._steps) else None

    def cost(self, prediction, state=None) -> float:
        y = self.truth()
        if y is None:
            return 0.0
        return 0.5 * (y - prediction) ** 2 if self.loss is None else self.loss(y, prediction)

    def step(self, learner: Learner):
        out = super().step(learner)
        self.prediction_at = self._steps[self.at]["prediction_at"]
        return out
