"""Expert weights in closed form, as windows: no ordered Python loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _softmax(rows: DataFrame, score: str, keys: list[str], t: str) -> DataFrame:
    """Adds weight: exp(score) over its sum among the experts of one step, by the largest score."""
    step = Window.partitionBy(*keys, t)
    shifted = F.exp(F.col(score) - F.max(score).over(step))
    rows = rows.withColumn("_e", shifted)
    return rows.withColumn("weight", F.col("_e") / F.sum("_e").over(step)).drop("_e")


def hedge(losses: DataFrame, rate: float = 1.0, prior: Column | None = None, keys: list[str] | tuple[str, ...] = (), t: str = "t", expert: str = "expert", loss: str = "loss") -> DataFrame:
    """Rows (keys, t, expert, loss) with `weight` after the step's loss.

    weight is prior * exp(-rate * cumulated loss) over its sum: a running sum for each expert and a
    softmax for each step. prior: a Column of the expert's weight before the first step (equal if
    none).
    """
    keys = list(keys)
    upto = Window.partitionBy(*keys, expert).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    score = -rate * F.sum(loss).over(upto) + (F.ln(prior) if prior is not None else F.lit(0.0))
    return _softmax(losses.withColumn("_s", score), "_s", keys, t).drop("_s")


def hedge_regret(weighted: DataFrame, keys: list[str] | tuple[str, ...] = (), t: str = "t", loss: str = "loss", mixture: bool = False) -> DataFrame:
    """Rows (keys, t, cost, regret): cost is sum(weight * loss), or -ln sum(weight * exp(-loss)) for the aggregating algorithm.

    The latter is infinite where that sum is 0 in doubles (losses over some 745); Spark's ln has NULL there.
    """
    keys = list(keys)
    mixed = F.sum(F.col("weight") * F.exp(-F.col(loss)))
    cost = F.when(mixed == 0, float("inf")).otherwise(-F.ln(mixed)) if mixture else F.sum(F.col("weight") * F.col(loss))
    steps = weighted.groupBy(*keys, t).agg(cost.alias("cost"))
    return steps.withColumn("regret", F.sum("cost").over(Window.partitionBy(*keys).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)))


def time_hedge(losses: DataFrame, features: list[Column], rate: float = 1.0, keys: list[str] | tuple[str, ...] = (), t: str = "t", expert: str = "expert", loss: str = "loss") -> DataFrame:
    """Weights softmax(-theta f(t)) after the step, theta = rate * sum of loss * f over steps so far; features: Columns of t."""
    keys = list(keys)
    upto = Window.partitionBy(*keys, expert).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    score = -sum((rate * F.sum(F.col(loss) * f).over(upto) * f for f in features), F.lit(0.0))
    return _softmax(losses.withColumn("_s", score), "_s", keys, t).drop("_s")
