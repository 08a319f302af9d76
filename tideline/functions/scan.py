"""Ordered running sums over a whole table without a one-task window.

A window without partition keys runs in one task. Here values are cut at approximate quantiles into
buckets, each bucket is summed (as many rows as buckets), and the totals of the buckets before are
added to running sums inside each bucket. Equal values share a bucket; a value that makes up several
quantiles has one of its own.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 128


def cuts_of(df: DataFrame, columns: list[str], buckets: int = BUCKETS) -> dict[str, list[float]]:
    """Approximate quantiles of numeric columns, of all in one aggregate. Around a value that is several quantiles there are two cuts."""
    shares = [i / buckets for i in range(1, buckets)]
    row = df.agg(*[F.percentile_approx(F.col(f"`{c}`"), shares, 10_000) for c in columns]).first()
    out = {}
    for c, q in zip(columns, row, strict=True):
        found = Counter(float(x) for x in q or [])
        out[c] = sorted({*found, *(math.nextafter(x, -math.inf) for x, n in found.items() if n > 1)})
    return out


def bucket_of(column: str, cuts: list[float]) -> Column:
    """The number of cuts below the column's value, by a binary search of comparisons that is compiled with its stage."""

    def search(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return f"CASE WHEN `{column}` > double('{cuts[mid]!r}') THEN {search(mid + 1, hi)} ELSE {search(lo, mid)} END"

    return F.expr(search(0, len(cuts)))


def single_valued(cuts: list[float]) -> list[int]:
    """Buckets that can hold one value only."""
    return [i for i in range(1, len(cuts)) if math.nextafter(cuts[i], -math.inf) == cuts[i - 1]]


def bucketed(df: DataFrame, order: str, buckets: int = BUCKETS) -> DataFrame:
    """Adds _bucket: the number of approximate quantiles below the value of `order` (numeric, not null)."""
    return df.withColumn("_bucket", bucket_of(order, cuts_of(df, [order], buckets)[order]))


def running(df: DataFrame, order: list[str], sums: dict[str, str], keys: list[str] | tuple[str, ...] = (), buckets: int = BUCKETS, bucket: str | None = None) -> DataFrame:
    """Adds rn (1-based), n, and for each name of `sums` the running and total sum of its column: name, name_total.

    Rows are ordered by `order` inside keys; the first order column must be numeric when there are no keys.
    bucket: a column that numbers buckets of the first order column; without it, rows are put into
    buckets where there are no keys, and each key is one window where there are.
    """
    keys = list(keys)
    if keys and bucket is None:
        over = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy(*keys)
        out = {"rn": F.row_number().over(Window.partitionBy(*keys).orderBy(*order)), "n": F.count(F.lit(1)).over(whole)}
        for name, c in sums.items():
            out |= {name: F.sum(c).over(over), f"{name}_total": F.sum(c).over(whole)}
        return df.withColumns(out)
    if own := bucket is None:
        df, bucket = bucketed(df, order[0], buckets), "_bucket"
    group = [*keys, bucket]
    totals = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_{s}") for s, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    made = {"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "n": F.sum("_n").over(whole)}
    for s in sums:
        made |= {f"_{s}_before": F.coalesce(F.sum(f"_{s}").over(before), F.lit(0.0)), f"{s}_total": F.sum(f"_{s}").over(whole)}
    totals = totals.withColumns(made).drop("_n", *[f"_{s}" for s in sums])
    inside = Window.partitionBy(*group).orderBy(*order)
    rows = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(F.broadcast(totals), group)  # one row for each bucket of each key
    made = {"rn": (F.row_number().over(inside) + F.col("_before")).cast("long")}
    for s, c in sums.items():
        made[s] = F.sum(c).over(rows) + F.col(f"_{s}_before")
    return out.withColumns(made).drop("_before", *[f"_{s}_before" for s in sums], *([bucket] if own else []))
