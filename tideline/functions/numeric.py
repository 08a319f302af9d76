"""Column builders for samples: missing values, guarded division, numeric columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def number(c: Column | str) -> Column:
    """As double, with NaN as NULL: aggregates then skip it."""
    c = (F.col(f"`{c}`") if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(c), c)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.when(b != 0, a / b)


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns from the schema alone."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def sample(df: DataFrame, value: str | Column, weight: str | Column | None = None, keys: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """keys, x, w of the rows with a value; without a weight column each weighs 1. A missing weight drops the row."""
    w = F.lit(1.0) if weight is None else number(weight)
    out = df.select(*[F.col(f"`{k}`") for k in keys], number(value).alias("x"), w.alias("w"))
    return out.where("x IS NOT NULL AND w IS NOT NULL")


def collect_value(df: DataFrame):
    """The single value of a one-row result, or None."""
    row = df.first()
    return None if row is None else row["value"]
