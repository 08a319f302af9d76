"""Sources and sinks: Parquet tables, pandas and numpy data in memory, JSON and HTML out."""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.numeric import number, numeric_columns


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_pandas(spark: SparkSession, pdf: pd.DataFrame, order: str = "index") -> DataFrame:
    """A pandas frame with its index as the column `order`; NaN becomes NULL; periods and intervals become start times and structs."""
    if not isinstance(pdf, pd.DataFrame):
        raise ValueError("a pandas DataFrame is needed")
    out = pdf.copy()
    index = out.index
    if isinstance(index, pd.PeriodIndex):
        index = index.to_timestamp()
    if isinstance(index, pd.IntervalIndex):
        index = [{"left": x.left, "right": x.right} for x in index]
    elif isinstance(index, pd.MultiIndex):
        index = [str(x) for x in index]
    elif isinstance(index, pd.CategoricalIndex):
        index = index.astype(str)
    out.insert(0, order, index)
    df = spark.createDataFrame(out.reset_index(drop=True))
    return df.withColumns({c: number(c) for c, kind in df.dtypes if kind in ("double", "float")})


def from_arrays(spark: SparkSession, x: np.ndarray, y: np.ndarray | None = None) -> DataFrame:
    """seq, features (array) and y of a matrix and a vector of one length."""
    x = np.asarray(x, float)
    x = x[:, None] if x.ndim == 1 else x
    if y is not None and len(y) != len(x):
        raise ValueError("x and y have different lengths")
    pdf = pd.DataFrame({"seq": np.arange(len(x)), "features": x.tolist()} | ({"y": np.asarray(y, float)} if y is not None else {}))
    return spark.createDataFrame(pdf)


def as_features(df: DataFrame, columns: list[str] | None = None, name: str = "features") -> DataFrame:
    """Adds an array column of numeric columns."""
    return df.withColumn(name, F.array(*[number(c) for c in (columns or numeric_columns(df))]))


def write_json(df: DataFrame, path: str) -> None:
    """A folder of JSON lines, written by the executors."""
    df.write.mode("overwrite").json(path)


def write_results(rows: list[dict], path: str) -> None:
    """A small list of results as one JSON file."""
    Path(path).write_text(json.dumps(rows, indent=1, default=str), encoding="utf-8")
