"""Losses of a prediction as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_loss(y: Column, p: Column) -> Column:
    return 0.5 * (y - p) * (y - p)


def absolute_loss(y: Column, p: Column) -> Column:
    return F.abs(y - p)


def logistic_loss(y: Column, p: Column) -> Column:
    """ln(1 + exp(-y p)), without overflow."""
    z = -y * p
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
