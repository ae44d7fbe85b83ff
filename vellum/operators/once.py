"""Evaluate an expression once a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Append ``value``.  The one-element generator keeps the optimizer from copying the
    expression into each use of the column (or into each step of a lambda)."""
    return df.select("*", F.explode(F.array(value)).alias(name))
