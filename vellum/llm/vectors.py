"""Vectors as integers: what the operators on embeddings share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest size of an integer component; beyond it sums of squares might leave 64 bits.
LARGEST = 1 << 26


def finite(vector: Column) -> Column:
    """Whether a vector is there, has components, and each is a number."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce(number(x.cast("double")), F.lit(False))), F.lit(False))


def integers(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of each component, as ``array<int>``.  Components beyond ``LARGEST`` are an error, as overflows are."""

    def one(x: Column) -> Column:
        v = F.floor(x.cast("double") * scale)
        return F.when(F.abs(x.cast("double") * scale) < LARGEST, v.cast("int")).otherwise(
            F.raise_error(F.lit(f"a component times {scale} is beyond {LARGEST}")).cast("int")
        )

    return F.transform(vector, one)


def of_one_width(df: DataFrame, vector: str, order: list[Column], multiple: int = 1) -> tuple[DataFrame, int]:
    """Rows whose vector is as wide as that of the first row by ``order`` of a width divisible by ``multiple``; that width (0: no rows)."""
    fits = df.filter(F.size(vector) % multiple == 0)
    first = fits.orderBy(*order).select(F.size(vector).alias("w")).first()
    width = first.w if first else 0
    return fits.filter(F.size(vector) == width), width


def matrix(column, width: int) -> np.ndarray:
    """A list column of an Arrow batch as a matrix with a row each."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
