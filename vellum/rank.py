"""Ranks over all rows, or within keys, without a task that holds them all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row in the partition below


def ranked(df: DataFrame, order: list[Column], name: str = "rn") -> DataFrame:
    """Append the 1-based rank by ``order``, which should leave no ties.

    Rows are dealt by ranges of ``order`` and sorted within; a row's rank is its place in
    its partition and the rows of the partitions before, of which there is one count each.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    part = F.shiftright("__at", _ROW_BITS)
    rows = written(dealt, "ranked").withColumn("__part", part)
    counts = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("__part", F.coalesce(before, F.lit(0)).alias("__base"))  # one row a partition
    place = F.col("__at").bitwiseAND((1 << _ROW_BITS) - 1)
    return rows.join(F.broadcast(base), "__part").select(*df.columns, (F.col("__base") + place + 1).alias(name))


#: Rows of one key from which on its ranks come from range partitions; fewer are one window.
HOT = 100_000


def ranked_by(df: DataFrame, by: list[str], order: list[Column], name: str = "rn", hot: int = HOT) -> DataFrame:
    """Append the 1-based rank within equal ``by`` (nulls are equal).

    Rows are counted by key first.  Keys of ``hot`` rows or more are spread over partitions: their ranks
    are those over all such rows, less the lowest of the key.  The others are windows of a bounded size.
    """
    marks = [F.col(c).alias(f"__by_{c}") for c in by]
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by])
    window = lambda rows: rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    large = written(df.groupBy(*by).agg(F.count("*").alias("__n")).filter(F.col("__n") >= hot).select(*marks), "hot-keys")
    if large.isEmpty():
        return window(df)
    rows = ranked(df.join(large, same, "left_semi"), [*map(F.col, by), *order], "__all")
    lowest = rows.groupBy(*by).agg(F.min("__all").alias("__low")).select(*marks, "__low")
    spread = rows.join(lowest, same).select(*df.columns, (F.col("__all") - F.col("__low") + 1).alias(name))
    return window(df.join(large, same, "left_anti")).unionByName(spread)
