"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import forget, scratch, written

#: ASCII white space: the characters between words in every contract of this subpackage.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Cut lineage: see :func:`vellum.scratch.written`.
materialize = written


def free(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores before it as it takes to clash with no column (case ignored)."""
    taken = {c.lower() for c in columns}
    made = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        made.append(name)
    return made


def kept_columns(docs: DataFrame, outputs: list[str]) -> list[str]:
    """Columns of ``docs`` but those with the name of an output (case ignored), which the output replaces."""
    taken = {c.lower() for c in outputs}
    return [c for c in docs.columns if c.lower() not in taken]


def named(columns: list[str]) -> list[Column]:
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space, in order."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def bind(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Append ``value``, evaluated once a row.

    A generator of one element is a barrier: the optimizer copies the expression neither
    into each place that uses the column nor into a filter below.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(node, component)`` with the smallest reachable node.

    Alternating large-star and small-star contraction.  Each half is a partial
    aggregate (min per node) and an equi-join, so hubs are combined map-side and
    a skewed join side can be split by AQE.  Rounds grow with the logarithm of
    the longest chain; nothing but two counters reaches the driver.  Edges with a null
    end are no edges; an edge from a node to itself makes no row.  A round's table is
    removed when the next one is written.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        both = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else down
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        far = both.filter(F.col("v") > F.col("u")) if large else both
        moved = far.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        if not large:
            moved = moved.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return moved.filter("a <> b").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(
            e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        )

    spark = edges.sparkSession
    path = scratch(spark, "cc")
    e = materialize(
        edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct(), "cc", path
    )
    seen = mark(e)
    while seen[0]:
        before, path = path, scratch(spark, "cc")
        e = materialize(star(star(e, large=True), large=False), "cc", path)
        now = mark(e)
        forget(spark, before)
        if now == seen:
            break
        seen = now
    return e.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("component"))
