"""Tile plans of image pyramids: pure arithmetic, one row per tile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = 512


def ceil_div(a: Column, b: Column) -> Column:
    return F.floor((a + b - 1) / b).cast("long")


def scale_factors(w: Column, h: Column, tile: int = TILE) -> Column:
    """1, 2, 4, ... up to the first at which the whole image fits one tile."""
    exps = F.sequence(F.lit(0), F.lit(30))
    powers = F.transform(exps, lambda e: F.call_function("shiftleft", F.lit(1).cast("long"), e))
    longest = F.greatest(w, h)
    return F.filter(powers, lambda s: (s == 1) | (ceil_div(longest, F.floor(s / 2).cast("long")) > tile))


def tile_plan(images: DataFrame, w: str = "w", h: str = "h", tile: int = TILE) -> DataFrame:
    """Rows of ``images`` by scale factor and tile: ``scale, x, y, rw, rh, sw, sh`` (region and output size)."""
    by = images.withColumn("scale", F.explode(scale_factors(F.col(w), F.col(h), tile)))
    step = F.col("scale") * tile
    rows = by.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col(h).cast("long") - 1, step)))
    cols = rows.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col(w).cast("long") - 1, step)))
    rw, rh = F.least(step, F.col(w) - F.col("x")), F.least(step, F.col(h) - F.col("y"))
    return cols.select(
        "*", rw.alias("rw"), rh.alias("rh"),
        ceil_div(rw, F.col("scale")).alias("sw"), ceil_div(rh, F.col("scale")).alias("sh"),
    )


def tile_key(prefix: Column) -> Column:
    """File of a row of :func:`tile_plan`."""
    return F.format_string("%s/%d,%d,%d,%d/%d,%d/0/default.jpg", prefix, "x", "y", "rw", "rh", "sw", "sh")


def size_key(prefix: Column, w: Column, h: Column, scale: Column) -> Column:
    return F.format_string("%s/full/%d,%d/0/default.jpg", prefix, ceil_div(w, scale), ceil_div(h, scale))


def info_json(base: Column, w: Column, h: Column, tile: int = TILE) -> Column:
    """The level-0 image description that is stored beside the tiles."""
    factors = scale_factors(w, h, tile)
    sizes = F.transform(factors, lambda s: F.struct(ceil_div(w, s).alias("width"), ceil_div(h, s).alias("height")))
    return F.to_json(F.struct(
        F.lit("http://iiif.io/api/image/3/context.json").alias("@context"), base.alias("id"),
        F.lit("ImageService3").alias("type"), F.lit("http://iiif.io/api/image").alias("protocol"),
        F.lit("level0").alias("profile"), w.cast("long").alias("width"), h.cast("long").alias("height"),
        sizes.alias("sizes"),
        F.array(F.struct(F.lit(tile).alias("width"), factors.alias("scaleFactors"))).alias("tiles"),
    ))
