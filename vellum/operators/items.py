"""Library items without a presentation document: one is derived from the item's files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ordinal_name, or_else
from ..functions.dates import trimmed

DEFAULT_TITLE = "Library of Congress item"


def page_images(files: DataFrame, item: str) -> DataFrame:
    """``files(item, grp, pos, url, info, mimetype, width, height)`` -> one row per group with a JPEG.

    The largest JPEG by area is shown; separately the largest file with an image
    description gives service and size.  The first of equals wins, files without area
    never do.  Pages are numbered from 1 over the groups that stay.
    """
    area = F.coalesce(F.col("width").cast("long") * F.col("height"), F.lit(0))
    ranked = files.withColumn("a", F.when((F.col("width") > 0) & (F.col("height") > 0), area)).withColumn("rank", F.struct("a", (-F.col("pos")).alias("p")))
    jpeg = (F.col("mimetype") == "image/jpeg") & F.col("a").isNotNull()
    info = (F.coalesce("info", F.lit("")) != "") & F.col("a").isNotNull()
    best = ranked.groupBy(item, "grp").agg(
        F.max_by(F.struct("url", "width", "height"), F.when(jpeg, F.col("rank"))).alias("j"),
        F.max_by(F.struct("info", "width", "height"), F.when(info, F.col("rank"))).alias("i"),
    ).filter("j is not null")
    page = F.row_number().over(Window.partitionBy(item).orderBy("grp"))
    return best.select(
        item, page.alias("page"), F.col("j.url").alias("url"), F.regexp_replace("i.info", r"/info\.json\z", "").alias("service"),
        F.coalesce("i.width", "j.width").alias("width"), F.coalesce("i.height", "j.height").alias("height"),
    )


def text_values(raw: Column) -> Column:
    """A non-blank JSON string untrimmed, or the trimmed non-blank strings of a list; else none."""
    listed = F.startswith(F.ltrim(raw), F.lit("["))
    many = F.filter(F.transform(F.from_json(F.when(listed, raw), "array<string>"), trimmed), lambda v: v != "")
    empty = F.array().cast("array<string>")
    return F.when(listed, F.coalesce(many, empty)).when(trimmed(raw) != "", F.array(raw)).otherwise(empty)


def derived_manifests(items: DataFrame, pages: DataFrame, item: str, url: str) -> DataFrame:
    """``(item, manifest, error)``: a presentation document per item; items without pages are errors."""
    canvas = F.concat(F.col(url), F.lit("#canvas-"), F.lpad(F.col("page").cast("string"), 4, "0"))
    one = F.struct(
        canvas.alias("@id"), F.lit("sc:Canvas").alias("@type"), F.concat(F.lit("Page "), "page").alias("label"), "width", "height",
        F.array(F.struct(F.struct(F.col("url_").alias("@id"), "width", "height", F.when(F.col("service").isNotNull(), F.struct(F.col("service").alias("@id"))).alias("service")).alias("resource"))).alias("images"),
    )
    joined = pages.withColumnRenamed("url", "url_").join(items.select(item, url), item)
    canvases = joined.groupBy(item).agg(F.transform(F.sort_array(F.collect_list(F.struct("page", one.alias("c")))), lambda x: x["c"]).alias("canvases"))
    made = items.join(canvases, item, "left")
    fields = F.array_compact(F.array(*[
        F.when(F.size(F.col(c)) > 0, F.struct(F.lit(label).alias("label"), F.array_join(c, "; ").alias("value"))) for label, c in (("Date", "dates"), ("Language", "languages"), ("Rights", "rights"))
    ]))
    doc = F.to_json(F.struct(
        F.lit("sc:Manifest").alias("@type"), F.col(url).alias("@id"), or_else(F.col("title"), F.lit(DEFAULT_TITLE)).alias("label"),
        fields.alias("metadata"), F.array(F.struct("canvases")).alias("sequences"),
    ))
    has = F.col("canvases").isNotNull()
    return made.select(item, F.when(has, doc).alias("manifest"), F.when(~has, "no pages").alias("error"))


def capped(rows: DataFrame, by: str, order: list[str], value: str, kind: str, most: int, width: int = 4) -> DataFrame:
    """Per key what numbering its rows in order gives: ``(by, last_name, distinct_in_order, taster, capped, overflow)``.

    The zero-padded name of the last row, its kinds once each in order of appearance, the first
    value, how many of the first ``most`` rows there are, and whether there are more.  A key is one document.
    """
    numbered = rows.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    each = numbered.groupBy(by).agg(F.max("rn").alias("n"), F.min_by(value, "rn").alias("taster"), F.sort_array(F.collect_list(F.struct("rn", F.col(kind).alias("k")))).alias("vs"))
    return each.select(
        by, ordinal_name(F.col("n"), width).alias("last_name"), F.array_distinct(F.transform("vs", lambda x: x["k"])).alias("distinct_in_order"), "taster",
        F.least("n", F.lit(most)).cast("long").alias("capped"), (F.col("n") > most).alias("overflow"),
    )
