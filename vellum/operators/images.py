"""Images, canvases and licences of presentation documents (both shapes)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import or_else
from ..functions.urls import service_id
from .once import once

_RESOURCE = "struct<`@id`:string,id:string,width:bigint,height:bigint,service:string>"
SHAPE = (
    "sequences array<struct<canvases:array<struct<`@id`:string,id:string,`@type`:string,label:string,"
    f"images:array<struct<resource:{_RESOURCE}>>>>>>, "
    "items array<struct<`@id`:string,id:string,type:string,`@type`:string,"
    f"items:array<struct<items:array<struct<body:{_RESOURCE}>>>>>>"
)


def own_id(node: Column) -> Column:
    """``id`` before ``@id``."""
    return F.coalesce(or_else(node["id"], node["@id"]), F.lit(""))


def _first_service(resource: Column) -> Column:
    """The service object, or the first of a list; to be bound, as it is looked at several times."""
    raw = resource["service"]
    # an object is read as a list of one
    return F.get(F.from_json(F.when(_listed(raw), raw).otherwise(F.concat(F.lit("["), raw, F.lit("]"))), "array<struct<`@id`:string,id:string>>"), F.lit(0))


def _listed(raw: Column) -> Column:
    return F.coalesce(F.startswith(F.ltrim(raw), F.lit("[")), F.lit(False))


def _service(resource: Column, first: Column) -> Column:
    """Of a service object its id; of a list the first element's, even if empty; else from the image's own id."""
    found = F.when(first.isNotNull(), own_id(first))
    return F.coalesce(F.when(_listed(resource["service"]), found).otherwise(F.nullif(found, F.lit(""))), service_id(own_id(resource)))


def parsed(manifests: DataFrame, column: str = "manifest") -> DataFrame:
    """``manifests`` with the document as struct ``m``; null where it isn't JSON."""
    return once(manifests, "m", F.from_json(column, SHAPE))


def with_images(manifests: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` and ``images``: those of each document in order, as an array; null where it isn't JSON.

    The older shape wins if it has any image.
    """
    m = parsed(manifests)
    old = F.flatten(F.transform("m.sequences", lambda s: F.flatten(F.transform(
        F.coalesce(s["canvases"], F.array()), lambda c: F.transform(
            F.coalesce(c["images"], F.array()), lambda i: F.struct(
                own_id(c).alias("canvas_id"), i["resource"].alias("r"), c["label"].alias("label")))))))
    new = F.flatten(F.transform("m.items", lambda c: F.flatten(F.transform(
        F.coalesce(c["items"], F.array()), lambda p: F.transform(
            F.coalesce(p["items"], F.array()), lambda a: F.struct(
                own_id(c).alias("canvas_id"), a["body"].alias("r"), F.lit(None).cast("string").alias("label")))))))
    both = once(once(m, "old", old), "new", new)
    return both.select(*columns, F.when(F.size("old") > 0, F.col("old")).otherwise(F.col("new")).alias("images"))


def enumerate_images(manifests: DataFrame, key: str) -> DataFrame:
    """``(key, ord, canvas_id, service_id, width, height, label)``; ``label`` is raw JSON text.

    Rows are in document order; ``ord`` counts from 1 within the document.
    """
    rows = once(with_images(manifests, [key]).select(key, F.posexplode("images").alias("pos", "i")), "first", _first_service(F.col("i.r")))
    return rows.select(
        key, (F.col("pos") + 1).alias("ord"), "i.canvas_id", _service(F.col("i.r"), F.col("first")).alias("service_id"),
        F.coalesce("i.r.width", F.lit(0)).cast("int").alias("width"), F.coalesce("i.r.height", F.lit(0)).cast("int").alias("height"),
        F.col("i.label").alias("label"),
    )


def canvas_ids(manifests: DataFrame, key: str) -> DataFrame:
    """``(key, canvases)``: distinct canvas ids in document order, older shape first."""
    m = parsed(manifests)
    old = F.flatten(F.transform("m.sequences", lambda s: F.transform(F.coalesce(s["canvases"], F.array()), own_id)))
    kind = lambda c: F.coalesce(c["type"], c["@type"], F.lit(""))
    new = F.transform(F.filter("m.items", lambda c: kind(c).isin("Canvas", "sc:Canvas")), own_id)
    empty = F.array().cast("array<string>")
    both = F.concat(F.coalesce(old, empty), F.coalesce(new, empty))
    return m.select(key, F.array_distinct(F.filter(both, lambda x: x != "")).alias("canvases"))


def with_stored_size(images: DataFrame, sizes: DataFrame, key: str, w: str = "width", h: str = "height") -> DataFrame:
    """``images`` with width and height of the stored description where it is known (``sizes(key, w, h)``; 0 is unknown), else as declared."""
    stored = sizes.select(key, F.struct(F.nullif(F.col(w), F.lit(0)).alias("w"), F.nullif(F.col(h), F.lit(0)).alias("h")).alias("stored"))
    size = {w: F.coalesce("stored.w", w), h: F.coalesce("stored.h", h)}
    return images.join(stored, key, "left").select(*[size[c].alias(c) if c in size else F.col(c) for c in images.columns])


def first_string(*raw: Column) -> Column:
    """Of raw JSON values in order: the first non-empty string, or first string of a list; '' if none."""
    def one(v: Column) -> Column:
        text = F.when(F.startswith(F.ltrim(v), F.lit('"')), F.get(F.from_json(F.concat(F.lit("["), v, F.lit("]")), "array<string>"), F.lit(0)))
        listed = F.when(F.startswith(F.ltrim(v), F.lit("[")), F.from_json(v, "array<string>"))
        return F.nullif(F.coalesce(text, F.get(listed, F.lit(0))), F.lit(""))

    return F.coalesce(*[one(v) for v in raw], F.lit(""))
