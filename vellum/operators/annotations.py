"""Web annotations on canvases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import or_else

CONTEXT = "http://www.w3.org/ns/anno.jsonld"


def _plain(raw: Column) -> Column:
    """The text of a raw JSON string, else null."""
    return F.when(F.startswith(F.ltrim(raw), F.lit('"')), F.get(F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<string>"), F.lit(0)))


def canvas_id(target: Column) -> Column:
    """Canvas of a raw JSON target, without fragment: the string, or an object's ``source``
    (string, or its ``id`` before ``@id``), else its ``id``; '' for a list."""
    one = F.from_json(target, "source string, id string, `@id` string")
    source = one["source"]
    inner = F.from_json(source, "id string, `@id` string")
    # a string member arrives without its quotes, an object as JSON text
    from_source = F.when(F.startswith(source, F.lit("{")), or_else(inner["id"], inner["@id"])).otherwise(source)
    whole = F.coalesce(_plain(target), F.nullif(from_source, F.lit("")), one["id"], F.lit(""))
    return F.split_part(whole, F.lit("#"), F.lit(1))


def by_canvas(notes: DataFrame, order: str) -> DataFrame:
    """``(canvas, n, ids)`` with ids in order; notes without canvas drop out."""
    keyed = notes.withColumn("canvas", canvas_id(F.col("target"))).filter("canvas <> ''")
    made = keyed.groupBy("canvas").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(order, "id"))).alias("i"))
    return made.select("canvas", "n", F.transform("i", lambda x: x["id"]).alias("ids"))


def to_open_annotation(notes: DataFrame, keys: list[str]) -> DataFrame:
    """Older form: ``on`` is a string target with its fragment, else the canvas; a bare motivation gets ``oa:``."""
    on = or_else(_plain(F.col("target")), canvas_id(F.col("target")))
    motive = F.when(F.coalesce("motivation", F.lit("")) == "", "oa:commenting").when(F.contains("motivation", F.lit(":")), F.col("motivation")).otherwise(
        F.concat(F.lit("oa:"), "motivation"))
    return notes.select(*keys, motive.alias("motivation"), on.alias("on"), F.col("value").alias("chars"), or_else(F.col("format"), F.lit("text/plain")).alias("format"))


def of_canvas(notes: DataFrame, canvas: str) -> DataFrame:
    """Notes on one canvas; all for a blank one."""
    return notes.filter(canvas_id(F.col("target")) == canvas) if canvas else notes


def decoded(note: Column) -> Column:
    """``struct<id, type, motivation, body, target>`` of a note's JSON text; the last three as JSON text.

    The text itself is the stored form, so members that no field names stay with it.
    """
    v = F.try_parse_json(note)
    raw = lambda m: F.to_json(F.try_variant_get(v, f"$.{m}", "variant"))
    text = lambda m: F.coalesce(F.try_variant_get(v, f"$.{m}", "string"), F.lit(""))
    return F.struct(text("id").alias("id"), text("type").alias("type"), *[raw(m).alias(m) for m in ("motivation", "body", "target")])


def page(text: Column) -> Column:
    """``struct<context, id, type, items>`` of a stored page, items as JSON texts; no page (null) is an empty one.

    A page that isn't JSON is null.
    """
    read = F.from_json(text, "`@context` string, id string, type string, items array<string>")
    none = F.array().cast("array<string>")
    made = F.struct(
        or_else(read["@context"], F.lit(CONTEXT)).alias("context"), F.coalesce(read["id"], F.lit("")).alias("id"),
        or_else(read["type"], F.lit("AnnotationPage")).alias("type"), F.coalesce(read["items"], none).alias("items"),
    )
    empty = F.struct(F.lit(CONTEXT).alias("context"), F.lit("").alias("id"), F.lit("AnnotationPage").alias("type"), none.alias("items"))
    return F.when(text.isNull(), empty).when(F.try_parse_json(text).isNotNull(), made)


def encoded(page: Column) -> Column:
    """The stored text of :func:`page`; items go in as they are."""
    quoted = lambda v: F.to_json(F.struct(v.alias("v")))
    plain = lambda v: F.regexp_extract(quoted(v), r'(?s)\A\{"v":(.*)\}\z', 1)
    own = F.when(page["id"] != "", F.concat(F.lit('"id":'), plain(page["id"]), F.lit(","))).otherwise("")
    return F.concat(
        F.lit('{"@context":'), plain(page["context"]), F.lit(","), own, F.lit('"type":'), plain(page["type"]), F.lit(',"items":['), F.array_join(page["items"], ","), F.lit("]}"))


def edited(items: Column, op: Column, id_: Column, note: Column) -> Column:
    """Items of a page after one edit: ``add`` appends, ``update`` replaces the first with that id, ``delete`` drops all with it.

    Null where there is no such id.
    """
    ids = F.transform(items, lambda n: F.coalesce(F.get_json_object(n, "$.id"), F.lit("")))
    first = F.array_position(ids, id_)
    swapped = F.transform(items, lambda n, i: F.when(i + 1 == first, note).otherwise(n))
    rest = F.filter(items, lambda n: F.coalesce(F.get_json_object(n, "$.id"), F.lit("")) != id_)
    return F.when(op == "add", F.array_append(items, note)).when(first > 0, F.when(op == "update", swapped).when(op == "delete", rest))
