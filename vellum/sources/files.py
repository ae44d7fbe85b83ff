"""Stored bundles, local documents, configuration: files as tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import trimmed
from ..functions.text import or_else
from ..functions.tiles import info_json
from ..functions.urls import is_absolute, safe_relative
from .graph import latest

def settings(lines: DataFrame, line: str = "value", order: str = "ord") -> DataFrame:
    """``(key, value, error)`` of ``key = value`` lines; '#' comments and blank lines drop out.

    The last value of a key counts.  Lines without '=' come back as errors.
    """
    text = trimmed(F.col(line))
    used = lines.withColumn("t", text).filter((F.col("t") != "") & ~F.startswith("t", F.lit("#")))
    parts = F.split("t", "=", 2)
    bad = used.filter(~F.contains("t", F.lit("="))).select(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"), F.concat(F.lit("malformed: "), "t").alias("error"))
    good = used.filter(F.contains("t", F.lit("="))).select(trimmed(F.get(parts, F.lit(0))).alias("key"), trimmed(F.get(parts, F.lit(1))).alias("value"), order)
    return latest(good, "key", order, "value").withColumn("error", F.lit(None).cast("string")).unionByName(bad)


def local_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(path, id, body, error)``: whole files with the absolute URL they name themselves by."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))
    own = or_else(F.get_json_object("body", "$.id"), F.get_json_object("body", "$['@id']"))
    named = files.withColumn("id", own)
    return named.withColumn("error", F.when(~F.coalesce(is_absolute(F.col("id")), F.lit(False)), "no absolute id"))


def listing(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``(dir, file, length, modified)`` under ``root``; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    at = F.regexp_replace("path", r"\A\w+:/*", "/")
    return found.select(
        F.regexp_extract(at, r"\A(.*)/[^/]*\z", 1).alias("dir"), F.regexp_extract(at, r"([^/]*)\z", 1).alias("file"),
        "length", F.col("modificationTime").alias("modified"),
    )


def folder_sizes(files: DataFrame) -> DataFrame:
    return files.groupBy("dir").agg(F.sum("length").alias("bytes"), F.count("*").alias("files"))


def stamp(modified: Column, length: Column) -> Column:
    """Nanoseconds and size of a file, '-' where it is absent."""
    made = F.concat(F.unix_micros(modified).cast("string"), F.lit("000/"), length.cast("string"))
    return F.coalesce(made, F.lit("-"))


def jpeg_dimensions(data: bytes | None) -> tuple[int, int] | None:
    """Width and height from the frame header of a JPEG, or None.

    Segments are followed by their lengths, so nothing inside one (a thumbnail in EXIF data, a
    colour profile) is taken for a marker; a file that ends before its frame header has none.
    Baseline, extended and progressive frames of 8 bits with 1, 3 or 4 components are read.
    """
    if not data or data[:2] != b"\xff\xd8":
        return None
    at, n = 2, len(data)
    while True:
        at = data.find(b"\xff", at)  # what stands between segments is skipped
        while 0 <= at < n and data[at] == 0xFF:  # fill bytes
            at += 1
        if at < 0 or at >= n:
            return None
        marker, at = data[at], at + 1
        if marker == 0 or 0xD0 <= marker <= 0xD7:  # stuffed, or a restart: no segment
            continue
        if marker in (0xD9, 0xDA) or marker < 0xC0:  # the end, or image data, before a frame
            return None
        size = int.from_bytes(data[at : at + 2], "big")
        if size < 2 or at + size > n:
            return None
        if marker in (0xC0, 0xC1, 0xC2):
            bits, height, width, parts = data[at + 2], int.from_bytes(data[at + 3 : at + 5], "big"), int.from_bytes(data[at + 5 : at + 7], "big"), (size - 8) // 3
            good = size in (11, 17, 20) and bits == 8 and data[at + 7] == parts and width and height
            return (width, height) if good else None
        if 0xC3 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):  # lossless, hierarchical, arithmetic
            return None
        at += size


def jpeg_size(body: Column) -> Column:
    """``struct<width, height>`` of a JPEG's bytes; null if it can't be read.  See :func:`jpeg_dimensions`."""

    @F.pandas_udf("width int, height int")
    def run(bodies: pd.Series) -> pd.DataFrame:
        found = [jpeg_dimensions(b) or (None, None) for b in bodies]
        return pd.DataFrame(found, columns=["width", "height"]).astype("Int32")

    return F.transform(F.array(run(body)), lambda s: F.when(s["width"].isNotNull(), s))[0]


def readable_jpeg(body: Column) -> Column:
    """Whether the bytes are a JPEG with a frame header that has a size."""
    return jpeg_size(body).isNotNull()


def publish(new: DataFrame, pointers: DataFrame, key: str, digest: str) -> DataFrame:
    """Next commit pointers ``(key, manifest, digest)``: the first document of a bundle keeps its name,
    a changed one is staged under its digest, an unchanged one stays where it is."""
    old = pointers.select(key, F.col("manifest").alias("was"), F.col(digest).alias("had"))
    joined = new.select(key, F.col(digest).alias("digest")).join(old, key, "full")
    staged = F.concat(F.lit("manifest-versions/"), "digest", F.lit(".json"))
    name = (
        F.when(F.col("digest").isNull() | F.col("had").eqNullSafe(F.col("digest")), F.col("was"))
        .when(F.col("was").isNull(), "manifest.json").otherwise(staged)
    )
    return joined.select(key, name.alias("manifest"), F.coalesce("digest", "had").alias(digest))


def active(bundles: DataFrame, pointers: DataFrame, key: str) -> DataFrame:
    """``(key, manifest)`` to read: the pointer's if it stays inside the bundle, else the first document."""
    named = bundles.select(key).join(pointers.select(key, "manifest"), key, "left")
    ok = F.coalesce(safe_relative(F.col("manifest")), F.lit(False))
    return named.select(key, F.when(ok, F.col("manifest")).otherwise("manifest.json").alias("manifest"))


def blobs_put(store: DataFrame, new: DataFrame) -> DataFrame:
    """``(key, body)`` after ``new(key, body, ord)``: the last body of a key counts; keys that leave the root are refused."""
    good = new.filter(F.coalesce(safe_relative(F.col("key")), F.lit(False))).groupBy("key").agg(F.max_by("body", "ord").alias("body"))
    return store.select("key", "body").join(good.select("key"), "key", "left_anti").unionByName(good)


def blobs_get(store: DataFrame, asked: DataFrame) -> DataFrame:
    """``(key, body, error)`` for each of ``asked(key)``; an empty body is there, a missing one is an error."""
    met = asked.select("key").join(store.select("key", "body", F.lit(True).alias("there")), "key", "left")
    error = F.when(~F.coalesce(safe_relative(F.col("key")), F.lit(False)), "outside the store").when(F.col("there").isNull(), "no such key")
    return met.select("key", F.when(error.isNull(), F.col("body")).alias("body"), error.alias("error"))


def blobs_delete(store: DataFrame, gone: DataFrame) -> DataFrame:
    return store.select("key", "body").join(gone.select("key"), "key", "left_anti")


def pyramid_complete(images: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """``(key, complete)``: whether the description beside an image's tiles is the one its size asks for.

    ``images(key, prefix, w, h)``, ``texts(key, body)``.  It is written after all tiles, so it stands for them.
    """
    met = images.join(texts.select(key, "body"), key, "left")
    want = trimmed(info_json(F.col("prefix"), F.col("w"), F.col("h")))
    return met.select(key, F.coalesce(trimmed(F.col("body")) == want, F.lit(False)).alias("complete"))
