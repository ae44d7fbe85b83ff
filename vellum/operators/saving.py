"""Guarded writes: what people edit, and the documents of stored bundles.

Each function is one commit to the store at ``folder`` (see :mod:`vellum.sources.store`): all of it is
there afterwards or none, a writer that came second starts over from what the first one left,
and a store that can't be read is not written.  What it returns was computed on the version it committed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import written
from ..sources import files, store
from . import catalogue, comparisons, merge
from .exchange import CATALOGUE, COMPARISONS

#: Bytes at most of a request's body.
BODIES = {"edit": 64 << 10, "comparison": 64 << 10, "deletion": 8 << 10, "annotation": 1 << 20}
POINTERS = "slug string, manifest string, digest string"
DOCUMENTS = "slug string, manifest string, body string"


def body_error(body: Column, kind: str) -> Column:
    """"body too large" for one of more bytes than its kind may have; null if it may be read."""
    return F.when(F.coalesce(F.octet_length(body), F.lit(0)) > BODIES[kind], "body too large")


def _commit(spark: SparkSession, folder: str, change: Callable[[store.Snapshot], tuple[DataFrame, dict[str, DataFrame]]]) -> DataFrame:
    said: list[DataFrame] = []

    def once(read: store.Snapshot) -> dict[str, DataFrame]:
        told, tables = change(read)
        said.append(written(told, "outcomes"))
        return tables

    store.update(spark, folder, once)
    return said[-1]


def save_edits(spark: SparkSession, folder: str, edits: DataFrame) -> DataFrame:
    """``(dir, ord, outcome)`` of ``edits(dir, ord, title, notes, tags)``; the last one of a folder that may be made is saved."""

    def change(read: store.Snapshot):
        now = read.read(spark, "catalogue", CATALOGUE)
        return catalogue.edit_outcomes(now, edits), {"catalogue": catalogue.edited(now, edits)}

    return _commit(spark, folder, change)


def save_sets(spark: SparkSession, folder: str, new: DataFrame) -> DataFrame:
    """``(ord, name, error)`` of ``new(ord, name, docs, canvases)``; sets without an error are saved behind those that are there."""

    def change(read: store.Snapshot):
        now = read.read(spark, "comparisons", COMPARISONS)
        judged = written(comparisons.added(now, new, "ord"), "sets")
        base = now.agg(F.coalesce(F.max("ord") + 1, F.lit(0)).alias("base"))
        good = judged.filter("error is null").join(base).select(  # one row on the right
            (F.col("base") + F.col("ord")).alias("ord"), comparisons.named(F.col("name")).alias("name"), "docs", "canvases")
        return judged.select("ord", "name", "error"), {"comparisons": now.unionByName(good)}

    return _commit(spark, folder, change)


def drop_sets(spark: SparkSession, folder: str, gone: DataFrame) -> DataFrame:
    """``(ord, outcome)`` of the sets to delete, ``gone(ord)``: deleted or not found."""

    def change(read: store.Snapshot):
        left, told = comparisons.deleted(read.read(spark, "comparisons", COMPARISONS), gone, "ord")
        return told, {"comparisons": left}

    return _commit(spark, folder, change)


def preserve(spark: SparkSession, folder: str, images: DataFrame, documents: DataFrame) -> DataFrame:
    """Counters per bundle of ``images(slug, exists, matched, committed, valid, pyramid_ok, fetch_ok)``, and whether it was committed.

    Of bundles all of whose images are there, ``documents(slug, body)`` become the active ones: the first keeps its
    plain name, a changed one is stored under its digest beside those before.  Document and
    pointer change in one commit, so a reader finds the document that its pointer names.
    """
    counts = written(merge.commit(merge.preserve_actions(images), "slug"), "counts")
    ready = documents.join(counts.filter("committed").select("slug"), "slug", "left_semi")
    ready = written(ready.withColumn("digest", F.sha2(F.col("body").cast("binary"), 256)), "ready")

    def change(read: store.Snapshot):
        pointers = read.read(spark, "pointers", POINTERS)
        named = written(files.publish(ready.select("slug", "digest"), pointers, "slug", "digest"), "pointers")
        had = read.read(spark, "documents", DOCUMENTS)
        new = ready.join(named.select("slug", "manifest"), "slug").select("slug", "manifest", "body")
        return counts, {"pointers": named, "documents": had.unionByName(new.join(had.select("slug", "manifest"), ["slug", "manifest"], "left_anti"))}

    return _commit(spark, folder, change)


def active_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``(slug, manifest, body)``: the document each bundle's pointer names."""
    read = store.snapshot(spark, folder)
    return read.read(spark, "pointers", POINTERS).join(read.read(spark, "documents", DOCUMENTS), ["slug", "manifest"]).select("slug", "manifest", "body")
