"""Comparisons: named sets of a few documents, each with a canvas to begin at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import trimmed
from ..functions.urls import safe_relative

MIN_DOCS, MAX_DOCS, MAX_NAME, MAX_SETS = 2, 4, 200, 100


def named(name: Column) -> Column:
    """A set's name as it is stored; none is blank."""
    return trimmed(F.coalesce(name, F.lit("")))


def good_name(name: Column) -> Column:
    return F.length(named(name)).between(1, MAX_NAME)


def safe_slug(slug: Column) -> Column:
    """A relative path in its shortest form: no empty, '.' or '..' part."""
    parts = F.split(slug, "/")
    return F.coalesce(safe_relative(slug) & ~F.exists(parts, lambda p: p.isin("", ".", "..")), F.lit(False))


def shared_canvases(members: DataFrame, owned: DataFrame, by: str) -> DataFrame:
    """``(by, canvas, owners)`` of canvases that several documents of one set hold.

    ``members(by, doc)`` and ``owned(doc, canvas)``; a document counts once.
    """
    met = members.select(by, "doc").distinct().join(owned.select("doc", "canvas").distinct(), "doc")
    return met.groupBy(by, "canvas").agg(F.count("*").alias("owners")).filter("owners > 1")


def selections(members: DataFrame, known: DataFrame, owned: DataFrame, by: str, least: int = MIN_DOCS, most: int = MAX_DOCS) -> DataFrame:
    """``(by, docs, error)``: whether the documents of each set can be compared.

    ``members(by, pos, doc, canvas)``, ``known(doc)``, ``owned(doc, canvas)``.  A set has
    ``least`` to ``most`` documents, all safe, known and different; no canvas belongs to two
    of them; a canvas to begin at ('' for none) belongs to its document.  The first of
    these rules that is broken is the error.
    """
    there = known.select("doc").distinct().withColumn("known", F.lit(True))
    own = owned.select("doc", F.col("canvas")).distinct().withColumn("own", F.lit(True))
    met = members.withColumn("canvas", F.coalesce("canvas", F.lit(""))).join(there, "doc", "left").join(own, ["doc", "canvas"], "left")
    sets = met.groupBy(by).agg(
        F.count("*").alias("docs"), F.count_distinct("doc").alias("different"), F.bool_and(safe_slug(F.col("doc"))).alias("safe"),
        F.count("known").alias("known"), F.count_if(F.expr("canvas <> '' and own is null")).alias("strangers"),
    )
    clashes = shared_canvases(members, owned, by).groupBy(by).agg(F.count("*").alias("clashes"))
    error = (
        F.when(~F.col("docs").between(least, most), "number of documents").when(~F.col("safe"), "unsafe document")
        .when(F.col("different") < F.col("docs"), "repeated document").when(F.col("known") < F.col("docs"), "unknown document")
        .when(F.col("clashes") > 0, "canvas of two documents").when(F.col("strangers") > 0, "canvas of another document")
    )
    return sets.join(clashes, by, "left").select(by, "docs", error.alias("error"))


def resolved(documents: DataFrame, bundles: DataFrame, by: str) -> DataFrame:
    """``(by, docs, complete)``: documents of incoming sets as local folders, by manifest URL, else by folder.

    ``documents(by, pos, manifest_url, bundle_dir)``; ``complete`` if all have one.
    """
    by_url = bundles.filter("manifest_url <> ''").groupBy("manifest_url").agg(F.max("dir").alias("d1"))
    by_dir = bundles.select(F.col("dir").alias("bundle_dir"), F.col("dir").alias("d2")).distinct()
    met = documents.join(by_url, "manifest_url", "left").join(by_dir, "bundle_dir", "left").withColumn("dir", F.coalesce("d1", "d2"))
    made = met.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("pos", "dir"))).alias("d"), F.bool_and(F.col("dir").isNotNull()).alias("complete"))
    return made.select(by, F.transform("d", lambda x: x["dir"]).alias("docs"), "complete")


def merged(local: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """``(name, order, outcome)``: added, duplicate (same documents and canvases), conflict (the local set stays)
    or invalid (no name of 1 to 200 characters).

    ``local(name, docs, canvases)``, ``incoming(name, docs, canvases, order)``.  Names are
    compared without case; of incoming sets with one name the first is added and the
    others are held against it.
    """
    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("key", F.lower(named(F.col("name")))).withColumn("set", F.to_json(F.struct("docs", "canvases")))

    mine = keyed(local).groupBy("key").agg(F.min("set").alias("mine"))
    new = keyed(incoming)
    firsts = new.groupBy("key").agg(F.min(F.struct(order, "set")).alias("f"))
    met = new.join(mine, "key", "left").join(firsts, "key")
    outcome = (
        F.when(~good_name(F.col("name")), "invalid").when(F.col("mine").isNull() & (F.col(order) == F.col(f"f.{order}")), "added")
        .when(F.col("set") == F.coalesce("mine", "f.set"), "duplicate").otherwise("conflict")
    )
    return met.select("name", order, outcome.alias("outcome"))


def added(store: DataFrame, new: DataFrame, order: str, most: int = MAX_SETS) -> DataFrame:
    """``new(name, order)`` with ``error``: a bad name (1 to 200 characters), one that exists already (case ignored),
    or a full store; null if it may be added.  Sets are added one after another in ``order``."""
    name = named(F.col("name"))
    taken = store.select(F.lower(trimmed(F.col("name"))).alias("key"), F.lit(True).alias("taken")).distinct()
    keyed = new.withColumn("key", F.lower(name)).join(taken, "key", "left")
    first = keyed.filter("taken is null").groupBy("key").agg(F.min(order).alias("first"))
    met = keyed.join(first, "key", "left")
    error = F.when(~good_name(F.col("name")), "name").when(F.col("taken").isNotNull() | (F.col(order) > F.col("first")), "exists")
    judged = met.select(*new.columns, error.alias("error"))
    room = most - store.count()
    good = judged.filter("error is null")
    kept = good.orderBy(order).limit(max(room, 0)).select(order).withColumn("fits", F.lit(True))  # at most `most` rows
    return judged.join(F.broadcast(kept), order, "left").select(*new.columns, F.when(F.col("error").isNull() & F.col("fits").isNull(), "full").otherwise(F.col("error")).alias("error"))


def deleted(store: DataFrame, gone: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """The store without the sets of ``gone(key)``, and what became of each key asked for: ``(key, outcome)``, deleted or not found."""
    asked = gone.select(key).distinct()
    there = store.select(key).distinct().withColumn("there", F.lit(True))
    outcome = F.when(F.col("there").isNotNull(), "deleted").otherwise("not found")
    return store.join(asked, key, "left_anti"), asked.join(there, key, "left").select(key, outcome.alias("outcome"))


def listed(store: DataFrame) -> DataFrame:
    """Sets by the time they were made; ``ord`` keeps equal ones in the order of the store."""
    return store.orderBy("created_at", "ord")
