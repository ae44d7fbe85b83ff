"""State of crawls: what a run is, what is done, what failed, what is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import trimmed
from ..functions.text import canonical_set
from .graph import not_done

STATE_VERSION = 1


def fingerprint(collection: Column, languages: Column, places: Column, start: Column, end: Column, mapping_digest: Column) -> Column:
    """Digest of a crawl's question: order, repeats and blanks don't matter, nor the case of places; of languages it does.

    A missing year and a missing bound are told apart from year 0.
    """
    parts = F.struct(
        F.lit(STATE_VERSION).alias("version"), trimmed(collection).alias("collection"), canonical_set(languages).alias("languages"),
        canonical_set(places, fold=True).alias("places"), F.coalesce(start.cast("string"), F.lit("-")).alias("from"),
        F.coalesce(end.cast("string"), F.lit("-")).alias("to"), mapping_digest.alias("mapping"),
    )
    return F.sha2(F.to_json(parts).cast("binary"), 256)


def mapping_digest(mapping: DataFrame) -> DataFrame:
    """One row with the digest of ``mapping(ord, host, label, kind)``, a fixed dimension."""
    rows = F.transform(F.sort_array(F.collect_list(F.struct("ord", "label", "host", "kind"))), lambda x: F.concat_ws("\x1f", x["host"], x["label"], x["kind"]))
    return mapping.agg(F.sha2(F.array_join(rows, "\x1e").cast("binary"), 256).alias("digest"))


def opened(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """``wanted(fingerprint, descriptor)`` with ``state``: new, resumed, or mismatch (another descriptor under that fingerprint)."""
    had = stored.select("fingerprint", F.col("descriptor").alias("had"))
    state = F.when(F.col("had").isNull(), "new").when(F.col("had") == F.col("descriptor"), "resumed").otherwise("mismatch")
    return wanted.join(had, "fingerprint", "left").select(*wanted.columns, state.alias("state"))


def fresh(tables: dict[str, DataFrame], runs: DataFrame) -> dict[str, DataFrame]:
    """State tables without the rows of ``runs(fingerprint)``, in the order in which they must be replaced:
    discovery first, so that a stop between two never hides new documents."""
    return {name: tables[name].join(runs.select("fingerprint"), "fingerprint", "left_anti") for name in ("frontier", "journal", "failures") if name in tables}


def completed(lines: DataFrame, line: str = "value", by: tuple[str, ...] = ()) -> DataFrame:
    """Distinct trimmed non-blank lines of a journal, per run if ``by`` names one."""
    return lines.select(*by, trimmed(F.col(line)).alias("url")).filter("url <> ''").distinct()


def migrated(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """The union of two journals, ``added`` marking what only the old one had."""
    fresh_ones = new.filter(F.col(key).isNotNull()).select(key).distinct().withColumn("added", F.lit(False))
    return fresh_ones.unionByName(not_done(old.filter(F.col(key).isNotNull()).select(key).distinct(), new, key).withColumn("added", F.lit(True)))


def failures(log: DataFrame, key: str, order: str) -> DataFrame:
    """``(key, done, attempts, last_failure, message)`` from outcomes ``log(key, order, outcome, message)``.

    ``outcome`` is stored, nomatch, failed or trial (a dry run).  Stored and nomatch
    complete a document and clear its failures so far; a later failure counts anew.  A
    document that is failing has ``attempts`` above 0.  Blank keys don't count.
    """
    used = log.filter(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
    ok = used.groupBy(key).agg(F.max(F.when(F.col("outcome").isin("stored", "nomatch"), F.col(order))).alias("ok"))
    after = (F.col("outcome") == "failed") & (F.col("ok").isNull() | (F.col(order) > F.col("ok")))
    return used.join(ok, key).groupBy(key).agg(
        F.bool_or(F.col("ok").isNotNull()).alias("done"), F.count_if(after).alias("attempts"),
        F.max(F.when(after, F.col(order))).alias("last_failure"), F.max_by("message", F.when(after, F.col(order))).alias("message"),
    )


def status(documents: DataFrame, run: str) -> DataFrame:
    """Per run of ``documents(run, url, done, failed)``: manifests, done, pending and failed; each document once."""
    each = documents.groupBy(run, "url").agg(F.bool_or("done").alias("done"), F.bool_or("failed").alias("failed"))
    done = F.count_if(F.col("done"))
    return each.groupBy(run).agg(
        F.count("*").alias("manifests"), done.alias("done"), F.greatest(F.lit(0), F.count("*") - done).alias("pending"), F.count_if(F.col("failed")).alias("failed"))


def status_total(runs: DataFrame, incomplete: DataFrame) -> DataFrame:
    """One row over all runs: how many, reused, pending, failed; and the incomplete bundles."""
    total = runs.agg(
        F.count("*").alias("runs"), F.coalesce(F.sum("done"), F.lit(0)).alias("reused"), F.coalesce(F.sum("pending"), F.lit(0)).alias("pending"), F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"))
    return total.join(incomplete.agg(F.count("*").alias("incomplete")))  # one row each
