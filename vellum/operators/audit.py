"""Integrity findings: anti-joins and 'count and first' groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import host_of


def missing_by_kind(links: DataFrame, stored: DataFrame, by: list[str]) -> DataFrame:
    """Links that aren't stored: ``(by, kind, missing, first)``; first in link order."""
    gone = links.join(stored.select("url").distinct(), "url", "left_anti")
    return gone.groupBy(*by, "kind").agg(F.count("*").alias("missing"), F.min_by("url", "ord").alias("first"))


def reconcile(catalogue: DataFrame, bundles: DataFrame, key: str) -> DataFrame:
    """Full outer difference: stale (no bundle), missing (no entry), changed (other stamp), same."""
    a = catalogue.select(key, F.col("stamp").alias("was"), F.lit(True).alias("listed"))
    b = bundles.select(key, F.col("stamp").alias("now"), F.lit(True).alias("there"))
    state = (
        F.when(F.col("there").isNull(), "stale").when(F.col("listed").isNull(), "missing")
        .when(~F.col("was").eqNullSafe(F.col("now")), "changed").otherwise("same")
    )
    return a.join(b, key, "full").select(key, state.alias("state"))


def repeated_files(files: DataFrame, by: str, file: str) -> DataFrame:
    """``(by, file, extra)``: names that occur more than once in a bundle, and how often too much."""
    counts = files.groupBy(by, file).agg((F.count("*") - 1).alias("extra"))
    return counts.filter("extra > 0")


def tally(results: DataFrame) -> DataFrame:
    """One row over all results, errors too: ``n, matched, images, failures``."""
    return results.agg(
        F.count("*").alias("n"), F.count_if(F.col("class") == "MATCH").alias("matched"),
        F.coalesce(F.sum("images"), F.lit(0)).cast("long").alias("images"), F.count_if(F.col("error").isNotNull()).alias("failures"),
    )


def first_results(results: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` results after classification, whatever their outcome (0: all)."""
    return results.orderBy(order).limit(n) if n else results


def incomplete(files: DataFrame, state_dir: str = ".iiif-state") -> DataFrame:
    """``(dir)`` of bundles with a ``manifest.json`` and no ``provenance.json`` beside it; ``files(dir, file)``.

    Folders below one named ``state_dir`` are passed over.
    """
    seen = files.filter(~F.array_contains(F.split("dir", "/"), state_dir))
    done = seen.filter("file = 'provenance.json'").select("dir").distinct()
    return seen.filter("file = 'manifest.json'").select("dir").distinct().join(done, "dir", "left_anti")


def topmost(paths: DataFrame, path: str) -> DataFrame:
    """Directories that hold a marker file and lie under no other such directory."""
    from .merge import prefixes

    parents = paths.select(path, F.explode(prefixes(F.col(path))).alias("up")).filter(F.col("up") != F.col(path))
    nested = parents.join(paths.select(F.col(path).alias("up")).distinct(), "up", "left_semi").select(path).distinct()
    return paths.join(nested, path, "left_anti")


def institution(url: Column) -> Column:
    return F.coalesce(F.nullif(host_of(url), F.lit("")), F.lit("—"))
