"""Fetched documents as a table: outcomes, conditional cache, retries, pacing.

The network is a table ``(url, status, content_type, etag, last_modified, retry_after,
body)``; failures are rows with an ``error``, never exceptions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import derivation_key, item_route, looks_like_html, retry_delay_ms, scheme_policy
from ..rank import ranked_by

MAX_BODY, MAX_CACHED = 512 << 20, 16 << 20


def outcomes(responses: DataFrame, cache: DataFrame) -> DataFrame:
    """``(url, body, error, from_cache)`` per response; a 304 takes the cached body."""
    held = cache.select("url", F.col("body").alias("cached"))
    joined = responses.join(held, "url", "left")
    body = F.when(F.col("status") == 304, F.col("cached")).otherwise(F.col("body"))
    error = (
        F.when(scheme_policy(F.col("url")) == "refused", "insecure url")
        .when((F.col("status") == 304) & F.col("cached").isNull(), "not modified, but not cached")
        .when(F.col("status") == 404, "not found")
        .when((F.col("status") != 304) & ~F.col("status").between(200, 299), F.concat(F.lit("status "), "status"))
        .when(F.octet_length(body) > MAX_BODY, "too large")
        .when(looks_like_html(F.col("content_type"), body), "html page")
    )
    return joined.select("url", F.when(error.isNull(), body).alias("body"), error.alias("error"), (F.col("status") == 304).alias("from_cache"))


def updated_cache(cache: DataFrame, responses: DataFrame, order: str | None = None) -> DataFrame:
    """The cache after ``responses``: JSON bodies with a validator, of up to 16 MiB, replace older ones.

    Of several responses of one URL the last by ``order`` counts (without an order, the one
    with the greatest validator and body).
    """
    names = ["url", "etag", "last_modified", "content_type", "body"]
    validator = (F.coalesce("etag", F.lit("")) != "") | (F.coalesce("last_modified", F.lit("")) != "")
    keep = F.col("status").between(200, 299) & validator & (F.octet_length("body") <= MAX_CACHED) & F.try_parse_json("body").isNotNull()
    last = F.struct(order) if order else F.struct("etag", "body")
    new = responses.filter(keep).groupBy("url").agg(F.max_by(F.struct(*names[1:]), last).alias("r")).select("url", *[f"r.{n}" for n in names[1:]])
    return new.unionByName(cache.select(names).join(new.select("url"), "url", "left_anti"))


def item_fallback(responses: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, url, via, body)``: where a manifest comes from, with the key it is derived under.

    A refused (403) manifest of an exact catalogue route is derived from its item among
    ``items(item, body)``; a 200 is taken as it is; anything else is an error.  Only responses of
    such a route are joined: the others, most of them, have no item and would all meet in one task.
    """
    routed = responses.withColumn("item", F.when(F.col("status") == 403, item_route(F.col("url"))))
    held = items.select("item", F.col("body").alias("derived"))
    met = routed.filter("item is not null").join(held, "item", "left").unionByName(
        routed.filter("item is null").withColumn("derived", F.lit(None).cast(held.schema["derived"].dataType)))
    via = F.when(F.col("derived").isNotNull(), "derived").when(F.col("status") == 200, "direct").otherwise("error")
    body = F.when(via == "derived", F.col("derived")).when(via == "direct", F.col("body"))
    return met.select(*keys, "url", via.alias("via"), body.alias("body"), derivation_key(F.col("url"), F.coalesce("derived", "body")).alias("derivation"))


def preferred(rows: DataFrame, by: list[str], order: list[str], worked: str) -> DataFrame:
    """``rows`` with ``pref``: the form that ``worked`` (null: none did) for the last row before this one of the same ``by``.

    A key is a bundle's images on one host, a window of a few thousand rows at most.
    """
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("pref", F.last(worked, ignorenulls=True).over(before))


def attempts(log: DataFrame, limit: int = 3) -> DataFrame:
    """``log(url, attempt, status, retry_after)`` with ``delay_ms`` before the next try and the time it begins."""
    delay = retry_delay_ms(F.col("status"), F.col("retry_after"), F.col("attempt"), limit)
    w = Window.partitionBy("url").orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    timed = log.withColumn("delay_ms", delay)
    return timed.withColumn("start_ms", F.coalesce(F.sum("delay_ms").over(w), F.lit(0)))


def schedule(requests: DataFrame, order: str, default_ms: int = 750) -> DataFrame:
    """``start_ms`` of each request: its place in its host's queue times the host's interval (``interval_ms``)."""
    queued = ranked_by(requests, ["host"], [F.col(order)], "__nth")
    start = (F.col("__nth") - 1) * F.coalesce("interval_ms", F.lit(default_ms))
    return queued.withColumn("start_ms", start.cast("long")).drop("__nth")


def jittered(start_ms: Column, max_ms: int = 600) -> Column:
    """A random extra of 30 to ``max_ms`` milliseconds in steps of 30."""
    return start_ms + 30 * (1 + F.floor(F.rand() * (max_ms // 30)))


