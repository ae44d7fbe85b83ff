"""URL, file-name and header helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import trimmed

#: Suffixes tried for the largest image of a service, in default order.
IMAGE_SUFFIXES = ("/full/max/0/default.jpg", "/full/full/0/default.jpg", "")
RETRYABLE = (429, 503)


def host_of(url: Column) -> Column:
    """Host with its port, without user data; '' where there is none."""
    return F.coalesce(F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit(""))


def store_dir(url: Column) -> Column:
    """``host/slug`` folder of a manifest URL: unsafe runs become '_', outer '_' go, all-dot parts become '_'."""
    def part(x: Column) -> Column:
        safe = F.regexp_replace(F.regexp_replace(x, "[^A-Za-z0-9._-]+", "_"), r"\A_+|_+\z", "")
        return F.regexp_replace(safe, r"\A\.+\z", "_")

    rest = F.regexp_replace(url, r"(?s)\A.*?://", "")
    host, slug = part(F.regexp_extract(rest, r"(?s)\A([^/]*)", 1)), part(F.regexp_extract(rest, r"(?s)\A[^/]*/(.*)\z", 1))
    return F.array_join(F.filter(F.array(host, slug), lambda p: p != ""), "/")


def is_absolute(url: Column) -> Column:
    return url.rlike(r"\Ahttps?://[^/?#]+")


def scheme_policy(url: Column) -> Column:
    """'ok' for https, 'warned' for the one plain-http harvest endpoint that is allowed, else 'refused'."""
    return (
        F.when(url.rlike(r"\A(?i:https)://"), "ok")
        .when(url.rlike(r"\A(?i:http)://(?i:oai\.bnf\.fr)/oai2/OAIHandler(?:[?#]|\z)"), "warned")
        .otherwise("refused")
    )


def item_route(url: Column) -> Column:
    """Item id of a catalogue manifest route on the library host, else null."""
    shape = r"\A[A-Za-z]+://(?i:www\.loc\.gov)(?::[0-9]+)?/+item/+([^/?#]+)/+manifest\.json/*(?:[?#]|\z)"
    return F.when(url.rlike(shape), F.regexp_extract(url, shape, 1))


def looks_like_html(content_type: Column, body: Column) -> Column:
    """An interstitial page: by content type, or by how the first 512 characters begin."""
    start = F.lower(trimmed(F.substring(body, 1, 512)))
    by_type = F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("text/html"))
    return by_type | F.coalesce(F.startswith(start, F.lit("<!doctype html")) | F.startswith(start, F.lit("<html")), F.lit(False))


def retry_after(value: Column) -> Column:
    """Whole seconds from 0 to 86,400, else 0 (dates are ignored)."""
    seconds = F.when(value.rlike(r"\A[+-]?[0-9]+\z"), value).try_cast("bigint")
    return F.when(seconds.between(0, 86400), seconds).otherwise(0).cast("long")


def backoff_ms(attempt: Column, base_ms: int = 1000) -> Column:
    return (F.lit(base_ms) * F.call_function("shiftleft", F.lit(1).cast("long"), (attempt - 1).cast("int"))).cast("long")


def retry_delay_ms(status: Column, header: Column, attempt: Column, attempts: int = 3) -> Column:
    """Wait before the next attempt; null where there is none."""
    wait = retry_after(header) * 1000
    return F.when(status.isin(*RETRYABLE) & (attempt < attempts), F.when(wait > 0, wait).otherwise(backoff_ms(attempt)))


def linked_extension(url: Column, media_type: Column, kind: Column) -> Column:
    mime = F.lower(trimmed(F.split_part(F.coalesce(media_type, F.lit("")), F.lit(";"), F.lit(1))))
    path = F.regexp_extract(url, r"\A(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]*)\z", 1))
    return (
        F.when(mime.isin("application/json", "application/ld+json"), ".json")
        .when(mime.isin("application/xml", "text/xml", "application/alto+xml", "application/tei+xml"), ".xml")
        .when(mime == "text/plain", ".txt")
        .when(mime == "text/html", ".html")
        .when(F.endswith(mime, F.lit("+xml")), ".xml")
        .when(F.endswith(mime, F.lit("+json")), ".json")
        .when(F.octet_length(ext).between(2, 10), ext)
        .when(kind == "annotation", ".json")
        .otherwise(".bin")
    )


def linked_file(url: Column, media_type: Column, kind: Column) -> Column:
    return F.concat(F.lit("resources/"), F.sha2(url.cast("binary"), 256), linked_extension(url, media_type, kind))


def image_candidates(service: Column, preferred: Column) -> Column:
    """URLs to try for a service; a valid preferred suffix (0..2) comes first."""
    base = F.regexp_replace(service, r"/+\z", "")
    order = F.array(*map(F.lit, range(len(IMAGE_SUFFIXES))))
    first = F.filter(order, lambda i: i == preferred)
    rest = F.filter(order, lambda i: ~F.coalesce(i == preferred, F.lit(False)))
    suffixes = F.array(*map(F.lit, IMAGE_SUFFIXES))
    return F.transform(F.concat(first, rest), lambda i: F.concat(base, F.get(suffixes, i)))


def service_id(raw_id: Column) -> Column:
    """An image id without the suffix of its full-size rendering."""
    return F.regexp_replace(raw_id, r"/full/(?:full|max)/0/default\.jpg\z", "")


def derivation_key(url: Column, body: Column) -> Column:
    """Hash of a URL and a document, with a zero byte between."""
    return F.sha2(F.concat(url.cast("binary"), F.unhex(F.lit("00")), body.cast("binary")), 256)


def refreshed_name(service: Column, canvas: Column, ordinal: Column) -> Column:
    zero = F.unhex(F.lit("00"))
    whole = F.concat(service.cast("binary"), zero, canvas.cast("binary"), zero, ordinal.cast("string").cast("binary"))
    return F.concat(F.lit("image-"), F.substring(F.sha2(whole, 256), 1, 24))


def safe_relative(path: Column) -> Column:
    """A non-empty relative path that stays inside its root."""
    parts = F.split(path, "/")
    depth = F.aggregate(
        parts, F.struct(F.lit(0).alias("d"), F.lit(True).alias("ok")),
        lambda acc, p: F.struct(
            F.when(p.isin("", "."), acc["d"]).when(p == "..", acc["d"] - 1).otherwise(acc["d"] + 1).alias("d"),
            (acc["ok"] & ~((p == "..") & (acc["d"] <= 0))).alias("ok"),
        ),
    )
    return (path != "") & ~F.startswith(path, F.lit("/")) & depth["ok"] & ~F.contains(path, F.lit("\\"))


def single_segment(path: Column) -> Column:
    return (path != "") & ~path.isin(".", "..") & ~path.rlike(r"[/\\]")
