"""The catalogue: a row per stored bundle, with what people wrote about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import trimmed
from ..functions.text import megabytes, normalize_tags, or_else
from ..rank import ranked
from ..scratch import written
from .audit import institution

WRITTEN = ("title", "notes", "tags")
#: Bytes at most of a title, of notes, of tags.
LIMITS = {"title": 500, "notes": 20_000, "tags": 1_000}
VERSION = 1


def summary(bundles: DataFrame) -> DataFrame:
    """Display row of ``bundles(dir, source_title, url, langs, images, title, notes, tags, size)``.

    The title is the one given, else the source's, else the folder's name.
    """
    source = or_else(F.col("source_title"), F.col("dir"))
    return bundles.select(
        "dir", source.alias("source_title"), or_else(F.col("title"), source).alias("title"), institution(F.col("url")).alias("institution"),
        F.when(F.size("langs") > 0, F.array_join("langs", ", ")).otherwise("—").alias("languages"), F.col("images").alias("pages"),
        F.coalesce("notes", F.lit("")).alias("notes"), F.coalesce("tags", F.lit("")).alias("tags"), megabytes(F.col("size")).alias("size"),
    )


def search(rows: DataFrame, query: str) -> DataFrame:
    """Rows of :func:`summary` in whose titles, institution, languages, notes or tags the query stands; case ignored."""
    text = F.lower(F.concat_ws(" ", "source_title", "title", "institution", "languages", "notes", "tags"))
    return rows.filter(F.contains(text, F.lower(trimmed(F.lit(query)))))


#: Fixed value: the order of a browser's ``localeCompare``, accents and case after letters.
COLLATION = "UNICODE"


def collated(text: Column) -> Column:
    """Sort key of a text in lower case: by letters, then accents, as readers expect, not by code points."""
    return F.collate(F.lower(F.coalesce(text, F.lit(""))), COLLATION)


def sort_keys(mode: str) -> list[Column]:
    """Of the four ways to sort the catalogue; the folder settles ties."""
    title, path = collated(F.col("title")), [collated(F.col("dir")), F.col("dir")]
    return {"path": path, "title": [title, *path], "institution": [collated(F.col("institution")), *path], "pages": [F.col("pages").desc(), title, *path]}[mode]


def ranks(rows: DataFrame) -> DataFrame:
    """``rows`` with their place under each way to sort: ``by_path, by_title, by_institution, by_pages``.

    Only sort keys and row numbers are sorted; the four narrow results meet before the rows join.
    """
    numbered = written(rows.withColumn("__row", F.monotonically_increasing_id()), "catalogue")
    narrow = numbered.select("__row", "dir", "title", "institution", "pages")
    places = None
    for mode in ("path", "title", "institution", "pages"):
        one = ranked(narrow, sort_keys(mode), f"by_{mode}").select("__row", f"by_{mode}")
        places = one if places is None else places.join(one, "__row")
    return numbered.join(places, "__row").drop("__row")


#: Orders of listings.
ORDERS = {"catalogue": ("dir",), "bundles": ("slug",), "problems": ("path", "message"), "comparisons": ("created_at", "ord"), "failures": ("url",)}


def in_order(rows: DataFrame, kind: str) -> DataFrame:
    """Rows in the order of a listing: by their columns' values, as files and logs are."""
    return rows.orderBy(*ORDERS[kind])


def placed(rows: DataFrame, kind: str, name: str = "place") -> DataFrame:
    """Append each row's place in a listing, without a task that sorts them all."""
    return ranked(rows, [F.col(c) for c in ORDERS[kind]], name)


def within_limits(title: Column, notes: Column, tags: Column) -> Column:
    """Whether texts are short enough, in bytes."""
    sizes = {"title": title, "notes": notes, "tags": tags}
    ok = F.lit(True)
    for name, most in LIMITS.items():
        ok = ok & (F.coalesce(F.octet_length(sizes[name]), F.lit(0)) <= most)
    return ok


def edited(catalogue: DataFrame, edits: DataFrame) -> DataFrame:
    """The catalogue after ``edits(dir, ord, title, notes, tags)``; the last edit of a folder that may be made counts.

    Texts are trimmed, tags normalized.  Edits beyond the limits, or of unknown folders, change nothing.
    """
    last = edits.filter(within_limits(F.col("title"), F.col("notes"), F.col("tags"))).groupBy("dir").agg(F.max_by(F.struct(*WRITTEN), "ord").alias("e"))
    text = {"title": trimmed(F.col("e.title")), "notes": trimmed(F.col("e.notes")), "tags": normalize_tags(F.col("e.tags"))}
    met = catalogue.join(last, "dir", "left")
    return met.select(*[F.when(F.col("e").isNotNull(), F.coalesce(text[c], F.lit(""))).otherwise(F.col(c)).alias(c) if c in WRITTEN else F.col(c) for c in catalogue.columns])


def edit_outcomes(catalogue: DataFrame, edits: DataFrame) -> DataFrame:
    """``(dir, ord, outcome)`` of each edit: saved, too long, or not found."""
    there = catalogue.select("dir", F.lit(True).alias("there")).distinct()
    outcome = F.when(~within_limits(F.col("title"), F.col("notes"), F.col("tags")), "too long").when(F.col("there").isNull(), "not found").otherwise("saved")
    return edits.join(there, "dir", "left").select("dir", "ord", outcome.alias("outcome"))


def reloaded(catalogue: DataFrame, sidecar: DataFrame) -> DataFrame:
    """The catalogue with what people wrote as ``sidecar(dir, title, notes, tags)`` has it, for folders that both know."""
    saved = sidecar.select("dir", F.struct(*WRITTEN).alias("s"))
    met = catalogue.join(saved, "dir", "left")
    return met.select(*[F.when(F.col("s").isNotNull(), F.col(f"s.{c}")).otherwise(F.col(c)).alias(c) if c in WRITTEN else F.col(c) for c in catalogue.columns])


def complete(stamp: Column) -> Column:
    """Whether a stamp is that of a bundle with provenance, which is written last."""
    return ~F.endswith(stamp, F.lit(":-"))


def refreshed(catalogue: DataFrame, bundles: DataFrame) -> DataFrame:
    """``(dir, stamp, pages, title, notes, tags, size, state)`` after a look at the stored bundles.

    ``catalogue(dir, stamp, pages, title, notes, tags, size)``, ``bundles(dir, stamp, pages)``.  What people
    wrote is kept, a size as long as the stamp is the same.  A bundle without provenance
    is not taken up, and doesn't replace its older entry.  ``state``: added, changed, same or removed.
    """
    a = catalogue.select("dir", F.struct(*[c for c in catalogue.columns if c != "dir"]).alias("was"))
    b = bundles.select("dir", F.struct("stamp", "pages").alias("now"))
    done, here, had = complete(F.col("now.stamp")), F.col("now").isNotNull(), F.col("was").isNotNull()
    same = had & here & (~done | F.col("was.stamp").eqNullSafe(F.col("now.stamp")))
    state = F.when(same, "same").when(had & here, "changed").when(had, "removed").when(done, "added")
    source = F.when(same | ~here, F.struct("was.stamp", "was.pages")).otherwise(F.struct("now.stamp", "now.pages"))
    met = a.join(b, "dir", "full").withColumn("state", state).filter("state is not null").withColumn("src", source)
    return met.select(
        "dir", F.col("src.stamp").alias("stamp"), F.col("src.pages").alias("pages"), *[F.coalesce(f"was.{c}", F.lit("")).alias(c) for c in WRITTEN],
        F.when(F.col("was.stamp").eqNullSafe(F.col("src.stamp")), F.col("was.size")).alias("size"), "state",
    )


def readable(text: Column, version: int = VERSION) -> Column:
    """Error of a sidecar's text, null if it can be read; a file that can't be is never overwritten.  No file (null) is an empty one."""
    parsed = F.try_parse_json(text)
    return (
        F.when(text.isNull(), None).when(parsed.isNull(), "not JSON")
        .when(~F.coalesce(F.try_variant_get(parsed, "$.version", "int") == version, F.lit(False)), "another version")
    )
