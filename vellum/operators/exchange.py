"""Research archives: export of what people added, and its non-destructive import.

An import is one plan over catalogue, annotations and comparisons.  The report of a dry run and
the tables that a commit writes are both read off the plan, so they can't differ.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import written
from ..sources import store
from . import comparisons as sets
from .annotations import canvas_id
from .merge import merge_annotations, merge_research

FORMAT, VERSION = "vellum-research", 1
#: Bytes at most of an archive.
MAX_ARCHIVE = 64 << 20
#: Tables of a library's store.
CATALOGUE = "dir string, manifest_url string, title string, notes string, tags string"
ANNOTATIONS = "dir string, ord long, id string, canvas string, body string"
COMPARISONS = "ord long, name string, docs array<string>, canvases array<string>"

_DOCUMENTS = "array<struct<manifest_url:string,bundle_dir:string,canvas:string>>"
_LINE = (
    "format string, version int, kind string, dir string, manifest_url string, title string, notes string, tags string, "
    f"annotations array<string>, ord long, name string, documents {_DOCUMENTS}"
)


def resolve(incoming: DataFrame, bundles: DataFrame) -> DataFrame:
    """Incoming rows with their local ``dir``: by manifest URL, else by folder; null if there is neither.

    Two local bundles of one URL: the later folder counts; a blank URL is none.  Of several incoming rows for
    one bundle the first stays (``repeated`` marks the others).
    """
    by_url = bundles.filter("manifest_url <> ''").groupBy("manifest_url").agg(F.max("dir").alias("d1"))
    by_dir = bundles.select(F.col("dir").alias("bundle_dir"), F.col("dir").alias("d2")).distinct()
    met = incoming.join(by_url, "manifest_url", "left").join(by_dir, "bundle_dir", "left").withColumn("dir", F.coalesce("d1", "d2")).drop("d1", "d2")
    first = met.filter("dir is not null").groupBy("dir").agg(F.min("ord").alias("first"))
    return met.join(first, "dir", "left").withColumn("repeated", F.coalesce(F.col("ord") > F.col("first"), F.lit(False))).drop("first")


def import_report(incoming: DataFrame, bundles: DataFrame, local: DataFrame) -> DataFrame:
    """Counts of bundles by status, without writing anything: missing, repeated, conflict, changed, same."""
    met = resolve(incoming, bundles)
    taken = met.filter("dir is not null and not repeated")
    texts = [c for c in ("title", "notes", "tags") if c in met.columns]
    merged = merge_research(local, taken.select("dir", *texts), "dir").join(taken.select("dir").distinct(), "dir", "left_semi")
    parts = [
        met.filter("dir is null").select(F.lit("missing").alias("status")), met.filter("repeated").select(F.lit("repeated").alias("status")),
        merged.select("status"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("status").agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class Library:
    """What people wrote: tables of the shapes above, and ``owned(doc, canvas)`` of the stored documents."""

    catalogue: DataFrame
    annotations: DataFrame
    comparisons: DataFrame
    owned: DataFrame


@dataclass(frozen=True)
class Archive:
    """``bundles(ord, manifest_url, bundle_dir, title, notes, tags)``, ``annotations(ord, pos, id, canvas, body)`` of the
    bundle with that ``ord``, ``comparisons(ord, name, documents)``, and ``errors(ord, error)`` of lines that aren't read."""

    bundles: DataFrame
    annotations: DataFrame
    comparisons: DataFrame
    errors: DataFrame


@dataclass(frozen=True)
class Plan:
    """A change set: ``bundles(ord, bundle_dir, outcome)``, ``catalogue`` rows of matched bundles with ``changed`` and
    ``conflicts``, ``annotations(dir, ord, pos, id, canvas, body, outcome)``, ``comparisons(ord, name, docs, canvases, outcome)``."""

    bundles: DataFrame
    catalogue: DataFrame
    annotations: DataFrame
    comparisons: DataFrame

    def warnings(self) -> DataFrame:
        """``(subject, message)`` of all that an import leaves out; local values stay."""
        notes = self.annotations.filter("outcome in ('skipped', 'conflict')")
        parts = [
            self.bundles.filter("outcome <> 'matched'").select(F.col("bundle_dir").alias("subject"), F.col("outcome").alias("message")),
            self.catalogue.select(F.col("dir").alias("subject"), F.explode("conflicts").alias("c")).select("subject", F.concat("c", F.lit(" conflict")).alias("message")),
            notes.select(F.col("dir").alias("subject"), F.concat(F.lit("annotation "), F.coalesce("id", F.lit("")), F.lit(": "), "outcome").alias("message")),
            self.comparisons.filter("outcome not in ('added', 'duplicate')").select(F.col("name").alias("subject"), F.concat(F.lit("comparison: "), "outcome").alias("message")),
        ]
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        return found

    def report(self) -> DataFrame:
        """One row of counts, as the reader of a dry run or a commit gets it."""
        count = lambda df, when, name: df.agg(F.count_if(F.expr(when)).alias(name))
        rows = [
            count(self.bundles, "outcome = 'matched'", "bundles"), count(self.catalogue, "changed", "catalogue_changes"),
            count(self.annotations, "outcome = 'added'", "annotations_added"), count(self.annotations, "outcome = 'duplicate'", "duplicates"),
            count(self.comparisons, "outcome = 'added'", "comparisons_added"), count(self.comparisons, "outcome = 'duplicate'", "comparison_duplicates"),
            self.warnings().agg(F.count("*").alias("warnings")),
        ]
        found = rows[0]
        for r in rows[1:]:
            found = found.join(r)  # one row each
        return found

    def applied(self, library: Library) -> dict[str, DataFrame]:
        """The tables after the import: changed texts, added annotations and sets, behind those that were there."""
        new = self.catalogue.filter("changed").select("dir", F.struct("title", "notes", "tags").alias("n"))
        merged = library.catalogue.join(new, "dir", "left")
        texts = [F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(c)).alias(c) for c in ("title", "notes", "tags")]
        last = library.annotations.groupBy("dir").agg(F.max("ord").alias("last"))
        notes = self.annotations.filter("outcome = 'added'").join(last, "dir", "left").select(
            "dir", (F.coalesce("last", F.lit(-1)) + 1 + F.col("pos")).alias("ord"), "id", "canvas", "body")
        base = library.comparisons.agg(F.coalesce(F.max("ord") + 1, F.lit(0)).alias("base"))
        added = self.comparisons.filter("outcome = 'added'").join(base).select(  # one row on the right
            (F.col("base") + F.col("ord")).alias("ord"), sets.named(F.col("name")).alias("name"), "docs", "canvases")
        return {
            "catalogue": merged.select("dir", "manifest_url", *texts), "annotations": library.annotations.unionByName(notes),
            "comparisons": library.comparisons.unionByName(added),
        }


def plan(archive: Archive, library: Library) -> Plan:
    """What an import of ``archive`` into ``library`` does; written once, so that every reader sees the same."""
    met = resolve(archive.bundles, library.catalogue.select("dir", "manifest_url"))
    outcome = F.when(F.col("dir").isNull(), "no matching local bundle").when(F.col("repeated"), "duplicate bundle in archive").otherwise("matched")
    met = written(met.withColumn("outcome", outcome), "import-bundles")
    taken = met.filter("outcome = 'matched'")
    texts = ["title", "notes", "tags"]
    merged = merge_research(library.catalogue.select("dir", *texts), taken.select("dir", *texts), "dir").join(taken.select("dir"), "dir", "left_semi")

    incoming = archive.annotations.join(taken.select("ord", "dir"), "ord")
    judged = merge_annotations(library.annotations, incoming, "pos", by=("dir",)).select("dir", "pos", "outcome")
    notes = incoming.join(judged, ["dir", "pos"])

    documents = archive.comparisons.select("ord", F.posexplode("documents").alias("pos", "d")).select("ord", "pos", "d.*")
    found = sets.resolved(documents, library.catalogue.select("dir", "manifest_url"), "ord")
    chosen = archive.comparisons.join(found, "ord", "left").withColumn("canvases", F.transform("documents", lambda d: F.coalesce(d["canvas"], F.lit(""))))
    members = chosen.filter("complete").select("ord", F.posexplode(F.arrays_zip("docs", "canvases")).alias("pos", "m")).select(
        "ord", "pos", F.col("m.docs").alias("doc"), F.col("m.canvases").alias("canvas"))
    checked = sets.selections(members, library.catalogue.select(F.col("dir").alias("doc")), library.owned, "ord").select("ord", "error")
    chosen = written(chosen.join(checked, "ord", "left").withColumn("error", F.when(~F.coalesce("complete", F.lit(False)), "no local bundle").otherwise(F.col("error"))), "import-sets")
    good = chosen.filter("error is null").select("name", "docs", "canvases", "ord")
    outcomes = sets.merged(library.comparisons.select("name", "docs", "canvases"), good, "ord").select("ord", "outcome")
    room = max(0, sets.MAX_SETS - library.comparisons.count())
    fits = outcomes.filter("outcome = 'added'").orderBy("ord").limit(room).select("ord", F.lit(True).alias("fits"))  # at most MAX_SETS rows
    outcomes = outcomes.join(fits, "ord", "left").select("ord", F.when(F.expr("outcome = 'added' and fits is null"), "store is full").otherwise(F.col("outcome")).alias("o"))
    chosen = chosen.join(outcomes, "ord", "left").select("ord", "name", "docs", "canvases", F.coalesce("error", "o").alias("outcome"))
    return Plan(
        met.select("ord", "bundle_dir", "outcome"), written(merged, "import-catalogue"),
        written(notes.select("dir", "ord", "pos", "id", "canvas", "body", "outcome"), "import-annotations"), written(chosen, "import-comparisons"),
    )


def library_of(spark: SparkSession, read: store.Snapshot, owned: DataFrame) -> Library:
    return Library(
        read.read(spark, "catalogue", CATALOGUE), read.read(spark, "annotations", ANNOTATIONS), read.read(spark, "comparisons", COMPARISONS), owned)


def import_archive(spark: SparkSession, folder: str, archive: Archive, owned: DataFrame, dry_run: bool = False) -> Plan:
    """Import into the store at ``folder``; the plan that was committed (dry run: that would be).

    All tables change in one commit.  If another writer was first, the plan is made anew from what that one left.
    """
    made: list[Plan] = []

    def change(read: store.Snapshot) -> dict[str, DataFrame]:
        library = library_of(spark, read, owned)
        made.append(plan(archive, library))
        return made[-1].applied(library)

    if dry_run:
        return plan(archive, library_of(spark, store.snapshot(spark, folder), owned))
    store.update(spark, folder, change)
    return made[-1]


def export(research: DataFrame, annotations: DataFrame, comparisons: DataFrame | None = None) -> DataFrame:
    """One JSON line per bundle with a title, notes, tags or an annotation (``annotations(dir, ord, body)``), and one per
    set of ``comparisons(ord, name, docs, canvases)``, whose documents also name their manifest's URL."""
    notes = annotations.groupBy("dir").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "body"))), lambda x: x["body"]).alias("annotations"))
    joined = research.join(notes, "dir", "left")
    has = F.array_max(F.array(*[F.coalesce(F.col(c), F.lit("")) != "" for c in ("title", "notes", "tags")])) | F.col("annotations").isNotNull()
    head = [F.lit(FORMAT).alias("format"), F.lit(VERSION).alias("version")]
    lines = joined.filter(has).select("dir", F.to_json(F.struct(*head, "dir", "manifest_url", "title", "notes", "tags", "annotations")).alias("value"))
    if comparisons is None:
        return lines
    pairs = F.posexplode(F.arrays_zip("docs", "canvases")).alias("pos", "d")
    each = comparisons.select("ord", "name", pairs).select("ord", "name", "pos", F.col("d.docs").alias("dir"), F.col("d.canvases").alias("canvas"))
    urls = research.groupBy("dir").agg(F.max("manifest_url").alias("manifest_url"))
    document = F.struct("pos", "manifest_url", F.col("dir").alias("bundle_dir"), "canvas")
    whole = each.join(urls, "dir", "left").groupBy("ord", "name").agg(F.sort_array(F.collect_list(document)).alias("d"))
    documents = F.transform("d", lambda d: F.struct(d["manifest_url"].alias("manifest_url"), d["bundle_dir"].alias("bundle_dir"), d["canvas"].alias("canvas")))
    made = whole.select(F.lit(None).cast("string").alias("dir"), F.to_json(F.struct(*head, F.lit("comparison").alias("kind"), "ord", "name", documents.alias("documents"))).alias("value"))
    return lines.unionByName(made)


def read_archive(lines: DataFrame) -> DataFrame:
    """Bundle rows of an archive; ``error`` where format or version is another."""
    a = _parsed(lines).filter("coalesce(kind, '') <> 'comparison'")
    return a.select("format", "version", "dir", "manifest_url", "title", "notes", "tags", "annotations", "error")


def _parsed(lines: DataFrame) -> DataFrame:
    a = lines.select(F.from_json("value", _LINE).alias("a")).select("a.*")
    ok = (F.col("format") == FORMAT) & (F.col("version") == VERSION)
    return a.withColumn("error", F.when(~F.coalesce(ok, F.lit(False)), "unknown format or version"))


def archive_of(lines: DataFrame, most: int = MAX_ARCHIVE) -> Archive:
    """The tables of an archive's lines ``(value)``.  One of more than ``most`` bytes is refused.

    Rows are numbered in the order of the lines.
    """
    size = lines.agg(F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0))).first()[0]
    if size > most:
        raise ValueError(f"an archive of {size} bytes; at most {most} are read")
    a = written(_parsed(lines).withColumn("line", F.monotonically_increasing_id()), "archive")
    good = a.filter("error is null")
    bundles = good.filter("coalesce(kind, '') <> 'comparison'")
    notes = bundles.select(F.col("line").alias("ord"), F.posexplode("annotations").alias("pos", "body"))
    note = F.from_json("body", "id string, target string")
    raw = F.when(F.substring(note["target"], 1, 1).isin("{", "["), note["target"]).otherwise(F.to_json(F.array(note["target"])))
    canvas = canvas_id(F.when(F.startswith(raw, F.lit("[\"")), F.substr(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw))
    return Archive(
        bundles.select(F.col("line").alias("ord"), "manifest_url", F.col("dir").alias("bundle_dir"), "title", "notes", "tags"),
        notes.select("ord", F.col("pos").cast("long").alias("pos"), note["id"].alias("id"), F.coalesce(canvas, F.lit("")).alias("canvas"), "body"),
        good.filter("kind = 'comparison'").select(F.col("line").alias("ord"), "name", "documents"),
        a.filter("error is not null").select(F.col("line").alias("ord"), "error"),
    )
