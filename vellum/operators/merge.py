"""Identity joins and merges in which nothing disappears."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import trimmed
from ..functions.text import merge_tags, or_else
from ..sources.graph import occurrence


def match_in_order(old: DataFrame, new: DataFrame, key: str, old_order: list[str], new_order: list[str]) -> DataFrame:
    """Multiset match by key: the n-th old row of a key meets the n-th new one.  Inner."""
    return occurrence(old, key, *old_order).join(occurrence(new, key, *new_order), [key, "nth"])


def lost(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``(key, lost)``: keys that occur more often before than after; blank keys don't count.

    Counts per key are compared, so a key that a third of all rows share is one row in the join.
    """
    a = old.filter(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").groupBy(key).agg(F.count("*").alias("a"))
    b = new.groupBy(key).agg(F.count("*").alias("b"))
    gone = F.col("a") - F.coalesce("b", F.lit(0))
    return a.join(b, key, "left").select(key, gone.alias("lost")).filter("lost > 0")


def monotone_union(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """All new rows, then old ones whose key is not among them; ``kept`` marks the latter."""
    stay = old.join(new.select(key).distinct(), key, "left_anti")
    return new.withColumn("kept", F.lit(False)).unionByName(stay.withColumn("kept", F.lit(True)))


def reuse_linked(links: DataFrame, previous: DataFrame, by: list[str]) -> DataFrame:
    """``links`` with ``file`` and ``sha256`` of the resource that is stored for the URL already; null where none is."""
    had = previous.groupBy(*by, "url").agg(F.max_by(F.struct("file", "sha256"), "file").alias("p"))
    return links.join(had, [*by, "url"], "left").select(*links.columns, "p.file", "p.sha256")


def prefixes(path: Column) -> Column:
    """A path and its ancestors at '/' boundaries."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def longest_anchor(nodes: DataFrame, anchors: DataFrame, key: str, path: str) -> DataFrame:
    """``(key, anchor)``: the longest anchor that is the path or its ancestor.  Equi-join on exploded prefixes."""
    each = nodes.select(key, F.explode(F.array_distinct(prefixes(F.col(path)))).alias("anchor"))
    met = each.join(anchors.select("anchor").distinct(), "anchor")
    return met.groupBy(key).agg(F.max_by("anchor", F.length("anchor")).alias("anchor"))


def replace_urls(docs: DataFrame, key: str, urls: str, files: DataFrame) -> DataFrame:
    """``(key, urls)`` with each element replaced by ``files(url, file)``; blank files don't replace."""
    leaves = docs.select(key, F.posexplode(urls).alias("pos", "url"))
    known = files.filter("file <> ''").groupBy("url").agg(F.max_by("file", "ord").alias("file"))  # the last entry counts
    local = leaves.join(known, "url", "left").select(key, "pos", F.coalesce("file", "url").alias("u"))
    return local.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "u"))), lambda x: x["u"]).alias(urls))


def fill_blank(local: Column, incoming: Column) -> Column:
    return or_else(local, trimmed(F.coalesce(incoming, F.lit(""))))


def conflict(local: Column, incoming: Column) -> Column:
    l, i = F.coalesce(local, F.lit("")), trimmed(F.coalesce(incoming, F.lit("")))
    return (l != "") & (i != "") & (l != i)


def merge_research(local: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Non-destructive: blank texts (``title``, and ``notes`` where both sides have them) are filled, differing
    ones stay and are reported, tags united.

    ``(key, texts, tags, status, changed, conflicts)``; status: missing (no local row), conflict,
    changed, same.  A row can be both ``changed`` and in conflict; ``conflicts`` lists the texts that are.
    """
    texts = [c for c in ("title", "notes") if c in local.columns and c in incoming.columns]
    a = local.select(key, F.struct(*texts, "tags").alias("a"))
    both = a.join(incoming.select(key, F.struct(*texts, "tags").alias("b")), key, "full")
    here, there = F.col("a").isNotNull(), F.col("b").isNotNull()
    made = {c: fill_blank(F.col(f"a.{c}"), F.col(f"b.{c}")) for c in texts} | {"tags": merge_tags(F.col("a.tags"), F.col("b.tags"))}
    both = both.select(key, "a", "b", *[F.when(here, F.when(there, v).otherwise(F.coalesce(f"a.{c}", F.lit("")))).alias(c) for c, v in made.items()])
    clash = F.filter(F.array(*[F.when(conflict(F.col(f"a.{c}"), F.col(f"b.{c}")), F.lit(c)) for c in texts]), lambda c: c.isNotNull())
    changed = F.exists(F.array(*[F.col(c) != F.coalesce(f"a.{c}", F.lit("")) for c in made]), lambda x: x)
    both = both.withColumns({"conflicts": clash, "changed": here & there & F.coalesce(changed, F.lit(False))})
    status = F.when(~here, "missing").when(F.size("conflicts") > 0, "conflict").when(F.col("changed"), "changed").otherwise("same")
    return both.select(key, *made, status.alias("status"), "changed", "conflicts")


def merge_annotations(local: DataFrame, incoming: DataFrame, order: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Incoming annotations by outcome: skipped (no id or canvas), added, duplicate, conflict.

    Those with one id are compared with the local one, else with the first incoming of
    that id; the local one always stays (of local ones that share an id, the least body).
    ``by`` names the columns of the page that an id belongs to; no page is null.
    """
    key = [*by, "id"]
    mine = local.filter("id <> ''").groupBy(*key).agg(F.min("body").alias("mine"))  # ids of a page may repeat
    firsts = incoming.filter("id <> '' and canvas <> ''").groupBy(*key).agg(F.min(F.struct(order, "body")).alias("f"))
    met = incoming.join(mine, key, "left").join(firsts, key, "left")
    base = F.coalesce("mine", "f.body")
    is_first = F.col("mine").isNull() & (F.col(order) == F.col(f"f.{order}"))
    outcome = (
        F.when((F.coalesce("id", F.lit("")) == "") | (F.coalesce("canvas", F.lit("")) == ""), "skipped")
        .when(is_first, "added").when(F.col("body") == base, "duplicate").otherwise("conflict")
    )
    return met.select(*key, order, outcome.alias("outcome"))


def replay(log: DataFrame, by: list[str], order: str) -> DataFrame:
    """Final state of keyed add/update/delete logs: ``(by, value, present, not_found)``.

    An update or delete of an absent key is not found; the state before a step is the
    last add or delete before it (an update changes no presence).  A key's log is one
    window: keys are ids of single notes or comparisons, with few edits each.
    """
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    flip = F.when(F.col("op") == "add", True).when(F.col("op") == "delete", False)
    before = F.coalesce(F.last(flip, ignorenulls=True).over(w), F.lit(False))
    step = log.withColumn("there", before)
    done = F.col("there") | (F.col("op") == "add")
    return step.groupBy(*by).agg(
        F.max_by("value", F.when(done & (F.col("op") != "delete"), F.col(order))).alias("value"),
        F.max_by(F.col("op") != "delete", F.when(done, F.col(order))).alias("present"),
        F.count_if(~done).alias("not_found"),
    )


def preserve_actions(images: DataFrame) -> DataFrame:
    """``action`` per image from ``exists, matched, committed, valid, pyramid_ok, fetch_ok``.

    An existing file is reused if its identity matched or nothing was committed before,
    and it is readable; then its pyramid may need repair.  Anything else is fetched.
    """
    reuse = F.col("exists") & (F.col("matched") | ~F.col("committed")) & F.col("valid")
    action = F.when(reuse & F.col("pyramid_ok"), "skipped").when(reuse, "repaired").when(F.col("fetch_ok"), "stored").otherwise("failed")
    return images.withColumn("action", action)


def commit(images: DataFrame, bundle: str) -> DataFrame:
    """Counters per bundle, and ``committed``: all images are there, or nothing is committed."""
    count = lambda a: F.count_if(F.col("action") == a).alias(a)
    return images.groupBy(bundle).agg(*map(count, ("skipped", "repaired", "stored", "failed")), F.bool_and(F.col("action") != "failed").alias("committed"))
