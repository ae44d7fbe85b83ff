"""Collections, change streams, ledgers: where document URLs come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..rank import ranked_by
from ..scratch import Known, bucketed, complete, scratch, written

COLLECTION = (
    "manifests array<struct<`@id`:string>>, collections array<struct<`@id`:string>>, "
    "members array<struct<`@id`:string,id:string,`@type`:string,type:string>>, "
    "items array<struct<`@id`:string,id:string,`@type`:string,type:string>>"
)


def references(documents: DataFrame, url: str = "url", body: str = "body") -> DataFrame:
    """Edges ``(parent, child, kind, pos)`` of collection documents of both versions.

    Order in a document: manifests, collections, members, items.  A member's type is
    ``type``, else ``@type`` without ``sc:``; other types drop out.  ``id`` goes before
    ``@id``.  A body that isn't JSON gives no rows.
    """
    d = documents.select(F.col(url).alias("parent"), F.from_json(body, COLLECTION).alias("c"))
    empty = F.array().cast("array<struct<id:string,kind:string>>")

    def fixed(name: str, kind: str):
        return F.coalesce(F.transform(f"c.{name}", lambda x: F.struct(x["@id"].alias("id"), F.lit(kind).alias("kind"))), empty)

    def typed(name: str):
        def one(x):
            kind = F.coalesce(F.nullif(x["type"], F.lit("")), F.regexp_replace(x["@type"], r"\Asc:", ""))
            return F.struct(F.coalesce(F.nullif(x["id"], F.lit("")), x["@id"]).alias("id"), F.lower(kind).alias("kind"))

        return F.coalesce(F.transform(f"c.{name}", one), empty)

    refs = F.concat(fixed("manifests", "manifest"), fixed("collections", "collection"), typed("members"), typed("items"))
    rows = d.select("parent", F.posexplode(refs).alias("pos", "r"))
    return rows.select("parent", F.col("r.id").alias("child"), F.col("r.kind").alias("kind"), "pos").filter(
        "kind in ('manifest', 'collection')"
    )


def walk_tree(edges: DataFrame, root: str, failed: DataFrame | None = None) -> DataFrame:
    """Manifests in document order, duplicates kept: ``(manifest, depth, path, error)``.

    A collection is entered once, however many documents refer to it and whether or not
    they form cycles: where a depth-first walk in document order comes to it first.
    That is the least of its paths (positions from the root), so each round offers the
    collections behind those whose path has changed a path, and keeps the lesser; a round
    per level, and few collections after the first.  ``failed(url, error)`` are collections
    that can't be read: a row with their error stands where their content would, and the
    walk goes on.  Sorting by ``path`` gives the depth-first order.
    """
    spark = edges.sparkSession
    edges = bucketed(edges.select("parent", "child", "kind", "pos"), "walk-edges", ["parent"])
    inner = edges.filter("kind = 'collection' and child <> ''")
    paths = Known("walk", ["node"])  # a node's least path counts
    changed = paths.add(spark.createDataFrame([(root, [])], "node string, path array<int>"))
    while True:
        offers = changed.join(inner, F.expr("node = parent")).select(F.col("child").alias("node"), F.concat("path", F.array("pos")).alias("path"))
        less = offers.groupBy("node").agg(F.min("path").alias("path"))
        for table in paths.tables_in_order():
            had = table.groupBy("node").agg(F.min("path").alias("was"))
            less = less.join(had, "node", "left").filter("was is null or path < was").select("node", "path")
        changed = paths.add(less)
        if changed.isEmpty():
            break
    known = paths.all().groupBy("node").agg(F.min("path").alias("path"))
    leaves = known.join(edges.filter("kind = 'manifest'"), F.expr("node = parent")).select(
        F.col("child").alias("manifest"), F.concat("path", F.array("pos")).alias("path"), F.lit(None).cast("string").alias("error"))
    if failed is not None:
        errors = known.join(failed, F.expr("node = url")).select(F.lit(None).cast("string").alias("manifest"), "path", "error")
        leaves = leaves.unionByName(errors)
    return leaves.select("manifest", F.size("path").alias("depth"), "path", "error")


FRONTIER_VERSION = 1


def walk_frontier(edges: DataFrame, root: str, folder: str | None = None, failed: DataFrame | None = None) -> DataFrame:
    """Breadth-first with both collections and manifests visited once: ``(url, kind, depth, expanded)``.

    Blank URLs drop out.  Every round's discoveries and expanded collections are written
    before the next round reads them.  With a ``folder`` they stay there: a later call
    takes up the rounds that were written to their end and goes on with the collections
    still pending.  A folder of another root or version raises.  A collection in
    ``failed(url)`` stays pending, and the walk stops after its round.
    """
    spark = edges.sparkSession
    folder = folder or scratch(spark, "frontier")
    about = f"{folder}/about"
    if complete(spark, about):
        had = spark.read.parquet(about).first()
        if (had["root"], had["version"]) != (root, FRONTIER_VERSION):
            raise ValueError(f"{folder} holds a walk of {had['root']}, version {had['version']}")
    else:
        spark.createDataFrame([(root, FRONTIER_VERSION)], "root string, version int").write.mode("overwrite").parquet(about)
    edges = bucketed(edges.filter("child <> ''").select("parent", "child", "kind"), "frontier-edges", ["parent"])
    path = lambda name, n: f"{folder}/{name}-{n:06d}"
    rounds = 0
    while complete(spark, path("done", rounds + 1)):  # written last: the round counts from then on
        rounds += 1
    found, done = _walked(spark, folder, root, rounds)
    known = Known("frontier", ["url"])
    known.add(found.select("url"))
    pending = written(found.filter("kind = 'collection'").join(done, "url", "left_anti").select("url"), "pending")
    stuck = failed.select("url").distinct() if failed is not None else spark.createDataFrame([], "url string")
    while True:
        ready, blocked = (written(pending.join(stuck, "url", how), "pending") for how in ("left_anti", "left_semi"))
        if ready.isEmpty():
            break
        rounds += 1
        step = ready.join(edges, F.expr("url = parent")).groupBy(F.col("child").alias("url")).agg(F.min("kind").alias("kind"))
        known.without(step).select("url", "kind", F.lit(rounds).alias("depth")).write.mode("overwrite").parquet(path("found", rounds))
        ready.write.mode("overwrite").parquet(path("done", rounds))
        new = spark.read.schema(_FOUND).parquet(path("found", rounds))
        known.add(new.select("url"))
        pending = blocked.unionByName(new.filter("kind = 'collection'").select("url"))
        if not blocked.isEmpty():
            break
    found, done = _walked(spark, folder, root, rounds)
    return found.join(done.withColumn("expanded", F.lit(True)), "url", "left").select("url", "kind", "depth", F.coalesce("expanded", F.lit(False)).alias("expanded"))


_FOUND = "url string, kind string, depth int"


def _walked(spark: SparkSession, folder: str, root: str, rounds: int) -> tuple[DataFrame, DataFrame]:
    """What the rounds so far have found, and what they have expanded: one scan each."""
    start = spark.createDataFrame([(root, "collection", 0)], _FOUND)
    if not rounds:
        return start, spark.createDataFrame([], "url string")
    paths = lambda name: [f"{folder}/{name}-{n:06d}" for n in range(1, rounds + 1)]
    return start.unionByName(spark.read.schema(_FOUND).parquet(*paths("found"))), spark.read.schema("url string").parquet(*paths("done"))


def stored_stats(spark: SparkSession, folder: str) -> DataFrame:
    """One row about a walk that is stored in ``folder``: its root and version, and :func:`frontier_stats`.  None there: an error."""
    about = f"{folder}/about"
    if not complete(spark, about):
        raise FileNotFoundError(f"{folder} holds no walk")
    had = spark.read.parquet(about).first()
    if had["version"] != FRONTIER_VERSION:
        raise ValueError(f"{folder} holds a walk of version {had['version']}")
    rounds = 0
    while complete(spark, f"{folder}/done-{rounds + 1:06d}"):
        rounds += 1
    found, done = _walked(spark, folder, had["root"], rounds)
    return frontier_stats(found, done).select(F.lit(had["root"]).alias("root"), F.lit(had["version"]).alias("version"), "*")


def frontier_stats(visited: DataFrame, expanded: DataFrame) -> DataFrame:
    """One row: collections visited, collections not yet expanded, manifests, complete."""
    state = visited.select("url", "kind").join(expanded.select("url", F.lit(True).alias("done")), "url", "left")
    counts = state.agg(
        F.count_if(F.col("kind") == "collection").alias("visited"),
        F.count_if(F.expr("kind = 'collection' and done is null")).alias("pending"),
        F.count_if(F.col("kind") == "manifest").alias("manifests"),
    )
    return counts.withColumn("complete", F.expr("pending = 0"))


_PAGE = "first struct<id:string>, next struct<id:string>, orderedItems array<struct<type:string,object:struct<id:string,type:string>>>"


def paged_activities(documents: DataFrame, root: str) -> DataFrame:
    """``(page, pos, activity, id, error)`` of a paged stream, from ``documents(url, body)``.

    From the root's ``first`` page along ``next`` until there is none or a page comes
    again.  A page that is missing or isn't JSON ends the stream with an error row.  Pages
    are numbered by doubling: each round knows the page 1, 2, 4, ... steps on, so a
    stream of n pages takes log n joins.
    """
    read = documents.groupBy("url").agg(F.max("body").alias("body"))
    read = read.select("url", F.from_json("body", _PAGE).alias("p"), F.try_parse_json("body").isNotNull().alias("ok"))
    read = written(read.select("url", "ok", "p.first.id", F.col("p.next.id").alias("next"), F.col("p.orderedItems").alias("items")), "stream")
    start = read.filter(F.col("url") == root).select(F.col("id").alias("url")).filter("url <> ''")
    reached = written(start.withColumn("page", F.lit(0).cast("long")), "stream-pages")
    jump = read.filter("next <> ''").select("url", F.col("next").alias("to"))
    step = 1
    while True:
        more = reached.join(jump, "url").groupBy(F.col("to").alias("url")).agg((F.min("page") + step).alias("page"))
        new = written(more.join(reached, "url", "left_anti").select("url", "page"), "stream-pages")
        if new.isEmpty():
            break
        reached = reached.unionByName(new)
        jump = written(jump.join(jump.select(F.col("url").alias("to"), F.col("to").alias("far")), "to").select("url", F.col("far").alias("to")), "stream-jumps")
        step *= 2
    pages = reached.join(read.drop("id", "next"), "url", "left")
    bad = ~F.coalesce("ok", F.lit(False))
    end = pages.filter(bad).agg(F.min("page")).first()[0]
    read_whole = pages if end is None else pages.filter(F.col("page") < end)
    rows = read_whole.select("page", F.posexplode("items").alias("pos", "x")).select(
        "page", "pos", F.col("x.type").alias("activity"), F.col("x.object.id").alias("id"), F.lit(None).cast("string").alias("error"))
    errors = pages.filter(F.col("page") == F.lit(end)).select(
        "page", F.lit(0).alias("pos"), F.lit(None).cast("string").alias("activity"), F.lit(None).cast("string").alias("id"), F.concat(F.lit("unreadable page "), "url").alias("error"))
    root_bad = documents.filter(F.col("url") == root).filter(F.try_parse_json("body").isNotNull()).agg(F.count("*").alias("n")).filter("n = 0")
    lost = root_bad.select(
        F.lit(0).cast("long").alias("page"), F.lit(0).alias("pos"), F.lit(None).cast("string").alias("activity"), F.lit(None).cast("string").alias("id"), F.lit(f"unreadable stream {root}").alias("error"))
    return rows.unionByName(errors).unionByName(lost)


def changed(activities: DataFrame, key: str, order: str) -> DataFrame:
    """First Create or Update of each object: ``(key, order)``; deletes are ignored, not retracted."""
    return activities.filter("activity in ('Create', 'Update')").groupBy(key).agg(F.min(order).alias(order))


def not_done(stream: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Rows whose key the ledger doesn't have; rows without key (errors) pass."""
    keyed = stream.filter(F.col(key).isNotNull()).join(ledger.select(key).distinct(), key, "left_anti")
    return keyed.unionByName(stream.filter(F.col(key).isNull()).select(keyed.columns))


def first_by_digest(docs: DataFrame, key: str, body: str) -> DataFrame:
    """``(key, digest, first)``: whether no smaller key has the same bytes.  A minimum per digest, joined back."""
    hashed = docs.select(key, F.sha2(F.col(body).cast("binary"), 256).alias("digest"))
    low = hashed.groupBy("digest").agg(F.min(key).alias("low"))
    return hashed.join(low, "digest").select(key, "digest", (F.col(key) == F.col("low")).alias("first"))


def latest(rows: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """Last non-null value of each column by key, as an upsert log leaves it."""
    return rows.groupBy(key).agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(v) for v in values])


def journal_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, value)`` of an append-only journal's lines; a torn last line (without line feed) is dropped.

    Plain (not compressed) files are split and read in parallel.  A file is torn if its lines and a line feed for each take
    more bytes than it has; its last line is the one that starts last in its last split.
    """
    row = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("at"), "value")
    ends = row.groupBy("file", "size").agg(F.sum(F.octet_length("value") + 1).alias("bytes"), F.max("at").alias("at"))  # a row a file
    torn = ends.filter(F.col("bytes") > F.col("size")).select("file", "at.block", "at.n")
    return row.select("file", "at.block", "at.n", "value").join(torn, ["file", "block", "n"], "left_anti").select("file", "value")


def last_complete_lines(spark: SparkSession, path: str) -> DataFrame:
    """Distinct non-blank lines of an append-only journal without torn ones: see :func:`journal_lines`."""
    return journal_lines(spark, path).select(F.col("value").alias("url")).filter("trim(url) <> ''").distinct()


def append_lines(urls: DataFrame, folder: str) -> None:
    """Add ``urls(url)`` that the journal ``folder`` doesn't have, as files of their own.

    Lines already there aren't touched, so a stopped call loses nothing and leaves no torn line of its own.
    A URL with a line feed can't be a line and is an error.
    """
    spark = urls.sparkSession
    checked = F.when(F.contains("url", F.lit("\n")), F.raise_error(F.lit("a line feed in a journal's line")).cast("string")).otherwise(F.col("url"))
    new = urls.filter("trim(url) <> ''").select(checked.alias("url")).distinct()
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        new = new.join(last_complete_lines(spark, folder), "url", "left_anti")
    written(new, "journal").select("url").write.mode("append").text(folder)


def occurrence(df: DataFrame, key: str, *order: str) -> DataFrame:
    """``nth``: 1-based occurrence of a key in order, for first-in-first-out matching."""
    return ranked_by(df, [key], [F.col(c) for c in order], "nth")
