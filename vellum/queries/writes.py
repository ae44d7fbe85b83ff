"""What is committed, walked to a cap, or read from bytes: state after the library has written it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import exchange, linked, saving
from ..scratch import scratch
from ..sources import files, graph, store
from .base import load, query

_IMAGES = """i AS (SELECT l_orderkey AS k, (l_partkey % 4 <> 0) AS e, l_suppkey % 3 <> 0 AS m, l_orderkey % 2 = 0 AS c, l_partkey % 5 <> 0 AS v, l_linenumber % 3 <> 0 AS p, l_partkey % 31 <> 0 AS f FROM lineitem),
g AS (SELECT k, bool_and((e AND (m OR NOT c) AND v) OR f) AS ok FROM i GROUP BY k)"""


@query(f"""
WITH {_IMAGES}, o AS (SELECT o_orderkey AS k, o_orderkey % 3 = 0 AS moved, k % 2 = 0 AS again FROM orders),
d AS (SELECT o.k, moved, again FROM o JOIN g ON o.k = g.k AND ok)
SELECT k::VARCHAR AS slug, CASE WHEN again AND moved THEN 'manifest-versions/' || sha256('new' || k) || '.json' ELSE 'manifest.json' END AS manifest,
  CASE WHEN again AND moved THEN 'new' || k ELSE 'doc' || k END AS body FROM d""")
def q85_preserved_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "store")
    images = load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("slug"), F.expr("l_partkey % 4 <> 0").alias("exists"), F.expr("l_suppkey % 3 <> 0").alias("matched"),
        F.expr("l_orderkey % 2 = 0").alias("committed"), F.expr("l_partkey % 5 <> 0").alias("valid"), F.expr("l_linenumber % 3 <> 0").alias("pyramid_ok"), F.expr("l_partkey % 31 <> 0").alias("fetch_ok"))
    orders, k = load(spark, sf_dir, "orders"), F.col("o_orderkey")
    saving.preserve(spark, folder, images, orders.select(k.cast("string").alias("slug"), F.concat(F.lit("doc"), k).alias("body")))
    again = F.when(k % 3 == 0, "new").otherwise("doc")
    saving.preserve(spark, folder, images, orders.filter(k % 2 == 0).select(k.cast("string").alias("slug"), F.concat(again, k).alias("body")))
    return saving.active_documents(spark, folder)


@query("""
WITH c AS (SELECT doc_id, 'd' || doc_id AS dir FROM documents), e AS (SELECT doc_id, doc_id % 10 AS k FROM documents WHERE doc_id % 3 = 0)
SELECT dir, CASE WHEN e.doc_id IS NULL OR k = 0 THEN 'old' ELSE 't' || c.doc_id END AS title, CASE WHEN e.doc_id IS NULL OR k = 0 THEN '' ELSE 'n' END AS notes,
  CASE WHEN e.doc_id IS NULL OR k = 0 THEN 'A' ELSE 'x, Y' END AS tags FROM c LEFT JOIN e USING (doc_id)""")
def q86_saved_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, k = scratch(spark, "store"), F.col("doc_id")
    docs = load(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), "doc_id").alias("dir"))
    start = docs.select("dir", F.lit("").alias("manifest_url"), F.lit("old").alias("title"), F.lit("").alias("notes"), F.lit("A").alias("tags"))
    store.commit(spark, store.snapshot(spark, folder), {"catalogue": start})
    some = docs.filter(k % 3 == 0)
    good = some.select("dir", (k * 2).alias("ord"), F.concat(F.lit(" t"), "doc_id").alias("title"), F.lit("n ").alias("notes"), F.lit("x,Y, X").alias("tags"))
    late = some.select("dir", (k * 2 + 1).alias("ord"), F.repeat(F.lit("z"), 600).alias("title"), F.lit("").alias("notes"), F.lit("").alias("tags"))  # too long: the one before counts
    saving.save_edits(spark, folder, good.filter(k % 10 != 0).unionByName(late))
    return store.snapshot(spark, folder).read(spark, "catalogue", exchange.CATALOGUE).select("dir", "title", "notes", "tags")


@query("""
WITH b AS (SELECT doc_id, 'd' || doc_id AS dir, 'u' || doc_id AS url, CASE WHEN doc_id % 2 = 0 THEN 'mine' ELSE '' END AS title, CASE WHEN doc_id % 5 = 0 THEN 'seen' ELSE '' END AS notes FROM documents),
i AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'theirs' ELSE 'mine' END AS title, CASE WHEN doc_id % 4 = 0 THEN 'read' ELSE '' END AS notes, doc_id % 7 = 0 AS lost FROM documents),
m AS (SELECT b.title AS bt, b.notes AS bn, i.title AS it, i.notes AS inn, lost FROM b JOIN i USING (doc_id))
SELECT count(*) FILTER (NOT lost) AS bundles, count(*) FILTER (NOT lost AND (bt = '' OR (bn = '' AND inn <> ''))) AS catalogue_changes,
  count(*) FILTER (lost) + count(*) FILTER (NOT lost AND bt <> '' AND bt <> it) + count(*) FILTER (NOT lost AND bn <> '' AND inn <> '' AND bn <> inn) AS warnings, 2 AS versions FROM m""")
def q87_imported_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, k = scratch(spark, "store"), F.col("doc_id")
    docs = load(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), "doc_id").alias("dir"), F.concat(F.lit("u"), "doc_id").alias("manifest_url"))
    local = docs.select("dir", "manifest_url", F.when(k % 2 == 0, "mine").otherwise("").alias("title"), F.when(k % 5 == 0, "seen").otherwise("").alias("notes"), F.lit("").alias("tags"))
    store.commit(spark, store.snapshot(spark, folder), {"catalogue": local})
    there = docs.select("doc_id", F.when(k % 7 == 0, F.concat(F.lit("x"), "dir")).otherwise(F.col("dir")).alias("dir"), F.when(k % 7 == 0, "").otherwise(F.col("manifest_url")).alias("manifest_url"))
    written = there.select("dir", "manifest_url", F.when(k % 3 == 0, "theirs").otherwise("mine").alias("title"), F.when(k % 4 == 0, " read").otherwise("").alias("notes"), F.lit("").alias("tags"))
    lines = exchange.export(written, spark.createDataFrame([], exchange.ANNOTATIONS).select("dir", "ord", "body")).select("value")
    made = exchange.import_archive(spark, folder, exchange.archive_of(lines, most=1 << 40), spark.createDataFrame([], "doc string, canvas string"))
    return made.report().select("bundles", "catalogue_changes", "warnings", F.lit(store.snapshot(spark, folder).version).alias("versions"))


@query("""
WITH l AS (SELECT o_custkey AS k, o_orderkey AS n FROM orders), r AS (SELECT k, n, row_number() OVER (PARTITION BY k ORDER BY n) AS place FROM l)
SELECT k::VARCHAR AS key, 'https://x/' || n AS url, place, place > 12 AS over FROM r WHERE place <= 13""")
def q88_capped_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference = F.struct(F.concat(F.lit("https://x/"), "o_orderkey").alias("id"))
    pages = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", reference.alias("r")))).alias("s"))
    docs = pages.select(F.col("o_custkey").cast("string").alias("key"), F.to_json(F.struct(F.transform("s", lambda x: x["r"]).alias("seeAlso"))).alias("body"))
    none = spark.createDataFrame([], "url string, body string")
    return linked.closure(docs, none, "key", "body", limit=12).select("key", "url", "place", "over")


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 5 < 3 THEN 1 + p_partkey % 4000 END AS width, CASE WHEN p_partkey % 5 < 3 THEN 1 + p_size * 7 END AS height FROM part""")
def q89_jpeg_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    number = lambda n: F.lpad(F.hex(n.cast("long")), 4, "0")
    frame = F.concat(F.lit("FFC0001108"), number(1 + F.col("p_size") * 7), number(1 + k % 4000), F.lit("03011100021100031100"))
    thumbnail = F.lit("FFE1000DFFC000080800010001")  # a frame header inside a segment
    bad = F.when(k % 5 == 3, F.concat(F.lit("FFD8"), thumbnail, F.lit("0001FFD9"))).otherwise(F.concat(F.lit("FFD8"), F.substring(frame, 1, 20)))
    body = F.when(k % 5 == 0, F.concat(F.lit("FFD8"), frame)).when(k % 5 == 1, F.concat(F.lit("FFD8"), thumbnail, F.lit("0001"), frame)).when(
        k % 5 == 2, F.concat(F.lit("FFD8FFFF"), F.substr(F.regexp_replace(frame, "^FFC0", "FFC2"), F.lit(3)))).otherwise(bad)
    sized = load(spark, sf_dir, "part").select("p_partkey", files.jpeg_size(F.unhex(body)).alias("s"))
    return sized.select("p_partkey", "s.width", "s.height")


@query("""
SELECT 'n' || n_regionkey AS parent, CASE WHEN n_nationkey % 3 = 0 THEN 'm' ELSE 'c' END || n_nationkey AS child, CASE WHEN n_nationkey % 3 = 0 THEN 'manifest' ELSE 'collection' END AS kind
FROM nation WHERE n_nationkey % 7 <> 0
UNION ALL SELECT 'k' || c_nationkey, 'x' || c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'manifest' ELSE 'collection' END FROM customer""")
def q90_collection_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, customer = load(spark, sf_dir, "nation").withColumn("k", F.col("n_nationkey")), load(spark, sf_dir, "customer")
    old = nation.groupBy("n_regionkey").agg(
        F.collect_list(F.when((F.col("k") % 3 == 0) & (F.col("k") % 7 != 0), F.struct(F.concat(F.lit("m"), "k").alias("@id")))).alias("manifests"),
        F.collect_list(F.when((F.col("k") % 3 != 0) & (F.col("k") % 7 != 0), F.struct(F.concat(F.lit("c"), "k").alias("@id"), F.lit("sc:Collection").alias("@type")))).alias("members"),
        F.collect_list(F.when(F.col("k") % 7 == 0, F.struct(F.lit("other").alias("id"), F.lit("Range").alias("type")))).alias("items"))
    kind = F.when(F.col("c_custkey") % 2 == 0, "Manifest").otherwise("Collection")
    new = customer.groupBy("c_nationkey").agg(F.collect_list(F.struct(F.concat(F.lit("x"), "c_custkey").alias("id"), F.lit("no").alias("@id"), kind.alias("type"))).alias("items"))
    docs = old.select(F.concat(F.lit("n"), "n_regionkey").alias("url"), F.to_json(F.struct("manifests", "members", "items")).alias("body")).unionByName(
        new.select(F.concat(F.lit("k"), "c_nationkey").alias("url"), F.to_json(F.struct("items")).alias("body")))
    return graph.references(docs).select("parent", "child", "kind")


@query("""
SELECT user_id::VARCHAR AS url FROM events WHERE user_id IS NOT NULL GROUP BY user_id""")
def q91_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "journal")
    urls = load(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("url"), F.col("user_id").alias("n"))
    graph.append_lines(urls.filter("n % 3 <> 0").select("url"), folder)
    graph.append_lines(urls.select("url"), folder)  # takes in what isn't there
    return graph.journal_lines(spark, folder).select(F.col("value").alias("url"))


@query("""
SELECT doc_id, CASE WHEN strlen(text) > 8192 THEN 'body too large' END AS deletion, CASE WHEN 40 * strlen(text) > 65536 THEN 'body too large' END AS edit FROM documents""")
def q102_body_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select(
        "doc_id", saving.body_error(F.col("text"), "deletion").alias("deletion"), saving.body_error(F.repeat("text", F.lit(40)), "edit").alias("edit"))


@query("""
WITH n AS (SELECT conv_id, turn, 'a' || conv_id AS id FROM conversations),
l AS (SELECT * FROM n WHERE turn = 0 AND conv_id % 3 = 0), i AS (SELECT * FROM n WHERE turn = 0 AND conv_id % 2 = 0)
SELECT count(*) FILTER (l.id IS NULL AND i.id IS NOT NULL) AS added, count(*) FILTER (l.id IS NOT NULL AND i.id IS NOT NULL) AS duplicates, count(l.id) + count(*) FILTER (l.id IS NULL AND i.id IS NOT NULL) AS stored
FROM l FULL JOIN i USING (conv_id)""")
def q103_imported_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, k = scratch(spark, "store"), F.col("conv_id")
    notes = load(spark, sf_dir, "conversations").filter("turn = 0").select(
        "conv_id", F.concat(F.lit("d"), k % 20).alias("dir"), k.cast("long").alias("ord"), F.concat(F.lit("a"), k).alias("id"), F.lit("https://x/c").alias("canvas"))
    body = F.to_json(F.struct("id", F.concat("canvas", F.lit("#xywh=1,1,2,2")).alias("target")))
    notes = notes.withColumn("body", body)
    folders = spark.range(20).select(F.concat(F.lit("d"), "id").alias("dir"), F.lit("").alias("manifest_url"), F.lit("").alias("title"), F.lit("").alias("notes"), F.lit("").alias("tags"))
    columns = ["dir", "ord", "id", "canvas", "body"]
    store.commit(spark, store.snapshot(spark, folder), {"catalogue": folders, "annotations": notes.filter(k % 3 == 0).select(*columns)})
    lines = exchange.export(folders, notes.filter(k % 2 == 0).select("dir", "ord", "body")).select("value")
    made = exchange.import_archive(spark, folder, exchange.archive_of(lines, most=1 << 40), spark.createDataFrame([], "doc string, canvas string")).report()
    there = store.snapshot(spark, folder).read(spark, "annotations", exchange.ANNOTATIONS).agg(F.count("*").alias("stored"))
    return made.join(there).select(F.col("annotations_added").alias("added"), "duplicates", "stored")  # one row each
