"""Audits, tallies, reconciliation, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tiles
from ..operators import audit as A
from ..operators import items, library
from ..operators import linked as L
from ..scratch import spread, written
from ..sources import ingest
from .base import load, query


@query("""
WITH l AS (SELECT l_orderkey % 50 AS bundle, l_orderkey || '/' || l_partkey AS url, CASE l_partkey % 3 WHEN 0 THEN 'annotation' WHEN 1 THEN 'content' ELSE 'seeAlso' END AS kind,
  l_orderkey * 100000000 + l_partkey AS ord FROM lineitem)
SELECT bundle, kind, count(*) AS missing, arg_min(url, ord) AS first FROM l WHERE url NOT IN (SELECT l_orderkey || '/' || l_partkey FROM lineitem WHERE l_suppkey % 4 <> 0) GROUP BY ALL""")
def q36_missing_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("annotation", "content", "seeAlso")))
    links = load(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 50).alias("bundle"), F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string")).alias("url"),
        F.get(kinds, (F.col("l_partkey") % 3).cast("int")).alias("kind"), (F.col("l_orderkey") * 100000000 + F.col("l_partkey")).alias("ord"), "l_suppkey",
    )
    return A.missing_by_kind(links, links.filter("l_suppkey % 4 <> 0"), ["bundle"])


@query("""
WITH c AS (SELECT o_orderkey, o_orderkey % 3 AS stamp FROM orders), b AS (SELECT l_orderkey AS o_orderkey, min(l_orderkey % 4) AS stamp FROM lineitem GROUP BY l_orderkey)
SELECT coalesce(c.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'stale' WHEN c.o_orderkey IS NULL THEN 'missing' WHEN c.stamp <> b.stamp THEN 'changed' ELSE 'same' END AS state
FROM c FULL JOIN b ON c.o_orderkey = b.o_orderkey""")
def q37_catalogue_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = load(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 3).alias("stamp"))
    there = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("stamp", F.col("o_orderkey") % 4)
    return A.reconcile(listed, there, "o_orderkey")


@query("""
WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'MATCH' WHEN o_orderkey % 10 <> 1 THEN 'NO-MATCH' END AS class, o_orderkey % 7 AS images, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 10 = 1 THEN 'e' END AS error FROM orders),
f AS (SELECT * FROM r ORDER BY o_orderkey LIMIT 500)
SELECT 'first 500' AS run, count(*) AS n, count(*) FILTER (class = 'MATCH') AS matched, sum(images)::BIGINT AS images, count(error) AS failures FROM f
UNION ALL SELECT 'all', count(*), count(*) FILTER (class = 'MATCH'), sum(images)::BIGINT, count(error) FROM r""")
def q38_crawl_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    results = load(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k % 3 == 0, "MATCH").when(k % 10 != 1, "NO-MATCH").alias("class"), (k % 7).alias("images"), F.when((k % 3 != 0) & (k % 10 == 1), "e").alias("error"))
    some = A.tally(A.first_results(results, "o_orderkey", 500)).withColumn("run", F.lit("first 500"))  # the limit is the operator (-max)
    return some.unionByName(A.tally(A.first_results(results, "o_orderkey", 0)).withColumn("run", F.lit("all")))


_LISTING = """CASE page_id % 4 WHEN 0 THEN 'h/' || page_id WHEN 1 THEN 'h/' || (page_id - 1) || '/nested' WHEN 2 THEN 'g/a/' || page_id ELSE 'g/a/' || (page_id - 1) || '/x/y' END"""


@query(f"""
WITH d AS (SELECT DISTINCT {_LISTING} AS dir, page_id % 4 IN (0, 2) OR (page_id - page_id % 2) NOT IN (SELECT page_id FROM pages) AS top, page_id % 5 <> 0 AS done FROM pages)
SELECT dir, done AS complete FROM d WHERE top""")
def q43_bundle_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirs = load(spark, sf_dir, "pages").select(F.expr(_LISTING).alias("dir"), (F.col("page_id") % 5 != 0).alias("done")).distinct()
    files = dirs.select("dir", F.explode(F.when(F.col("done"), F.array(F.lit("manifest.json"), F.lit("provenance.json"))).otherwise(F.array(F.lit("manifest.json")))).alias("file"))
    unfinished = A.incomplete(files).withColumn("c", F.lit(False))
    return A.topmost(dirs.select("dir"), "dir").join(unfinished, "dir", "left").select("dir", F.coalesce("c", F.lit(True)).alias("complete"))


@query("""
WITH d AS (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN sha256(text) WHEN 2 THEN sha256(text || 'x') ELSE sha256(text) END AS want FROM documents)
SELECT doc_id, want = '' OR want = sha256(text) AS digest_ok, strlen(text) <= 2000 AND doc_id % 3 <> 0 AS linked_ok, doc_id % 5 IN (0, 1) AS recognized FROM d""")
def q47_digest_and_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    digest = F.sha2(F.col("text").cast("binary"), 256)
    want = F.when(k % 4 == 0, "").when(k % 4 == 2, F.sha2(F.concat("text", F.lit("x")).cast("binary"), 256)).otherwise(digest)
    # documents that aren't JSON, each as long as its text
    body = F.when(k % 3 == 0, F.rpad(F.lit('{"a":'), F.greatest(F.octet_length("text"), F.lit(5)), F.lit(" "))).otherwise('{"a": 1}')
    types = F.array(*map(F.lit, ("AnnotationPage", "sc:AnnotationList", "Manifest", "sc:Canvas", "Annotation")))
    return load(spark, sf_dir, "documents").select(
        "doc_id", L.digest_ok(F.col("text"), want).alias("digest_ok"), ((F.octet_length("text") <= 2000) & L.valid_resource(body, F.lit("annotation"))).alias("linked_ok"),
        L.is_annotation_document(F.to_json(F.struct(F.get(types, (k % 5).cast("int")).alias("type")))).alias("recognized"),
    )


@query("""
WITH f AS (SELECT source, 'f' || (doc_id % 40) AS file, n_chars FROM documents),
d AS (SELECT source, file, count(*) - 1 AS extra FROM f GROUP BY ALL HAVING count(*) > 1),
b AS (SELECT source, sum(n_chars)::BIGINT AS bytes, count(*) AS files FROM f GROUP BY source)
SELECT b.source, bytes, files, coalesce(sum(extra), 0)::BIGINT AS repeated, coalesce(min(file), '') AS first, row_number() OVER (ORDER BY b.source) AS rn FROM b LEFT JOIN d ON b.source = d.source GROUP BY b.source, bytes, files""")
def q53_audit_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = load(spark, sf_dir, "documents").select("source", F.concat(F.lit("f"), F.col("doc_id") % 40).alias("file"), "n_chars")
    totals = files.groupBy("source").agg(F.sum("n_chars").cast("long").alias("bytes"), F.count("*").alias("files"))
    extra = A.repeated_files(files, "source", "file").groupBy("source").agg(F.sum("extra").cast("long").alias("repeated"), F.min("file").alias("first"))
    made = totals.join(extra, "source", "left").select("source", "bytes", "files", F.coalesce("repeated", F.lit(0)).cast("long").alias("repeated"), F.coalesce("first", F.lit("")).alias("first"))
    return made.withColumn("rn", F.row_number().over(Window.orderBy("source")).cast("long"))  # a row a source


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem),
f AS (SELECT l_orderkey, l_partkey % 5 AS k, min(rn) AS p FROM r GROUP BY ALL), o AS (SELECT l_orderkey, string_agg(k::VARCHAR, ',' ORDER BY p) AS ks FROM f GROUP BY l_orderkey)
SELECT l_orderkey, lpad(max(rn)::VARCHAR, 4, '0') AS last_name, ks AS distinct_in_order, min(l_partkey) FILTER (rn = 1) AS taster, count(*) FILTER (rn <= 3) AS capped, count(*) > 3 AS overflow
FROM r JOIN o USING (l_orderkey) GROUP BY l_orderkey, ks""")
def q56_ordinals_and_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").withColumn("k", F.col("l_partkey") % 5)
    made = items.capped(lines, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "l_partkey", "k", 3)
    return made.withColumn("distinct_in_order", F.array_join("distinct_in_order", ","))


@query("""
SELECT user_id % 20 AS run, count(DISTINCT user_id) AS manifests, count(DISTINCT user_id) FILTER (event_type = 'purchase') AS done,
 greatest(0, count(DISTINCT user_id) - count(DISTINCT user_id) FILTER (event_type = 'purchase')) AS pending, count(DISTINCT user_id) FILTER (event_type = 'error') AS failed FROM events GROUP BY ALL""")
def q57_ingest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = load(spark, sf_dir, "events").select(
        (F.col("user_id") % 20).alias("run"), F.col("user_id").alias("url"), (F.col("event_type") == "purchase").alias("done"), (F.col("event_type") == "error").alias("failed"))
    return ingest.status(seen, "run")


@query("""
WITH u AS (SELECT user_id, user_id % 20 AS run, bool_or(event_type = 'purchase') AS done, bool_or(event_type = 'error') AS failed FROM events GROUP BY user_id)
SELECT count(DISTINCT run) AS runs, count(*) FILTER (done) AS reused, count(*) FILTER (NOT done) AS pending, count(*) FILTER (failed) AS failed,
 (SELECT count(DISTINCT page_id) FROM pages WHERE page_id % 5 = 0) AS incomplete FROM u""")
def q63_ingest_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages").select(F.concat(F.lit("h/"), "page_id").alias("dir"), "page_id")
    names = F.when(F.col("page_id") % 5 == 0, F.array(F.lit("manifest.json"))).otherwise(F.array(F.lit("manifest.json"), F.lit("provenance.json")))
    total = ingest.status_total(q57_ingest_status(spark, sf_dir), A.incomplete(pages.select("dir", F.explode(names).alias("file"))))
    return total.select("runs", F.col("reused").cast("long"), F.col("pending").cast("long"), F.col("failed").cast("long"), "incomplete")


#: Descriptions with a tile profile that lacks a number.
_NO_WIDTH = '{"width":600,"height":400,"tiles":[{"height":5,"scaleFactors":[1,2]}]}'
_NO_FACTOR = '{"width":600,"height":400,"tiles":[{"width":5,"scaleFactors":[null]}]}'


def _library(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A library of one bundle per customer, with faults by the remainder of its key."""
    who = spread(load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("b/"), "c_custkey").alias("slug")), ["slug"])
    k = F.col("k")
    linked = F.array(F.struct(
        F.concat(F.lit("https://x/"), k).alias("url"), F.when(k % 13 == 5, "../up").otherwise("resources/r.json").alias("file"), F.lit("annotation").alias("kind"),
        F.sha2(F.when(k % 13 == 6, "other").otherwise("{}").cast("binary"), 256).alias("sha256")))
    image = lambda file, folder: F.struct(file.alias("file"), folder.alias("tile_dir"))
    provenance = F.to_json(F.struct(
        F.concat(F.lit("https://m/"), k).alias("manifest_url"), F.lit("").alias("manifest_file"),
        F.array(image(F.lit("i1.jpg"), F.lit("t1")), image(F.when(k % 13 == 7, "i1.jpg").otherwise("i2.jpg"), F.lit(""))).alias("images"),
        linked.alias("linked_resources"), F.when(k % 13 == 8, F.array(F.struct(F.lit("").alias("url"), F.lit("content").alias("kind"), F.lit("gone").alias("error")))).alias("linked_failures")))
    bundles = who.select(
        "slug", F.when(k % 13 == 1, '{"a":').otherwise("{}").alias("manifest"), F.when(k % 13 == 2, None).when(k % 13 == 3, "[").otherwise(provenance).alias("provenance"),
        F.when(k % 13 == 4, "nope").alias("annotations"))
    info = tiles.info_json(F.lit("t1"), F.lit(600).cast("long"), F.lit(400).cast("long"), 256)
    texts = who.select("slug", F.explode(F.array(
        F.struct(F.lit("resources/r.json").alias("file"), F.lit("{}").alias("body")), F.struct(F.lit("t1/info.json").alias("file"), F.when(k % 13 == 9, "{}").when(k % 26 == 13, _NO_WIDTH).when(k % 26 == 0, _NO_FACTOR).otherwise(info).alias("body")),
    )).alias("t")).select("slug", "t.*")
    promised = library.advertised(spark.range(1).select(F.lit("t1").alias("prefix"), info.alias("body")), ["prefix"]).select("file")
    plain = spark.createDataFrame([("i1.jpg",), ("i2.jpg",), ("resources/r.json",)], "file string")
    names = plain.union(promised)  # some twenty names
    files = who.join(F.broadcast(names)).filter("not (k % 13 = 10 and file = 'i1.jpg') and not (k % 13 = 11 and file like 't1/full/%')").select(
        "slug", "file", F.when((k % 13 == 12) & (F.col("file") == "i1.jpg"), 0).otherwise(10).alias("length"))
    links = who.select("slug", F.explode(F.array(F.struct(F.lit(0).alias("ord"), F.concat(F.lit("https://x/"), k).alias("url"), F.lit("annotation").alias("kind")), F.struct(
        F.lit(1).alias("ord"), F.when(k % 13 == 0, "https://y/z").otherwise(F.concat(F.lit("https://x/"), k)).alias("url"), F.lit("seeAlso").alias("kind")))).alias("l")).select("slug", "l.*")
    catalogue = who.filter("k % 17 <> 0").select(F.col("slug").alias("dir")).union(spark.createDataFrame([("b/none",)], "dir string"))
    return {"bundles": bundles, "files": files, "texts": texts, "links": links, "catalogue": catalogue}


@query("""
WITH c AS (SELECT c_custkey AS k, 'b/' || c_custkey AS s FROM customer), ok AS (FROM c WHERE k % 13 NOT IN (2, 3))
SELECT 'ERROR' AS severity, s || '/manifest.json' AS path, 'invalid JSON' AS message FROM c WHERE k % 13 = 1
UNION ALL SELECT 'ERROR', s || '/provenance.json', 'cannot read provenance' FROM c WHERE k % 13 = 2
UNION ALL SELECT 'ERROR', s || '/provenance.json', 'invalid provenance JSON' FROM c WHERE k % 13 = 3
UNION ALL SELECT 'ERROR', s || '/annotations.json', 'invalid JSON' FROM c WHERE k % 13 = 4
UNION ALL SELECT 'ERROR', s || '/provenance.json', 'linked resource 1 has an unsafe file path' FROM ok WHERE k % 13 = 5
UNION ALL SELECT 'ERROR', s || '/resources/r.json', 'SHA-256 does not match provenance' FROM ok WHERE k % 13 = 6
UNION ALL SELECT 'ERROR', s || '/provenance.json', 'repeated image file i1.jpg' FROM ok WHERE k % 13 = 7
UNION ALL SELECT 'WARN', s || '/provenance.json', 'unpreserved linked content: gone' FROM ok WHERE k % 13 = 8
UNION ALL SELECT 'ERROR', s || '/t1/info.json', 'invalid dimensions or no tiles' FROM ok WHERE k % 13 = 9
UNION ALL SELECT 'ERROR', s || '/t1/info.json', CASE WHEN k % 26 = 0 THEN 'invalid scale factor' ELSE 'invalid tile width' END FROM ok WHERE k % 13 = 0
UNION ALL SELECT 'ERROR', s || '/i1.jpg', 'missing or unreadable' FROM ok WHERE k % 13 = 10
UNION ALL SELECT 'ERROR', s || '/t1/full/' || z || '/0/default.jpg', 'missing or unreadable' FROM ok, (VALUES ('600,400'), ('300,200'), ('150,100')) v(z) WHERE k % 13 = 11
UNION ALL SELECT 'ERROR', s || '/i1.jpg', 'file is empty' FROM ok WHERE k % 13 = 12
UNION ALL SELECT 'WARN', s || '/manifest.json', '1 linked seeAlso not preserved, first https://y/z' FROM ok WHERE k % 13 = 0
UNION ALL SELECT 'WARN', 'catalogue', 'missing catalogue entry ' || s FROM c WHERE k % 17 = 0
UNION ALL SELECT 'WARN', 'catalogue', 'stale catalogue entry b/none'""")
def q64_library_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.problems(**_library(spark, sf_dir))


@query("""
WITH c AS (SELECT c_custkey AS k FROM customer), ok AS (FROM c WHERE k % 13 NOT IN (2, 3)),
n AS (SELECT (SELECT count(*) FROM c WHERE k % 13 IN (1, 2, 3, 4)) + (SELECT count(*) FROM ok WHERE k % 13 IN (0, 5, 6, 7, 9, 10, 12)) + 3 * (SELECT count(*) FROM ok WHERE k % 13 = 11) AS errors,
  (SELECT count(*) FROM ok WHERE k % 13 IN (0, 8)) + (SELECT count(*) FROM c WHERE k % 17 = 0) + 1 AS warnings)
SELECT (SELECT count(*) FROM c) AS bundles, 2 * (SELECT count(*) FROM ok) AS images, (SELECT count(*) FROM ok) AS pyramids, (SELECT count(*) FROM ok) AS linked, errors, warnings, errors = 0 AS healthy,
 (SELECT count(*) FROM ok WHERE k % 13 IN (0, 8)) AS reruns FROM n""")
def q65_audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _library(spark, sf_dir)
    read = library.parsed(held["bundles"])
    again = library.reruns(held["bundles"], held["links"], read).agg(F.count("*").alias("reruns"))
    found = written(library.problems(**held, provenance=read), "problems")
    return library.report(held["bundles"], found, read).join(again).select(
        "bundles", *[F.col(c).cast("long") for c in ("images", "pyramids", "linked", "errors", "warnings")], "healthy", "reruns")


