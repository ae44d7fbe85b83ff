"""Listings, settings, responses and the small helpers of stored state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tiles, urls
from ..operators import annotations, catalogue, items, localize
from ..operators.once import once
from ..scratch import spread
from ..sources import fetch, files, ingest
from .base import load, query


@query("""
SELECT 'problems' AS kind, p_partkey AS k, row_number() OVER (ORDER BY p_brand, p_partkey) AS place FROM part
UNION ALL SELECT 'comparisons', o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) FROM orders
UNION ALL SELECT 'bundles', c_custkey, row_number() OVER (ORDER BY 'b/' || c_custkey) FROM customer
UNION ALL SELECT 'failures', page_id, row_number() OVER (ORDER BY url || '#' || page_id) FROM pages""")
def q92_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = {
        "problems": load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("path"), F.col("p_partkey").alias("message")),
        "comparisons": load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("ord")),
        "bundles": load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("b/"), "c_custkey").alias("slug")),
        "failures": load(spark, sf_dir, "pages").select(F.col("page_id").alias("k"), F.concat("url", F.lit("#"), "page_id").alias("url")),
    }
    found = None
    for kind, df in rows.items():
        one = catalogue.placed(df, kind).select(F.lit(kind).alias("kind"), "k", "place")
        found = one if found is None else found.unionByName(one)
    return found


@query("""
SELECT doc_id % 50 AS k, max(CASE WHEN doc_id % 4 = 1 THEN doc_id END) AS value, count(*) FILTER (doc_id % 4 = 3) AS errors FROM documents GROUP BY doc_id % 50
HAVING max(CASE WHEN doc_id % 4 = 1 THEN doc_id END) IS NOT NULL OR count(*) FILTER (doc_id % 4 = 3) > 0""")
def q93_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, key = F.col("doc_id") % 4, F.concat(F.lit("k"), F.col("doc_id") % 50)
    line = F.when(k == 0, F.concat(F.lit(" # "), key, F.lit(" = 1"))).when(k == 1, F.concat(F.lit("\t"), key, F.lit("="), "doc_id", F.lit(" "))).when(k == 2, "  ").otherwise(F.concat(key, F.lit(" alone")))
    read = files.settings(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), line.alias("value")))
    number = F.regexp_extract(F.coalesce("key", "error"), r"k([0-9]+)", 1).cast("long")
    return read.groupBy(number.alias("k")).agg(F.max(F.col("value").cast("long")).alias("value"), F.count_if(F.col("error").isNotNull()).alias("errors"))


@query("""
SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'body' || page_id WHEN 1 THEN 'kept' || page_id END AS body,
 CASE page_id % 6 WHEN 2 THEN 'not found' WHEN 3 THEN 'status 503' WHEN 4 THEN 'html page' WHEN 5 THEN 'not modified, but not cached' END AS error, page_id % 6 IN (1, 5) AS from_cache FROM pages""")
def q94_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, url = F.col("page_id") % 6, F.concat(F.lit("https://x/"), "page_id")
    pages = load(spark, sf_dir, "pages").select("page_id")
    status = F.when(k == 0, 200).when(k.isin(1, 5), 304).when(k == 2, 404).when(k == 3, 503).otherwise(200)
    responses = pages.select(url.alias("url"), status.alias("status"), F.when(k == 4, "text/html").otherwise("application/json").alias("content_type"), F.concat(F.lit("body"), "page_id").alias("body"))
    cache = pages.filter(k == 1).select(url.alias("url"), F.concat(F.lit("kept"), "page_id").alias("body"))
    return fetch.outcomes(responses, cache).select(F.substring_index("url", "/", -1).cast("long").alias("page_id"), "body", "error", "from_cache")


@query("""
SELECT conv_id, turn FROM conversations WHERE conv_id % 7 = 3""")
def q95_notes_of_canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.concat(F.lit("https://x/c/"), F.col("conv_id") % 7)
    target = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(F.struct(at.alias("@id")).alias("source")))).otherwise(F.concat(F.lit('"'), at, F.lit('#xywh=1,2"')))
    notes = load(spark, sf_dir, "conversations").select("conv_id", "turn", target.alias("target"))
    return annotations.of_canvas(notes, "https://x/c/3").select("conv_id", "turn")


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'saved' ELSE 'now' END AS title, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'n' END AS notes, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 't' END AS tags FROM customer""")
def q96_reloaded_research(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = load(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("d"), "c_custkey").alias("dir"))
    now = who.select("c_custkey", "dir", F.lit("now").alias("title"), F.lit("n").alias("notes"), F.lit("t").alias("tags"))
    kept = who.filter("c_custkey % 3 = 0").select("dir", F.lit("saved").alias("title"), F.lit(None).cast("string").alias("notes"), F.lit("").alias("tags"))
    strange = spark.createDataFrame([("elsewhere", "x", "x", "x")], "dir string, title string, notes string, tags string")
    return catalogue.reloaded(now, kept.unionByName(strange)).select("c_custkey", "title", "notes", "tags")


@query("""
SELECT p_partkey, 'image-' || left(sha256(('s' || p_partkey)::BLOB || '\\x00'::BLOB || ('c' || p_size)::BLOB || '\\x00'::BLOB || p_size::VARCHAR::BLOB), 24) AS name,
 't/full/' || ((p_partkey + 3) // 4) || ',' || ((p_size + 3) // 4) || '/0/default.jpg' AS key, 'https://me/' || p_partkey AS id, p_size AS width FROM part""".replace("\\\\", "\\"))
def q97_names_and_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    info = tiles.info_json(F.lit("old"), size.cast("long"), size.cast("long"))
    part = spread(load(spark, sf_dir, "part").select("p_partkey", "p_size"), ["p_partkey"])
    # a description is made, and made again, once a row
    asked = once(once(part, "info", info), "asked", localize.with_request_id(F.col("info"), F.concat(F.lit("https://me/"), k)))
    return asked.select(
        "p_partkey", urls.refreshed_name(F.concat(F.lit("s"), k), F.concat(F.lit("c"), size), size).alias("name"), tiles.size_key(F.lit("t"), k, size, F.lit(4)).alias("key"),
        F.get_json_object("asked", "$.id").alias("id"), F.get_json_object("asked", "$.width").cast("int").alias("width"))


@query("""
WITH l AS (SELECT o_custkey AS run, o_orderkey % 7 AS url, o_orderkey FROM orders)
SELECT run, count(DISTINCT url) FILTER (url <> 0) AS done, (SELECT CASE WHEN c_custkey % 4 = 0 THEN 'new' WHEN c_custkey % 4 = 1 THEN 'mismatch' ELSE 'resumed' END FROM customer WHERE c_custkey = run) AS state
FROM l GROUP BY run HAVING count(*) FILTER (url <> 0) > 0""")
def q98_resumed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 7
    lines = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.when(k == 0, " \t").when(k < 4, F.concat(F.lit(" u"), k)).otherwise(F.concat(F.lit("u"), k, F.lit(" "))).alias("value"))
    done = ingest.completed(lines, by=("run",)).groupBy("run").agg(F.count("*").alias("done"))
    wanted = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("fingerprint"), F.concat(F.lit("q"), "c_custkey").alias("descriptor"))
    stored = wanted.filter("fingerprint % 4 <> 0").select("fingerprint", F.when(F.col("fingerprint") % 4 == 1, "other").otherwise(F.col("descriptor")).alias("descriptor"))
    return done.join(ingest.opened(wanted, stored), F.expr("run = fingerprint")).select("run", "done", "state")


@query("""
SELECT source AS dir, sum(n_chars)::BIGINT AS bytes, count(*) AS files, max((doc_id * 1000)::VARCHAR || '000/' || n_chars) AS last FROM documents GROUP BY source""")
def q99_folder_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = load(spark, sf_dir, "documents").select(F.col("source").alias("dir"), F.col("n_chars").alias("length"), F.timestamp_micros(F.col("doc_id") * 1000).alias("modified"))
    stamps = held.groupBy("dir").agg(F.max(files.stamp(F.col("modified"), F.col("length"))).alias("last"))
    return files.folder_sizes(held).join(stamps, "dir").select("dir", F.col("bytes").cast("long").alias("bytes"), "files", "last")


@query("""
WITH f AS (SELECT l_orderkey AS k, min(l_quantity) AS q FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey AS k, CASE WHEN q IS NOT NULL AND o_orderkey % 5 <> 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'Title' ELSE 'Library of Congress item' END END AS label,
 CASE WHEN q IS NOT NULL AND o_orderkey % 5 <> 0 THEN 'https://x/' || o_orderkey || '#canvas-0001' END AS canvas, CASE WHEN q IS NULL OR o_orderkey % 5 = 0 THEN 'no pages' END AS error,
 CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' 1900 ' ELSE 'a|b' END AS dates FROM orders LEFT JOIN f ON o_orderkey = k""")
def q100_derived_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, key = F.col("o_orderkey") % 3, F.col("o_orderkey")
    dates = items.text_values(F.when(k == 0, " ").when(k == 1, " 1900 ").otherwise('[" a ", "", "b"]'))
    known = load(spark, sf_dir, "orders").select(
        key.alias("k"), F.concat(F.lit("https://x/"), key).alias("at"), F.when(key % 2 == 0, "Title").otherwise("").alias("title"), dates.alias("dates"),
        F.array().cast("array<string>").alias("languages"), F.array().cast("array<string>").alias("rights"))
    lines = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_quantity").cast("int").alias("q")).filter("l_orderkey % 5 <> 0")
    found = lines.select(F.col("l_orderkey").alias("k"), F.lit(0).alias("grp"), F.lit(0).alias("pos"), F.lit("u").alias("url"), F.lit(None).cast("string").alias("info"), F.lit("image/jpeg").alias("mimetype"), (F.col("q") + 1).alias("width"), F.lit(3).alias("height"))
    made = items.derived_manifests(known, items.page_images(found, "k"), "k", "at")
    return made.join(known, "k").select(
        "k", F.get_json_object("manifest", "$.label").alias("label"), F.get_json_object("manifest", "$.sequences[0].canvases[0].@id").alias("canvas"), "error", F.array_join("dates", "|").alias("dates"))
