"""Merges: identity matching, refresh gates, links, annotations, comparisons, commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import merge_tags
from ..operators import comparisons as K
from ..operators import merge as M
from ..sources.files import active
from .base import load, query


@query("""
WITH o AS (SELECT l_partkey, l_orderkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey) AS nth FROM lineitem WHERE l_orderkey % 2 = 0),
n AS (SELECT l_partkey, l_orderkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey) AS nth FROM lineitem WHERE l_orderkey % 2 = 1)
SELECT l_partkey, nth, o.l_orderkey AS old_order, n.l_orderkey AS new_order FROM o JOIN n USING (l_partkey, nth)""")
def q26_fifo_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey")
    old = lines.filter("l_orderkey % 2 = 0").withColumnRenamed("l_orderkey", "old_order")
    new = lines.filter("l_orderkey % 2 = 1").withColumnRenamed("l_orderkey", "new_order")
    return M.match_in_order(old, new, "l_partkey", ["old_order"], ["new_order"]).withColumn("nth", F.col("nth").cast("long"))


@query("""
SELECT l_partkey, count(*) AS lost FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT ALL SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N') GROUP BY l_partkey""")
def q27_refresh_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag")
    return M.lost(lines.filter("l_returnflag = 'A'"), lines.filter("l_returnflag = 'N'"), "l_partkey")


@query("""
SELECT o_custkey, o_orderkey, false AS kept FROM orders WHERE o_orderkey % 3 <> 0
UNION ALL SELECT o_custkey, o_orderkey, true FROM orders WHERE o_orderkey % 2 = 0 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 <> 0)""")
def q28_monotone_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return M.monotone_union(orders.filter("o_orderkey % 3 <> 0"), orders.filter("o_orderkey % 2 = 0"), "o_custkey")


@query(r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) AS path FROM pages),
a AS (SELECT DISTINCT regexp_extract(path, '^(https?://[^/]*/[a-d][^/]*)', 1) AS anchor FROM p WHERE page_id % 2 = 0 UNION SELECT DISTINCT regexp_extract(path, '^(https?://[^/]*)', 1) FROM p WHERE page_id % 3 = 0)
SELECT page_id, max_by(anchor, length(anchor)) AS anchor FROM p JOIN a ON anchor <> '' AND (path = anchor OR starts_with(path, anchor || '/')) GROUP BY page_id""")
def q29_prefix_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"\A([^?#]*)", 1).alias("path"))
    cut = lambda n, k: pages.filter(k).select(F.regexp_extract("path", n, 1).alias("anchor"))
    anchors = cut(r"\A(https?://[^/]*/[a-d][^/]*)", "page_id % 2 = 0").union(cut(r"\A(https?://[^/]*)", "page_id % 3 = 0")).filter("anchor <> ''")
    return M.longest_anchor(pages, anchors, "page_id", "path")


@query("""
WITH f AS (SELECT url, arg_max('resources/' || page_id, page_id) AS file FROM pages WHERE page_id % 2 = 0 GROUP BY url)
SELECT page_id, coalesce(file, p.url) || ' ' || p.url || 'x' || ' ' || coalesce(file, p.url) AS urls FROM pages p LEFT JOIN f ON p.url = f.url""")
def q30_localized_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    docs = pages.select("page_id", F.array("url", F.concat("url", F.lit("x")), "url").alias("urls"))
    files = pages.select("url", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("resources/"), "page_id")).otherwise("").alias("file"), F.col("page_id").alias("ord"))
    return M.replace_urls(docs, "page_id", "urls", files).select("page_id", F.array_join("urls", " ").alias("urls"))


@query("""
WITH l AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'good' ELSE '' END AS title, CASE WHEN doc_id % 4 = 0 THEN 'seen' ELSE '' END AS notes, 'A, b' AS tags
  FROM (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id)),
i AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'good' WHEN doc_id % 3 = 1 THEN lang ELSE ' ' END AS title, CASE WHEN doc_id % 5 = 0 THEN ' read ' WHEN doc_id % 5 = 1 THEN 'seen' END AS notes FROM documents),
m AS (SELECT doc_id, l.title AS lt, coalesce(trim(i.title), '') AS it, l.notes AS ln, coalesce(trim(i.notes), '') AS inn, l.doc_id IS NOT NULL AS here, i.doc_id IS NOT NULL AS there FROM l FULL JOIN i USING (doc_id)),
c AS (SELECT *, CASE WHEN here AND lt <> '' AND it <> '' AND lt <> it THEN 'title' END AS ct, CASE WHEN here AND ln <> '' AND inn <> '' AND ln <> inn THEN 'notes' END AS cn,
  here AND there AND ((lt = '' AND it <> '') OR (ln = '' AND inn <> '') OR doc_id % 2 = 1) AS changed FROM m)
SELECT doc_id, CASE WHEN here THEN CASE WHEN lt = '' THEN it ELSE lt END END AS title, CASE WHEN here THEN CASE WHEN ln = '' THEN inn ELSE ln END END AS notes,
 CASE WHEN here THEN CASE WHEN doc_id % 2 = 0 OR NOT there THEN 'A, b' ELSE 'A, b, c' END END AS tags, changed, concat_ws(' ', ct, cn) AS conflicts,
 CASE WHEN NOT here THEN 'missing' WHEN coalesce(ct, cn) IS NOT NULL THEN 'conflict' WHEN changed THEN 'changed' ELSE 'same' END AS status FROM c""")
def q33_research_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = load(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q")).select(
        "doc_id", F.when(F.col("q") == 1, "good").otherwise("").alias("title"),
        F.when(F.col("doc_id") % 4 == 0, "seen").otherwise("").alias("notes"), F.lit("A, b").alias("tags"))
    k, n = F.col("doc_id") % 3, F.col("doc_id") % 5
    incoming = load(spark, sf_dir, "documents").select(
        "doc_id", F.when(k == 0, "good").when(k == 1, F.col("lang")).otherwise(" ").alias("title"),
        F.when(n == 0, " read ").when(n == 1, "seen").alias("notes"), F.when(F.col("doc_id") % 2 == 0, "a, B").otherwise("c").alias("tags"))
    return M.merge_research(local, incoming, "doc_id").withColumn("conflicts", F.array_join("conflicts", " "))


@query("""
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Alpha, beta, Gamma' WHEN 1 THEN 'x' ELSE 'One, TWO' END AS tags FROM orders""")
def q34_tag_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    local = F.when(k == 0, "Alpha, beta,,alpha ").when(k == 1, "").otherwise("One")
    incoming = F.when(k == 0, "BETA,Gamma , ").when(k == 1, " x,X").otherwise("ONE, one ,TWO")
    return load(spark, sf_dir, "orders").select("o_orderkey", merge_tags(local, incoming).alias("tags"))


@query("""
WITH i AS (SELECT l_orderkey, (l_partkey % 4 <> 0) AS e, l_suppkey % 3 <> 0 AS m, l_orderkey % 2 = 0 AS c, l_partkey % 5 <> 0 AS v, l_linenumber % 3 <> 0 AS p, l_partkey % 11 <> 0 AS f FROM lineitem),
a AS (SELECT l_orderkey, CASE WHEN e AND (m OR NOT c) AND v THEN CASE WHEN p THEN 'skipped' ELSE 'repaired' END WHEN f THEN 'stored' ELSE 'failed' END AS action FROM i)
SELECT l_orderkey, count(*) FILTER (action = 'skipped') AS skipped, count(*) FILTER (action = 'repaired') AS repaired, count(*) FILTER (action = 'stored') AS stored,
 count(*) FILTER (action = 'failed') AS failed, bool_and(action <> 'failed') AS committed FROM a GROUP BY l_orderkey""")
def q39_preserve_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.expr("l_partkey % 4 <> 0").alias("exists"), F.expr("l_suppkey % 3 <> 0").alias("matched"), F.expr("l_orderkey % 2 = 0").alias("committed"),
        F.expr("l_partkey % 5 <> 0").alias("valid"), F.expr("l_linenumber % 3 <> 0").alias("pyramid_ok"), F.expr("l_partkey % 11 <> 0").alias("fetch_ok"),
    )
    return M.commit(M.preserve_actions(images), "l_orderkey")


@query("""
WITH i AS (SELECT 'Set ' || (o_orderkey % 400) AS name, min(o_orderkey) AS k, count(*) AS n FROM orders GROUP BY ALL),
l AS (SELECT 'SET ' || c_custkey AS name, c_custkey % 2 = 0 AS same FROM customer WHERE c_custkey < 300)
SELECT lower(i.name) AS name, CASE WHEN l.name IS NULL THEN 'added' WHEN l.same THEN 'duplicate' ELSE 'conflict' END AS outcome, k AS first, n FROM i LEFT JOIN l ON lower(i.name) = lower(l.name)""")
def q48_comparison_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    canvases = F.array(F.lit(""), F.lit(""))
    incoming = load(spark, sf_dir, "orders").select(
        F.concat(F.lit("Set "), F.col("o_orderkey") % 400).alias("name"), F.array(F.lit("a"), F.lit("b")).alias("docs"), canvases.alias("canvases"), F.col("o_orderkey").alias("ord"))
    local = load(spark, sf_dir, "customer").filter("c_custkey < 300").select(
        F.concat(F.lit(" SET "), "c_custkey").alias("name"), F.array(F.lit("a"), F.when(F.col("c_custkey") % 2 == 0, "b").otherwise("c")).alias("docs"), canvases.alias("canvases"))
    outcomes = K.merged(local, incoming, "ord").groupBy(F.lower("name").alias("name")).agg(
        F.min_by("outcome", "ord").alias("outcome"), F.min("ord").alias("first"), F.count("*").alias("n"))
    return outcomes.select("name", "outcome", "first", "n")


@query("""
WITH c AS (SELECT o_custkey AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, 'u' || o_orderkey AS url, 'd' || (o_orderkey % 50) AS dir FROM orders),
b AS (SELECT 'd' || (p_partkey % 30) AS dir, 'u' || p_partkey AS url FROM part),
u AS (SELECT url, max(dir) AS dir FROM b GROUP BY url), r AS (SELECT s, pos, coalesce(u.dir, (SELECT min(b.dir) FROM b WHERE b.dir = c.dir)) AS d FROM c LEFT JOIN u ON c.url = u.url)
SELECT s, string_agg(coalesce(d, '-'), ',' ORDER BY pos) AS docs, bool_and(d IS NOT NULL) AS complete FROM r GROUP BY s""")
def q74_comparison_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = load(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("s"), F.col("o_orderkey").alias("pos"), F.concat(F.lit("u"), "o_orderkey").alias("manifest_url"), F.concat(F.lit("d"), F.col("o_orderkey") % 50).alias("bundle_dir"))
    bundles = load(spark, sf_dir, "part").select(F.concat(F.lit("d"), F.col("p_partkey") % 30).alias("dir"), F.concat(F.lit("u"), "p_partkey").alias("manifest_url"))
    found = K.resolved(documents, bundles, "s")
    return found.select("s", F.array_join("docs", ",", "-").alias("docs"), "complete")


@query("""
WITH l AS (SELECT DISTINCT l_orderkey AS k, 'u' || (l_partkey % 9) AS url FROM lineitem), p AS (SELECT DISTINCT l_orderkey AS k, 'u' || (l_partkey % 9) AS url FROM lineitem WHERE l_suppkey % 3 = 0)
SELECT l.k, l.url, CASE WHEN p.k IS NOT NULL THEN 'f/' || l.url END AS file FROM l LEFT JOIN p USING (k, url)""")
def q75_linked_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("u"), F.col("l_partkey") % 9)
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), url.alias("url"), "l_suppkey")
    had = lines.filter("l_suppkey % 3 = 0").select("k", "url", F.concat(F.lit("f/"), "url").alias("file"), F.lit("").alias("sha256"))
    return M.reuse_linked(lines.select("k", "url").distinct(), had, ["k"]).select("k", "url", "file")


@query("""
WITH c AS (SELECT o_custkey, max(o_orderkey) AS active FROM orders GROUP BY o_custkey)
SELECT c_custkey, CASE WHEN active IS NULL OR active % 3 = 0 THEN 'manifest.json' ELSE 'manifest-versions/' || active || '.json' END AS manifest FROM customer LEFT JOIN c ON c_custkey = o_custkey""")
def q76_active_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    pointers = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("a"))
    name = F.when(F.col("a") % 3 == 0, F.concat(F.lit("../"), "a")).otherwise(F.concat(F.lit("manifest-versions/"), "a", F.lit(".json")))
    return active(load(spark, sf_dir, "customer").select("c_custkey"), pointers.select("c_custkey", name.alias("manifest")), "c_custkey")


@query("""
WITH g AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'add' WHEN 'purchase' THEN 'add' WHEN 'error' THEN 'delete' ELSE 'update' END AS op FROM events),
s AS (SELECT *, coalesce(last_value(CASE op WHEN 'add' THEN true WHEN 'delete' THEN false END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS there FROM g)
SELECT user_id, max(event_id) FILTER ((there OR op = 'add') AND op <> 'delete') AS value, arg_max(op <> 'delete', event_id) FILTER (there OR op = 'add') AS present, count(*) FILTER (NOT there AND op <> 'add') AS not_found FROM s GROUP BY user_id""")
def q49_edit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type").isin("signup", "purchase"), "add").when(F.col("event_type") == "error", "delete").otherwise("update")
    log = load(spark, sf_dir, "events").select("user_id", "event_id", op.alias("op"), F.col("event_id").alias("value"))
    return M.replay(log, ["user_id"], "event_id")


@query("""
WITH l AS (SELECT 'a' || conv_id || '-' || turn AS id, md5(text) AS body FROM conversations WHERE turn % 2 = 0),
i AS (SELECT CASE WHEN conv_id % 10 = 0 THEN '' ELSE 'a' || conv_id || '-' || turn END AS id, conv_id * 1000 + turn AS ord, CASE WHEN conv_id % 3 = 0 THEN 'other' ELSE md5(text) END AS body FROM conversations),
d AS (SELECT id, min(body) AS body FROM l GROUP BY id)
SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN i.id = '' THEN 'skipped' WHEN d.body IS NULL THEN 'added' WHEN d.body = i.body THEN 'duplicate' ELSE 'conflict' END AS outcome FROM i LEFT JOIN d USING (id)) GROUP BY outcome""")
def q50_archive_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    cv = load(spark, sf_dir, "conversations").select(
        F.concat(F.lit("a"), "conv_id", F.lit("-"), "turn").alias("id"), "conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("body"))
    local = cv.filter("turn % 2 = 0").select("id", "body")
    incoming = cv.select(
        F.when(F.col("conv_id") % 10 == 0, "").otherwise(F.col("id")).alias("id"), F.lit("c").alias("canvas"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.when(F.col("conv_id") % 3 == 0, "other").otherwise(F.col("body")).alias("body"))
    return M.merge_annotations(local, incoming, "ord").groupBy("outcome").agg(F.count("*").alias("n"))


@query("""
WITH c AS (SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS active, count(*) AS versions FROM orders GROUP BY o_custkey)
SELECT c_custkey, CASE WHEN active IS NULL THEN 'manifest.json' ELSE 'manifest-versions/' || sha256(active::VARCHAR) || '.json' END AS manifest, coalesce(versions, 0) AS versions,
 coalesce(versions, 0) % 2 = 1 AS changed FROM customer LEFT JOIN c ON c_custkey = o_custkey""")
def q52_active_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    pointers = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("active"), F.count("*").alias("n"))
    name = F.concat(F.lit("manifest-versions/"), F.sha2(F.col("active").cast("string").cast("binary"), 256), F.lit(".json"))
    versions = F.coalesce("n", F.lit(0)).cast("long")
    bundles = load(spark, sf_dir, "customer").select("c_custkey")
    named = active(bundles, pointers.select("c_custkey", name.alias("manifest")), "c_custkey")
    return named.join(pointers, "c_custkey", "left").select("c_custkey", "manifest", versions.alias("versions"), (versions % 2 == 1).alias("changed"))


