"""Catalogue, annotations, comparisons, text helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.text import comparison_query, first_spellings, megabytes, or_else, resolve_store, result_line, shell_quote, split_list
from ..operators import annotations as N
from ..operators import catalogue as C
from ..operators import comparisons as K
from ..operators.annotations import by_canvas, to_open_annotation
from .base import load, query


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(conv_id, turn, id, target, motivation, value, format)`` from conversations; targets of three shapes."""
    canvas = F.concat(F.lit("https://x/canvas/"), "conv_id")
    full = F.concat(canvas, F.lit("#xywh="), "turn", F.lit(",0,1,1"))
    k = F.col("turn") % 3
    target = F.when(k == 0, F.to_json(F.struct(full.alias("source")))).when(k == 1, F.concat(F.lit('"'), full, F.lit('"'))).otherwise(
        F.to_json(F.struct(F.struct(full.alias("id")).alias("source"))))
    return load(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.concat(F.lit("a"), "turn").alias("id"), target.alias("target"),
        F.when(F.col("role") == "user", "commenting").when(F.col("turn") % 2 == 0, "sc:painting").otherwise("").alias("motivation"),
        F.md5(F.col("text").cast("binary")).alias("value"), F.when(F.col("turn") % 2 == 1, "text/html").otherwise("").alias("format"),
    )


@query("""
SELECT 'https://x/canvas/' || conv_id AS canvas, count(*) AS n, string_agg('a' || turn, ',' ORDER BY turn) AS ids FROM (SELECT DISTINCT conv_id, turn FROM conversations) GROUP BY conv_id""")
def q31_annotations_by_canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = annotations(spark, sf_dir).dropDuplicates(["conv_id", "turn"])
    return by_canvas(notes, "turn").select("canvas", "n", F.array_join("ids", ",").alias("ids"))


@query("""
SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'oa:commenting' WHEN turn % 2 = 0 THEN 'sc:painting' ELSE 'oa:commenting' END AS motivation,
 'https://x/canvas/' || conv_id || CASE WHEN turn % 3 = 1 THEN '#xywh=' || turn || ',0,1,1' ELSE '' END AS on, md5(text) AS chars, CASE WHEN turn % 2 = 1 THEN 'text/html' ELSE 'text/plain' END AS format FROM conversations""".replace(" AS on,", ' AS "on",'))
def q32_open_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_open_annotation(annotations(spark, sf_dir), ["conv_id", "turn"])


@query("""
WITH t AS (SELECT *, 'd' || lpad(doc_id::VARCHAR, 9, '0') AS dir, source || CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN ' Zèbre' WHEN 2 THEN ' zebra' WHEN 3 THEN ' éclair' WHEN 4 THEN ' Eclairs' ELSE '-öl' END AS name FROM documents),
c AS (SELECT doc_id, dir, lower(name) AS title, lang AS institution, n_chars AS pages FROM t WHERE contains(lower(source || ' t' || doc_id || ' ' || lang || ' tag ' || name), 'src1'))
SELECT doc_id, row_number() OVER (ORDER BY dir) AS by_path, row_number() OVER (ORDER BY title COLLATE en, dir) AS by_title, row_number() OVER (ORDER BY institution COLLATE en, dir) AS by_institution,
 row_number() OVER (ORDER BY pages DESC, title COLLATE en, dir) AS by_pages FROM c""")
def q35_catalogue_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 6
    tail = F.when(k == 0, "").when(k == 1, " Zèbre").when(k == 2, " zebra").when(k == 3, " éclair").when(k == 4, " Eclairs").otherwise("-öl")
    rows = load(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("dir"), F.concat(F.lit("t"), "doc_id").alias("source_title"),
        F.concat("source", tail).alias("title"), F.col("lang").alias("institution"), F.lit("—").alias("languages"), F.col("n_chars").alias("pages"), F.lit("").alias("notes"), F.lit("tag").alias("tags"))
    return C.ranks(C.search(rows, " SRC1 ")).select("doc_id", "by_path", "by_title", "by_institution", "by_pages")


@query("""
WITH s AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS docs FROM orders GROUP BY o_custkey),
v AS (SELECT o_custkey, docs FROM s WHERE len(docs) BETWEEN 2 AND 20), x AS (SELECT o_custkey, unnest(docs) AS d FROM v)
SELECT o_custkey, count(DISTINCT d) AS docs, coalesce(max(n), 0) AS conflicts FROM x LEFT JOIN
 (SELECT o_custkey, count(*) AS n FROM (SELECT o_custkey, d % 50 AS canvas FROM x GROUP BY ALL HAVING count(DISTINCT d) > 1) GROUP BY o_custkey) USING (o_custkey) GROUP BY o_custkey""")
def q40_comparison_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    picks = load(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("d"))
    sets = picks.groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n between 2 and 20").select("o_custkey")
    chosen = picks.join(sets, "o_custkey", "left_semi")
    owned = picks.select(F.col("d").alias("doc"), (F.col("d") % 50).alias("canvas"))
    shared = K.shared_canvases(chosen.select("o_custkey", F.col("d").alias("doc")), owned, "o_custkey")
    conflicts = shared.groupBy("o_custkey").agg(F.count("*").alias("conflicts"))
    docs = chosen.groupBy("o_custkey").agg(F.count_distinct("d").alias("docs"))
    return docs.join(conflicts, "o_custkey", "left").select("o_custkey", "docs", F.coalesce("conflicts", F.lit(0)).cast("long").alias("conflicts"))


@query("""
WITH m AS (SELECT o_custkey % 3000 AS s, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey % 3000 ORDER BY o_orderkey) - 1 AS pos FROM orders),
d AS (SELECT *, CASE WHEN k % 41 = 0 THEN '../x' WHEN k % 29 = 0 THEN 'd/0' ELSE 'd/' || k END AS doc, CASE WHEN k % 31 = 0 THEN 'other' WHEN k % 2 = 0 THEN 'c' || (k % 40) ELSE '' END AS canvas FROM m),
o AS (SELECT DISTINCT 'd/' || o_orderkey AS doc, 'c' || (o_orderkey % 40) AS canvas FROM orders WHERE o_orderkey % 7 <> 0),
x AS (SELECT s, count(*) AS n FROM (SELECT s, o.canvas FROM (SELECT DISTINCT s, doc FROM d) JOIN o USING (doc) GROUP BY ALL HAVING count(*) > 1) GROUP BY s),
g AS (SELECT s, count(*) AS docs, count(DISTINCT d.doc) AS u, bool_or(d.doc = '../x') AS unsafe, count(*) FILTER (d.doc NOT IN (SELECT doc FROM o)) AS unknown,
  count(*) FILTER (d.canvas <> '' AND (d.doc, d.canvas) NOT IN (SELECT (doc, canvas) FROM o)) AS strangers FROM d GROUP BY s)
SELECT s, docs, CASE WHEN docs NOT BETWEEN 2 AND 4 THEN 'number of documents' WHEN unsafe THEN 'unsafe document' WHEN u < docs THEN 'repeated document' WHEN unknown > 0 THEN 'unknown document'
  WHEN n > 0 THEN 'canvas of two documents' WHEN strangers > 0 THEN 'canvas of another document' END AS error FROM g LEFT JOIN x USING (s)""")
def q66_comparison_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    orders = load(spark, sf_dir, "orders").select((F.col("o_custkey") % 3000).alias("s"), "o_orderkey")
    members = orders.select(
        "s", k.alias("pos"), F.when(k % 41 == 0, "../x").when(k % 29 == 0, "d/0").otherwise(F.concat(F.lit("d/"), k)).alias("doc"),
        F.when(k % 31 == 0, "other").when(k % 2 == 0, F.concat(F.lit("c"), k % 40)).otherwise("").alias("canvas"))
    owned = orders.filter(k % 7 != 0).select(F.concat(F.lit("d/"), k).alias("doc"), F.concat(F.lit("c"), k % 40).alias("canvas"))
    return K.selections(members, owned, owned, "s")


@query("""
WITH s AS (SELECT 'Name ' || (c_custkey % 40) AS name FROM customer WHERE c_custkey < 20),
n AS (SELECT p_partkey AS ord, CASE WHEN p_partkey % 11 = 0 THEN ' ' WHEN p_partkey % 13 = 0 THEN repeat('x', 201) ELSE 'NAME ' || (p_partkey % 150) END AS name FROM part),
j AS (SELECT *, lower(trim(name)) AS k, length(trim(name)) BETWEEN 1 AND 200 AS ok FROM n),
e AS (SELECT *, CASE WHEN NOT ok THEN 'name' WHEN k IN (SELECT lower(name) FROM s) OR ord > min(ord) OVER (PARTITION BY k) THEN 'exists' END AS e FROM j),
r AS (SELECT *, count(*) FILTER (e IS NULL) OVER (ORDER BY ord) AS nth FROM e)
SELECT ord, CASE WHEN e IS NULL AND nth > 100 - (SELECT count(*) FROM s) THEN 'full' ELSE e END AS error FROM r""")
def q67_comparison_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = load(spark, sf_dir, "customer").filter("c_custkey < 20").select(F.concat(F.lit("Name "), F.col("c_custkey") % 40).alias("name"))
    k = F.col("p_partkey")
    name = F.when(k % 11 == 0, " ").when(k % 13 == 0, F.repeat(F.lit("x"), F.lit(201))).otherwise(F.concat(F.lit("NAME "), k % 150))
    return K.added(store, load(spark, sf_dir, "part").select(k.alias("ord"), name.alias("name")), "ord").select("ord", "error")


@query("""
WITH c AS (SELECT o_orderkey AS k, 's' || (o_orderkey % 3) || CASE WHEN o_orderkey % 11 = 0 THEN ':-' ELSE '' END AS stamp FROM orders),
b AS (SELECT DISTINCT l_orderkey AS k, 's' || (l_orderkey % 4) || CASE WHEN l_orderkey % 5 = 0 THEN ':-' ELSE '' END AS stamp FROM lineitem),
j AS (SELECT coalesce(c.k, b.k) AS k, c.k IS NOT NULL AS had, b.k IS NOT NULL AS here, c.stamp AS was, b.stamp AS now, b.k % 5 = 0 AS half FROM c FULL JOIN b ON c.k = b.k),
s AS (SELECT *, CASE WHEN had AND here AND (half OR was = now) THEN 'same' WHEN had AND here THEN 'changed' WHEN had THEN 'removed' WHEN NOT half THEN 'added' END AS state FROM j)
SELECT k AS dir, CASE WHEN state IN ('same', 'removed') THEN was ELSE now END AS stamp, CASE WHEN had THEN 't' || k ELSE '' END AS title,
 CASE WHEN state IN ('same', 'removed') OR was = now THEN k * 10 END AS size, state FROM s WHERE state IS NOT NULL""")
def q68_catalogue_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    def stamp(key: str, by: int, half: int):
        return F.concat(F.lit("s"), F.col(key) % by, F.when(F.col(key) % half == 0, ":-").otherwise(""))

    listed = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("dir"), stamp("o_orderkey", 3, 11).alias("stamp"), F.lit(1).alias("pages"), F.concat(F.lit("t"), "o_orderkey").alias("title"), F.lit("").alias("notes"), F.lit("").alias("tags"),
        (F.col("o_orderkey") * 10).alias("size"))
    there = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("dir")).distinct().select("dir", stamp("dir", 4, 5).alias("stamp"), F.lit(2).alias("pages"))
    return C.refreshed(listed, there).select("dir", "stamp", "title", "size", "state")


@query("""
WITH e AS (SELECT event_id, user_id, event_type, CASE WHEN event_id % 17 = 0 THEN repeat('y', 501) ELSE ' T' || event_id || ' ' END AS t FROM events),
l AS (SELECT user_id, max(event_id) AS id FROM e WHERE event_id % 17 <> 0 GROUP BY user_id)
SELECT c_custkey AS dir, CASE WHEN id IS NULL THEN 'old' ELSE 'T' || id END AS title, CASE WHEN id IS NULL THEN 'x' WHEN event_type = 'view' THEN 'a, view' ELSE 'a, ' || event_type END AS tags
FROM customer LEFT JOIN l ON c_custkey = user_id LEFT JOIN e ON e.event_id = l.id""")
def q69_catalogue_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalogue = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("dir"), F.lit("old").alias("title"), F.lit("").alias("notes"), F.lit("x").alias("tags"))
    k = F.col("event_id")
    edits = load(spark, sf_dir, "events").select(
        F.col("user_id").alias("dir"), k.alias("ord"), F.when(k % 17 == 0, F.repeat(F.lit("y"), F.lit(501))).otherwise(F.concat(F.lit(" T"), k, F.lit(" "))).alias("title"), F.lit(" ").alias("notes"),
        F.concat(F.lit("a,, A,"), "event_type").alias("tags"))
    return C.edited(catalogue, edits).select("dir", "title", "tags")


@query("""
WITH e AS (SELECT event_id, user_id FROM events)
SELECT event_id AS ord, CASE WHEN event_id % 17 = 0 THEN 'too long' WHEN user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) THEN 'not found' ELSE 'saved' END AS outcome FROM e""")
def q70_edit_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalogue = load(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("dir"))
    k = F.col("event_id")
    edits = load(spark, sf_dir, "events").select(F.col("user_id").alias("dir"), k.alias("ord"), F.lit("t").alias("title"), F.lit("").alias("notes"), F.when(k % 17 == 0, F.repeat(F.lit("y"), F.lit(1001))).otherwise("").alias("tags"))
    return C.edit_outcomes(catalogue, edits).select("ord", "outcome")


@query("""
WITH s AS (SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN '' END AS title, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'src ' || c_custkey END AS src, c_nationkey FROM customer)
SELECT 'd/' || k AS dir, CASE WHEN coalesce(title, '') <> '' THEN title WHEN src <> '' THEN src ELSE 'd/' || k END AS title, CASE WHEN k % 5 = 0 THEN '—' ELSE 'host' || (k % 7) END AS institution,
 CASE WHEN k % 2 = 0 THEN 'la, fr' ELSE '—' END AS languages, k % 9 AS pages FROM s""")
def q71_catalogue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    bundles = load(spark, sf_dir, "customer").select(
        F.concat(F.lit("d/"), k).alias("dir"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("src "), k)).alias("source_title"), F.when(k % 5 == 0, "none").otherwise(F.concat(F.lit("https://host"), k % 7, F.lit("/m"))).alias("url"),
        F.when(k % 2 == 0, F.array(F.lit("la"), F.lit("fr"))).otherwise(F.array().cast("array<string>")).alias("langs"), (k % 9).alias("images"),
        F.when(k % 4 == 0, F.col("c_name")).when(k % 4 == 1, "").alias("title"), F.lit(None).cast("string").alias("notes"), F.lit(None).cast("string").alias("tags"), F.lit(0).alias("size"))
    return C.summary(bundles).select("dir", "title", "institution", "languages", "pages")


@query("""
SELECT conv_id, turn, 'a' || turn AS id, 'Annotation' AS type, 'https://x/canvas/' || conv_id AS canvas, md5(text) AS extra, count(*) OVER (PARTITION BY conv_id) AS items FROM (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY ALL)""")
def q72_annotation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = load(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    note = F.to_json(F.struct(
        F.concat(F.lit("a"), "turn").alias("id"), F.lit("Annotation").alias("type"), F.struct(F.concat(F.lit("https://x/canvas/"), "conv_id", F.lit("#t=1")).alias("source")).alias("target"),
        F.md5(F.col("text").cast("binary")).alias("mae")))
    items = made.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", note.alias("n")))), lambda x: x["n"]).alias("items"))
    none = F.lit(None).cast("string")
    empty = N.page(none)
    stored = items.select("conv_id", N.encoded(F.struct(empty["context"].alias("context"), F.lit("").alias("id"), empty["type"].alias("type"), F.col("items").alias("items"))).alias("text"))
    back = stored.select("conv_id", N.page(F.col("text")).alias("p")).select("conv_id", F.size("p.items").cast("long").alias("items"), F.explode("p.items").alias("note"))
    seen = back.withColumn("d", N.decoded(F.col("note")))
    return seen.select(
        "conv_id", F.regexp_extract("d.id", r"([0-9]+)", 1).cast("long").alias("turn"), "d.id", "d.type", N.canvas_id(F.col("d.target")).alias("canvas"), F.get_json_object("note", "$.mae").alias("extra"), "items")


@query("""
SELECT c_custkey, replace(c_name || '''s ' || c_mktsegment, '''', '''"''"''') AS q0, '''' || replace(c_name || '''s', '''', '''"''"''') || '''' AS quoted,
 CASE c_custkey % 3 WHEN 0 THEN 'MATCH ' || c_custkey WHEN 1 THEN 'NO-MATCH ' || c_custkey ELSE 'ERROR ' || c_custkey END AS line,
 c_mktsegment || '|b' AS parts, CASE WHEN c_custkey = 0 THEN '—' ELSE (round_even(c_custkey * 300000.0 / 1048576.0, 0))::BIGINT || ' MB' END AS size,
 'canvas=a%2F' || c_custkey || '&doc=' || c_custkey || '&doc=' || (c_custkey + 1) AS query FROM customer""".replace("replace(c_name || '''s ' || c_mktsegment, '''', '''\"''\"''') AS q0, ", ""))
def q44_text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    verdict = F.get(F.array(*map(F.lit, ("MATCH", "NO-MATCH", "ERROR"))), (key % 3).cast("int"))
    canvases = F.array(F.concat(F.lit("a/"), key), F.lit(""))
    docs = F.array(key.cast("string"), (key + 1).cast("string"))
    return load(spark, sf_dir, "customer").select(
        "c_custkey", shell_quote(F.concat("c_name", F.lit("'s"))).alias("quoted"), result_line(verdict, key).alias("line"),
        F.array_join(first_spellings(split_list(F.concat(F.lit(" "), "c_mktsegment", F.lit(", ,b,"), F.lower("c_mktsegment")))), "|").alias("parts"),
        megabytes(key * 300000).alias("size"),
        comparison_query(docs, canvases).alias("query"),
    )


_PATHS = """CASE page_id % 8 WHEN 0 THEN '' WHEN 1 THEN '/' || page_id WHEN 2 THEN '../x' WHEN 3 THEN 'a/../../b' WHEN 4 THEN 'a/../b/' || page_id WHEN 5 THEN '..' WHEN 6 THEN 'tiles' ELSE regexp_replace(url, '^https?://', '') END"""


@query(f"""
WITH p AS (SELECT page_id, {_PATHS} AS p FROM pages)
SELECT page_id, page_id % 8 IN (4, 6, 7) AS relative, page_id % 8 = 6 AS segment, starts_with(p, '/') OR p = '' AS rejected FROM p""")
def q45_path_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "pages").select("page_id", F.expr(_PATHS).alias("p"))
    return p.select(
        "page_id", U.safe_relative(F.col("p")).alias("relative"), U.single_segment(F.col("p")).alias("segment"),
        (F.startswith("p", F.lit("/")) | (or_else(F.col("p"), F.lit("/")) == "/")).alias("rejected"),
    )




@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '/h/f' || c_custkey WHEN c_custkey % 3 = 1 THEN '/abs' ELSE '/h/images' END AS store FROM customer""")
def q73_store_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    flag = F.when(k % 3 == 0, F.concat(F.lit("~/f"), k)).otherwise("")
    setting = F.when(k % 3 == 1, "/abs").when(k % 3 == 0, "~")
    return load(spark, sf_dir, "customer").select("c_custkey", resolve_store(flag, setting, F.lit("/h"), "images").alias("store"))
