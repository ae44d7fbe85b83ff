"""Works: metadata, dates, languages, selection, labels, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import parse_date_range
from ..functions.language import parse_language
from ..jsontext import member_text, metadata_rows, text_of, title_of
from ..operators.images import canvas_ids, enumerate_images, first_string
from ..operators.linked import inventory
from ..operators.select import Filter, period_counts, work_records
from ..scratch import written
from .base import load, query

_LANGUAGES = ("French", " lat ", "english", "Deutsch", "italiano", "castellano", "GREEK", "Nederlands", "Klingon")
_CODES = "CASE o_orderkey % 9 WHEN 0 THEN 'fr' WHEN 1 THEN 'la' WHEN 2 THEN 'en' WHEN 3 THEN 'de' WHEN 4 THEN 'it' WHEN 5 THEN 'es' WHEN 6 THEN 'el' WHEN 7 THEN 'nl' END"
_START = """CASE o_orderkey % 8 WHEN 0 THEN y WHEN 1 THEN y WHEN 2 THEN y - 20 WHEN 3 THEN 1901 WHEN 4 THEN 1901
  WHEN 5 THEN 1801 WHEN 6 THEN NULL ELSE y END"""
_END = """CASE o_orderkey % 8 WHEN 0 THEN y WHEN 1 THEN y + 5 WHEN 2 THEN y + 20 WHEN 3 THEN 2000 WHEN 4 THEN 2000
  WHEN 5 THEN 1900 WHEN 6 THEN NULL ELSE y + 3 END"""


def _language_text(key: Column) -> Column:
    return F.get(F.array(*map(F.lit, _LANGUAGES)), (key % 9).cast("int"))


def _date_text(key: Column, year: Column) -> Column:
    y = year.cast("string")
    forms = [
        y, F.concat(y, F.lit("-"), (year + 5).cast("string")), F.concat(F.lit("Circa "), y), F.lit("20th  Century"),
        F.lit("XXe siècle"), F.lit("s. xix"), F.lit("undated"), F.concat((year + 3).cast("string"), F.lit(" – "), y, F.lit("\n")),
    ]
    return F.get(F.array(*forms), (key % 8).cast("int"))


def _rows(df: DataFrame, key: str, pos: Column, fields: dict[str, Column]) -> DataFrame:
    """Metadata rows ``(key, pos, label, value)`` from columns."""
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("label"), v.alias("value")) for i, (k, v) in enumerate(fields.items())])
    return df.select(key, pos.alias("base"), F.explode(cells).alias("c")).select(
        key, (F.col("base") * 10 + F.col("c.i")).alias("pos"), "c.label", "c.value"
    )


@query(f"""
WITH w AS (SELECT o_orderkey, year(o_orderdate) AS y, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
r AS (SELECT o_orderkey, {_CODES} AS langs, {_START} AS date_start, {_END} AS date_end, n_name AS origin FROM w)
SELECT o_orderkey, coalesce(langs, '') AS langs, date_start::INT AS date_start, date_end::INT AS date_end, origin,
  CASE WHEN (langs IS NULL OR langs IN ('fr', 'la')) AND (date_start IS NULL OR (date_start <= 1995 AND 1990 <= date_end))
    AND contains(lower(origin), 'nation_1') THEN 'MATCH' ELSE 'NO-MATCH' END AS class FROM r""")
def q01_classify_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"))
    placed = (
        orders.join(load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.expr("o_custkey = c_custkey"))
        .join(load(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.expr("c_nationkey = n_nationkey"))
    )
    key = F.col("o_orderkey")
    rows = _rows(placed, "o_orderkey", F.lit(0), {
        "Language ": _language_text(key), "Date Statement": _date_text(key, F.col("y")),
        "place of origin": F.col("n_name"), "Shelfmark": F.lit("x"),
    })
    made = work_records(rows, "o_orderkey")
    wanted = Filter(("fr", "la"), (1990, 1995), (" nation_1",))
    return made.select(
        "o_orderkey", F.array_join("langs", ",").alias("langs"), F.col("date.start").alias("date_start"),
        F.col("date.end").alias("date_end"), "origin", wanted.classify(F.col("langs"), F.col("date"), F.col("origin")).alias("class"),
    )


_ROMAN = "i ii iii iv v vi vii viii ix x xi xii xiii xiv xv xvi xvii xviii xix xx".split()


@query("""
WITH p AS (SELECT p_partkey, p_partkey % 9 AS f, (p_partkey // 9) % 20 + 1 AS n, 1000 + p_partkey % 900 AS y FROM part)
SELECT p_partkey,
 (CASE WHEN f IN (0, 1, 2) THEN (n - 1) * 100 + 1 WHEN f IN (3, 4) THEN y - 20 WHEN f = 5 THEN y WHEN f = 6 THEN y WHEN f = 7 THEN y - 3 END)::INT AS date_start,
 (CASE WHEN f IN (0, 1, 2) THEN n * 100 WHEN f IN (3, 4) THEN y + 20 WHEN f = 5 THEN y WHEN f = 6 THEN y + 7 WHEN f = 7 THEN y END)::INT AS date_end
FROM p""")
def q02_date_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.floor(F.col("p_partkey") / 9) % 20 + 1).cast("int")
    y = (1000 + F.col("p_partkey") % 900).cast("string")
    roman = F.get(F.array(*map(F.lit, _ROMAN)), n - 1)
    forms = [
        F.concat(n.cast("string"), F.lit("th century")), F.concat(F.upper(roman), F.lit("e Siècle")), F.concat(F.lit("siglo "), roman),
        F.concat(F.lit("c."), y), F.concat(F.lit("ca "), y), F.concat(F.lit("\t"), y, F.lit(" ")),
        F.concat(y, F.lit(" - "), (y.cast("int") + 7).cast("string")), F.concat(y, F.lit("—"), (y.cast("int") - 3).cast("string")),
        F.concat(F.lit("before "), y),
    ]
    text = F.get(F.array(*forms), (F.col("p_partkey") % 9).cast("int"))
    made = load(spark, sf_dir, "part").select("p_partkey", parse_date_range(text).alias("d"))
    return made.select("p_partkey", F.col("d.start").alias("date_start"), F.col("d.end").alias("date_end"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN NULL ELSE lang END AS code FROM documents""")
def q03_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    spellings = {
        "en": ("English", "eng", " EN\t", "en"), "fr": ("Français", "fre", "fra", "french"),
        "de": ("Deutsch", "ger", "deu", " german "), "es": ("Español", "espanol", "SPA", "castellano"),
    }
    text = F.when(F.lit(False), "")
    k = (F.col("doc_id") % 5).cast("int")
    for lang, names in spellings.items():
        text = text.when((F.col("lang") == lang) & (k < 4), F.get(F.array(*map(F.lit, names)), k))
    return load(spark, sf_dir, "documents").select("doc_id", parse_language(text.otherwise("volapük")).alias("code"))


@query("""
WITH w(name, lo, hi) AS (VALUES ('a', 1990, 1992), ('b', 1993, 1996), ('c', 1995, 1995), ('d', 1998, 2010), ('e', 1900, 1910)),
o AS (SELECT year(o_orderdate) AS s, year(o_orderdate) + o_orderkey % 3 AS e FROM orders)
SELECT name, count(s) AS works FROM w LEFT JOIN o ON s <= hi AND lo <= e GROUP BY name""")
def q04_interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = spark.createDataFrame(
        [("a", 1990, 1992), ("b", 1993, 1996), ("c", 1995, 1995), ("d", 1998, 2010), ("e", 1900, 1910)], "name string, lo int, hi int"
    )
    works = load(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("s"), (F.year("o_orderdate") + F.col("o_orderkey") % 3).alias("e"))
    return period_counts(works, windows, "name", ("s", "e"), ("lo", "hi")).select("name", "works")


@query("""
WITH w AS (SELECT p_partkey, 1700 + (p_partkey * 7919) % 330 AS lo, 1700 + (p_partkey * 7919) % 330 + CASE WHEN p_partkey % 50 = 0 THEN 400 ELSE p_size % 12 END AS hi FROM part),
o AS (SELECT CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE 1650 + (o_orderkey * 31) % 400 END AS s, 1650 + (o_orderkey * 31) % 400 + o_custkey % 60 AS e FROM orders),
g AS (SELECT s, e, count(*) AS n FROM o GROUP BY ALL)
SELECT p_partkey, lo, hi, (coalesce(sum(n) FILTER (s IS NOT NULL), 0) + (SELECT sum(n) FROM g WHERE s IS NULL))::BIGINT AS works
FROM w LEFT JOIN g ON s <= hi AND lo <= e GROUP BY ALL""")
def q84_works_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = 1700 + (F.col("p_partkey") * 7919) % 330
    periods = load(spark, sf_dir, "part").select(
        "p_partkey", at.alias("lo"), (at + F.when(F.col("p_partkey") % 50 == 0, 400).otherwise(F.col("p_size") % 12)).alias("hi"))
    start = 1650 + (F.col("o_orderkey") * 31) % 400
    works = load(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 97 != 0, start).alias("s"), (start + F.col("o_custkey") % 60).alias("e"))
    return period_counts(works, periods, "p_partkey", ("s", "e"), ("lo", "hi"))


@query("""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE lang END AS lang, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE n_name END AS place
  FROM documents JOIN nation ON doc_id % 25 = n_nationkey)
SELECT doc_id, lang IS NULL OR lang IN ('fr', 'de') AS lang_ok, place IS NULL OR contains(lower(place), '_1') AS place_ok FROM d""")
def q05_lenient_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("doc_id") % 25).alias("n_nationkey"))
    placed = docs.join(load(spark, sf_dir, "nation"), "n_nationkey")
    wanted = Filter(languages=("fr", "de"), places=("_1",))
    langs = F.when(F.col("doc_id") % 10 == 0, F.array().cast("array<string>")).otherwise(F.array("lang"))
    place = F.when(F.col("doc_id") % 7 != 0, F.col("n_name"))
    return placed.select("doc_id", wanted.language_ok(langs).alias("lang_ok"), wanted.origin_ok(place).alias("place_ok"))


@query(f"""
WITH w AS (SELECT o_custkey, o_orderkey, year(o_orderdate) AS y FROM orders),
r AS (SELECT o_custkey, o_orderkey, {_CODES} AS code, {_START} AS s, {_END} AS e FROM w),
f AS (SELECT o_custkey, code, min(o_orderkey) AS k FROM r WHERE code IS NOT NULL GROUP BY ALL),
l AS (SELECT o_custkey, string_agg(code, ',' ORDER BY k) AS langs FROM f GROUP BY o_custkey),
d AS (SELECT o_custkey, arg_max(s, o_orderkey) FILTER (s IS NOT NULL) AS date_start, arg_max(e, o_orderkey) FILTER (s IS NOT NULL) AS date_end FROM r GROUP BY o_custkey)
SELECT o_custkey, coalesce(langs, '') AS langs, date_start::INT AS date_start, date_end::INT AS date_end FROM d LEFT JOIN l USING (o_custkey)""")
def q06_records_by_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.year("o_orderdate").alias("y"))
    key = F.col("o_orderkey")
    rows = _rows(orders, "o_custkey", key, {"langue": _language_text(key), "century": _date_text(key, F.col("y"))})
    return work_records(rows, "o_custkey").select(
        "o_custkey", F.array_join("langs", ",").alias("langs"), F.col("date.start").alias("date_start"), F.col("date.end").alias("date_end")
    )


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 7 = 4 THEN cast(p_size AS VARCHAR) WHEN p_partkey % 7 = 6 THEN '' ELSE p_name END AS label FROM part""")
def q07_label_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit('"'), "p_name", F.lit('"'))
    forms = [
        name, F.concat(F.lit('{"@value":'), name, F.lit(',"@language":"xx"}')), F.concat(F.lit('{"fr":["autre"],"en":['), name, F.lit("]}")),
        F.concat(F.lit('[{"@value":"autre","@language":"fr"},{"@value":'), name, F.lit(',"@language":"en"}]')),
        F.col("p_size").cast("string"), F.concat(F.lit('{"none":["",'), name, F.lit('],"fr":["autre"]}')), F.lit("true"),
    ]
    raw = F.get(F.array(*forms), (F.col("p_partkey") % 7).cast("int"))
    return load(spark, sf_dir, "part").select("p_partkey", text_of(raw).alias("label"))


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(l_orderkey, manifest)``: a presentation document per order; even orders in the older shape."""
    key = F.col("l_orderkey").cast("string")
    lines = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("lines")
    )

    def canvas(i: Column) -> Column:
        return F.concat(F.lit("https://img.example/c/"), key, F.lit("/"), i + 1)

    def service(x: Column) -> Column:
        return F.concat(F.lit("https://img.example/s/"), x["l_partkey"], F.lit("/"), x["l_suppkey"])

    def old(x: Column, i: Column) -> Column:
        resource = F.struct(
            F.concat(service(x), F.lit("/full/full/0/default.jpg")).alias("@id"), F.lit(600).alias("width"), F.lit(400).alias("height"),
            F.when(x["l_partkey"] % 2 == 0, F.struct(service(x).alias("@id"))).alias("service"))
        return F.struct(
            canvas(i).alias("@id"), F.lit("sc:Canvas").alias("@type"), F.concat(F.lit("p. "), i + 1).alias("label"), F.array(F.struct(resource.alias("resource"))).alias("images"))

    def new(x: Column, i: Column) -> Column:
        body = F.struct(
            F.concat(service(x), F.lit("/full/max/0/default.jpg")).alias("id"), F.lit(600).alias("width"), F.lit(400).alias("height"),
            F.array(F.struct(service(x).alias("id"))).alias("service"))
        return F.struct(canvas(i).alias("id"), F.lit("Canvas").alias("type"), F.array(F.struct(F.array(F.struct(body.alias("body"))).alias("items"))).alias("items"))

    # one grouping; a document is built in its own shape alone
    text = F.when(
        F.col("l_orderkey") % 2 == 0,
        F.to_json(F.struct(F.lit("sc:Manifest").alias("@type"), F.array(F.struct(F.transform("lines", old).alias("canvases"))).alias("sequences"))),
    ).otherwise(F.to_json(F.struct(F.lit("Manifest").alias("type"), F.transform("lines", new).alias("items"))))
    return written(lines.select("l_orderkey", text.alias("manifest")), "manifests")  # documents are read from storage


@query("""
SELECT l_orderkey, rn AS ord, 'https://img.example/c/' || l_orderkey || '/' || rn AS canvas_id,
  'https://img.example/s/' || l_partkey || '/' || l_suppkey AS service_id, 600 AS width,
  CASE WHEN l_orderkey % 2 = 0 THEN 'p. ' || rn ELSE '' END AS label
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem)""")
def q08_manifest_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = enumerate_images(manifests(spark, sf_dir), "l_orderkey")
    return found.select("l_orderkey", F.col("ord").cast("long").alias("ord"), "canvas_id", "service_id", "width", member_text(F.col("label")).alias("label"))


@query("""
WITH f AS (SELECT l_orderkey, 'c' || (l_partkey % 5) AS c, min(l_linenumber * 1000000 + l_partkey) AS p FROM lineitem GROUP BY ALL),
g AS (SELECT l_orderkey, string_agg(c, ',' ORDER BY p) AS canvases FROM f GROUP BY l_orderkey)
SELECT l_orderkey, canvases, CASE l_orderkey % 4 WHEN 0 THEN 'cc-by' WHEN 1 THEN 'rights-' || l_orderkey WHEN 2 THEN 'attr' ELSE '' END AS license FROM g""")
def q09_license_and_canvases(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.concat(F.lit("c"), F.col("l_partkey") % 5).alias("c"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("p")
    )
    firsts = lines.groupBy("l_orderkey", "c").agg(F.min("p").alias("p")).groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("p", "c"))).alias("cs"))
    k = F.col("l_orderkey") % 4
    license_ = F.when(k == 0, F.lit('"cc-by"')).otherwise(F.lit('""'))
    rights = F.when(k == 1, F.concat(F.lit('["rights-'), "l_orderkey", F.lit('"]'))).otherwise(F.lit('{"en":["x"]}'))
    attribution = F.when(k == 2, F.lit('"attr"'))
    return firsts.select(
        "l_orderkey", F.array_join(F.transform("cs", lambda x: x["c"]), ",").alias("canvases"),
        first_string(license_, rights, attribution).alias("license"),
    )


@query("""
SELECT l_orderkey, count(*) AS canvases, min('https://img.example/c/' || l_orderkey || '/1') AS first, max(rn) AS last
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) GROUP BY l_orderkey""")
def q58_canvas_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = canvas_ids(manifests(spark, sf_dir), "l_orderkey")
    last = F.element_at(F.split(F.element_at("canvases", -1), "/"), -1)
    return found.select("l_orderkey", F.size("canvases").cast("long").alias("canvases"), F.get("canvases", F.lit(0)).alias("first"), last.cast("long").alias("last"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS title, 0 AS pos, 'Brand' AS label, p_brand AS value FROM part
UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END, 1, 'Size', p_size::VARCHAR FROM part""")
def q59_document_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    k = F.col("p_partkey") % 3
    label = F.when(k == 1, F.concat(F.lit(',"label":"'), "p_name", F.lit('"'))).when(k == 2, F.concat(F.lit(',"label":{"fr":["x"],"en":["'), "p_name", F.lit('"]}'))).otherwise("")
    entries = F.concat(
        F.lit('[{"label":"Brand","value":{"en":["'), "p_brand", F.lit('"]}},{"label":[{"@value":"Size","@language":"en"}],"value":'), F.col("p_size").cast("string"), F.lit('},{"label":" ","value":"x"}]'))
    docs = part.select("p_partkey", F.concat(F.lit('{"type":"Manifest"'), label, F.lit(',"metadata":'), entries, F.lit("}")).alias("manifest"))
    titles = docs.select("p_partkey", title_of(F.col("manifest")).alias("title"))
    return metadata_rows(docs, "p_partkey", "manifest").join(titles, "p_partkey").select("p_partkey", "title", "pos", "label", "value")


@query("""
WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN l_orderkey % 11 <> 0 THEN n END AS images, CASE WHEN l_orderkey % 11 <> 0 THEN l_orderkey % 3 END AS linked,
 CASE WHEN l_orderkey % 11 <> 0 THEN n || ' image(s), ' || l_orderkey % 3 || ' linked resource reference(s) (dry-run, not stored)' END AS line, CASE WHEN l_orderkey % 11 = 0 THEN 'not JSON' END AS error FROM c""")
def q104_dry_run_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey")
    links = F.transform(F.slice(F.array(F.lit(0), F.lit(1)), F.lit(1), (k % 3).cast("int")), lambda n: F.concat(F.lit("https://x/"), n))
    with_links = F.concat(F.regexp_replace("manifest", r"\}\z", ""), F.lit(',"seeAlso":'), F.to_json(links), F.lit("}"))
    docs = manifests(spark, sf_dir).select("l_orderkey", F.when(k % 11 == 0, "{").otherwise(with_links).alias("manifest"))
    return inventory(docs, "l_orderkey")
