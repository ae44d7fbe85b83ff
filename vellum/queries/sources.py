"""Sources: trees, change streams, ledgers, caches, retries, schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.text import canonical_set
from ..operators import linked
from ..operators.localize import localize
from ..operators.profiles import HOSTS, Profile, mapping_rows, with_profile
from ..sources import fetch, files, graph, ingest
from .base import load, query


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation, customer = (load(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    parts = [
        region.select(F.lit("root").alias("parent"), name("r", "r_regionkey").alias("child"), F.lit("collection").alias("kind"), F.col("r_regionkey").cast("int").alias("pos")),
        nation.select(name("r", "n_regionkey").alias("parent"), name("n", "n_nationkey").alias("child"), F.lit("collection").alias("kind"), F.col("n_nationkey").cast("int").alias("pos")),
        customer.select(name("n", "c_nationkey").alias("parent"), name("c", "c_custkey").alias("child"), F.lit("manifest").alias("kind"), F.col("c_custkey").cast("int").alias("pos")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_EDGES = """e AS (SELECT 'root' AS parent, 'r' || r_regionkey AS child, 'collection' AS kind FROM region
  UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, 'collection' FROM nation
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'manifest' FROM customer)"""


@query(f"""
WITH RECURSIVE {_EDGES}, w AS (SELECT 'root' AS node, 'collection' AS kind, 0 AS depth
  UNION ALL SELECT child, e.kind, depth + 1 FROM w JOIN e ON parent = node WHERE w.kind = 'collection')
SELECT node AS manifest, depth FROM w WHERE kind = 'manifest'""")
def q10_collection_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.walk_tree(_tree(spark, sf_dir), "root").select("manifest", "depth")


@query(f"""
WITH RECURSIVE {_EDGES}, g AS (SELECT * FROM e UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'collection' FROM nation
  UNION ALL SELECT 'r' || (c_custkey % 5), 'c' || c_custkey, 'manifest' FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT 'root', '', 'collection'),
w AS (SELECT 'root' AS url, 'collection' AS kind UNION SELECT child, g.kind FROM w JOIN g ON parent = url WHERE child <> '')
SELECT count(*) FILTER (kind = 'collection') AS visited, 0::BIGINT AS pending, count(*) FILTER (kind = 'manifest') AS manifests, true AS complete FROM w""")
def q11_frontier_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, customer = load(spark, sf_dir, "nation"), load(spark, sf_dir, "customer")
    more = [
        nation.selectExpr("concat('n', n_nationkey) parent", "concat('r', n_regionkey) child", "'collection' kind", "0 pos"),
        customer.filter("c_custkey % 7 = 0").selectExpr("concat('r', c_custkey % 5) parent", "concat('c', c_custkey) child", "'manifest' kind", "0 pos"),
        spark.createDataFrame([("root", "", "collection", 9)], "parent string, child string, kind string, pos int"),
    ]
    edges = _tree(spark, sf_dir)
    for m in more:
        edges = edges.unionByName(m)
    seen = graph.walk_frontier(edges, "root")
    return graph.frontier_stats(seen, seen.filter("kind = 'collection'"))


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.create_map(*map(F.lit, ("signup", "Create", "view", "Update", "error", "Delete")))
    return load(spark, sf_dir, "events").select("event_id", "user_id", F.try_element_at(kinds, F.col("event_type")).alias("activity"))


_FIRST = """SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type IN ('signup', 'view') GROUP BY user_id"""


@query(_FIRST)
def q12_change_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.changed(activities(spark, sf_dir), "user_id", "event_id")


@query("""SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def q13_resumable_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return graph.not_done(orders.select("o_orderkey"), orders.filter("o_orderstatus = 'F'"), "o_orderkey")


@query("""SELECT doc_id, sha256(text) AS digest, doc_id = min(doc_id) OVER (PARTITION BY text) AS first FROM documents""")
def q14_content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.first_by_digest(load(spark, sf_dir, "documents"), "doc_id", "text")


@query("""
WITH s AS (SELECT user_id, list_sort(list_distinct(list(upper(event_type)))) AS l FROM events GROUP BY user_id)
SELECT user_id, len(l) AS n, sha256(array_to_string(list_transform(l, lambda x: lower(x)), chr(10))) AS fingerprint FROM s""")
def q15_canonical_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    spelled = F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.concat(F.lit(" "), "event_type", F.lit("\t")))
    sets = load(spark, sf_dir, "events").groupBy("user_id").agg(canonical_set(F.collect_set(spelled), fold=True).alias("l"))
    return sets.select("user_id", F.size("l").cast("long").alias("n"), F.sha2(F.array_join("l", "\n").cast("binary"), 256).alias("fingerprint"))


@query("""
SELECT 'pages' AS source, starts_with(lower(ltrim(left(html, 512))), '<!doctype html') OR starts_with(lower(ltrim(left(html, 512))), '<html') AS html, count(*) AS n FROM pages GROUP BY ALL
UNION ALL SELECT 'documents', doc_id % 9 = 0 OR starts_with(lower(ltrim(left(text, 512))), '<!doctype html') OR starts_with(lower(ltrim(left(text, 512))), '<html'), count(*) FROM documents GROUP BY ALL""")
def q16_html_interstitials(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages").select(F.lit("pages").alias("source"), U.looks_like_html(F.lit(None).cast("string"), F.col("html")).alias("html"))
    kind = F.when(F.col("doc_id") % 9 == 0, F.lit("Text/HTML; charset=utf-8")).otherwise("application/json")
    docs = load(spark, sf_dir, "documents").select(F.lit("documents").alias("source"), U.looks_like_html(kind, F.col("text")).alias("html"))
    return pages.unionByName(docs).groupBy("source", "html").agg(F.count("*").alias("n"))


@query(r"""
WITH u AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/]*/(.*)$', 1) AS rest FROM pages),
s AS (SELECT page_id, host, trim(regexp_replace(rest, '[^A-Za-z0-9._-]+', '_', 'g'), '_') AS slug FROM u)
SELECT page_id, host, host || '/' || slug AS dir, CASE WHEN host = 'tionsh.example.net' THEN 13000 ELSE 750 END AS min_interval_ms FROM s""")
def q17_store_dirs_and_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = with_profile(load(spark, sf_dir, "pages").select("page_id", "url"), "url", HOSTS | {"tionsh.example.net": Profile(interval_ms=13_000)})
    return pages.select("page_id", "host", U.store_dir(F.col("url")).alias("dir"), F.col("interval_ms").alias("min_interval_ms"))


_POLICY_URL = """CASE page_id % 6 WHEN 0 THEN 'http://OAI.bnf.fr/oai2/OAIHandler?verb=x' WHEN 1 THEN 'http://oai.bnf.fr:80/oai2/OAIHandler'
  WHEN 2 THEN 'http://u@oai.bnf.fr/oai2/OAIHandler' WHEN 3 THEN 'ftp://x/y' ELSE url END"""


@query(f"""
WITH u AS (SELECT page_id, {_POLICY_URL} AS u FROM pages)
SELECT page_id, CASE WHEN starts_with(u, 'https://') THEN 'ok' WHEN page_id % 6 = 0 THEN 'warned' ELSE 'refused' END AS policy, starts_with(u, 'http') AS absolute FROM u""")
def q18_url_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = load(spark, sf_dir, "pages").select("page_id", F.expr(_POLICY_URL).alias("u"))
    return u.select("page_id", U.scheme_policy(F.col("u")).alias("policy"), U.is_absolute(F.col("u")).alias("absolute"))


@query("""
WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 200 WHEN 1 THEN 429 WHEN 2 THEN 503 ELSE 404 END AS status, event_id % 3 + 1 AS attempt,
  CASE WHEN event_id % 7 = 0 THEN 0 WHEN event_id % 7 = 1 THEN 0 ELSE floor(value)::BIGINT END AS s FROM events)
SELECT event_id, CASE WHEN status IN (429, 503) AND attempt < 3 THEN CASE WHEN s BETWEEN 1 AND 86400 THEN s * 1000 ELSE 1000 * (1 << (attempt - 1)) END END::BIGINT AS delay_ms FROM e""")
def q19_retry_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 7
    header = F.when(k == 0, "Wed, 21 Oct 2015 07:28:00 GMT").when(k == 1, "90000").otherwise(F.concat(F.lit("+"), F.floor("value").cast("string")))
    header = F.when((k > 1) & (F.col("value") < 0), F.floor("value").cast("string")).otherwise(header)
    status = F.get(F.array(*map(F.lit, (200, 429, 503, 404))), (F.col("event_id") % 4).cast("int"))
    return load(spark, sf_dir, "events").select(
        "event_id", U.retry_delay_ms(status, header, F.col("event_id") % 3 + 1).cast("long").alias("delay_ms")
    )


@query("""
SELECT user_id, arg_max(event_type = 'view', event_id) AS not_modified, arg_max(event_id, event_id) FILTER (event_type <> 'view') AS body, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY user_id""")
def q20_conditional_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select(
        "user_id", "event_id", (F.col("event_type") == "view").alias("not_modified"),
        F.when(F.col("event_type") != "view", F.col("event_id")).alias("body"),
    )
    failures = load(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("failures"))
    return graph.latest(rows, "user_id", "event_id", "not_modified", "body").join(failures, "user_id")


@query(r"""
WITH p AS (SELECT page_id, url, page_id % 6 AS k, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, 'resources/' || sha256(url) || CASE k WHEN 0 THEN '.json' WHEN 1 THEN '.xml' WHEN 2 THEN '.xml'
  ELSE CASE WHEN regexp_matches(path, '\.[^./]{1,9}$') THEN lower(regexp_extract(path, '(\.[^./]*)$', 1)) WHEN k = 3 THEN '.json' ELSE '.bin' END END AS file FROM p""")
def q21_linked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    mimes = ("Application/LD+JSON; profile=x", " application/alto+xml ", "image/svg+xml", "", "image/png", "audio/mpeg")
    k = (F.col("page_id") % 6).cast("int")
    mime = F.get(F.array(*map(F.lit, mimes)), k)
    kind = F.when(k == 3, "annotation").otherwise("content")
    return load(spark, sf_dir, "pages").select("page_id", U.linked_file(F.col("url"), mime, kind).alias("file"))


_LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"


@query(f"""
WITH r AS (SELECT l_orderkey, row_number() OVER w AS rn, 'https://s/' || l_partkey AS s, CASE WHEN l_linenumber % 4 < 3 THEN l_linenumber % 4 END AS v,
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER})),
p AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pref FROM r)
SELECT l_orderkey, rn, CASE coalesce(pref, 0) WHEN 0 THEN s || '/full/max/0/default.jpg ' || s || '/full/full/0/default.jpg ' || s
  WHEN 1 THEN s || '/full/full/0/default.jpg ' || s || '/full/max/0/default.jpg ' || s ELSE s || ' ' || s || '/full/max/0/default.jpg ' || s || '/full/full/0/default.jpg' END AS candidates FROM p""")
def q22_image_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [c.strip() for c in _LINE_ORDER.split(",")]
    w = Window.partitionBy("l_orderkey").orderBy(*order)
    rows = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", *order, F.row_number().over(w).cast("long").alias("rn"),
        F.when(F.col("l_linenumber") % 4 < 3, F.col("l_linenumber") % 4).alias("v"),
    )
    service = F.concat(F.lit("https://s/"), "l_partkey", F.lit("//"))
    return fetch.preferred(rows, ["l_orderkey"], ["rn"], "v").select(
        "l_orderkey", "rn", F.array_join(U.image_candidates(service, F.coalesce("pref", F.lit(-1))), " ").alias("candidates")
    )


@query(r"""
SELECT page_id, 750 * (row_number() OVER (PARTITION BY regexp_extract(url, '://([^/?#]*)', 1) ORDER BY page_id) - 1) AS start_ms FROM pages""")
def q23_request_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages").select("page_id", U.host_of(F.col("url")).alias("host"))
    return fetch.schedule(pages.withColumn("interval_ms", F.lit(None).cast("int")), "page_id").select("page_id", "start_ms")


@query(_FIRST)
def q42_change_stream_streaming(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.changes import first_changes

    return first_changes(spark, f"{sf_dir}/events.parquet", ("signup", "view"), "event_type", "user_id", "event_id")


@query("""
SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events WHERE user_id IS NOT NULL GROUP BY user_id""")
def q101_last_rows_streaming(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.changes import last_rows

    return last_rows(spark, f"{sf_dir}/events.parquet", "user_id", "event_id", ["event_type"])


@query("""
WITH u AS (SELECT o_orderkey, o_orderkey % 5 AS k, CASE o_orderkey % 3 WHEN 0 THEN 403 WHEN 1 THEN 200 ELSE 404 END AS status FROM orders)
SELECT o_orderkey, CASE WHEN k IN (0, 1) AND status = 403 THEN 'derived' WHEN status = 200 THEN 'direct' ELSE 'error' END AS via,
 sha256(encode(CASE k WHEN 0 THEN 'https://www.loc.gov/item/' || o_orderkey || '/manifest.json' WHEN 1 THEN 'https://WWW.loc.gov/item/' || o_orderkey || '/manifest.json?x=1'
  WHEN 2 THEN 'https://www.loc.gov/item/a/' || o_orderkey || '/manifest.json' WHEN 3 THEN 'https://loc.gov/item/' || o_orderkey || '/manifest.json' ELSE 'https://www.loc.gov/item//manifest.json' END)
  || '\\x00'::BLOB || encode('body' || o_orderkey)) AS derivation FROM u""".replace("\\\\", "\\"))
def q46_item_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    forms = [
        F.concat(F.lit("https://www.loc.gov/item/"), key, F.lit("/manifest.json")), F.concat(F.lit("https://WWW.loc.gov/item/"), key, F.lit("/manifest.json?x=1")),
        F.concat(F.lit("https://www.loc.gov/item/a/"), key, F.lit("/manifest.json")), F.concat(F.lit("https://loc.gov/item/"), key, F.lit("/manifest.json")),
        F.lit("https://www.loc.gov/item//manifest.json"),
    ]
    asked = load(spark, sf_dir, "orders").select(
        "o_orderkey", F.get(F.array(*forms), (key % 5).cast("int")).alias("url"),
        F.get(F.array(*map(F.lit, (403, 200, 404))), (key % 3).cast("int")).alias("status"),
    )
    items = load(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("item"), F.concat(F.lit("body"), key).alias("body"))
    asked = asked.withColumn("body", F.concat(F.lit("body"), key))
    return fetch.item_fallback(asked, items, ["o_orderkey"]).select("o_orderkey", "via", "derivation")


@query("""
WITH a AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 'fail' WHEN event_type = 'view' THEN 'nomatch' ELSE 'stored' END AS r FROM events),
l AS (SELECT user_id, max(event_id) FILTER (r <> 'fail') AS ok FROM a GROUP BY user_id)
SELECT user_id, ok IS NOT NULL AS done, count(*) FILTER (r = 'fail' AND (ok IS NULL OR event_id > ok)) AS attempts,
 max(event_id) FILTER (r = 'fail' AND (ok IS NULL OR event_id > ok)) AS last_failure FROM a JOIN l USING (user_id) GROUP BY user_id, ok""")
def q55_crawl_disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "nomatch").otherwise("stored")
    log = load(spark, sf_dir, "events").select("user_id", "event_id", outcome.alias("outcome"), F.col("props").alias("message"))
    return ingest.failures(log, "user_id", "event_id").select("user_id", "done", "attempts", "last_failure")


@query("""
WITH j AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'view'), k AS (SELECT DISTINCT user_id FROM events WHERE event_type IN ('view', 'purchase'))
SELECT (SELECT count(*) FROM k WHERE user_id NOT IN (SELECT user_id FROM j)) AS added, (SELECT count(*) FROM (SELECT * FROM j UNION SELECT * FROM k)) AS total""")
def q54_ledger_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    urls = lambda kinds: events.filter(F.col("event_type").isin(*kinds)).select("user_id")
    both = ingest.migrated(urls(["view"]), urls(["view", "purchase"]), "user_id")
    return both.agg(F.count_if(F.col("added")).alias("added"), F.count("*").alias("total"))


@query("""
WITH RECURSIVE t AS (SELECT 'root' AS p, 'r' || r_regionkey AS c, r_regionkey AS pos, 'collection' AS kind FROM region
  UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, n_nationkey, 'collection' FROM nation
  UNION ALL SELECT 'r' || r_regionkey, 'n' || ((r_regionkey * 7 + 3) % 25), 100 + r_regionkey, 'collection' FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'root', 60, 'collection' FROM nation
  UNION ALL SELECT 'n' || n_nationkey, 'n' || (n_nationkey + 1), 50, 'collection' FROM nation WHERE n_nationkey % 5 = 0
  UNION ALL SELECT 'n' || c_nationkey, 'm' || (c_custkey % 200), 1000 + c_custkey, 'manifest' FROM customer),
w AS (SELECT 'root' AS node, []::INT[] AS path, ['root'] AS seen
  UNION ALL SELECT c, list_append(path, pos::INT), list_append(seen, c) FROM w JOIN t ON p = node WHERE kind = 'collection' AND NOT list_contains(seen, c)),
f AS (SELECT node, min(path) AS path FROM w GROUP BY node)
SELECT c AS manifest, len(path) + 1 AS depth, array_to_string(path, '.') || '.' || pos AS path FROM f JOIN t ON p = node WHERE kind = 'manifest'""")
def q77_shared_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation, customer = (load(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    parts = [
        region.selectExpr("'root' parent", "concat('r', r_regionkey) child", "'collection' kind", "r_regionkey pos"),
        nation.selectExpr("concat('r', n_regionkey) parent", "concat('n', n_nationkey) child", "'collection' kind", "n_nationkey pos"),
        region.selectExpr("concat('r', r_regionkey) parent", "concat('n', (r_regionkey * 7 + 3) % 25) child", "'collection' kind", "100 + r_regionkey pos"),
        nation.selectExpr("concat('n', n_nationkey) parent", "'root' child", "'collection' kind", "60 pos"),
        nation.filter("n_nationkey % 5 = 0").selectExpr("concat('n', n_nationkey) parent", "concat('n', n_nationkey + 1) child", "'collection' kind", "50 pos"),
        customer.selectExpr("concat('n', c_nationkey) parent", "concat('m', c_custkey % 200) child", "'manifest' kind", "cast(1000 + c_custkey as int) pos"),
    ]
    edges = parts[0]
    for part in parts[1:]:
        edges = edges.unionByName(part)
    found = graph.walk_tree(edges, "root")
    return found.select("manifest", F.col("depth").cast("long").alias("depth"), F.array_join(F.transform("path", lambda x: x.cast("string")), ".").alias("path"))


@query("""
WITH e AS (SELECT event_id, user_id, event_type, event_id // 500 AS page FROM events), l AS (SELECT max(page) - 2 AS bad FROM e)
SELECT user_id, min(event_id) AS event_id, NULL::VARCHAR AS error FROM e, l WHERE page < bad AND event_type IN ('signup', 'view') GROUP BY user_id
UNION ALL SELECT NULL, NULL, 'unreadable page p' || bad FROM l""")
def q78_paged_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.create_map(*map(F.lit, ("signup", "Create", "view", "Update", "error", "Delete", "click", "Other", "purchase", "Other")))
    events = load(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 500).cast("long").alias("page"), "event_id", "user_id", F.try_element_at(kinds, F.col("event_type")).alias("type"))
    last = events.agg(F.max("page")).first()[0]
    item = F.struct("event_id", F.struct(F.col("type").alias("type"), F.struct(F.concat(F.col("user_id").cast("string"), F.lit("")).alias("id"), F.lit("Manifest").alias("type")).alias("object")).alias("a"))
    pages = events.groupBy("page").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["a"]).alias("orderedItems"))
    following = F.concat(F.lit("p"), F.when(F.col("page") == last, 3).otherwise(F.col("page") + 1))  # the last page leads back
    body = F.to_json(F.struct(F.struct(following.alias("id")).alias("next"), "orderedItems"))
    docs = pages.select(F.concat(F.lit("p"), "page").alias("url"), F.when(F.col("page") == last - 2, "no page").otherwise(body).alias("body"))
    root = spark.createDataFrame([("s", '{"first":{"id":"p0"}}')], "url string, body string")
    rows = graph.paged_activities(docs.union(root), "s")
    numbered = rows.filter("error is null").select("activity", F.col("id").cast("long").alias("user_id"), (F.col("page") * 500 + F.col("pos")).alias("event_id"))
    lost = rows.filter("error is not null").select(F.lit(None).cast("long").alias("user_id"), F.lit(None).cast("long").alias("event_id"), "error")
    return graph.changed(numbered, "user_id", "event_id").withColumn("error", F.lit(None).cast("string")).unionByName(lost)


@query("""
WITH d AS (SELECT o_orderkey AS k, o_orderkey % 2 = 0 AS more FROM orders), b AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem WHERE l_orderkey IN (SELECT k FROM d)),
p AS (SELECT DISTINCT k FROM b)
SELECT k AS key, kind, count(*) AS n FROM (
 SELECT k, 'seeAlso' AS kind FROM d UNION ALL SELECT k, 'annotation' FROM d UNION ALL SELECT k, 'content' FROM b
 UNION ALL SELECT k, 'annotation' FROM d WHERE more AND k IN (SELECT k FROM p) UNION ALL SELECT k, 'content' FROM d WHERE more AND k IN (SELECT k FROM p)) GROUP BY ALL""")
def q79_linked_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    at = lambda kind, key: F.concat(F.lit(f"https://x/{kind}/"), key)
    orders = load(spark, sf_dir, "orders").select("o_orderkey")
    docs = orders.select(k.alias("key"), F.to_json(F.struct(
        F.array(F.struct(at("s", k).alias("id"))).alias("seeAlso"), F.array(F.struct(at("l", k).alias("@id"))).alias("otherContent"),
        F.array(F.struct(F.lit("Annotation").alias("type"), F.lit("painting").alias("motivation"), F.struct(at("i", k).alias("id")).alias("body"))).alias("items"))).alias("body"))
    key = F.col("l_orderkey").cast("string")
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    notes = F.collect_list(F.struct(F.lit("Annotation").alias("type"), F.struct(F.concat(at("b", key), F.lit("/"), "l_linenumber").alias("id")).alias("body")))
    pages = lines.groupBy("l_orderkey").agg(notes.alias("items")).select(at("l", key).alias("url"), F.to_json(F.struct(
        F.lit("AnnotationPage").alias("type"), F.when(F.col("l_orderkey") % 2 == 0, at("m", key)).alias("next"), "items")).alias("body"))
    last = orders.select(at("m", k).alias("url"), F.concat(F.lit('{"@type":"sc:AnnotationList","resources":[{"@type":"oa:Annotation","resource":{"@id":"https://x/z/'), F.col("o_orderkey") % 10, F.lit('"}}]}')).alias("body"))
    found = linked.closure(docs, pages.union(last), "key", "body")
    return found.groupBy(F.col("key").cast("long").alias("key"), "kind").agg(F.count("*").alias("n"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'http://me/' || o_orderkey || '.jpg' ELSE 'https://i/' || o_orderkey || '/full/max/0/default.jpg' END AS image,
 CASE WHEN o_orderkey % 3 = 0 THEN 600 ELSE 1 END AS width, CASE WHEN o_orderkey % 2 = 0 THEN 'http://me/r' ELSE 'https://x/meta' END AS meta, o_orderkey % 5 = 0 AS thumbnail FROM orders""")
def q80_localized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    key = k.cast("string")
    thumb = F.when(k % 5 == 0, "http://me/t").otherwise("https://far/t")
    body = F.struct(F.concat(F.lit("https://i/"), key, F.lit("/full/max/0/default.jpg")).alias("id"), F.lit(1).alias("width"))
    canvas = F.struct(F.lit("Canvas").alias("type"), F.lit(1).alias("width"), F.lit(1).alias("height"), F.array(F.struct(F.array(F.struct(body.alias("body"))).alias("items"))).alias("items"))
    docs = load(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.struct(F.lit("Manifest").alias("type"), thumb.alias("thumbnail"), F.lit("https://x/meta").alias("seeAlso"), F.array(canvas).alias("items"))).alias("body"))
    targets = docs.filter(k % 3 == 0).select(
        "o_orderkey", F.concat(F.lit("https://i/"), key).alias("anchor"), F.concat(F.lit("http://me/"), key, F.lit(".jpg")).alias("image"), F.concat(F.lit("http://me/"), key).alias("service"), F.lit(600).alias("w"), F.lit(400).alias("h"))
    links = docs.filter(k % 2 == 0).select("o_orderkey", F.lit("https://x/meta").alias("url"), F.lit("http://me/r").alias("file"))
    made = localize(docs, "o_orderkey", "body", targets, links, "http://me/")
    shape = "thumbnail string, seeAlso string, items array<struct<width:int,items:array<struct<items:array<struct<body:struct<id:string>>>>>>>"
    read = made.select("o_orderkey", F.from_json("body", shape).alias("m"))
    return read.select(
        "o_orderkey", F.expr("m.items[0].items[0].items[0].body.id").alias("image"), F.expr("m.items[0].width").alias("width"), F.col("m.seeAlso").alias("meta"), F.col("m.thumbnail").isNotNull().alias("thumbnail"))


@query("""
SELECT count(DISTINCT fp) AS runs, count(*) AS asked FROM (SELECT concat_ws('|', o_custkey % 40, o_orderkey % 2) AS fp FROM orders)""")
def q81_run_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    a, b = F.array(F.lit("fr"), F.lit(" la"), F.lit("")), F.array(F.lit("la"), F.lit("fr"), F.lit("fr"))
    places = F.when(k % 3 == 0, F.array(F.lit("Paris"))).otherwise(F.array(F.lit(" PARIS "), F.lit("paris")))
    digest = ingest.mapping_digest(mapping_rows(spark)).first()[0]
    asked = load(spark, sf_dir, "orders").select(ingest.fingerprint(
        F.concat(F.lit(" c"), F.col("o_custkey") % 40), F.when(k % 5 == 0, a).otherwise(b), places, F.when(k % 2 == 0, 1400), F.when(k % 2 == 0, 1500), F.lit(digest)).alias("fp"))
    return asked.agg(F.count_distinct("fp").alias("runs"), F.count("*").alias("asked"))


@query("""
WITH s AS (SELECT 'k' || o_orderkey AS key, o_totalprice AS body FROM orders WHERE o_orderkey % 2 = 0), n AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN '../k' ELSE 'k' || o_orderkey END AS key, -o_totalprice AS body FROM orders WHERE o_orderkey % 3 = 0)
SELECT key, coalesce(n.body, s.body)::DOUBLE AS body FROM s FULL JOIN (FROM n WHERE key <> '../k') n USING (key) WHERE key NOT IN (SELECT 'k' || o_orderkey FROM orders WHERE o_orderkey % 11 = 0)""")
def q82_blob_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    name = F.concat(F.lit("k"), k)
    orders = load(spark, sf_dir, "orders")
    store = orders.filter(k % 2 == 0).select(name.alias("key"), F.col("o_totalprice").alias("body"))
    new = orders.filter(k % 3 == 0).select(F.when(k % 7 == 0, "../k").otherwise(name).alias("key"), (-F.col("o_totalprice")).alias("body"), k.alias("ord"))
    return files.blobs_delete(files.blobs_put(store, new), orders.filter(k % 11 == 0).select(name.alias("key")))


@query("""
SELECT user_id, arg_max(event_id, event_id) AS etag FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id
UNION ALL SELECT c_custkey, -1 FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type IN ('view', 'click'))""")
def q83_updated_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    cache = load(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("url"), F.lit("-1").alias("etag"), none.alias("last_modified"), none.alias("content_type"), F.lit("{}").alias("body"))
    responses = load(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("url"), F.when(F.col("event_type").isin("view", "click"), 200).otherwise(500).alias("status"), F.col("event_id").cast("string").alias("etag"), none.alias("last_modified"),
        none.alias("content_type"), F.col("props").alias("body"), "event_id")
    found = fetch.updated_cache(cache, responses, "event_id")
    return found.select(F.col("url").cast("long").alias("user_id"), F.col("etag").cast("long").alias("etag"))
