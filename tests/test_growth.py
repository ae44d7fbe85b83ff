"""Work and memory that grow no faster than the input, and results on many rows."""

import duckdb
from pyspark.sql import functions as F

from vellum import scratch
from vellum.operators import images, linked, select
from vellum.queries import ORACLE_SQL, QUERIES
from vellum.sources import fetch

SMALL = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_periods_are_counted_without_pairs(spark, monkeypatch):
    works = spark.range(5000).selectExpr("cast(if(id % 97 = 0, null, 1000 + id % 701) as int) as s", "cast(1000 + id % 701 + id % 53 as int) as e")
    bounds = [(None, 1200, 1300), ("a", 1700, 1900), ("a", 1000, 1000), ("b", 1699, 1699), ("c", None, 1500), ("d", -5, 9999), ("e", 0, 7)]
    asked = spark.createDataFrame(bounds, "p string, lo int, hi int")
    monkeypatch.setattr(select, "overlapping", None)  # there is nothing that ends before it starts
    got = select.period_counts(works, asked, "p", ("s", "e"), ("lo", "hi"))
    rows = [tuple(r) for r in works.collect()]
    want = [(p, lo, hi, sum(s is None or (lo is not None and s <= hi and lo <= e) for s, e in rows)) for p, lo, hi in bounds]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)  # null and repeated keys, too


def test_tiles_are_never_broadcast(spark):
    plan = plan_of(QUERIES["q25_missing_tiles"](spark, SMALL))
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_page_names_equal_the_sql_beyond_four_digits(spark, tmp_path):
    spark.range(10_005).selectExpr("id * 100 as l_orderkey", "id * 7 + 1 as l_partkey", "1L as l_suppkey", "1 as l_linenumber", "7.0D as l_quantity").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    want = sorted(db.execute(ORACLE_SQL["q41_page_choice"]).fetchall())
    got = QUERIES["q41_page_choice"](spark, str(tmp_path))
    assert max(r[3] for r in want) == 10_005
    assert sorted(map(tuple, got.collect())) == want


def test_rows_that_become_many_are_spread(spark, monkeypatch):
    assert scratch.spread(spark.range(101), ["id"], 10).rdd.getNumPartitions() == 11
    assert scratch.spread(spark.range(0), ["id"]).rdd.getNumPartitions() == 1
    monkeypatch.setattr(scratch, "EACH", 50)
    n = -(-spark.read.parquet(f"{SMALL}/part.parquet").count() // 50)
    assert n > 1 and f", {n}), REPARTITION_BY_NUM" in plan_of(QUERIES["q60_advertised_files"](spark, SMALL))


def test_bundles_of_a_library_are_spread(spark, monkeypatch):
    monkeypatch.setattr(scratch, "EACH", 50)
    n = -(-spark.read.parquet(f"{SMALL}/customer.parquet").count() // 50)
    assert n > 1 and f", {n}), REPARTITION_BY_NUM" in plan_of(QUERIES["q64_library_audit"](spark, SMALL))


def test_responses_without_an_item_meet_in_no_task(spark):
    route = "https://www.loc.gov/item/{}/manifest.json"
    asked = [(1, route.format("a"), 403, "x"), (2, route.format("b"), 403, "x"), (3, "u", 200, "x"), (4, "u", 403, None), (5, None, None, None)]
    responses = spark.createDataFrame(asked, "k int, url string, status int, body string")
    met = fetch.item_fallback(responses, spark.createDataFrame([("a", "from a"), (None, "y")], "item string, body string").hint("merge"), ["k"])
    assert [(r.k, r.via, r.body) for r in met.orderBy("k").collect()] == [(1, "derived", "from a"), (2, "error", None), (3, "direct", "x"), (4, "error", None), (5, "error", None)]
    assert "Union" in plan_of(met)  # those without an item are never shuffled


def test_descriptions_are_made_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(scratch, "EACH", 50)
    n = -(-spark.read.parquet(f"{SMALL}/part.parquet").count() // 50)
    assert n > 1 and f", {n}), REPARTITION_BY_NUM" in plan_of(QUERIES["q97_names_and_descriptions"](spark, SMALL))


def test_services_are_parsed_once(spark):
    docs = spark.createDataFrame([(1, "{}")], "k int, manifest string")
    assert plan_of(images.enumerate_images(docs, "k").select("service_id")).count("from_json(") == 2  # the document, and an image's service


def test_inventory_counts_where_documents_lie(spark):
    body = '{"seeAlso":["https://x/a","https://x/b"],"items":[{"id":"c","items":[{"items":[{"body":{"id":"https://i/1"}}]}]}]}'
    rows = [("a", body), ("a", "{}"), (None, body), ("d", "{"), ("e", None)]
    found = linked.inventory(spark.createDataFrame(rows, "k string, manifest string"), "k")
    assert "Exchange" not in plan_of(found)
    got = sorted(((r.k, r.images, r.linked, r.error) for r in found.collect()), key=repr)
    want = [("a", 0, 0, None), ("a", 1, 2, None), ("d", None, None, "not JSON"), ("e", None, None, "not JSON"), (None, 1, 2, None)]
    assert got == sorted(want, key=repr)
