"""Small helpers that no query calls by themselves."""

import hashlib

from pyspark.sql import functions as F

from vellum.functions import tiles, urls
from vellum.operators import annotations, catalogue, exchange, select


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_notes_of_a_canvas(spark):
    notes = spark.createDataFrame([("1", '"http://c#xywh=1"'), ("2", '{"source":"http://d"}'), ("3", "[]")], "id string, target string")
    ids = lambda canvas: [r.id for r in annotations.of_canvas(notes, canvas).orderBy("id").collect()]
    assert ids("http://c") == ["1"] and ids("http://d") == ["2"] and ids("http://x") == [] and ids("") == ["1", "2", "3"]


def test_research_is_reloaded_for_known_folders(spark):
    shape = "dir string, title string, notes string, tags string"
    now = spark.createDataFrame([("a", "t", "n", "x", 1), ("b", "t", None, "", 2)], f"{shape}, pages int")
    saved = spark.createDataFrame([("a", "u", "", None), ("c", "v", "", "")], shape)
    assert told(catalogue.reloaded(now, saved)) == [("a", "u", "", None, 1), ("b", "t", None, "", 2)]


def test_names_of_refreshed_images(spark):
    row = spark.range(1).select(urls.refreshed_name(F.lit("s"), F.lit("é"), F.lit(7)).alias("n")).first()
    assert row.n == "image-" + hashlib.sha256("s\0é\x007".encode()).hexdigest()[:24]


def test_file_of_a_size(spark):
    made = spark.range(1).select(tiles.size_key(F.lit("p"), F.lit(601), F.lit(400), F.lit(4)).alias("k")).first()
    assert made.k == "p/full/151,100/0/default.jpg"


def test_incoming_bundles_find_local_ones(spark):
    bundles = spark.createDataFrame([("a", "u1"), ("b", "u1"), ("c", ""), ("d", None)], "dir string, manifest_url string")
    incoming = [(1, "u1", "a"), (2, "", "c"), (3, "", "none"), (4, "other", "b"), (5, None, "d"), (6, "u1", "x")]
    got = exchange.resolve(spark.createDataFrame(incoming, "ord int, manifest_url string, bundle_dir string"), bundles)
    assert told(got.select("ord", "dir", "repeated")) == [(1, "b", False), (2, "c", False), (3, None, False), (4, "b", True), (5, "d", False), (6, "b", True)]


def test_filters_and_periods_agree(spark):
    works = spark.createDataFrame([(1, 1400, 1450), (2, None, None), (3, 0, 0), (4, -50, 20)], "w int, s int, e int")
    periods = spark.createDataFrame([("a", 1440, 1500), ("b", 1451, 1500)], "p string, lo int, hi int")
    counts = {r.p: r.works for r in select.period_counts(works, periods, "p", ("s", "e"), ("lo", "hi")).collect()}
    date = F.when(F.col("s").isNotNull(), F.struct(F.col("s").alias("start"), F.col("e").alias("end")))
    for p, lo, hi in (("a", 1440, 1500), ("b", 1451, 1500)):
        # year 0 to year 0 is no date to a filter, which it passes; to a join it is a year
        assert works.filter(select.Filter(years=(lo, hi)).date_ok(date)).filter("not (s = 0 and e = 0) or s is null").count() == counts[p]
