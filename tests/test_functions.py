"""Case tables of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from vellum.functions import dates, language, text, tiles, urls
from vellum.jsontext import coerce, member_text, text_of


def values(spark, rows, fn):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


DATES = [
    ("1450", (1450, 1450)), (" 1450\n", (1450, 1450)), ("\u00a01450\u2003", (1450, 1450)), ("1450-1500", (1450, 1500)), ("1500 – 1450", (1450, 1500)),
    ("1450—1460", (1450, 1460)), ("15th century", (1401, 1500)), ("1ST  Century", (1, 100)), ("22st century", (2101, 2200)), ("0th century", None),
    ("xve siècle", (1401, 1500)), ("XV siecle", (1401, 1500)), ("ier siècle", (1, 100)), ("s. xv", (1401, 1500)), ("s xii", (1101, 1200)),
    ("Siglo XVI", (1501, 1600)), ("circa 1450", (1430, 1470)), ("c.1450", (1430, 1470)), ("ca 9", (-11, 29)), ("c1450", (1430, 1470)),
    ("0", (0, 0)), ("", None), (None, None), ("before 1450", None), ("14500", None), ("1450 CE", None), ("siglo", None),
]


def test_dates(spark):
    got = values(spark, [d for d, _ in DATES], dates.parse_date_range)
    assert [g and (g["start"], g["end"]) for g in got] == [w for _, w in DATES]
    assert values(spark, ["0", "5"], lambda c: dates.present(dates.parse_date_range(c)).isNull()) == [True, False]


@pytest.mark.parametrize(("roman", "value"), [("xiv", 14), ("iiii", 4), ("ic", 99), ("mcmxc", 1990), ("abc", 0), ("", 0), ("ixc", 89)])
def test_roman(spark, roman, value):
    assert values(spark, [roman], dates.roman_to_int) == [value]


def test_languages(spark):
    assert values(spark, [" FRENCH ", "lat", "español", "xx", "", None], language.parse_language) == ["fr", "la", "es", None, None, None]


def test_urls(spark):
    assert values(spark, ["https://a@b.c:8/x/y?z", "x", "http://h", ""], urls.host_of) == ["b.c:8", "", "h", ""]
    assert values(spark, ["https://a.b/x y//z..", "a.b", "https://../..", "x://h/_a_"], urls.store_dir) == ["a.b/x_y_z..", "a.b", "_/_", "h/a"]
    assert values(spark, ["120", "+5", "-1", "86401", "x", None, " 5"], urls.retry_after) == [120, 5, 0, 0, 0, 0, 0]
    routes = ["https://www.loc.gov/item/x1/manifest.json", "http://WWW.LOC.GOV:80/item/x/manifest.json?q", "https://www.loc.gov/item/a/b/manifest.json", "https://loc.gov/item/x/manifest.json"]
    assert values(spark, routes, urls.item_route) == ["x1", "x", None, None]
    paths = ["a/b", "../a", "a/../b", "a/../../b", "", "/a", "a\\b"]
    assert values(spark, paths, urls.safe_relative) == [True, False, True, False, False, False, False]
    got = values(spark, ["http://x/a.XML?y", "http://x/a", "http://x/.verylongextension"], lambda u: urls.linked_extension(u, F.lit("image/png"), F.lit("annotation")))
    assert got == [".xml", ".json", ".json"]
    html = ["  <!DOCTYPE html>x", "<HTML>", "{}", None]
    assert values(spark, html, lambda b: urls.looks_like_html(F.lit("application/json"), b)) == [True, True, False, False]
    assert values(spark, ["x//"], lambda s: urls.image_candidates(s, F.lit(2))) == [["x", "x/full/max/0/default.jpg", "x/full/full/0/default.jpg"]]


def test_text(spark):
    assert values(spark, [" b, A ,,B,a , c"], text.normalize_tags) == ["b, A, c"]
    assert values(spark, ["it's"], text.shell_quote) == ["'it'\"'\"'s'"]
    assert values(spark, ["7"], lambda c: text.ordinal_name(c.cast("int"))) == ["0007"]


def test_tile_plan(spark):
    images = spark.createDataFrame([(1, 600, 400), (2, 1, 1), (3, 512, 512), (4, 513, 1)], "k int, w int, h int")
    counts = {r["k"]: r["count"] for r in tiles.tile_plan(images, tile=256).groupBy("k").count().collect()}
    assert counts[1] == 9 and counts[2] == 1 and counts[3] == 5
    edge = tiles.tile_plan(images.filter("k = 4")).orderBy("scale", "x").collect()
    assert [(r["scale"], r["x"], r["rw"], r["sw"]) for r in edge] == [(1, 0, 512, 512), (1, 512, 1, 1), (2, 0, 513, 257)]


JSON = [
    ('"x"', "x"), ("1.5", "1.5"), ("1e21", "1000000000000000000000"), ("3.0", "3"), ("true", ""), ("null", ""), ("nonsense", ""),
    ('["", "b"]', "b"), ('{"@value": "", "en": ["x"]}', ""), ('{"fr": ["f"], "en": ["e"]}', "e"), ('{"fr": ["f"], "none": ["n"]}', "n"),
    ('{"b": ["2"], "a": ["1"]}', "1"), ('[{"@value": "f", "@language": "fr"}, {"value": "e", "language": "en"}]', "e"),
    ('{"value": "v", "language": "fr"}', "fr"), ('{"only": ["", "z"]}', "z"), ("[]", ""), ("{}", ""),
]


def test_json_text(spark):
    assert values(spark, [j for j, _ in JSON] + [None], text_of) == [w for _, w in JSON] + [""]
    assert coerce({"de": [[], {"none": "deep"}]}) == "deep"
    assert values(spark, ["plain", '{"en":["e"]}', None], member_text) == ["plain", "e", ""]
