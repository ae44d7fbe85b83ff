"""Documents of any depth: decoded, encoded, searched for text, rewritten, walked for links."""

import json
import random

import pytest
from pyspark.sql import functions as F

from vellum import jsontext, jsontree
from vellum.operators import linked, localize

DEEP = 10_000


def tree(rnd, depth):
    kind = rnd.random()
    if depth == 0 or kind < 0.3:
        return rnd.choice([None, True, 1, 2.5, 'é"x', "", -3e9])
    if kind < 0.65:
        return [tree(rnd, depth - 1) for _ in range(rnd.randint(0, 4))]
    return {rnd.choice('abcdé"') + str(i): tree(rnd, depth - 1) for i in range(rnd.randint(0, 4))}


def test_the_stack_reads_what_the_library_reads():
    rnd = random.Random(1)
    for _ in range(1000):
        t = tree(rnd, 6)
        assert jsontree._decode_deep(json.dumps(t, indent=rnd.choice([None, 1]))) == t
    for bad in ("", "[", "[1,]", '{"a"}', '{"a":1,}', "[1 2]", "1 1", "{a:1}", "]", "[1}"):
        with pytest.raises(ValueError):  # noqa: PT011
            jsontree._decode_deep(bad)


def test_ten_thousand_levels():
    lists = "[" * DEEP + '"x"' + "]" * DEEP
    value = jsontree.decode(lists)
    assert jsontext.coerce(value) == "x" and jsontree.encode(value) == lists
    half = DEEP // 2 - 1
    document = '{"items":[' * half + '{"type":"Canvas","thumbnail":"q","id":"u","seeAlso":"https://x/y"}' + "]}" * half
    made = localize.Localizer([], {"u": "f"}, "base").rewrite(jsontree.decode(document))
    assert jsontree.encode(made) == document.replace('"thumbnail":"q",', "").replace('"u"', '"f"')
    assert linked.links_of(document) == [("https://x/y", "seeAlso", "")]
    with pytest.raises(ValueError, match="deeper"):
        jsontree.decode("[" + lists + "]")


def test_empty_parts_are_searched_once():
    value = {"en": ""}
    for _ in range(2000):  # preferred and sorted members are the same: two to the power of this, searched again and again
        value = {"en": value}
    assert jsontext.coerce(value) == ""
    assert jsontext.coerce([{"language": "en", "value": ""}]) == "en"  # a map of languages after all


def test_deep_documents_in_tables(spark):
    fine, over = "[" * 9000 + '"x"' + "]" * 9000, "[" * 60_000 + "]" * 60_000
    df = spark.createDataFrame([(1, fine), (2, over), (3, None), (4, '{"a":')], "k long, body string")
    assert [r.t for r in df.select("k", jsontext.text_of(F.col("body")).alias("t")).orderBy("k").collect()] == ["x", "", "", ""]
    none = spark.createDataFrame([], "k long, anchor string, image string, service string, w int, h int")
    links = spark.createDataFrame([(1, "x", "f"), (2, "x", "f")], "k long, url string, file string")
    made = {r.k: r.body for r in localize.localize(df, "k", "body", none, links, "http://me").collect()}
    assert made == {1: fine.replace('"x"', '"f"'), 2: over, 3: None, 4: '{"a":'}
    assert linked.discover(df, "k", "body").count() == 0
