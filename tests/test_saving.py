"""Edits, sets and documents that are saved in one commit each."""

import hashlib

from pyspark.sql import functions as F

from vellum.operators import exchange, saving
from vellum.sources import store

SETS = "ord long, name string, docs array<string>, canvases array<string>"


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_edits_are_saved(spark, tmp_path):
    folder = f"file://{tmp_path}/s"
    store.commit(spark, store.snapshot(spark, folder), {"catalogue": spark.createDataFrame([("d1", "u1", "t", "", ""), ("d2", "", "", "", "")], exchange.CATALOGUE)})
    edits = [("d1", 1, " a ", "n", "x,X"), ("d1", 2, "z" * 501, "", ""), ("d3", 3, "q", "", "")]
    got = saving.save_edits(spark, folder, spark.createDataFrame(edits, "dir string, ord int, title string, notes string, tags string"))
    assert told(got) == [("d1", 1, "saved"), ("d1", 2, "too long"), ("d3", 3, "not found")]
    now = store.snapshot(spark, folder)
    assert now.version == 2 and told(now.read(spark, "catalogue", exchange.CATALOGUE)) == [("d1", "u1", "a", "n", "x"), ("d2", "", "", "", "")]


def test_sets_are_saved_and_dropped(spark, tmp_path):
    folder = f"file://{tmp_path}/s"
    sets = lambda *names: spark.createDataFrame([(n, x, ["a", "b"], ["", ""]) for n, x in enumerate(names)], SETS)
    assert told(saving.save_sets(spark, folder, sets("One", "one ", "", "Two"))) == [(0, "One", None), (1, "one ", "exists"), (2, "", "name"), (3, "Two", None)]
    assert told(saving.save_sets(spark, folder, sets("TWO", " Three"))) == [(0, "TWO", "exists"), (1, " Three", None)]
    there = lambda: told(store.snapshot(spark, folder).read(spark, "comparisons", exchange.COMPARISONS).select("ord", "name"))
    assert there() == [(0, "One"), (3, "Two"), (5, "Three")]
    assert told(saving.drop_sets(spark, folder, spark.createDataFrame([(3,), (9,)], "ord long"))) == [(3, "deleted"), (9, "not found")]
    assert there() == [(0, "One"), (5, "Three")]


def test_documents_and_pointers_change_together(spark, tmp_path):
    folder = f"file://{tmp_path}/s"
    shape = "slug string, exists boolean, matched boolean, committed boolean, valid boolean, pyramid_ok boolean, fetch_ok boolean"
    images = lambda **ok: spark.createDataFrame([(s, False, False, False, False, False, o) for s, o in ok.items()], shape)
    docs = lambda **body: spark.createDataFrame(list(body.items()), "slug string, body string")
    got = saving.preserve(spark, folder, images(a=True, b=False), docs(a="1", b="1"))
    assert told(got.select("slug", "stored", "failed", "committed")) == [("a", 1, 0, True), ("b", 0, 1, False)]
    assert told(saving.active_documents(spark, folder)) == [("a", "manifest.json", "1")]
    saving.preserve(spark, folder, images(a=True, b=True), docs(a="2", b="1"))
    digest = hashlib.sha256(b"2").hexdigest()
    assert told(saving.active_documents(spark, folder)) == [("a", f"manifest-versions/{digest}.json", "2"), ("b", "manifest.json", "1")]
    saving.preserve(spark, folder, images(a=False, b=True), docs(a="3", b="1"))  # a stays as it is
    assert len(told(saving.active_documents(spark, folder))) == 2 and store.snapshot(spark, folder).read(spark, "documents", saving.DOCUMENTS).count() == 3


def test_bodies(spark):
    df = spark.createDataFrame([("x" * (8 << 10),), ("é" * (4 << 10) + "x",), (None,)], "b string")
    assert [r[0] for r in df.select(saving.body_error(F.col("b"), "deletion")).collect()] == [None, "body too large", None]
