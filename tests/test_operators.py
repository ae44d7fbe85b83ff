"""Operators on small tables with defined orders, ties, nulls and empty inputs."""

import json

from pyspark.sql import functions as F

from vellum import rank
from vellum.operators import annotations, audit, images, linked, localize, merge, select
from vellum.sources import graph


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_work_records(spark):
    data = [(1, 1, "Language", "French"), (1, 2, " LANGUE ", "lat"), (1, 3, "language", "fr"), (1, 4, "date", "1450"), (1, 5, "Date", "n.d."), (1, 6, "century", "1500"),
            (1, 7, "origin", "Paris"), (1, 8, "Place of Origin", ""), (2, 1, "title", "x"), (3, 1, "language", "klingon")]
    got = select.work_records(spark.createDataFrame(data, "id int, pos int, label string, value string"), "id")
    by = {r["id"]: r for r in got.collect()}
    assert by[1]["langs"] == ["fr", "la"] and tuple(by[1]["date"]) == (1500, 1500) and by[1]["origin"] == ""
    assert by[3]["langs"] == [] and by[3]["date"] is None and 2 not in by


def test_missing_data_matches(spark):
    one = spark.createDataFrame([(["fr"], 0, 0, " "), ([], 1400, 1450, "Paris"), (["de"], None, None, None)], "l array<string>, s int, e int, o string")
    date = F.when(F.col("s").isNotNull(), F.struct(F.col("s").alias("start"), F.col("e").alias("end")))

    def classes(f):
        return [r[0] for r in one.select(f.classify(F.col("l"), date, F.col("o"))).collect()]

    assert classes(select.Filter()) == ["MATCH"] * 3
    assert classes(select.Filter(languages=["fr"])) == ["MATCH", "MATCH", "NO-MATCH"]
    assert classes(select.Filter(years=(1500, 1600))) == ["MATCH", "NO-MATCH", "MATCH"]
    assert classes(select.Filter(years=(1400, 0))) == ["MATCH", "NO-MATCH", "MATCH"]  # one bound only: the other is year 0
    assert classes(select.Filter(places=["PAR "])) == ["MATCH"] * 3 and classes(select.Filter(places=["rome"]))[1] == "NO-MATCH"


def test_collection_references(spark):
    body = json.dumps({
        "manifests": [{"@id": "m1"}], "collections": [{"@id": "c1"}], "members": [{"@id": "m2", "@type": "sc:Manifest"}, {"@id": "x", "@type": "sc:Range"}],
        "items": [{"id": "c2", "type": "Collection"}, {"id": "m1", "type": "Manifest"}],
    })
    got = graph.references(spark.createDataFrame([("r", body), ("bad", "{")], "url string, body string")).orderBy("pos")
    assert [(r["child"], r["kind"]) for r in got.collect()] == [("m1", "manifest"), ("c1", "collection"), ("m2", "manifest"), ("c2", "collection"), ("m1", "manifest")]


def test_walks(spark):
    data = [("r", "a", "collection", 0), ("r", "b", "collection", 1), ("a", "m1", "manifest", 0), ("b", "m1", "manifest", 0), ("b", "m2", "manifest", 1), ("b", "r", "collection", 2), ("a", "", "manifest", 3)]
    edges = spark.createDataFrame(data, "parent string, child string, kind string, pos int")
    tree = graph.walk_tree(edges.filter("child <> ''"), "r").orderBy("path")
    assert [r["manifest"] for r in tree.collect()] == ["m1", "m1", "m2"]
    seen = graph.walk_frontier(edges, "r")
    assert rows(seen, "url") == [("a",), ("b",), ("m1",), ("m2",), ("r",)]
    stats = graph.frontier_stats(seen, seen.filter("url in ('r', 'a')")).first()
    assert tuple(stats) == (3, 1, 2, False)


def test_ledgers(spark, tmp_path):
    stream = spark.createDataFrame([("a",), ("b",), (None,)], "url string")
    assert rows(graph.not_done(stream, stream.filter("url = 'a'"), "url"), "url") == [("b",), (None,)]
    (tmp_path / "journal").write_text("a\n\nb\na\ntorn")
    assert rows(graph.last_complete_lines(spark, str(tmp_path / "journal")), "url") == [("a",), ("b",)]
    log = spark.createDataFrame([("k", 1, "x"), ("k", 2, None), ("j", 1, None)], "k string, at int, v string")
    assert rows(graph.latest(log, "k", "at", "v"), "k", "v") == [("j", None), ("k", "x")]


def test_images_of_both_shapes(spark):
    old = {"sequences": [{"canvases": [{"@id": "c1", "label": "p1", "images": [
        {"resource": {"@id": "i/full/full/0/default.jpg", "width": 5}}, {"resource": {"@id": "j", "service": {"@id": "s1"}}}, {"resource": {"@id": "k", "service": [{}, {"id": "s2"}]}}]}]}],
        "items": [{"id": "ignored", "items": [{"items": [{"body": {"id": "z"}}]}]}]}
    new = {"items": [{"id": "c2", "type": "Canvas", "items": [{"items": [{"body": {"id": "i/full/max/0/default.jpg", "height": 7}}]}]}, {"id": "x", "type": "Range"}]}
    df = spark.createDataFrame([(1, json.dumps(old)), (2, json.dumps(new)), (3, "{}"), (4, "no json")], "k int, manifest string")
    got = rows(images.enumerate_images(df, "k"), "k", "ord", "canvas_id", "service_id", "width", "height")
    assert got == [(1, 1, "c1", "i", 5, 0), (1, 2, "c1", "s1", 0, 0), (1, 3, "c1", "", 0, 0), (2, 1, "c2", "i", 0, 7)]
    assert dict(rows(images.canvas_ids(df, "k"), "k", "canvases"))[2] == ["c2"]


def test_merges(spark):
    keys = lambda xs: spark.createDataFrame([(x, i) for i, x in enumerate(xs)], "k string, i int")
    assert rows(merge.lost(keys(["a", "a", "b", ""]), keys(["a", "c"]), "k"), "k", "lost") == [("a", 1), ("b", 1)]
    pairs = merge.match_in_order(keys(["a", "a", "b"]), keys(["a", "a", "a"]).withColumnRenamed("i", "j"), "k", ["i"], ["j"])
    assert rows(pairs, "k", "i", "j") == [("a", 0, 0), ("a", 1, 1)]
    local = spark.createDataFrame([(1, "", "x"), (2, "t", "")], "k int, title string, tags string")
    incoming = spark.createDataFrame([(1, " new ", "X,y"), (2, "u", ""), (3, "v", "")], "k int, title string, tags string")
    assert rows(merge.merge_research(local, incoming, "k"), "k", "title", "tags", "status") == [(1, "new", "x, y", "changed"), (2, "t", "", "conflict"), (3, None, None, "missing")]
    noted = lambda rows: spark.createDataFrame(rows, "k int, title string, notes string, tags string")
    merged = merge.merge_research(noted([(1, "t", "", ""), (2, "t", "n", ""), (4, None, None, None)]), noted([(1, "u", "\u2003m ", ""), (2, "t", "o", None), (3, "", "", "")]), "k")
    assert rows(merged, "k", "title", "notes", "status", "changed", "conflicts") == [
        (1, "t", "m", "conflict", True, ["title"]), (2, "t", "n", "conflict", False, ["notes"]), (3, None, None, "missing", False, []), (4, "", "", "same", False, [])]
    mine = spark.createDataFrame([("a", "1")], "id string, body string")
    new = spark.createDataFrame([("a", "1", "c", 1), ("a", "2", "c", 2), ("b", "1", "c", 3), ("b", "1", "c", 4), ("b", "9", "c", 5), ("", "1", "c", 6), ("d", "1", "", 7)], "id string, body string, canvas string, n int")
    assert [r[1] for r in rows(merge.merge_annotations(mine, new, "n"), "n", "outcome")] == ["duplicate", "conflict", "added", "duplicate", "conflict", "skipped", "skipped"]
    nodes = spark.createDataFrame([(1, "h/a/b"), (2, "h/ab"), (3, "x")], "k int, p string")
    anchors = spark.createDataFrame([("h/a",), ("h",)], "anchor string")
    assert rows(merge.longest_anchor(nodes, anchors, "k", "p"), "k", "anchor") == [(1, "h/a"), (2, "h")]


def test_replay(spark):
    log = spark.createDataFrame([(1, 1, "update", "x"), (1, 2, "add", "a"), (1, 3, "update", "b"), (1, 4, "delete", None), (1, 5, "delete", None), (2, 1, "add", "z")], "k int, n int, op string, value string")
    assert rows(merge.replay(log, ["k"], "n"), "k", "value", "present", "not_found") == [(1, "b", False, 2), (2, "z", True, 0)]


def test_audit(spark):
    dirs = spark.createDataFrame([("a",), ("a/b",), ("ab",), ("c/d",)], "dir string")
    assert rows(audit.topmost(dirs, "dir"), "dir") == [("a",), ("ab",), ("c/d",)]
    people = spark.createDataFrame([(x,) for x in "cabbage"], "v string").withColumn("u", F.monotonically_increasing_id())
    ranked = rank.ranked(people, [F.col("v"), F.col("u")])
    assert [r["v"] for r in sorted(ranked.collect(), key=lambda r: r["rn"])] == sorted("cabbage")
    assert audit.first_results(people, "u", 3).count() == 3


def test_annotation_targets(spark):
    targets = ['"http://c#xywh=1"', '{"source":"http://c#t"}', '{"source":{"@id":"http://d"}}', '{"id":"http://e#f"}', '["http://x"]', "bad"]
    df = spark.createDataFrame([(t,) for t in targets], "t string")
    assert [r[0] for r in df.select(annotations.canvas_id(F.col("t"))).collect()] == ["http://c", "http://c", "http://d", "http://e", "", ""]


def test_linked_resources(spark):
    doc = {
        "seeAlso": [{"id": "https://x/meta.xml", "format": "text/xml"}, "relative"], "otherContent": [{"@id": "https://x/list1"}, {"@id": "https://x/in", "resources": []}],
        "items": [{"type": "Annotation", "motivation": "painting", "body": {"id": "https://x/img"}}, {"type": "Annotation", "motivation": "linking", "body": [
            {"type": "Choice", "items": ["https://x/a", {"id": "https://x/pic", "type": "Image"}]}, {"value": "inline"}, {"type": "SpecificResource", "source": {"id": "https://x/b"}}]}],
    }
    df = spark.createDataFrame([("d", json.dumps(doc)), ("e", "nope")], "k string, body string")
    want = [("https://x/meta.xml", "seeAlso"), ("https://x/list1", "annotation"), ("https://x/a", "content"), ("https://x/b", "content")]
    assert [(r["url"], r["kind"]) for r in linked.discover(df, "k", "body").orderBy("ord").collect()] == want
    page = json.dumps({"type": "AnnotationPage", "next": "https://x/list2", "items": [{"type": "Annotation", "body": "https://x/c"}]})
    other = json.dumps({"@type": "sc:AnnotationList", "resources": [{"@type": "oa:Annotation", "resource": {"@id": "https://x/d"}}]})
    fetched = spark.createDataFrame([("https://x/list1", page), ("https://x/list2", other), ("https://x/b", page)], "url string, body string")
    got = linked.closure(df, fetched, "k", "body", limit=6)
    assert {r["url"] for r in got.collect()} == {u for u, _ in want} | {"https://x/list2", "https://x/c", "https://x/d"}
    assert got.filter("over").count() == 1


def test_a_walk_of_links_stops_at_its_cap(spark):
    link = lambda n: {"id": f"https://x/{n}"}
    many = json.dumps({"seeAlso": [link(n) for n in range(200_000)]})
    page = lambda at, *links: (f"https://x/{at}", json.dumps({"type": "AnnotationPage", "items": [{"type": "Annotation", "body": f"https://x/{n}"} for n in links], "next": f"https://x/{at}n"}))
    small = json.dumps({"otherContent": ["https://x/p", "https://x/q"]})
    df = spark.createDataFrame([("many", many), ("small", small), ("fits", json.dumps({"otherContent": ["https://x/r"]}))], "k string, body string")
    fetched = spark.createDataFrame([page("p", 1, 2), page("q", 2, 3, 1), page("qn", 7), ("https://x/r", json.dumps({"type": "AnnotationPage", "items": [{"body": f"https://x/{n}"} for n in range(4)]}))], "url string, body string")
    got = {}
    for r in linked.closure(df, fetched, "k", "body", limit=5).collect():
        got.setdefault(r.key, []).append((r.place, r.url.removeprefix("https://x/"), r.over))
    assert sorted(got["many"]) == [(n + 1, str(n), n == 5) for n in range(6)]  # one beyond is told, no more are kept
    assert sorted(got["small"]) == [(1, "p", False), (2, "q", False), (3, "1", False), (4, "2", False), (5, "pn", False), (6, "3", True)]
    assert sorted(got["fits"]) == [(1, "r", False), (2, "0", False), (3, "1", False), (4, "2", False), (5, "3", False)]  # as many as there is room for


def test_localized_documents(spark):
    doc = {"type": "Manifest", "thumbnail": "https://far/t.jpg", "seeAlso": "https://x/meta", "items": [{"type": "Canvas", "width": 1, "height": 1, "body": {
        "id": "https://i/s/full/max/0/default.jpg", "service": [{"id": "https://i/s"}], "width": 1}}, {"type": "Canvas", "thumbnail": {"id": "http://me/t"}, "body": {"@id": "https://i/sx"}}]}
    docs = spark.createDataFrame([(1, json.dumps(doc)), (2, "no json")], "k int, body string")
    targets = spark.createDataFrame([(1, "https://i/s", "http://me/1.jpg", "http://me/1", 600, 400)], "k int, anchor string, image string, service string, w int, h int")
    links = spark.createDataFrame([(1, "https://x/meta", "http://me/meta.xml"), (1, "https://i/sx", "")], "k int, url string, file string")
    got = dict(rows(localize.localize(docs, "k", "body", targets, links, "http://me/"), "k", "body"))
    made = json.loads(got[1])
    first = made["items"][0]
    assert got[2] == "no json" and "thumbnail" not in made and made["seeAlso"] == "http://me/meta.xml"
    assert (first["width"], first["height"], first["body"]["width"], first["body"]["id"]) == (600, 400, 600, "http://me/1.jpg")
    assert first["body"]["service"][0]["profile"] == "level0" and made["items"][1]["body"] == {"@id": "https://i/sx"} and "thumbnail" in made["items"][1]
    assert localize.thumbnail_url([{}, {"@id": "u"}]) == "u"
