"""Shared collections, resumed walks, paged streams, ranks, pages of notes, descriptions, comparisons."""

import json
import random

import pytest
from pyspark.sql import functions as F

from vellum import rank, scratch
from vellum.jsontext import metadata_rows, title_of
from vellum.operators import annotations, catalogue, comparisons, library, localize, merge
from vellum.sources import fetch, files, graph, ingest

EDGE = "parent string, child string, kind string, pos int"


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def depth_first(edges, root, failed=()):
    """The walk as a plain recursion with one visited set."""
    seen, out = {root}, []

    def enter(node):
        if node in failed:
            out.append((None, f"no {node}"))
            return
        for _, child, kind, _ in sorted((e for e in edges if e[0] == node), key=lambda e: e[3]):
            if kind == "manifest":
                out.append((child, None))
            elif child not in seen:
                seen.add(child)
                enter(child)

    enter(root)
    return out


def test_shared_collections_are_entered_once(spark):
    diamond = [("r", "a", "collection", 0), ("r", "b", "collection", 1), ("a", "x", "collection", 0), ("b", "x", "collection", 0), ("x", "m", "manifest", 0), ("x", "m", "manifest", 1), ("x", "r", "collection", 2)]
    rnd = random.Random(3)
    tangled = [(f"c{rnd.randrange(14)}", f"c{rnd.randrange(14)}", "collection", k) for k in range(40)] + [(f"c{k % 14}", f"m{k % 9}", "manifest", 100 + k) for k in range(30)]
    for edges, root, failed in ((diamond, "r", ()), (tangled, "c0", ()), (tangled, "c0", ("c3", "c5"))):
        here = [e for e in edges if e[0] not in failed]
        bad = spark.createDataFrame([(u, f"no {u}") for u in failed], "url string, error string")
        got = graph.walk_tree(spark.createDataFrame(here, EDGE), root, bad).collect()
        assert [(r["manifest"], r["error"]) for r in sorted(got, key=lambda r: r["path"])] == depth_first(edges, root, failed)


def test_a_walk_is_taken_up_again(spark, tmp_path):
    edges = spark.createDataFrame([("r", "a", "collection", 0), ("r", "b", "collection", 1), ("a", "m1", "manifest", 0), ("b", "c", "collection", 0), ("c", "m2", "manifest", 0)], EDGE)
    down = spark.createDataFrame([("b",)], "url string")
    folder = f"{tmp_path}/walk"
    first = graph.walk_frontier(edges, "r", folder, down)
    assert rows(first, "url", "expanded") == [("a", True), ("b", False), ("m1", False), ("r", True)]
    done = first.filter("expanded")
    assert tuple(graph.frontier_stats(first, done).first()) == (3, 1, 1, False)
    again = graph.walk_frontier(edges, "r", folder)
    assert rows(again, "url") == [("a",), ("b",), ("c",), ("m1",), ("m2",), ("r",)]
    assert tuple(graph.frontier_stats(again, again.filter("expanded")).first()) == (4, 0, 2, True)
    assert tuple(graph.stored_stats(spark, folder).first()) == ("r", 1, 4, 0, 2, True)
    with pytest.raises(FileNotFoundError):
        graph.stored_stats(spark, f"{tmp_path}/none")
    with pytest.raises(ValueError, match="holds a walk of r"):
        graph.walk_frontier(edges, "other", folder)


def test_paged_stream(spark):
    page = lambda following, *acts: json.dumps({"next": {"id": following} if following else None, "orderedItems": [{"type": t, "object": {"id": i}} for t, i in acts]})
    docs = [("s", '{"first":{"id":"p1"}}'), ("p1", page("p2", ("Create", "a"), ("Delete", "a"), ("Update", "b"))), ("p2", page("p3", ("Update", "a"))), ("p3", page("p1", ("Create", "c")))]
    seen = graph.paged_activities(spark.createDataFrame(docs, "url string, body string"), "s")
    assert rows(seen, "page", "pos", "activity", "id") == [(0, 0, "Create", "a"), (0, 1, "Delete", "a"), (0, 2, "Update", "b"), (1, 0, "Update", "a"), (2, 0, "Create", "c")]
    torn = graph.paged_activities(spark.createDataFrame([docs[0], docs[1], ("p2", "nope"), docs[3]], "url string, body string"), "s")
    assert rows(torn, "page", "error") == [(0, None), (0, None), (0, None), (1, "unreadable page p2")]
    assert rows(graph.paged_activities(spark.createDataFrame([("x", "{}")], "url string, body string"), "s"), "error") == [("unreadable stream s",)]


def test_ranks(spark):
    rnd = random.Random(1)
    data = [(i, rnd.choice(["hot"] * 6 + ["a", "b", None]), rnd.randrange(50)) for i in range(400)]
    df = spark.createDataFrame(data, "i int, k string, v int").repartition(9)
    order = sorted(data, key=lambda r: (-r[2], r[0]))
    assert rows(rank.ranked(df, [F.col("v").desc(), F.col("i")]), "i", "rn") == sorted(((r[0], n) for n, r in enumerate(order, 1)), key=repr)
    want, count = [], {}
    for i, k, _ in sorted(data, key=lambda r: (r[2], r[0])):
        count[k] = count.get(k, 0) + 1
        want.append((i, count[k]))
    assert rows(rank.ranked_by(df, ["k"], [F.col("v"), F.col("i")]), "i", "rn") == sorted(want, key=repr)
    assert rank.ranked_by(df.limit(0), ["k"], [F.col("v")]).count() == 0


def test_ranks_of_hot_keys(spark):
    rnd = random.Random(4)
    pairs = [(rnd.choice([None, "a", "a", "a", "b"]), n) for n in rnd.sample(range(1000), 300)] + [("c", 1)]
    want, seen = {}, {}
    for k, n in sorted(pairs, key=lambda p: p[1]):
        want[k, n] = seen[k] = seen.get(k, 0) + 1
    df = spark.createDataFrame(pairs, "k string, n int")
    for hot in (1, 60, 1000):  # all keys by ranges, some, none
        assert {(r.k, r.n): r.rn for r in rank.ranked_by(df, ["k"], [F.col("n")], "rn", hot).collect()} == want


def test_catalogue_order_is_that_of_readers(spark):
    titles = ["Zebra", "apple", "Éclair", "eclair", "Eclaire", "öl", "Oz", "zèbre", None]
    df = spark.createDataFrame([(f"d{n}", t, "I", 1) for n, t in enumerate(titles)], "dir string, title string, institution string, pages int").repartition(3)
    got = {r.title: r.by_title for r in catalogue.ranks(df).collect()}
    assert sorted(got, key=got.get) == [None, "apple", "eclair", "Éclair", "Eclaire", "öl", "Oz", "Zebra", "zèbre"]
    assert sorted(r.by_path for r in catalogue.ranks(df.withColumn("dir", F.lit("same"))).collect()) == list(range(1, 10))  # ties keep places of their own


def test_known_rows_are_joined_in_their_buckets(spark):
    known = scratch.Known("t", ["a", "b"])
    rounds = [spark.createDataFrame([(k, k + n) for k in range(0, 40, n + 1)], "a int, b int") for n in range(11)]
    kept = []
    for r in rounds:
        kept.append(known.add(known.without(r.distinct())).count())
    assert [len(t) for t in known.tables] == [3, 2]  # eleven rounds, five tables
    assert known.all().count() == known.all().distinct().count() == sum(kept)
    asked = known.tables[0][0].select("a", "b")
    plan = known.without(asked)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan or "Broadcast" in plan


def test_the_newest_response_is_kept(spark):
    shape = "url string, status int, etag string, last_modified string, content_type string, body string, at int"
    got = spark.createDataFrame([("u", 200, "z", None, None, "{}", 1), ("u", 200, "a", None, None, "[]", 2), ("u", 500, "y", None, None, "{}", 3)], shape)
    cache = spark.createDataFrame([("u", "old", None, None, "1"), ("v", "e", None, None, "2")], "url string, etag string, last_modified string, content_type string, body string")
    assert rows(fetch.updated_cache(cache, got, "at"), "url", "etag", "body") == [("u", "a", "[]"), ("v", "e", "2")]


def test_local_notes_that_share_an_id(spark):
    mine = spark.createDataFrame([("a", "1"), ("a", "2"), ("", "1"), ("", "2")], "id string, body string")
    new = spark.createDataFrame([("a", "1", "c", 1), ("", "1", "c", 2)], "id string, body string, canvas string, n int")
    assert rows(merge.merge_annotations(mine, new, "n"), "n", "outcome") == [(1, "duplicate"), (2, "skipped")]


def test_pages_of_notes(spark):
    note = '{"id":"n1","type":"Annotation","creator":{"x":[1,"é\\"q"]},"target":"http://c#t"}'
    text = '{"@context":"c","type":"AnnotationPage","items":[' + note + ',{"id":"n2"},{"id":"n1","v":2}]}'
    df = spark.createDataFrame([(1, text), (2, None), (3, "{"), (4, "{}")], "k int, t string").withColumn("p", annotations.page(F.col("t")))
    got = {r["k"]: r["p"] for r in df.collect()}
    assert got[3] is None and got[2]["items"] == [] == got[4]["items"] and got[4]["type"] == "AnnotationPage" and got[2]["context"] == annotations.CONTEXT
    assert json.loads(got[1]["items"][0]) == json.loads(note)
    back = {r["k"]: r["e"] for r in df.filter("k <> 3").select("k", annotations.encoded(F.col("p")).alias("e")).collect()}
    assert json.loads(back[1]) == json.loads(text) and json.loads(back[2])["items"] == []

    def edit(op, id_, new=None):
        made = annotations.edited(F.col("p.items"), F.lit(op), F.lit(id_), F.lit(new))
        out = df.filter("k = 1").select(made.alias("x")).first()["x"]
        return out and [json.loads(x).get("id") for x in out]

    assert edit("add", "", '{"id":"n9"}') == ["n1", "n2", "n1", "n9"] and edit("update", "n1", '{"id":"n8"}') == ["n8", "n2", "n1"]
    assert edit("delete", "n1") == ["n2"] and edit("delete", "nx") is None and edit("update", "nx", "{}") is None


def test_descriptions(spark):
    bodies = [
        ("ok", {"width": 4, "height": 4, "sizes": [{"width": 4, "height": 4}], "tiles": [{"width": 2, "scaleFactors": [1, 2]}]}), ("none", {"width": 0, "height": 4, "tiles": [{}]}),
        ("bad", {"width": 4, "height": 4, "sizes": [{"width": 0, "height": 1}], "tiles": [{"width": 0, "scaleFactors": [1]}, {"width": 2, "scaleFactors": [0, 9223372036854775807]}]}),
        ("absent", {"width": 4, "height": 4, "sizes": [{"width": 4}], "tiles": [{"height": 2, "scaleFactors": [1, 2]}, {}, {"width": 4, "scaleFactors": [None]}]}),
        ("many", {"width": 100000, "height": 100000, "tiles": [{"width": 1, "scaleFactors": [1]}]}),
    ]
    df = spark.createDataFrame([(k, k, json.dumps(b)) for k, b in bodies] + [("no", "no", "{")], "k string, prefix string, body string")
    got = {}
    for r in library.advertised(df, ["k"]).collect():
        got.setdefault(r["k"], []).append(r["file"] or r["error"])
    assert sorted(got["ok"]) == ["ok/0,0,2,2/2,2/0/default.jpg", "ok/0,0,4,4/2,2/0/default.jpg", "ok/0,2,2,2/2,2/0/default.jpg", "ok/2,0,2,2/2,2/0/default.jpg", "ok/2,2,2,2/2,2/0/default.jpg", "ok/full/4,4/0/default.jpg"]
    assert got["none"] == ["invalid dimensions or no tiles"] and got["no"] == ["invalid description"] and got["many"] == ["too many tiles"]
    assert sorted(got["bad"]) == ["invalid scale factor", "invalid size", "invalid tile width", "scale factor too large"]
    assert sorted(got["absent"]) == ["invalid scale factor", "invalid size", "invalid tile width", "invalid tile width"]
    asked = df.filter("k = 'ok'").select(localize.with_request_id(F.col("body"), F.lit("http://me/ok")).alias("b")).first()["b"]
    assert json.loads(asked)["id"] == "http://me/ok" and json.loads(asked)["width"] == 4


def test_document_texts(spark):
    doc = {"label": {"fr": ["t"]}, "metadata": [{"label": "Date", "value": [{"@value": "1900"}, "x"]}, {"label": " ", "value": "y"}]}
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, "nope"), (3, '{"metadata":"x"}')], "k int, m string")
    assert rows(df.select("k", title_of(F.col("m")).alias("t")), "k", "t") == [(1, "t"), (2, ""), (3, "")]
    assert rows(metadata_rows(df, "k", "m"), "k", "pos", "label", "value") == [(1, 0, "Date", "1900")]


def test_sidecars_and_state(spark):
    texts = spark.createDataFrame([(None,), ("{",), ('{"version":1}',), ('{"version":2}',), ('{"version":"x"}',)], "t string")
    assert [r[0] for r in texts.select(catalogue.readable(F.col("t"))).collect()] == [None, "not JSON", None, "another version", "another version"]
    had = spark.createDataFrame([("f1", "d1"), ("f2", "d2")], "fingerprint string, descriptor string")
    want = spark.createDataFrame([("f1", "d1"), ("f2", "dx"), ("f3", "d3")], "fingerprint string, descriptor string")
    assert rows(ingest.opened(want, had), "fingerprint", "state") == [("f1", "resumed"), ("f2", "mismatch"), ("f3", "new")]
    left = ingest.fresh({n: had for n in ("journal", "failures", "frontier")}, want.filter("fingerprint = 'f1'").select("fingerprint"))
    assert list(left) == ["frontier", "journal", "failures"] and all(rows(t, "fingerprint") == [("f2",)] for t in left.values())
    store = spark.createDataFrame([("a", "1"), ("e", "")], "key string, body string")
    asked = spark.createDataFrame([("a",), ("e",), ("x",), ("../a",)], "key string")
    assert rows(files.blobs_get(store, asked), "key", "error") == [("../a", "outside the store"), ("a", None), ("e", None), ("x", "no such key")]
    lines = spark.createDataFrame([(" u ",), ("u",), ("",), ("v",)], "value string")
    assert rows(ingest.completed(lines), "url") == [("u",), ("v",)]


def test_comparison_merges(spark):
    shape = "name string, docs array<string>, canvases array<string>"
    local = spark.createDataFrame([("One", ["a", "b"], ["", ""])], shape)
    new = spark.createDataFrame([("ONE", ["a", "b"], ["", ""], 1), (" one", ["a", "c"], ["", ""], 2), ("two", ["a", "b"], ["", ""], 3), ("Two", ["a", "b"], ["", "x"], 4), (None, ["a", "b"], ["", ""], 5), (" ", None, None, 6)], shape + ", ord int")
    assert rows(comparisons.merged(local, new, "ord"), "ord", "outcome") == [(1, "duplicate"), (2, "conflict"), (3, "added"), (4, "conflict"), (5, "invalid"), (6, "invalid")]
    sets = spark.createDataFrame([("x", 5, 2), ("y", 3, 1), ("z", 5, 1)], "name string, created_at int, ord int")
    assert [r["name"] for r in comparisons.listed(sets).collect()] == ["y", "z", "x"] == [r["name"] for r in catalogue.in_order(sets, "comparisons").collect()]
