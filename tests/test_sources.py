"""Files, fetch tables, derived documents and archives."""

import json

from pyspark.sql import functions as F

from vellum.operators import exchange, items
from vellum.sources import fetch, files


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_settings(spark):
    df = spark.createDataFrame([(1, "# note"), (2, " a = 1 "), (3, ""), (4, "a=2=3"), (5, "oops")], "ord int, value string")
    assert rows(files.settings(df), "key", "value", "error") == [("a", "2=3", None), (None, None, "malformed: oops")]


def test_local_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "manifest.json").write_text('{"@id": "https://x/m",\n "label": "l"}')
    (tmp_path / "b.json").write_text('{"id": "relative"}')
    got = rows(files.local_documents(spark, f"{tmp_path}/*.json").unionByName(files.local_documents(spark, f"{tmp_path}/a/*.json")), "id", "error")
    assert got == [("https://x/m", None), ("relative", "no absolute id")]
    listed = files.listing(spark, str(tmp_path))
    assert rows(files.folder_sizes(listed), "files") == [(1,), (1,)]
    assert listed.select(files.stamp(F.col("modified"), F.col("length")).alias("s")).filter("s rlike '^[0-9]+000/[0-9]+$'").count() == 2


def test_commit_pointers(spark):
    old = spark.createDataFrame([("a", "manifest.json", "1"), ("b", "manifest.json", "1")], "k string, manifest string, digest string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "k string, digest string")
    got = files.publish(new, old, "k", "digest")
    assert rows(got, "k", "manifest") == [("a", "manifest.json"), ("b", "manifest-versions/2.json"), ("c", "manifest.json")]
    bad = spark.createDataFrame([("a", "../x"), ("b", "manifest-versions/2.json")], "k string, manifest string")
    assert rows(files.active(new, bad, "k"), "k", "manifest") == [("a", "manifest.json"), ("b", "manifest-versions/2.json"), ("c", "manifest.json")]


def segment(marker, body):
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def frame(marker, width, height, parts=3, bits=8):
    return segment(marker, bytes([bits]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([parts]) + b"\x01\x11\x00" * parts)


def test_jpeg_header(spark):
    start, small = b"\xff\xd8", frame(0xC0, 8, 6)
    thumbnail = segment(0xE1, b"Exif\0\0" + start + small + b"\xff\xd9")
    table = segment(0xC4, b"\x00" * 20)
    cases = {
        "plain": (start + small, (8, 6)), "thumbnail": (start + thumbnail + frame(0xC0, 4000, 3000), (4000, 3000)), "progressive": (start + table + frame(0xC2, 5, 7, 1), (5, 7)),
        "filled": (start + b"\xff\xff" + small[1:], (8, 6)), "only a thumbnail": (start + thumbnail + b"\xff\xd9", None), "cut": (start + small[:-3], None),
        "in a segment": (start + segment(0xE0, b"JFIF") + b"\xff\xe2\x40\x00" + small, None), "after the scan": (start + segment(0xDA, b"\x01") + small, None),
        "lossless": (start + frame(0xC3, 8, 6), None), "no size": (start + frame(0xC0, 0, 6), None), "bits": (start + frame(0xC0, 8, 6, bits=12), None),
        "parts": (start + frame(0xC0, 8, 6, 2), None), "half bytes": (start + segment(0xE0, bytes.fromhex("0FFC00011080100020030F")), None), "start": (start, None), "empty": (b"", None), "null": (None, None),
    }
    df = spark.createDataFrame([(k, v and bytearray(v)) for k, (v, _) in cases.items()], "k string, b binary").repartition(2)
    got = {r.k: r.s and tuple(r.s) for r in df.select("k", files.jpeg_size(F.col("b")).alias("s")).collect()}
    assert got == {k: want for k, (_, want) in cases.items()}
    assert {r.k for r in df.filter(files.readable_jpeg(F.col("b"))).collect()} == {k for k, (_, want) in cases.items() if want}
    assert df.limit(0).select(files.jpeg_size(F.col("b"))).count() == 0


def test_fetch_outcomes(spark):
    shape = "url string, status int, content_type string, etag string, last_modified string, retry_after string, body string"
    got = spark.createDataFrame([
        ("https://a", 200, "application/json", "e", None, None, '{"x":1}'), ("https://b", 304, None, None, None, None, None), ("https://c", 404, None, None, None, None, "x"),
        ("https://d", 200, "text/html", None, None, None, "x"), ("http://e", 200, None, None, None, None, "x"), ("https://f", 503, None, None, None, "2", ""), ("https://g", 304, None, None, None, None, None)], shape)
    cache = spark.createDataFrame([("https://b", "e", None, None, "old"), ("https://a", "z", None, None, "older")], "url string, etag string, last_modified string, content_type string, body string")
    want = {"https://a": ('{"x":1}', None), "https://b": ("old", None), "https://c": (None, "not found"), "https://d": (None, "html page"), "http://e": (None, "insecure url"),
            "https://f": (None, "status 503"), "https://g": (None, "not modified, but not cached")}
    assert {r["url"]: (r["body"], r["error"]) for r in fetch.outcomes(got, cache).collect()} == want
    assert rows(fetch.updated_cache(cache, got), "url", "body") == [("https://a", '{"x":1}'), ("https://b", "old")]
    log = spark.createDataFrame([("u", 1, 503, None), ("u", 2, 429, "5"), ("u", 3, 503, None)], "url string, attempt int, status int, retry_after string")
    assert rows(fetch.attempts(log), "attempt", "delay_ms", "start_ms") == [(1, 1000, 0), (2, 5000, 1000), (3, None, 6000)]
    queue = spark.createDataFrame([("h", 1, None), ("h", 2, None), ("g", 1, 13000), ("g", 2, 13000)], "host string, n int, interval_ms int")
    assert rows(fetch.schedule(queue, "n"), "host", "n", "start_ms") == [("g", 1, 0), ("g", 2, 13000), ("h", 1, 0), ("h", 2, 750)]


def test_derived_documents(spark):
    shape = "item string, grp int, pos int, url string, info string, mimetype string, width int, height int"
    f = spark.createDataFrame([
        ("i", 0, 0, "t", None, "text/plain", 0, 0), ("i", 1, 0, "a", None, "image/jpeg", 10, 10), ("i", 1, 1, "b", None, "image/jpeg", 20, 5),
        ("i", 1, 2, "c", "s/info.json", "image/tiff", 30, 30), ("i", 2, 0, "d", None, "image/jpeg", 1, 1), ("i", 2, 1, "e", None, "image/jpeg", None, None)], shape)
    pages = items.page_images(f, "item")
    assert rows(pages, "page", "url", "service", "width") == [(1, "a", "s", 30), (2, "d", None, 1)]
    known = spark.createDataFrame([("i", "https://x", "", ["1900"], [], []), ("j", "https://y", "t", [], [], [])], "item string, at string, title string, dates array<string>, languages array<string>, rights array<string>")
    got = {r["item"]: r for r in items.derived_manifests(known, pages, "item", "at").collect()}
    made = json.loads(got["i"]["manifest"])
    assert made["label"] == items.DEFAULT_TITLE and made["metadata"] == [{"label": "Date", "value": "1900"}]
    assert [c["@id"] for c in made["sequences"][0]["canvases"]] == ["https://x#canvas-0001", "https://x#canvas-0002"]
    assert got["j"]["error"] == "no pages"
    raw = spark.createDataFrame([(" x ",), ('[" a ", ""]',), (" ",), (None,)], "v string")
    assert [r[0] for r in raw.select(items.text_values(F.col("v"))).collect()] == [[" x "], ["a"], [], []]


def test_archive_round_trip(spark):
    research = spark.createDataFrame([("d1", "u1", "t", None, "x"), ("d2", "u2", None, None, None), ("d3", "u3", "", "", "")], "dir string, manifest_url string, title string, notes string, tags string")
    notes = spark.createDataFrame([("d2", 2, "n2"), ("d2", 1, "n1")], "dir string, ord int, body string")
    lines = exchange.export(research, notes)
    back = exchange.read_archive(lines.select("value").union(spark.createDataFrame([('{"format":"y"}',)], "value string")))
    assert rows(back, "dir", "annotations", "error") == [("d1", None, None), ("d2", ["n1", "n2"], None), (None, None, "unknown format or version")]
    incoming = spark.createDataFrame([(1, "u1", "zz", "other", "x"), (2, "none", "d2", "new", ""), (3, "none", "none", "", ""), (4, "u2", "q", "", "")], "ord int, manifest_url string, bundle_dir string, title string, tags string")
    report = exchange.import_report(incoming, research.select("dir", "manifest_url"), research.select("dir", "title", "tags"))
    assert rows(report, "status", "n") == [("changed", 1), ("conflict", 1), ("missing", 1), ("repeated", 1)]
