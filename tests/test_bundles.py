"""Stored bundles read as a table: a filter lists only its folders."""

import pytest
from pyspark.sql import functions as F

from vellum.sources import bundles, files


@pytest.fixture
def library(tmp_path):
    for slug in ("a/one", "a/two", "b", "b/below", "c/d/e", "a/empty", ".state/x", "abc"):
        (tmp_path / slug).mkdir(parents=True, exist_ok=True)
        if slug != "a/empty":
            (tmp_path / slug / "manifest.json").write_text(f'{{"id": "{slug}"}}')
    (tmp_path / "a" / "one" / "provenance.json").write_text("{}")
    (tmp_path / "b" / "annotations.json").write_bytes(b"\xff[]")
    (tmp_path / "manifest.json").write_text("the root is no bundle")
    return tmp_path


@pytest.fixture
def listed(monkeypatch):
    seen = []
    names = bundles._names
    monkeypatch.setattr(bundles, "_names", lambda store, path: (seen.append(path), names(store, path))[1])
    return seen


def read(reader):
    return [tuple(r) for p in reader.partitions() for b in reader.read(p) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]


def test_all_bundles(spark, library):
    bundles.register(spark)
    df = spark.read.format("bundles").load(str(library))
    got = {r.slug: (r.manifest, r.provenance, r.annotations) for r in df.collect()}
    assert got == {
        "a/one": ('{"id": "a/one"}', "{}", None), "a/two": ('{"id": "a/two"}', None, None), "b": ('{"id": "b"}', None, "�[]"),
        "c/d/e": ('{"id": "c/d/e"}', None, None), "abc": ('{"id": "abc"}', None, None),
    }
    assert df.rdd.getNumPartitions() == 4  # a folder each
    assert spark.read.format("bundles").load(f"file://{library}").count() == 5
    assert spark.read.format("bundles").load(f"{library}/a/empty").count() == 0


def test_what_is_asked_for_is_read(spark, library):
    slugs = lambda **how: sorted(r.slug for r in bundles.load(spark, str(library), **how).collect())
    assert slugs(slugs=["a/one"]) == ["a/one"] and slugs(slugs=[]) == [] and slugs(slugs=["b", "c/d/e", "nope", "../x", "b/below"]) == ["b", "c/d/e"]
    assert slugs(prefix="a") == ["a/one", "a/two", "abc"] and slugs(prefix="a", slugs=["b", "abc"]) == ["abc"] and slugs(prefix="b/") == []
    df = bundles.load(spark, str(library))
    assert df.filter("slug = 'b'").count() == 1 and df.count() == 5  # a filter of one query is none of the next


def test_filters_reach_the_source(spark, library):
    bundles.register(spark)
    load = lambda: spark.read.format("bundles_by_filter").load(str(library))  # noqa: E731  anew for each query
    slugs = lambda how: sorted(r.slug for r in load().filter(how).collect())
    assert slugs("slug = 'a/one'") == ["a/one"] and load().filter("slug = 'a/one'").rdd.getNumPartitions() == 1
    assert slugs("slug in ('b', 'c/d/e', 'nope', '../x', 'b/below')") == ["b", "c/d/e"]
    assert slugs(F.startswith("slug", F.lit("a"))) == ["a/one", "a/two", "abc"]
    assert slugs("slug like 'a/%' and provenance is null") == ["a/two"]
    assert slugs("slug = 'a/one' and slug = 'b'") == [] and slugs("startswith(slug, 'a') and startswith(slug, 'b')") == []
    assert slugs("startswith(slug, 'b/')") == []  # below a bundle


def test_files_of_bundles(spark, library):
    (library / "a" / "one" / "t" / "0,0").mkdir(parents=True)
    (library / "a" / "one" / "t" / "0,0" / "x.jpg").write_bytes(b"12345")
    bundles.register(spark)
    df = spark.read.format("bundle_files").load(str(library))
    got = {(r.slug, r.file): r.length for r in df.collect()}
    assert got["a/one", "t/0,0/x.jpg"] == 5 and got["b", "annotations.json"] == 3 and ("b", "below/manifest.json") in got and len(got) == 9
    assert {r.slug for r in df.filter("slug = 'a/one' and length > 2").collect()} == {"a/one"}
    sizes = {r.dir: r.files for r in files.folder_sizes(df.withColumnRenamed("slug", "dir")).collect()}
    assert sizes == {"a/one": 3, "a/two": 1, "b": 3, "c/d/e": 1, "abc": 1}
    assert df.filter(files.stamp(F.col("modified"), F.col("length")).rlike("^[0-9]+000/[0-9]+$")).count() == 9


def test_a_filter_lists_only_its_folders(library, listed):
    from pyspark.sql.datasource import EqualTo, StringStartsWith

    one = bundles.FilteredReader(str(library))
    assert list(one.pushFilters([EqualTo(("slug",), "a/one"), EqualTo(("manifest",), "x")])) == [EqualTo(("manifest",), "x")]
    assert [r[0] for r in read(one)] == ["a/one"]
    assert set(listed) == {f"{library}/a", f"{library}/a/one"}
    listed.clear()
    few = bundles.FilteredReader(str(library))
    assert list(few.pushFilters([StringStartsWith(("slug",), "c/d")])) == []
    assert [r[0] for r in read(few)] == ["c/d/e"]
    assert set(listed) == {f"{library}/c", f"{library}/c/d", f"{library}/c/d/e"}
