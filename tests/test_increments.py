"""Work that grows by what is new: change streams, journals; and the join of intervals."""

import random

import pytest
from pyspark.sql import functions as F

from vellum.operators import catalogue, select
from vellum.sources import graph
from vellum.streaming import changes


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_change_stream_by_batches(spark, tmp_path):
    source, table, state = f"{tmp_path}/in", f"{tmp_path}/table", f"{tmp_path}/state"

    def arrive(*events):
        spark.createDataFrame(events, "seq long, id string, activity string").coalesce(1).write.mode("append").parquet(source)

    def take():
        return rows(changes.first_changes(spark, source, ("Create", "Update"), table=table, state=state, files_per_batch=1), "id", "seq")

    def written():
        return {p.name: spark.read.parquet(str(p)).count() for p in (tmp_path / "table").iterdir()}

    arrive((5, "a", "Update"), (6, "b", "Create"), (7, "c", "Delete"), (8, None, "Create"))
    assert take() == [("a", 5), ("b", 6)]
    arrive((3, "a", "Create"))
    arrive((9, "d", "Create"), (4, "c", "Delete"))
    assert take() == [("a", 3), ("b", 6), ("d", 9)]
    had = written()
    assert sorted(had.values()) == [1, 1, 2]  # a batch writes its own objects
    assert take() == [("a", 3), ("b", 6), ("d", 9)] and written() == had  # nothing new, nothing written
    schema = "id string, seq long"
    assert changes.fold(spark, table, "id", "seq", schema) == 3 and list(written().values()) == [3]
    arrive((1, "b", "Update"))
    assert take() == [("a", 3), ("b", 1), ("d", 9)]
    assert changes.fold(spark, table, "id", "seq", schema) == 1 and changes.fold(spark, table, "id", "seq", schema) == 0
    assert rows(changes.current(spark, table, "id", "seq", schema), "id", "seq") == [("a", 3), ("b", 1), ("d", 9)]
    (next((tmp_path / "table").iterdir()) / "_SUCCESS").unlink()  # a fold that isn't whole doesn't count
    assert changes.current(spark, table, "id", "seq", schema).count() == 0


def test_last_rows_refresh_a_catalogue(spark, tmp_path):
    source, table, state = f"{tmp_path}/in", f"{tmp_path}/table", f"{tmp_path}/state"

    def seen(*rows_):
        spark.createDataFrame(rows_, "n long, dir string, stamp string, pages int").coalesce(1).write.mode("append").parquet(source)
        return changes.last_rows(spark, source, "dir", "n", ["stamp", "pages"], table, state)

    seen((1, "a", "s1", 3), (2, "b", "s1", 4), (3, "a", "s2", 5), (4, None, "x", 0))
    now = seen((2, "a", "old", 1), (5, "c", "s9:-", 1))
    assert rows(now, "dir", "n", "stamp", "pages") == [("a", 3, "s2", 5), ("b", 2, "s1", 4), ("c", 5, "s9:-", 1)]
    held = spark.createDataFrame([("a", "s1", 3, "t", "", "", 9), ("b", "s1", 4, "", "", "", 8)], "dir string, stamp string, pages int, title string, notes string, tags string, size int")
    got = catalogue.refreshed(held, now.select("dir", "stamp", "pages"))
    assert rows(got, "dir", "pages", "title", "size", "state") == [("a", 5, "t", None, "changed"), ("b", 4, "", 8, "same")]


def test_torn_journals_are_split(spark, tmp_path):
    had = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        lines = [f"https://x/{n}" for n in range(1000)]
        (tmp_path / "whole.log").write_text("\n".join(lines) + "\n")
        (tmp_path / "torn.log").write_text("\n".join(lines) + "\nhttps://x/5\nhttps://x/0")  # torn at a line that stands elsewhere
        (tmp_path / "one.log").write_text("https://tor")
        (tmp_path / "empty.log").write_text("")
        (tmp_path / "blank.log").write_bytes("é\r\n \n\n\rü".encode())
        got = graph.journal_lines(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 5
        kept = {}
        for r in got.collect():
            kept.setdefault(r.file.rpartition("/")[2], []).append(r.value)
        assert sorted(kept["whole.log"]) == sorted(lines) and sorted(kept["torn.log"]) == sorted([*lines, "https://x/5"])
        assert kept.get("one.log") is None and sorted(kept["blank.log"]) == ["", " ", "é\r"]
        assert sorted(r.url for r in graph.last_complete_lines(spark, str(tmp_path)).collect()) == sorted([*lines, "é\r"])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", had)


def test_appended_journals(spark, tmp_path):
    folder = f"{tmp_path}/journal"
    urls = lambda *x: spark.createDataFrame([(u,) for u in x], "url string")
    graph.append_lines(urls("a", "b", "a", "", None), folder)
    graph.append_lines(urls("b", "c"), folder)
    assert rows(graph.journal_lines(spark, folder), "value") == [("a",), ("b",), ("c",)]
    (tmp_path / "journal" / "part-torn.txt").write_text("d\ne")
    graph.append_lines(urls("e", "d"), folder)
    assert rows(graph.journal_lines(spark, folder), "value") == [("a",), ("b",), ("c",), ("d",), ("e",)]
    with pytest.raises(Exception, match="line feed"):
        graph.append_lines(urls("x\ny"), folder)


def test_overlapping_years_equal_all_pairs(spark):
    rnd = random.Random(5)

    def interval():
        at = rnd.randint(-500, 2100)
        return rnd.choice([(at, at), (at, at + rnd.randint(0, 12)), (at, at + rnd.choice((63, 64, 65, 127, 1 << 14))), (at + 3, at), (None, at), (at, None)])

    works = [(k, *interval()) for k in range(300)] + [(300, -9999, 9999), (301, 5, 5), (301, 5, 5)]
    periods = [(k, *interval()) for k in range(60)] + [(60, 0, 0), (61, -(1 << 20), 1 << 20)]
    a, b = spark.createDataFrame(works, "w int, s int, e int"), spark.createDataFrame(periods, "p int, lo int, hi int")
    want = sorted((w, p) for w, s, e in works for p, lo, hi in periods if None not in (s, e, lo, hi) and s <= hi and lo <= e)
    joined = select.overlapping(a, b, ("s", "e"), ("lo", "hi"))
    assert sorted((r.w, r.p) for r in joined.collect()) == want
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    undated = sum(None in (s, e) for _, s, e in works)
    counts = {p: undated for p, _, _ in periods}
    for _, p in want:
        counts[p] += 1
    assert {r.p: r.works for r in select.period_counts(a, b, "p", ("s", "e"), ("lo", "hi")).collect()} == counts
    assert select.period_counts(a.limit(0), b, "p", ("s", "e"), ("lo", "hi")).agg(F.sum("works")).first()[0] == 0


def test_many_periods_make_few_copies(spark):
    spans = spark.range(100_000).selectExpr("id as p", "cast(id % 2000 as int) as lo", "cast(id % 2000 + id % 300 as int) as hi")
    assert select._binned(spans, "lo", "hi", list(range(10))).count() < 100_000 * 20
