"""Works from metadata rows, and their selection.  Missing data always matches."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import parse_date_range, present, trimmed
from ..functions.language import parse_language
from ..scratch import written
from .once import once

# Metadata labels (lower case) by what they hold.
FIELD_KINDS = {
    "language": ("language", "langue", "text language"),
    "date": ("date", "date statement", "date of origin (english)", "century"),
    "origin": ("origin", "place of origin", "place of origin (english)"),
}


def field_map(spark: SparkSession) -> DataFrame:
    """``(label, kind)``: a fixed dimension of ten rows."""
    rows = [(label, kind) for kind, labels in FIELD_KINDS.items() for label in labels]
    return spark.createDataFrame(rows, "label string, kind string")


def work_records(metadata: DataFrame, key: str) -> DataFrame:
    """``metadata(key, pos, label, value)`` -> one row per key: ``langs, date, origin``.

    Labels are looked up trimmed and in lower case, unknown ones drop out.  Languages
    are distinct codes in order of appearance; of dates the last readable one counts,
    of origins the last one, also if blank.  One shuffle; dates and origins are
    combined before it.
    """
    known = metadata.withColumn("label", F.lower(trimmed(F.col("label")))).join(
        F.broadcast(field_map(metadata.sparkSession)), "label"
    )
    fields = once(known, "date", F.when(F.col("kind") == "date", parse_date_range(F.col("value")))).select(
        key, "pos", "kind", "date",
        F.when(F.col("kind") == "language", parse_language(F.col("value"))).alias("code"),
        F.when(F.col("kind") == "origin", F.col("value")).alias("origin"),
    )
    made = fields.groupBy(key).agg(
        F.sort_array(F.collect_set(F.when(F.col("code").isNotNull(), F.struct("pos", "code")))).alias("codes"),
        F.max_by("date", F.when(F.col("date").isNotNull(), F.col("pos"))).alias("date"),
        F.max_by("origin", F.when(F.col("kind") == "origin", F.col("pos"))).alias("origin"),
    )
    return made.select(
        key, F.array_distinct(F.transform("codes", lambda c: c["code"])).alias("langs"), "date", "origin"
    )


@dataclass(frozen=True)
class Filter:
    """Criteria that a work must not fail.  A bound left at 0 is year 0, as given on one side only."""

    languages: Sequence[str] = ()
    years: tuple[int, int] | None = None
    places: Sequence[str] = ()

    def language_ok(self, langs: Column) -> Column:
        if not self.languages:
            return F.lit(True)
        return F.coalesce(F.size(langs) == 0, F.lit(True)) | F.coalesce(
            F.arrays_overlap(langs, F.array(*map(F.lit, self.languages))), F.lit(True)
        )

    def date_ok(self, date: Column) -> Column:
        if self.years is None:
            return F.lit(True)
        start, end = self.years
        d = present(date)
        return F.coalesce((d["start"] <= end) & (F.lit(start) <= d["end"]), F.lit(True))

    def origin_ok(self, origin: Column) -> Column:
        if not self.places:
            return F.lit(True)
        o = F.lower(trimmed(F.coalesce(origin, F.lit(""))))
        hit = o == ""
        for place in self.places:
            hit = hit | F.contains(o, F.lower(trimmed(F.lit(place))))
        return hit

    def classify(self, langs: Column, date: Column, origin: Column) -> Column:
        ok = self.language_ok(langs) & self.date_ok(date) & self.origin_ok(origin)
        return F.when(ok, "MATCH").otherwise("NO-MATCH")


def _binned(df: DataFrame, start: str, end: str, others: list[int]) -> DataFrame:
    """Rows with ``__lo, __own`` and one copy per bin: of their own level, and of higher levels that the other side has.

    A level's bins are as wide as its intervals can be, so an interval touches two at most.
    """
    sized = df.withColumns({"__lo": F.least(start, end).cast("long"), "__hi": F.greatest(start, end).cast("long")}).filter("__lo is not null and __hi is not null")
    sized = sized.withColumn("__own", F.when(F.col("__lo") == F.col("__hi"), 0).otherwise(F.length(F.bin(F.col("__hi") - F.col("__lo")))))
    levels = F.array_union(F.array("__own"), F.filter(F.array(*map(F.lit, others)).cast("array<int>"), lambda level: level > F.col("__own")))
    leveled = sized.withColumn("__level", F.explode(levels))
    at = lambda c: F.expr(f"shiftright({c}, __level)")
    return leveled.withColumn("__bin", F.explode(F.array_distinct(F.array(at("__lo"), at("__hi"))))).drop("__hi")


def overlapping(left: DataFrame, right: DataFrame, left_years: tuple[str, str], right_years: tuple[str, str]) -> DataFrame:
    """Pairs of rows of two tables whose years overlap: each starts no later than the other ends.  Null bounds meet nothing.

    An equi-join on bins of years.  An interval's level is the power of two that holds its length; a pair meets at the
    higher of its two levels, in the bin where the later of the two starts, hence once.  So a
    wide interval has as few copies as a narrow one.  Columns of the two sides must have different names.
    """
    (a, b), (c, d) = left_years, right_years
    kinds = lambda df, x, y: [r[0] for r in _binned(df.select(x, y), x, y, []).select("__own").distinct().collect()]  # noqa: E731  at most 65
    mine = _binned(left, a, b, kinds(right, c, d)).withColumnsRenamed({"__lo": "__llo", "__own": "__lown"})
    other = _binned(right, c, d, kinds(left, a, b)).withColumnsRenamed({"__lo": "__rlo", "__own": "__rown"})
    met = mine.join(other, ["__level", "__bin"])
    once_only = F.expr("greatest(__lown, __rown) = __level and shiftright(greatest(__llo, __rlo), __level) = __bin")
    exact = (F.col(a) <= F.col(d)) & (F.col(c) <= F.col(b))
    return met.filter(once_only & exact).select(*left.columns, *right.columns)


def _up_to(counted: DataFrame, marks: DataFrame) -> DataFrame:
    """``(__at, __sum)`` of all values of ``marks(__at)``: the sum of ``__n`` over values of ``counted(__at, __n)`` up to it.

    Values lie in blocks of 1,024: a window holds the values of one block, or a row a block.
    """
    values = counted.unionByName(marks.filter("__at is not null").withColumn("__n", F.lit(0).cast("long"))).groupBy("__at").agg(F.sum("__n").alias("__n"))
    values = values.withColumn("__block", F.shiftright("__at", 10))
    before = F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = values.groupBy("__block").agg(F.sum("__n").alias("__n")).select("__block", F.coalesce(before, F.lit(0)).alias("__base"))
    inside = F.sum("__n").over(Window.partitionBy("__block").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0))
    return values.withColumn("__inside", inside).join(blocks, "__block").select("__at", (F.col("__base") + F.col("__inside")).alias("__sum"))


def period_counts(works: DataFrame, periods: DataFrame, key: str, years: tuple[str, str], bounds: tuple[str, str]) -> DataFrame:
    """``periods`` with ``works``: how many works each period's years admit.  Works without a date are in every period.

    Works of equal years are one row, as periods of equal bounds are.  No pairs are made: of works that start up to a
    period's end, those that end before its start don't meet it.  Only where a work or a period ends before
    it starts, the different years are joined.  A null ``key`` is a key as any other.
    """
    (start, end), (low, high) = years, bounds
    as_year = lambda c, name: F.col(c).cast("long").alias(name)
    spans = written(works.groupBy(as_year(start, "__start"), as_year(end, "__end")).agg(F.count("*").alias("__n")), "spans")
    asked = written(periods.select(as_year(low, "__low"), as_year(high, "__high")).distinct(), "periods")
    forward = spans.filter("__start <= __end")
    begun = _up_to(forward.select(F.col("__start").alias("__at"), "__n"), asked.select(F.col("__high").alias("__at")))
    ended = _up_to(forward.select(F.col("__end").alias("__at"), "__n"), asked.select((F.col("__low") - 1).alias("__at")))
    met = asked.filter("__low <= __high").join(begun.withColumnsRenamed({"__at": "__high", "__sum": "__begun"}), "__high").join(
        ended.select((F.col("__at") + 1).alias("__low"), F.col("__sum").alias("__ended")), "__low")
    parts = [met.select("__low", "__high", (F.col("__begun") - F.col("__ended")).alias("__n"))]
    for some, others in ((spans.filter("__start > __end"), asked), (forward, asked.filter("__low > __high"))):
        if not some.isEmpty() and not others.isEmpty():
            parts.append(overlapping(some, others, ("__start", "__end"), ("__low", "__high")).select("__low", "__high", "__n"))
    dated = reduce(DataFrame.unionByName, parts).groupBy("__low", "__high").agg(F.sum("__n").alias("__dated"))
    undated = spans.agg(F.coalesce(F.sum(F.when(F.col("__start").isNull() | F.col("__end").isNull(), F.col("__n"))), F.lit(0)).alias("__undated"))
    same = (F.col(low).cast("long") == F.col("__low")) & (F.col(high).cast("long") == F.col("__high"))
    counted = periods.join(dated, same, "left").join(F.broadcast(undated))  # one row on the right
    return counted.select(*periods.columns, (F.coalesce("__dated", F.lit(0)) + F.col("__undated")).alias("works"))
