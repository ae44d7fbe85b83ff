"""Free-text dates as closed intervals of years.  Built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CIRCA_YEARS = 20
_OUTER = r"\A[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+\z"


def trimmed(text: Column) -> Column:
    """Without Unicode white space at either end (Spark's ``trim`` takes blanks only)."""
    return F.regexp_replace(text, _OUTER, "")


def roman_to_int(text: Column) -> Column:
    """Value of a lower-case Roman numeral, read from the right: a sign below the largest so far
    counts negative.  Not validated ('iiii' is 4); 0 for any other letter."""
    signs = F.create_map(*[F.lit(x) for pair in {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}.items() for x in pair])
    values = F.transform(F.filter(F.split(F.reverse(text), ""), lambda c: c != ""), lambda c: F.try_element_at(signs, c))
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("top"))

    def add(acc: Column, v: Column) -> Column:
        low = v < acc["top"]
        return F.struct(
            F.when(low, acc["total"] - v).otherwise(acc["total"] + v).alias("total"),
            F.when(low, acc["top"]).otherwise(v).alias("top"),
        )

    total = F.aggregate(values, zero, add)["total"]
    return F.when(F.exists(values, lambda v: v.isNull()), 0).otherwise(total)


def century(n: Column) -> Column:
    return F.struct(((n - 1) * 100 + 1).cast("int").alias("start"), (n * 100).cast("int").alias("end"))


# The whole-text forms of a date.
YEAR = r"\A[0-9]{1,4}\z"
SPAN = r"\A([0-9]{1,4})\s*[-–—]\s*([0-9]{1,4})\z"
CENTURY = r"\A([0-9]{1,2})(?:st|nd|rd|th)\s+century\z"
CIRCA = r"\A(?:circa|ca\.?|c\.?)\s*([0-9]{1,4})\z"
ROMAN = (r"\A([ivxlcdm]+)(?:e|eme|ème|ère|er)?\s+si[eè]cle\z", r"\A(?:s\.?|siglo)\s+([ivxlcdm]+)\z")


def parse_date_range(text: Column) -> Column:
    """``struct<start int, end int>`` or null.

    Whole-text forms: '15th century' (0th: no date); 'xve siècle'; 'siglo xv', 's. xv';
    'circa 1450' (20 years to each side); '1450'; '1450-1500' in either order.  No text
    has two of these forms, so the cheap ones are tried first and a plain year costs one
    test.  Dates inside longer texts are not read.
    """
    return F.when(text.rlike(YEAR), _years(text, text)).otherwise(let(trimmed(text), _read))


def _years(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once: a lambda over a one-element list."""
    return F.transform(F.array(value), use)[0]


def _read(raw: Column) -> Column:
    def number(of: Column, pattern: str, k: int = 1) -> Column:
        return F.regexp_extract(of, pattern, k).cast("int")

    def words(norm: Column) -> Column:
        about, nth = number(norm, CIRCA), number(norm, CENTURY)
        found = F.when(norm.rlike(CIRCA), _years(about - CIRCA_YEARS, about + CIRCA_YEARS)).when(norm.rlike(CENTURY), F.when(nth > 0, century(nth)))
        for pattern in ROMAN:
            found = found.when(norm.rlike(pattern), let(roman_to_int(F.regexp_extract(norm, pattern, 1)), lambda n: F.when(n > 0, century(n))))
        return found

    a, b = number(raw, SPAN, 1), number(raw, SPAN, 2)
    return F.when(raw.rlike(YEAR), _years(raw, raw)).when(raw.rlike(SPAN), _years(F.least(a, b), F.greatest(a, b))).otherwise(
        let(F.lower(F.regexp_replace(raw, r"\s+", " ")), words))


def present(date: Column) -> Column:
    """The interval, or null for year 0 to year 0, which counts as no date when works are selected."""
    return F.when((date["start"] == 0) & (date["end"] == 0), None).otherwise(date)
