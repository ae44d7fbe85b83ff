"""Lists in text, labels and shell words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import trimmed


def split_list(text: Column) -> Column:
    """Comma-separated values, trimmed, blank ones dropped."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), trimmed)
    return F.filter(parts, lambda p: p != "")


def first_spellings(values: Column) -> Column:
    """Values without later ones that differ in case only; order and first spelling stay."""
    lower = F.transform(values, F.lower)
    return F.filter(values, lambda v, i: F.array_position(lower, F.lower(v)) == i + 1)


def normalize_tags(text: Column) -> Column:
    return F.array_join(first_spellings(split_list(text)), ", ")


def merge_tags(local: Column, incoming: Column) -> Column:
    """Local tags first, then incoming ones that are new (case ignored)."""
    return F.array_join(first_spellings(F.concat(split_list(local), split_list(incoming))), ", ")


def canonical_set(values: Column, fold: bool = False) -> Column:
    """Trimmed, blank ones dropped, distinct, in byte order."""
    made = F.transform(values, lambda v: F.lower(trimmed(v)) if fold else trimmed(v))
    return F.array_sort(F.array_distinct(F.filter(made, lambda v: v != "")))


def shell_quote(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\"'\"'")), F.lit("'"))


def megabytes(size: Column) -> Column:
    """Whole MiB, half to even; a dash for none."""
    return F.when(size > 0, F.concat(F.bround(size / F.lit(1048576.0), 0).cast("long").cast("string"), F.lit(" MB"))).otherwise("—")


def ordinal_name(n: Column, width: int = 4) -> Column:
    """Zero-padded to ``width``; longer numbers keep all digits."""
    text = n.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def or_else(value: Column, other: Column) -> Column:
    """``value`` unless null or ''."""
    return F.coalesce(F.nullif(value, F.lit("")), other)


def result_line(kind: Column, subject: Column) -> Column:
    """A verdict and what it is about."""
    return F.concat_ws(" ", kind, subject.cast("string"))


def comparison_query(docs: Column, canvases: Column) -> Column:
    """Query string of a comparison: documents, then canvases; blank ones at the end drop out."""
    last = F.aggregate(
        F.transform(canvases, lambda c, i: F.when(c != "", i + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x)
    )
    shown = F.slice(canvases, F.lit(1), last)
    pairs = F.concat(
        F.transform(shown, lambda c: F.concat(F.lit("canvas="), F.url_encode(c))), F.transform(docs, lambda d: F.concat(F.lit("doc="), F.url_encode(d)))
    )
    return F.array_join(pairs, "&")


def expand_home(path: Column, home: Column) -> Column:
    """A leading '~' alone or before '/' is ``home``."""
    return F.when(path == "~", home).when(F.startswith(path, F.lit("~/")), F.concat(home, F.substring(path, 2, 1 << 20))).otherwise(path)


def resolve_store(flag: Column, setting: Column, home: Column, default: str) -> Column:
    """The flag, else the setting, else ``default`` under ``home``."""
    return F.coalesce(*[expand_home(F.nullif(v, F.lit("")), home) for v in (flag, setting)], F.concat(home, F.lit("/" + default)))
