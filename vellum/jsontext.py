"""Text of polymorphic JSON values (labels and metadata of presentation documents).

Values nest without bound, so a JVM expression can't follow them; this is the one
Arrow-batched helper of the engine, and it only looks at labels and values that
``from_json`` has cut out as raw strings.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.dates import trimmed
from .jsontree import decode


def _number(x: int | float) -> str:
    """Shortest decimal of the 64-bit value, never with an exponent."""
    value = float(x)
    text = format(Decimal(repr(value)), "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


def _tagged(item: object, lang: str) -> bool:
    if not isinstance(item, dict):
        return False
    names = [item.get(k) for k in ("@language", "language")]
    return next((n for n in names if isinstance(n, str)), "") == lang


def _candidates(value: dict | list, prefer: Sequence[str]) -> list:
    """What a map or a list may take its text from, best first."""
    if isinstance(value, list):
        tagged = [item.get("@value", item.get("value")) for lang in prefer for item in value if _tagged(item, lang)]
        return [*tagged, *value]
    if "@value" in value:
        return [value["@value"]]
    first = [value[key] for key in (*prefer, "none") if key in value]
    return [*first, *(value[key] for key in sorted(value, key=str.encode))]


def coerce(value: object, prefer: Sequence[str] = ("en",)) -> str:
    """The first text that isn't empty, candidates before what stands behind them.

    A part that comes up again has been searched without a find by then, so each is searched once.
    """
    left, searched = [value], set()
    while left:
        x = left.pop()
        if isinstance(x, str):
            if x:
                return x
        elif isinstance(x, bool) or x is None:
            continue
        elif isinstance(x, int | float):
            return _number(x)
        elif id(x) not in searched:
            searched.add(id(x))
            left += reversed(_candidates(x, prefer))
    return ""


def text_of(raw: Column, prefer: Sequence[str] = ("en",)) -> Column:
    """Text of a raw JSON value; '' where it is null, not JSON, nests too deep, or has none."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        def one(v: str | None) -> str:
            try:
                return "" if v is None else coerce(decode(v), prefer)
            except ValueError:
                return ""

        return values.map(one)

    return run(raw)


def member_text(raw: Column, prefer: Sequence[str] = ("en",)) -> Column:
    """Text of a member that ``from_json`` read as string: strings come without quotes,
    objects and lists as JSON."""
    nested = raw.rlike(r"\A\s*[\[{]")
    return F.coalesce(F.when(nested, text_of(F.when(nested, raw), prefer)).otherwise(raw), F.lit(""))


def title_of(manifest: Column, prefer: Sequence[str] = ("en",)) -> Column:
    """Text of a document's ``label``; '' where there is none, or no JSON."""
    return member_text(F.from_json(manifest, "label string")["label"], prefer)


def metadata_rows(documents: DataFrame, key: str, manifest: str, prefer: Sequence[str] = ("en",)) -> DataFrame:
    """``(key, pos, label, value)`` of documents' metadata, blank labels dropped; see :func:`metadata_of`."""
    rows = documents.select(key, F.posexplode(metadata_of(F.col(manifest))).alias("pos", "m"))
    texts = rows.select(key, "pos", member_text(F.col("m.label"), prefer).alias("label"), member_text(F.col("m.value"), prefer).alias("value"))
    return texts.filter(trimmed(F.col("label")) != "")


def metadata_of(manifest: Column) -> Column:
    """``array<struct<label, value>>`` of raw JSON texts; null where ``metadata`` isn't a list."""
    return F.from_json(manifest, "metadata array<struct<label:string,value:string>>")["metadata"]
