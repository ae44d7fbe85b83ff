"""Language names as two-letter codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import trimmed

# Accepted spellings by code.
ALIASES = {
    "fr": ("french", "français", "francais", "fre", "fra", "fr"),
    "la": ("latin", "lat", "la"),
    "en": ("english", "eng", "en"),
    "de": ("german", "deutsch", "ger", "deu", "de"),
    "it": ("italian", "italiano", "ita", "it"),
    "es": ("spanish", "español", "espanol", "castellano", "spa", "es"),
    "el": ("greek", "gre", "ell", "el"),
    "nl": ("dutch", "nederlands", "dut", "nld", "nl"),
}


def parse_language(text: Column) -> Column:
    """Two-letter code, or null for blank and unknown names; case and outer white space don't matter."""
    names = F.create_map(*[F.lit(x) for code, all_ in ALIASES.items() for name in all_ for x in (name, code)])
    return F.try_element_at(names, F.lower(trimmed(text)))
