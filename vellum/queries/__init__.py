"""Queries of the collection engine on the driver tables, with their oracles."""

from . import audit, catalogue, images, merge, sources, state, works, writes  # noqa: F401  (each registers its queries)
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
