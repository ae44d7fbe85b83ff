"""Institutions: how a host is to be asked, and what its metadata labels mean."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import host_of
from .select import FIELD_KINDS


@dataclass(frozen=True)
class Profile:
    interval_ms: int = 750
    jitter_ms: int = 600
    burst: int = 1
    browser: bool = False  # whether the host wants a browser's name
    fields: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: FIELD_KINDS)


# The default, and hosts with a profile of their own.
DEFAULT = Profile()
HOSTS = {"gallica.bnf.fr": Profile(interval_ms=13_000, jitter_ms=0, browser=True)}


def profiles(spark: SparkSession, hosts: Mapping[str, Profile] = HOSTS) -> DataFrame:
    """``(host, interval_ms, jitter_ms, burst, browser)``: a fixed dimension, a row a host."""
    rows = [(host, p.interval_ms, p.jitter_ms, p.burst, p.browser) for host, p in hosts.items()]
    return spark.createDataFrame(rows, "host string, interval_ms int, jitter_ms int, burst int, browser boolean")


def with_profile(requests: DataFrame, url: str, hosts: Mapping[str, Profile] = HOSTS, default: Profile = DEFAULT) -> DataFrame:
    """``requests`` with the ``host`` of their URL and its profile; hosts without one have the default."""
    known = F.broadcast(profiles(requests.sparkSession, hosts))  # fixed rows
    own = {"interval_ms": default.interval_ms, "jitter_ms": default.jitter_ms, "burst": default.burst, "browser": default.browser}
    met = requests.withColumn("host", host_of(F.col(url))).join(known, "host", "left")
    return met.select(*requests.columns, "host", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in own.items()])


def mapping_rows(spark: SparkSession, hosts: Mapping[str, Profile] = HOSTS, default: Profile = DEFAULT) -> DataFrame:
    """``(host, label, kind)`` in canonical order: '*' for the default, hosts and labels sorted."""
    everyone = {"*": default, **dict(sorted(hosts.items()))}
    rows = [(n, host, label, kind) for n, (host, p) in enumerate(everyone.items()) for label, kind in sorted((label, kind) for kind, labels in p.fields.items() for label in labels)]
    return spark.createDataFrame(rows, "ord int, host string, label string, kind string")
