"""Connectors as rows: what there is, what may run, what it covers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "slug string, kind string, uf string, validated boolean, address string"


class Registry:
    """Connectors by slug. A second one under a slug is an error, and so is asking for an unknown one."""

    def __init__(self) -> None:
        self._rows: dict[str, tuple] = {}

    def add(self, slug: str, kind: str, uf: str | None = None, validated: bool = False, address: str = "") -> None:
        if slug in self._rows:
            raise ValueError(f"connector {slug} is registered already")
        self._rows[slug] = (slug, kind, uf, validated, address)

    def get(self, slug: str) -> tuple:
        if slug not in self._rows:
            raise KeyError(f"no connector {slug}; there are {', '.join(sorted(self._rows))}")
        return self._rows[slug]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(self._rows.values()), SCHEMA)


def listed(connectors: DataFrame, kind: str | None = None, uf: str | None = None) -> DataFrame:
    """By kind and state; a connector without a state covers all."""
    if kind:
        connectors = connectors.filter(F.col("kind") == kind)
    if uf:
        connectors = connectors.filter((F.col("uf") == uf) | F.col("uf").isNull())
    return connectors.orderBy("slug")


def blocked(forced: bool = False) -> Column:
    """Placeholders never run; unvalidated connectors only by force."""
    return F.col("address").contains("PREENCHER") | (~F.col("validated") & F.lit(not forced))


def profiles_to_suggest(auctioneers: DataFrame, hosts: Sequence[str]) -> DataFrame:
    """Auctioneers whose site is on none of the known hosts."""
    host = F.regexp_replace(F.lower(F.try_parse_url("site", F.lit("HOST"))), "^www\\.", "")
    known = auctioneers.sparkSession.createDataFrame([(h,) for h in hosts], "host string")
    return auctioneers.withColumn("host", host).filter("host is not null").join(known, "host", "left_anti")
