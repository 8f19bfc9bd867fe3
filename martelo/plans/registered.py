"""The registry of queries and of the DuckDB SQL they are held against."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from .lots import LOTS, SESSIONS, in_duckdb

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
WITH_LOTS = f"WITH lots AS ({in_duckdb(LOTS)}), sessions AS ({in_duckdb(SESSIONS)})"
PLAIN = f"trim(regexp_replace(lower(translate({{}}, '{text.ACCENTED}', '{text.UNACCENTED}')), '[ \\t\\n\\r\\f]+', ' ', 'g'))"


def query(oracle: str | None = None, with_lots: bool = False):
    """Register a function as the query of its name."""

    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            sql = f"{WITH_LOTS} {oracle}" if with_lots else oracle
            ORACLES[f.__name__] = re.sub(r"(?<!\")\bat\b(?!\")", '"at"', sql)  # a word of DuckDB's grammar
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dbl(*names: str):
    return [F.col(n).cast("double").alias(n) for n in names]
