"""Counts: facets in one pass, source health, publications, map clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.present import CATEGORIES, category
from .search import truthy_price

#: Bands of a score from the lowest up.
BANDS = ("BAIXA", "MODERADA", "BOA", "ALTA")


def facets(lots: DataFrame) -> DataFrame:
    """(facet, value, n): counts by place, asset, category, sphere and status, in one scan with grouping sets.

    Every category appears, with 0 if it must.
    """
    with_groups = lots.withColumn("category", category(F.col("nature"), F.col("zone"))).withColumn("place", F.concat_ws("/", "uf", "city"))
    names = ("place", "asset", "category", "sphere", "status")
    sets = [[F.col(n)] for n in names]
    counts = with_groups.groupingSets(sets, *(F.col(n) for n in names)).agg(F.count(F.lit(1)).alias("n"), *(F.grouping(n).alias(f"_{n}") for n in names))
    facet, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for n in names:
        facet, value = F.when(F.col(f"_{n}") == 0, n).otherwise(facet), F.when(F.col(f"_{n}") == 0, F.col(n)).otherwise(value)
    found = counts.select(facet.alias("facet"), value.alias("value"), "n")
    every = lots.sparkSession.createDataFrame([("category", c) for c in CATEGORIES], "facet string, value string")
    zeros = every.join(found, ["facet", "value"], "left_anti").withColumn("n", F.lit(0).cast("long"))
    return found.unionByName(zeros)


def price_range(lots: DataFrame) -> DataFrame:
    return lots.agg(F.min(truthy_price()).alias("least"), F.max(truthy_price()).alias("most"))


def source_health(sources: DataFrame, runs: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Every source with its latest run and its runs and failures of the last days; one pass over the runs."""
    recent = F.col("started_at") >= F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(days))
    seen = runs.groupBy("source").agg(
        F.max(F.struct("started_at", "run_id", "run_status")).alias("latest"),
        F.count_if(recent).alias("runs"),
        F.count_if(recent & (F.col("run_status") == "FALHA")).alias("failures"),
    )
    return sources.join(seen, "source", "left").select("source", F.col("latest.started_at").alias("last_at"), F.col("latest.run_status").alias("last_status"), F.coalesce("runs", F.lit(0)).alias("runs"), F.coalesce("failures", F.lit(0)).alias("failures"))


def run_status(runs: DataFrame) -> DataFrame:
    """runs plus run_status from (blocked, failed, warnings, items)."""
    status = F.when(F.col("blocked"), "BLOQUEADA").when(F.col("failed"), "FALHA").when(F.col("warnings") > 0, "PARCIAL").otherwise("SUCESSO")
    return runs.withColumn("run_status", status)


def publication_page(publications: DataFrame, number: int = 1, size: int = 50) -> DataFrame:
    return publications.orderBy(F.col("published_on").desc_nulls_last(), F.col("publication_id").desc()).offset(max(0, (number - 1) * size)).limit(size)


def publication_counts(publications: DataFrame) -> DataFrame:
    return publications.agg(F.count(F.lit(1)).alias("total"), F.count_if("detected").alias("detected"))


def map_clusters(lots: DataFrame) -> DataFrame:
    """Members and best band of each place."""
    ordinal = F.array_position(F.array(*map(F.lit, BANDS)), F.col("band"))
    found = lots.groupBy("uf", "city").agg(F.count(F.lit(1)).alias("members"), F.max(ordinal).alias("o"))
    return found.select("uf", "city", "members", F.get(F.array(*map(F.lit, BANDS)), (F.col("o") - 1).cast("int")).alias("best_band"))


def by_month(events: DataFrame) -> DataFrame:
    return events.groupBy(F.date_format(F.col("at") - F.expr("INTERVAL 3 HOURS"), "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def findings_quality(findings: DataFrame) -> DataFrame:
    """Mean confidence, to three places, and how many findings a person should look at, for each lot."""
    return findings.groupBy("lot_id").agg(F.bround(F.avg(F.col("confidence").cast("decimal(6,3)")), 3).cast("decimal(6,3)").alias("mean_confidence"), F.count_if(F.col("confidence") < 0.70).alias("to_review"))
