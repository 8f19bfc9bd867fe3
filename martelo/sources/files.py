"""Landed files as DataFrames: reference CSVs, gazette JSON, raw archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import comparable

#: What counts as true in a CSV.
TRUE_WORDS = ("1", "sim", "true", "demonstracao", "demonstração")
#: Names that different gazettes give one field.
ALIASES = {
    "external_id": ("id", "identificador", "codigo", "hash"),
    "text": ("texto", "conteudo", "content", "body"),
    "published_on": ("data_disponibilizacao", "dataDisponibilizacao", "data", "date"),
    "case_number": ("numeroprocessocommascara", "numero_processo", "numeroProcesso", "processo"),
    "organ": ("nomeOrgao", "orgao", "orgaoJulgador"),
    "court": ("siglaTribunal", "tribunal", "sigla"),
    "url": ("link", "url"),
}
ENVELOPES = ("items", "itens", "content", "data", "resultado")


def vehicle_table(spark: SparkSession, path: str) -> DataFrame:
    """A vehicle price mirror with '#' comment lines; brands upper-cased; the last row of a (code, year, month), by
    file and place in it."""
    raw = spark.read.schema("codigo_fipe string, marca string, modelo string, ano_modelo int, combustivel string, valor decimal(14,2), mes_referencia string, demonstracao string").csv(path, header=True, comment="#", mode="PERMISSIVE")
    rows = raw.select(F.col("codigo_fipe").alias("ref_id"), F.upper(F.trim("marca")).alias("brand"), F.col("modelo").alias("model"), F.col("ano_modelo").alias("year"), F.col("combustivel").alias("fuel"), F.col("valor").alias("value"), F.col("mes_referencia").alias("month"), F.coalesce(F.lower(F.trim("demonstracao")).isin(*TRUE_WORDS), F.lit(False)).alias("demo"))
    return last_rows(rows.withColumn("_n", F.monotonically_increasing_id()), ("ref_id", "year", "month"), "_n").drop("_n")


def last_rows(rows: DataFrame, keys: tuple[str, ...], sequence: str) -> DataFrame:
    """The last row of each key by the sequence; null keys are keys."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.col(sequence)).alias("_row")).select("_row.*")


def upserted(stored: DataFrame, new: DataFrame, keys: tuple[str, ...], updates: tuple[str, ...]) -> DataFrame:
    """Stored reference rows with new ones over them: a known key, null parts included, takes only the columns that
    updates name; unknown keys come in whole. Loading a file twice changes nothing."""
    mine, theirs = (df.select(*stored.columns, F.lit(n).alias("_side")) for n, df in enumerate((stored, new)))
    rest = [c for c in stored.columns if c not in keys]
    both = mine.unionByName(theirs).groupBy(*keys).agg(F.min_by(F.struct(*rest), "_side").alias("_old"), F.max_by(F.struct(*rest), "_side").alias("_new"))
    return both.select(*keys, *(F.col(f"{'_new' if c in updates else '_old'}.{c}").alias(c) for c in rest)).select(stored.columns)


def price_index(spark: SparkSession, path: str) -> DataFrame:
    """A price index by place and month; an empty district is null: the city's own row."""
    raw = spark.read.schema("uf string, cidade string, bairro string, valor_m2_venda decimal(14,2), mes_referencia string, observacao string").csv(path, header=True, comment="#")
    return raw.select(F.upper("uf").alias("uf"), F.col("cidade").alias("city"), F.nullif(F.trim("bairro"), F.lit("")).alias("district"), F.col("valor_m2_venda").alias("value_m2"), F.col("mes_referencia").alias("month"), F.col("observacao").alias("note"))


def centroids(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("uf string, cidade string, latitude double, longitude double").csv(path, header=True, comment="#")
    return raw.select(F.upper("uf").alias("uf"), comparable(F.col("cidade")).alias("city_key"), "latitude", "longitude")


def geocoded(lots: DataFrame, places: DataFrame) -> DataFrame:
    """lots with the centroid of their town; an equi-join that AQE may broadcast, by its measured size."""
    keyed = lots.withColumn("city_key", comparable(F.col("city")))
    return keyed.join(places, ["uf", "city_key"], "left").select(*lots.columns, "latitude", "longitude")


def aliased(document: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.nullif(F.try_variant_get(document, f"$.{n}", "string"), F.lit("")) for n in names))


def gazette(landed: DataFrame, body: str = "value") -> DataFrame:
    """Publications of landed API responses (one JSON text a row): any envelope key, any alias of a field; one row
    for each external id."""
    parsed = landed.select(F.try_parse_json(F.col(body)).alias("d"))
    lists = [F.try_variant_get("d", f"$.{e}", "array<variant>") for e in ENVELOPES]
    items = parsed.select(F.explode(F.coalesce(*lists, F.try_variant_get("d", "$", "array<variant>"))).alias("item"))
    return items.select(*(aliased(F.col("item"), names).alias(name) for name, names in ALIASES.items())).filter(F.col("external_id").isNotNull()).dropDuplicates(["external_id"])


def archive(raw: DataFrame, path: str) -> None:
    """Raw bodies by source and day: raw (source, day, url, body). Retention is dropping days."""
    raw.withColumn("digest", F.substring(F.sha2(F.col("body"), 256), 1, 16)).write.mode("append").partitionBy("source", "day").parquet(path)


def expired_days(spark: SparkSession, path: str, as_of: str, keep_days: int = 30) -> DataFrame:
    days = spark.read.parquet(path).select("source", "day").distinct()
    return days.filter(F.col("day") < F.date_sub(F.lit(as_of).cast("date"), keep_days))


def robots_allows(status: Column, disallowed: Column) -> Column:
    """Whether a path may be fetched: unreachable or failing robots files forbid, missing ones allow."""
    return F.when(status.isNull() | (status >= 500), False).when(status >= 400, True).otherwise(~F.coalesce(disallowed, F.lit(False)))
