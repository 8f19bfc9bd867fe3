"""The opportunity score: five parts, each of them explainable, in exact decimals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most points of each part, bands, expected fields, penalties.
MOST = {"discount": 40, "quality": 20, "risk": 25, "window": 10, "history": 5}
BANDS = ((80, "ALTA"), (60, "BOA"), (40, "MODERADA"))
EXPECTED = {
    "IMOVEL": ("valor_avaliacao", "data_praca_1", "valor_minimo_praca_2", "matricula_imovel", "area_total_m2", "ocupado", "endereco"),
    "VEICULO": ("valor_avaliacao", "data_praca_1", "valor_minimo_praca_2", "marca", "modelo", "ano_modelo", "condicao_veiculo"),
    "OUTRO": ("valor_avaliacao", "data_praca_1", "valor_minimo_praca_2"),
}
LIENS = {"hipoteca": 5, "alienacao_fiduciaria": 6, "usufruto": 6, "indisponibilidade": 5, "inalienabilidade": 6, "arresto": 3, "penhora": 1, "servidao": 2, "arrolamento": 2}
DAMAGE = {"sucata": 10, "sem_documento": 7, "sem_motor": 6, "sem_chave": 3, "nao_vistoriado": 3}
CLOSED, BAD = ("ARREMATADO", "DESERTO", "SUSPENSO"), ("DESERTO", "SUSPENSO")


def points(c: Column) -> Column:
    """Points of a part: exact to ten places, as only the total is rounded."""
    return c.cast("decimal(13,10)")


def discount_part(discount: Column) -> Column:
    """All points from 50 per cent on."""
    share = F.least(F.coalesce(discount, F.lit(0)).cast("decimal(12,2)"), F.lit(50).cast("decimal(12,2)")) / F.lit(50).cast("decimal(2,0)")
    return points(F.greatest(share, F.lit(0)) * MOST["discount"])


def quality_part(asset: Column, confirmed: Column, has_documents: Column) -> Column:
    """Confirmed fields among those expected of the asset; half without a document."""
    part = F.lit(None).cast("decimal(13,10)")
    for kind, names in EXPECTED.items():
        found = F.size(F.array_intersect(confirmed, F.array(*map(F.lit, names))))
        part = F.when(asset == kind, points((found * MOST["quality"]).cast("decimal(16,10)") / F.lit(len(names)).cast("decimal(3,0)"))).otherwise(part)
    return points(F.when(has_documents, part).otherwise(part / 2))


def _penalty(found: Column, table: dict[str, int], other: int) -> Column:
    weights = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.aggregate(F.coalesce(found, F.array().cast("array<string>")), F.lit(0), lambda a, x: a + F.coalesce(F.try_element_at(weights, F.lower(F.trim(x))), F.lit(other)))


def risk_part(asset: Column, occupied: Column, liens: Column, damage: Column, buyer_pays: Column, from_price: Column, registry: Column) -> Column:
    land = asset == "IMOVEL"
    lost = (
        F.when(occupied, 9).when(occupied.isNull() & land, 3).otherwise(0)
        + _penalty(liens, LIENS, 2)
        + _penalty(damage, DAMAGE, 3)
        + F.when(buyer_pays, 4).otherwise(0)
        - F.when(from_price, 2).otherwise(0)
        + F.when(land & (F.coalesce(registry, F.lit("")) == ""), 3).otherwise(0)
    )
    return points(F.greatest(F.lit(0), F.least(F.lit(MOST["risk"]), F.lit(MOST["risk"]) - lost)))


def window_part(at: Column, passed: Column, as_of: str) -> Column:
    """Fewer whole days left, more points; none without a session to come."""
    days = F.floor((F.unix_micros(at.cast("timestamp")) - F.unix_micros(F.lit(as_of).cast("timestamp"))) / 86_400_000_000)
    return points(F.when(at.isNull() | passed, 0).when(days <= 3, 10).when(days <= 15, 8).when(days <= 45, 5).otherwise(3))


def history(lots: DataFrame) -> DataFrame:
    """(auctioneer_id, closed, bad, history): the share of closed lots that went well; neutral below five."""
    counts = lots.groupBy("auctioneer_id").agg(F.count_if(F.col("status").isin(*CLOSED)).alias("closed"), F.count_if(F.col("status").isin(*BAD)).alias("bad"))
    good = ((F.col("closed") - F.col("bad")) * MOST["history"]).cast("decimal(18,0)") / F.col("closed").cast("decimal(18,0)")
    return counts.withColumn("history", F.when(F.col("closed") < 5, F.lit("2.5").cast("decimal(13,10)")).otherwise(points(good)))


def band(total: Column) -> Column:
    found = F.lit("BAIXA")
    for least, name in reversed(BANDS):
        found = F.when(total >= least, name).otherwise(found)
    return found


def scored(lots: DataFrame, as_of: str) -> DataFrame:
    """(lot_id, five parts, score, band) of lots that carry discount, confirmed, has_documents, the risk columns,
    session_at, session_passed and history (null: no known auctioneer, so neutral)."""
    parts = {
        "discount_points": discount_part(F.col("discount")),
        "quality_points": quality_part(F.col("asset"), F.col("confirmed"), F.col("has_documents")),
        "risk_points": risk_part(*(F.col(c) for c in ("asset", "occupied", "liens", "damage", "buyer_pays", "from_price", "registry"))),
        "window_points": window_part(F.col("session_at"), F.col("session_passed"), as_of),
        "history_points": points(F.coalesce("history", F.lit("2.5").cast("decimal(13,10)"))),
    }
    made = lots.select("lot_id", *(c.alias(n) for n, c in parts.items()))
    total = F.bround(sum((F.col(n).cast("decimal(16,10)") for n in parts), F.lit(0).cast("decimal(16,10)")), 1).cast("decimal(5,1)")
    return made.withColumn("score", total).withColumn("band", band(F.col("score")))
