"""Gazette publications: filters, and detected auctions as thin lots with their findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parse, text
from .extract import FINDING, REVIEW_BELOW
from .terms import GOODS, asset_snippet, classify, detect, labels, signals

#: Names of the tracked states, and how long a lot's description and title may be.
STATE_NAMES = {"AL": "Alagoas", "BA": "Bahia", "PE": "Pernambuco", "SE": "Sergipe"}
LONGEST_DESCRIPTION, LONGEST_TITLE, LONGEST_PART = 4000, 300, 140
#: Signs of goods that make them a vehicle.
VEHICLE_SIGNS = ("veículo", "identificação veicular")


def wanted(publications: DataFrame, source: Sequence[str] = (), uf: Sequence[str] = (), sphere: Sequence[str] = (), detected: bool | None = None, review: bool | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Publications by gazette, state, sphere, detection, need of review and day of publication, both ends included."""
    found = publications
    for name, values in (("source", source), ("uf", uf), ("sphere", sphere)):
        if values:
            found = found.filter(F.col(name).isin(*values))
    for name, value in (("detected", detected), ("review", review)):
        if value is not None:
            found = found.filter(F.col(name) == value)
    if since:
        found = found.filter(F.col("published_on") >= F.lit(since).cast("date"))
    if until:
        found = found.filter(F.col("published_on") <= F.lit(until).cast("date"))
    return found


def section_state(c: Column) -> Column:
    """The state that a federal section is named after: a regional court's case numbers don't tell it."""
    named = text.comparable(F.nullif(F.regexp_extract(c, r"(?i)(?:sub)?se[cç][aã]o\s+judici[aá]ria\s+d[eoa]s?\s+([A-Za-zÀ-ÿ'\s-]{3,40})", 1), F.lit("")))
    found = F.lit(None).cast("string")
    for uf, name in reversed(list(STATE_NAMES.items())):
        found = F.when(F.contains(named, F.lit(name.lower())), uf).otherwise(found)
    return found


def sphere_of_text(c: Column) -> Column:
    """FEDERAL or ESTADUAL by what a publication calls its court, for sources that don't say."""
    low = text.comparable(c)
    federal = F.contains(low, F.lit("justica federal")) | F.contains(low, F.lit("secao judiciaria"))
    return F.when(federal, "FEDERAL").when(F.contains(low, F.lit("tribunal de justica")), "ESTADUAL").otherwise("DESCONHECIDA")


def title(asset: Column, organ: Column, place: Column) -> Column:
    """The asset's first clause and the organ, or else the place; a dot ends a clause only before a blank."""
    clause = text.tidy(F.get(F.split(asset, r";|\.\s| - "), F.lit(0)))
    parts = F.array_compact(F.array(F.nullif(clause, F.lit("")), F.coalesce(F.nullif(organ, F.lit("")), F.nullif(place, F.lit("")))))
    cut = F.transform(parts, lambda p: F.substring(p, 1, LONGEST_PART))
    return F.when(F.size(cut) == 0, "Leilão judicial").otherwise(F.substring(F.array_join(cut, " · "), 1, LONGEST_TITLE))


def detected(publications: DataFrame) -> DataFrame:
    """Publications that announce an auction: plus notice, asset (the passage that describes it) and its class.

    The class is read from that passage where there is one, so that a court's address is no sign of urban land.
    """
    found = detect(publications).filter(F.col("notice").isNotNull()).withColumn("asset_text", asset_snippet(F.col("text")))
    return classify(found.withColumn("_of", F.coalesce("asset_text", "text")), "_of").drop("_of")


def as_lots(found: DataFrame, facts: DataFrame) -> DataFrame:
    """Thin lots of detected publications (from `detected`), with only what their texts say.

    facts: findings of these publications (publication_id, name, and a value of one type), as from extract.
    """
    told = {"valor_avaliacao": "number", "comissao_leiloeiro": "number", "area_total_m2": "number", "percentual_minimo_segunda_praca": "number", "valor_minimo_praca_1": "number", "valor_minimo_praca_2": "number", "data_praca_1": "at", "data_praca_2": "at"}
    told |= dict.fromkeys(("comarca", "vara", "leiloeiro_nome", "leiloeiro_matricula", "matricula_imovel", "cartorio"), "text")
    wide = facts.groupBy("publication_id").agg(*(F.max(F.when(F.col("name") == n, F.col(kind))).alias(f"_{n}") for n, kind in told.items()))
    rows = found.join(wide, "publication_id", "left")
    session = lambda n, share: F.when(F.coalesce(F.col(f"_data_praca_{n}").cast("string"), F.col(f"_valor_minimo_praca_{n}").cast("string"), share.cast("string")).isNotNull(), F.struct(F.lit(n).alias("ordinal"), F.col(f"_data_praca_{n}").alias("at"), share.cast("decimal(5,2)").alias("share"), F.col(f"_valor_minimo_praca_{n}").cast("decimal(14,2)").alias("minimum")))
    vehicle = F.exists(labels(signals(text.comparable(F.coalesce("asset_text", "text")), GOODS)), lambda x: x.isin(*VEHICLE_SIGNS))
    return rows.select(
        "publication_id", "source",
        title(F.col("asset_text"), F.col("organ"), F.col("place")).alias("title"),
        F.when(F.col("nature") == "IMOVEL", "IMOVEL").when((F.col("nature") == "MOVEL") & vehicle, "VEICULO").otherwise("OUTRO").alias("asset"),
        F.substring(text.without_cpf(text.tidy(F.col("text"))), 1, LONGEST_DESCRIPTION).alias("description"),
        F.col("_valor_avaliacao").cast("decimal(14,2)").alias("appraisal"),
        F.array_compact(F.array(session(1, F.lit(None)), session(2, F.col("_percentual_minimo_segunda_praca")))).alias("sessions"),
        F.col("_comissao_leiloeiro").cast("decimal(5,2)").alias("commission"),
        F.coalesce(parse.case_number(F.col("text")), F.col("case_number")).alias("case_number"),
        "court",
        F.coalesce(F.col("_comarca"), F.col("place")).alias("comarca"),
        F.coalesce(F.col("_vara"), F.col("organ")).alias("chamber"),
        F.col("_leiloeiro_nome").alias("auctioneer_name"), F.col("_leiloeiro_matricula").alias("auctioneer_licence"),
        F.coalesce(F.col("uf"), section_state(F.col("text"))).alias("uf"),
        F.col("_matricula_imovel").alias("registry"), F.col("_cartorio").alias("office"), F.col("_area_total_m2").alias("total_area"),
        "nature", "zone", F.col("notice.score").alias("detection_score"), F.slice("notice.labels", 1, 8).alias("detection_terms"),
    )


def findings(found: DataFrame, facts: DataFrame) -> DataFrame:
    """(publication_id, name, confidence, text, number, at, flag, review): what detection and classification say of
    each publication, and the parser's facts."""
    kinds = {"text": "string", "number": "decimal(18,3)", "at": "timestamp_ntz", "flag": "boolean"}

    def made(name: str, sure: Column, **value: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), sure.cast("double").alias("confidence"), F.lit(None).cast("string").alias("evidence"), F.lit("REGRA").alias("method"), *(value.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items())).cast(FINDING)

    own = [
        made("leilao_detectado_em_diario", F.col("notice.score"), flag=F.lit(True)),
        F.when(F.col("nature") != "INDEFINIDA", made("natureza_bem", F.col("nature_score"), text=F.col("nature"))),
        F.when(F.col("zone") != "INDEFINIDA", made("zona_imovel", F.col("zone_score"), text=F.col("zone"))),
    ]
    names = ["publication_id", "name", "confidence", *kinds]
    detected_ones = found.select("publication_id", F.inline(F.array_compact(F.array(*own)))).select(names)
    return detected_ones.unionByName(facts.select(names)).withColumn("review", F.col("confidence") < REVIEW_BELOW)
