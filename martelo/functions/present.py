"""Derived labels: status words, time left, score bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import comparable

#: Fixed values, first match first: words of a register's status column.
REGISTER_STATUS = (
    ("suspens", "SUSPENSO"),
    *((w, "INATIVO") for w in ("cancel", "baixad", "inativ", "destitu", "exonerad")),
    *((w, "ATIVO") for w in ("ativ", "em exercicio", "em atividade", "regular", "habilitad")),
)
#: Fixed values, first match first: words of a listing's status.
LOT_STATUS = (
    *((w, "ARREMATADO") for w in ("arremat", "vendido", "adjudicad")),
    *((w, "SUSPENSO") for w in ("suspens", "sobrestad")),
    *((w, "DESERTO") for w in ("deserto", "sem lance", "negativo")),
    *((w, "CANCELADO") for w in ("cancelad", "revogad", "anulad")),
    *((w, "ENCERRADO") for w in ("encerrad", "finalizad")),
)


def first_word(c: Column, table, otherwise: str) -> Column:
    low, found = comparable(c), F.lit(otherwise)
    for word, label in reversed(table):
        found = F.when(F.contains(low, F.lit(word)), label).otherwise(found)
    return found


def register_status(c: Column) -> Column:
    return first_word(c, REGISTER_STATUS, "DESCONHECIDO")


def lot_status(c: Column) -> Column:
    return first_word(c, LOT_STATUS, "ABERTO")


def time_left(at: Column, as_of: Column) -> Column:
    """Whole days until a moment, a level of urgency (alta within a day, media within seven) and the words for it."""
    micros = F.unix_micros(at.cast("timestamp")) - F.unix_micros(as_of.cast("timestamp"))
    minutes = F.floor(F.abs(micros) / 60_000_000)
    days = F.floor(minutes / 1440)
    hours = F.floor(minutes / 60)
    amount = F.when(days >= 2, F.concat(days.cast("string"), F.lit(" dias"))).when(hours >= 2, F.concat(hours.cast("string"), F.lit(" horas"))).when(minutes >= 2, F.concat(minutes.cast("string"), F.lit(" minutos"))).otherwise("menos de 1 minuto")
    level = F.when(at.isNull(), "nenhuma").when(micros < 0, "encerrada").when(days <= 1, "alta").when(days <= 7, "media").otherwise("baixa")
    words = F.when(at.isNull(), "sem data de praça").when(micros < 0, F.concat(F.lit("encerrada há "), amount)).otherwise(F.concat(F.lit("faltam "), amount))
    return F.struct(F.floor(micros / 86_400_000_000).alias("days"), level.alias("urgency"), words.alias("words"))


def category(nature: Column, zone: Column) -> Column:
    """The five groups of an agenda."""
    land = nature == "IMOVEL"
    return F.when(land & (zone == "RURAL"), "imovel_rural").when(land & (zone == "URBANA"), "imovel_urbano").when(land, "imovel_indefinido").when(nature == "MOVEL", "movel").otherwise("indefinido")


CATEGORIES = ("imovel_rural", "imovel_urbano", "imovel_indefinido", "movel", "indefinido")
