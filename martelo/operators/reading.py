"""Extractors that may fail, and what a model reported: findings of typed values, and a row for whatever went wrong."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Mapping
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parse
from ..functions.text import comparable
from ..sources.html import mapped
from .extract import MODEL_FIELDS, MODEL_ONLY

#: The kinds of a model's fields; the others are texts.
KINDS = {
    "number": ("valor_avaliacao", "valor_minimo_praca_1", "valor_minimo_praca_2", "area_total_m2", "area_privativa_m2", "ano_fabricacao", "ano_modelo"),
    "percent": ("percentual_minimo_segunda_praca", "comissao_leiloeiro"),
    "at": ("data_praca_1", "data_praca_2", "prazo_habilitacao"),
    "flag": ("ocupado", "edital_invoca_sub_rogacao_no_preco", "edital_atribui_debitos_ao_arrematante"),
}
#: Words for yes and no, shortest texts that are read, shortest and longest quotes.
YES, NO = ("sim", "true", "verdadeiro", "1", "ocupado"), ("nao", "false", "falso", "0", "desocupado")
LEAST_LETTERS, LEAST_QUOTE, LEAST_WORDS, FIRST_WORDS, MOST_EVIDENCE = 60, 12, 4, 6, 600
VALUES = "number decimal(18,3), text string, at timestamp_ntz, flag boolean, confidence double, evidence string"

Found = tuple[str, object, float, str]  # name, value, confidence, evidence


def _placed(value: object) -> tuple:
    """(number, text, at, flag): the value in the place of its type."""
    if isinstance(value, bool):
        return None, None, None, value
    if isinstance(value, (int, float, Decimal)):
        return round(Decimal(str(value)), 3), None, None, None
    if isinstance(value, dt.datetime):
        return None, None, value, None
    if isinstance(value, str):
        return None, value, None, None
    raise TypeError(f"a value of type {type(value).__name__}")


def cut(evidence: str) -> str:
    return evidence if len(evidence) <= MOST_EVIDENCE else evidence[: MOST_EVIDENCE - 3] + "..."


def isolated(df: DataFrame, extractors: Mapping[str, Callable[[str], Iterable[Found]]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Run a group of extractors over each text: (key, n, extractor, name, values, confidence, evidence, error).

    A row has a finding or an error. One that fails on a text, or gives what is no value, leaves one error for it and
    none of its findings; the others' stay, and so do the other texts'. Null texts, and those of fewer than 60
    letters, have one error without an extractor. Confidences are kept within 0 and 1.
    """

    def rows(body: str | None) -> list[tuple]:
        if body is None or len(body.strip()) < LEAST_LETTERS:
            return [(None, None, *(None,) * 6, "empty or too short to read")]
        made: list[tuple] = []
        for name, extractor in extractors.items():
            try:
                own = [(name, field, *_placed(value), max(0.0, min(1.0, float(sure))), cut(proof), None) for field, value, sure, proof in extractor(body)]
            except Exception as error:  # whatever it is, the other extractors' findings stay
                own = [(name, None, *(None,) * 6, f"{name}: {error}")]
            made += own
        return made

    return mapped(df, [key, text], f"n int, extractor string, name string, {VALUES}, error string", rows)


def typed(name: Column, value: Column) -> dict[str, Column]:
    """number, text, at and flag of a reported value, by its field; all null where it can't be read as its kind."""
    of = {kind: name.isin(*fields) for kind, fields in KINDS.items()}
    digits = F.replace(F.regexp_replace(value, "[^0-9.,-]", ""), F.lit(","), F.lit(".")).try_cast("decimal(18,3)")
    word = comparable(value)
    return {
        "number": F.when(of["number"], F.coalesce(parse.money(value).cast("decimal(18,3)"), digits)).when(of["percent"], parse.percent(value).cast("decimal(18,3)")),
        "text": F.when(~(of["number"] | of["percent"] | of["at"] | of["flag"]), F.trim(value)),
        "at": F.when(of["at"], parse.moment(value)),
        "flag": F.when(of["flag"], F.when(word.isin(*YES), True).when(word.isin(*NO), False)),
    }


def reported(model: DataFrame, documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What a model reported of documents (key, name, value, confidence, quote) as findings and warnings: (key, name,
    number, text, at, flag, confidence, evidence, method, warning).

    A row with a warning has no value: its field is unknown, its quote is not in the document (comparable, twelve
    letters at least; or, of four words or more, its first six), or its value is none of the field's kind. Confidence
    is that of what only a model saw, at most. Documents that are missing hold no quote. A document's reports are
    gathered before they meet it, so each text moves once.
    """
    own = model.groupBy(key).agg(F.collect_list(F.struct("name", "value", "confidence", "quote")).alias("_own"))
    bodies = documents.select(key, comparable(F.col(text)).alias("_body")).filter(F.col(key).isNotNull())
    rows = own.join(bodies, key, "left").select(key, "_body", F.inline("_own"))
    quote = comparable(F.col("quote"))
    words = F.split(quote, " ")
    within = F.contains("_body", quote) | ((F.size(words) >= LEAST_WORDS) & F.contains("_body", F.array_join(F.slice(words, 1, FIRST_WORDS), " ")))
    known, real = F.col("name").isin(*MODEL_FIELDS), F.coalesce((F.char_length(quote) >= LEAST_QUOTE) & within, F.lit(False))
    values = typed(F.col("name"), F.col("value"))
    read = reduce(lambda a, b: a | b, (c.isNotNull() for c in values.values()))
    name = F.coalesce("name", F.lit("(none)"))
    rows = rows.select(key, "name", "confidence", "quote", known.alias("_known"), real.alias("_real"), read.alias("_read"), *(c.alias(n) for n, c in values.items()))
    warning = (
        F.when(~F.coalesce("_known", F.lit(False)), F.concat(name, F.lit(": no field of the list")))
        .when(~F.col("_real"), F.concat(name, F.lit(": the quote is not in the document")))
        .when(~F.col("_read"), F.concat(name, F.lit(": a value of another kind")))
    )
    proof = F.when(F.char_length("quote") > MOST_EVIDENCE, F.concat(F.substring("quote", 1, MOST_EVIDENCE - 3), F.lit("..."))).otherwise(F.col("quote"))
    sure = F.greatest(F.lit(0.0), F.least(F.coalesce("confidence", F.lit(MODEL_ONLY)), F.lit(MODEL_ONLY)))
    kept = rows.withColumn("warning", warning)
    clear = lambda c: F.when(F.col("warning").isNull(), c)
    return kept.select(key, "name", *(clear(F.col(n)).alias(n) for n in values), clear(sure).alias("confidence"), clear(proof).alias("evidence"), F.lit("LLM").alias("method"), "warning")
