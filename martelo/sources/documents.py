"""Documents from their pages' texts, and the service that turns a document into findings of its lot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import repaired_pdf
from ..operators import extract, identity

#: A page with fewer letters counts as scanned, a document with fewer as empty.
LEAST_OF_PAGE, LEAST_OF_DOCUMENT = 120, 40
#: Findings that fill a lot's column of the same meaning.
LOT_COLUMNS = {
    "valor_avaliacao": "appraisal", "valor_minimo_praca_1": "first_min", "valor_minimo_praca_2": "second_min", "comissao_leiloeiro": "commission", "matricula_imovel": "registry", "cartorio": "office",
    "area_total_m2": "total_area", "area_privativa_m2": "private_area", "endereco": "address", "bairro": "district", "cidade": "city", "ocupado": "occupied", "marca": "brand", "modelo": "model",
    "ano_fabricacao": "built_year", "ano_modelo": "model_year",
}


def assembled(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a document from its pages (key, page, text, ocr_text): text, pages, ocr_pages, origin.

    A page whose own text is short takes the recognised one, where that is longer. A document whose text stays short
    counts as empty. Null texts are empty; recognition itself lies outside.
    """
    own, seen = F.coalesce("text", F.lit("")), F.coalesce("ocr_text", F.lit(""))
    scanned = (F.length(F.trim(own)) < LEAST_OF_PAGE) & (F.length(F.trim(seen)) > F.length(F.trim(own)))
    parts = pages.select(key, "page", F.when(scanned, seen).otherwise(own).alias("text"), scanned.alias("scanned"))
    whole = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"), F.count(F.lit(1)).cast("int").alias("pages"), F.count_if("scanned").cast("int").alias("ocr_pages"))
    body = repaired_pdf(F.array_join(F.transform("p", lambda x: x["text"]), "\n\n"))
    made = whole.withColumn("text", body)
    return made.select(key, F.when(F.length(F.trim("text")) < LEAST_OF_DOCUMENT, "").otherwise(F.col("text")).alias("text"), "pages", "ocr_pages", F.when(F.col("ocr_pages") > 0, "OCR").otherwise("PDF_TEXTO").alias("origin"))


def value_text(column: str = "text"):
    """A finding's value of whatever type as text."""
    return F.coalesce(F.col("number").cast("string"), F.col("at").cast("string"), F.col("flag").cast("string"), F.col(column))


def read_documents(lots: DataFrame, documents: DataFrame, held: DataFrame, model: DataFrame | None = None) -> dict[str, DataFrame]:
    """The document service: documents (lot_id, text) to findings, merged into those held (lot_id, name, confidence,
    method, value), and lots filled from the sure ones.

    Identity numbers are gone before any pattern runs. model: findings of a language model (lot_id, name, quote, text,
    number, at, flag, confidence), kept only where their quotes are in the text. What a document says replaces what is
    held, but for what a person entered; a lot's own values stay.
    """
    facts = extract.extract(documents, "lot_id")
    if model is not None:
        real = extract.check_model_findings(model, documents, "lot_id")
        facts = extract.fuse(facts, real, ("lot_id", "name"))
    new = facts.select("lot_id", "name", "confidence", "method", value_text().alias("value"))
    findings = identity.keep_findings(held, new, from_document=True)
    known = {f: c for f, c in LOT_COLUMNS.items() if c in lots.columns}
    renamed = findings.filter(F.col("name").isin(*known)).replace(known, subset=["name"])
    return {"findings": findings, "lots": identity.apply_findings(lots, renamed, tuple(known.values()))}
