"""A corpus from raw documents to packed sequences: five stages, each a table that the next one reads.

quality    rows that the rule ensemble scores below REJECT_BELOW go
near_dup   of each class of near copies one row stays
benchmark  rows that hold a benchmark item go
pii        personal data in the texts gives way to its kind in brackets
packing    what is left becomes pieces of sequences of 4096 tokens, each with its ids

All stages read whole texts and take any columns beside those of documents, whatever their names, and hand them on,
but for packing. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from martelo.llm import decontamination, neardup, packing, pii, quality
from martelo.llm.common import scratch, stored, table

REJECT_BELOW = 0.3


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows that the quality classifier rejects. It learns from `labels` and these documents.

    Null and empty texts are scored as any other; without labelled rows nothing is rejected; repeated rows share
    their fate.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), threshold=REJECT_BELOW)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least key of each class of near copies; of repeated rows one. Null and empty texts are one
    class; a row without a key stays only where its class has none with a key."""
    return neardup.keep_first(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows that hold an item of `benchmark`. Null and empty texts hold none and stay."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with personal data replaced, and n_chars set where a text changed. Null texts stay null; no row goes."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids (little-endian unsigned 32-bit), sequence_id and offset of each
    piece: packing.sequences puts them together. A null or empty text is the end id alone; repeated rows are packed
    as often as they come."""
    return packing.pack(packing.cut(docs, keep_ids=True))


STAGES = [("quality", keep_good), ("near_dup", drop_near_copies), ("benchmark", drop_leaks), ("pii", redact_pii), ("packing", pack)]
#: SQL can't express trees, Poisson arrivals or tokenizers; tests/llm tests the stages one by one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all sequences, from `documents`. Tables between stages are deleted by the end of the call."""
    docs = table(spark, sf_dir, "documents")
    with scratch(spark):
        for _, stage in STAGES[:-1]:
            with scratch(spark):
                docs = stored(stage(spark, docs, sf_dir), keep=True)
        return STAGES[-1][1](spark, docs, sf_dir)
