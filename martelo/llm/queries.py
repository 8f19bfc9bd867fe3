"""The registered queries of this subpackage and the SQL that some of them can be held against."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, licences, minhash, neardup, packing, pii, quality, rollups, runs, sharding, toxicity, variants, warc
from .common import scratch, shared_folder, stored, table


def op1_rule_ensemble_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.scores(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op2_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return sharding.with_slots(rows).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op3_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches: all documents come in, later copies of a text go, and counts are revised to
    what is left when repeated lines of a text are dropped. The second batch is sent twice.

    Rows of one text are summed by source and language before any of them meet, so a text that fills the corpus
    is a few sums by the time it is shuffled."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.coalesce("text", F.lit("")).alias("text"))
    lines = F.array_join(F.array_distinct(F.split("text", "\n")), "\n")
    parts = F.array(*(F.struct(F.lit(n).alias("part"), c.alias("text")) for n, c in (("before", F.col("text")), ("after", F.col("lines")))))
    both = docs.withColumn("lines", lines).select("doc_id", "source", "lang", F.md5("text").alias("same"), (F.col("text") != F.col("lines")).alias("changed"), F.inline(parts))
    with scratch(spark):
        each = stored(rollups.counted(both.filter("part = 'before' or changed").drop("changed")))
        same = ("same", "source", "lang", "tokenizer")
        tokens = lambda part: F.max(F.when(F.col("part") == part, F.col("tokens"))).alias(part)
        groups = stored(each.groupBy(*same).agg(F.count_if(F.col("part") == "before").alias("n"), F.min("doc_id").alias("least"), tokens("before"), tokens("after")))
        first = groups.groupBy("same").agg(F.min_by(F.struct("source", "lang"), F.struct(F.col("least").isNull(), "least", "source", "lang")).alias("first"))
        marked = groups.join(first, "same").withColumn("kept", F.struct("source", "lang").eqNullSafe(F.col("first")))
        changes = lambda rows, docs, tokens: rows.select(*rollups.DIMENSIONS, docs.cast("long").alias("docs"), tokens.cast("long").alias("tokens"))
        rollup = rollups.Rollup(spark, f"{shared_folder(spark)}/rollups/{uuid.uuid4().hex}")
        rollup.commit("1-load", changes(groups, F.col("n"), F.col("n") * F.col("before")))
        copies = F.col("n") - F.col("kept").cast("int")
        for _ in range(2):
            rollup.commit("2-copies", changes(marked.filter(copies > 0), -copies, -copies * F.col("before")))
        changed = marked.filter("kept and before <> after")
        rollup.commit("3-lines", rollups.revised(changed.withColumn("tokens", F.col("before")), changed.withColumn("tokens", F.col("after"))))
    return rollup.totals()


def op4_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.scores(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op5_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.cut(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with an item that it holds, by id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "edits", "likeness")


def op8_licence_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.find_notices(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op9_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_probminhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "links", "likeness")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variant_groups(table(spark, sf_dir, "documents").select("doc_id", "text")).select("word", "form", "root", "n", "n_near", "form_n")


def op12_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.described(table(spark, sf_dir, "documents").select("doc_id", "text"), change=runs.repeated)


QUERIES = {
    "op1_rule_ensemble_quality": op1_rule_ensemble_quality,
    "op3_token_rollup": op3_token_rollup,
    "op4_kneser_ney_toxicity": op4_kneser_ney_toxicity,
    "op2_jump_sharding": op2_jump_sharding,
    "op5_semi_markov_pii": op5_semi_markov_pii,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_pigeonhole_decontamination": op7_pigeonhole_decontamination,
    "op8_licence_notices": op8_licence_notices,
    "op9_minhash_fingerprints": op9_minhash_fingerprints,
    "op10_probminhash_neardup": op10_probminhash_neardup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_warc_bundles": op12_warc_bundles,
    "op13_periodic_runs": op13_periodic_runs,
}
