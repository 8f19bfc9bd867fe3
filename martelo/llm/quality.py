"""Quality by a sparse rule ensemble.

Statistics of whole texts are measured once; boosted trees over them give conjunctive rules (each path from a root
is one), lasso logistic regression keeps the few that matter, and those are compiled into one Spark column
expression. Labels, language, source and key are never among the statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, map_rows, scratch, slices, stored
from .labelled import ROWS_PER_CLASS, training_rows
from .shingles import word_hashes

STATISTICS = (
    "letters", "words", "letters_in_word", "upper", "digit", "mark", "space", "beyond_ascii", "bang", "pipe", "distinct_words",
    "commonest_word", "repeated_pairs", "lines", "repeated_lines", "letters_in_line", "marked_words", "short_words", "stops",
)
#: What each byte counts as: a bit for each statistic that is a share of bytes.
BYTES = {
    "upper": [0x41 <= b <= 0x5A for b in range(256)],
    "digit": [0x30 <= b <= 0x39 for b in range(256)],
    "mark": [0x21 <= b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7E for b in range(256)],
    "space": [b in (9, 10, 11, 12, 13, 32) for b in range(256)],
    "beyond_ascii": [b >= 0x80 for b in range(256)],
    "bang": [b == 0x21 for b in range(256)],
    "pipe": [b == 0x7C for b in range(256)],
    "stops": [b == 0x2E for b in range(256)],
}
TABLE = np.array([BYTES[n] for n in BYTES], float)
MARKED = np.array(BYTES["mark"])


def statistics_of(text: str | None) -> list[float]:
    """The statistics of one whole text, in the order of STATISTICS; an empty text has zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(STATISTICS)
    n = len(raw)
    share = dict(zip(BYTES, (TABLE @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / n).tolist(), strict=True))
    low = raw.lower()
    starts, hashes = word_hashes(low)
    words = len(hashes)
    lines = [x for x in low.split(b"\n") if x.strip()]
    got = {"letters": np.log1p(n), "words": np.log1p(words), "lines": np.log1p(len(lines)), "letters_in_line": np.log1p(n / max(1, len(lines))), "letters_in_word": n / max(1, words)} | share
    got["repeated_lines"] = 1 - len(set(lines)) / max(1, len(lines))
    if words:
        _, counts = np.unique(hashes, return_counts=True)
        got["distinct_words"], got["commonest_word"] = len(counts) / words, counts.max() / words
        gaps = np.diff(np.append(starts, n + 1))
        got["short_words"] = float((gaps <= 4).mean())
        # a word whose neighbours include two marks in a row, as in "word!!" or "word***"
        letters = np.frombuffer(low + b"  ", np.uint8)
        got["marked_words"] = float(np.count_nonzero(MARKED[letters[:-1]] & MARKED[letters[1:]])) / words
    if words > 1:
        pairs = hashes[1:] * np.uint64(0x9E3779B97F4A7C15) ^ hashes[:-1]
        got["repeated_pairs"] = 1 - len(np.unique(pairs)) / len(pairs)
    return [float(got.get(name, 0.0)) for name in STATISTICS]


def statistics(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of df: key and its text's statistics. Null texts count as empty."""

    def make():
        return lambda keys, texts: [keys, *map(list, zip(*map(statistics_of, texts), strict=True))]

    kind = dict(df.dtypes)[key]
    return map_rows(df, [key, text], f"`{key}` {kind}, " + ", ".join(f"{n} double" for n in STATISTICS), make)


def with_statistics(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """df plus the statistics of each row's text, under prefixed names; every row and column passes."""
    schema = T.StructType([*df.schema, *(T.StructField(prefix + n, T.DoubleType()) for n in STATISTICS)])
    at, names = df.columns.index(text), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                made = np.array([statistics_of(t) for t in part.column(at).to_pylist()]).reshape(-1, len(STATISTICS))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(made[:, i]) for i in range(len(STATISTICS)))], names=names)

    return df.mapInArrow(run, schema)


class Test(NamedTuple):
    statistic: str
    above: bool
    threshold: float

    def column(self, prefix: str = "") -> Column:
        c = F.col(prefix + self.statistic)
        return c > self.threshold if self.above else c <= self.threshold


Rule = tuple[Test, ...]


class RuleEnsemble(NamedTuple):
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, prefix: str = "") -> Column:
        """The ensemble as one expression over columns named after the statistics."""
        terms = [F.when(holds(rule, prefix), F.lit(weight)).otherwise(0.0) for rule, weight in self.rules]
        return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, terms, F.lit(self.intercept))))


def holds(rule: Rule, prefix: str = "") -> Column:
    return reduce(lambda a, b: a & b, (t.column(prefix) for t in rule))


def paths(node, so_far: Rule = ()) -> Iterator[Rule]:
    """Every path from a tree's root to another node, with tests on the same side of a statistic merged."""
    if so_far:
        tightest: dict[tuple[str, bool], float] = {}
        for t in so_far:
            old = tightest.get((t.statistic, t.above), t.threshold)
            tightest[t.statistic, t.above] = max(old, t.threshold) if t.above else min(old, t.threshold)
        yield tuple(sorted(Test(s, a, x) for (s, a), x in tightest.items()))
    if node.getClass().getSimpleName() == "InternalNode":
        split = node.split()
        name, threshold = STATISTICS[split.featureIndex()], float(split.threshold())
        yield from paths(node.leftChild(), (*so_far, Test(name, False, threshold)))
        yield from paths(node.rightChild(), (*so_far, Test(name, True, threshold)))


def fit_rules(rows: DataFrame, trees: int = 12, depth: int = 3, penalty: float = 0.002, seed: int = 17) -> RuleEnsemble:
    """Fit on rows (y, weight, statistics). Boosted trees and the lasso both run as Spark jobs; rows is read many times."""
    data = rows.select("y", "weight", array_to_vector(F.array(*STATISTICS)).alias("features")).coalesce(2).cache()
    try:
        found = {r["y"]: r["weight"] for r in data.groupBy("y").agg(F.sum("weight").alias("weight")).collect()}
        if len(found) < 2:  # one class, or no labelled row at all
            return RuleEnsemble(0.0 if not found else 4.0 if 1.0 in found else -4.0, ())
        forest = GBTClassifier(labelCol="y", weightCol="weight", maxIter=trees, maxDepth=depth, maxBins=64, seed=seed, cacheNodeIds=False).fit(data)
        rules = list(dict.fromkeys(rule for tree in forest.trees for rule in paths(tree._java_obj.rootNode())))
        if not rules:  # statistics that tell no row from another: the classes' shares are all there is
            return RuleEnsemble(float(np.log(found[1.0] / found[0.0])), ())
        marked = rows.select("y", "weight", array_to_vector(F.array(*(holds(r).cast("double") for r in rules))).alias("features")).coalesce(2).cache()
        try:
            lasso = LogisticRegression(labelCol="y", weightCol="weight", elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False).fit(marked)
        finally:
            marked.unpersist()
        weights = [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if w]
        return RuleEnsemble(float(lasso.intercept), tuple(weights))
    finally:
        data.unpersist()


def scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.3, rows_per_class: int = ROWS_PER_CLASS) -> DataFrame:
    """One row for each row of docs: key, held_out, score (likelihood of label 1), predicted and the statistics.

    Null and empty texts have zero statistics and so a score; repeated rows repeat; without labelled rows the
    score is 0.5; where no statistic tells the classes apart it is the share of label 1. Other columns are not
    carried.
    """
    measured = stored(statistics(docs, key, text))
    known = training_rows(labels, label, key, rows_per_class)
    with scratch(docs.sparkSession):
        ensemble = fit_rules(stored(measured.join(F.broadcast(known), key)))
    scored = measured.withColumn("score", ensemble.score())
    return scored.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *STATISTICS)


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.3, rows_per_class: int = ROWS_PER_CLASS) -> DataFrame:
    """The rows of docs whose score is at least the threshold; their columns and repeated rows stay as they are.

    Only the labelled rows are measured to fit the rules; then each text is measured once and never shuffled.
    Without labelled rows every score is 0.5. Null and empty texts have zero statistics and so a score.
    """
    known = F.broadcast(training_rows(labels, label, key, rows_per_class).select(F.col(key).alias("__key"), "y", "weight"))
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("text")).join(known, "__key").select("text", "y", "weight")
    with scratch(docs.sparkSession):
        ensemble = fit_rules(stored(with_statistics(rows).drop("text")))
    prefix = "__stat_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return with_statistics(docs, text, prefix).filter(ensemble.score(prefix) >= threshold).select(docs.columns)
