"""Toxicity by class-conditional Kneser-Ney models of letters.

A text is its lower-case words with single blanks, five blanks before it and one after, letter by letter (UTF-8
bytes). Each letter is predicted from the ORDER - 1 before it, whatever words they belong to, so an expression of
several words counts as one of several letters does. Each class has its own counts of whole n-grams; both back off
to one shared model of shorter n-grams, recursively down to single letters and then to all bytes alike. The shared
counts are continuation counts (how many different letters precede an n-gram) over all documents. So a rare
spelling that neither class has counted weighs nothing, and variants of an expression share its weight.

A text's evidence is the difference of the classes' log-likelihoods per letter: over the whole text, over the most
toxic window of WINDOW letters, and by how much windows pass EXPRESSIVE, on the mean of all windows. A logistic
curve, fitted on labelled rows that the counts have not seen, turns these rates into a score.

An n-gram of up to seven bytes is the whole number that its bytes spell, so its context and its shorter n-grams are
shifts and masks of it, in numpy and in column expressions alike, and no hash can collide.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_rows, scratch, stored
from .labelled import ROWS_PER_CLASS, training_rows

ORDER = 5
#: Taken off each count: off the shared model's, and, as one occurrence in a labelled text says little, off a class's.
DISCOUNT, CLASS_DISCOUNT = 0.75, 1.5
#: Letters of the windows whose mean evidence is compared; letters before the text count nothing.
WINDOW = 8
#: From this mean difference a letter on, a window counts as an expression.
EXPRESSIVE = 0.3
FEATURES = ("whole", "strongest", "excess")
#: Bytes of text that each class's counts are taken from at most, in whole rows (a documented bound of the fit).
BYTES_PER_CLASS = 12_000_000
#: Buckets of keys by hash that the bound on bytes is kept by.
BUCKETS = 1024
#: n-grams that a task remembers having sent already.
REMEMBERED = 1_000_000
#: Letters whose n-grams are looked up at once.
SEGMENT = 1 << 20
#: Every byte that is no word's to a blank, after A-Z are lower-cased; bytes from 0x80 belong to words.
WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
BEFORE = b" " * (ORDER - 1)


def spelled(text: str | None) -> bytes:
    """The text as it is modelled, with the blanks around it; nothing for a text without words."""
    words = b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(WORD_BYTES).split())
    return BEFORE + words + b" " if words else b""


def grams_of(letters: bytes) -> np.ndarray:
    """int64: the n-gram of ORDER bytes that ends at each letter but the first ORDER - 1."""
    raw = np.frombuffer(letters, np.uint8).astype(np.int64)
    n = len(raw) - ORDER + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = raw[:n].copy()
    for i in range(1, ORDER):
        out <<= 8
        out |= raw[i : i + n]
    return out


def streams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text's number, n-gram) of every letter, in segments of bounded length."""
    parts: list[bytes] = []
    numbers: list[int] = []
    size = 0

    def flush():
        # n-grams across two texts are cut out: each text's own end ORDER - 1 before the next one's first letter
        docs = np.repeat(numbers, [len(p) - ORDER + 1 for p in parts])
        yield docs, np.concatenate([grams_of(p) for p in parts]) if parts else np.zeros(0, np.int64)

    for i, text in enumerate(texts):
        letters = spelled(text)
        for at in range(0, len(letters) - ORDER + 1, SEGMENT):
            part = letters[at : at + SEGMENT + ORDER - 1]
            parts.append(part)
            numbers.append(i)
            size += len(part)
            if size >= SEGMENT:
                yield from flush()
                parts, numbers, size = [], [], 0
    if parts:
        yield from flush()


def _counts(rows: DataFrame) -> DataFrame:
    """(gram, one, zero): how often each class has each whole n-gram, over rows (text, y)."""

    def make():
        def f(texts, ys):
            out = []
            for y in (1.0, 0.0):
                seen = [g for _, g in streams([t for t, own in zip(texts, ys, strict=True) if own == y])]
                if seen:
                    grams, n = np.unique(np.concatenate(seen), return_counts=True)
                    out.append((grams, n * (y == 1), n * (y == 0)))
            return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [[]] * 3

        return f

    return map_rows(rows, ["text", "y"], "gram long, one long, zero long", make).groupBy("gram").agg(F.sum("one").alias("one"), F.sum("zero").alias("zero"))


def _seen(docs: DataFrame, text: str) -> DataFrame:
    """(gram): the different whole n-grams of all documents. Tasks send one again at most once they have forgotten it."""

    def make():
        sent: set[int] = set()

        def f(texts):
            new: list[np.ndarray] = []
            for _, grams in streams(texts):
                own = [g for g in pd.unique(grams).tolist() if g not in sent]
                if len(sent) > REMEMBERED:
                    sent.clear()
                sent.update(own)
                new.append(np.array(own, np.int64))
            return [np.concatenate(new)] if new else [[]]

        return f

    return map_rows(docs, [text], "gram long", make).distinct()


def _end(gram: str, letters: int) -> Column:
    """The n-gram's last letters."""
    return F.col(gram).bitwiseAND(F.lit((1 << 8 * letters) - 1))


def _context(gram: str) -> Column:
    return F.shiftright(F.col(gram), 8)


def shared_model(seen: DataFrame) -> DataFrame:
    """(gram, p): the shared probability of the last letter of each n-gram of ORDER - 1 letters after the others.

    Interpolated Kneser-Ney over continuation counts. A level's counts follow from the level above: how many of its
    n-grams end in each shorter one.
    """
    levels, above = [], seen
    for k in range(ORDER - 1, 0, -1):
        above = stored(above.groupBy(_end("gram", k).alias("gram")).agg(F.count(F.lit(1)).alias("before")), narrow=True)
        levels.append((k, above))
    lower = None
    for k, level in reversed(levels):
        sums = level.groupBy(_context("gram").alias("context")).agg(F.sum("before").alias("total"), F.count(F.lit(1)).alias("kinds"))
        rows = level.withColumn("context", _context("gram")).join(sums, "context")
        rest = F.lit(1 / 256)
        if lower is not None:
            rows = rows.withColumn("end", _end("gram", k - 1)).join(lower.select(F.col("gram").alias("end"), F.col("p").alias("rest")), "end")
            rest = F.col("rest")
        p = (F.greatest(F.col("before") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("kinds") * rest) / F.col("total")
        lower = stored(rows.select("gram", p.alias("p")), narrow=True)
    return lower


class Evidence(NamedTuple):
    """Log-likelihood differences: of counted n-grams, and of any other n-gram after a counted context."""

    grams: np.ndarray
    gram_worth: np.ndarray
    contexts: np.ndarray
    context_worth: np.ndarray

    def of(self, grams: np.ndarray) -> np.ndarray:
        """The difference at each letter; each different n-gram is looked up once."""
        codes, distinct = pd.factorize(grams)
        worth = np.zeros(len(distinct))
        if len(self.grams):
            at = np.minimum(np.searchsorted(self.grams, distinct), len(self.grams) - 1)
            known = self.grams[at] == distinct
            worth[known] = self.gram_worth[at[known]]
            rest = np.flatnonzero(~known)
            context = distinct[rest] >> 8
            at = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
            hit = self.contexts[at] == context
            worth[rest[hit]] = self.context_worth[at[hit]]
        return worth[codes]


def class_probabilities(counts: pd.DataFrame) -> tuple[dict[str, np.ndarray], pd.DataFrame]:
    """Each class's probability of the last letter of each counted n-gram, and by context the share that it leaves
    to the shared model, from counts (gram, one, zero, p)."""
    context = counts["gram"].to_numpy() >> 8
    seen = pd.DataFrame({"context": context} | {c: counts[c].to_numpy() for c in ("one", "zero")} | {f"left_{c}": np.minimum(counts[c].to_numpy(), CLASS_DISCOUNT) for c in ("one", "zero")})
    by = seen.groupby("context").sum()
    place = by.index.get_indexer(context)
    made, rest = {}, pd.DataFrame(index=by.index)
    for c in ("one", "zero"):
        total = by[c].to_numpy()
        rest[c] = np.where(total > 0, by[f"left_{c}"].to_numpy() / np.maximum(total, 1), 1.0)
        made[c] = np.maximum(counts[c].to_numpy() - CLASS_DISCOUNT, 0) / np.maximum(total[place], 1) + rest[c].to_numpy()[place] * counts["p"].to_numpy()
    return made, rest


def fit_evidence(counts: pd.DataFrame) -> Evidence:
    """Differences from counts (gram, one, zero, p), one row for each counted n-gram."""
    counts = counts.sort_values("gram", ignore_index=True)
    p, rest = class_probabilities(counts)
    return Evidence(counts["gram"].to_numpy(), np.log(p["one"]) - np.log(p["zero"]), rest.index.to_numpy(), np.log(rest["one"].to_numpy()) - np.log(rest["zero"].to_numpy()))


def features_of(texts: list[str | None], evidence: Evidence) -> np.ndarray:
    """One row of FEATURES for each text: rates a letter; a text without words has zeros."""
    out = np.zeros((len(texts), len(FEATURES)))
    parts = [(docs, evidence.of(grams)) for docs, grams in streams(texts)]
    if not parts:
        return out
    docs, worth = (np.concatenate(x) for x in zip(*parts, strict=True))
    begins = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))
    whose, sizes = docs[begins], np.diff(np.concatenate((begins, [len(docs)])))
    sums = np.concatenate(([0.0], np.cumsum(worth)))
    out[whose, 0] = (sums[begins + sizes] - sums[begins]) / sizes
    ends, since = np.arange(1, len(docs) + 1), np.repeat(begins, sizes)
    rate = (sums[ends] - sums[np.maximum(since, ends - WINDOW)]) / WINDOW
    out[whose, 1] = np.maximum.reduceat(rate, begins)
    out[whose, 2] = np.log1p(100 * np.add.reduceat(np.maximum(rate - EXPRESSIVE, 0), begins) / sizes)
    return out


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression on weighted rows by Newton's method on standardised features: (mean, deviation, weights)."""
    if len(set(y.tolist())) < 2:
        return np.zeros(x.shape[1]), np.ones(x.shape[1]), np.append(np.zeros(x.shape[1]), 0.0 if not len(y) else 4.0 if y[0] else -4.0)
    share = weight / weight.sum()
    mean = share @ x
    deviation = np.sqrt(share @ (x - mean) ** 2) + 1e-9
    z = np.hstack(((x - mean) / deviation, np.ones((len(x), 1))))
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (share * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        w = w + np.linalg.solve(hessian, z.T @ (share * (y - p)) - ridge * w)
    return mean, deviation, w


def _within(rows: DataFrame, most: int) -> DataFrame:
    """The rows (key, text, y) of hash buckets of each class that together hold at most so many bytes of text: in
    order, each that still fits, so that one long text leaves out its own bucket only. Where none fits, the smallest.

    Only the buckets' sums reach the driver, so neither long texts nor repeated keys meet in one place.
    """
    bucket = F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int")
    sums = rows.groupBy("y", bucket.alias("bucket")).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes")).collect()
    within = F.lit(False)
    for y in (0.0, 1.0):
        own, total, chosen = sorted((r["bucket"], r["bytes"]) for r in sums if r["y"] == y), 0, []
        for number, size in own:
            if total + size <= most:
                total += size
                chosen.append(number)
        if not total and (large := [(size, number) for number, size in own if size]):
            chosen.append(min(large)[1])
        within = within | ((F.col("y") == y) & bucket.isin(chosen))
    return rows.filter(within)


def scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = 0.5, rows_per_class: int = ROWS_PER_CLASS, bytes_per_class: int = BYTES_PER_CLASS) -> DataFrame:
    """One row for each row of docs: key, held_out, score (likelihood of label 1), predicted and the features.

    Null and empty texts have no evidence and get the score of none; repeated rows repeat; without labelled rows
    of both classes all scores are alike. Other columns are not carried. Of a labelled key that repeats one text is
    learned from, that of the least hash. Each class is counted on at most
    rows_per_class labelled rows, of at most bytes_per_class bytes together, so that the model that driver and tasks
    hold is bounded (16 bytes for each n-gram and context); the shared counts are taken from all documents; the
    curve sees the true shares.
    """
    spark = docs.sparkSession
    known = F.broadcast(training_rows(labels, label, key, rows_per_class))
    with scratch(spark):
        labelled = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(known.withColumnRenamed(key, "key"), "key")
        first = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
        rows = stored(labelled.groupBy("key", "y", "part", "weight").agg(first).select("key", "text", "y", "part", "weight"))
        learned = _within(rows.filter("part > 0"), bytes_per_class)
        counts = stored(_counts(learned), narrow=True)
        shared = shared_model(stored(_seen(docs, text)))
        model = counts.withColumn("end", _end("gram", ORDER - 1)).join(shared.select(F.col("gram").alias("end"), "p"), "end").select("gram", "one", "zero", "p").toPandas()
        evidence = spark.sparkContext.broadcast(fit_evidence(model))
        del model

        def measure(df: DataFrame, columns: list[str], schema: str) -> DataFrame:
            def make():
                return lambda texts, *others: [*others, *features_of(texts, evidence.value).T]

            return map_rows(df, columns, schema + ", " + ", ".join(f"{n} double" for n in FEATURES), make)

        aside = measure(rows.filter("part = 0"), ["text", "y", "weight"], "y double, weight double").toPandas()
    mean, deviation, weights = fit_curve(aside[list(FEATURES)].to_numpy(), aside["y"].to_numpy(), aside["weight"].to_numpy())
    measured = measure(docs, [text, key], f"`{key}` {dict(docs.dtypes)[key]}")
    terms = [(F.col(n) - float(m)) / float(d) * float(w) for n, m, d, w in zip(FEATURES, mean, deviation, weights[:-1], strict=True)]
    score = 1 / (1 + F.exp(-(sum(terms, F.lit(float(weights[-1]))))))
    return measured.withColumn("score", score).select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *FEATURES)
