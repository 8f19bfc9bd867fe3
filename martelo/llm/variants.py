"""Spelling variants: words of a vocabulary at distance one, and the common form of each.

Words are counted over all texts, added up in each task before they are shuffled. Pairs at distance one (a code
point inserted, deleted or replaced) come from a self-join of the vocabulary's trie with active-node sets: walking
down, each node carries the nodes whose strings are within distance one of its own, made from its parent's, and two
words whose ends meet in a set are a pair.

The trie is partitioned by prefixes. Words of m letters meet those of m and of m + 1 letters. Two such words are
equal either in their first half, and then they lie in one branch of the trie, or in their last half, and then they
lie in one branch of the trie of the words read backwards. A branch holds only what its words do not share. A branch
with more than BRANCH_WORDS words, or BRANCH_LETTERS letters, is halved in the same way: by the first half of what
its words do not share yet, and by the last half, until one place is left, where there can be no more words than
pairs of letters. A pair is told by the branch of equal beginnings if it is in one, else by the other, so
once; no branch, however many words begin alike, is one large task.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import scratch, slices, stored

#: Maximal runs of these letters are words; only A-Z are lower-cased.
LETTERS = "[A-Za-zÀ-ÿ]+"
LOWER = {i: i + 32 for i in range(0x41, 0x5B)}
#: Distinct words that a task adds up before it hands them on, and letters in them.
HELD_WORDS, HELD_LETTERS = 1 << 17, 1 << 22
#: Most words, and letters not shared, of a branch of the trie that one task holds.
BRANCH_WORDS, BRANCH_LETTERS = 20_000, 1 << 20
#: A form has at least so many times its variant's occurrences.
FORM_RATIO = 5


def misspelt(doc_id, every: int = 199) -> Callable[[str], str]:
    """What a word of a document becomes: one letter goes where the crc32 of '<doc_id>:<word>' is a multiple of
    `every`. A null doc_id is written as nothing."""
    begun = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())

    def change(word: str) -> str:
        h = zlib.crc32(word.encode(), begun)
        if h % every:
            return word
        at = h % len(word)
        return word[:at] + word[at + 1 :]

    return change


def _batched(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def vocabulary(df: DataFrame, key: str = "doc_id", text: str = "text", least_letters: int = 6, least_n: int = 5, change=misspelt) -> DataFrame:
    """(word, n): distinct words of at least so many letters and occurrences in all texts.

    change(key) gives a function that tells what is counted for a word of that text. Null texts have no words; repeated rows count as
    often as they come. Counts are added up in the tasks, in dictionaries of bounded size, so a word that fills the
    corpus reaches the shuffle as a few rows.
    """
    out = df.sparkSession.createDataFrame([], "word string, n long").schema
    arrow = to_arrow_schema(out)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, held, letters = re.compile(LETTERS).findall, Counter(), 0
        for batch in batches:
            for part in slices(batch):
                for k, t in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    changed = change(k) if change else str
                    for word, n in Counter(find((t or "").translate(LOWER))).items():
                        word = changed(word)
                        if len(word) >= least_letters:
                            if word not in held:
                                letters += len(word)
                            held[word] += n
                if len(held) >= HELD_WORDS or letters >= HELD_LETTERS:
                    yield _batched(list(held.items()), arrow)
                    held, letters = Counter(), 0
        yield _batched(list(held.items()), arrow)

    counted = df.select(key, text).mapInArrow(count, out)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n)


def _halved(words: DataFrame) -> DataFrame:
    """Each branch's words in two: those that share the first half of what is free, and those that share the last.

    m: letters of the shorter words; left, right: letters shared at both ends; apart: pairs that are equal up to
    there belong to another branch.
    """
    free = F.col("m") - F.col("left") - F.col("right")
    half = F.floor((free + 1) / 2).cast("int")
    ways = F.array(
        F.struct((F.col("left") + half).alias("left"), F.col("right").alias("right"), F.col("apart").alias("apart")),
        F.struct(F.col("left").alias("left"), (F.col("right") + free - half).alias("right"), (F.col("left") + half).alias("apart")),
    )
    return words.select("word", "n", "m", F.inline(ways)).withColumns(_branch())


def _branch() -> dict[str, Column]:
    """The key of a word's branch, and what the branch's words do not share."""
    size, left, right = F.char_length("word"), F.col("left"), F.col("right")
    ends = (F.substring("word", F.lit(1), left), F.substring("word", size - right + 1, right))
    number = lambda c: c.cast("string")
    return {
        "branch": F.concat_ws("/", number(F.col("m")), number(left), number(right), number(F.col("apart")), *ends),
        "free": F.substring("word", left + 1, size - left - right),
    }


def branches(words: DataFrame, most_words: int = BRANCH_WORDS, most_letters: int = BRANCH_LETTERS) -> DataFrame:
    """(branch, free, m, apart, word, n): every word in each branch that it may have a pair in, alone or not.

    Branches that are too large are halved, at most log2 of a word's letters times; each time their keys are
    counted, with partial sums before the shuffle.
    """
    large = (F.count(F.lit(1)) > most_words) | (F.sum(F.char_length("free")) > most_letters)
    whole = words.filter("word <> ''").withColumn("m", F.explode(F.array(F.char_length("word"), F.char_length("word") - 1)))
    open_ = stored(_halved(whole.filter("m > 0").withColumns({c: F.lit(0) for c in ("left", "right", "apart")})))
    done = None
    while True:
        split = stored(open_.filter("m - left - right > 1").groupBy("branch").agg(large.alias("large")).filter("large").select("branch"), narrow=True)
        kept = open_.join(split, "branch", "left_anti") if (more := bool(split.head(1))) else open_
        done = kept if done is None else done.unionByName(kept)
        if not more:
            return done.select("branch", "free", "m", "apart", "word", "n")
        open_ = stored(_halved(open_.join(split, "branch", "left_semi").drop("branch", "free")))


class Trie:
    """A trie of strings: children of each node, its depth, and the strings that end there."""

    def __init__(self, strings: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        for i, s in enumerate(strings):
            node = 0
            for c in s:
                at = self.children[node].get(c)
                if at is None:
                    at = self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                node = at
            self.ends[node].append(i)

    def pairs(self) -> Iterator[tuple[int, int]]:
        """(i, j) with i < j: numbers of the strings at distance one.

        A node's active set holds itself at distance 0 and others at distance 1. A child by c has, besides itself:
        its parent (c deleted), its siblings (c replaced), its own children (one letter more), the children by c
        of its siblings (one letter before c), and the children by c of the parent's active nodes.
        """
        children, ends = self.children, self.ends
        todo: list[tuple[int, tuple[int, ...]]] = [(0, tuple(children[0].values()))]
        while todo:
            node, active = todo.pop()
            for i in ends[node]:
                for v in active:
                    for j in ends[v]:
                        if i < j:
                            yield i, j
            own = children[node]
            for c, child in own.items():
                near = {node, *children[child].values()}
                near.update(own.values())
                near.update(w for v in active if (w := children[v].get(c)) is not None)
                near.discard(child)
                todo.append((child, tuple(near)))


PAIR = "word string, n long, near string, near_n long"


def pairs(words: DataFrame, most_words: int = BRANCH_WORDS, most_letters: int = BRANCH_LETTERS) -> DataFrame:
    """(word, n, near, near_n): each pair of words at distance one, once, from (word, n) with distinct words.

    Words may be of any length; null and empty words pair with nothing.
    """
    out: StructType = words.sparkSession.createDataFrame([], PAIR).schema
    arrow = to_arrow_schema(out)

    def found(rows: list[tuple[str, int, int, str, int]]) -> Iterator[tuple]:
        for i, j in Trie([r[0] for r in rows]).pairs():
            (_, letters, apart, x, x_n), (_, _, _, y, y_n) = rows[i], rows[j]
            if min(len(x), len(y)) == letters and (not apart or x[:apart] != y[:apart]):
                yield x, x_n, y, y_n

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        branch, rows, made = None, [], []
        for batch in batches:
            for b, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != branch:
                    if len(rows) > 1:
                        made += found(rows)
                    branch, rows = b, []
                    if len(made) > 1 << 14:
                        yield _batched(made, arrow)
                        made = []
                rows.append(tuple(row))
        if len(rows) > 1:
            made += found(rows)
        yield _batched(made, arrow)

    dealt = branches(words.filter("word is not null").select("word", "n"), most_words, most_letters)
    return dealt.repartition("branch").sortWithinPartitions("branch").select("branch", "free", "m", "apart", "word", "n").mapInArrow(walk, out)


def _rooted(forms: DataFrame, most_n: int) -> DataFrame:
    """(word, root) by doubling: each form has FORM_RATIO times the occurrences of its word, which bounds a chain."""
    links = max(1, math.ceil(math.log(max(most_n, 1), FORM_RATIO)) + 1)
    at = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(links))):
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = stored(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), narrow=True)
    return at


def groups(words: DataFrame, ratio: int = FORM_RATIO) -> DataFrame:
    """(word, n, form, form_n, root, n_near) of a vocabulary (word, n) of distinct words.

    A word's form is its near word with the most occurrences (ties: the least by code points), if that has at least
    `ratio` times the word's; root follows forms to the last. Words without a near word are their own root.
    """
    if ratio < FORM_RATIO:
        raise ValueError(f"a form has at least {FORM_RATIO} times the occurrences of its word")
    words = stored(words.select("word", "n"), keep=True)
    told = pairs(words)
    ways = F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    both = told.select(F.inline(ways))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = both.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    is_form = -F.col("best.less") >= F.col("n") * ratio
    near = stored(near.select("word", "n_near", F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")), keep=True)
    most = words.agg(F.max("n")).first()[0] or 1
    roots = stored(_rooted(near.filter("form is not null"), most), narrow=True, keep=True)
    all_ = words.join(near, "word", "left").join(roots, "word", "left")
    return all_.select("word", "n", "form", "form_n", F.coalesce("root", "word").alias("root"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def variant_groups(df: DataFrame, key: str = "doc_id", text: str = "text", least_letters: int = 6, least_n: int = 5, change=misspelt) -> DataFrame:
    """The groups of the vocabulary of all texts: one row for each word. Empty tables give no rows; tables between
    the steps go when it returns, but for those that the result reads."""
    spark: SparkSession = df.sparkSession
    with scratch(spark):
        return groups(vocabulary(df, key, text, least_letters, least_n, change))
