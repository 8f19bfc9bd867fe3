"""Benchmark decontamination by pigeonhole edit matching.

A test item of n letters counts as found where a document holds it with at most k = n // EDIT_EVERY edits. Cut into
k + 1 pieces, any such occurrence holds one piece unharmed: one Aho-Corasick pass finds all pieces of a block of
items, and Myers's bit-parallel distance verifies the places they point at. Both sides are compared as lower-case
words with single blanks. An item too short for edits must stand word for word. Items are dealt to blocks of
bounded size by their hashes; a block is one pass over the documents, and driver and tasks hold one block at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, scratch, slices, stored

EDIT_EVERY = 12
#: Items of fewer letters (as words) than this must stand at word borders, with as many edits as any.
FUZZY_FROM = 40
#: Length of the letter runs that a place is counted by before its distance is measured.
RUN = 5
#: Letters of items searched for in one pass over the documents.
BLOCK_LETTERS = 4_000_000
#: Word letters stay, anything else parts words; the same rule as for shingles.
WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def plain(text: str | None) -> str:
    """Lower-case words with single blanks, a letter for each byte."""
    return b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()).decode("latin-1")


def edit_budget(item: str) -> int:
    return len(item) // EDIT_EVERY


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def runs(text: str, start: int = 0, end: int | None = None) -> set[str]:
    part = text[start:end]
    return {part[i : i + RUN] for i in range(len(part) - RUN + 1)}


class Myers:
    """Where a pattern ends in a text with the fewest edits: all rows of the table in the bits of one number."""

    def __init__(self, pattern: str) -> None:
        self.n, self.full, self.top = len(pattern), (1 << len(pattern)) - 1, 1 << (len(pattern) - 1)
        self.bits: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.bits[c] = self.bits.get(c, 0) | 1 << i

    def search(self, text: str, start: int, end: int, most: int) -> tuple[int, int] | None:
        """(edits, end) of the first best place within text[start:end], if it takes at most `most` edits."""
        up, down, edits, full, top, bits = self.full, 0, self.n, self.full, self.top, self.bits
        best, at = most + 1, -1
        for i in range(start, min(end, len(text))):
            x = bits.get(text[i], 0)
            across = (((x & up) + up) ^ up) | x | down
            plus, minus = down | ~(across | up) & full, up & across
            if plus & top:
                edits += 1
            elif minus & top:
                edits -= 1
            if edits < best:
                best, at = edits, i + 1
            plus, minus = plus << 1 & full, minus << 1 & full  # a match may begin anywhere: row 0 stays 0
            x |= down
            up, down = minus | ~(x | plus) & full, plus & x
        return (best, at) if at >= 0 else None


def distance(a: str, b: str) -> int:
    """Letters inserted, deleted or replaced between two short strings."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def between_borders(item: str, letters: str, low: int, high: int, most: int) -> tuple[int, int] | None:
    """(edits, end) of the first best stretch of whole words within letters[low:high], if it takes at most `most`."""
    best = None
    starts = [i for i in range(max(0, low), min(high, len(letters))) if letters[i] != " " and (i == 0 or letters[i - 1] == " ")]
    ends = [i for i in range(max(0, low) + 1, min(high, len(letters)) + 1) if letters[i - 1] != " " and (i == len(letters) or letters[i] == " ")]
    for end in ends:
        for start in starts:
            if start < end and abs(end - start - len(item)) <= most and (d := distance(item, letters[start:end])) <= most and (best is None or d < best[0]):
                best = d, end
    return best


def searcher(items: list[tuple[int, str]]) -> Callable[[str | None], list[tuple[int, int, int, int]]]:
    """A function from a text to (item id, edits, letters of the item, end in the plain text) of each item found."""
    seeds: dict[str, list[tuple[int, int]]] = {}
    budgets, matchers = [edit_budget(x) for _, x in items], [Myers(x) for _, x in items]
    for i, (_, item) in enumerate(items):
        if not budgets[i]:
            seeds.setdefault(f" {item} ", []).append((i, 1))
            continue
        for at, piece in pieces(item, budgets[i]):
            seeds.setdefault(piece, []).append((i, at))
    # an edit harms at most RUN of an item's runs of letters, so any occurrence keeps at least so many of them
    grams = [runs(x) for _, x in items]
    least = [len(g) - RUN * k for g, k in zip(grams, budgets, strict=True)]
    automaton = ahocorasick.Automaton()
    for piece, where in seeds.items():
        automaton.add_word(piece, (len(piece), where))
    automaton.make_automaton()

    def search(text: str | None) -> list[tuple[int, int, int, int]]:
        letters = plain(text)
        if not letters or not seeds:
            return []
        found: dict[int, tuple[int, int]] = {}
        tried: dict[int, int] = {}  # item -> the last place that was verified
        # a blank on both sides, so that words at either end have borders; places count from the first letter
        for end, (size, where) in automaton.iter(f" {letters} "):
            for i, at in where:
                k, start = budgets[i], end - size - at
                if i in found and found[i][0] == 0 or tried.get(i) == start:
                    continue
                tried[i] = start
                item = items[i][1]
                if not k:  # the seed is the item between blanks, of which the first is no letter of the text
                    found[i] = 0, start + 2 + len(item)
                    continue
                if len(item) < FUZZY_FROM:
                    if hit := between_borders(item, letters, start - k, start + len(item) + k, min(k, found[i][0] - 1 if i in found else k)):
                        found[i] = hit
                    continue
                if letters.startswith(item, max(0, start)) and start >= 0:
                    found[i] = 0, start + len(item)
                    continue
                low, high = max(0, start - k), start + len(item) + k
                if least[i] > 0 and len(grams[i] & runs(letters, low, high)) < least[i]:
                    continue
                if hit := matchers[i].search(letters, low, high, min(k, found[i][0] - 1 if i in found else k)):
                    found[i] = hit
        return sorted((items[i][0], edits, len(items[i][1]), end) for i, (edits, end) in found.items())

    return search


def blocks(benchmark: DataFrame, item: str, text: str, letters: int = BLOCK_LETTERS) -> Iterator[tuple[bool, list[tuple[int, str]]]]:
    """(whether it is the only one, items as plain text) of each block; each distinct item once, under its least id.

    Items are dealt to blocks by hash, as many blocks as their letters take; one block at a time reaches the driver.
    """
    kind = dict(benchmark.dtypes)[item]

    def make():
        return lambda ids, texts: [ids, [plain(t) for t in texts]]

    words = map_rows(benchmark.select(item, text), [item, text], f"i {kind}, w string", make).filter("w <> ''")
    once = words.groupBy("w").agg(F.min("i").alias("i"))
    once = stored(once)
    n = max(1, -(-(once.agg(F.sum(F.length("w"))).first()[0] or 0) // letters))
    for block in range(n):
        mine = [(r["i"], r["w"]) for r in once.filter(F.pmod(F.xxhash64("w"), F.lit(n)) == block).orderBy("i", "w").collect()]
        if mine:
            yield n == 1, mine


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """One row for each row of docs and item that its text holds: key, item_id, edits, likeness, end (in the plain text).

    Null and empty texts hold nothing; null items and items without words are not searched for; equal items count
    once, under the least id; repeated rows repeat. Texts are read whole. Only the fewest edits of an item in a text
    are told, of equally good places the first. Other columns of docs are not carried; a key named item_id makes the
    item's column benchmark_item_id.
    """
    kinds, spark = dict(docs.dtypes), docs.sparkSession
    name = "item_id" if key.lower() != "item_id" else "benchmark_item_id"
    schema = f"`{key}` {kinds[key]}, {name} {dict(benchmark.dtypes)[item]}, edits int, likeness double, end long"
    found = None
    with scratch(spark):
        for only, block in blocks(benchmark, item, item_text, block_letters):
            shared = spark.sparkContext.broadcast(block)

            def make(shared=shared):
                search = searcher(shared.value)

                def f(keys, texts):
                    rows = [(k, i, e, 1 - e / n, at) for k, t in zip(keys, texts, strict=True) for i, e, n, at in search(t)]
                    return list(zip(*rows, strict=True)) or [[]] * 5

                return f

            rows = map_rows(docs, [key, text], schema, make)
            if not only:
                rows = stored(rows, keep=True)
                shared.unpersist()
            found = rows if found is None else found.unionByName(rows)
    return spark.createDataFrame([], schema) if found is None else found


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """The rows of docs whose texts hold no item. Null and empty texts stay; all columns pass; order doesn't matter.

    Each block of items filters what the blocks before it left, without a shuffle; with several blocks, what one
    leaves is stored before the next is read.
    """
    at, left, spark = docs.columns.index(text), docs, docs.sparkSession
    with scratch(spark):
        for only, block in blocks(benchmark, item, item_text, block_letters):
            shared = spark.sparkContext.broadcast(block)

            def run(batches, shared=shared):
                search = searcher(shared.value)
                for batch in batches:
                    for part in slices(batch):
                        yield part.filter(pa.array([not search(t) for t in part.column(at).to_pylist()], pa.bool_()))

            left = left.mapInArrow(run, docs.schema)
            if not only:
                left = stored(left)
                shared.unpersist()
        return stored(left, keep=True) if left is not docs and not only else left
