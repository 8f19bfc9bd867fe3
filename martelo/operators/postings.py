"""Text search over lots by an index of three-letter pieces with their places.

The index has a row (piece, lot_id, place) for each letter of a lot's comparable body, the piece being the letter and
the two after it; the end is padded, so that every one- or two-letter stretch begins a piece too. It is dealt by
ranges of (piece, lot_id), so that a piece that most lots have is many tasks' and files', and sorted, so that a
filter on pieces reads the row groups that hold them.

A term stands in a body exactly where the pieces that cover it stand at their distances: every third one and the
last. So a search reads the postings of those pieces and nothing else, neither lots nor bodies, and needs no check
afterwards. It finds what `text.holds_all` finds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import comparable
from .search import BODY, _plain

PIECE = 3
PAD = "\u0001"


def postings(lots: DataFrame, key: str = "lot_id") -> DataFrame:
    """(piece, key, place) of each lot's body; of an empty one a single row, so that every lot has a place 0."""
    body = comparable(F.concat_ws(" ", *(F.col(c) for c in BODY if c in lots.columns)))
    places = F.sequence(F.lit(0), F.greatest(F.char_length("_body") - 1, F.lit(0)))
    padded = F.concat(F.col("_body"), F.lit(PAD * (PIECE - 1)))
    rows = F.transform(places, lambda i: F.struct(F.substr(padded, i + 1, F.lit(PIECE)).alias("piece"), i.alias("place")))
    # outer, though no array is empty: of an inner one Catalyst infers a filter that makes the pieces once more
    return lots.select(F.col(key), body.alias("_body")).select(key, F.inline_outer(rows)).select("piece", key, "place")


def build(lots: DataFrame, path: str, key: str = "lot_id") -> None:
    postings(lots, key).repartitionByRange("piece", key).sortWithinPartitions("piece", key, "place").write.parquet(path)


def parts_of(term: str) -> list[tuple[str, int]]:
    """The pieces that cover a term, with their distance from its start; a shorter term is the start of a piece."""
    if len(term) < PIECE:
        return [(term, 0)]
    last = len(term) - PIECE
    return [(term[i : i + PIECE], i) for i in sorted({*range(0, last + 1, PIECE), last})]


def _is(piece: str) -> Column:
    return F.col("piece") == piece if len(piece) == PIECE else F.col("piece").startswith(piece)


def found(spark: SparkSession, path: str, words: str, key: str = "lot_id") -> DataFrame:
    """The keys of the lots whose body holds every word, each once; all lots for no words."""
    index = spark.read.parquet(path)
    terms = {t: parts_of(t) for t in dict.fromkeys(_plain(words).split())}
    if not terms:
        return index.filter("place = 0").select(key)
    asked = [_is(piece) for piece in dict.fromkeys(p for parts in terms.values() for p, _ in parts)]
    wanted = asked[0]
    for one in asked[1:]:
        wanted = wanted | one
    hits = [F.when(_is(piece), F.struct(F.lit(n).alias("term"), (F.col("place") - away).alias("start"))) for n, parts in enumerate(terms.values()) for piece, away in parts]
    # one shuffle: what follows groups by the key and more
    rows = index.filter(wanted).repartition(key).select(key, F.inline(F.array_compact(F.array(*hits))))
    sizes = F.element_at(F.array(*(F.lit(len(parts)) for parts in terms.values())), F.col("term") + 1)
    whole = rows.groupBy(key, "term", "start").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == sizes)
    return whole.groupBy(key).agg(F.count_distinct("term").alias("n")).filter(F.col("n") == len(terms)).select(key)
