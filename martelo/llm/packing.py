"""Best-fit decreasing packing of token sequences, planned on the histogram of lengths.

No piece is longer than a sequence, so the lengths of any corpus make a histogram of at most `capacity` rows. Best
fit treats open sequences with the same room alike; the plan therefore runs over groups of such sequences, with a
segment tree over the remaining capacities to find the tightest room that fits in logarithmic time, and places as
many equal pieces at once as best fit would place one by one. Spark numbers the pieces of each length and applies
the plan; no list of documents ever meets in one place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import slices, stored, unused
from .tokens import encoder

CAPACITY = 4096
END_ID = 1


class Tightest:
    """A segment tree over 0..capacity: how many groups have each room, and the least room of at least so much."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << (capacity + 1).bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        at = room + self.size
        while at:
            self.tree[at] += n
            at >>= 1

    def find(self, least: int) -> int:
        """-1 if there is none."""
        at = least + self.size
        if self.tree[at]:
            return least
        while at > 1:
            if not at & 1 and self.tree[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at + (not self.tree[2 * at])
                return at - self.size
            at >>= 1
        return -1


def best_fit_decreasing(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Runs (first rank, first sequence, pieces in each sequence, offset of the first), by rank.

    Ranks number all pieces from the longest to the shortest. A run's pieces fill its sequences one after another.
    """
    tree, rooms, runs = Tightest(capacity), [[] for _ in range(capacity + 1)], []
    rank = opened = 0

    def put(room: int, first: int, n: int) -> None:
        if n:
            rooms[room].append((first, n))
            tree.add(room, 1)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = tree.find(length)
            if room < 0:
                room, each = capacity, capacity // length
                first, n = opened, -(-left // each)
                opened += n
            else:
                each = room // length
                first, n = rooms[room].pop()
                tree.add(room, -1)
            full = min(n, left // each)
            if full:
                runs.append((rank, first, each, capacity - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left:
                runs.append((rank, first + full, left, capacity - room))
                put(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            put(room, first + full, n - full)
    return np.array(runs, np.int64).reshape(-1, 4)


def cut(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row for each piece of each row of df: key, piece, start, length, ids_crc32, and the ids if asked for.

    A null or empty text is the end id alone. Only longer documents than `capacity` are cut. Repeated rows make
    repeated pieces; other columns are not carried.
    """
    fields = [T.StructField(key, df.schema[key].dataType), T.StructField("piece", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32"))]
    schema = T.StructType(fields + [T.StructField("ids", T.BinaryType())] * keep_ids)
    arrow = to_arrow_schema(schema)
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            for part_of in slices(batch):
                keys, texts = (c.to_pylist() for c in part_of.columns)
                rows = []
                for k, ids in zip(keys, own.encode(texts), strict=True):
                    ids += end
                    for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append((k, n, at // 4, len(part) // 4, zlib.crc32(part), part)[: len(arrow)])
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return df.select(key, text).mapInArrow(run, schema)


#: Rows of the table of offsets (16 bytes each) up to which it may be broadcast; beyond, the join shuffles.
BROADCAST_OFFSETS = 1_000_000


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces plus sequence_id and offset. Needs a `length` of 1 to capacity; other columns pass, and columns named
    sequence_id or offset are replaced. An empty table stays empty; equal pieces each get a place.

    The pieces are stored once with the number of their split and their rank among its pieces of equal length, which
    the task counts as it goes. A piece's rank among all of its length is the split's offset plus that rank, so the
    most common length never meets in one task and no piece is shuffled, unless the offsets outgrow a broadcast.
    """
    pieces = pieces.drop("sequence_id", "offset")
    spark, names = pieces.sparkSession, pieces.columns
    split, rank, count, before = unused(pieces, "_split", "_rank", "_n", "_offset")
    at = names.index("length")
    ranked_schema = T.StructType([*pieces.schema, T.StructField(rank, T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            lengths = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(lengths, kind="stable")
            _, first, n = np.unique(lengths[order], return_index=True, return_counts=True)
            ranks = np.empty(len(lengths), np.int64)
            ranks[order] = np.arange(len(lengths)) - np.repeat(first, n) + seen[lengths[order]]
            np.add.at(seen, lengths, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ranks)], names=ranked_schema.names)

    rows = stored(pieces.mapInArrow(number, ranked_schema).withColumn(split, F.spark_partition_id()), keep=True)
    counts = stored(rows.groupBy("length", split).agg(F.count(F.lit(1)).alias(count)), narrow=True, keep=True)
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum(count)).collect()}  # at most `capacity` rows
    plan = spark.sparkContext.broadcast(best_fit_decreasing(histogram, capacity))
    longer = np.zeros(capacity + 2, np.int64)
    for n, c in histogram.items():
        longer[n] = c
    longer = np.concatenate((np.cumsum(longer[::-1])[::-1][1:], [0]))  # pieces longer than each length
    earlier = W.partitionBy("length").orderBy(split).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("length", split, F.coalesce(F.sum(count).over(earlier), F.lit(0)).alias(before))
    if counts.count() <= BROADCAST_OFFSETS:
        offsets = F.broadcast(offsets)
    placed = rows.join(offsets, ["length", split]).withColumn(rank, F.col(before) + F.col(rank)).select(*names, rank)
    schema = T.StructType([*pieces.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = plan.value
        for batch in batches:
            length = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            place = batch.column(len(arrow) - 2).to_numpy(zero_copy_only=False) + longer[length]
            first, sequence, each, offset = runs[np.searchsorted(runs[:, 0], place, "right") - 1].T
            inside = place - first
            made = [pa.array(sequence + inside // each), pa.array(offset + inside % each * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(arrow) - 2], *made], schema=arrow)

    return placed.mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed ids themselves: one row for each sequence, from pieces that were cut with keep_ids."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("length"))
    return parts.select("sequence_id", "length", F.aggregate("p", F.lit(b""), lambda all_, x: F.concat(all_, x["ids"])).alias("ids"))
