"""Bounded, repeatable samples of the rows whose labels may be learned from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

#: At most so many labelled rows of each class are learned from (the documented bound of both classifiers).
ROWS_PER_CLASS = 8000


def training_rows(labels: DataFrame, label: str, key: str = "doc_id", rows_per_class: int = ROWS_PER_CLASS) -> DataFrame:
    """(key, y, part, weight): the rows_per_class keys of each class with the least hashes, none of them held out.

    part is 0 to 3, for setting rows aside. weight is the class's true count over its sampled count, so that weighted
    fits see the true shares whatever the size of the table; it is 1 where the bound does not bind. Rows without key or label don't count; of a key with several labels
    the largest holds. At most 2 * rows_per_class rows, so the result may be broadcast.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)).groupBy(key).agg(F.max(label).cast("double").alias("y"))
    ranked = known.withColumn("rank", F.xxhash64(key))
    parts = [ranked.filter(F.col("y") == y).orderBy("rank", key).limit(rows_per_class) for y in (0.0, 1.0)]
    counts = known.groupBy("y").agg(F.count(F.lit(1)).alias("all")).select("y", (F.col("all") / F.least("all", F.lit(rows_per_class))).alias("weight"))
    return parts[0].union(parts[1]).join(F.broadcast(counts), "y").select(key, "y", F.pmod(F.shiftrightunsigned("rank", 7), F.lit(4)).cast("int").alias("part"), "weight")
