"""One run from collected lots to the stored state: merge, calendar, and what the run counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import events as calendar
from . import identity

#: What a run counts.
COUNTERS = ("found", "new", "updated", "unchanged", "errors", "reschedules", "publications", "with_auction")
#: Fixed value: warnings that a run keeps as examples.
EXAMPLES = 10


def touched(stored: DataFrame, seen: DataFrame, as_of: str) -> DataFrame:
    """Stored lots (lot_id, content_hash, last_seen) after a run saw some (lot_id, content_hash) of them again: what was
    seen has the run's moment and hash, and `changed` where the hash is another."""
    new = seen.groupBy("lot_id").agg(F.max("content_hash").alias("_hash"))
    both = stored.join(new, "lot_id", "left")
    again = F.col("_hash").isNotNull()
    rest = [c for c in stored.columns if c not in ("content_hash", "last_seen")]
    return both.select(*rest, F.coalesce("_hash", "content_hash").alias("content_hash"), F.when(again, F.lit(as_of).cast("timestamp_ntz")).otherwise(F.col("last_seen")).alias("last_seen"), (again & ~F.col("_hash").eqNullSafe(F.col("content_hash"))).alias("changed"))


def statistics(rows: DataFrame) -> DataFrame:
    """Counters by source over rows (source, counter, n, warning): sums, so that runs and sources can be merged in any
    order; warnings are counted, and the ten most frequent kept as examples, in order of their text."""
    sums = [F.coalesce(F.sum(F.when(F.col("counter") == c, F.col("n"))), F.lit(0)).alias(c) for c in COUNTERS]
    counted = rows.groupBy("source").agg(*sums, F.count("warning").alias("warnings"))
    often = rows.filter("warning is not null").groupBy("source", "warning").agg(F.count(F.lit(1)).alias("times"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.col("times").desc(), "warning"))
    first = often.withColumn("rank", rank).filter(F.col("rank") <= EXAMPLES).groupBy("source").agg(F.array_sort(F.collect_list("warning")).alias("examples"))
    none = F.array().cast("array<string>")
    return counted.join(first.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source").withColumn("examples", F.coalesce("examples", none))


def merged_statistics(*parts: DataFrame) -> DataFrame:
    """The sum of several runs' statistics, by source; of their examples the first ten by text."""
    every = reduce(DataFrame.unionByName, parts)
    # ten a part: a source has as many as it has runs to merge
    examples = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("examples")))), 1, EXAMPLES)
    return every.groupBy("source").agg(*(F.sum(c).alias(c) for c in (*COUNTERS, "warnings")), examples.alias("examples"))


def run(stored: DataFrame, incoming: DataFrame, old_events: DataFrame, sessions: DataFrame, fill: tuple[str, ...], as_of: str) -> dict[str, DataFrame]:
    """A whole cycle over lots (lot_id, source, status, content_hash, and the columns to fill).

    lots: the stored state with incoming lots merged in, and `changed`; changes: events that are new, moved or gone,
    for the sessions of all lots; statistics: what each source's run counts. Everything is keyed by lot_id, so the
    steps share one partitioning.
    """
    lots = identity.merge(stored, incoming, "lot_id", fill=fill, replace=("content_hash", "status"), may_replace=F.lit(True))
    changes = calendar.difference(old_events, calendar.wanted(sessions, lots))
    mark = stored.select("lot_id", F.lit(True).alias("_known"))
    met = incoming.select("lot_id", "source").join(mark, "lot_id", "left").join(lots.select("lot_id", "changed"), "lot_id")
    kind = F.when(F.col("_known").isNull(), "new").when(F.size("changed") > 0, "updated").otherwise("unchanged")
    none = F.lit(None).cast("string")
    counted = met.select("source", F.lit("found").alias("counter"), F.lit(1).alias("n"), none.alias("warning")).unionByName(met.select("source", kind.alias("counter"), F.lit(1).alias("n"), none.alias("warning")))
    moved = changes.filter("change = 'remarcado'").join(lots.select("lot_id", "source"), "lot_id")
    counted = counted.unionByName(moved.select("source", F.lit("reschedules").alias("counter"), F.lit(1).alias("n"), none.alias("warning")))
    return {"lots": lots.withColumn("last_seen", F.lit(as_of).cast("timestamp_ntz")), "changes": changes, "statistics": statistics(counted)}
