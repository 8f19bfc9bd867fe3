"""When landed addresses may be fetched, and how long raw bodies are kept, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: least seconds between two requests to a host.
LEAST_DELAY = 1.5


def delays(hosts: DataFrame, least: float = LEAST_DELAY) -> DataFrame:
    """(host, delay_ms): a robots file's crawl_delay raises a host's delay and never lowers it."""
    seconds = F.greatest(F.coalesce(F.col("crawl_delay").cast("double"), F.lit(0.0)), F.lit(least))
    return hosts.groupBy("host").agg(F.max(F.ceil(seconds * 1000)).cast("bigint").alias("delay_ms"))


def schedule(queue: DataFrame, hosts: DataFrame, least: float = LEAST_DELAY, block: str = "HOUR") -> DataFrame:
    """queue (host, address, requested_at, any more) with starts_at: the earliest moment of each request.

    A host takes its requests one after another, by requested_at, then address, each a delay after the one before:
    request i starts at the latest of requested_at[j] + (i - j) * delay over all j up to i. Hosts that `hosts` doesn't
    name have the least delay. Rows without a host, address or moment have no start; repeated rows are requests of
    their own.

    A host's requests are numbered in blocks of an hour (or another unit), and the blocks' counts and maxima alone go
    through a window of the whole host, so that a host with most of the queue is as many groups as it has hours.
    """
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    known = F.col("host").isNotNull() & F.col("address").isNotNull() & F.col("requested_at").isNotNull()
    rows = queue.filter(known).join(delays(hosts, least), "host", "left").withColumn("_delay", F.coalesce("delay_ms", F.lit(int(least * 1000))) * 1000).drop("delay_ms")
    rows = rows.withColumn("_block", F.date_trunc(block, "requested_at"))
    before = Window.partitionBy("host").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("host", "_block").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("host", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    order = Window.partitionBy("host", "_block").orderBy("requested_at", "address")
    numbered = rows.join(offsets, ["host", "_block"]).withColumn("_i", F.col("_before") + F.row_number().over(order) - 1)
    numbered = numbered.withColumn("_free", micros(F.col("requested_at")) - F.col("_i") * F.col("_delay"))
    running = Window.partitionBy("host", "_block").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    maxima = numbered.groupBy("host", "_block").agg(F.max("_free").alias("_most"))
    earlier = maxima.select("host", "_block", F.max("_most").over(before).alias("_earlier"))
    told = numbered.withColumn("_own", F.max("_free").over(running)).join(earlier, ["host", "_block"])
    start = F.timestamp_micros(F.greatest("_own", "_earlier") + F.col("_i") * F.col("_delay"))
    kind = dict(queue.dtypes)["requested_at"]
    timed = told.select(*queue.columns, start.cast(kind).alias("starts_at"))
    return timed.unionByName(queue.filter(~known).withColumn("starts_at", F.lit(None).cast(kind)))


def expired(day: Column, as_of: str, keep_days: int) -> Column:
    return day < F.date_sub(F.lit(as_of).cast("date"), keep_days)


def drop_expired(spark: SparkSession, path: str, as_of: str, keep_days: int = 30) -> list[str]:
    """Delete the day folders of a raw archive (source=/day=) that are older than keep_days: their names.

    Only folder names are listed, no body is read; a folder that is no day stays.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in (files.globStatus(hadoop.Path(root, "source=*/day=*")) or ())]
    names = [(f"{p.getParent().getName()}/{p.getName()}", p) for p in found]
    days = spark.createDataFrame([(n, n.rpartition("day=")[2]) for n, _ in names], "name string, day string")
    old = {r.name for r in days.filter(expired(F.col("day").try_cast("date"), as_of, keep_days)).collect()}
    for name, at in names:
        if name in old:
            files.delete(at, True)
    return sorted(old)
