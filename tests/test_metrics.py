"""Run metrics observed by the write itself, and by a stream's batches, against the counted ones."""

import time

import pytest
from pyspark.sql import functions as F

from martelo.operators import cycle, metrics

SCHEMA = "source string, counter string, n int, warning string"
ROWS = [("web", "found", 3, None), ("web", "found", 2, "slow"), ("web", "errors", 1, "HTTP 500"), ("djen", "new", 1, "HTTP 500"), ("djen", "strange", 9, None), ("else", "new", 4, "odd"), (None, "found", 1, None)]


def plain(df):
    return sorted((tuple(r) for r in df.select("source", *cycle.COUNTERS, "warnings", "examples").collect()), key=repr)


def test_equal_to_the_counted(spark, tmp_path):
    rows = spark.createDataFrame(ROWS * 5, SCHEMA)
    told = metrics.observed(rows, ["djen", "web", "idle"], lambda df: df.write.parquet(f"file://{tmp_path}/rows"))
    named = rows.withColumn("source", F.when(F.col("source").isin("djen", "web"), F.col("source")).otherwise(metrics.OTHERS))
    assert plain(told) == plain(cycle.statistics(named))
    assert spark.read.parquet(f"file://{tmp_path}/rows").count() == len(ROWS) * 5
    assert not metrics.observed(rows.limit(0), ["web"], lambda df: df.write.parquet(f"file://{tmp_path}/none")).collect()


def test_one_pass(spark, tmp_path):
    """Each row is read once for the write and the counts together."""
    seen = spark.sparkContext.accumulator(0)

    def touch(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.createDataFrame(ROWS, SCHEMA).mapInArrow(touch, SCHEMA)
    metrics.observed(rows, ["web"], lambda df: df.write.parquet(f"file://{tmp_path}/rows"))
    assert seen.value == len(ROWS)


def test_a_failed_write_tells_nothing(spark):
    def fails(df):
        raise OSError("no room")

    with pytest.raises(OSError):
        metrics.observed(spark.createDataFrame(ROWS, SCHEMA), ["web"], fails)


def test_ten_examples(spark):
    rows = spark.createDataFrame([("web", "errors", 1, f"w{i:02d}") for i in range(25) for _ in range(1 + (i % 2))] + [(None, "errors", 1, "x")], SCHEMA)
    found = {r.source: r.examples for r in cycle.statistics(rows).collect()}
    assert found == {"web": [f"w{i:02d}" for i in range(1, 21, 2)], None: ["x"]}
    both = cycle.merged_statistics(cycle.statistics(rows), cycle.statistics(rows.withColumn("warning", F.concat(F.lit("a"), "warning"))))
    assert {r.source: (r.errors, r.warnings, len(r.examples)) for r in both.collect()} == {"web": (74, 74, 10), None: (2, 2, 2)}


def test_stream(spark, tmp_path):
    """Batches add up, and the sums equal those of one batch."""
    for n in range(3):
        spark.createDataFrame(ROWS, SCHEMA).coalesce(1).write.mode("append").json(f"file://{tmp_path}/in")
    listener = metrics.StreamMetrics(["djen", "web"])
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
        query = listener.watched(stream).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/at").trigger(availableNow=True).start()
        query.awaitTermination()
        for _ in range(100):  # progress is told after the batch
            if len(listener.batches) == 3:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    named = spark.createDataFrame(ROWS * 3, SCHEMA).withColumn("source", F.when(F.col("source").isin("djen", "web"), F.col("source")).otherwise(metrics.OTHERS))
    assert plain(listener.table(spark)) == plain(cycle.statistics(named))
