"""Topics of landed records, consumed in micro-batches: bad records go aside, good ones are merged once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the order in which topics are consumed, so that lots find their auctioneers.
TOPICS = ("leiloeiros", "publicacoes", "lotes")


def published(records: DataFrame) -> DataFrame:
    """Any records as JSON messages, one a row."""
    return records.select(F.to_json(F.struct(*records.columns)).alias("value"))


def topic(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """A folder of JSON lines as a stream of messages; the checkpoint acknowledges them."""
    return spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_batch).text(path)


def parted(messages: DataFrame, schema: T.StructType, key: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejects): what parses and has its key, and the raw text of the rest."""
    parsed = messages.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"))
    good = F.col("r").isNotNull() & F.col(f"r.{key}").isNotNull()
    return parsed.filter(good).select("r.*"), parsed.filter(~good).select("value")


def consume(messages: DataFrame, schema: T.StructType, key: str, checkpoint: str, merge: Callable[[DataFrame, int], None], reject: Callable[[DataFrame, int], None] | None = None):
    """Run one topic to its end: merge(records, batch) must be idempotent by batch, as batches may come again."""

    def batch(messages: DataFrame, number: int) -> None:
        records, rejects = parted(messages, schema, key)
        merge(records, number)
        if reject is not None:
            reject(rejects, number)

    return messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(publications: DataFrame, id_column: str = "external_id", time: str = "at", within: str = "3 days") -> DataFrame:
    """A re-read window of publications without repeats: state is kept only as long as the window."""
    return publications.withWatermark(time, within).dropDuplicatesWithinWatermark([id_column])


def send_alerts(sent_path: str, send: Callable[[DataFrame], None], schema: str = "alert_id bigint, lot_id bigint") -> Callable[[DataFrame, int], None]:
    """A foreachBatch body: sends what no earlier batch sent, and marks it only after sending succeeded (at least once).

    A batch that comes again has the same marks as before: its own earlier marks don't count against it, and it writes
    the same ones over them.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        try:
            sent = spark.read.schema(f"{schema}, batch bigint").parquet(sent_path).filter(F.col("batch") < number)
        except AnalysisException as error:  # nothing was sent yet
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            sent = spark.createDataFrame([], f"{schema}, batch bigint")
        fresh = rows.dropDuplicates(["alert_id", "lot_id"]).join(sent, ["alert_id", "lot_id"], "left_anti").persist()
        try:
            send(fresh)
            fresh.select("alert_id", "lot_id").write.mode("overwrite").parquet(f"{sent_path}/batch={number}")
        finally:
            fresh.unpersist()

    return batch
