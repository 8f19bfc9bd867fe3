"""Jump consistent hashing in column expressions: stable keys to shards without a ring table.

The generator of the published algorithm is a 64-bit linear congruential one. Spark's bigint product overflows
(an error in ANSI mode), so the product is taken in 16- and 32-bit limbs that never leave 63 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, unused

#: Fixed value: the multiplier of the published algorithm's generator.
MULTIPLIER = 2862933555777941757
LOW = 0xFFFFFFFF


def _step(x: Column) -> Column:
    """x * MULTIPLIER + 1, modulo 2**64, for a long read as 64 bits."""
    low, high = x.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(x, 32)
    c0, c1, top = MULTIPLIER & 0xFFFF, (MULTIPLIER >> 16) & 0xFFFF, MULTIPLIER >> 32
    mid = low * c1
    lo = low * c0 + F.shiftleft(mid.bitwiseAND(F.lit(0xFFFF)), 16) + 1
    hi = (
        F.shiftrightunsigned(lo, 32)
        + F.shiftrightunsigned(mid, 16)
        + (high * c0).bitwiseAND(F.lit(LOW))
        + F.shiftleft((high * c1).bitwiseAND(F.lit(0xFFFF)), 16)
        + (low * top).bitwiseAND(F.lit(LOW))
    )
    return F.shiftleft(hi.bitwiseAND(F.lit(LOW)), 32).bitwiseOR(lo.bitwiseAND(F.lit(LOW)))


def jump_shard(key: Column, shards: int) -> Column:
    """The shard of a bigint key among `shards`; a null key counts as 0.

    One more shard moves only the rows that land in the new one. The jumps rise strictly, so `shards` rounds end
    any key's walk.
    """
    start = F.struct(F.coalesce(key.cast("long"), F.lit(0).cast("long")).alias("x"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("next"))

    def jump(state: Column, _: Column) -> Column:
        x = _step(state["x"])
        at = state["next"]
        step = F.floor((at + 1) * (F.lit(float(1 << 31)) / (F.shiftrightunsigned(x, 33) + 1).cast("double"))).cast("long")
        moved = F.struct(x.alias("x"), at.alias("at"), step.alias("next"))
        return F.when(state["next"] < shards, moved).otherwise(state)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards + 1)), start, jump, lambda s: s["at"].cast("int"))


def assign_shards(df: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df plus size, text_crc32, law, shard and grown_shard (the shard when there is one more).

    size is the text's UTF-8 bytes plus 1 (a null text: no bytes, CRC 0). Rows with the same key share a shard,
    whatever their texts; repeated rows stay. Columns of df with one of these names are replaced; others pass.
    """
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return df.withColumns(
        {
            "size": F.octet_length(raw).cast("long") + 1,
            "text_crc32": F.crc32(raw),
            "law": F.lit("key"),
            "shard": jump_shard(F.col(key), shards),
            "grown_shard": jump_shard(F.col(key), shards + 1),
        }
    )


def with_slots(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """df plus slot: places without gaps from 0 in each shard, by key (nulls first), then CRC and size.

    Rows are dealt by range of shard, key and CRC and stored with the number of their range, so that places stay
    fixed when an executor is lost. A place is the range's offset in its shard plus the rank within range and shard:
    no task ever holds a whole shard, only one range's rows of it and the table of counts. Equal rows take
    neighbouring places; a column of df named slot is replaced, other columns pass.
    """
    split, count, offset, rank = unused(df, "_split", "_n", "_offset", "_rank")
    order = [F.col(key).asc_nulls_first(), F.col("text_crc32").asc(), F.col("size").asc()]
    ranged = df.drop("slot").repartitionByRange(F.col("shard").asc(), *order)
    rows = stored(ranged.withColumn(split, F.spark_partition_id()))
    counts = rows.groupBy("shard", split).agg(F.count(F.lit(1)).alias(count))
    before = W.partitionBy("shard").orderBy(split).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", split, F.coalesce(F.sum(count).over(before), F.lit(0)).alias(offset))
    ranked = rows.withColumn(rank, F.row_number().over(W.partitionBy("shard", split).orderBy(*order)))
    return ranked.join(offsets, ["shard", split]).withColumn("slot", (F.col(offset) + F.col(rank) - 1).cast("long")).drop(split, offset, rank)


def write_shards(df: DataFrame, path: str) -> None:
    """One folder of Parquet files for each shard; a shard may span files."""
    df.write.partitionBy("shard").parquet(path)
