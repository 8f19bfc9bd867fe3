"""MinHash fingerprints: universal hashes of word shingles in vectorised numpy.

A fingerprint holds, for each of PERMUTATIONS multiply-shift hashes, the low 16 bits of the least value over the
text's distinct shingles. The share of equal places estimates the Jaccard likeness of two texts.

Bands of the fingerprints are joined as in neardup: bucket members are verified against a hub, mixed buckets are
searched through in blocks, and exact Jaccard likeness of 0.8 or more links two texts. Only pairs that share no
band are missed: one in about 20,000 at a likeness of 0.8, fewer above.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import neardup
from .common import scratch, slices, stored
from .shingles import U, counted, mix

PERMUTATIONS = 128
#: What stands in every place of an empty text's fingerprint.
EMPTY = np.uint32(0xFFFFFFFF)
#: Texts hashed at once: their distinct shingles stay in the processor's cache.
GROUP = 24


def permutations(n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Factors and addends of n multiply-shift hashes, a 2-universal family."""
    a = mix(np.arange(1, n + 1, dtype=U) + U(seed << 32)) | U(1)
    return a, mix(a ^ U(0x5851F42D4C957F2D))


def signatures(texts: list[str | None], n: int = PERMUTATIONS) -> np.ndarray:
    """uint32[len(texts), n]."""
    out = np.full((len(texts), n), EMPTY)
    a, b = permutations(n)
    for start in range(0, len(texts), GROUP):
        docs, hashes, _ = counted(texts[start : start + GROUP])
        if not len(docs):
            continue
        begins = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))
        rows = start + docs[begins]
        for i in range(n):
            out[rows, i] = np.minimum.reduceat(hashes * a[i] + b[i], begins) >> U(32)
    return out


def short(signature: np.ndarray) -> np.ndarray:
    return signature.astype(np.uint16)


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (short(x) == short(y)).mean(axis=-1)


def hexed(signature: np.ndarray) -> str:
    return short(signature).astype(">u2").tobytes().hex()


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact Jaccard of two texts' distinct shingles; 0 where their numbers alone put it under the threshold."""
    x, y = a[0], b[0]
    few, many = sorted((len(x), len(y)))
    if not many:
        return 1.0
    if few < neardup.THRESHOLD * many:
        return 0.0
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared / (few + many - shared)


def banded(texts: list[str | None]) -> np.ndarray:
    """The places of the fingerprints that bands are cut from."""
    return short(signatures(texts))[:, : neardup.REGISTERS]


BY_SETS = neardup.Method(banded, jaccard, False)


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as many letters, or all, from the start of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


SCHEMA = "hash long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _neighbourhoods(df: DataFrame, key: str, text: str, n_blocks: int) -> DataFrame:
    """Rows dealt to blocks of neighbouring keys, each followed by a guest: the first row of the next block.

    Block borders are approximate quantiles, so there are n_blocks of them whatever the size of the table; only
    those borders and the first row's place of each block reach the driver. A key that several borders fall on has
    that many blocks more, by its texts' hashes. Every text is shuffled once.
    """
    order, spread = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))), F.xxhash64(text)  # nulls first
    share = [i / n_blocks for i in range(1, n_blocks)]
    borders = np.array(df.select(F.percentile_approx(order, share, 20 * n_blocks)).first()[0] or [], np.int64)

    def block_of(keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The block of each row: after all lesser borders, and among those equal to its key by the hash."""
        low, high = np.searchsorted(borders, keys, "left"), np.searchsorted(borders, keys, "right")
        inside = ((hashes.astype(np.float64) * 2.0**-64 + 0.5) * (high - low + 1)).astype(np.int64)
        return low + np.minimum(inside, high - low)

    @F.pandas_udf("int")
    def block(keys: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(block_of(keys.to_numpy(), hashes.to_numpy()).astype("int32"))

    least = F.min(F.struct("k", "h"))
    firsts = sorted((r["b"], (r["k"], r["h"])) for r in df.select(order.alias("k"), spread.alias("h")).groupBy(block("k", "h").alias("b")).agg(least.alias("at")).select("b", "at.k", "at.h").collect())
    guests = {at: b for (b, _), (_, at) in zip(firsts, firsts[1:] + firsts[:1], strict=True)}

    @F.pandas_udf("array<int>")
    def blocks(keys: pd.Series, hashes: pd.Series) -> pd.Series:
        own = block_of(keys.to_numpy(), hashes.to_numpy())
        return pd.Series([[2 * int(b)] if (g := guests.get(at)) is None else [2 * int(b), 2 * g + 1] for b, at in zip(own, zip(keys.tolist(), hashes.tolist(), strict=True), strict=True)])

    dealt = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.explode(blocks(order, spread)).alias("at"), spread.alias("hash"))
    parted = dealt.withColumn("block", F.floor(F.col("at") / 2).cast("int"))
    return parted.repartition(max(1, n_blocks // 8), "block").sortWithinPartitions("block", "at", F.col("key").asc_nulls_first(), "hash").select("key", "text", "at", "hash")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", blocks: int | None = None) -> DataFrame:
    """One row for each row of df: its fingerprint, that of its edited text, likenesses, and class_id.

    class_id is the least key among the texts that links of Jaccard likeness 0.8 or more join to the row's. Rows
    follow one another by key (nulls first), equal keys by the XXH64 of their texts; after the last comes the first.
    Null texts count as empty; two empty texts are wholly alike; repeated rows each have their row; other columns
    are not carried. Keys must be whole numbers: another type is a TypeError.
    """
    spark = df.sparkSession
    if not isinstance(df.schema[key].dataType, T.IntegralType):
        raise TypeError(f"{key} must be a whole number, not {df.schema[key].dataType.simpleString()}")
    if blocks is None:
        blocks = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = df.schema[key].dataType
    out = T.StructType([T.StructField(key, kind), *spark.createDataFrame([], SCHEMA).schema])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = ()  # the last row of the batch before, whose next row has yet to come

        def told(keys, texts, ats, hashes, sigs) -> Iterator[tuple]:
            rows = [i for i in range(len(keys) - 1) if not ats[i] & 1 and ats[i + 1] >> 1 == ats[i] >> 1]
            changed = [edited(texts[i], texts[i + 1]) for i in rows]
            new = signatures(changed)
            for n, i in enumerate(rows):
                yield keys[i], hashes[i], len(texts[i]), hashlib.sha256(changed[n].encode("utf-8", "surrogatepass")).hexdigest(), hexed(sigs[i]), hexed(new[n]), float(likeness(sigs[i], new[n])), float(likeness(sigs[i], sigs[i + 1]))

        for batch in batches:
            for part in slices(batch):
                keys, texts, ats, hashes = (c.to_pylist() for c in part.columns)
                sigs = signatures(texts)
                if held:
                    keys, texts, ats, hashes, sigs = [held[0], *keys], [held[1], *texts], [held[2], *ats], [held[3], *hashes], np.vstack([held[4], sigs])
                held = keys[-1], texts[-1], ats[-1], hashes[-1], sigs[-1:]
                made = list(zip(*told(keys, texts, ats, hashes, sigs), strict=True)) or [[]] * len(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(made, arrow, strict=True)], schema=arrow)

    # only rows that another row's key stands for need a join; all others are their own class
    with scratch(spark):
        found = neardup.classes(df, key, text, method=BY_SETS).filter(~F.col("class_id").eqNullSafe(F.col(key)))
        moved = stored(found.select(F.col(key).alias("__key"), F.col("hash").alias("__hash"), "class_id").distinct(), narrow=True, keep=True)
    few = F.broadcast(moved) if moved.count() <= neardup.BROADCAST_NODES else moved
    prints = _neighbourhoods(df, key, text, blocks).mapInArrow(run, out)
    joined = prints.join(few, prints[key].eqNullSafe(F.col("__key")) & (prints["hash"] == F.col("__hash")), "left")
    return joined.withColumn("class_id", F.coalesce("class_id", key)).drop("hash", "__key", "__hash")
