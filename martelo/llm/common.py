"""What several operators share: shared-folder tables, and Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows, and bytes of text, that a Python worker unpacks at once; a longer text is a slice of its own.
SLICE_ROWS, SLICE_BYTES = 256, 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the setting is missing, a local session gets a folder of its own; a cluster has no folder that could be
    guessed, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.gettempdir()}/checkpoints/martelo-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Tables that this session has stored and not dropped yet, and the open scope's: those to delete, those to keep.
_kept: set[str] = set()
_scope: ContextVar[tuple[list[str], list[str]] | None] = ContextVar("scope", default=None)


def _tables(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tables"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _kept.discard(path)


@contextmanager
def scratch(spark: SparkSession):
    """Tables stored within are deleted at the end; those that are kept pass to the scope around it.

    What leaves the scope must read kept tables only.
    """
    mine: tuple[list[str], list[str]] = [], []
    token = _scope.set(mine)
    try:
        yield
    finally:
        _scope.reset(token)
        for path in mine[0]:
            _delete(spark, path)
        if outer := _scope.get():
            outer[0].extend(mine[1])


def clear(spark: SparkSession) -> None:
    """Delete every table and folder that this session has stored: for when the results that read them are written."""
    for path in list(_kept):
        _delete(spark, path)


def stored(df: DataFrame, narrow: bool = False, keep: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors.

    narrow: a table of ids and numbers that costs little to make, so that an eighth of the shuffle's partitions make
    files enough. keep: outlives the scratch scope that it is stored in.
    """
    spark = df.sparkSession
    path = f"{_tables(spark)}/{uuid.uuid4().hex}"
    if narrow:
        df = df.coalesce(max(4, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    _kept.add(path)
    if scope := _scope.get():
        scope[keep].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept_folder(spark: SparkSession, kind: str) -> str:
    """A new folder beside the stored tables, for files that results read; `clear` deletes it."""
    path = f"{shared_folder(spark)}/{kind}/{uuid.uuid4().hex}"
    _kept.add(path)
    return path


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many more underscores as it takes to be no column of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most SLICE_ROWS rows and about SLICE_BYTES of text."""
    size = np.ones(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    total, start = np.cumsum(size), 0
    while start < batch.num_rows:
        before = total[start - 1] if start else 0
        end = max(start + 1, min(start + SLICE_ROWS, int(np.searchsorted(total, before + SLICE_BYTES, "right"))))
        yield batch.slice(start, end - start)
        start = end


def map_rows(df: DataFrame, columns: list[str], schema: str | T.StructType, make: Callable[[], Callable]) -> DataFrame:
    """Run make()'s function over slices of the named columns, as lists, in Arrow batches.

    make() is called once in each task and returns f(*lists) -> lists of the output columns; what it builds
    (automata, tokenizers, caches) lives as long as the task.
    """
    out = df.sparkSession.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in slices(batch):
                made = f(*(c.to_pylist() for c in part.columns))
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(made, arrow, strict=True)], schema=arrow)

    return df.select(*columns).mapInArrow(run, out)


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of the documents whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
