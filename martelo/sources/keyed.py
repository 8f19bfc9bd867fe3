"""Keyed tables that are written by commits: an upsert rewrites the touched buckets only, readers see whole versions.

A table is a folder of Parquet files by bucket of the key's hash, and of manifests by version. A manifest names each
bucket's folder, and the last batch of each writer. Files are written first, under names of their own; the commit
is the renaming of the next manifest into place, which fails if another writer came first: then the upsert is made
again on that writer's version. What a broken write left is named by no manifest and goes by `vacuum`.

Rows of one key are reduced to one before anything else, so no key is a large group; buckets are shuffled by their
number and each is one task, so give a table enough of them for a bucket to fit a task.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.identity import upsert


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder below spark.checkpoint.dir, which driver and executors share; a local session without the setting
    takes one for temporary files."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = f"file://{tempfile.gettempdir()}/checkpoints/martelo-{spark.sparkContext.applicationId}"
    return f"{shared}/{kind}/{uuid.uuid4().hex}"


class Conflict(Exception):
    """Another writer committed the version first."""


class KeyedTable:
    """A table of rows with keys at a path. A new one needs its schema; an old one keeps its own, keys and buckets."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = (), schema: T.StructType | str | None = None, buckets: int = 64):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._hadoop, self._conf = hadoop, spark._jsc.hadoopConfiguration()
        self._files = hadoop.Path(self.path).getFileSystem(self._conf)
        self._context = hadoop.FileContext.getFileContext(hadoop.Path(self.path).toUri(), self._conf)
        if self.version() is None:
            if not keys or schema is None:
                raise ValueError("a new table needs keys and a schema")
            kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
            first = {"version": 0, "keys": list(keys), "schema": kind.json(), "n_buckets": buckets, "buckets": {}, "batches": {}}
            try:
                self._commit(first)
            except Conflict:  # another one made it
                pass
        made = self.manifest()
        self.keys, self.schema, self.n_buckets = made["keys"], T.StructType.fromJson(json.loads(made["schema"])), made["n_buckets"]

    # ---- versions ----

    def version(self) -> int | None:
        folder = self._hadoop.Path(f"{self.path}/versions")
        if not self._files.exists(folder):
            return None
        names = (s.getPath().getName() for s in self._files.listStatus(folder))
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=None)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        return json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.path}/versions/{version:012d}.json").collect()))

    def _commit(self, manifest: dict) -> None:
        """Put a manifest in place, or raise Conflict if its version is taken."""
        path = self._hadoop.Path
        draft = path(f"{self.path}/drafts/{uuid.uuid4().hex}")
        out = self._files.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        self._files.mkdirs(path(f"{self.path}/versions"))
        never = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._context.rename(draft, path(f"{self.path}/versions/{manifest['version']:012d}.json"), never)
        except Py4JJavaError as error:
            self._files.delete(draft, False)
            if error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                raise Conflict(f"version {manifest['version']} of {self.path} is taken") from error
            raise

    # ---- reading and writing ----

    def read(self, version: int | None = None, only: Sequence[int] | None = None) -> DataFrame:
        """The rows of a version, the latest by default; only: of these buckets."""
        held = self.manifest(version)["buckets"]
        paths = [p for b, p in held.items() if only is None or int(b) in only]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{p}" for p in paths))

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.n_buckets)).cast("int")

    def upsert(self, rows: DataFrame, order: str | None = None, writer: str | None = None, batch: int | None = None, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None, attempts: int = 5) -> int:
        """Merge rows into the table and commit: the version that holds them.

        Of several rows of a key the last by `order` counts, and replaces the stored one; merge(stored, new) may do
        otherwise, and must keep keys. With a writer's name, a batch that is not above its last one is already in:
        nothing is written. Rows may lack no column and have more; null keys are equal. No rows, no new version.
        """
        merged = merge or (lambda old, new: upsert(old, new, self.keys))
        names = self.schema.fieldNames()
        rest = [c for c in names if c not in self.keys]
        if order or not merge:
            rank = F.struct(F.col(order).isNotNull(), F.col(order)) if order else F.struct(*rest)
            rows = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), rank).alias("_row")).select(*self.keys, "_row.*").select(*names)
        rows = rows.persist()
        try:
            touched = sorted(r[0] for r in rows.select(self._bucket()).distinct().collect())  # at most n_buckets numbers
            for _ in range(attempts):
                base = self.manifest()
                if writer is not None and batch is not None and base["batches"].get(writer, -1) >= batch:
                    return base["version"]
                if not touched:
                    return base["version"]
                new = merged(self.read(base["version"], touched), rows.select(*names)).select(*names)
                folder = f"data/{uuid.uuid4().hex}"
                new.withColumn("_bucket", self._bucket()).repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
                made = {s.getPath().getName().removeprefix("_bucket=") for s in self._files.listStatus(self._hadoop.Path(f"{self.path}/{folder}")) if s.isDirectory()}
                held = {b: p for b, p in base["buckets"].items() if int(b) not in touched} | {b: f"{folder}/_bucket={b}" for b in made}
                batches = base["batches"] | ({writer: batch} if writer is not None and batch is not None else {})
                try:
                    self._commit(base | {"version": base["version"] + 1, "buckets": held, "batches": batches})
                    return base["version"] + 1
                except Conflict:
                    self._files.delete(self._hadoop.Path(f"{self.path}/{folder}"), True)
            raise Conflict(f"{attempts} other writers came first")
        finally:
            rows.unpersist()

    def rollback(self, version: int) -> int:
        """A new version that is what an old one was; batches that came since may come again."""
        return self._again(self.manifest(version))

    def _again(self, old: dict) -> int:
        number = self.version() + 1
        self._commit(old | {"version": number})
        return number

    def vacuum(self, keep: int = 1) -> int:
        """Delete the files that none of the last `keep` versions names, and older manifests: how many folders. Not
        while others write."""
        last = self.version()
        kept = {p.split("/")[1] for v in range(max(0, last - keep + 1), last + 1) for p in self.manifest(v)["buckets"].values()}
        for v in range(max(0, last - keep + 1)):
            self._files.delete(self._hadoop.Path(f"{self.path}/versions/{v:012d}.json"), False)
        data, gone = self._hadoop.Path(f"{self.path}/data"), 0
        for status in self._files.listStatus(data) if self._files.exists(data) else ():
            if status.getPath().getName() not in kept:
                gone += bool(self._files.delete(status.getPath(), True))
        return gone


def stream_into(table: KeyedTable, writer: str, order: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch body: each batch is in the table once, however often it comes."""
    return lambda rows, number: table.upsert(rows, order, writer, number) and None
