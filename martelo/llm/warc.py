"""WARC archives as seekable Zstandard bundles, written and read in tasks.

Records are grouped into frames of about FRAME_BYTES that can be decompressed alone; a bundle is a file of frames
with a seek table in a skippable frame at its end (the seekable format of Zstandard: sizes of each frame, their
number, a magic number), so any decompressor reads the bundle as one WARC file, and a reader that knows a record's
frame reads that frame only. `Archive.index` maps record identifiers to bundle, frame and offset within the frame.

Equal payloads are stored once. The digests alone are grouped; a payload is shuffled once, to the task that writes
it, with what is known of its digest. Digests that stand for over one row in HOT_SHARE, at most that many, are
broadcast and their rows dealt to all tasks, so that no group of copies is one task's.

Bundles lie in a folder that driver and executors share and that Arrow's file systems can open (file, hdfs, s3).
A task names its bundles anew at each attempt; the index names those of the attempts that ended, so a task that is
lost or run twice leaves at most files that nothing reads, which `Archive.sweep` deletes.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import kept_folder, slices, stored

#: Bytes of records after which a frame is closed, and of a bundle after which the next is begun.
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 256 << 20
#: Payloads of fewer bytes are stored as often as they come.
LEAST_SHARED = 100
#: A digest of more than one row in so many is dealt to all tasks.
HOT_SHARE = 10_000
#: The skippable frame and the end of a seek table in the seekable Zstandard format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
END = struct.Struct("<IBI")
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
INDEX = "record_id string, bundle string, frame long, offset long, length long"


# ---- records ----


def record_id(key) -> str:
    """A URI for a row's key; of a null key one that no key has."""
    return "urn:page-without-key" if key is None else f"urn:page:{quote(str(key), safe='')}"


def key_of(identifier: str) -> str | None:
    return unquote(identifier.removeprefix("urn:page:")) if identifier.startswith("urn:page:") else None


def record(key, url: str | None, payload: bytes | None, digest: str, n_bytes: int, refers_to, date: str = DATE) -> bytes:
    """One record: a response holds the payload, a revisit (payload None) names the record that does."""
    fields = [
        ("WARC-Type", "response" if payload is not None else "revisit"),
        ("WARC-Record-ID", f"<{record_id(key)}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", quote(url or record_id(key), safe=":/?#[]@!$&'()*+,;=%~")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Payload-Length", str(n_bytes)),  # an extension: a revisit has no payload to measure
    ]
    if payload is None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{record_id(refers_to)}>")]
    fields.append(("Content-Length", str(len(payload or b""))))
    head = VERSION + b"\r\n" + b"".join(f"{name}: {value}\r\n".encode() for name, value in fields)
    return b"".join((head, b"\r\n", payload or b"", b"\r\n\r\n"))


def records_in(frame: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, fields, block) of each record; field names in lower case."""
    at = 0
    while at < len(frame):
        body = frame.index(b"\r\n\r\n", at) + 4
        version, *lines = frame[at:body].split(b"\r\n")
        if version != VERSION:
            raise ValueError(f"no record at {at}")
        fields = {k.decode().lower(): v.strip().decode() for k, v in (line.split(b":", 1) for line in lines if line)}
        end = body + int(fields["content-length"])
        if frame[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} has another length than it tells")
        yield at, end + 4 - at, fields, frame[body:end]
        at = end + 4


# ---- bundles ----


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The skippable frame for frames of (compressed, decompressed) sizes."""
    entries = b"".join(struct.pack("<II", *s) for s in sizes)
    return struct.pack("<II", SKIPPABLE, len(entries) + END.size) + entries + END.pack(len(sizes), 0, SEEKABLE)


def frames_of(file) -> list[tuple[int, int, int]]:
    """(offset, compressed, decompressed) of each frame, from the seek table at the end of an open file."""
    total = file.size()
    number, _, magic = END.unpack(file.read_at(END.size, total - END.size))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    entries = file.read_at(8 * number, total - END.size - 8 * number)
    out, at = [], 0
    for small, large in struct.iter_unpack("<II", entries):
        out.append((at, small, large))
        at += small
    return out


class BundleWriter:
    """Frames appended to files of one folder; tells where each record went."""

    def __init__(self, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES):
        self.system, self.root = fs.FileSystem.from_uri(folder)
        self.frame_bytes, self.bundle_bytes = frame_bytes, bundle_bytes
        self.compressor = zstandard.ZstdCompressor(level=3)
        self.file, self.name = None, ""
        self.parts: list[bytes] = []
        self.size = self.written = 0
        self.sizes: list[tuple[int, int]] = []

    def append(self, made: bytes) -> tuple[str, int, int, int]:
        """bundle, frame, offset and length of a record."""
        if self.file is None:
            context = TaskContext.get()
            self.name = f"{context.partitionId() if context else 0:05d}-{uuid.uuid4().hex}.warc.zst"
            self.file, self.sizes, self.written = self.system.open_output_stream(f"{self.root}/{self.name}", compression=None), [], 0
        place = self.name, len(self.sizes), self.size, len(made)
        self.parts.append(made)
        self.size += len(made)
        if self.size >= self.frame_bytes:
            self._frame()
            if self.written >= self.bundle_bytes:
                self.close()
        return place

    def _frame(self) -> None:
        if self.parts:
            packed = self.compressor.compress(b"".join(self.parts))
            self.file.write(packed)
            self.sizes.append((len(packed), self.size))
            self.written += len(packed)
            self.parts, self.size = [], 0

    def close(self) -> None:
        if self.file is not None:
            self._frame()
            self.file.write(seek_table(self.sizes))
            self.file.close()
            self.file = None


@dataclass
class Archive:
    """Bundles in a folder, and the table that maps record identifiers to places in them."""

    folder: str
    index: DataFrame

    def bundles(self) -> DataFrame:
        """(bundle, first, last): pieces of bundles of some 64 frames, to be read by one task each."""
        piece = F.floor(F.col("frame") / 64)
        return self.index.groupBy("bundle", piece.alias("piece")).agg(F.min("frame").alias("first"), F.max("frame").alias("last")).drop("piece")

    def read(self) -> DataFrame:
        """Every record as the bundles tell it, with payload null in revisits. Digests of payloads are computed
        anew; one that differs from what its record tells is an error."""
        folder, pieces = self.folder, self.bundles()

        def run(batches):
            system, root = fs.FileSystem.from_uri(folder)
            undo = zstandard.ZstdDecompressor()
            for batch in batches:
                for bundle, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    with system.open_input_file(f"{root}/{bundle}") as file:
                        for number, (at, small, large) in enumerate(frames_of(file)):
                            if first <= number <= last:
                                frame = undo.decompress(file.read_at(small, at), max_output_size=large)
                                yield from _told(records_in(frame), bundle, number)

        out = self.index.sparkSession.createDataFrame([], RECORD).schema
        return _dealt(pieces, "bundle", "first").select("bundle", "first", "last").mapInArrow(run, out)

    def fetch(self, wanted: DataFrame) -> DataFrame:
        """The records of the identifiers in wanted.record_id, each read from its frame alone. Identifiers without
        a record give no row; repeated ones one row for each record."""
        folder = self.folder
        places = self.index.join(wanted.select("record_id").distinct(), "record_id", "left_semi")

        def run(batches):
            system, root = fs.FileSystem.from_uri(folder)
            undo = zstandard.ZstdDecompressor()
            bundle, file, frames, number, frame = None, None, [], -1, b""
            for batch in batches:
                for b, f, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if b != bundle:
                        if file is not None:
                            file.close()
                        bundle, file, number = b, system.open_input_file(f"{root}/{b}"), -1
                        frames = frames_of(file)
                    if f != number:
                        at, small, large = frames[f]
                        number, frame = f, undo.decompress(file.read_at(small, at), max_output_size=large)
                    yield from _told(records_in(frame[offset : offset + length]), b, f, offset)
            if file is not None:
                file.close()

        out = self.index.sparkSession.createDataFrame([], RECORD).schema
        dealt = _dealt(places, "bundle").sortWithinPartitions("bundle", "frame", "offset")
        return dealt.select("bundle", "frame", "offset", "length").mapInArrow(run, out)

    def sweep(self) -> int:
        """Delete the bundles that the index does not name, of attempts that were lost: how many."""
        system, root = fs.FileSystem.from_uri(self.folder)
        names = [f.base_name for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.is_file]
        spark = self.index.sparkSession
        left = spark.createDataFrame([(n,) for n in names], "bundle string").join(self.index, "bundle", "left_anti")
        gone = 0
        for row in left.toLocalIterator():
            system.delete_file(f"{root}/{row.bundle}")
            gone += 1
        return gone


def _dealt(places: DataFrame, *by: str) -> DataFrame:
    """Rows of a few bytes that each stand for much to read: a fixed number of tasks, which are not merged."""
    return places.repartition(int(places.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


RECORD = "record_id string, key string, record_type string, refers_to string, url string, payload_digest string, payload_bytes long, payload binary, bundle string, frame long, offset long"


def _told(found, bundle: str, frame: int, shift: int = 0) -> Iterator[pa.RecordBatch]:
    rows = []
    for offset, _, fields, block in found:
        digest = fields["warc-payload-digest"].removeprefix("sha256:")
        payload = block if fields["warc-type"] == "response" else None
        if payload is not None and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(fields["payload-length"])):
            raise ValueError(f"{bundle}, frame {frame}: the payload at {offset + shift} is not what its record tells")
        identifier = fields["warc-record-id"].strip("<>")
        refers = fields.get("warc-refers-to")
        rows.append((identifier, key_of(identifier), fields["warc-type"], key_of(refers.strip("<>")) if refers else None, fields["warc-target-uri"], digest, int(fields["payload-length"]), payload, bundle, frame, offset + shift))
    if rows:
        schema = _RECORDS
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_RECORDS = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in RECORD.split(", "))])


# ---- from tables ----


def decided(pages: DataFrame, key: str, payload: str, least: int = LEAST_SHARED) -> DataFrame:
    """pages with digest, n_bytes, is_revisit and first: the least key among equal payloads of at least so many
    bytes. Rows with that key, repeated ones too, are responses, the others revisits; a row without a key revisits
    one that has one."""
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.withColumns({"digest": F.sha2(body, 256), "n_bytes": F.octet_length(body).cast("long")})
    copies = rows.filter(F.col("n_bytes") >= least).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first")).filter("n > 1")
    copies = stored(copies, narrow=True)
    total = max(1, copies.agg(F.sum("n")).first()[0] or 1)
    is_hot = F.col("n") * HOT_SHARE > total
    hot = F.broadcast(copies.filter(is_hot).select("digest", F.col("first").alias("hot_first"), F.lit(True).alias("is_hot")))
    rows = rows.join(hot, "digest", "left")
    alone = F.coalesce(F.col("is_hot") | (F.col("n_bytes") < least), F.lit(False))  # such rows meet nothing below
    rows = rows.withColumn("meets", F.when(alone, F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))).otherwise(F.col("digest")))
    rows = rows.join(copies.filter(~is_hot).select(F.col("digest").alias("meets"), "first"), "meets", "left")
    first = F.coalesce("hot_first", "first")
    revisit = first.isNotNull() & ~F.col(key).eqNullSafe(first)
    return rows.select(*(F.col(c) for c in pages.columns), "digest", "n_bytes", revisit.alias("is_revisit"), F.when(revisit, first).alias("first"))


def write(pages: DataFrame, folder: str | None = None, key: str = "page_id", url: str = "url", payload: str = "html", date: str = DATE, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> Archive:
    """One record for each row of pages; null payloads are empty, null addresses those of the record's identifier.

    Keys of any type stand in the identifiers as text; letters of addresses that a header can't hold stand in their
    percent form. Other columns are not archived. Without a folder one is made
    below spark.checkpoint.dir. An empty table gives an archive without bundles.
    """
    spark = pages.sparkSession
    folder = folder or kept_folder(spark, "warc")
    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root)
    names = ("key", "url", "payload")
    rows = decided(pages.select(*(F.col(c).alias(n) for c, n in zip((key, url, payload), names, strict=True))), "key", "payload")
    text = F.when(~F.col("is_revisit"), F.coalesce("payload", F.lit("")))
    out = spark.createDataFrame([], INDEX).schema
    arrow = to_arrow_schema(out)

    def run(batches):
        writer = BundleWriter(folder, frame_bytes, bundle_bytes)
        for batch in batches:
            for part in slices(batch):
                rows = []
                for k, u, t, digest, n, first in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    rows.append((record_id(k), *writer.append(record(k, u, None if t is None else t.encode(), digest, n, first, date))))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
        writer.close()

    index = rows.select(F.col("key").cast("string"), "url", text.alias("text"), "digest", "n_bytes", F.col("first").cast("string")).mapInArrow(run, out)
    return Archive(folder, stored(index, keep=True))


def archived(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write pages to an archive and read it back: key, payload_bytes, payload_digest, record_type and refers_to of
    each record."""
    kind = pages.schema[key].dataType
    found = write(pages, None, key, url, payload).read()
    return found.select(F.col("key").cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
