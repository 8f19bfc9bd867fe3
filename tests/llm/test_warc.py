"""Archives: exact round trips, the seek table by hand, lost attempts and odd inputs."""

import hashlib
import io
import struct

import duckdb
import pytest
import zstandard
from pyarrow import fs
from pyspark.sql import functions as F

from martelo.llm import queries, warc
from martelo.llm.oracles import ORACLES

SF_DIR = "/root/testdata/sf0.001"
SAME, OTHER = "<p>" + "same " * 50 + "</p>", "<p>ünïcode 日本語 🙂\r\n\r\nWARC/1.1\r\n" + "x" * 200
PAGES = [
    (3, "http://a/3", SAME), (1, "http://a/1", SAME), (2, None, SAME), (1, "http://a/1", SAME), (None, "http://a/none", SAME),
    (4, "http://b/\r\nX: y ü", OTHER), (5, "http://b/5", OTHER), (6, "", None), (7, "http://c", ""), (8, "http://c", "short"), (9, "http://d", "short"),
    (10, "http://e", "y" * 99), (11, "http://e", "y" * 99), (12, "http://e", "z" * 100), (13, "http://e", "z" * 100), (14, "http://f", "long " * 400_000),
]


def plain(rows):
    """The contract's rows."""
    out = []
    for k, _, html in rows:
        body = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "").encode() == body and r[0] is not None]
        first = min(same, default=None) if len(body) >= 100 else None
        revisit = first is not None and k != first
        out.append((k, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*r, "x", 1) for r in PAGES], "page_id long, url string, html string, digest string, frame int").repartition(3)


def test_round_trip(pages):
    found = warc.archived(pages)
    assert sorted(map(tuple, found.collect()), key=repr) == plain(PAGES)
    assert not warc.archived(pages.limit(0)).collect()


@pytest.mark.parametrize("share", [1, 10_000])
def test_hot_payloads(spark, monkeypatch, share):
    """Broadcast or joined, copies are told alike."""
    monkeypatch.setattr(warc, "HOT_SHARE", share)
    rows = [(i, None, SAME if i % 3 else OTHER + str(i % 7)) for i in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted(map(tuple, warc.archived(df).collect()), key=repr) == plain(rows)


def test_frames_can_be_read_alone(spark, pages, tmp_path):
    archive = warc.write(pages, f"file://{tmp_path}", frame_bytes=500, bundle_bytes=400)
    index = archive.index.collect()
    assert len(index) == len(PAGES) and len({r.bundle for r in index}) > 3
    payloads = {(k, t) for k, _, t in PAGES}
    for bundle in {r.bundle for r in index}:
        raw = (tmp_path / bundle).read_bytes()
        number, flags, magic = struct.unpack("<IBI", raw[-9:])
        assert magic == 0x8F92EAB1 and flags == 0
        sizes = list(struct.iter_unpack("<II", raw[-9 - 8 * number : -9]))
        assert struct.unpack("<II", raw[-17 - 8 * number : -9 - 8 * number]) == (0x184D2A5E, 8 * number + 9)
        assert sum(s[0] for s in sizes) == len(raw) - 17 - 8 * number
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
        assert len(whole) == sum(s[1] for s in sizes)  # any decompressor reads the bundle through
        starts = [sum(s[0] for s in sizes[:i]) for i in range(number)]
        for r in (r for r in index if r.bundle == bundle):
            small, large = sizes[r.frame]
            frame = zstandard.ZstdDecompressor().decompress(raw[starts[r.frame] : starts[r.frame] + small], max_output_size=large)
            head, body = frame[r.offset : r.offset + r.length].split(b"\r\n\r\n", 1)
            assert f"WARC-Record-ID: <{r.record_id}>".encode() in head.split(b"\r\n")
            if b"WARC-Type: response" in head:
                key = warc.key_of(r.record_id)
                assert any(str(k) == str(key) and (t or "") == body[:-4].decode() for k, t in payloads)


def test_fetch(spark, pages, tmp_path):
    archive = warc.write(pages, f"file://{tmp_path}", frame_bytes=500)
    wanted = spark.createDataFrame([("urn:page:14",), ("urn:page:3",), ("urn:page:3",), ("urn:page:99",), (None,), ("urn:page-without-key",)], "record_id string")
    found = {r.record_id: r for r in archive.fetch(wanted).collect()}
    assert set(found) == {"urn:page:14", "urn:page:3", "urn:page-without-key"}
    assert bytes(found["urn:page:14"].payload).decode() == PAGES[-1][2] and found["urn:page:3"].refers_to == "1" and found["urn:page:3"].payload is None
    index = {r.record_id: r for r in archive.index.filter(F.col("record_id").isin(*found)).collect()}
    assert all((found[k].bundle, found[k].frame, found[k].offset) == (index[k].bundle, index[k].frame, index[k].offset) for k in found)


def test_lost_attempts_are_not_read(spark, pages, tmp_path):
    archive = warc.write(pages, f"file://{tmp_path}")
    left = tmp_path / "00000-lost.warc.zst"
    left.write_bytes(b"half a frame")
    assert archive.read().count() == len(PAGES)
    assert archive.sweep() == 1 and not left.exists() and archive.read().count() == len(PAGES)


def test_a_changed_payload_is_an_error(spark, tmp_path):
    made = warc.record(1, None, b"payload", hashlib.sha256(b"other").hexdigest(), 7, None)
    with pytest.raises(ValueError):
        list(warc._told(warc.records_in(made), "b", 0))
    with pytest.raises(ValueError):
        list(warc.records_in(made[:-1] + b"x"))


def test_text_keys(spark):
    rows = [("ä/b <c>", "u", "t" * 120), ("a:b\n", "u", "t" * 120), ("%41", "u", "v")]
    df = spark.createDataFrame(rows, "id string, link string, body string")
    found = warc.archived(df, "id", "link", "body").collect()
    assert sorted((r.id, r.record_type, r.refers_to) for r in found) == [("%41", "response", None), ("a:b\n", "response", None), ("ä/b <c>", "revisit", "a:b\n")]


def test_query_equals_sql(spark):
    found = queries.op12_warc_bundles(spark, SF_DIR)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF_DIR}/pages.parquet'")
    wanted = con.execute(f"SELECT {', '.join(found.columns)} FROM ({ORACLES['op12_warc_bundles']})").fetchall()
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, wanted))
    assert fs.FileSystem.from_uri("file:///tmp")[0].type_name == "local"
