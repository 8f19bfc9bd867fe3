"""Streams over landed files, run to their end."""

import json
import os
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martelo.streaming import ingest, state, windows

LOT = T.StructType([T.StructField("lot_id", T.LongType()), T.StructField("price", T.DecimalType(14, 2)), T.StructField("at", T.TimestampNTZType())])


def finish(query):
    query.awaitTermination(120)
    assert query.exception() is None


def land(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(rows) + "\n")
    os.utime(path / name, (1_700_000_000 + 60 * len(list(path.iterdir())),) * 2)  # files are taken by their age


def test_consume_parts_good_records_from_bad_ones(spark, tmp_path):
    topic, good, bad = tmp_path / "lotes", f"file://{tmp_path}/good", f"file://{tmp_path}/bad"
    records = spark.createDataFrame([(1, "10.50", "2026-11-10 14:30:00"), (2, None, None)], "lot_id bigint, price string, at string").select("lot_id", F.col("price").cast("decimal(14,2)").alias("price"), F.col("at").cast("timestamp_ntz").alias("at"))
    land(topic, "a.json", [r["value"] for r in ingest.published(records).collect()] + ["not json", json.dumps({"price": 1})])

    def merge(rows, n):
        rows.write.mode("overwrite").parquet(f"{good}/batch={n}")

    def reject(rows, n):
        rows.write.mode("overwrite").parquet(f"{bad}/batch={n}")

    run = lambda: finish(ingest.consume(ingest.topic(spark, f"file://{topic}"), LOT, "lot_id", f"file://{tmp_path}/ck", merge, reject))
    run()
    got = {r["lot_id"]: (r["price"], r["at"]) for r in spark.read.parquet(good).collect()}
    assert {k: (v[0] and float(v[0]), v[1] and v[1].isoformat()) for k, v in got.items()} == {1: (10.5, "2026-11-10T14:30:00"), 2: (None, None)}
    assert {r["value"] for r in spark.read.parquet(bad).collect()} == {"not json", '{"price": 1}'}
    run()  # nothing new: the checkpoint has acknowledged all
    land(topic, "b.json", [json.dumps({"lot_id": 3})])
    run()
    assert sorted(r["lot_id"] for r in spark.read.parquet(good).collect()) == [1, 2, 3]


def test_deduplicated_keeps_one_within_the_window(spark, tmp_path):
    rows = [("a", "2026-01-01 10:00:00"), ("a", "2026-01-02 10:00:00"), ("b", "2026-01-01 11:00:00")]
    land(tmp_path / "in", "a.json", [json.dumps({"external_id": i, "at": t}) for i, t in rows])
    stream = spark.readStream.schema("external_id string, at timestamp").json(f"file://{tmp_path}/in")
    finish(ingest.deduplicated(stream).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start())
    assert sorted(r["external_id"] for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == ["a", "b"]


def test_alerts_are_sent_once_and_replays_mark_the_same(spark, tmp_path):
    sent, path = [], f"file://{tmp_path}/sent"
    df = lambda *rows: spark.createDataFrame(rows, "alert_id bigint, lot_id bigint")
    batch = ingest.send_alerts(path, lambda rows: sent.append(sorted(map(tuple, rows.collect()))))
    batch(df((1, 1), (1, 2), (1, 2)), 0)
    batch(df((1, 2), (1, 3)), 1)
    batch(df((1, 2), (1, 3)), 1)  # comes again
    batch(df((1, 1), (1, 2), (1, 3), (2, 1)), 2)
    assert sent == [[(1, 1), (1, 2)], [(1, 3)], [(1, 3)], [(2, 1)]]
    marks = sorted((r["alert_id"], r["lot_id"]) for r in spark.read.parquet(path).collect())
    assert marks == [(1, 1), (1, 2), (1, 3), (2, 1)]

    def fails(rows):
        raise RuntimeError("no mail")

    try:
        ingest.send_alerts(path, fails)(df((9, 9)), 3)
    except RuntimeError:
        pass
    assert not spark.read.parquet(path).filter("alert_id = 9").count()


def test_changes_of_a_stream_of_snapshots(spark, tmp_path):
    at, later = "2026-11-10 14:00:00", "2026-11-12 14:00:00"
    steps = [[(1, at, "CONFIRMADO")], [(1, at, "CONFIRMADO")], [(1, later, "CONFIRMADO")], [(1, later, "SUSPENSO")], [(1, None, None)]]
    for n, step in enumerate(steps):
        land(tmp_path / "in", f"{n}.json", [json.dumps({"lot_id": k, "kind": "PRACA_UNICA", "at": a, "target": t, "seen_at": f"2026-01-0{n + 1} 00:00:00"}) for k, a, t in step])
    stream = spark.readStream.schema("lot_id bigint, kind string, at timestamp, target string, seen_at timestamp").option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
    found = []
    finish(state.changes(stream).writeStream.foreachBatch(lambda rows, n: found.extend(rows.collect())).option("checkpointLocation", f"file://{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start())
    assert [(r["change"], r["new_status"]) for r in found] == [("criado", "CONFIRMADO"), ("remarcado", "REMARCADO"), ("status", "SUSPENSO"), ("cancelado", "CANCELADO")]
    assert found[1]["old_at"] == datetime.fromisoformat(at) and found[1]["new_at"] == datetime.fromisoformat(later)


def test_windows_drop_what_comes_too_late(spark, tmp_path):
    start = datetime(2026, 1, 1)
    frame = lambda hours: pd.DataFrame({"ts": [start + timedelta(hours=h) for h in hours], "event_type": "click", "value": 1.0, "user_id": 1})
    (tmp_path / "in").mkdir()
    for n, hours in enumerate(([1, 2], [30, 60], [61], [3])):
        path = tmp_path / "in" / f"{n}.parquet"
        frame(hours).to_parquet(path, coerce_timestamps="us")
        os.utime(path, (1_700_000_000 + 60 * n,) * 2)  # files are taken by their age
    stream = spark.readStream.schema("ts timestamp, event_type string, value double, user_id long").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    finish(windows.tumbling(stream).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start())
    got = {r["start"].day: r["n"] for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got[1] == 2 and got[2] == 1 and 3 not in got
