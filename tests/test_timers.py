"""Events as state with timers: equal to the difference of snapshots, late rows, restarts, dates that pass."""

import json

import pytest
from pyspark.sql import functions as F

from martelo.operators import events
from martelo.streaming import timers

ROW = "lot_id bigint, kind string, at timestamp, target string, seen_at timestamp"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def session(spark):
    """The session with RocksDB as its state store, for the test only."""
    old = spark.conf.get(PROVIDER)
    timers.prepare(spark)
    yield spark
    spark.conf.set(PROVIDER, old)


class Run:
    """A folder of snapshots and a query over it; every call is a restart from the checkpoint."""

    def __init__(self, spark, path, initial=None):
        self.spark, self.path, self.initial, self.n = spark, path, initial, 0
        (path / "in").mkdir()

    def __call__(self, *rows):
        self.n += 1
        lines = [json.dumps(dict(zip(("lot_id", "kind", "at", "target", "seen_at"), r, strict=True))) for r in rows]
        (self.path / "in" / f"{self.n:03d}.json").write_text("\n".join(lines) + "\n")
        stream = self.spark.readStream.schema(ROW).json(f"file://{self.path}/in")
        made = timers.timed_changes(stream, self.initial, keep_days=5).withColumn("run", F.lit(self.n))
        query = made.writeStream.format("parquet").option("path", f"{self.path}/out").option("checkpointLocation", f"{self.path}/at").trigger(availableNow=True).start()
        query.awaitTermination()
        found = self.spark.read.parquet(f"{self.path}/out").filter(F.col("run") == self.n)
        return sorted((r.lot_id, r.kind, r.change, r.old_at and str(r.old_at)[:10], str(r.new_at)[:10], r.new_status) for r in found.collect())


def test_equals_the_difference(session, tmp_path):
    """Each snapshot's changes are those that the batch operator tells, from stored events on."""
    spark = session
    kind, stored = "lot_id bigint, kind string, at timestamp, event_status string", [(i, "PRACA_UNICA", f"2026-06-{10 + i % 3} 10:00:00", "CONFIRMADO") for i in range(12)]
    frame = lambda rows, schema: spark.createDataFrame([(a, b, c, d) for a, b, c, d in rows], schema.replace("timestamp", "string")).withColumn("at", F.col("at").cast("timestamp"))
    held = frame(stored, kind)
    asked = [(i, "PRACA_UNICA", f"2026-06-{10 + i % 3 + (i % 4 == 0)} 10:00:00", ("CONFIRMADO", "SUSPENSO")[i % 5 == 1]) for i in range(3, 16)]
    wanted = events.difference(held, frame(asked, kind.replace("event_status", "target"))).collect()
    run = Run(spark, tmp_path, held)
    told = run(*((*r, "2026-05-01 09:00:00") for r in asked), *((i, "PRACA_UNICA", None, None, "2026-05-01 09:00:00") for i in range(3)))
    assert told == sorted((r.lot_id, r.kind, r.change, r.old_at and str(r.old_at)[:10], str(r.new_at)[:10], r.new_status) for r in wanted)
    assert {r[2] for r in told} == {"criado", "remarcado", "status", "cancelado"}


def test_late_rows_and_dates_that_pass(session, tmp_path):
    run = Run(session, tmp_path)
    one, two = (1, "PRACA_PRIMEIRA"), (2, "PRACA_UNICA")
    assert run((*one, "2026-06-10 10:00:00", "CONFIRMADO", "2026-06-01 09:00:00"), (*two, "2026-06-05 10:00:00", "CONFIRMADO", "2026-06-01 09:00:00")) == [(*one, "criado", None, "2026-06-10", "CONFIRMADO"), (*two, "criado", None, "2026-06-05", "CONFIRMADO")]
    # the later of two snapshots of one run counts last, and one seen before it tells nothing in the next run
    assert run((*one, "2026-06-12 10:00:00", "CONFIRMADO", "2026-06-02 12:00:00"), (*one, "2026-06-11 10:00:00", "CONFIRMADO", "2026-06-02 10:00:00")) == [(*one, "remarcado", "2026-06-10", "2026-06-11", "REMARCADO"), (*one, "remarcado", "2026-06-11", "2026-06-12", "REMARCADO")]
    assert run((*one, "2026-06-20 10:00:00", "CONFIRMADO", "2026-06-02 11:00:00")) == []
    # the watermark is a day behind what was seen: lot 2's date has passed, lot 1's has not
    other = (3, "PRACA_UNICA")
    passed = run((*other, "2026-09-01 10:00:00", "CONFIRMADO", "2026-06-08 09:00:00"))
    assert passed == [(*two, "realizado", "2026-06-05", "2026-06-05", "REALIZADO"), (*other, "criado", None, "2026-09-01", "CONFIRMADO")]
    assert run((*two, "2026-06-05 10:00:00", "CONFIRMADO", "2026-06-08 10:00:00")) == []  # held already, still known
    # five days after its date the event is forgotten, and would be new again
    run((*other, "2026-09-01 10:00:00", "CONFIRMADO", "2026-06-20 09:00:00"))
    assert (*two, "criado", None, "2026-06-05", "CONFIRMADO") in run((*two, "2026-06-05 10:00:00", "CONFIRMADO", "2026-06-20 10:00:00"))


def test_cancelled_events_do_not_pass(session, tmp_path):
    run, key = Run(session, tmp_path), (1, "PRACA_UNICA")
    run((*key, "2026-06-10 10:00:00", "CONFIRMADO", "2026-06-01 09:00:00"))
    assert run((*key, None, None, "2026-06-02 09:00:00")) == [(*key, "cancelado", "2026-06-10", "2026-06-10", "CANCELADO")]
    assert [r for r in run((2, "PRACA_UNICA", "2026-09-10 10:00:00", "CONFIRMADO", "2026-06-12 09:00:00")) if r[0] == 1] == []
