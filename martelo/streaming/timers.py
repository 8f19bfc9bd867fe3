"""Events of lots as keyed state with event-time timers: changes from snapshots, and what passes with time.

The state of a (lot, kind) is its last known date and status, when it was last told of, and one timer. Snapshots
change it as `operators.events.difference` does. When the watermark passes an event's date the event is held: the
change 'realizado' is told, once. KEEP_DAYS later the state goes, so that closed lots leave nothing behind; until
then later snapshots still find it. A snapshot that was seen before the last one taken tells nothing.

State lives in RocksDB, and may start from stored events (`initial`), which then need not be told again.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Days that the state of an event is kept after its date.
KEEP_DAYS = 30
#: Statuses that no date ends.
OVER = ("CANCELADO", "REALIZADO")
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "lot_id bigint, kind string, change string, old_at timestamp, new_at timestamp, new_status string"
STATE = "at timestamp, status string, seen_at timestamp"


def _moment(value) -> dt.datetime | None:
    return None if value is None or value is pd.NaT else pd.Timestamp(value).to_pydatetime()


def change_of(old: tuple | None, at, target) -> tuple[str | None, dt.datetime | None, str | None]:
    """(change, date, status) after a snapshot asks for a date and status, or, with a null target, for nothing."""
    if target is None:
        if old is None:
            return None, None, None
        return ("cancelado", old[0], "CANCELADO") if old[1] not in OVER else (None, *old)
    if old is None:
        return "criado", at, target
    if old[0] != at:
        return "remarcado", at, "REMARCADO"
    if old[1] != target and target != "CONFIRMADO":
        return "status", at, target
    return None, *old


class EventTimers(StatefulProcessor):
    def __init__(self, keep_days: int = KEEP_DAYS):
        self.keep = dt.timedelta(days=keep_days)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.event = handle.getValueState("event", STATE)

    def _hold(self, at: dt.datetime, status: str, seen_at: dt.datetime | None, moved: bool) -> None:
        """Keep the event, and one timer: at its date, or, for one that is over, when its state goes."""
        self.event.update((at, status, seen_at))
        if moved:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            due = at + self.keep if status in OVER else at
            self.handle.registerTimer(int(pd.Timestamp(due, tz="UTC").timestamp() * 1000))

    def _held(self) -> tuple | None:
        if not self.event.exists():
            return None
        at, status, seen_at = self.event.get()
        return _moment(at), status, _moment(seen_at)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for row in initialState.itertuples(index=False):
            self._hold(_moment(row.at), row.event_status, None, True)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        told = sorted((r for frame in rows for r in zip(map(_moment, frame["seen_at"]), map(_moment, frame["at"]), frame["target"], strict=True)), key=lambda r: r[0])
        held, out = self._held(), []
        for seen_at, at, target in told:
            if held and held[2] is not None and seen_at < held[2]:
                continue
            target = None if target is None or target != target else target
            change, new_at, status = change_of(held and held[:2], at, target)
            if status is None:
                continue
            if change:
                out.append((*key, change, held and held[0], new_at, status))
            self._hold(new_at, status, seen_at, change is not None)
            held = new_at, status, seen_at
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        if held is None:
            yield _frame([])
        elif held[1] in OVER:
            self.event.clear()
            yield _frame([])
        else:
            self._hold(held[0], "REALIZADO", held[2], True)
            yield _frame([(*key, "realizado", held[0], held[0], "REALIZADO")])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["lot_id", "kind", "change", "old_at", "new_at", "new_status"])
    return frame.astype({"old_at": "datetime64[us]", "new_at": "datetime64[us]"})


def prepare(spark: SparkSession) -> None:
    """State of this kind needs RocksDB; a session with streams of another provider should be another one."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def timed_changes(snapshots: DataFrame, initial: DataFrame | None = None, late: str = "1 day", keep_days: int = KEEP_DAYS) -> DataFrame:
    """snapshots: a stream (lot_id, kind, at, target, seen_at), times as timestamps; its watermark runs `late` behind
    seen_at. initial: stored events (lot_id, kind, at, event_status) that a first run starts from."""
    keyed = snapshots.withWatermark("seen_at", late).groupBy("lot_id", "kind")
    start = initial.groupBy("lot_id", "kind") if initial is not None else None
    return keyed.transformWithStateInPandas(EventTimers(keep_days), SCHEMA, "Append", "EventTime", start)
