"""Event changes from a stream of snapshots, with the last known event of each (lot, kind) as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "lot_id bigint, kind string, change string, old_at timestamp, new_at timestamp, new_status string"


def _changes(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """One lot and kind: rows (at, target) in the order of seen_at; target null means it is no longer asked for."""
    old_at, old_status = state.get if state.exists else (None, None)
    rows = pd.concat(list(frames)).sort_values(["seen_at"], kind="stable")
    out = []
    for at, target in zip(rows["at"], rows["target"], strict=True):
        gone = target is None or target != target
        if gone:
            change, status, at = ("cancelado", "CANCELADO", old_at) if old_status not in (None, "CANCELADO") else (None, old_status, old_at)
        elif old_status is None:
            change, status = "criado", target
        elif pd.Timestamp(old_at) != at:
            change, status = "remarcado", "REMARCADO"
        elif old_status != target and target != "CONFIRMADO":
            change, status = "status", target
        else:
            change, status, at = None, old_status, old_at
        if change:
            out.append((*key, change, old_at, at, status))
        old_at, old_status = at, status
    if old_status is not None:
        state.update((old_at, old_status))
    yield pd.DataFrame(out, columns=["lot_id", "kind", "change", "old_at", "new_at", "new_status"])


def changes(snapshots: DataFrame) -> DataFrame:
    """snapshots: a stream (lot_id, kind, at, target, seen_at). The state is one date and status a key."""
    return snapshots.groupBy("lot_id", "kind").applyInPandasWithState(_changes, SCHEMA, "at timestamp, status string", "append", "NoTimeout")
