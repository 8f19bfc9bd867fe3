"""Calendar events from sessions, and what changed since last time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Days between the deadline to enrol and the first session; event status by lot status.
DEADLINE_DAYS = 3
STATUS = {"SUSPENSO": "SUSPENSO", "CANCELADO": "CANCELADO", "ARREMATADO": "REALIZADO", "DESERTO": "REALIZADO", "ENCERRADO": "REALIZADO", "ABERTO": "CONFIRMADO"}
REMINDERS = (72, 24, 1)


def event_status(status):
    table = F.create_map(*(F.lit(x) for pair in STATUS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, status), F.lit("CONFIRMADO"))


def wanted(sessions: DataFrame, lots: DataFrame) -> DataFrame:
    """(lot_id, kind, at, estimated, target): what a lot's sessions ask for.

    One dated first session and no other: a single session. Ordinals beyond 2 have no event. The deadline lies
    DEADLINE_DAYS before the first dated session and is an estimate. A lot has a few sessions, so they meet in a row.
    """
    dated = F.col("at").isNotNull()
    own = sessions.groupBy("lot_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(dated & F.col("ordinal").between(1, 2), F.struct("ordinal", "at")))).alias("held"), F.min(F.when(dated, F.struct("ordinal", "at"))).alias("first"))
    event = lambda kind, at, estimated: F.struct(kind.alias("kind"), at.alias("at"), F.lit(estimated).alias("estimated"))
    kind = lambda ordinal: F.when((F.col("n") == 1) & (ordinal == 1), "PRACA_UNICA").when(ordinal == 1, "PRACA_PRIMEIRA").otherwise("PRACA_SEGUNDA")
    held = F.transform("held", lambda s: event(kind(s["ordinal"]), s["at"], False))
    due = F.array_compact(F.array(F.when(F.col("first").isNotNull(), event(F.lit("PRAZO_HABILITACAO"), F.col("first.at") - F.make_dt_interval(days=F.lit(DEADLINE_DAYS)), True))))
    # one shuffle of the sessions, and the lots' status joins before the events come apart
    known = own.join(lots.select("lot_id", event_status(F.col("status")).alias("target")), "lot_id")
    return known.select("lot_id", F.inline(F.concat(held, due)), "target")


def difference(stored: DataFrame, asked: DataFrame) -> DataFrame:
    """One row for each event that is new, moved, changed in status or gone.

    stored (lot_id, kind, at, event_status), asked as from wanted. A move comes before a change of status; a change
    to CONFIRMADO is none; what is no longer asked for is cancelled, once, never deleted.
    """
    both = stored.select("lot_id", "kind", F.col("at").alias("old_at"), F.col("event_status").alias("old_status")).join(asked.select("lot_id", "kind", F.col("at").alias("new_at"), "target"), ["lot_id", "kind"], "full_outer")
    change = (
        F.when(F.col("old_status").isNull(), "criado")
        .when(F.col("target").isNull() & (F.col("old_status") != "CANCELADO"), "cancelado")
        .when(F.col("target").isNull(), None)
        .when(F.col("old_at") != F.col("new_at"), "remarcado")
        .when((F.col("old_status") != F.col("target")) & (F.col("target") != "CONFIRMADO"), "status")
    )
    status = F.when(change == "criado", F.col("target")).when(change == "cancelado", "CANCELADO").when(change == "remarcado", "REMARCADO").otherwise(F.col("target"))
    return both.withColumn("change", change).filter("change is not null").select("lot_id", "kind", "change", "old_at", F.coalesce("new_at", "old_at").alias("new_at"), "old_status", status.alias("new_status"))


def applied(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """The stored events after the changes."""
    new = changes.select("lot_id", "kind", F.col("new_at").alias("_at"), F.col("new_status").alias("_status"))
    both = stored.join(new, ["lot_id", "kind"], "full_outer")
    return both.select("lot_id", "kind", F.coalesce("_at", "at").alias("at"), F.coalesce("_status", "event_status").alias("event_status"))


def history_of(changes: DataFrame) -> DataFrame:
    """Rows for the append-only history: every change but a creation."""
    return changes.filter("change <> 'criado'")


def reschedules(changes: DataFrame) -> DataFrame:
    return changes.groupBy("lot_id").agg(F.count_if(F.col("change") == "remarcado").alias("reschedules"))


def sync_sessions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sessions (lot_id, ordinal, at, share) with new ones merged in. A date over another one marks REMARCADA; a
    first date over none doesn't; a missing share is filled."""
    both = old.alias("o").join(new.alias("n"), ["lot_id", "ordinal"], "full_outer")
    moved = F.col("o.at").isNotNull() & F.col("n.at").isNotNull() & (F.col("o.at") != F.col("n.at"))
    return both.select("lot_id", "ordinal", F.coalesce("n.at", "o.at").alias("at"), F.coalesce("o.share", "n.share").alias("share"), F.when(moved, "REMARCADA").otherwise("AGENDADA").alias("session_status"))
