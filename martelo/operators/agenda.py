"""Agenda, calendar, current session: what happens when."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import local_day
from ..functions.present import CATEGORIES, category

#: Kinds of sessions; anything else is a deadline.
SESSIONS = ("PRACA_UNICA", "PRACA_PRIMEIRA", "PRACA_SEGUNDA")


def _moment(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def items(events: DataFrame, lots: DataFrame, start: str, days: int = 60, uf: Sequence[str] = (), sphere: Sequence[str] = (), categories: Sequence[str] = (), gazette: DataFrame | None = None, gazette_only: bool = False, deadlines: bool = False, limit: int = 500) -> DataFrame:
    """Items of an agenda: events in [start, start + days], cancelled ones left out, ordered, and limited last.

    gazette: first publication of each lot (lot_id, published_on), joined where given.
    """
    begin = _moment(start)
    due = events.filter(F.col("at").between(begin, begin + F.make_dt_interval(days=F.lit(days))) & (F.col("event_status") != "CANCELADO"))
    if not deadlines:
        due = due.filter(F.col("kind").isin(*SESSIONS))
    found = due.join(lots.withColumn("category", category(F.col("nature"), F.col("zone"))), "lot_id")
    for name, values in (("uf", uf), ("sphere", sphere), ("category", categories)):
        if values:
            found = found.filter(F.col(name).isin(*values))
    if gazette is not None:
        found = found.join(gazette, "lot_id", "inner" if gazette_only else "left")
    return found.withColumn("day", local_day(F.col("at"))).orderBy("at", "lot_id", "kind").limit(limit)


def days(items: DataFrame) -> DataFrame:
    """One row for each local day with its items nested in order."""
    entry = F.struct("at", "lot_id", "kind", "title", "category")
    return items.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(entry)).alias("items"))


def by_category(items: DataFrame) -> DataFrame:
    """Items in each of the five categories, zeros included."""
    names = items.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    return names.join(items.groupBy("category").agg(F.count(F.lit(1)).alias("n")), "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


def calendar(events: DataFrame, lots: DataFrame, start: str, end: str, uf: Sequence[str] = (), asset: Sequence[str] = (), limit: int = 1000) -> DataFrame:
    """Events of a calendar. The limit comes before the lots' filters, and cancelled events stay."""
    due = events.filter(F.col("at").between(_moment(start), _moment(end))).orderBy("at", "lot_id", "kind").limit(limit)
    found = due.join(lots, "lot_id")
    for name, values in (("uf", uf), ("asset", asset)):
        if values:
            found = found.filter(F.col(name).isin(*values))
    return found


def current_session(lots: DataFrame, sessions: DataFrame, as_of: str) -> DataFrame:
    """(lot_id, ordinal, at, minimum, passed): the first session by ordinal still to come, else the latest one.

    Aggregates only: no window, one shuffle. The minimum is that of the session's ordinal, for 1 and 2.
    """
    dated = sessions.filter(F.col("at").isNotNull())
    ahead = F.col("at") > _moment(as_of)
    found = dated.groupBy("lot_id").agg(
        F.min(F.when(ahead, F.struct("ordinal", "at"))).alias("next"),
        F.max(F.struct("at", -F.col("ordinal"))).alias("last"),
    )
    chosen = found.select("lot_id", F.coalesce(F.col("next.ordinal"), -F.col("last.col2")).alias("ordinal"), F.coalesce("next.at", "last.at").alias("at"), F.col("next").isNull().alias("passed"))
    minimum = F.when(F.col("ordinal") == 1, F.col("first_min")).when(F.col("ordinal") == 2, F.col("second_min"))
    return chosen.join(lots.select("lot_id", "first_min", "second_min"), "lot_id").select("lot_id", "ordinal", "at", minimum.alias("minimum"), "passed")


def next_session(events: DataFrame, as_of: str) -> DataFrame:
    """The earliest session to come, else the latest past one."""
    ahead = F.col("at") >= _moment(as_of)
    return events.filter(F.col("kind").isin(*SESSIONS)).groupBy("lot_id").agg(F.coalesce(F.min(F.when(ahead, F.col("at"))), F.max("at")).alias("next_at"))


def first_publication(publications: DataFrame) -> DataFrame:
    """The earliest detected publication of each lot; one without a date comes last."""
    return publications.filter("detected").groupBy("lot_id").agg(F.min_by("publication_id", F.struct(F.col("published_on").isNull(), "published_on", "publication_id")).alias("publication_id"), F.min("published_on").alias("published_on"))
