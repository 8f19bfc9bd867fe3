"""What screens ask for: summaries, details with everything nested, favourites, histories, what waits for work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: from this confidence on a finding is confirmed.
CONFIRMED_FROM = 0.70


def next_of(sessions: DataFrame, as_of: str) -> DataFrame:
    """(lot_id, next_session, next_ordinal): the earliest session to come, else the latest past one."""
    ahead = F.col("at") >= F.lit(as_of).cast("timestamp_ntz")
    found = sessions.filter("at is not null").groupBy("lot_id").agg(F.coalesce(F.min(F.when(ahead, F.struct("at", "ordinal"))), F.max(F.struct("at", "ordinal"))).alias("s"))
    return found.select("lot_id", F.col("s.at").alias("next_session"), F.col("s.ordinal").alias("next_ordinal"))


def summary(lots: DataFrame, sessions: DataFrame, as_of: str, auctioneers: DataFrame | None = None) -> DataFrame:
    """lots with next_session, next_ordinal and, where auctioneers (auctioneer_id, name, status) are given, a struct."""
    found = lots.join(next_of(sessions, as_of), "lot_id", "left")
    if auctioneers is not None:
        told = auctioneers.select("auctioneer_id", F.struct("auctioneer_id", "name", "status").alias("auctioneer"))
        found = found.join(told, "auctioneer_id", "left")
    return found


def typed_value(number: Column, at: Column, flag: Column, words: Column) -> Column:
    """The first value that is there, as text: number, date, truth, words."""
    return F.coalesce(number.cast("string"), at.cast("string"), flag.cast("string"), words)


def nested(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """(lot_id, name): a lot's rows as an array of structs, sorted by the order's columns."""
    rest = [c for c in rows.columns if c != "lot_id" and c not in order]
    return rows.groupBy("lot_id").agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(name))


def detail(summaries: DataFrame, findings: DataFrame, review_first: bool = False, **children: DataFrame) -> DataFrame:
    """Summaries with `fields` (name, value, confidence, review) by name, and each of the children, keyed by lot_id,
    as an array under its name. review_first: fields that wait for a person come first, as the screen shows them."""
    value = typed_value(F.col("number"), F.col("at"), F.col("flag"), F.col("text")).alias("value")
    fields = findings.select("lot_id", (~F.col("review")).alias("settled"), "name", value, "confidence", "review")
    fields = nested(fields, "fields", "settled", "name") if review_first else nested(fields.drop("settled"), "fields", "name")
    out = summaries.join(fields, "lot_id", "left")
    for name, rows in children.items():
        out = out.join(nested(rows, name), "lot_id", "left")
    return out


def confirmed_fields(findings: DataFrame) -> DataFrame:
    """(lot_id, confirmed, to_review) counts."""
    sure = F.col("confidence") >= CONFIRMED_FROM
    return findings.groupBy("lot_id").agg(F.count_if(sure).alias("confirmed"), F.count_if(~sure).alias("to_review"))


def last_findings(findings: DataFrame, sequence: str = "n") -> DataFrame:
    """The last finding of each name in a lot, whatever its confidence."""
    best = findings.groupBy("lot_id", "name").agg(F.max_by(F.struct(*findings.columns), F.col(sequence)).alias("_row"))
    return best.select("_row.*")


def with_places(lots: DataFrame, cases: DataFrame, districts: DataFrame, courts: DataFrame) -> DataFrame:
    """lots with chamber, comarca and court_name by way of their case: three keyed joins, small sides by AQE."""
    placed = cases.join(districts.select("district_id", F.col("name").alias("comarca")), "district_id", "left").join(courts.select("court_id", F.col("name").alias("court_name")), "court_id", "left")
    return lots.join(placed.select("case_id", "chamber", "comarca", "court_name"), "case_id", "left")


def pending_documents(documents: DataFrame, most: int = 50) -> DataFrame:
    """Documents whose facts are not extracted yet, by id, as many as one run takes."""
    return documents.filter(F.col("extracted_at").isNull()).orderBy("document_id").limit(most)


def favourites(marks: DataFrame, lots: DataFrame, user: int) -> DataFrame:
    """A user's marked lots, the latest mark first."""
    return marks.filter(F.col("user_id") == user).join(lots, "lot_id").orderBy(F.col("marked_at").desc(), "lot_id")


def history(events: DataFrame, changes: DataFrame, lot_id: int | None = None) -> DataFrame:
    """Changes of lots' events, with the event's present date and status, the latest change first."""
    own = changes if lot_id is None else changes.filter(F.col("lot_id") == lot_id)
    now = events.select("lot_id", "kind", F.col("at").alias("event_at"), "event_status")
    return own.join(now, ["lot_id", "kind"])


def shown_events(events: DataFrame, items: DataFrame) -> DataFrame:
    """The events behind an agenda's items, for its calendar: a semi-join on lot and kind."""
    return events.join(items.select("lot_id", "kind"), ["lot_id", "kind"], "left_semi")


def agenda_totals(items: DataFrame) -> DataFrame:
    """(total, from_gazette) of an agenda's items that were joined to their first publication."""
    return items.agg(F.count(F.lit(1)).alias("total"), F.count("published_on").alias("from_gazette"))
