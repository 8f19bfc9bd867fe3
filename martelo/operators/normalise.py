"""Raw lots to normalised ones: case, court, state, redaction, minima, keys and class; and the dimensions they name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parse, text
from .terms import classify

#: Type of a raw lot's sessions.
SESSIONS = "array<struct<ordinal:int,at:timestamp_ntz,share:decimal(5,2),minimum:decimal(14,2)>>"


def with_minima(appraisal: Column, sessions: Column) -> Column:
    """Sessions with the minima that the notice implies: its stated share of the appraisal, half-even to cents; the
    first session without share or minimum goes at the appraisal. No share is ever assumed."""
    money = lambda c: c.cast("decimal(14,2)")

    def one(s: Column) -> Column:
        implied = F.when(s["share"].isNotNull(), money(F.bround(appraisal * s["share"] / 100, 2)))
        first = F.when((s["ordinal"] == 1) & (appraisal != 0), money(appraisal))
        return F.struct(s["ordinal"].alias("ordinal"), s["at"].alias("at"), s["share"].alias("share"), money(F.coalesce(s["minimum"], implied, first)).alias("minimum"))

    return F.transform(sessions, one)


def minimum(sessions: Column, ordinal: int) -> Column:
    """The minimum of the first session of that ordinal."""
    return F.get(F.filter(sessions, lambda s: s["ordinal"] == ordinal), F.lit(0))["minimum"]


def _warnings(given: Column, valid: Column, appraisal: Column, sessions: Column, plate: Column, masked: Column, tie: Column) -> Column:
    derived = F.transform(
        F.filter(sessions, lambda s: s["minimum"].isNull() & s["share"].isNotNull() & appraisal.isNotNull()),
        lambda s: F.concat(F.lit("minimum of session "), s["ordinal"].cast("string"), F.lit(" derived from "), s["share"].cast("string"), F.lit("% of the appraisal")),
    )
    said = F.array(
        F.when(given.isNotNull() & ~valid, F.concat(F.lit("case number "), given, F.lit(" fails its check digits: a reference only"))),
        F.when(plate.isNotNull() & (plate != "") & masked.isNull(), F.lit("plate not recognised: dropped")),
        F.when(tie, F.lit("signs of both a rural and an urban zone: zone left open")),
    )
    return F.concat(F.array_compact(said), derived)


def normalised(lots: DataFrame) -> DataFrame:
    """Raw lots (source, title, description, address, district, city, comarca, uf, court, case_number, lot_number,
    asset, appraisal, plate, sessions) in their normal form; their other columns pass.

    The case number is the stated one, else the first in title and description; only one whose check digits hold
    leads to a court and to the natural key. Identity numbers are removed and plates masked before anything is kept.
    Adds case_valid, sphere, first_min, second_min, content_hash, natural_key, nature, zone and their scores, and
    warnings.
    """
    given = F.coalesce("case_number", parse.case_number(F.concat_ws(" ", "title", F.coalesce("description", F.lit("")))))
    rows = lots.withColumns({"_case": given, "_plate": text.masked_plate(F.col("plate")), "_description": text.without_cpf(text.tidy(F.col("description")))})
    rows = rows.withColumn("case_valid", F.coalesce(parse.case_is_valid(F.col("_case")), F.lit(False)))
    court = F.coalesce("court", F.when(F.col("case_valid"), parse.case_court(F.col("_case"))))
    rows = rows.withColumn("_court", court).withColumn("_uf", parse.state(F.col("uf"), F.col("_court"), F.col("city"), F.col("address"), F.col("title")))
    rows = rows.withColumn("_court", F.coalesce("_court", F.when(F.col("_uf").isin(*parse.STATES), F.concat(F.lit("TJ"), F.col("_uf")))))
    rows = rows.withColumn("_sessions", with_minima(F.col("appraisal"), F.col("sessions")))
    body = F.concat_ws(" ", "title", "_description", "address", F.when(F.coalesce("district", F.lit("")) != "", F.concat(F.lit("bairro "), F.col("district"))))
    rows = classify(rows.withColumn("_body", body), "_body", declared="asset")
    told = F.to_json(F.transform("_sessions", lambda s: F.struct(s["ordinal"].alias("o"), s["at"].alias("t"), s["minimum"].alias("m"))))
    rows = rows.withColumn("content_hash", text.content_key(F.col("source"), F.col("title"), F.col("appraisal"), told, F.col("_description")))
    made = {
        "warnings": _warnings(F.col("_case"), F.col("case_valid"), F.col("appraisal"), F.col("sessions"), F.col("plate"), F.col("_plate"), F.col("zone_tie")),
        "natural_key": text.natural_key(F.col("_court"), F.when(F.col("case_valid"), F.col("_case")), F.col("lot_number"), F.col("source"), F.col("content_hash")),
        "first_min": minimum(F.col("_sessions"), 1),
        "second_min": minimum(F.col("_sessions"), 2),
        "sphere": parse.sphere(F.coalesce("_court", F.lit(""))),
        "city": F.coalesce(text.tidy(F.col("city")), text.tidy(F.col("comarca"))),
        "district": text.tidy(F.col("district")),
        "address": text.tidy(F.col("address")),
    }
    rows = rows.withColumns(made).withColumns({"case_number": F.col("_case"), "court": F.col("_court"), "uf": F.col("_uf"), "plate": F.col("_plate"), "description": F.col("_description"), "sessions": F.col("_sessions")})
    return rows.drop("_case", "_plate", "_description", "_court", "_uf", "_sessions", "_body", "zone_tie")


def key_id(*keys: Column) -> Column:
    """An id that follows from a key, so that a replay gives the same one and no counter is shared."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 2)


def find_or_create(rows: DataFrame, known: DataFrame, keys: Sequence[str], id_name: str) -> tuple[DataFrame, DataFrame]:
    """(rows with id_name, the dimension's new rows): each row finds its key among known (id_name, keys) or makes it.

    Rows whose key has a null find nothing and make nothing. Of several known ids of one key the least counts.
    """
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    once = known.groupBy(*keys).agg(F.min(id_name).alias("_known"))
    made = rows.filter(whole).select(*keys).distinct().join(once, list(keys), "left_anti").withColumn(id_name, key_id(*(F.col(k) for k in keys)))
    found = rows.join(once, list(keys), "left").withColumn(id_name, F.coalesce("_known", F.when(whole, key_id(*(F.col(k) for k in keys))))).select(*rows.columns, id_name)
    return found, made.select(id_name, *keys)


def dimensions(lots: DataFrame, courts: DataFrame, districts: DataFrame, cases: DataFrame, auctioneers: DataFrame) -> dict[str, DataFrame]:
    """Normalised lots (court, comarca, case_number, case_valid, auctioneer_name) with the ids of what they name, under
    'lots', and the new rows of each dimension.

    A district belongs to its court, by slug; a case needs valid digits; an auctioneer is known by the comparable name.
    """
    rows = lots.withColumns({"district_slug": F.when(text.tidy(F.col("comarca")).isNotNull(), text.slug(F.col("comarca"))), "valid_case": F.when(F.col("case_valid"), F.col("case_number")), "name_key": F.nullif(text.comparable(F.col("auctioneer_name")), F.lit(""))})
    rows, new_courts = find_or_create(rows, courts, ["court"], "court_id")
    rows, new_districts = find_or_create(rows, districts, ["court_id", "district_slug"], "district_id")
    rows, new_cases = find_or_create(rows, cases, ["valid_case"], "case_id")
    rows, new_auctioneers = find_or_create(rows, auctioneers, ["name_key"], "auctioneer_id")
    return {"lots": rows, "courts": new_courts, "districts": new_districts, "cases": new_cases, "auctioneers": new_auctioneers}
