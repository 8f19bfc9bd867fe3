"""Dockets of courts, as a search over their index returns them: which speak of an auction, and the lots they signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parse, text
from ..operators.terms import auction_movements

SOURCE = "datajud-hastas"


def with_auctions(dockets: DataFrame, as_of: str, days: int = 30, movements: str = "movements") -> DataFrame:
    """Dockets (updated_at, movements as structs with name and at) that were updated within the days and have a
    movement that speaks of an auction."""
    since = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(days))
    recent = F.col("updated_at").cast("timestamp_ntz") >= F.date_trunc("DAY", since).cast("timestamp_ntz")
    return dockets.filter(recent & auction_movements(F.transform(movements, lambda m: m["name"])))


def last_movement(movements: str = "movements") -> Column:
    """The name of the latest movement, by date; one without a date counts as the earliest."""
    return F.array_max(F.transform(movements, lambda m: F.struct(m["at"].alias("at"), m["name"].alias("name"))))["name"]


def as_lots(dockets: DataFrame) -> DataFrame:
    """Lots that only say that an auction is set: the asset comes with its notice. The state is the court's only one."""
    title = F.concat(F.lit("Hasta publica sinalizada - "), F.coalesce("case_class", F.lit("processo")), F.lit(" ("), F.coalesce("organ", "court"), F.lit(")"))
    state = parse.state(F.lit(None).cast("string"), F.col("court"))
    number = F.coalesce(parse.case_number(F.col("case_number")), F.col("case_number"))
    keys = [c for c in dockets.columns if c not in ("case_number", "court", "case_class", "organ", "subject", "grade", "movements", "updated_at")]
    return dockets.select(*keys, F.lit(SOURCE).alias("source"), F.substring(text.tidy(title), 1, 300).alias("title"), text.tidy(last_movement()).alias("description"), number.alias("case_number"), "court", state.alias("uf"), F.col("organ").alias("chamber"), F.lit(True).alias("signal_only"), "subject", "grade")
