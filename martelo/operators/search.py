"""Search over lots: one predicate, one order, one page."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import comparable, holds_all

STATUSES = ("ABERTO", "SUSPENSO", "CANCELADO", "ARREMATADO", "DESERTO", "ENCERRADO")
DOMAINS = {"status": STATUSES, "asset": ("IMOVEL", "VEICULO", "OUTRO"), "nature": ("IMOVEL", "MOVEL", "INDEFINIDA"), "zone": ("RURAL", "URBANA", "INDEFINIDA"), "sphere": ("ESTADUAL", "FEDERAL", "DESCONHECIDA")}
BODY = ("title", "description", "city", "district", "address", "brand", "model", "case_number")


def price(first: str = "first_min", second: str = "second_min") -> Column:
    """The price a filter compares: the second minimum unless it is null. A zero counts."""
    return F.coalesce(F.col(second), F.col(first))


def truthy_price(first: str = "first_min", second: str = "second_min") -> Column:
    """The price an order sorts by: zeros count as missing."""
    return F.coalesce(F.nullif(F.col(second), F.lit(0)), F.nullif(F.col(first), F.lit(0)))


@dataclass(frozen=True)
class LotFilter:
    """Criteria of a search; empty ones ask for nothing. The default asks for open lots."""

    status: Sequence[str] = ("ABERTO",)
    uf: Sequence[str] = ()
    asset: Sequence[str] = ()
    nature: Sequence[str] = ()
    zone: Sequence[str] = ()
    sphere: Sequence[str] = ()
    cities: Sequence[str] = ()
    districts: Sequence[str] = ()
    auctioneers: Sequence[int] = ()
    least_price: float | None = None
    most_price: float | None = None
    least_discount: float | None = None
    least_score: float | None = None
    vacant_only: bool = False
    without_liens: bool = False
    words: str = ""
    days_ahead: int | None = None
    order: str = "score"
    page: int = field(default=1)
    size: int = field(default=20)

    @classmethod
    def from_criteria(cls, criteria: Mapping) -> LotFilter:
        """Saved criteria: scalars become lists, unknown keys and values outside a domain are dropped."""
        known = {f.name: f for f in fields(cls)}
        kept: dict = {}
        for name, value in criteria.items():
            if name not in known or value is None:
                continue
            if isinstance(known[name].default, tuple):
                values = [value] if isinstance(value, (str, int)) else list(value)
                if name == "uf":
                    values = [str(v).upper() for v in values]
                kept[name] = tuple(v for v in values if name not in DOMAINS or v in DOMAINS[name])
            elif name in ("least_price", "most_price", "least_discount", "least_score"):
                try:
                    kept[name] = float(value)
                except (TypeError, ValueError):
                    continue
            else:
                kept[name] = value
        return cls(**kept)

    def predicate(self, columns: Sequence[str]) -> Column:
        """All criteria but the days ahead as one condition, which Catalyst pushes to the scan as far as it goes."""
        asked = [F.col(name).isin(*values) for name in ("status", "uf", "asset", "nature", "zone", "sphere") if (values := getattr(self, name))]
        if self.auctioneers:
            asked.append(F.col("auctioneer_id").isin(*self.auctioneers))
        for name, values in (("city", self.cities), ("district", self.districts)):
            if values:
                asked.append(comparable(F.col(name)).isin(*(_plain(v) for v in values)))
        for test in (
            self.least_price is not None and price() >= F.lit(str(self.least_price)).cast("decimal(14,2)"),
            self.most_price is not None and price() <= F.lit(str(self.most_price)).cast("decimal(14,2)"),
            self.least_discount is not None and F.col("discount") >= self.least_discount,
            self.least_score is not None and F.col("score") >= self.least_score,
            self.vacant_only and ~F.col("occupied"),
            self.without_liens and F.coalesce(F.size("liens"), F.lit(0)) <= 0,
        ):
            if test is not False:
                asked.append(test)
        if self.words.strip():
            body = F.concat_ws(" ", *(F.col(c) for c in BODY if c in columns))
            asked.append(holds_all(comparable(body), _plain(self.words).split()))
        return reduce(lambda a, b: a & b, asked, F.lit(True))


def _plain(text: str) -> str:
    import unicodedata

    low = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    return " ".join(low.split())


def matching(lots: DataFrame, wanted: LotFilter, scores: DataFrame | None = None, events: DataFrame | None = None, as_of: str | None = None) -> DataFrame:
    """The lots that a filter asks for, with score and discount; a lot without a score has neither.

    Events are only semi-joined: a lot qualifies with any event within the days ahead.
    """
    if scores is not None:
        lots = lots.join(scores.select("lot_id", "score", "discount"), "lot_id", "left")
    found = lots.filter(wanted.predicate(lots.columns))
    if wanted.days_ahead is not None and events is not None:
        start = F.lit(as_of).cast("timestamp_ntz")
        soon = events.filter(F.col("at").between(start, start + F.make_dt_interval(days=F.lit(wanted.days_ahead))))
        found = found.join(soon, "lot_id", "left_semi")
    return found


def next_event(events: DataFrame, as_of: str) -> DataFrame:
    """The first event from as_of on, of any kind and status: what the order 'event' sorts by."""
    return events.filter(F.col("at") >= F.lit(as_of).cast("timestamp_ntz")).groupBy("lot_id").agg(F.min("at").alias("next_at"))


def order_keys(lots: DataFrame, order: str) -> list[Column]:
    """Missing scores count as -1, missing or zero discounts as -1, missing or zero prices as 10**12; ties by id."""
    keys = {
        "score": F.coalesce(F.col("score"), F.lit(-1.0)).desc(),
        "discount": F.coalesce(F.nullif(F.col("discount"), F.lit(0)), F.lit(-1)).desc(),
        "event": F.col("next_at").asc_nulls_last() if "next_at" in lots.columns else F.lit(0).asc(),
        "price": F.coalesce(truthy_price(), F.lit(10**12)).asc(),
        "recent": F.col("collected_at").desc(),
    }
    return [keys.get(order, keys["score"]), F.col("lot_id").asc()]


def ordered(lots: DataFrame, order: str) -> DataFrame:
    return lots.orderBy(*order_keys(lots, order))


def page(lots: DataFrame, number: int, size: int) -> DataFrame:
    return lots.offset(max(0, (number - 1) * size)).limit(size)


def counted_pages(lots: DataFrame, size: int) -> DataFrame:
    """(total, pages): at least one page."""
    return lots.agg(F.count(F.lit(1)).alias("total")).select("total", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long").alias("pages"))


def by_ids(lots: DataFrame, ids: Sequence[int]) -> DataFrame:
    """Lots to compare, in the order asked for; two or three of them."""
    if not 2 <= len(ids) <= 3:
        raise ValueError("compare two or three lots")
    wanted = lots.sparkSession.createDataFrame(list(enumerate(ids)), "place int, lot_id long")
    return lots.join(F.broadcast(wanted), "lot_id").orderBy("place")


def ranked(lots: DataFrame, order: str, place: str, path: str) -> DataFrame:
    """The lots with their place in an order, from 1, as one more column. They are stored at path, a folder of their own.

    Lots are dealt by ranges of the order's keys, whose last is the id, and stored with range and number in it, so that
    places stay fixed when an executor is lost. A place is the range's start plus that number: a task holds one range
    or the table of the ranges' sizes, and never all lots.
    """
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = ordered(lots, order).select(*lots.columns, F.spark_partition_id().alias("_range"), within.alias("_n"))
    dealt.write.parquet(path)
    rows = lots.sparkSession.read.schema(dealt.schema).parquet(path)
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    starts = sizes.select("_range", (F.sum("_size").over(Window.orderBy("_range")) - F.col("_size")).alias("_start"))
    return rows.join(F.broadcast(starts), "_range").select(*lots.columns, (F.col("_start") + F.col("_n") + 1).alias(place))
