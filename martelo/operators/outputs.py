"""What leaves the engine: GeoJSON, iCalendar, message texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import LOCAL_HOURS
from ..functions.text import brazilian_money, ics_escaped
from .agenda import SESSIONS
from .alerts import MOST_LOTS

#: iCalendar status by event status, minutes of an event by kind.
ICS_STATUS = {"REMARCADO": "CONFIRMED", "REALIZADO": "CONFIRMED", "SUSPENSO": "TENTATIVE", "CANCELADO": "CANCELLED"}
SESSION_MINUTES, OTHER_MINUTES = 120, 30
#: What an entry says of an estimated date, and of itself.
ESTIMATE = "ATENÇÃO: data estimada, não declarada no edital. Confirme na fonte."
DISCLAIMER = "Informações extraídas automaticamente do edital oficial. Consulte o documento original e um advogado antes de participar do leilão."


def geojson(lots: DataFrame, limit: int = 2000) -> DataFrame:
    """One feature for each lot that has coordinates, by id."""
    point = F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates"))
    told = F.struct("lot_id", "title", "city", "uf", "band")
    rows = lots.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).orderBy("lot_id").limit(limit)
    return rows.select("lot_id", F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), told.alias("properties"))).alias("feature"))


def stamp(c: Column) -> Column:
    return F.date_format(c, "yyyyMMdd'T'HHmmss'Z'")


def folded(line: Column) -> Column:
    """Lines of at most 75 octets, continued after a blank, never inside a letter."""

    @F.pandas_udf("string")
    def fold(lines):
        def one(text: str) -> str:
            parts, size = [[]], 0
            for c in text:
                n = len(c.encode())
                if size + n > (75 if len(parts) == 1 else 74):
                    parts.append([])
                    size = 0
                parts[-1].append(c)
                size += n
            return "\r\n ".join("".join(p) for p in parts)

        return lines.map(lambda t: t if len(t.encode()) <= 75 else one(t))

    return fold(line)


def description(events: DataFrame) -> Column:
    """What an entry says of its lot: title, least bid of the session, appraisal, case, whether the date is an estimate
    or was moved, the disclaimer, and the source. Columns that events lacks, nulls and zero prices say nothing.

    Of estimated, moved_from (the last date before, where it was another), case_number, appraisal, source_url."""
    have = lambda n, kind: (F.col(n) if n in events.columns else F.lit(None)).cast(kind)
    money = lambda n: F.nullif(have(n, "decimal(14,2)"), F.lit(0).cast("decimal(14,2)"))
    say = lambda text, value: F.concat(F.lit(text), value)
    least = F.when(F.col("kind") == "PRACA_SEGUNDA", money("second_min")).otherwise(money("first_min"))
    return F.concat_ws(
        "\n", "title", say("Lance mínimo: R$ ", least.cast("string")), say("Avaliação: R$ ", money("appraisal").cast("string")), say("Processo: ", F.nullif(have("case_number", "string"), F.lit(""))),
        F.when(have("estimated", "boolean"), ESTIMATE), F.concat(F.lit("Remarcado: era "), F.date_format(have("moved_from", "timestamp_ntz"), "dd/MM/yyyy HH:mm"), F.lit(" UTC.")), F.lit(DISCLAIMER), say("Fonte: ", F.nullif(have("source_url", "string"), F.lit(""))),
    )


def ics_event(events: DataFrame, as_of: str, domain: str = "martelo.example", full: bool = False) -> DataFrame:
    """(lot_id, kind, vevent): one iCalendar event each, lines unfolded; events without a date are left out. full: with
    DESCRIPTION, and GEO and URL where events has latitude, longitude and source_url.

    SEQUENCE counts the changes on record, so that calendars update an event instead of adding one.
    """
    status = F.lit("CONFIRMED")
    for own, ics in ICS_STATUS.items():
        status = F.when(F.col("event_status") == own, ics).otherwise(status)
    minutes = F.when(F.col("kind").startswith("PRACA_"), SESSION_MINUTES).otherwise(OTHER_MINUTES)
    alarms = F.array_join(
        F.transform(F.reverse(F.array_sort("reminders")), lambda h: F.concat(F.lit("BEGIN:VALARM\r\nACTION:DISPLAY\r\nTRIGGER:-PT"), h.cast("string"), F.lit("H\r\nDESCRIPTION:"), ics_escaped(F.concat(F.col("title"), F.lit(" em "), h.cast("string"), F.lit("h"))), F.lit("\r\nEND:VALARM"))),
        "\r\n",
    )
    place = F.nullif(F.concat_ws(", ", "address", "district", "city", "uf"), F.lit(""))
    have = lambda n: F.col(n) if n in events.columns else F.lit(None)
    url = F.nullif(have("source_url").cast("string"), F.lit(""))
    said = F.concat(F.lit("DESCRIPTION:"), ics_escaped(description(events)))
    where = F.concat(F.lit("GEO:"), have("latitude").cast("string"), F.lit(";"), have("longitude").cast("string"))
    lines = [
        F.lit("BEGIN:VEVENT"),
        F.concat(F.lit("UID:lote-"), F.col("lot_id").cast("string"), F.lit("-"), F.lower("kind"), F.lit(f"@{domain}")),
        F.concat(F.lit("DTSTAMP:"), stamp(F.lit(as_of).cast("timestamp_ntz"))),
        F.concat(F.lit("DTSTART:"), stamp(F.col("at"))),
        F.concat(F.lit("DURATION:PT"), minutes.cast("string"), F.lit("M")),
        F.concat(F.lit("SEQUENCE:"), F.col("changes").cast("string")),
        F.concat(F.lit("STATUS:"), status),
        F.concat(F.lit("SUMMARY:"), ics_escaped(F.col("title"))),
        *([said] if full else []),
        F.when(place.isNotNull(), F.concat(F.lit("LOCATION:"), ics_escaped(place))),
        *([where, F.when(url.isNotNull(), F.concat(F.lit("URL:"), ics_escaped(url)))] if full else []),
        F.concat(F.lit("CATEGORIES:"), ics_escaped(F.col("asset"))),
        F.nullif(alarms, F.lit("")),
        F.lit("END:VEVENT"),
    ]
    return events.filter(F.col("at").isNotNull()).select("lot_id", "kind", F.concat_ws("\r\n", *lines).alias("vevent"))


def calendar_text(events: DataFrame, name: str) -> DataFrame:
    """One calendar from events (calendar_id, at, vevent): for one user's or one lot's events, folded."""
    head = f"BEGIN:VCALENDAR\r\nVERSION:2.0\r\nPRODID:-//martelo//calendar//PT\r\nCALSCALE:GREGORIAN\r\nMETHOD:PUBLISH\r\nX-WR-CALNAME:{name}"
    lines = events.select("calendar_id", "at", F.posexplode(F.split("vevent", "\r\n")).alias("n", "line"), "vevent").withColumn("line", folded(F.col("line")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "vevent", "n", "line"))), lambda x: x["line"]), "\r\n")
    return lines.groupBy("calendar_id").agg(F.concat(F.lit(head + "\r\n"), body, F.lit("\r\nEND:VCALENDAR\r\n")).alias("ics"))


def digest_line(title: Column, city: Column, minimum: Column, discount: Column) -> Column:
    """One lot in a message's plain text."""
    cut = F.when(discount > 0, F.concat(F.lit(" ("), F.translate(discount.cast("string"), ".", ","), F.lit("% abaixo)"))).otherwise("")
    return F.concat(F.lit("- "), title, F.lit(" — "), F.coalesce(city, F.lit("local não informado")), F.lit(": "), brazilian_money(minimum), cut)


def html_escaped(c: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def said_session(at: Column) -> Column:
    """A session's local day and time in words."""
    return F.coalesce(F.date_format(at - F.expr(f"INTERVAL {LOCAL_HOURS} HOURS"), "dd/MM/yyyy 'às' HH'h'mm"), F.lit("sem data de praça"))


def digests(alerts: DataFrame, matches: DataFrame, lots: DataFrame, events: DataFrame, base_url: str, analyses: DataFrame | None = None, scores: DataFrame | None = None, most: int = MOST_LOTS) -> DataFrame:
    """(alert_id, n, body, html): the message of each alert that has matches (alert_id, lot_id, place), its lots in
    their order, as plain text and as HTML. place is a lot's rank in its alert, from 1 (see alerts.new_matches); a
    message tells of the first `most`, which bounds its size, and n counts those.

    alerts: alert_id, name. lots: lot_id, title, district, city, uf, first_min, second_min, appraisal. events: a lot's
    earliest session is told, never a deadline. analyses: a lot's best one (discount, source); scores: score, band.
    Nulls and zero prices are told as unknown; texts are escaped in HTML. Matches of unknown lots go.
    """
    first = events.filter(F.col("kind").isin(*SESSIONS)).groupBy("lot_id").agg(F.min("at").alias("_at"))
    rows = matches.filter(F.col("place") <= most).select("alert_id", "lot_id", "place").join(lots, "lot_id").join(first, "lot_id", "left")
    none = lambda kind: F.lit(None).cast(kind)
    if analyses is not None:
        rows = rows.join(analyses.select("lot_id", F.col("discount").alias("_discount"), F.col("source").alias("_source")), "lot_id", "left")
    else:
        rows = rows.withColumns({"_discount": none("decimal(12,2)"), "_source": none("string")})
    if scores is not None:
        rows = rows.join(scores.select("lot_id", F.col("score").alias("_score"), F.col("band").alias("_band")), "lot_id", "left")
    else:
        rows = rows.withColumns({"_score": none("double"), "_band": none("string")})
    title = F.coalesce("title", F.lit("(sem título)"))
    filled = [F.nullif(F.col(c), F.lit("")) for c in ("district", "city", "uf")]
    place = F.coalesce(F.nullif(F.concat_ws(", ", *filled), F.lit("")), F.lit("local não informado"))
    zero = F.lit(0).cast("decimal(14,2)")
    least = brazilian_money(F.coalesce(F.nullif("second_min", zero), F.nullif("first_min", zero)))
    appraisal, session = brazilian_money(F.nullif("appraisal", zero)), said_session(F.col("_at"))
    link = F.concat(F.lit(f"{base_url}/lote/"), F.col("lot_id").cast("string"))
    below = F.when(F.col("_discount") > 0, F.concat(F.col("_discount").cast("string"), F.lit("% abaixo da referência de "), F.col("_source"))).otherwise("sem desconto estimado")
    points = F.coalesce(F.concat(F.lit(" · "), F.bround("_score", 0).cast("int").cast("string"), F.lit("/100")), F.lit(""))
    band = F.concat(F.lit("Oportunidade "), F.initcap(F.lower(F.coalesce("_band", F.lit("INDEFINIDA")))), points)
    text = F.concat_ws("\n", F.concat(F.lit("- "), title), F.concat(F.lit("  "), place), F.concat(F.lit("  Lance mínimo: "), least, F.lit(" | Avaliação: "), appraisal), F.concat(F.lit("  Próxima praça: "), session), F.concat(F.lit("  "), link), F.lit(""))
    item = F.concat(
        F.lit("<li><a href=\""), html_escaped(link), F.lit("\">"), html_escaped(title), F.lit("</a><p>"), html_escaped(place), F.lit("</p><p>Lance mínimo: <b>"), least, F.lit("</b> · Avaliação: "), appraisal,
        F.lit("</p><p>"), html_escaped(below), F.lit("</p><p>Próxima praça: "), session, F.lit("</p><p>"), html_escaped(band), F.lit("</p></li>"),
    )
    told = rows.groupBy("alert_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("place", "lot_id", text.alias("text"), item.alias("item")))).alias("_lots"))
    name, n = F.coalesce("name", F.lit("")), F.col("n").cast("string")
    manage = f"{base_url}/alertas"
    body = F.concat_ws("\n", F.concat(n, F.lit(" novo(s) lote(s) para o alerta \""), name, F.lit("\"")), F.lit(""), F.array_join(F.transform("_lots", lambda x: x["text"]), "\n"), F.lit(DISCLAIMER), F.lit(""), F.lit(f"Gerenciar alertas: {manage}"))
    heading = F.concat(n, F.when(F.col("n") == 1, " novo lote").otherwise(" novos lotes"), F.lit(" para “"), html_escaped(name), F.lit("”"))
    page = F.concat(
        F.lit("<!doctype html><html lang=\"pt-br\"><meta charset=\"utf-8\"><body><h1>"), heading, F.lit("</h1><ul>"), F.array_join(F.transform("_lots", lambda x: x["item"]), ""), F.lit(f"</ul><p>{DISCLAIMER}</p><p>Você recebe esta mensagem porque salvou o filtro “"),
        html_escaped(name), F.lit("”. <a href=\""), html_escaped(F.lit(manage)), F.lit("\">Gerenciar alertas</a></p></body></html>"),
    )
    return told.join(alerts.select("alert_id", "name"), "alert_id").select("alert_id", "n", body.alias("body"), page.alias("html"))
