"""Calendar entries in full, and a calendar's text with its folded lines."""

from pyspark.sql import functions as F

from martelo.operators import outputs

SCHEMA = "lot_id int, kind string, at timestamp_ntz, event_status string, title string, address string, district string, city string, uf string, asset string, changes int, reminders array<int>, estimated boolean, first_min decimal(14,2), second_min decimal(14,2), latitude double, longitude double, source_url string"


def made(spark):
    import datetime as dt

    at = dt.datetime(2026, 11, 10, 17)
    rows = [
        (1, "PRACA_SEGUNDA", at, "CONFIRMADO", "Casa; 3 quartos, " + "ótima " * 20, None, "Centro", "Maceió", "AL", "IMOVEL", 2, [24, 72], False, 100, 60, -9.5, -35.75, "http://x/1,2"),
        (2, "PRAZO_HABILITACAO", at, "SUSPENSO", "Carro", None, None, None, None, "VEICULO", 0, [], True, 0, None, None, 1.0, None),
        (3, "PRACA_UNICA", None, "CONFIRMADO", "Sem data", None, None, None, None, "OUTRO", 0, None, None, None, None, None, None, None),
    ]
    from decimal import Decimal

    rows = [tuple(Decimal(v) if n in (13, 14) and v is not None else v for n, v in enumerate(r)) for r in rows]
    return outputs.ics_event(spark.createDataFrame(rows, SCHEMA), "2026-10-01 12:00:00", full=True)


def test_entries_in_full(spark):
    found = {r.lot_id: r.vevent.split("\r\n") for r in made(spark).collect()}
    assert set(found) == {1, 2}
    one = dict(line.split(":", 1) for line in found[1] if not line.startswith(("BEGIN", "END")) and line != "ACTION:DISPLAY" and "VALARM" not in line)
    assert one["GEO"] == "-9.5;-35.75" and one["URL"] == "http://x/1\\,2" and one["LOCATION"] == "Centro\\, Maceió\\, AL"
    described = next(line for line in found[1] if line.startswith("DESCRIPTION:Casa"))
    assert "\\nLance mínimo: R$ 60.00\\n" in described and described.endswith("\\nFonte: http://x/1\\,2") and "estimada" not in described
    two = found[2]
    assert not any(line.startswith(("GEO", "URL", "LOCATION")) for line in two)
    text = next(line for line in two if line.startswith("DESCRIPTION:"))
    assert text == "DESCRIPTION:Carro\\n" + outputs.ESTIMATE.replace(",", "\\,") + "\\n" + outputs.DISCLAIMER.replace(",", "\\,")


def test_calendar_text_is_folded(spark):
    events = made(spark).select(F.lit("mine").alias("calendar_id"), F.lit("2026-11-10").cast("timestamp_ntz").alias("at"), "vevent")
    (text,) = [r.ics for r in outputs.calendar_text(events, "Lotes").collect()]
    lines = text.split("\r\n")
    assert lines[0] == "BEGIN:VCALENDAR" and lines[-2:] == ["END:VCALENDAR", ""] and text.count("BEGIN:VEVENT") == 2
    assert max(len(line.encode()) for line in lines) <= 75 and any(line.startswith(" ") for line in lines)
    whole = text.replace("\r\n ", "")
    assert all(line in whole.split("\r\n") for r in made(spark).collect() for line in r.vevent.split("\r\n"))
