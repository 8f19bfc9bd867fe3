"""Extractors in isolation, and a model's reports as typed values of all fields."""

import datetime as dt
from decimal import Decimal

from martelo.operators import reading
from martelo.operators.extract import MODEL_FIELDS

LONG = "Edital de leilão judicial: avaliação de R$ 320.000,00, primeira praça em 10/11/2026 às 14:00."


def test_one_failing_extractor_leaves_the_others(spark):
    def fails(text):
        yield "valor", 1, 0.9, "kept by nobody"
        raise ZeroDivisionError("no way")

    group = {
        "amount": lambda text: [("valor", Decimal("320000.00"), 1.7, "R$ 320.000,00"), ("vara", "1ª", -1, "x" * 700)],
        "fails": fails,
        "odd": lambda text: [("valor", object(), 1.0, "")],
        "day": lambda text: [("data", dt.datetime(2026, 11, 10, 17), 0.5, "10/11"), ("ocupado", False, 0.5, "")] if "praça" in text else [],
    }
    df = spark.createDataFrame([(1, LONG, "x"), (2, None, "x"), (3, "short", "x"), (4, LONG.replace("praça", "data"), "x"), (None, LONG, "x")], "doc_id long, text string, error string")
    found = reading.isolated(df, group).collect()
    one = [(r.extractor, r.name, r.number, r.text, r.at, r.flag, r.confidence, r.error) for r in found if r.doc_id == 1]
    none = (None,) * 6
    assert one == [
        ("amount", "valor", Decimal("320000.000"), None, None, None, 1.0, None), ("amount", "vara", None, "1ª", None, None, 0.0, None),
        ("fails", *none, "fails: no way"), ("odd", *none, "odd: a value of type object"),
        ("day", "data", None, None, dt.datetime(2026, 11, 10, 17), None, 0.5, None), ("day", "ocupado", None, None, None, False, 0.5, None),
    ]
    assert {r.doc_id: r.error for r in found if r.extractor is None} == {2: "empty or too short to read", 3: "empty or too short to read"}
    assert [len(r.evidence) for r in found if r.name == "vara"] == [600] * 3 and sum(r.doc_id == 4 for r in found) == 4
    assert not reading.isolated(df.limit(0), group).collect()


def test_all_fields_have_a_kind():
    listed = [f for fields in reading.KINDS.values() for f in fields]
    assert len(listed) == len(set(listed)) == 15 and set(listed) <= set(MODEL_FIELDS) and len(MODEL_FIELDS) == 31


def test_reports_of_all_fields(spark):
    values = {"number": ("R$ 1.234,56", Decimal("1234.560")), "percent": ("5,5% (cinco)", Decimal("5.500")), "at": ("10/11/2026 às 14:00", dt.datetime(2026, 11, 10, 17)), "flag": ("NÃO", False)}
    kind = {f: k for k, fields in reading.KINDS.items() for f in fields}
    rows = [(1, f, values[kind[f]][0] if f in kind else "  some text ", 0.99, "Avaliacao de R$  320.000,00") for f in MODEL_FIELDS]
    docs = spark.createDataFrame([(1, LONG)], "doc_id long, text string")
    found = {r.name: r for r in reading.reported(spark.createDataFrame(rows, "doc_id long, name string, value string, confidence double, quote string"), docs).collect()}
    assert set(found) == set(MODEL_FIELDS)
    for f, r in found.items():
        place = {"percent": "number"}.get(kind.get(f), kind.get(f, "text"))
        wanted = values[kind[f]][1] if f in kind else "some text"
        assert (r[place], r.warning, r.confidence, r.method) == (wanted, None, 0.6, "LLM"), f
        assert sum(r[p] is not None for p in ("number", "text", "at", "flag")) == 1


def test_reports_that_are_not_taken(spark):
    quote = "primeira praça em 10/11/2026 às 14:00. depois outra"  # its first six words are there
    rows = [
        (1, "data_praca_1", "10/11/2026", None, quote), (1, "data_praca_2", "31/02/2026", 0.5, quote), (1, "ocupado", "talvez", 0.5, quote), (1, "ocupado", "Ocupado", 0.3, quote),
        (1, "cor", "azul", 0.5, quote), (1, "vara", "1", 0.5, "320.000,00"), (1, "vara", "1", 0.5, "palavras inventadas"), (1, "vara", "2", 0.5, None), (2, "vara", "1", 0.5, quote), (1, None, "1", 0.5, quote),
        (1, "ano_modelo", "ano 2015/2016", 0.5, quote), (1, "ano_modelo", "-", 0.5, quote), (1, "comarca", None, 0.5, quote),
    ]
    docs = spark.createDataFrame([(1, LONG), (3, LONG)], "doc_id long, text string")
    found = reading.reported(spark.createDataFrame(rows, "doc_id long, name string, value string, confidence double, quote string"), docs).collect()
    told = sorted((r.doc_id, r.name or "", (r.warning or "").partition(": ")[2], str(r.at or r.flag or r.number or "")) for r in found)
    field, kind, unsaid = "no field of the list", "a value of another kind", "the quote is not in the document"
    assert [t for t in told if t[1] not in ("ano_modelo",)] == sorted([
        (1, "", field, ""), (1, "comarca", kind, ""), (1, "cor", field, ""), (1, "data_praca_1", "", "2026-11-10 03:00:00"), (1, "data_praca_2", kind, ""), (1, "ocupado", "", "True"), (1, "ocupado", kind, ""),
        (1, "vara", unsaid, ""), (1, "vara", unsaid, ""), (1, "vara", unsaid, ""), (2, "vara", unsaid, ""),
    ])
    assert (1, "ano_modelo", kind, "") in told
