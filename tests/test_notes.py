"""Messages, warnings, merged auctioneers and words of listings on odd rows."""

from pyspark.sql import functions as F

from martelo.functions import parse, present
from martelo.operators import identity, market, outputs, terms

AS_OF = "2026-06-01 12:00:00"
LOTS = "lot_id long, title string, district string, city string, uf string, first_min decimal(14,2), second_min decimal(14,2), appraisal decimal(14,2)"


def test_digest_of_odd_lots(spark):
    lots = spark.createDataFrame([(1, None, None, "", None, None, None, None), (2, "<b>\n& 'x'", None, "Maceió", "AL", None, None, None)], LOTS)
    events = spark.createDataFrame([(2, "PRAZO_HABILITACAO", "2026-01-01 10:00:00"), (2, "PRACA_SEGUNDA", "2026-02-02 01:05:00"), (2, "PRACA_PRIMEIRA", None)], "lot_id long, kind string, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    alerts = spark.createDataFrame([(7, None), (8, "none sent")], "alert_id long, name string")
    matches = spark.createDataFrame([(7, 2, 1), (7, 1, 2), (7, 99, 3), (9, 1, 1)], "alert_id long, lot_id long, place int")
    (row,) = outputs.digests(alerts, matches, lots, events, "https://m.invalid").collect()
    assert (row.alert_id, row.n) == (7, 2)
    assert row.body.splitlines()[2:7] == ["- <b>", "& 'x'", "  Maceió, AL", "  Lance mínimo: não informado | Avaliação: não informado", "  Próxima praça: 01/02/2026 às 22h05"]
    assert "- (sem título)\n  local não informado\n" in row.body and "sem data de praça" in row.body
    assert "<li><a href=\"https://m.invalid/lote/2\">&lt;b&gt;\n&amp; &#x27;x&#x27;</a><p>Maceió, AL</p>" in row.html and row.html.count("<li>") == 2 and "Oportunidade Indefinida</p>" in row.html
    assert outputs.digests(alerts, matches.limit(0), lots, events, "x").count() == 0


def test_warnings_of_odd_analyses(spark):
    lots = spark.createDataFrame([(1, "IMOVEL", "Jatiúca", "Maceió", None, "10.00", "0.00", None, "60.00", "5.00", "BAIRRO", True, "20.00", None), (2, "IMOVEL", None, None, None, "10.00", None, "50.00", None, "5.00", "CIDADE", None, None, True)], "lot_id long, asset string, district string, city string, uf string, minimum string, appraisal string, private_area string, total_area string, value_m2 string, precision string, demo boolean, other string, passed boolean")
    lots = lots.withColumns({c: F.col(c).cast("decimal(12,2)") for c in ("minimum", "appraisal", "private_area", "total_area", "value_m2")})
    found = {r.lot_id: r for r in market.index_analysis(lots).collect()}
    assert found[1].warnings == [market.DEMO_INDEX, market.ASKED_PRICES, market.TOTAL_AREA] and float(found[1].confidence) == 0.28
    assert found[1].method == "60.00 m² × R$ 5.00/m² (FipeZap, Jatiúca, Maceió, precisão bairro) = R$ 300.00. Comparado ao lance mínimo."
    assert found[2].warnings == [market.ASKED_PRICES] and found[2].method is not None
    told = market.appraisal_analysis(lots.withColumn("appraisal", F.lit("40.00").cast("decimal(12,2)"))).collect()
    assert [len(r.warnings) for r in sorted(told)] == [1, 2] and all("(10.00)" in r.method and "(40.00)" in r.method for r in told)
    best = market.best_analysis(market.index_analysis(lots).unionByName(market.appraisal_analysis(lots))).collect()
    assert {r.lot_id: r.warnings[0] for r in best} == {1: market.DEMO_INDEX, 2: market.ASKED_PRICES}


OLD = "auctioneer_id long, name string, register string, licence string, uf string, status string, districts array<string>, credentials map<string,boolean>, site string, email string, phone string, checked_at timestamp_ntz"
NEW = "sequence int, name string, register string, licence string, uf string, status string, districts array<string>, source string, site string, email string, phone string"


def test_merged_auctioneers(spark):
    old = spark.createDataFrame([(5, "Ana Lima", "JUCEAL", "7", "AL", "ATIVO", None, None, "", None, "1", None), (6, "Rui", None, None, "SE", None, ["a"], {"TJAL": True}, None, None, None, None)], OLD)
    new = spark.createDataFrame(
        [
            (1, "ANA  LÍMA", None, None, "AL", None, ["x", "x"], "jucea", "s1", None, "2"),
            (2, "other name", "JUCEAL", "7", "AL", "SUSPENSO", None, "tjal", "s2", "e", None),
            (3, "Zé", None, None, "SE", None, None, "tjse-a", None, None, None),
            (4, "Bia", "JUCESE", "1", "SE", "ATIVO", ["b"], "tjse-a", None, None, None),
            (5, "bia", "JUCESE", None, "SE", "DESCONHECIDO", ["c", "b"], "tjpe-b", "s", None, None),
            (6, None, None, None, None, None, None, None, None, None, None),
        ],
        NEW,
    )
    found = {r.auctioneer_id: r for r in identity.merge_auctioneers(old, new, AS_OF).collect()}
    assert sorted(found) == [5, 6, 7, 8]
    ana, rui, bia, ze = (found[i] for i in (5, 6, 7, 8))
    assert (ana.name, ana.site, ana.email, ana.phone, ana.status, ana.districts, ana.credentials, ana.created) == ("Ana Lima", "s1", "e", "1", "SUSPENSO", ["x"], {"TJAL": True}, False)
    assert (rui.credentials, rui.districts, rui.checked_at) == ({"TJAL": True}, ["a"], None) and str(ana.checked_at) == AS_OF
    assert (bia.name, bia.licence, bia.status, bia.districts, bia.credentials, bia.site, bia.created) == ("Bia", "1", "ATIVO", ["b", "c"], {"TJPE": True}, "s", True)
    assert (ze.name, ze.status, ze.districts, ze.credentials) == ("Zé", "DESCONHECIDO", [], {})
    first = identity.merge_auctioneers(old.limit(0), new, AS_OF).collect()
    assert sorted((r.auctioneer_id, r.name) for r in first) == [(1, "ANA  LÍMA"), (2, "Bia"), (3, "other name"), (4, "Zé")]
    assert identity.merge_auctioneers(old, new.limit(0), AS_OF).filter("not created").count() == 2


def test_words_of_odd_listings(spark):
    rows = spark.createDataFrame([(None, None, None), ("", "", ""), ("moto e casa", "TRF5", "al"), ("CAMINHÃO", "TJSE", "AL"), ("x", "TRF3", "SE")], "t string, c string, u string")
    found = rows.select(terms.asset_vote(F.col("t")), present.lot_status(F.col("t")), parse.sphere(F.col("c")), parse.place_is_valid(F.col("u"), F.col("c")), parse.states_of_court(F.col("c"))).collect()
    assert [tuple(r) for r in found] == [
        ("OUTRO", "ABERTO", "DESCONHECIDA", False, []),
        ("OUTRO", "ABERTO", "DESCONHECIDA", False, []),
        ("IMOVEL", "ABERTO", "FEDERAL", True, ["AL", "PE", "SE"]),
        ("VEICULO", "ABERTO", "ESTADUAL", False, ["SE"]),
        ("OUTRO", "ABERTO", "DESCONHECIDA", True, []),
    ]
