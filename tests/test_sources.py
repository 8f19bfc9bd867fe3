"""Landed files, pages and documents, on small fixtures."""

import pytest
from pyspark.sql import functions as F

from martelo.functions import parse, present, text
from martelo.schemas import validate
from martelo.sources import documents, files, html, profiles, registry


def write(path, body):
    path.write_text(body, encoding="utf-8")
    return f"file://{path}"


def test_vehicle_table_and_upsert(spark, tmp_path):
    head = "# a mirror\ncodigo_fipe,marca,modelo,ano_modelo,combustivel,valor,mes_referencia,demonstracao\n"
    path = write(tmp_path / "f.csv", head + "1,fiat,Uno,2010,G,100.00,2026-01,sim\n1,fiat,Uno,2010,G,110.00,2026-01,nao\n2,vw,Gol,2011,G,200.00,2026-01,\n")
    rows = files.vehicle_table(spark, path)
    got = {r["ref_id"]: r for r in rows.collect()}
    assert got["1"]["brand"] == "FIAT" and float(got["1"]["value"]) == 110 and not got["1"]["demo"] and len(got) == 2
    stored = rows.filter("ref_id = '1'").withColumn("model", F.lit("kept")).withColumn("value", F.lit(1).cast("decimal(14,2)"))
    keys, updates = ("ref_id", "year", "month"), ("value", "demo")
    once = files.upserted(stored, rows, keys, updates)
    assert {(r["ref_id"], r["model"], float(r["value"])) for r in once.collect()} == {("1", "kept", 110.0), ("2", "Gol", 200.0)}
    assert sorted(map(str, files.upserted(once, rows, keys, updates).collect())) == sorted(map(str, once.collect()))


def test_price_index_with_null_districts(spark, tmp_path):
    path = write(tmp_path / "z.csv", "uf,cidade,bairro,valor_m2_venda,mes_referencia,observacao\nal,Maceió,,5000.00,2026-01,a\nal,Maceió,Centro,6000.00,2026-01,b\n")
    rows = files.price_index(spark, path)
    again = files.upserted(rows, rows.withColumn("value_m2", F.lit(7).cast("decimal(14,2)")).withColumn("note", F.lit("new")), ("uf", "city", "district", "month"), ("value_m2",))
    assert {(r["uf"], r["district"], float(r["value_m2"]), r["note"]) for r in again.collect()} == {("AL", None, 7.0, "a"), ("AL", "Centro", 7.0, "b")}


def test_centroids_and_geocoding(spark, tmp_path):
    path = write(tmp_path / "c.csv", "uf,cidade,latitude,longitude\nAL,Maceió,-9.6,-35.7\n")
    lots = spark.createDataFrame([(1, "AL", "MACEIO"), (2, "AL", "Outra"), (3, None, None)], "lot_id long, uf string, city string")
    assert {r["lot_id"]: r["latitude"] for r in files.geocoded(lots, files.centroids(spark, path)).collect()} == {1: -9.6, 2: None, 3: None}


def test_archive_and_its_retention(spark, tmp_path):
    raw = spark.createDataFrame([("a", "2026-01-01", "u", "b"), ("a", "2026-03-01", "u", "b")], "source string, day string, url string, body string")
    files.archive(raw, f"file://{tmp_path}/raw")
    old = files.expired_days(spark, f"file://{tmp_path}/raw", "2026-03-10")
    assert [str(r["day"]) for r in old.collect()] == ["2026-01-01"]


def test_robots(spark):
    rows = spark.createDataFrame([(200, True), (200, False), (200, None), (404, True), (500, False), (None, None)], "s int, d boolean")
    assert [r[0] for r in rows.select(files.robots_allows(F.col("s"), F.col("d"))).collect()] == [False, True, True, True, False, False]


def test_registry(spark):
    own = registry.Registry()
    own.add("b", "LEILOEIRO", "AL", True, "https://x")
    own.add("a", "DIARIO_OFICIAL")
    with pytest.raises(ValueError):
        own.add("a", "X")
    with pytest.raises(KeyError):
        own.get("c")
    rows = own.frame(spark)
    assert [r["slug"] for r in registry.listed(rows, uf="PE").collect()] == ["a"] and own.get("b")[0] == "b"
    assert [r["slug"] for r in registry.listed(rows, kind="LEILOEIRO").collect()] == ["b"]
    people = spark.createDataFrame([(1, "https://www.known.com/x"), (2, "https://new.com"), (3, None)], "auctioneer_id long, site string")
    assert [r["auctioneer_id"] for r in registry.profiles_to_suggest(people, ["known.com"]).collect()] == [2]


def test_deep_pages():
    deep = "<div>" * 4000 + "<a href='/x'>y</a>" + "</div>" * 4000
    assert html.links_of(deep) == [("/x", "y")] and html.cards_of(deep) == []


@pytest.mark.parametrize(
    ("selector", "found"),
    [("article.lote h2", ["one", "two"]), ("[class*=ot] .n", ["1", "2"]), ("a[href$='.pdf']", ["doc"]), ("#main a, h2", ["one", "doc", "two"]), ("h3", []), ("article[data-x=2] h2", ["two"])],
)
def test_selectors(selector, found):
    page = "<div id='main'><article class='lote big'><h2>one</h2><p class='n'>1</p><a href='a.pdf'>doc</a></article><article class='lote' data-x='2'><h2>two</h2><p class='n'>2</p></article></div>"
    assert [n.words() for n in profiles.select(html.Tree(page).root, selector)] == found


def test_profiles_from_yaml(tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "p.yaml"
    path.write_text("perfis:\n  - &base\n    slug: a\n    campos: {titulo: h2}\n  - <<: *base\n    slug: b\n")
    assert [(p["slug"], p["campos"]["titulo"]) for p in profiles.read_profiles(str(path))] == [("a", "h2"), ("b", "h2")]


def test_fields_of_a_block():
    root = html.Tree("<div><b class='v'>R$ 10,00 ou R$ 20,00</b><i>lote 7</i></div>").root
    assert profiles.raw_value(root, root.words(), profiles.Field(selector=".v", pattern=r"R\$\s*([\d,]+)"), "") == "10,00"
    assert profiles.raw_value(root, root.words(), profiles.Field(pattern=r"R\$\s*([\d,]+)", several=True), "") == ["10,00", "20,00"]
    assert profiles.raw_value(root, root.words(), profiles.Field(selector=".none", otherwise="x"), "") == "x"
    with pytest.raises(ValueError):
        list(profiles.select(root, "a > b"))


def test_read_documents(spark):
    body = "EDITAL DE LEILÃO. CPF 123.456.789-09. Avaliado em R$ 320.000,00. Comissão do leiloeiro de 5%. Imóvel desocupado nesta data."
    lots = spark.createDataFrame([(1, None, None), (2, None, True)], "lot_id long, appraisal decimal(14,2), occupied boolean")
    docs = spark.createDataFrame([(1, body), (2, "curto")], "lot_id long, text string")
    held = spark.createDataFrame([(1, "ocupado", 0.9, "MANUAL", "true"), (1, "valor_avaliacao", 0.99, "REGRA", "5")], "lot_id long, name string, confidence double, method string, value string")
    made = documents.read_documents(lots, docs, held)
    findings = {(r["lot_id"], r["name"]): (r["method"], r["value"]) for r in made["findings"].collect()}
    assert findings[1, "ocupado"] == ("MANUAL", "true") and findings[1, "valor_avaliacao"] == ("REGRA", "320000.000")
    assert {r["lot_id"]: (r["appraisal"] and float(r["appraisal"]), r["occupied"]) for r in made["lots"].collect()} == {1: (320000.0, True), 2: (None, True)}


def test_small_columns(spark):
    one = spark.createDataFrame([("Comarca de São Luís, 2ª Vara", ["https://www.tjal.jus.br/a", "https://ok.com"], "2026-09", "em_analise", "Arrematado em 2025", "a-\nb 1 , 50")], "c string, h array<string>, m string, u string, s string, p string")
    r = one.select(text.comarca_label(F.col("c")).alias("c"), text.first_site(F.col("h")).alias("h"), parse.month_start(F.col("m")).cast("string").alias("m"), text.humanised(F.col("u")).alias("u"), present.lot_status(F.col("s")).alias("s"), text.repaired_pdf(F.col("p")).alias("p"), present.register_status(F.lit("Inativa")).alias("r")).first()
    assert (r["c"], r["h"], r["m"], r["u"], r["s"], r["p"], r["r"]) == ("São Luís", "https://ok.com", "2026-09-01", "em analise", "ARREMATADO", "ab 1,50", "INATIVO")
    with pytest.raises(ValueError, match="lot_id"):
        validate(one, "alerts_sent")


def test_headers_that_differ_by_accents_join(spark):
    page = "<table><tr><th>Nome</th><th>Matrícula</th><th>Matricula</th><th>Situação</th></tr><tr><td>Ana <a href='/a'>x</a></td><td>12</td><td>AL</td><td>ativa</td></tr></table>"
    found = html.known_tables(spark.createDataFrame([(1, page)], "page_id int, html string"), html.REGISTER_HEADERS, 2).collect()
    assert [r.cells for r in found] == [{"nome": "Ana x", "nome__href": "/a", "matricula": "12 AL", "situacao": "ativa"}]


def test_page_trees(spark):
    page = "<a href=' #x'>s</a><a href='javascript:f()'>j</a><a href='b.pdf?v=1'>B</a><a href='/p/b.pdf?v=1'>again</a><a href='http://[bad'>bad</a><a href='MAILTO:a@b.c'>m</a><a name='n'>n</a>"
    assert html.page_links_of(page, "https://h.invalid/p/q") == [("https://h.invalid/p/b.pdf?v=1", "B"), ("http://[bad", "bad")]
    assert html.page_links_of(page, None) == [("b.pdf?v=1", "B"), ("/p/b.pdf?v=1", "again"), ("http://[bad", "bad")] and html.page_links_of(None, "https://h.invalid/") == []
    # a page's cards stand under several parents, their classes in any order; equal groups differ by text
    spread = "<section><div class='lot big'>a</div></section><section><div class='big lot'>b</div><p><div class='lot big'>c</div></p></section><ul><li class='m'>1</li><li class='m'>2</li></ul>"
    assert html.cards_of(spread) == ["a", "b", "c"]
    tie = "".join(f"<li class='m'>{i}</li>" for i in range(3)) + "".join(f"<div class='c'>card {i}<script>{'x' * 99}</script></div>" for i in range(3))
    assert html.cards_of(tie) == ["card 0", "card 1", "card 2"] and html.cards_of(tie.replace("card", "")) == ["0", "1", "2"]
    assert html.cards_of("<span class='c'>1</span>" * 5) == html.cards_of("") == html.cards_of(None) == []
    nested = "<table><tr><td>Nome</td><td><table><tr><th>Vara</th></tr><tr><td>2ª</td></tr></table></td></tr><tr><td>Ana</td></tr></table>"
    assert html.table_rows_of(nested) == [{"nome": "Ana"}, {"vara": "2ª"}] and html.table_rows_of("<table></table>") == []
    odd = spark.createDataFrame([(1, None, None), (2, "", "u")], "page_id int, html string, url string")
    assert html.page_links(odd).count() == html.tables(odd, url="url").count() == html.cards(odd).count() == 0


def test_decomposition_of_the_whole_plane(spark):
    import unicodedata

    every = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(every[i : i + 97]) for i in range(0, len(every), 97)] + every[::7] + ["", "n\u0303ao", "\U0001d400x", "\ufb01\ufb01\u0301a"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, t string").repartition(4)
    found = rows.select("i", text.decomposed_column(text.F.col("t")).alias("d"), text.comparable(text.F.col("t")).alias("c")).collect()
    full = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    for i, d, c in found:
        if i < 0:
            assert d.plain is None and c == ""
            continue
        assert d.plain == full(texts[i])
        starts = range(len(texts[i])) if d.starts is None else d.starts
        assert len(starts) == len(d.plain) and all(d.plain[p] in full(texts[i][s]) for p, s in enumerate(starts))
    assert {texts[i]: c for i, _, c in found if i >= 0}["n\u0303ao"] == "nao"


def test_listing_pages_are_spread(spark):
    from martelo.plans import catalogue

    pages = catalogue._listing(spark, "/root/testdata/sf0.001")
    assert pages.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
