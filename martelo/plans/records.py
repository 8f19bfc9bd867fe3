"""Queries of what surrounds a lot: normal forms, dimensions, publications, screens and runs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse
from ..operators import agenda, cycle, events, identity, metrics, normalise, publications, terms, views
from ..sources import keyed
from .lots import AS_OF, lots, sessions
from .registered import query, read

# ---- normal forms ----


def _raw(spark, sf_dir):
    """Raw lots: cases with right and wrong check digits, sessions with and without shares, things to redact."""
    k = F.col("lot_id")
    number = parse.written_case((k % 10_000_000).cast("string"), F.year("collected_at").cast("string"), F.lit("8"), F.when(k % 3 == 0, "02").when(k % 3 == 1, "25").otherwise("17"), F.lit("1"))
    wrong = F.concat(F.substring(number, 1, 8), F.lpad(((F.substring(number, 9, 2).cast("int") + 1) % 100).cast("string"), 2, "0"), F.substring(number, 11, 15))
    session = lambda n, share, least: F.struct(F.lit(n).alias("ordinal"), F.lit(None).cast("timestamp_ntz").alias("at"), share.cast("decimal(5,2)").alias("share"), least.cast("decimal(14,2)").alias("minimum"))
    none = F.lit(None)
    return lots(spark, sf_dir).select(
        "lot_id", F.lit("fonte").alias("source"), F.concat(F.lit("Apartamento "), "title").alias("title"), F.concat(F.lit("  CPF 123.456.789-09   de "), F.col("city")).alias("description"), F.lit(None).cast("string").alias("address"), "district",
        F.when(k % 2 == 0, F.col("city")).alias("city"), F.concat(F.lit(" Comarca "), F.col("city")).alias("comarca"), F.lit(None).cast("string").alias("uf"), F.lit(None).cast("string").alias("court"),
        F.when(k % 5 == 0, wrong).when(k % 5 != 4, number).alias("case_number"), F.when(k % 2 == 0, "LOTE 7").alias("lot_number"), F.lit("IMOVEL").alias("asset"), F.col("appraisal"),
        F.when(k % 3 == 0, "abc-1d23").when(k % 3 == 1, "nada").alias("plate"),
        F.array(session(1, none, none), session(2, F.when(k % 4 == 0, F.lit("60.00")), F.when(k % 4 == 1, F.col("first_min")))).alias("sessions"),
    )


@query("""SELECT lot_id, CASE WHEN lot_id % 5 = 4 THEN NULL ELSE lot_id % 5 <> 0 END AS valid, CASE WHEN lot_id % 5 IN (0, 4) THEN NULL WHEN lot_id % 3 = 0 THEN 'AL' WHEN lot_id % 3 = 1 THEN 'SE' ELSE 'PE' END AS uf,
CASE WHEN lot_id % 5 IN (0, 4) THEN 'DESCONHECIDA' ELSE 'ESTADUAL' END AS sphere, CASE WHEN lot_id % 5 IN (0, 4) THEN 'fonte' WHEN lot_id % 3 = 0 THEN 'TJAL' WHEN lot_id % 3 = 1 THEN 'TJSE' ELSE 'TJPE' END || CASE WHEN lot_id % 5 NOT IN (0, 4) THEN CASE WHEN lot_id % 2 = 0 THEN '|lote 7' ELSE '|unico' END ELSE '' END AS key_ends,
'CPF [CPF removido] de ' || city AS description, CASE WHEN lot_id % 2 = 0 THEN city ELSE 'Comarca ' || city END AS city, CASE WHEN lot_id % 3 = 0 THEN 'ABC1**3' END AS plate, CAST(appraisal AS DOUBLE) AS first_min,
CASE lot_id % 4 WHEN 0 THEN (c // 100 + CASE WHEN c % 100 > 50 OR c % 100 = 50 AND c // 100 % 2 = 1 THEN 1 ELSE 0 END)::DOUBLE / 100 WHEN 1 THEN CAST(first_min AS DOUBLE) END AS second_min,
CASE WHEN lot_id % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN lot_id % 3 = 1 THEN 1 ELSE 0 END + CASE WHEN lot_id % 4 = 0 THEN 1 ELSE 0 END AS warnings, 'IMOVEL' AS nature, 'URBANA' AS zone
FROM (SELECT *, CAST(appraisal * 100 AS BIGINT) * 60 AS c FROM lots)""", with_lots=True)
def normalised_lots(spark, sf_dir):
    """Raw lots in their normal form."""
    found = normalise.normalised(_raw(spark, sf_dir))
    key = F.split("natural_key", r"\|")
    ends = F.when(F.col("case_valid"), F.concat_ws("|", key[0], key[2])).otherwise(key[0])
    return found.select("lot_id", F.when(F.col("case_number").isNotNull(), F.col("case_valid")).alias("valid"), "uf", "sphere", ends.alias("key_ends"), "description", "city", "plate", F.col("first_min").cast("double").alias("first_min"), F.col("second_min").cast("double").alias("second_min"), F.size("warnings").alias("warnings"), "nature", "zone")


def _dimensions(spark, sf_dir):
    own = lots(spark, sf_dir)
    rows = own.select("lot_id", F.col("uf").alias("court"), F.when(F.col("lot_id") % 10 != 0, F.col("city")).alias("comarca"), (F.col("lot_id") % 4 != 0).alias("case_valid"), F.concat(F.lit("C"), (F.col("lot_id") % 1000).cast("string")).alias("case_number"), F.concat(F.lit("  Leiloeiro  "), F.col("auctioneer_id").cast("string")).alias("auctioneer_name"))
    courts = read(spark, sf_dir, "region").filter("r_regionkey < 3").select(F.col("r_regionkey").cast("long").alias("court_id"), F.col("r_name").alias("court"))
    empty = lambda schema: spark.createDataFrame([], schema)
    known = read(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("auctioneer_id"), F.concat(F.lit("leiloeiro "), F.col("s_suppkey").cast("string")).alias("name_key"))
    return normalise.dimensions(rows, courts, empty("district_id long, court_id long, district_slug string"), empty("case_id long, valid_case string"), known)


@query("""SELECT 'courts' AS dimension, (SELECT count(DISTINCT uf) FROM lots WHERE uf NOT IN (SELECT r_name FROM region WHERE r_regionkey < 3)) AS made
UNION ALL SELECT 'districts', (SELECT count(DISTINCT (uf, city)) FROM lots WHERE lot_id % 10 <> 0) UNION ALL SELECT 'cases', (SELECT count(DISTINCT lot_id % 1000) FROM lots WHERE lot_id % 4 <> 0)
UNION ALL SELECT 'auctioneers', (SELECT count(DISTINCT auctioneer_id) FROM lots WHERE auctioneer_id % 2 = 1)""", with_lots=True)
def new_dimension_rows(spark, sf_dir):
    """How many courts, districts, cases and auctioneers the lots make."""
    found = _dimensions(spark, sf_dir)
    counts = [found[name].agg(F.lit(name).alias("dimension"), F.count(F.lit(1)).alias("made")) for name in ("courts", "districts", "cases", "auctioneers")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@query("""SELECT lot_id, CASE WHEN auctioneer_id % 2 = 0 THEN auctioneer_id END AS auctioneer_id, r.r_regionkey::BIGINT AS court_id, lot_id % 4 <> 0 AS has_case, lot_id % 10 <> 0 AS has_district FROM lots LEFT JOIN region r ON r.r_name = uf AND r.r_regionkey < 3""", with_lots=True)
def dimension_ids(spark, sf_dir):
    """Known courts and auctioneers are found again; the rest have ids of their keys."""
    found = _dimensions(spark, sf_dir)["lots"]
    known = lambda c: F.when(F.col(c) < 1_000_000, F.col(c))  # noqa: E731  made ids are far greater
    return found.select("lot_id", known("auctioneer_id").alias("auctioneer_id"), known("court_id").alias("court_id"), F.col("case_id").isNotNull().alias("has_case"), F.col("district_id").isNotNull().alias("has_district"))


@query("SELECT lot_id, CASE WHEN auctioneer_id % 2 = 0 THEN auctioneer_id WHEN auctioneer_id % 3 = 0 THEN auctioneer_id + 1000000 END AS auctioneer_id FROM lots", with_lots=True)
def matched_auctioneers(spark, sf_dir):
    """By name, or else by register and licence."""
    k = F.col("auctioneer_id")
    rows = lots(spark, sf_dir).select("lot_id", F.concat(F.lit("JOÃO "), k.cast("string")).alias("name"), F.lit("JUCEAL").alias("register"), F.when(k % 3 == 0, k.cast("string")).alias("licence"))
    s = F.col("s_suppkey")
    supplier = read(spark, sf_dir, "supplier")
    by_name = supplier.filter(s % 2 == 0).select(s.alias("auctioneer_id"), F.concat(F.lit("joao "), s.cast("string")).alias("name"), F.lit(None).cast("string").alias("register"), F.lit(None).cast("string").alias("licence"))
    by_licence = supplier.select((s + 1_000_000).alias("auctioneer_id"), F.lit("outro").alias("name"), F.lit("JUCEAL").alias("register"), s.cast("string").alias("licence"))
    return identity.match_auctioneers(rows, by_name.unionByName(by_licence)).select("lot_id", "auctioneer_id")


# ---- publications ----

JUDGE = "CASE lot_id % 4 WHEN 0 THEN 'Seção Judiciária de Alagoas' WHEN 1 THEN 'Subseção Judiciaria do Sergipe' ELSE 'Foro' END"


def _publications(spark, sf_dir):
    k = F.col("lot_id")
    where = F.when(k % 4 == 0, "Seção Judiciária de Alagoas").when(k % 4 == 1, "Subseção Judiciaria do Sergipe").otherwise("Foro")
    asset = F.when(k % 3 == 0, "apartamento amplo no bairro central, com garagem; segue a descrição").when(k % 3 == 1, "veículo marca Delivery 9.170 ano 2010, sem chave. Visitas de segunda a sexta").otherwise("quotas sociais de uma empresa qualquer do ramo - sem mais")
    body = F.concat(F.when(k % 5 == 0, "EDITAL DE LEILÃO ELETRÔNICO, 1a praça com leiloeiro, autos. ").otherwise("Despacho sem mais nada a declarar nos autos. "), where, F.lit(". BEM: "), asset, F.lit("."))
    return lots(spark, sf_dir).select(
        k.alias("publication_id"), F.lit("djen").alias("source"), body.alias("text"), F.when(k % 2 == 0, "3ª Vara").alias("organ"), F.lit("Maceió").alias("place"), F.lit(None).cast("string").alias("case_number"), F.lit("TJAL").alias("court"),
        F.when(k % 4 == 3, "PE").alias("uf"), "sphere", (k % 5 == 0).alias("detected"), (k % 7 == 0).alias("review"), F.to_date("collected_at").alias("published_on"))


def _facts(spark, sf_dir):
    """Facts of the publications, as the parser would give them."""
    k = F.col("lot_id")
    number, at = F.lit(None).cast("decimal(18,3)"), F.lit(None).cast("timestamp_ntz")
    fact = lambda name, **v: F.struct(F.lit(name).alias("name"), F.lit(0.92).alias("confidence"), F.lit(None).cast("string").alias("text"), v.get("number", number).cast("decimal(18,3)").alias("number"), v.get("at", at).alias("at"), F.lit(None).cast("boolean").alias("flag"))
    return lots(spark, sf_dir).select(k.alias("publication_id"), F.inline(F.array(fact("valor_avaliacao", number=F.col("appraisal")), fact("data_praca_1", at=F.col("collected_at")), fact("percentual_minimo_segunda_praca", number=F.when(k % 2 == 0, F.lit(50))))))


@query("""SELECT lot_id AS publication_id, CASE lot_id % 3 WHEN 0 THEN 'apartamento amplo no bairro central, com garagem' WHEN 1 THEN 'veículo marca Delivery 9.170 ano 2010, sem chave' ELSE 'quotas sociais de uma empresa qualquer do ramo' END || ' · ' || CASE WHEN lot_id % 2 = 0 THEN '3ª Vara' ELSE 'Maceió' END AS title,
CASE lot_id % 3 WHEN 0 THEN 'IMOVEL' WHEN 1 THEN 'VEICULO' ELSE 'OUTRO' END AS asset, CAST(appraisal AS DOUBLE) AS appraisal, CASE WHEN lot_id % 2 = 0 THEN 2 ELSE 1 END AS sessions, CASE lot_id % 4 WHEN 0 THEN 'AL' WHEN 1 THEN 'SE' WHEN 3 THEN 'PE' END AS uf, collected_at AS first_at FROM lots WHERE lot_id % 5 = 0""", with_lots=True)
def publication_lots(spark, sf_dir):
    """Detected publications as thin lots."""
    found = publications.as_lots(publications.detected(_publications(spark, sf_dir)), _facts(spark, sf_dir))
    return found.select("publication_id", "title", "asset", F.col("appraisal").cast("double").alias("appraisal"), F.size("sessions").alias("sessions"), "uf", F.col("sessions")[0]["at"].alias("first_at"))


@query("""SELECT name, count(*) AS n, count(*) FILTER (review) AS to_review FROM (SELECT 'leilao_detectado_em_diario' AS name, FALSE AS review FROM lots WHERE lot_id % 5 = 0 UNION ALL SELECT 'natureza_bem', FALSE FROM lots WHERE lot_id % 5 = 0 UNION ALL SELECT 'zona_imovel', FALSE FROM lots WHERE lot_id % 15 = 0
UNION ALL SELECT unnest(['valor_avaliacao', 'data_praca_1', 'percentual_minimo_segunda_praca']), FALSE FROM lots WHERE lot_id % 5 = 0) GROUP BY name""", with_lots=True)
def publication_findings(spark, sf_dir):
    """What detection, classification and the parser say, by name."""
    found = publications.detected(_publications(spark, sf_dir))
    facts = _facts(spark, sf_dir).filter("publication_id % 5 = 0")
    return publications.findings(found, facts).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count_if("review").alias("to_review"))


@query("""SELECT lot_id AS publication_id FROM lots WHERE lot_id % 4 = 3 AND sphere IN ('ESTADUAL', 'FEDERAL') AND lot_id % 5 = 0 AND lot_id % 7 <> 0 AND CAST(collected_at AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-06-30'""", with_lots=True)
def publication_filters(spark, sf_dir):
    """all six filters."""
    return publications.wanted(_publications(spark, sf_dir), source=("djen",), uf=("PE",), sphere=("ESTADUAL", "FEDERAL"), detected=True, review=False, since="1995-01-01", until="1996-06-30").select("publication_id")


@query(f"SELECT lot_id AS publication_id, CASE lot_id % 4 WHEN 0 THEN 'AL' WHEN 1 THEN 'SE' END AS uf, CASE WHEN lot_id % 4 < 2 THEN 'FEDERAL' ELSE 'DESCONHECIDA' END AS sphere FROM (SELECT lot_id, {JUDGE} AS t FROM lots)", with_lots=True)
def section_states(spark, sf_dir):
    """State and sphere by what a text calls its court."""
    return _publications(spark, sf_dir).select("publication_id", publications.section_state(F.col("text")).alias("uf"), publications.sphere_of_text(F.col("text")).alias("sphere"))


@query("SELECT o_orderkey AS doc_id, o_orderkey % 3 = 1 AS auction FROM orders")
def movements_of_auctions(spark, sf_dir):
    """Dockets with a movement that speaks of an auction."""
    k = F.col("o_orderkey")
    moves = F.array(F.lit("Conclusos para despacho"), F.when(k % 3 == 1, "Designada a HASTA PÚBLICA").otherwise("Juntada de petição"))
    return read(spark, sf_dir, "orders").select(k.alias("doc_id"), terms.auction_movements(moves).alias("auction"))


# ---- screens ----


def _findings(spark, sf_dir):
    """Findings of every lot: a number, a date, a flag and a text, some unsure, with their sequence."""
    k = F.col("lot_id")
    kinds = (("text", "string"), ("number", "decimal(18,3)"), ("at", "timestamp_ntz"), ("flag", "boolean"))
    made = lambda n, name, sure, **v: F.struct(F.lit(n).alias("n"), F.lit(name).alias("name"), sure.alias("confidence"), (sure < 0.70).alias("review"), *(v.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds))
    sure, unsure = F.lit(0.92), F.when(k % 2 == 0, 0.65).otherwise(0.92)
    return lots(spark, sf_dir).select("lot_id", F.inline(F.array(made(1, "valor", sure, number=k % 100), made(2, "ocupado", unsure, flag=k % 3 == 0), made(3, "bairro", sure, text=F.lit("Centro")), made(4, "data", sure, at=F.col("collected_at")), made(5, "ocupado", F.lit(0.45), flag=k % 3 == 1))))


@query("""SELECT l.lot_id, coalesce(min(s.at) FILTER (s.at >= TIMESTAMP '1998-06-01 12:00:00'), max(s.at)) AS next_session, coalesce(arg_min(s.ordinal, s.at) FILTER (s.at >= TIMESTAMP '1998-06-01 12:00:00'), arg_max(s.ordinal, s.at)) AS next_ordinal, l.auctioneer_id AS auctioneer, (SELECT s_name FROM supplier WHERE s_suppkey = l.auctioneer_id) AS name
FROM lots l LEFT JOIN sessions s ON s.lot_id = l.lot_id AND s.at IS NOT NULL GROUP BY l.lot_id, l.auctioneer_id""", with_lots=True)
def lot_summaries(spark, sf_dir):
    """Lots with their next session and auctioneer."""
    known = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("auctioneer_id"), F.col("s_name").alias("name"), F.lit("REGULAR").alias("status"))
    found = views.summary(lots(spark, sf_dir), sessions(spark, sf_dir), AS_OF, known)
    return found.select("lot_id", "next_session", "next_ordinal", F.col("auctioneer.auctioneer_id").alias("auctioneer"), F.col("auctioneer.name").alias("name"))


@query("""SELECT lot_id, 'bairro=Centro,data=' || strftime(collected_at, '%Y-%m-%d %H:%M:%S') || ',ocupado=' || (lot_id % 3 = 0)::VARCHAR || ',ocupado=' || (lot_id % 3 = 1)::VARCHAR || ',valor=' || (lot_id % 100)::VARCHAR || '.000' AS fields,
CASE WHEN lot_id % 2 = 0 THEN 'ocupado,ocupado,bairro,data,valor' ELSE 'ocupado,bairro,data,ocupado,valor' END AS shown, (SELECT count(*) FROM sessions s WHERE s.lot_id = lots.lot_id) AS sessions FROM lots""", with_lots=True)
def lot_details(spark, sf_dir):
    """Everything of a lot in one row, fields by name, and as the screen sorts them."""
    found = _findings(spark, sf_dir)
    held = sessions(spark, sf_dir).select("lot_id", "ordinal", "at")
    one = views.detail(lots(spark, sf_dir).select("lot_id"), found, sessions=held)
    # two findings of one name stand in the order of their values
    pair = lambda x: F.concat(x["name"], F.lit("="), x["value"])
    fields = F.array_join(F.transform(F.array_sort(F.transform("fields", lambda x: F.struct(x["name"].alias("a"), (-x["confidence"]).alias("c"), pair(x).alias("p")))), lambda x: x["p"]), ",")
    screen = views.detail(lots(spark, sf_dir).select("lot_id"), found, review_first=True).select("lot_id", F.array_join(F.transform("fields", lambda x: x["name"]), ",").alias("shown"))
    return one.select("lot_id", fields.alias("fields"), F.size("sessions").cast("long").alias("sessions")).join(screen, "lot_id")


@query("SELECT lot_id, CASE WHEN lot_id % 2 = 0 THEN 3 ELSE 4 END AS confirmed, CASE WHEN lot_id % 2 = 0 THEN 2 ELSE 1 END AS to_review FROM lots", with_lots=True)
def confirmed_fields(spark, sf_dir):
    """A17."""
    return views.confirmed_fields(_findings(spark, sf_dir))


@query("SELECT lot_id, name, confidence::DOUBLE AS confidence, value FROM (SELECT lot_id, 'valor' AS name, 0.92 AS confidence, (lot_id % 100)::VARCHAR || '.000' AS value FROM lots UNION ALL SELECT lot_id, 'bairro', 0.92, 'Centro' FROM lots UNION ALL SELECT lot_id, 'ocupado', 0.45, (lot_id % 3 = 1)::VARCHAR FROM lots)", with_lots=True)
def last_findings(spark, sf_dir):
    """The last finding of a name wins."""
    found = views.last_findings(_findings(spark, sf_dir).filter("name <> 'data'"))
    return found.select("lot_id", "name", "confidence", views.typed_value(F.col("number"), F.col("at"), F.col("flag"), F.col("text")).alias("value"))


@query("""SELECT o_orderkey AS lot_id, 'Vara ' || (o_custkey % 9)::VARCHAR AS chamber, CASE WHEN c_custkey % 10 <> 0 THEN n_name END AS comarca, CASE WHEN c_custkey % 10 <> 0 THEN r_name ELSE NULL END AS court_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
def lot_places(spark, sf_dir):
    """Case, district and court of each lot, by keyed joins instead of one lookup a lot."""
    nation = read(spark, sf_dir, "nation")
    own = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("lot_id"), F.col("o_custkey").alias("case_id"))
    known = F.col("c_custkey") % 10 != 0
    cases = read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("case_id"), F.concat(F.lit("Vara "), (F.col("c_custkey") % 9).cast("string")).alias("chamber"), F.when(known, F.col("n_nationkey")).alias("district_id"), F.when(known, F.col("n_regionkey")).alias("court_id"))
    districts = nation.select(F.col("n_nationkey").alias("district_id"), F.col("n_name").alias("name"))
    courts = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("court_id"), F.col("r_name").alias("name"))
    return views.with_places(own, cases, districts, courts).select("lot_id", "chamber", "comarca", "court_name")


@query("SELECT event_id AS document_id FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 50")
def pending_documents(spark, sf_dir):
    """the next documents to extract; fifty a run."""
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("document_id"), F.when(F.col("event_type") != "error", F.col("ts")).alias("extracted_at"))
    return views.pending_documents(rows).select("document_id")


@query("SELECT e.event_id, l.lot_id FROM events e JOIN lots l ON l.lot_id = e.event_id WHERE e.user_id = 5", with_lots=True)
def favourites(spark, sf_dir):
    """What a user has marked, and its lots."""
    marks = read(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("lot_id"), "user_id", F.col("ts").alias("marked_at"))
    return views.favourites(marks, lots(spark, sf_dir).select("lot_id"), 5).select("event_id", "lot_id")


EVENTS_SQL = """all_events AS (SELECT s.lot_id, CASE WHEN c.n = 1 AND s.ordinal = 1 THEN 'PRACA_UNICA' WHEN s.ordinal = 1 THEN 'PRACA_PRIMEIRA' ELSE 'PRACA_SEGUNDA' END AS kind, s.at FROM sessions s JOIN (SELECT lot_id, count(*) AS n FROM sessions GROUP BY lot_id) c ON c.lot_id = s.lot_id WHERE s.at IS NOT NULL
UNION ALL SELECT lot_id, 'PRAZO_HABILITACAO', arg_min(at, ordinal) - INTERVAL 3 DAY FROM sessions WHERE at IS NOT NULL GROUP BY lot_id),
own AS (SELECT e.*, l.title, CASE l.status WHEN 'SUSPENSO' THEN 'SUSPENSO' WHEN 'ABERTO' THEN 'CONFIRMADO' ELSE 'REALIZADO' END AS event_status FROM all_events e JOIN lots l ON l.lot_id = e.lot_id),
items AS (SELECT * FROM own WHERE at BETWEEN TIMESTAMP '1998-06-01 12:00:00' AND TIMESTAMP '1998-07-31 12:00:00' AND kind LIKE 'PRACA_%' ORDER BY at, lot_id, kind LIMIT 500)"""


def _events(spark, sf_dir):
    return events.wanted(sessions(spark, sf_dir), lots(spark, sf_dir)).withColumnRenamed("target", "event_status")


@query(f", {EVENTS_SQL} SELECT lot_id, kind, at AS event_at, at - INTERVAL 1 DAY AS old_at, event_status FROM own WHERE kind <> 'PRAZO_HABILITACAO'", with_lots=True)
def event_history(spark, sf_dir):
    """Changes on record, with the event as it now is."""
    now = _events(spark, sf_dir)
    changes = now.filter("kind <> 'PRAZO_HABILITACAO'").select("lot_id", "kind", (F.col("at") - F.expr("INTERVAL 1 DAY")).alias("old_at"))
    return views.history(now, changes).select("lot_id", "kind", "event_at", "old_at", "event_status")


def _items(spark, sf_dir):
    published = lots(spark, sf_dir).filter("lot_id % 3 = 0").select("lot_id", F.to_date("collected_at").alias("published_on"))
    return agenda.items(_events(spark, sf_dir), lots(spark, sf_dir).drop("status"), AS_OF, gazette=published)


@query(f", {EVENTS_SQL} SELECT o.lot_id, o.kind, o.at FROM own o JOIN items i ON i.lot_id = o.lot_id AND i.kind = o.kind", with_lots=True)
def agenda_calendar(spark, sf_dir):
    """The events behind an agenda's items."""
    return views.shown_events(_events(spark, sf_dir), _items(spark, sf_dir)).select("lot_id", "kind", "at")


@query(f", {EVENTS_SQL} SELECT count(*) AS total, count(*) FILTER (lot_id % 3 = 0) AS from_gazette FROM items", with_lots=True)
def agenda_totals(spark, sf_dir):
    """A4."""
    return views.agenda_totals(_items(spark, sf_dir))


@query("SELECT lot_id, ordinal, at + CASE WHEN lot_id % 4 = 0 AND lot_id % 8 = 0 THEN INTERVAL 2 DAY ELSE INTERVAL 0 DAY END AS at, CASE WHEN lot_id % 8 = 0 AND at IS NOT NULL THEN 'REMARCADA' ELSE 'AGENDADA' END AS session_status, CASE WHEN lot_id % 3 = 0 THEN 50.0 WHEN lot_id % 4 = 0 THEN 60.0 END::DOUBLE AS share FROM sessions", with_lots=True)
def synced_sessions(spark, sf_dir):
    """New dates mark a session as moved; a missing share is filled."""
    k = F.col("lot_id")
    own = sessions(spark, sf_dir)
    old = own.withColumn("share", F.when(k % 3 == 0, F.lit("50.00")).cast("decimal(5,2)"))
    new = own.filter(k % 4 == 0).select("lot_id", "ordinal", F.when(k % 8 == 0, F.col("at") + F.expr("INTERVAL 2 DAYS")).otherwise(F.col("at")).alias("at"), F.lit("60.00").cast("decimal(5,2)").alias("share"))
    return events.sync_sessions(old, new).select("lot_id", "ordinal", "at", "session_status", F.col("share").cast("double").alias("share"))


@query("SELECT lot_id, CASE WHEN lot_id % 2 = 0 THEN title WHEN lot_id % 3 = 0 THEN 'lido' END AS title, CASE WHEN lot_id % 4 = 0 THEN 7 END AS rooms FROM lots", with_lots=True)
def applied_findings(spark, sf_dir):
    """Sure findings fill what a lot lacks, and nothing else."""
    k = F.col("lot_id")
    own = lots(spark, sf_dir).select("lot_id", F.when(k % 2 == 0, F.col("title")).alias("title"), F.lit(None).cast("int").alias("rooms"))
    rows = own.select("lot_id", F.lit("title").alias("name"), F.when(k % 3 == 0, 0.92).otherwise(0.60).alias("confidence"), F.lit("lido").alias("value")).unionByName(own.filter(k % 4 == 0).select("lot_id", F.lit("rooms").alias("name"), F.lit(0.92).alias("confidence"), F.lit("7").alias("value")))
    return identity.apply_findings(own, rows, ("title", "rooms"))


# ---- runs ----


@query("SELECT lot_id, CASE WHEN lot_id % 3 = 0 THEN 'h2' ELSE 'h1' END AS content_hash, CASE WHEN lot_id % 2 = 0 OR lot_id % 3 = 0 THEN TIMESTAMP '1998-06-01 12:00:00' ELSE collected_at END AS last_seen, lot_id % 3 = 0 AS changed FROM lots", with_lots=True)
def touched_lots(spark, sf_dir):
    """What a run saw again, and what of it changed."""
    own = lots(spark, sf_dir).select("lot_id", F.lit("h1").alias("content_hash"), F.col("collected_at").alias("last_seen"))
    seen = own.filter("lot_id % 2 = 0 or lot_id % 3 = 0").select("lot_id", F.when(F.col("lot_id") % 3 == 0, "h2").otherwise("h1").alias("content_hash"))
    return cycle.touched(own, seen, AS_OF)


@query("""SELECT coalesce(CASE WHEN event_type <> 'error' THEN event_type END, '(others)') AS source, CAST(coalesce(sum(event_id % 5) FILTER (event_id % 3 = 0), 0) AS BIGINT) AS found, CAST(coalesce(sum(event_id % 5) FILTER (event_id % 3 = 1), 0) AS BIGINT) AS new, CAST(coalesce(sum(event_id % 5) FILTER (event_id % 3 = 2), 0) AS BIGINT) AS errors,
count(*) FILTER (event_id % 3 = 2) AS warnings, coalesce(string_agg(DISTINCT CASE WHEN event_id % 3 = 2 THEN 'HTTP ' || (500 + event_id % 4) END, ',' ORDER BY CASE WHEN event_id % 3 = 2 THEN 'HTTP ' || (500 + event_id % 4) END), '') AS examples FROM events GROUP BY 1""")
def observed_run(spark, sf_dir):
    """What a run counts, told by the write of its rows."""
    i = F.col("event_id")
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.when(i % 3 == 0, "found").when(i % 3 == 1, "new").otherwise("errors").alias("counter"), (i % 5).alias("n"), F.when(i % 3 == 2, F.concat(F.lit("HTTP "), (500 + i % 4).cast("string"))).alias("warning"))
    known = [r[0] for r in rows.select("source").distinct().filter("source <> 'error'").collect()]
    told = metrics.observed(rows, sorted(known), lambda df: df.write.parquet(keyed.new_folder(spark, "runs")))
    return told.select("source", "found", "new", "errors", "warnings", F.array_join("examples", ",").alias("examples"))


@query("""SELECT event_type AS source, 2 * count(*) FILTER (event_id % 3 = 0) AS found, 2 * count(*) FILTER (event_id % 3 = 1) AS new, 2 * count(*) FILTER (event_id % 3 = 2) AS errors, 2 * count(*) FILTER (event_id % 3 = 2) AS warnings FROM events GROUP BY event_type""")
def run_statistics(spark, sf_dir):
    """Counters of a run, and two runs merged."""
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.when(F.col("event_id") % 3 == 0, "found").when(F.col("event_id") % 3 == 1, "new").otherwise("errors").alias("counter"), F.lit(1).alias("n"), F.when(F.col("event_id") % 3 == 2, "HTTP 500").alias("warning"))
    one = cycle.statistics(rows)
    return cycle.merged_statistics(one, one).select("source", "found", "new", "errors", "warnings")


@query("""SELECT uf AS source, count(*) AS found, count(*) FILTER (lot_id % 4 = 0) AS new, count(*) FILTER (lot_id % 4 <> 0 AND lot_id % 3 = 0) AS updated, count(*) FILTER (lot_id % 4 <> 0 AND lot_id % 3 <> 0) AS unchanged, CAST(coalesce(sum(moved), 0) AS BIGINT) AS reschedules FROM (
SELECT lot_id, uf, CASE WHEN lot_id % 5 = 0 THEN (SELECT count(*) FROM sessions s WHERE s.lot_id = lots.lot_id AND s.at IS NOT NULL) + CASE WHEN (SELECT count(*) FROM sessions s WHERE s.lot_id = lots.lot_id AND s.at IS NOT NULL) > 0 THEN 1 ELSE 0 END END AS moved FROM lots) GROUP BY uf""", with_lots=True)
def full_cycle(spark, sf_dir):
    """Collected lots merged into the stored ones, their calendar compared, and what each source's run counts."""
    k = F.col("lot_id")
    own = lots(spark, sf_dir).select("lot_id", F.col("uf").alias("source"), "status", "title", F.lit("h1").alias("content_hash"))
    incoming = own.withColumn("content_hash", F.when(k % 3 == 0, "h2").otherwise("h1"))
    held = sessions(spark, sf_dir)
    before = events.wanted(held, lots(spark, sf_dir)).select("lot_id", "kind", F.when(k % 5 == 0, F.col("at") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("at")).alias("at"), F.col("target").alias("event_status"))
    made = cycle.run(own.filter(k % 4 != 0), incoming, before, held, ("title", "source"), AS_OF)
    return made["statistics"].select("source", "found", "new", "updated", "unchanged", "reschedules")
