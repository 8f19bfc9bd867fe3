"""Market references and analyses: vehicle table by likeness, price index by place and month, best analysis, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import comparable

#: Words that say nothing about a model.
NOISE_WORDS = ("flex", "4p", "5p", "2p", "aut", "mec", "16v", "12v", "8v", "v", "cv", "gasolina", "alcool", "diesel", "turbo", "mpi", "tsi", "fire")
#: Least likeness, and what another year is worth.
LEAST_LIKENESS, OTHER_YEAR = "0.34", "0.6"
#: Sources that tell of a market.
MARKET_SOURCES = ("FIPE", "FIPEZAP", "COMPARAVEIS")
#: What an analysis says of itself, in this order.
OLD_APPRAISAL = "O valor de avaliação vem do laudo judicial e pode estar defasado em relação ao mercado — confira a data do laudo no edital."
SESSION_PASSED = "A praça usada como base já ocorreu; o lote pode estar encerrado."
NORMAL_USE = "A tabela FIPE é referência para veículo em estado normal de uso. Veículo de leilão costuma ter deságio adicional."
ASKED_PRICES = "O FipeZap mede preço de ANÚNCIO por m², não preço de venda fechado."
TOTAL_AREA = "Usada a área total por falta de área privativa no edital; o índice é calculado sobre área útil, então a referência tende a ficar superestimada."
#: Likeness below which a vehicle's model is told to be a guess.
SURE_LIKENESS = 0.6
DEMO_VALUE, DEMO_INDEX = "ATENÇÃO: valor de referência de DEMONSTRAÇÃO. Carregue a tabela real antes de usar em decisão.", "ATENÇÃO: índice de DEMONSTRAÇÃO. Carregue o boletim real antes de usar em decisão."


def money2(c: Column) -> Column:
    return F.bround(c, 2).cast("decimal(14,2)")


def tokens(c: Column) -> Column:
    words = F.split(comparable(c), "[^a-z0-9.]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*NOISE_WORDS)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two arrays of tokens; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def discount(reference: Column, compared: Column) -> Column:
    """Per cent below the reference, half-even to two places; 0 for a reference of 0 or less."""
    return F.when(reference <= 0, F.lit(0)).otherwise(F.bround((reference - compared).cast("decimal(18,2)") * 100 / reference, 2)).cast("decimal(12,2)")


def match_models(vehicles: DataFrame, table: DataFrame) -> DataFrame:
    """vehicles (id, brand, model, year) with the table row (ref_id, brand, model, year, value) most like each.

    Vehicles of one brand, model and year are one kind, and table rows of one brand, year and set of tokens one entry
    under its least ref_id, so pairs grow with the different texts and not with the rows. Candidates share brand and
    year: these meet by an equi-join on both, so a brand's own name pairs nothing. Only a kind without such candidates
    meets the whole table, by tokens, and then only by those of its tokens and the entry's that a pair of the least
    likeness must share: the rarest ones (a prefix filter). Another year is worth less; the least ref_id of equals
    counts.
    """
    own = vehicles.select("id", F.struct("brand", "model", "year").alias("kind"))
    kinds = own.select("kind").distinct().select(F.col("kind").alias("id"), "kind.*")
    left = kinds.select("id", F.upper(comparable(F.col("brand"))).alias("brand"), "year", tokens(F.concat_ws(" ", "brand", "model")).alias("t"))
    right = table.select("ref_id", F.col("brand").alias("ref_brand"), F.col("year").alias("ref_year"), F.array_sort(tokens(F.concat_ws(" ", "brand", "model"))).alias("r"))
    right = right.groupBy("ref_brand", "ref_year", "r").agg(F.min("ref_id").alias("ref_id"))
    blocks = table.select("brand", "year").distinct().withColumn("blocked", F.lit(True))
    known = left.join(blocks, ["brand", "year"], "left")
    inside = known.filter("blocked").join(right, (F.col("brand") == F.col("ref_brand")) & (F.col("year") == F.col("ref_year")))
    loose = _by_rare_tokens(known.filter("blocked is null"), right)
    names = ["id", "ref_id", "year", "ref_year", "t", "r"]
    pairs = inside.select(names).unionByName(loose.select(names)).withColumn("jaccard", likeness(F.col("t"), F.col("r")))
    score = F.when(F.col("year") != F.col("ref_year"), F.col("jaccard") * float(OTHER_YEAR)).otherwise(F.col("jaccard"))
    best = lambda df, key: df.groupBy(key).agg(F.max_by(F.struct("ref_id", "likeness"), F.struct("likeness", -F.col("ref_id"))).alias("b")).select(key, "b.*")
    matched = best(pairs.withColumn("likeness", score), "id").filter(F.col("likeness") >= float(LEAST_LIKENESS))
    # an id may stand for several rows of vehicles
    found = best(own.join(matched.withColumnRenamed("id", "kind"), "kind"), "id")
    return found.select("id", "ref_id", F.round("likeness", 3).alias("likeness"))


def _by_rare_tokens(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of left (t) and right (r) that may reach the least likeness, each once.

    Of n tokens in one order for all, a pair that alike shares one of the first n - ceil(least * n) + 1 of either
    side; the order is from the rarest in the table on, so common tokens seldom pair anything.
    """
    counts = right.select(F.explode("r").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))

    def prefixes(df: DataFrame, key: str, words: str) -> DataFrame:
        ranked = df.select(key, F.explode(words).alias("token")).join(counts, "token", "left")
        own = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))).alias("w"))
        most = F.size("w") - F.ceil(F.size("w") * float(LEAST_LIKENESS)).cast("int") + 1
        return own.select(key, F.explode(F.slice(F.transform("w", lambda x: x["token"]), F.lit(1), most)).alias("token"))

    met = prefixes(left, "id", "t").join(prefixes(right, "ref_id", "r"), "token").select("id", "ref_id").distinct()
    return met.join(left, "id").join(right, "ref_id")


def index_value(lots: DataFrame, index: DataFrame) -> DataFrame:
    """lots with value_m2, month and precision: the index's latest month for the place, the district's value in
    that month if there is one, else the city's; no city row, no value."""
    named = index.select(F.upper("uf").alias("_uf"), comparable(F.col("city")).alias("_city"), comparable(F.col("district")).alias("_district"), "month", "value_m2")
    latest = named.groupBy("_uf", "_city").agg(F.max("month").alias("month"))
    current = named.join(latest, ["_uf", "_city", "month"])
    one = current.groupBy("_uf", "_city", "_district").agg(F.max("month").alias("month"), F.min("value_m2").alias("value_m2"))
    district = one.filter("_district <> ''").select("_uf", "_city", "_district", F.col("value_m2").alias("_d"), F.col("month").alias("_dm"))
    city = one.filter("_district = ''").select("_uf", "_city", F.col("value_m2").alias("_c"), F.col("month").alias("_cm"))
    keyed = lots.withColumns({"_uf": F.upper("uf"), "_city": comparable(F.col("city")), "_district": comparable(F.col("district"))})
    found = keyed.join(district, ["_uf", "_city", "_district"], "left").join(city, ["_uf", "_city"], "left")
    precision = F.when(F.col("_d").isNotNull(), "BAIRRO").when(F.col("_c").isNotNull(), "CIDADE")
    return found.select(*lots.columns, F.coalesce("_d", "_c").alias("value_m2"), F.coalesce("_dm", "_cm").alias("month"), precision.alias("precision"))


def _have(df: DataFrame, name: str, kind: str) -> Column:
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind)


def _warnings(*said: Column) -> Column:
    return F.array_compact(F.array(*said)).alias("warnings")


def _compared(df: DataFrame) -> Column:
    """The session whose minimum was compared, where lots tell its ordinal."""
    return F.coalesce(F.concat(F.lit(" Comparado ao lance mínimo da "), _have(df, "ordinal", "string"), F.lit("ª praça.")), F.lit(" Comparado ao lance mínimo."))


def appraisal_analysis(lots: DataFrame) -> DataFrame:
    """lots carry minimum (of the current session) and appraisal, and may carry that session's ordinal and `passed`.
    Lots without minimum or appraisal have no analysis. Every analysis tells its warnings and its method."""
    known = lots.filter("appraisal > 0 and minimum is not null")
    passed = F.when(_have(known, "passed", "boolean"), SESSION_PASSED)
    method = F.concat(F.lit("Desconto sobre a avaliação judicial: lance mínimo"), F.coalesce(F.concat(F.lit(" da "), _have(known, "ordinal", "string"), F.lit("ª praça")), F.lit("")), F.lit(" ("), money2(F.col("minimum")).cast("string"), F.lit(") comparado ao valor de avaliação ("), money2(F.col("appraisal")).cast("string"), F.lit(") constante do edital."))
    return known.select("lot_id", F.lit("LAUDO_JUDICIAL").alias("source"), F.col("appraisal").alias("reference"), F.col("minimum").alias("compared"), discount(F.col("appraisal"), F.col("minimum")).alias("discount"), F.lit("0.850").cast("decimal(5,3)").alias("confidence"), _warnings(F.lit(OLD_APPRAISAL), passed), method.alias("method"))


def vehicle_analysis(lots: DataFrame, matches: DataFrame, table: DataFrame) -> DataFrame:
    """matches: match_models' result for these lots. Stated damage and demonstration rows lower the confidence. The
    table may tell the month of its values."""
    row = table.select("ref_id", F.col("value").alias("reference"), "demo", F.concat_ws(" ", "brand", "model", F.col("year").cast("string")).alias("_named"), F.col("model").alias("_model"), _have(table, "month", "string").alias("_month"))
    found = lots.filter("asset = 'VEICULO' and minimum is not null").join(matches.withColumnRenamed("id", "lot_id"), "lot_id").join(row, "ref_id")
    d = lambda x: F.lit(x).cast("decimal(3,2)")
    hurt = F.when(F.coalesce(F.size("damage"), F.lit(0)) > 0, d("0.80")).otherwise(d("1.00"))
    sure = d("0.80") * F.col("likeness").cast("decimal(5,3)") * hurt * F.when(F.col("demo"), d("0.50")).otherwise(d("1.00"))
    guess = F.concat(F.lit("O modelo do edital foi casado por aproximação com “"), F.col("_model"), F.lit("” (similaridade "), F.col("likeness").cast("string"), F.lit("). Confira se é o mesmo veículo."))
    worse = F.concat(F.lit("O edital aponta "), F.replace(F.array_join("damage", ", "), F.lit("_"), F.lit(" ")), F.lit(" — isso reduz o valor real abaixo da FIPE."))
    said = _warnings(F.when(F.col("demo"), DEMO_VALUE), F.lit(NORMAL_USE), F.when(F.col("likeness") < SURE_LIKENESS, guess), F.when(F.size("damage") > 0, worse))
    method = F.concat(F.lit("FIPE "), F.col("ref_id").cast("string"), F.lit(" — "), F.col("_named"), F.coalesce(F.concat(F.lit(", referência "), F.col("_month")), F.lit("")), F.lit("."), _compared(found))
    return found.select("lot_id", F.lit("FIPE").alias("source"), "reference", F.col("minimum").alias("compared"), discount(F.col("reference"), F.col("minimum")).alias("discount"), F.bround(F.least(sure, F.lit("0.900").cast("decimal(10,7)")), 3).cast("decimal(5,3)").alias("confidence"), said, method.alias("method"))


def index_analysis(lots: DataFrame) -> DataFrame:
    """lots carry value_m2 and precision, and may carry demo (of the index). The private area counts; the total area
    in its place lowers confidence, a demonstration row halves it."""
    area = F.coalesce(F.nullif("private_area", F.lit(0)), "total_area")
    known = lots.filter((F.col("asset") == "IMOVEL") & F.col("minimum").isNotNull() & F.col("value_m2").isNotNull() & (area > 0))
    d = lambda x: F.lit(x).cast("decimal(3,2)")
    reference = money2(F.col("value_m2") * area)
    demo = F.coalesce(_have(known, "demo", "boolean"), F.lit(False))
    sure = F.when(F.col("precision") == "BAIRRO", d("0.70")).otherwise(d("0.55")) * F.when(F.col("private_area").isNull(), d("0.80")).otherwise(d("1.00")) * F.when(demo, d("0.50")).otherwise(d("1.00"))
    place = F.concat(F.when(F.col("precision") == "BAIRRO", F.concat(F.col("district"), F.lit(", "))).otherwise(""), F.coalesce("city", F.lit("")), F.coalesce(F.concat(F.lit("/"), F.col("uf")), F.lit("")), F.coalesce(F.concat(F.lit(" — índice de "), _have(known, "month", "string")), F.lit("")))
    whole_city = F.concat(F.lit("Não há índice para o bairro "), F.nullif("district", F.lit("")), F.lit("; usada a média da cidade."))
    said = _warnings(F.when(demo, DEMO_INDEX), F.lit(ASKED_PRICES), F.when(F.col("private_area").isNull(), TOTAL_AREA), F.when(F.col("precision") == "CIDADE", whole_city))
    method = F.concat(area.cast("string"), F.lit(" m² × R$ "), F.col("value_m2").cast("string"), F.lit("/m² (FipeZap, "), place, F.lit(", precisão "), F.lower("precision"), F.lit(") = R$ "), reference.cast("string"), F.lit("."), _compared(known))
    return known.select("lot_id", F.lit("FIPEZAP").alias("source"), reference.alias("reference"), F.col("minimum").alias("compared"), discount(reference, F.col("minimum")).alias("discount"), F.bround(sure, 3).cast("decimal(5,3)").alias("confidence"), said, method.alias("method"))


def best_analysis(analyses: DataFrame) -> DataFrame:
    """One analysis for each lot: a market source first, then confidence, then discount; then the source's name.
    Warnings and method come along where analyses have them."""
    order = F.struct(F.col("source").isin(*MARKET_SOURCES), "confidence", F.coalesce("discount", F.lit(0).cast("decimal(12,2)")), "source")
    best = analyses.groupBy("lot_id").agg(F.max_by(F.struct("source", "reference", "compared", "discount", "confidence", *(c for c in ("warnings", "method") if c in analyses.columns)), order).alias("b"))
    return best.select("lot_id", "b.*")


def total_cost(lots: DataFrame, bid: Column | None = None) -> DataFrame:
    """lots plus total_cost: bid (else the later minimum), commission and stated debts; null without any bid.

    A zero counts as missing, as for prices that lots are sorted by. debts: array of (kind, amount).
    """
    base = F.coalesce(F.nullif(bid, F.lit(0)) if bid is not None else F.lit(None), F.nullif("second_min", F.lit(0)), F.nullif("first_min", F.lit(0))).cast("decimal(14,2)")
    fee = F.coalesce(F.bround(base * F.col("commission") / 100, 2), F.lit(0)).cast("decimal(14,2)")
    debts = F.aggregate(F.coalesce("debts", F.array().cast("array<struct<kind:string,amount:decimal(14,2)>>")), F.lit(0).cast("decimal(14,2)"), lambda a, x: (a + F.coalesce(x["amount"], F.lit(0))).cast("decimal(14,2)"))
    return lots.withColumn("total_cost", (base + fee + debts).cast("decimal(14,2)"))
