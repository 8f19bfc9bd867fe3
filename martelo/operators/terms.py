"""Weighted terms over comparable text: notice detection and asset classification, in exact decimals.

Fixed values: patterns, weights and labels. Patterns are written without accents, for text that has none.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import comparable, unaccented


class Term(NamedTuple):
    pattern: str
    weight: str
    label: str
    weight_as_place: str | None = None


FARM = r"\bsitio\b|\bfazenda\b|\bchacara\b|\bgranja\b|\bengenho\b"
STRONG = (
    Term(r"\bedital\s+de\s+leil(?:ao|oes)\b", "0.50", "edital de leilão"),
    Term(r"\bedital\s+de\s+(?:1a|primeira|2a|segunda|unica)\s+praca\b", "0.50", "edital de praça"),
    Term(r"\bhasta\s+publica\b", "0.50", "hasta pública"),
    Term(r"\bleilao\s+(?:judicial|eletronico|publico|presencial|hibrido)\b", "0.48", "leilão judicial"),
    Term(r"\balienacao\s+judicial\b", "0.45", "alienação judicial"),
    Term(r"\b(?:1a|primeira|2a|segunda|unica)\s+(?:praca|hasta)\b", "0.40", "praça designada"),
    Term(r"\bcarta\s+de\s+arremata[cç]ao\b", "0.40", "carta de arrematação"),
    Term(r"\barremat(?:acao|ante|ar|e|ado)\b", "0.32", "arrematação"),
)
MEDIUM = (
    Term(r"\blance\s+(?:minimo|inicial|vencedor)\b", "0.25", "lance mínimo"),
    Term(r"\bleiloeir[oa]\b", "0.22", "leiloeiro"),
    Term(r"\bleil(?:ao|oes)\b", "0.20", "leilão"),
    Term(r"\bvalor\s+d[ae]\s+avaliacao\b|\bavaliad[oa]\s+em\b", "0.15", "avaliação"),
    Term(r"\bbens?\s+penhorad[oa]s?\b", "0.15", "bem penhorado"),
)
NOISE = (
    Term(r"\bleilao\s+de\s+energia\b", "0.60", "leilão de energia"),
    Term(r"\bleilao\s+reverso\b", "0.50", "leilão reverso"),
    Term(r"\bpregao\s+(?:eletronico|presencial)\b", "0.35", "pregão licitatório"),
    Term(r"\bleilao\s+beneficente\b", "0.45", "leilão beneficente"),
)
GATE = r"leil|hasta|\bpraca\b|arremat"
COURT_WORDS = r"\bvara\b|\bjuiz|\bcomarca\b|\bexequente\b|\bexecutad[oa]\b|\bexecucao\s+fiscal\b|\bcumprimento\s+de\s+sentenca\b|\bsecao\s+judiciaria\b|\bautos\b"
LAND = (
    Term(r"\bbens?\s+imove(?:l|is)\b", "0.95", "bem imóvel"),
    Term(r"\bimove(?:l|is)\b", "0.90", "imóvel"),
    Term(r"\bapartamento\b|\bapto\.?\b", "0.90", "apartamento"),
    Term(r"\bterreno\b|\bgleba\b|\b(?:area|data)\s+de\s+terras?\b", "0.88", "terreno"),
    Term(FARM, "0.90", "sítio/fazenda", "0.45"),
    Term(r"\bsala\s+comercial\b|\bloja\b|\bgalpao\b|\bbarracao\b|\bpredio\b|\bedificio\b|\bsobrado\b|\bkitnet\b|\bcobertura\b", "0.85", "edificação"),
    Term(r"\bfracao\s+ideal\b|\bunidade\s+autonoma\b|\b(?:vaga|box)\s+de\s+garagem\b", "0.85", "fração ideal"),
    Term(r"\bregistro\s+de\s+imoveis\b|\bcartorio\s+de\s+imoveis\b", "0.88", "registro de imóveis"),
    Term(r"\bmatricula\s+(?:no\s*)?[\d.]{3,}", "0.80", "matrícula"),
    Term(r"\bbenfeitorias?\b|\balvenaria\b", "0.62", "benfeitoria"),
    Term(r"\biptu\b", "0.60", "IPTU"),
    Term(r"\bcasa\b", "0.70", "casa"),
)
GOODS = (
    Term(r"\bbens?\s+move(?:l|is)\b", "0.93", "bem móvel"),
    Term(r"\bveiculos?\b|\bautomove(?:l|is)\b|\bmotocicletas?\b|\bmotoneta\b|\bcaminha(?:o|es)\b|\bcamionet[ae]\b|\bonibus\b|\bsemirreboque\b|\breboque\b", "0.92", "veículo"),
    Term(r"\bchassi\b|\brenavam\b|\bplaca\s+[a-z]{3}", "0.90", "identificação veicular"),
    Term(r"\btrator(?:es)?\b|\bcolheitadeira\b|\bretroescavadeira\b|\bempilhadeira\b|\bmaquinas?\b|\bmaquinario\b|\bequipamentos?\b", "0.82", "máquina"),
    Term(r"\bsemoventes?\b|\bbovinos?\b|\bequinos?\b|\bcaprinos?\b|\bsuinos?\b|\brebanho\b|\bgado\b", "0.88", "semovente"),
    Term(r"\bembarcacao\b|\blancha\b|\baeronave\b", "0.85", "embarcação/aeronave"),
    Term(r"\bmobiliario\b|\bestoque\s+de\s+mercadorias\b", "0.80", "mobiliário/estoque"),
    Term(r"\b(?:quotas?|cotas?)\s+sociais\b|\bacoes\s+da\s+empresa\b", "0.72", "quotas"),
    Term(r"\bjoias?\b|\bobra\s+de\s+arte\b", "0.70", "joia/obra de arte"),
)
RURAL = (
    Term(r"\b(?:imove(?:l|is)|terrenos?|lotes?|glebas?|areas?|propriedades?|posses?)\s+rura(?:l|is)\b", "0.95", "imóvel rural"),
    Term(r"\b(?:zona|area|perimetro|setor)\s+rural\b", "0.92", "zona rural"),
    Term(r"\bccir\b|\bnirf\b|\bincra\b|\bitr\b", "0.88", "cadastro rural"),
    Term(FARM, "0.85", "sítio/fazenda"),
    Term(r"\bgleba\s+(?:de\s+terras?|rural)\b|\blote\s+rural\b", "0.88", "gleba rural"),
    Term(r"\bhectares?\b|\balqueires?\b|\btarefas?\s+de\s+terras?\b", "0.85", "medida agrária"),
    Term(r"\bcadastro\s+ambiental\s+rural\b", "0.85", "CAR"),
    Term(r"\bpovoado\b|\bassentamento\b", "0.60", "povoado"),
)
URBAN = (
    Term(r"\b(?:imove(?:l|is)|terrenos?|lotes?|glebas?|areas?|propriedades?|predios?)\s+urban[ao]s?\b", "0.92", "imóvel urbano"),
    Term(r"\b(?:zona|area|perimetro|setor)\s+urban[ao]\b", "0.92", "zona urbana"),
    Term(r"\bapartamento\b|\bapto\.?\b|\bcondominio\s+edilicio\b", "0.85", "apartamento"),
    Term(r"\biptu\b", "0.75", "IPTU"),
    Term(r"\bquadra\s+[\w-]+,?\s*lote\b", "0.70", "quadra e lote"),
    Term(r"\brua\b|\bavenida\b|\bav\.\s|\btravessa\b|\balameda\b|\bloteamento\b", "0.62", "logradouro"),
    Term(r"\bbairro\b|\bcep\b", "0.58", "bairro/CEP"),
)
#: Bounds and steps of both decisions.
CAP, NO_COURT, KEEP_FROM, REVIEW_BELOW = "0.95", "0.20", "0.55", "0.75"
TIE, AGREE, OPPOSED = "0.15", "0.04", "0.15"
PLACE = r"(?:localizad[oa]s?|situad[oa]s?|sediad[oa]s?|instalad[oa]s?|\bem|\bn[oa])\s+$"
LOOK_BACK = 18


def dec(x: str) -> Column:
    return F.lit(x).cast("decimal(6,3)")


def signals(low: Column, terms: tuple[Term, ...]) -> Column:
    """Array of (weight, label) of the terms that occur, the heaviest first, then in the order of the bank."""
    made = []
    for n, t in enumerate(terms):
        weight = dec(t.weight)
        if t.weight_as_place:
            # only the first occurrence decides whether the term names a place
            before = F.substring(F.substring(low, 1, F.regexp_instr(low, F.lit(t.pattern)) - 1), -LOOK_BACK, LOOK_BACK)
            weight = F.when(before.rlike(PLACE), dec(t.weight_as_place)).otherwise(weight)
        made.append(F.when(low.rlike(t.pattern), F.struct((-weight).alias("minus"), F.lit(n).alias("n"), F.lit(t.label).alias("label"))))
    found = F.array_sort(F.array_compact(F.array(*made)))
    return F.transform(found, lambda x: F.struct((-x["minus"]).alias("weight"), x["label"].alias("label")))


def total(found: Column) -> Column:
    return F.aggregate(found, dec("0"), lambda a, x: (a + x["weight"]).cast("decimal(6,3)"))


def labels(found: Column) -> Column:
    return F.transform(found, lambda x: x["label"])


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df plus columns that are made once for a row. They come out of an outer generator, as a plain column is copied
    into every filter and expression that speaks of it, and a pattern's text with it."""
    return df.select("*", F.inline_outer(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def detect(df: DataFrame, text: str = "text", keep_from: str = KEEP_FROM) -> DataFrame:
    """df plus `notice`: (score, labels, noise, in_court, review), null where the text is no auction notice.

    A gate on word stems spares every other text the banks.
    """
    low = F.col("__terms_low")
    gate = (F.length(F.trim(F.col(text))) >= 40) & low.rlike(GATE)
    banks = {"__terms_strong": STRONG, "__terms_medium": MEDIUM, "__terms_noise": NOISE}
    strong, medium, noise = map(F.col, banks)
    court = low.rlike(COURT_WORDS)
    raw = F.least(dec(CAP), total(strong) + total(medium)) - total(noise) - F.when(court, dec("0")).otherwise(dec(NO_COURT))
    score = F.greatest(dec("0"), F.least(dec(CAP), raw)).cast("decimal(4,3)")
    notice = F.struct(score.alias("score"), F.concat(labels(strong), labels(medium)).alias("labels"), labels(noise).alias("noise"), court.alias("in_court"), ((score < dec(REVIEW_BELOW)) | ~court | (F.size(noise) > 0)).alias("review"))
    found = once(once(df, {"__terms_low": F.lower(unaccented(F.col(text)))}), {name: F.when(gate, signals(low, bank)) for name, bank in banks.items()})
    gated = found.withColumn("notice", F.when(strong.isNotNull(), notice)).drop("__terms_low", *banks)
    return gated.withColumn("notice", F.when(F.col("notice.score") >= dec(keep_from), F.col("notice")))


def decide(a: Column, b: Column) -> Column:
    """(won: does a win, null if neither; score; tie) of two arrays of signals."""
    top = lambda x: F.coalesce(F.get(x, F.lit(0))["weight"], dec("0"))
    both = (F.size(a) > 0) & (F.size(b) > 0)
    tie = both & (F.abs(top(a) - top(b)) < dec(TIE))
    wins = top(a) >= top(b)
    more = F.when(wins, F.size(a)).otherwise(F.size(b))
    score = F.greatest(top(a), top(b)) + F.when(more > 1, dec(AGREE)).otherwise(dec("0")) - F.when(both, dec(OPPOSED)).otherwise(dec("0"))
    none = (F.size(a) == 0) & (F.size(b) == 0)
    return F.struct(
        F.when(~none & ~tie, wins).alias("won"),
        F.when(none, dec("0")).when(tie, F.least(top(a), top(b)) / 2).otherwise(F.greatest(dec("0"), F.least(dec(CAP), score))).cast("decimal(4,3)").alias("score"),
        tie.alias("tie"),
    )


def classify(df: DataFrame, text: str = "text", declared: str | None = None) -> DataFrame:
    """df plus nature, nature_score, zone, zone_score and zone_tie. A type stated by the source is one signal of 0.90."""
    low = F.col("__terms_low")
    banks = {"__terms_land": LAND, "__terms_goods": GOODS}
    land, goods = map(F.col, banks)
    if declared:
        own = F.struct(dec("0.90").alias("weight"), F.lit("tipo declarado pela fonte").alias("label"))
        land = F.when(F.col(declared) == "IMOVEL", F.concat(F.array(own), land)).otherwise(land)
        goods = F.when(F.col(declared) == "VEICULO", F.concat(F.array(own), goods)).otherwise(goods)
    found = once(once(df, {"__terms_low": F.lower(unaccented(F.coalesce(F.col(text), F.lit(""))))}), {name: signals(low, bank) for name, bank in banks.items()})
    out = found.withColumns({"__terms_land": land, "__terms_goods": goods}).withColumn("_nature", decide(*map(F.col, banks)))
    nature = F.when(F.col("_nature.won"), "IMOVEL").when(~F.col("_nature.won"), "MOVEL").otherwise("INDEFINIDA")
    zones = {"__terms_rural": RURAL, "__terms_urban": URBAN}
    out = once(out, {name: F.when(F.col("_nature.won"), signals(low, bank)) for name, bank in zones.items()})
    out = out.withColumn("_zone", F.when(F.col("_nature.won"), decide(*map(F.col, zones)))).drop("__terms_low", *banks, *zones)
    zone = F.when(F.col("_zone.won"), "RURAL").when(~F.col("_zone.won"), "URBANA").otherwise("INDEFINIDA")
    return out.withColumns({"nature": nature, "nature_score": F.col("_nature.score"), "zone": zone, "zone_score": F.coalesce(F.col("_zone.score"), dec("0")).cast("decimal(4,3)"), "zone_tie": F.coalesce(F.col("_zone.tie"), F.lit(False))}).drop("_nature", "_zone")


def asset_snippet(text: Column) -> Column:
    """The part of a notice that describes the asset, where one is set off by a label."""
    from ..functions.text import tidy

    return tidy(F.nullif(F.regexp_extract(text, r"(?is)(?:bem|bens|im[oó]vel|lote)\s*(?:penhorad[oa]s?|a\s+ser\s+leiload[oa]s?|objeto\s+d[oa]\s+leil[aã]o)?\s*[:;-]\s*(.{40,600})", 1), F.lit("")))


def auction_movements(movements: Column) -> Column:
    """Whether an array of docket movements mentions an auction."""
    return F.exists(movements, lambda m: comparable(m).rlike(r"leil|hasta|\bpraca\b|arremat|alienacao judicial"))


#: Words that vote for a kind of asset, each once.
ASSET_WORDS = {
    "IMOVEL": ("imovel", "apartamento", "casa", "terreno", "lote de terreno", "sala comercial", "galpao", "fazenda", "sitio", "chacara", "predio", "loja", "kitnet", "flat", "area rural", "gleba", "vaga de garagem"),
    "VEICULO": ("veiculo", "automovel", "carro", "moto", "motocicleta", "caminhao", "onibus", "reboque", "trator", "camionete", "utilitario", "van", "pick-up", "picape"),
}


def asset_vote(*texts: Column) -> Column:
    """The kind of asset that a listing's texts speak of; property of equals, OUTRO without any word."""
    return keyword_vote(F.concat_ws(" ", *texts), ASSET_WORDS, "OUTRO")


def keyword_vote(text: Column, banks: dict[str, tuple[str, ...]], otherwise: str) -> Column:
    """The kind with the most keywords in the text; the first of equals; otherwise if none occurs."""
    low = comparable(text)
    counts = [F.struct(reduce(lambda a, b: a + b, (F.contains(low, F.lit(w)).cast("int") for w in words)).alias("n"), F.lit(-i).alias("o"), F.lit(kind).alias("kind")) for i, (kind, words) in enumerate(banks.items())]
    best = F.array_max(F.array(*counts))
    return F.when(best["n"] > 0, best["kind"]).otherwise(otherwise)
