"""Declarative profiles of listing sites: which block is a lot, and where its fields stand.

A profile names a selector for a lot's block and, for each field, a selector, attribute, pattern, group, type, whether
it has several values, and a value in their absence. Selectors are a subset of CSS: tags, .class, #id, [attribute],
[attribute=v], *= $= ^=, descendants, and lists with commas.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from functools import lru_cache
from typing import Any, NamedTuple
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse
from .html import Node, Tree, card_nodes, mapped

FIELD = re.compile(r"([a-zA-Z][\w-]*)?((?:[.#][\w-]+|\[[^\]]+\])*)$")
PART = re.compile(r"([.#])([\w-]+)|\[\s*([\w-]+)\s*(?:([*^$]?=)\s*['\"]?([^'\"\]]*)['\"]?)?\s*\]")
#: Fixed value: what stands where an address is still to be filled in.
UNFILLED = "PREENCHER"
#: Fields that show that a block is a lot and not the page's furniture.
SIGNS = ("valor_avaliacao", "valor_minimo_primeira", "valor_minimo_segunda", "url_detalhe", "numero_processo", "data_primeira_praca")


class Field(NamedTuple):
    selector: str = ""
    attribute: str = ""
    pattern: str = ""
    group: int = 1
    kind: str = "texto"
    several: bool = False
    otherwise: str | None = None

    @classmethod
    def of(cls, spec: str | Mapping) -> Field:
        """From a profile's entry: a bare selector, or a mapping with the profile language's keys."""
        if isinstance(spec, str):
            return cls(selector=spec)
        names = {"seletor": "selector", "atributo": "attribute", "regex": "pattern", "grupo": "group", "tipo": "kind", "multiplo": "several", "padrao": "otherwise"}
        return cls(**{names[k]: v for k, v in spec.items()})


@lru_cache(maxsize=512)
def _compiled(selector: str) -> tuple[tuple[tuple[str, tuple], ...], ...]:
    """Alternatives of a selector, each a row of (tag, tests) from the outermost on. Unreadable parts are an error."""
    found = []
    for alternative in selector.split(","):
        steps = []
        for step in re.findall(r"(?:\[[^\]]*\]|[^\s\[])+", alternative):
            if not (m := FIELD.match(step)):
                raise ValueError(f"selector {selector!r}: {step!r}")
            tests = []
            for sign, name, attribute, how, value in PART.findall(m[2]):
                tests.append(("class", "~=", name) if sign == "." else ("id", "=", name) if sign else (attribute, how, value))
            steps.append((m[1] or "", tuple(tests)))
        if steps:
            found.append(tuple(steps))
    return tuple(found)


def _fits(node: Node, step: tuple[str, tuple]) -> bool:
    tag, tests = step
    if tag and node.tag != tag.lower():
        return False
    for name, how, value in tests:
        own = node.attributes.get(name)
        if own is None:
            return False
        if how == "~=" and value not in own.split() or how == "=" and own != value or how == "*=" and value not in own or how == "^=" and not own.startswith(value) or how == "$=" and not own.endswith(value):
            return False
    return True


def select(root: Node, selector: str) -> Iterator[Node]:
    """Nodes below root that the selector fits, in the order of the page."""
    alternatives = _compiled(selector)
    for node in root.below():
        for steps in alternatives:
            if not _fits(node, steps[-1]):
                continue
            rest, at = len(steps) - 2, node.parent
            while rest >= 0 and at is not None:
                if _fits(at, steps[rest]):
                    rest -= 1
                at = at.parent
            if rest < 0:
                yield node
                break


def raw_value(block: Node, words: str, field: Field, base: str) -> str | list[str] | None:
    """A field's text in a block: by selector first, else by pattern over the block's words; a pattern also refines
    what a selector found. Addresses are made absolute."""
    found: list[str] = []
    if field.selector:
        for node in select(block, field.selector):
            value = node.attributes.get(field.attribute) if field.attribute else node.words()
            if value:
                found.append(value)
                if not field.several:
                    break
    if field.pattern:
        pattern = re.compile(field.pattern, re.IGNORECASE | re.DOTALL)
        if found:
            found = [m[field.group] if (m := pattern.search(v)) else v for v in found]
        else:
            hits = pattern.finditer(words)
            found = [m[field.group] for m in hits] if field.several else [m[field.group] for m in [next(hits, None)] if m]
    if field.kind == "url":
        found = [urljoin(base, v.strip()) for v in found if v.strip()]
    if not found:
        return field.otherwise
    return found if field.several else found[0]


def blocks(root: Node, selector: str) -> list[Node]:
    return list(select(root, selector)) if selector else card_nodes(root)


def scraped_rows(html: str | None, item: str, fields: Mapping[str, Field], base: str) -> list[tuple[str, dict[str, str]]]:
    """(words, values) of each block that holds any sign of a lot; several values are joined by line ends."""
    rows = []
    for block in blocks(Tree(html or "").root, item):
        words = block.words()
        values: dict[str, str] = {}
        for name, field in fields.items():
            value = raw_value(block, words, field, base)
            if value is not None:
                values[name] = "\n".join(value) if isinstance(value, list) else value
        title = values.get("titulo") or words[:160].strip()
        if len(title) >= 4 and any(name in values for name in SIGNS):
            rows.append((words, {**values, "titulo": title[:300]}))
    return rows


def values(pages: DataFrame, profile: Mapping, key: str = "page_id", html: str = "html", base: str = "url") -> DataFrame:
    """(key, n, words, values map) of each lot's block on each page, values as texts."""
    fields = {name: Field.of(spec) for name, spec in profile["campos"].items()}
    item = profile.get("seletor_item", "")
    return mapped(pages, [key, html, base], "n int, words string, values map<string,string>", lambda page, address: [(w, list(v.items())) for w, v in scraped_rows(page, item, fields, address or "")])


def typed(rows: DataFrame, profile: Mapping, section: str = "campos") -> DataFrame:
    """rows of `values` with a column of its type for each field; several values become an array."""
    def column(name: str, spec: str | Mapping) -> Column:
        field, own = Field.of(spec), F.try_element_at("values", F.lit(name))
        if field.several:
            return F.filter(F.transform(F.split(own, "\n"), lambda v: parse.typed(v, field.kind)), lambda v: v.isNotNull()).alias(name)
        return parse.typed(own, field.kind).alias(name)

    return rows.select(*rows.columns, *(column(name, spec) for name, spec in profile[section].items()))


def with_details(lots: DataFrame, details: DataFrame, profile: Mapping, link: str = "url_detalhe", url: str = "url", html: str = "html") -> DataFrame:
    """lots with what their detail pages (url, html) add: only fields that the listing left open."""
    fields = {name: Field.of(spec) for name, spec in profile["campos_detalhe"].items()}

    def rows(page, address):
        root = Tree(page or "").root
        words = root.words()
        found = {n: raw_value(root, words, f, address or "") for n, f in fields.items()}
        return [([(n, "\n".join(v) if isinstance(v, list) else v) for n, v in found.items() if v is not None],)]

    told = mapped(details, [url, html, url], "n int, values map<string,string>", rows)
    made = typed(told, profile, "campos_detalhe").select(F.col(url).alias("_url"), *(F.col(n).alias(f"_{n}") for n in fields))
    both = lots.join(made.dropDuplicates(["_url"]), lots[link] == F.col("_url"), "left")
    new = [F.col(f"_{n}").alias(n) for n in fields if n not in lots.columns]
    return both.select(*((F.coalesce(lots[c], F.col(f"_{c}")) if c in fields else lots[c]).alias(c) for c in lots.columns), *new)


def read_profiles(path: str) -> list[dict[str, Any]]:
    """Profiles of a YAML file, with its anchors and merge keys. Needs a YAML library."""
    import yaml

    with open(path, encoding="utf-8") as file:
        return yaml.safe_load(file)["perfis"]


#: How a lot's fields look on most platforms, by parts of class names and by wording.
PLATFORM = {
    "seletor_item": "[class*=card], [class*=Card], [class*=lote], li[class*=item]",
    "campos": {
        "titulo": "h2, h3, [class*=titulo], [class*=title]",
        "url_detalhe": {"seletor": "a[href]", "atributo": "href", "tipo": "url"},
        "fotos": {"seletor": "img", "atributo": "src", "tipo": "url", "multiplo": True},
        "valor_avaliacao": {"regex": r"(?:avalia(?:ç|c)(?:ão|ao)|valor de avalia\w+)[^R]{0,40}R\$\s*([\d.,]+)", "tipo": "moeda"},
        "valor_minimo_primeira": {"regex": r"(?:1(?:ª|a)\s*pra(?:ç|c)a|primeiro leil(?:ã|a)o)[^R]{0,60}R\$\s*([\d.,]+)", "tipo": "moeda"},
        "valor_minimo_segunda": {"regex": r"(?:2(?:ª|a)\s*pra(?:ç|c)a|segundo leil(?:ã|a)o)[^R]{0,60}R\$\s*([\d.,]+)", "tipo": "moeda"},
        "data_primeira_praca": {"regex": r"1(?:ª|a)\s*pra(?:ç|c)a[^\d]{0,30}(\d{1,2}/\d{1,2}/\d{2,4}[^\n]{0,20})", "tipo": "data_hora"},
        "data_segunda_praca": {"regex": r"2(?:ª|a)\s*pra(?:ç|c)a[^\d]{0,30}(\d{1,2}/\d{1,2}/\d{2,4}[^\n]{0,20})", "tipo": "data_hora"},
        "numero_processo": {"tipo": "processo", "regex": r"(\d{7}-?\d{2}\.?\d{4}\.?\d\.?\d{2}\.?\d{4})"},
        "status": "[class*=status], [class*=situacao], [class*=badge]",
    },
    "campos_detalhe": {
        "descricao": "[class*=descricao], [class*=description], [class*=detalhe]",
        "url_edital": {"seletor": "a[href$='.pdf']", "atributo": "href", "tipo": "url"},
        "endereco": "[class*=endereco], [class*=localizacao], [class*=address]",
        "comissao_percentual": {"tipo": "percentual", "regex": r"comiss(?:ã|a)o[^%]{0,40}(\d{1,2}(?:[.,]\d)?\s*%)"},
        "matricula_imovel": {"regex": r"matr(?:í|i)cula\s*(?:n?[o°º.]?\s*)?([\d.-]{3,20})"},
        "area_total_m2": {"tipo": "area", "regex": r"(?:área|area)\s*(?:total|do terreno)?[^\d]{0,15}([\d.,]+\s*m(?:2|²))"},
    },
}
#: Fixed values: (slug, state, address, whether it was tried against the live site) of each profile.
SITES = (
    ("demo-leiloes-nordeste", "AL", "https://exemplo.invalid", True),
    ("superbid", "PE", "https://www.superbid.net", False),
    ("sodre-santoro", "PE", "https://www.sodresantoro.com.br", False),
    ("mega-leiloes", "PE", "https://www.megaleiloes.com.br", False),
    ("zuk-leiloes", "PE", "https://www.zukerman.com.br", False),
    ("vip-leiloes", "PE", "https://www.vipleiloes.com.br", False),
    ("daf-leiloes", "PE", "https://www.dafleiloes.com.br", False),
    ("freitas-leiloeiro", "PE", "https://www.freitasleiloeiro.com.br", False),
    ("leje-leiloes", "PE", "https://www.leje.com.br", False),
    ("regional-al-1", "AL", UNFILLED, False),
    ("regional-se-1", "SE", UNFILLED, False),
    ("regional-pe-1", "PE", UNFILLED, False),
    ("regional-ba-1", "BA", UNFILLED, False),
)


def sites(spark: SparkSession) -> DataFrame:
    """The profiles as connector rows (slug, kind, uf, validated, address), for sources.registry."""
    return spark.createDataFrame([(slug, "LEILOEIRO", uf, tried, address) for slug, uf, address, tried in SITES], "slug string, kind string, uf string, validated boolean, address string")


def gazettes(spark: SparkSession) -> DataFrame:
    """The six gazette connectors; one whose court serves several states has none of its own."""
    rows = [(f"djen-{court.lower()}", "DIARIO_OFICIAL", states[0] if len(states) == 1 else None, False, "https://comunicaapi.pje.jus.br") for court, states in parse.COURT_STATES.items()]
    return spark.createDataFrame(rows, "slug string, kind string, uf string, validated boolean, address string")

