"""HTML pages to rows, with the standard library's parser inside table functions that Spark spreads out."""

from __future__ import annotations

from collections import defaultdict
from html.parser import HTMLParser
from typing import Any
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import plain

VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
#: Elements that may be cards; at least so many of one tag and class on a page make a list of them.
CARD_TAGS, LEAST_CARDS = ("li", "article", "div", "section"), 3
#: Beginnings of links that lead to no page.
NO_PAGE = ("javascript:", "mailto:", "#")


class Node:
    __slots__ = ("attributes", "children", "parent", "tag", "text")

    def __init__(self, tag: str, attributes: dict, parent: Node | None) -> None:
        self.tag, self.attributes, self.parent, self.children, self.text = tag, attributes, parent, [], []

    def words(self, without: tuple[str, ...] = ("script", "style")) -> str:
        """The text below, without scripts and styles, in single blanks. Pages may nest to any depth."""
        pieces, waiting = [], [self]
        while waiting:
            piece = waiting.pop()
            if not isinstance(piece, Node):
                pieces.append(piece)
            elif piece is self or piece.tag not in without:
                waiting.extend(reversed(piece.text))
        return " ".join(" ".join(pieces).split())

    def below(self, without: tuple[str, ...] = ()):
        """Every node below, in the order of the page, without what stands in those of some tags."""
        waiting = list(reversed(self.children))
        while waiting:
            node = waiting.pop()
            if node.tag in without:
                continue
            yield node
            waiting.extend(reversed(node.children))

    def find(self, *tags: str):
        return (node for node in self.below() if node.tag in tags)


class Tree(HTMLParser):
    def __init__(self, html: str) -> None:
        super().__init__()
        self.root = self.at = Node("html", {}, None)
        self.feed(html)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        self.at.text.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.text.append(data)


def links_of(html: str | None) -> list[tuple[str, str]]:
    return [(a.attributes.get("href") or "", a.words()) for a in Tree(html or "").root.find("a") if a.attributes.get("href")]


def absolute(base: str | None, href: str) -> str:
    """The link seen from its page; as it stands where either is no address."""
    try:
        return urljoin(base or "", href.strip())
    except ValueError:
        return href.strip()


def page_links_of(html: str | None, base: str | None) -> list[tuple[str, str]]:
    """Absolute links to pages with the label of their first place, each once."""
    found: dict[str, str] = {}
    for href, label in links_of(html):
        if href.strip() and not href.strip().lower().startswith(NO_PAGE):
            found.setdefault(absolute(base, href), label)
    return list(found.items())


def table_rows_of(html: str | None, base: str | None = None) -> list[dict[str, str]]:
    """Filled rows of every table by its first row's cells in their comparison form. Same headers join, a cell beyond
    them is 'coluna_<place>', the first link's target is '<header>__href'. Tables inside a cell tell their own rows."""
    rows = []
    for t in Tree(html or "").root.find("table"):
        head: list[str] | None = None
        for tr in (n for n in t.below(("table",)) if n.tag == "tr"):
            cells = [c for c in tr.children if c.tag in ("td", "th")]
            if not cells:
                continue
            texts = [c.words(("script", "style", "table")) for c in cells]
            if head is None:
                head = [plain(x) for x in texts]
                continue
            row: dict[str, str] = {}
            for i, (cell, said) in enumerate(zip(cells, texts, strict=True)):
                name = head[i] if i < len(head) else f"coluna_{i}"
                row[name] = f"{row[name]} {said}".strip() if name in row else said
                if href := next((h for a in cell.below(("table",)) if a.tag == "a" and (h := a.attributes.get("href"))), None):
                    row.setdefault(f"{name}__href", absolute(base, href))
            if any(row.values()):
                rows.append(row)
    return rows


def card_nodes(root: Node) -> list[Node]:
    """The most elements of one tag and set of classes on the page, wherever they stand, three or more; of equally
    many those with most text, then the first. A single pass measures the text of all elements."""
    groups: dict[tuple[str, str], list[Node]] = defaultdict(list)
    nodes = list(root.below())
    for node in nodes:
        if node.tag in CARD_TAGS and (classes := (node.attributes.get("class") or "").split()):
            groups[node.tag, " ".join(sorted(classes))].append(node)
    most = max(map(len, groups.values()), default=0)
    if most < LEAST_CARDS:
        return []
    largest = [g for g in groups.values() if len(g) == most]
    if len(largest) == 1:
        return largest[0]
    size: dict[int, int] = defaultdict(int)  # letters of each element with a blank after each word
    for node in reversed(nodes):
        size[id(node)] += sum(len(w) + 1 for piece in node.text if isinstance(piece, str) for w in piece.split())
        if node.parent is not None and node.tag not in ("script", "style"):
            size[id(node.parent)] += size[id(node)]
    return max(largest, key=lambda g: sum(max(size[id(n)] - 1, 0) for n in g))


def cards_of(html: str | None) -> list[str]:
    return [c.words() for c in card_nodes(Tree(html or "").root)]


#: Letters of pages that a worker unpacks at once.
SLICE_LETTERS = 1 << 20


def mapped(pages: DataFrame, columns: list[str], schema: str, rows) -> DataFrame:
    """Rows (key, n, ...) of rows(*other columns) for each page; columns starts with the key. Batches are taken in
    slices of bounded size, a longer page by itself."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    out = pages.sparkSession.createDataFrame([], f"`{columns[0]}` {dict(pages.dtypes)[columns[0]]}, {schema}").schema
    arrow = to_arrow_schema(out)

    def batch_of(made: list[tuple[Any, ...]]):
        lists = list(zip(*made, strict=True)) or [[]] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(lists, arrow, strict=True)], schema=arrow)

    def run(batches):
        for batch in batches:
            made: list[tuple[Any, ...]] = []
            size = 0
            for i in range(batch.num_rows):
                k, *own = (c[i].as_py() for c in batch.columns)
                made += [(k, n, *r) for n, r in enumerate(rows(*own))]
                size += sum(len(x) for x in own if isinstance(x, str))
                if size > SLICE_LETTERS:
                    yield batch_of(made)
                    made, size = [], 0
            yield batch_of(made)

    # a page's address may stand in two places of the call
    picked = [F.col(c).alias(f"_{i}") for i, c in enumerate(columns)]
    return pages.select(*picked).mapInArrow(run, out)


def links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Every anchor with a target, as written."""
    return mapped(pages, [key, html], "n int, href string, label string", links_of)


def page_links(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """Links to other pages, absolute, each once on a page; n counts those that stay."""
    return mapped(pages, [key, html, url], "n int, href string, label string", page_links_of)


def tables(pages: DataFrame, key: str = "page_id", html: str = "html", url: str | None = None) -> DataFrame:
    """Rows of tables as maps; links are absolute where url names the column of the page's address."""
    return mapped(pages, [key, html, *([url] if url else [])], "n int, cells map<string,string>", lambda *page: [(list(r.items()),) for r in table_rows_of(*page)])


def cards(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    return mapped(pages, [key, html], "n int, text string", lambda t: [(x,) for x in cards_of(t)])


def pdf_links(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    return page_links(pages, key, html, url).filter(F.lower("href").rlike(r"\.pdf(\?|#|$)"))


#: Words of the headers that a register's and a court's tables are known by.
REGISTER_HEADERS = ("nome", "leiloeiro", "matricula", "registro", "situacao", "comarca")
NOTICE_HEADERS = ("processo", "comarca", "edital", "data", "leilao", "vara", "leiloeiro")


def known_tables(pages: DataFrame, headers: tuple[str, ...], least: int, key: str = "page_id", html: str = "html", url: str | None = None) -> DataFrame:
    """Rows of tables whose headers hold at least `least` of the words."""
    rows = tables(pages, key, html, url)
    names = F.array_join(F.filter(F.map_keys("cells"), lambda k: ~k.endswith("__href")), " ")
    hits = sum((F.contains(names, F.lit(h)).cast("int") for h in headers), F.lit(0))
    return rows.filter(hits >= least)


def by_label(*labels: str) -> Column:
    """The first filled cell whose header holds one of the labels, in the labels' order."""
    from ..functions.text import tidy

    def one(label: str) -> Column:
        named = F.map_filter("cells", lambda k, v: F.contains(k, F.lit(label)) & ~k.endswith("__href") & (F.trim(v) != ""))
        return tidy(F.get(F.map_values(named), F.lit(0)))

    return F.coalesce(*map(one, labels))


def first_href(*labels: str) -> Column:
    """A link's target in the first such cell; any cell's without labels."""
    def one(label: str) -> Column:
        return F.get(F.map_values(F.map_filter("cells", lambda k, _: F.contains(k, F.lit(label)) & k.endswith("__href"))), F.lit(0))

    return F.coalesce(*map(one, labels or ("",)))


def register_rows(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Auctioneers of a register's pages (name, licence, status, districts, email, phone, site): from tables with known
    headers, or on pages without such rows from repeated cards. Of one name and licence on a page the row with most
    contacts stays, the first of equals."""
    from ..functions.present import register_status
    from ..functions.text import comparable, districts, first_email, first_phone, first_site, tidy, unaccented

    contact = F.array_join(F.map_values(F.map_filter("cells", lambda k, _: ~k.endswith("__href"))), " ")
    site = first_href("site", "endereco eletronico", "pagina", "url")
    number = by_label("matricula", "registro", "numero", "jucep")
    licence = F.coalesce(F.nullif(F.regexp_extract(number, r"\b(\d{2,6}(?:[/-]\d{2,4})?)\b", 1), F.lit("")), number)
    columns = [by_label("nome", "leiloeiro", "razao social").alias("name"), licence.alias("licence"), register_status(by_label("situacao", "status", "condicao")).alias("status"), districts(by_label("comarca", "municipio", "atuacao", "sede")).alias("districts"), first_email(contact).alias("email"), first_phone(contact).alias("phone"), F.when(site.startswith("http"), site).alias("site")]
    listed = known_tables(pages, REGISTER_HEADERS, 1, key, html).select(key, "n", *columns)
    good = (F.length("name") >= 5) & ~comparable(F.col("name")).startswith("total")
    listed = listed.filter(good)
    rest = pages.join(listed.select(key).distinct(), key, "left_anti")
    found = mapped(rest, [key, html], "n int, head string, text string, hrefs array<string>", register_cards_of)
    low = unaccented(F.col("text"))
    own = [
        tidy(F.coalesce(F.nullif(F.col("head"), F.lit("")), F.substring_index("text", " | ", 1))).alias("name"),
        F.nullif(F.regexp_extract(low, r"(?i)(?:matricula|registro|jucea?l?|jucese|jucepe)\s*:?\s*(?:n[o.]?\s*)?([\w/-]+)", 1), F.lit("")).alias("licence"),
        register_status(F.col("text")).alias("status"), F.array().cast("array<string>").alias("districts"), first_email(F.col("text")).alias("email"), first_phone(F.col("text")).alias("phone"), F.coalesce(first_site(F.col("hrefs")), F.nullif(F.regexp_extract("text", r"(https?://[^\s,;)\"']+)", 1), F.lit(""))).alias("site"),
    ]
    carded = found.filter(F.length("text") >= 10).select(key, "n", *own).filter(good)
    every = listed.unionByName(carded)
    filled = sum((F.col(c).isNotNull().cast("int") for c in ("site", "email", "phone")), F.lit(0))
    best = every.groupBy(key, comparable(F.col("name")).alias("_name"), "licence").agg(F.max_by(F.struct(*every.columns), F.struct(filled, -F.col("n"))).alias("_row"))
    return best.select("_row.*")


def register_cards_of(html: str | None) -> list[tuple[str, str, list[str]]]:
    """(heading, texts between bars, link targets) of each card."""
    made = []
    for card in card_nodes(Tree(html or "").root):
        head = next((n.words() for n in card.find("h1", "h2", "h3", "h4", "strong", "b")), "")
        parts = [n.words() for n in card.children] or [card.words()]
        made.append((head, " | ".join(p for p in parts if p), [h for n in card.find("a") if (h := n.attributes.get("href"))]))
    return made


def court_notices(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """Notices of courts' pages (case_number, comarca, chamber, auctioneer, title, at, document): from tables with two
    known headers or more, or on pages without such rows from links to PDFs that speak of an auction."""
    from ..functions.parse import case_number, moment
    from ..functions.text import tidy

    body = F.array_join(F.map_values(F.map_filter("cells", lambda k, _: ~k.endswith("__href"))), " ")
    columns = [case_number(body).alias("case_number"), by_label("comarca", "circunscricao", "foro", "municipio").alias("comarca"), by_label("vara", "juizo", "unidade").alias("chamber"), by_label("leiloeiro", "responsavel").alias("auctioneer"), F.substring(by_label("edital", "leilao", "titulo", "objeto", "descricao"), 1, 300).alias("title"), moment(F.coalesce(by_label("data", "praca", "sessao", "realizacao"), body)).alias("at"), first_href().alias("document")]
    listed = known_tables(pages, NOTICE_HEADERS, 2, key, html, url).filter(F.length(body) >= 8).select(key, "n", *columns)
    listed = listed.filter("case_number is not null or title is not null or comarca is not null")
    rest = pages.join(listed.select(key).distinct(), key, "left_anti")
    label = F.coalesce(tidy(F.col("label")), F.substring_index("href", "/", -1))
    none = F.lit(None).cast("string")
    linked = pdf_links(rest, key, html, url).filter(F.concat_ws(" ", label, "href").rlike(r"(?i)edital|leil[aã]o|hasta|praça|praca"))
    linked = linked.select(key, "n", case_number(F.concat_ws(" ", label, "href")).alias("case_number"), none.alias("comarca"), none.alias("chamber"), none.alias("auctioneer"), F.substring(label, 1, 300).alias("title"), moment(label).alias("at"), F.col("href").alias("document"))
    return listed.unionByName(linked)
