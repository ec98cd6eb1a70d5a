"""What rules need of a page's markup. Pages are parsed once, in Python, an Arrow batch at a time; all that follows from the parsed
columns is expressions. Null sources count as empty."""

from __future__ import annotations

import re
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hearthline.functions import urls
from hearthline.operators import pages as rules
from hearthline.operators.select import pieces
from hearthline.operators.tokens import DATA, START, tokens

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements that are counted where they have this attribute.
COUNTED = {"a": "href", "img": "src", "div": "class", "form": "action"}
LINK_ATTRIBUTES = ("data-href", "data-url", "data-link")
# Classes and ids by what they hold.
GALLERIES = (".gallery", ".fotos", ".property-photos")
DETAILS = (".property-details", ".imovel-detalhes", "#property-info")
CARDS = ("property-card", "imovel-item", "listing-item", "property-listing")
PAGINATION = (".pagination", ".paginacao", ".page-numbers")
FILTERS = (".filters", ".filtros", ".search-filters")
CONTENT_WORDS = ("quartos", "dormitórios", "banheiros", "suítes", "vagas", "área", "m²", "condomínio", "iptu", "financiamento")


class _Page:
    def __init__(self, url: str, html: str) -> None:
        self.url, self.open, self.texts = url, [], []
        self.classes: list[str] = []
        self.filled: dict[str, None] = {}
        #: So many of the open elements, the outer ones, are known to have text.
        self.full = 0
        #: Addresses of anchors, of buttons and forms, of attributes: each group in the order of the page.
        self.found: tuple[list[str], list[str], list[str]] = ([], [], [])
        self.counts = dict.fromkeys(COUNTED, 0)
        self.photos = 0
        for token in tokens(html):
            if token[0] == START:
                self._start(token[1], token[2])
            elif token[0] == DATA:
                self._data(token[1])
            else:
                self._end(token[1])

    def _start(self, tag: str, given: dict[str, str]) -> None:
        own = given.get("class", "").split()
        self.classes += own
        if tag in COUNTED and COUNTED[tag] in given:
            self.counts[tag] += 1
        names = [f".{c}" for c in own] + ([f"#{given['id']}"] if given.get("id") else [])
        if tag == "img" and "src" in given:
            self.photos += sum(any(g in held for _, held in self.open) for g in GALLERIES)
        if tag == "a":
            self.found[0].append(given.get("href", ""))
        elif tag == "form":
            self.found[1].append(given.get("action", ""))
        if tag in ("button", "input", "form"):
            self.found[1].append(opened(given.get("onclick", "")))
        if given:
            self.found[2].extend(given[a] for a in LINK_ATTRIBUTES if a in given)
        if tag not in VOID:
            self.open.append((tag, names))

    def links(self) -> list[str]:
        """Absolute addresses, each once: anchors first, then buttons and forms, then attributes."""
        given = (x.strip() for group in self.found for x in group)
        return [x for x in dict.fromkeys(_joined(self.url, x) for x in given if x and not x.startswith("#")) if x]

    def _end(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                self.full = min(self.full, k)
                break

    def _data(self, data: str) -> None:
        self.texts.append(data)
        if data.strip():
            # what stands around an element with text has that text too
            while self.full < len(self.open):
                for name in self.open[self.full][1]:
                    self.filled.setdefault(name)
                self.full += 1


def opened(onclick: str) -> str:
    """The address that a script opens: what is in quotes behind the first opening that it has; empty if there is none."""
    for begin in urls.ONCLICK:
        _, there, rest = onclick.partition(begin)
        address, closed, _ = rest.partition(begin[-1])
        if there and closed and address:
            return "" if address.strip().startswith(("#", "javascript:")) else address.strip()
    return ""


#: Absolute paths that joining leaves as they are, and bases that they can be put behind.
_ROOTED, _ORIGIN = re.compile(r"(?:/[A-Za-z0-9_-]+)+/?(?:\?[A-Za-z0-9_=&-]+)?", re.ASCII), re.compile(r"https?://[a-z0-9.-]+(?=[/?#]|\Z)", re.ASCII)


def _joined(base: str, link: str) -> str:
    origin = _ORIGIN.match(base)
    if origin and _ROOTED.fullmatch(link):
        return origin[0] + link
    try:
        return urljoin(base, link.strip())
    except ValueError:
        return ""


def parsed(pages: DataFrame, linked: bool = True) -> DataFrame:
    """pages: page_id, url, html. Per page: page_id, url, text, the numbers of links, images, divs with classes and forms, photos in
    galleries, all classes, the classes (with a dot) and ids (with a hash) of elements with text, and absolute links in order, each once;
    links only if they are asked for (linked)."""
    names = NAMES if linked else NAMES[:-1]

    def run(batches):
        for piece, given in pieces(batches):
            rows = []
            for page_id, url, html in zip(*given, strict=True):
                page = _Page(url or "", html or "")
                rows.append((page_id, url, "".join(page.texts), *page.counts.values(), page.photos, page.classes, list(page.filled), *([page.links()] if linked else [])))
            kinds = [piece.schema.field(0).type, pa.string(), pa.string(), *[pa.int32()] * 5, *[pa.list_(pa.string())] * (len(names) - 8)]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, link_count int, image_count int, div_count int, form_count int, photos int, classes array<string>, filled array<string>" + (", links array<string>" if linked else ""))


NAMES = ["page_id", "url", "text", "link_count", "image_count", "div_count", "form_count", "photos", "classes", "filled", "links"]


def _holds(names: tuple[str, ...]) -> Column:
    return F.arrays_overlap("filled", F.array(*[F.lit(n) for n in names]))


def features(found: DataFrame, *more: str) -> DataFrame:
    """What pattern learning counts on a page: prices, words, links, images, pagination and filters. Lengths count bytes. more: columns
    of the parsed pages that stay."""
    lower = F.lower("text")
    words = F.lit(0)
    for w in CONTENT_WORDS:
        words = words + rules.count(lower, w)
    says = lambda *parts: lower.rlike("|".join(parts))
    return found.select(
        "page_id",
        rules.prices(F.col("text")).alias("price_count"),
        F.octet_length("text").alias("text_length"),
        rules.count(lower, "quartos").alias("quartos_count"),
        rules.count(lower, "banheiros").alias("banheiros_count"),
        (rules.count(lower, "imóveis") + rules.count(lower, "imoveis")).alias("imoveis_count"),
        words.alias("property_keywords"),
        "link_count",
        "image_count",
        "div_count",
        "form_count",
        (_holds(PAGINATION[:2]) | says("próxima", "anterior")).alias("has_pagination"),
        (_holds(FILTERS[:2]) | says("filtrar", "ordenar")).alias("has_filters"),
        *more,
    )


def structure(found: DataFrame) -> DataFrame:
    """page_id, kind: property, catalog or null by the markup alone."""
    cards = F.size(F.filter("classes", lambda c: c.isin(*CARDS)))
    return found.select("page_id", rules.by_structure(_holds(DETAILS), F.col("photos"), cards, _holds(PAGINATION), _holds(FILTERS)).alias("kind"))


def common_classes(found: DataFrame, most: int = 10) -> DataFrame:
    """page_id, class, n: of each page the classes of more than three bytes that occur more than once, the most frequent first."""
    named = found.select("page_id", F.explode("classes").alias("class")).where(F.octet_length("class") > 3)
    counted = named.groupBy("page_id", "class").agg(F.count("*").alias("n")).where("n > 1")
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("n"), "class"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= most).select("page_id", "class", "n")


def links(found: DataFrame) -> DataFrame:
    return found.select("page_id", F.posexplode("links").alias("at", "link"))
