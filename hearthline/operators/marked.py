"""The markup's part in the rules that classify pages: scores by elements that are there or say something, for the expressions in pages."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.operators import classify, pages, select

# Groups of selectors and what they count if one of a group says something, or is there.
LISTING_ELEMENTS = (
    ((".property-details", ".imovel-detalhes", "#property-info", ".detalhes-imovel"), 2),
    ((".property-price", ".preco-imovel", ".valor-imovel"), 1),
    ((".property-address", ".endereco-imovel", ".localizacao"), 1),
    ((".contact-form", ".formulario-contato", ".agendar-visita"), 1),
)
PHOTOS = (".gallery img", ".fotos img", ".property-photos img", ".imovel-fotos img")
BASIC_DETAILS = (".property-details", ".imovel-detalhes", "#property-info")
BASIC_CARDS = (".property-card", ".imovel-item", ".listing-item", ".property-listing")
BASIC_PAGINATION, BASIC_FILTERS = (".pagination", ".paginacao", ".page-numbers"), (".filters", ".filtros", ".search-filters")
CONTENT_ELEMENTS = (
    (".price, .valor, .preco", 1.0), (".details, .detalhes, .caracteristicas", 1.0), (".gallery, .galeria, .fotos, .images", 1.0), (".contact, .contato, .telefone, .whatsapp", 0.5),
    ("meta[property='og:type'][content*='property']", 2.0),
)
#: Elements of a catalogue, and more than how many of them count.
CATALOG_ELEMENTS = (
    (".price, .valor, .preco, [class*='price'], [class*='valor']", 3, 2), (".pagination, .paginacao, [class*='page'], [class*='pagina']", 0, 1),
    (".filter, .filtro, [class*='filter'], select, input[type='range']", 2, 1),
)

_TEXTS = tuple(
    dict.fromkeys(
        (
            "title", "form", *[s for group, _ in LISTING_ELEMENTS for s in group], *BASIC_DETAILS, *BASIC_CARDS, *BASIC_PAGINATION, *BASIC_FILTERS, *[s for s, _ in CONTENT_ELEMENTS],
            *[s for s, _, _ in CATALOG_ELEMENTS],
        )
    )
)


#: What the scores need of a page: texts, lists and attributes, as select.gathered takes them.
NEEDS = (_TEXTS, (), tuple((s, "src") for s in PHOTOS))


def gathered(found: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """page_id, url, text as written, lower, title (both in lower case), and what the scores need."""
    return told(select.gathered(found, *NEEDS, keep=keep))


def told(rows: DataFrame) -> DataFrame:
    """The same of pages that are gathered already, with NEEDS at least."""
    return rows.withColumns({"lower": F.lower("text"), "title": F.lower(F.coalesce(select.said("title"), F.lit("")))})


def _says(group: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(s) for s in group]), lambda s: F.try_element_at("found", s).isNotNull())


def photos(group: tuple[str, ...] = PHOTOS) -> Column:
    return reduce(add, [F.size(select.given(s, "src")) for s in group])


def listing_score() -> Column:
    return reduce(add, [F.when(_says(group), points).otherwise(0) for group, points in LISTING_ELEMENTS])


def content_score() -> Column:
    asks = F.lower(F.coalesce(select.said("form"), F.lit(""))).rlike("interesse|contato|visita")
    return reduce(add, [F.when(select.number(s) > 0, points).otherwise(0.0) for s, points in CONTENT_ELEMENTS]) + F.when(asks, 1.0).otherwise(0.0)


def catalog_score() -> Column:
    return reduce(add, [F.when(select.number(s) > least, points).otherwise(0) for s, least, points in CATALOG_ELEMENTS])


def structure() -> Column:
    cards = reduce(add, [select.number(s) for s in BASIC_CARDS])
    return pages.by_structure(_says(BASIC_DETAILS), photos(PHOTOS[:3]), cards, _says(BASIC_PAGINATION), _says(BASIC_FILTERS))


def page() -> Column:
    return pages.page(F.col("url"), F.col("lower"), F.col("title"), structure())


def strict() -> Column:
    return pages.strict(F.col("url"), F.col("lower"), F.col("title"), listing_score(), photos())


def validated() -> tuple[Column, Column]:
    return pages.validated(F.col("lower"), content_score())


def navigation() -> tuple[Column, Column]:
    return pages.navigation(F.col("url"), F.col("lower"), catalog_score())


def by_phrases() -> tuple[Column, Column]:
    return pages.by_phrases(F.col("lower"), pages.prices(F.col("text")))


def individual() -> Column:
    """The precise rule of a single listing: sure enough by its words, and no catalogue by words or url."""
    return (classify.listing_score(F.col("lower")) >= 0.6) & ~classify.any_of(F.col("lower"), classify.CATALOG) & ~classify.is_catalog(F.col("url"), F.col("lower"))
