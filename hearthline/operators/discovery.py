"""Where a page leads: links to listings, to more pages of a catalogue and to catalogues, and buttons and forms that search. What is
found is a table of links by page; which were visited is joined out. Pages without any give no rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hearthline.functions import urls
from hearthline.functions.once import computed_once
from hearthline.operators import learn, links, select
from hearthline.sources.shared import kept

# Selectors of links by what they lead to, and words on links and buttons.
LISTING_LINKS = (
    "a[href*='/imovel/']", "a[href*='/propriedade/']", "a[href*='/detalhes/']", "a[href*='/property/']", "a[href*='/listing/']", "a[href*='/anuncio/']",
    ".property-card a", ".imovel-card a", ".listing-item a", ".property-link", ".imovel-link", ".card a", ".item a", ".resultado a", ".anuncio a",
    "[class*='property'] a", "[class*='imovel'] a", "[class*='listing'] a", "[class*='card'] a", "[class*='item'] a", "[class*='resultado'] a",
    ".results a", ".resultados a", ".listings a", ".properties a", ".imoveis a",
)
PAGINATION_LINKS = (".pagination a", ".paginacao a", ".page-numbers a", "a[href*='page=']", "a[href*='pagina=']", "a[href*='p=']", ".next", ".proximo", ".anterior", ".previous")
CATALOG_WORDS = ("ver todos", "todos os imóveis", "buscar imóveis", "comprar", "alugar", "venda", "aluguel", "apartamentos", "casas", "terrenos")
BUTTONS = (
    "button", "input[type='submit']", "input[type='button']", "a[role='button']", ".btn", ".button", "[class*='search']", "[class*='busca']", "[class*='pesquisa']",
    "[id*='search']", "[id*='busca']", "[id*='pesquisa']",
)
SEARCH_WORDS = (
    "buscar", "pesquisar", "search", "procurar", "encontrar", "ver todos", "todos os imóveis", "buscar imóveis", "comprar", "alugar", "venda", "aluguel", "apartamentos",
    "casas", "terrenos", "imóveis", "filtrar", "aplicar filtros", "pesquisa avançada",
)
SEARCH_NAMES = ("search", "busca", "pesquisa")
FIELD_NAMES = (
    "search", "busca", "pesquisa", "query", "q", "cidade", "city", "bairro", "neighborhood", "tipo", "type", "categoria", "category", "preco", "price", "valor", "value",
    "quartos", "rooms", "bedrooms", "area", "tamanho", "size",
)
BUTTON = ", ".join(BUTTONS)
SUBMITS = "input[type='submit'], button[type='submit'], button:not([type])"
FIELDS = "input, select, textarea"
ANCHORS = "a[href]"


def _found(pages: DataFrame, selectors: tuple[str, ...], says: Callable[[Column], Column] | None = None) -> DataFrame:
    """page_id, base, selector, place, link, label: every element of the selectors that leads somewhere; with says, of those whose label
    says so, and only their addresses are resolved."""
    gathered = select.gathered(pages, (), selectors, tuple((s, "href") for s in selectors))
    one = gathered.select("page_id", F.col("url").alias("base"), "listed", F.explode("given").alias("key", "hrefs"))
    one = one.select("page_id", "base", F.col("key").substr(F.lit(1), F.length("key") - len("@href")).alias("selector"), "listed", F.posexplode("hrefs").alias("place", "href"))
    label = F.coalesce(F.get(F.try_element_at("listed", F.col("selector")), F.col("place")), F.lit(""))
    named = one.select("page_id", "base", "selector", "place", F.lower(label).alias("label"), "href")
    if says is not None:
        named = computed_once(named).where(says(F.col("label")))
    rows = computed_once(named.select("page_id", "base", "selector", "place", "label", urls.resolved(F.trim("href"), F.col("base")).alias("link")))
    return rows.where("link <> ''")


def _ranked(found: DataFrame, selectors: tuple[str, ...]) -> DataFrame:
    """Of found links those of some selectors, with the place of their selector as rank."""
    return found.where(F.col("selector").isin(*selectors)).withColumn("rank", F.array_position(F.array(*[F.lit(s) for s in selectors]), F.col("selector")).cast("int") - 1)


def links_of(pages: DataFrame) -> DataFrame:
    """What listing_links, pagination_links and catalog_links look at, as a table: pages are parsed once for all three."""
    return kept(_found(pages, tuple(dict.fromkeys((*LISTING_LINKS, *PAGINATION_LINKS, ANCHORS)))), "links")


def _firsts(rows: DataFrame, most: int | None, together: bool = False) -> DataFrame:
    """page_id, at, link: each link of a page once, by where it was first found, the first so many. A page's rows meet once, and stay
    together for both steps; together: they have met already."""
    first = (rows if together else rows.select("page_id", "link", "rank", "place").repartition("page_id")).groupBy("page_id", "link").agg(F.min(F.struct("rank", "place")).alias("first"))
    at = F.row_number().over(Window.partitionBy("page_id").orderBy("first", "link")) - 1
    numbered = first.select("page_id", at.alias("at"), "link")
    return numbered.where(F.col("at") < most) if most is not None else numbered


def unvisited(found: DataFrame, visited: DataFrame | None) -> DataFrame:
    return found if visited is None else found.join(visited.select(F.col("url").alias("link")).distinct(), "link", "left_anti")


def listing_links(pages: DataFrame | None, visited: DataFrame | None = None, most: int = 30, found: DataFrame | None = None) -> DataFrame:
    """page_id, at, link of a catalogue's listings: by selectors; on pages where these find none, by all links that look like listings,
    and where there are none of these either, by numbers at the end or paths on the same site. found: links_of pages."""
    selectors = (*LISTING_LINKS, ANCHORS)
    every = _ranked(_found(pages, selectors) if found is None else found, selectors)
    link, last = F.col("link"), len(LISTING_LINKS)
    like = links.like_listing(link)
    tier = F.when((F.col("rank") < last) & like, 0).when((F.col("rank") == last) & like, 1)
    loose = link.contains(F.col("base")) & (link.rlike(r"/\d+/?\z") | links.has_any(link, ("/imovel", "/propriedade", "/detalhes")))
    tiered = unvisited(every, visited).withColumn("tier", F.coalesce(tier, F.when((F.col("rank") == last) & loose, 2))).where("tier IS NOT NULL")
    best = tiered.withColumn("best", F.min("tier").over(Window.partitionBy("page_id"))).where("tier = best")
    return _firsts(best, most, together=True)


def host_links(pages: DataFrame, visited: DataFrame | None = None) -> DataFrame:
    """page_id, at, link: all links of a page that stay on its host and are pages to read."""
    every = _ranked(_found(pages, (ANCHORS,)), (ANCHORS,))
    return _firsts(unvisited(every.where(links.internal(F.col("link"), urls.host(F.col("base")))), visited), None)


def _own(pages: DataFrame) -> DataFrame:
    """All links of a page that mention its host."""
    every = _ranked(_found(pages, (ANCHORS,)), (ANCHORS,))
    return every.where(F.col("link").contains(urls.host(F.col("base"))))


def likely_links(pages: DataFrame) -> DataFrame:
    """page_id, n, links: a row for each page with links of its host that look like a listing's by path or code, no contacts; n with
    repeats, links each once."""
    no_contact = ~links.has_any(F.col("link"), ("whatsapp", "mailto:"))
    likely = _own(pages).where(no_contact & links.likely_listing_or_code(F.col("link")))
    return likely.groupBy("page_id").agg(F.count("*").alias("n"), F.collect_set("link").alias("links"))


def matched_links(pages: DataFrame, patterns: DataFrame | None, least: float = 0.5) -> DataFrame:
    """link, each once: links of a page's host that a learned pattern (training.url_patterns) matches with more than the least, or else
    that look like a listing's by path or code."""
    found = kept(_own(pages).select("link").distinct(), "links")
    likely = links.likely_listing_or_code(F.col("link"))
    by_rule = found.where(likely)
    if patterns is None:
        return by_rule
    # what looks like a listing's is taken anyway
    rest = found.where(~likely)
    scored = learn.best_reference(rest.select(F.col("link").alias("id"), F.col("link").alias("url")), patterns)
    return by_rule.unionByName(scored.where(F.col("score") > least).select(F.col("id").alias("link")))


def pagination_links(pages: DataFrame | None, visited: DataFrame | None = None, most: int = 5, found: DataFrame | None = None) -> DataFrame:
    """page_id, at, link of more pages: pagination's elements that say so or are numbers, the first so many."""
    says = lambda label: links.has_any(label, ("próxima", "next", "página")) | label.rlike(r"\A\d+\z")
    every = _ranked(_found(pages, PAGINATION_LINKS, says) if found is None else found.where(says(F.col("label"))), PAGINATION_LINKS)
    return _firsts(unvisited(every, visited), most)


def catalog_links(pages: DataFrame | None, visited: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """page_id, at, link whose words promise a catalogue."""
    says = lambda label: links.has_any(label, CATALOG_WORDS)
    every = _ranked(_found(pages, (ANCHORS,), says) if found is None else found.where(says(F.col("label"))), (ANCHORS,))
    return _firsts(unvisited(every, visited), None)


def _part(name: Column, words: tuple[str, ...]) -> Column:
    return links.has_any(F.lower(name), words)


def _attribute(name: str) -> Column:
    """An attribute of a gathered element, empty where it lacks it."""
    return F.coalesce(F.get(select.given("", name), F.lit(0)), F.lit(""))


def _label(text: Column, value: Column, title: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.nullif(value, F.lit("")), F.nullif(title, F.lit("")), F.lit(""))


def _button_points(label: Column, classes: Column, name: Column) -> Column:
    points = F.when(_part(label, SEARCH_WORDS), 0.3).otherwise(0.0) + F.when(_part(classes, SEARCH_NAMES), 0.2).otherwise(0.0) + F.when(_part(name, SEARCH_NAMES), 0.2).otherwise(0.0)
    return F.round(points, 9)


def _form_points(names: Column, hints: Column, said: Column) -> Column:
    spoken = lambda some: F.size(F.filter(F.transform(some, F.lower), lambda x: links.has_any(x, FIELD_NAMES)))
    points = 0.2 * F.greatest(spoken(names), F.least(spoken(hints), F.size(names)))
    points = points + F.when(_part(said, ("buscar", "pesquisar", "search")), 0.3).otherwise(0.0) + F.when(F.size(names) >= 2, 0.2).otherwise(0.0)
    return F.round(points, 9)


#: What is looked for within a form, and what its button says.
FORM_NEEDS = ((), (SUBMITS,), ((FIELDS, "name"), (FIELDS, "placeholder"), (SUBMITS, "value")))


def _submit() -> Column:
    return F.coalesce(F.nullif(F.get(select.listed(SUBMITS), F.lit(0)), F.lit("")), F.get(select.given(SUBMITS, "value"), F.lit(0)), F.lit(""))


def buttons(pages: DataFrame, least: float = 0.3) -> DataFrame:
    """page_id, label, confidence of buttons that search: 0.3 for what they say, 0.2 each for class and id; above the least."""
    found = select.elements(pages, BUTTON, ("value", "title", "class", "id"))
    label = _label(F.col("text"), F.col("value"), F.col("title"))
    return found.select("page_id", label.alias("label"), _button_points(label, F.col("class"), F.col("id")).alias("confidence")).where(F.col("confidence") > least)


def forms(pages: DataFrame, least: float = 0.3) -> DataFrame:
    """page_id, action, method, fields, confidence of forms that search: 0.2 for each field with such a name, 0.3 for a button that says so,
    0.2 for two fields or more; above the least."""
    inner = select.gathered(pages, *FORM_NEEDS, "form", own=("action", "method"))
    names, hints = select.given(FIELDS, "name"), select.given(FIELDS, "placeholder")
    found = computed_once(inner.select("page_id", "url", _attribute("action").alias("action"), _attribute("method").alias("method"), F.size(names).alias("fields"), _form_points(names, hints, _submit()).alias("confidence"))).where(F.col("confidence") > least)
    action = F.when(F.col("action") == "", F.col("url")).otherwise(urls.resolved(F.col("action"), F.col("url")))
    return found.select("page_id", action.alias("action"), F.when(F.col("method") == "", "GET").otherwise(F.upper("method")).alias("method"), "fields", "confidence")


def interactive(pages: DataFrame, least: float = 0.3) -> DataFrame:
    """page_id, buttons, forms: how many of a page's search, as buttons and forms tell them. Each page is parsed once for both, and its
    rows meet once. Links of navigation never count: their highest score is below their bound."""
    found = select.gathered(pages, *FORM_NEEDS, f"form, {BUTTON}", own=("value", "title", "class", "id"), kinds=("form", BUTTON), outer=True)
    label = _label(F.col("text"), _attribute("value"), _attribute("title"))
    each = computed_once(
        found.select(
            "page_id", (select.number("form") > 0).alias("form"), (select.number(BUTTON) > 0).alias("button"), F.lower(label).alias("label"), _attribute("class").alias("class"), _attribute("id").alias("id"),
            select.given(FIELDS, "name").alias("names"), select.given(FIELDS, "placeholder").alias("hints"), _submit().alias("said"),
        )
    )
    # points are counted only where an element is one
    button = F.when(F.col("button"), _button_points(F.col("label"), F.col("class"), F.col("id"))) > least
    form = F.when(F.col("form"), _form_points(F.col("names"), F.col("hints"), F.col("said"))) > least
    return each.groupBy("page_id").agg(F.count_if(button).alias("buttons"), F.count_if(form).alias("forms"))


#: What a button's words lead to, the first that occurs; a search otherwise. Fixed values.
BUTTON_PATHS = (
    ("buscar", "/busca"), ("pesquisar", "/pesquisa"), ("search", "/search"), ("ver todos", "/imoveis"), ("todos os imóveis", "/imoveis"), ("buscar imóveis", "/busca-imoveis"),
    ("comprar", "/venda"), ("alugar", "/aluguel"), ("venda", "/venda"), ("aluguel", "/aluguel"), ("apartamentos", "/venda/apartamento"), ("casas", "/venda/casa"),
    ("terrenos", "/venda/terreno"), ("imóveis", "/imoveis"),
)


def button_url(label: Column, base: Column) -> Column:
    """Where a button that has no address leads, by its words."""
    path = F.lit("/busca")
    for word, leads in reversed(BUTTON_PATHS):
        path = F.when(F.lower(label).contains(word), leads).otherwise(path)
    return F.concat(F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", 0), path)


def navigated(found: DataFrame, kind: str) -> DataFrame:
    """page_id, at, link in the order of visits: of a catalogue (kind column) its listings and then its further pages, of other pages
    the catalogues. found: page_id, kind, source (listing, pagination, catalog), at, link."""
    rank = F.when(F.col(kind) == "catalog", F.when(F.col("source") == "listing", 0).when(F.col("source") == "pagination", 1)).otherwise(F.when(F.col("source") == "catalog", 0))
    ranked = found.withColumn("rank", rank).where("rank IS NOT NULL")
    order = Window.partitionBy("page_id").orderBy("rank", "at", "link")
    return ranked.withColumn("at", F.row_number().over(order) - 1).select("page_id", "at", "link")

