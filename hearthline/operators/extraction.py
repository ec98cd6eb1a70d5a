"""Listing fields out of pages: the first acceptable text among the elements of a field's selectors, else a pattern in the page's text.
What is acceptable is an expression over the gathered columns. Lengths count bytes. Pages without any field give empty texts and zeros."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.functions import extract, hashing, text
from hearthline.functions.once import computed_once
from hearthline.operators import listings, select

# Selectors by field, in the order in which they are tried.
ADDRESS = (
    ".endereco", ".address", ".property-address", "[itemprop=address]", "#endereco", "#address", ".street-address", ".location", ".imovel-endereco", ".property-location",
    ".address-info", ".property-title", ".listing-address", ".imovel-titulo", ".endereco-imovel", ".local", ".localizacao", ".onde", "h1", "h2", "h3", ".titulo", ".title",
    ".nome-imovel", ".property-name", ".card-title", ".item-title", ".listing-title", "[data-address]", "[data-location]", "[data-endereco]",
)
PRICE = (
    ".valor", ".price", ".property-price", "[itemprop=price]", "#valor", "#price", ".value", ".amount", ".property-value", ".imovel-preco", ".valor-venda", ".valor-imovel",
    ".preco", ".preco-venda", ".valor-total", ".price-value", ".money", ".currency", ".cost", ".sale-price", "[data-price]", "[data-valor]", "[data-preco]",
    ".price-container", ".valor-container", ".preco-container", "strong", "b",
)
DESCRIPTION = (
    ".descricao", ".description", ".property-description", "[itemprop=description]", "#descricao", "#description", ".details", ".features", ".property-details",
    ".imovel-descricao", ".property-text", ".property-info", ".content", ".texto", ".info", ".informacoes", ".detalhes", ".property-content", ".listing-content",
    ".item-content", ".resumo", ".summary", ".sobre", ".about", "[data-description]", "[data-descricao]", "[data-content]", ".card-body", ".item-body", ".property-body",
)
FEATURE_ITEMS = ".caracteristicas li, .amenities li, .features li"
ADDRESS_PATTERNS = (
    r"R(?:ua|\.)\s+[^,\n]+,\s*\d+", r"Av(?:enida|\.)\s+[^,\n]+,\s*\d+", r"Pra(?:ça|\.)\s+[^,\n]+,\s*\d+", r"Est(?:rada|\.)\s+[^,\n]+,\s*\d+",
    r"Rod(?:ovia|\.)\s+[^,\n]+,\s*\d+", r"(?<![^,\n])[^A-Za-z,\n]*+[A-Z][^,\n]+ - [A-Z]{2}",
)
PRICE_PATTERNS = (r"R\$\s*[\d.,]+(?:\s*mil)?(?:\s*milhões?)?", r"(?:valor|preço|por)\s*:?\s*R\$\s*[\d.,]+", r"R\$\s*\d{1,3}(?:\.\d{3})*(?:,\d{2})?", r"\d{1,3}(?:\.\d{3})*(?:,\d{2})?\s*reais?")
GENERIC = {
    "price": (
        (".preco-imovel", ".valor-imovel", ".property-price", ".listing-price", ".price-value", ".valor-venda", ".preco-venda", ".imovel-preco"),
        (".preco", ".price", ".valor", ".value", "[class*='preco']", "[class*='price']", "[class*='valor']", ".currency", ".amount"),
        ("*[class*='R$']", "span:contains('R$')", "div:contains('R$')", "p:contains('R$')", ".money", ".cost"),
    ),
    "address": (
        (".endereco-imovel", ".property-address", ".listing-address", ".imovel-endereco", ".localizacao-imovel", ".property-location", ".address-info"),
        (".endereco", ".address", ".localizacao", ".location", "[class*='endereco']", "[class*='address']", "[class*='localizacao']", ".street-address"),
        (".locality", ".region", ".postal-code", "[itemprop='address']", "*[class*='rua']", "*[class*='avenida']", "*[class*='bairro']"),
    ),
    "description": (
        (".descricao-imovel", ".property-description", ".listing-description", ".imovel-descricao", ".property-details", ".detalhes-imovel"),
        (".descricao", ".description", ".detalhes", ".details", "[class*='descricao']", "[class*='description']", "[class*='detalhes']", ".property-info"),
        (".content", ".text", ".info", "[itemprop='description']", ".summary", ".overview", ".about"),
    ),
    "rooms": (
        (".quartos-imovel", ".dormitorios-imovel", ".property-bedrooms", ".imovel-quartos", ".bedrooms-count", ".rooms-count"),
        (".quartos", ".dormitorios", ".bedrooms", ".rooms", "[class*='quartos']", "[class*='dormitorios']", "[class*='bedrooms']", ".bed-count"),
        ("*:contains('quartos')", "*:contains('dormitórios')", "*:contains('bedrooms')", ".specifications li", ".features li", ".amenities li"),
    ),
    "bathrooms": (
        (".banheiros-imovel", ".property-bathrooms", ".imovel-banheiros", ".bathrooms-count", ".wc-count"),
        (".banheiros", ".bathrooms", ".wc", "[class*='banheiros']", "[class*='bathrooms']", ".bath-count"),
        ("*:contains('banheiros')", "*:contains('bathrooms')", "*:contains('wc')", ".specifications li", ".features li"),
    ),
    "area": (
        (".area-imovel", ".metragem-imovel", ".property-area", ".imovel-area", ".area-total", ".area-construida", ".built-area"),
        (".area", ".metragem", ".size", ".m2", "[class*='area']", "[class*='metragem']", "[class*='size']", ".square-meters"),
        ("*:contains('m²')", "*:contains('m2')", "*:contains('metros')", ".specifications li", ".features li"),
    ),
    "features": (
        (".caracteristicas-imovel", ".property-features", ".imovel-caracteristicas", ".property-amenities", ".listing-features", ".amenities-list"),
        (".caracteristicas", ".features", ".amenities", ".comodidades", "[class*='caracteristicas']", "[class*='features']", ".specifications"),
        (".extras", ".includes", ".highlights", ".benefits", "ul li", ".list-item", ".feature-item"),
    ),
    "type": (
        (".tipo-imovel", ".property-type", ".imovel-tipo", ".listing-type", ".property-category", ".category"),
        (".tipo", ".type", "[class*='tipo']", "[class*='type']", ".category-name", ".property-kind"),
        ("h1", "h2", ".title", ".heading", ".property-title", ".listing-title", "[itemprop='name']"),
    ),
}
ENHANCED_ITEMS = ".caracteristicas li, .features li, .amenities li, .specifications li"
NO_FEATURES = ("INÍCIO", "INICIO", "SOBRE NÓS", "CONTATO", "IMÓVEIS URBANOS", "IMÓVEIS RURAIS", "WHATSAPP", "E-MAIL", "FACEBOOK", "JAVASCRIPT", "FUNCTION")
STREET = r"(?iu)R(?:ua|\.)\s+[^,\n]+|Av(?:enida|\.)\s+[^,\n]+|VILA\s+[^,\n]+|JARDIM\s+[^,\n]+"
PRICE_SAID = r"R\$\s*[\d.,]+"
#: Cards of a catalogue: three sets, as three crawls look for them, and how many of a page's they read.
CARDS = {
    "legacy": (".imovel, .property, .card, .item, .listing, .property-card, .real-estate-item, [class*='imovel'], [class*='property'], [class*='listing']", None),
    "full": (".imovel, .property, .card, .item, .listing", 10),
    "improved": (".property-card, .imovel-item, .listing-item, .property, .imovel", 10),
}
CARD_TEXTS = (".endereco", ".address", ".location", ".street", ".preco", ".price", ".valor", ".value", ".descricao", ".description", ".details", ".info")
#: What a fingerprint looks at.
PRINTED = {
    "prices": (".price", ".valor", ".preco", "[class*=price]", "[class*=valor]", "[data-price]", ".property-price", ".listing-price"),
    "addresses": (".address", ".endereco", ".location", ".localizacao", "[class*=address]", "[class*=endereco]", "[class*=location]", ".property-address", ".listing-address"),
    "descriptions": (".description", ".descricao", ".details", ".detalhes", "[class*=description]", "[class*=descricao]", "[class*=details]", ".property-description", ".listing-description", "p"),
}
STREET_NUMBER = r"(?iu)R(?:ua|\.)\s+[\w\s]+,\s*\d+|Av(?:enida|\.)\s+[\w\s]+,\s*\d+"

META = "meta[name='description']"
BASIC_TEXTS = tuple(dict.fromkeys((*ADDRESS, *PRICE, *DESCRIPTION, "title")))
GENERIC_TEXTS = tuple(dict.fromkeys(s for tiers in GENERIC.values() for tier in tiers for s in tier))


def _first_pattern(value: Column, patterns: tuple[str, ...]) -> Column:
    """What the first pattern that occurs finds; empty if none does."""
    found = F.filter(F.array(*[F.regexp_extract(value, f"(?iu){p}", 0) for p in patterns]), lambda x: x != "")
    return F.coalesce(F.get(found, F.lit(0)), F.lit(""))


def address_in(value: Column) -> Column:
    """The last pattern, a city and its state, is looked for from the first letter behind a comma or line break only: a match from any
    letter after it would be part of that from the first, and looking from each takes the square of the text's length."""
    return listings.squeezed(F.regexp_replace(_first_pattern(value, ADDRESS_PATTERNS), r"\A[^\p{L}]+", ""))


def price_in(value: Column) -> Column:
    return listings.squeezed(_first_pattern(value, PRICE_PATTERNS))


def address() -> Column:
    return F.coalesce(listings.squeezed(select.first(ADDRESS, listings.like_address)), address_in(F.col("text")))


def price() -> Column:
    return F.coalesce(listings.squeezed(select.first(PRICE, listings.like_price)), price_in(F.col("text")))


def _described(selector: str, low: int = 0, high: int = 1 << 30) -> Column:
    """What all elements that describe say, each with a blank behind."""
    each = F.filter(select.listed(selector), lambda t: listings.like_description(t) & (F.octet_length(t) > low) & (F.octet_length(t) < high))
    return F.array_join(F.transform(each, lambda t: F.concat(t, F.lit(" "))), "")


def description() -> Column:
    meta = F.get(select.given(META, "content"), F.lit(0))
    paragraphs = _described("p")
    more = F.concat(paragraphs, F.when(F.octet_length(paragraphs) < 50, _described("div", 30, 1000)).otherwise(""))
    most = listings.squeezed(F.concat(more, F.when(F.octet_length(more) < 30, _described("span, td, li", 20, 500)).otherwise("")))
    return F.coalesce(listings.squeezed(select.first(DESCRIPTION, listings.like_description)), F.when(listings.like_description(meta), listings.squeezed(meta)), text.truncate(most, 3000))


#: What extracted() needs of a page: texts, lists and attributes, as select.gathered takes them; and what one field of it needs.
NEEDS = (BASIC_TEXTS, ("p", "div", "span, td, li", FEATURE_ITEMS), ((META, "content"),))
ADDRESS_NEEDS, PRICE_NEEDS, DESCRIPTION_NEEDS = (ADDRESS, (), ()), (PRICE, (), ()), (DESCRIPTION, ("p", "div", "span, td, li"), ((META, "content"),))


def gathered(pages: DataFrame, cards: str | None = None) -> DataFrame:
    """What extracted() needs of pages, or of each of their cards."""
    return select.gathered(pages, *NEEDS, cards)


def extracted(found: DataFrame) -> DataFrame:
    """Listings of gathered pages: page_id, card, url and the fields."""
    base = computed_once(found.select("page_id", "card", "url", address().alias("endereco"), price().alias("valor_texto"), description().alias("descricao"), select.listed(FEATURE_ITEMS).alias("items")))
    city, quarter = listings.location(F.concat_ws(" ", "endereco", "descricao"))
    items = F.filter("items", lambda t: (F.octet_length(t) > 3) & (F.octet_length(t) < 50))
    fields = base.select(
        "page_id", "card", "url", "endereco", "valor_texto", "descricao",
        extract.value(F.col("valor_texto")).alias("valor"), extract.rooms(F.col("descricao")).alias("quartos"), extract.baths(F.col("descricao")).alias("banheiros"),
        extract.area(F.col("descricao")).alias("area_total"), extract.kind(F.concat_ws(" ", "descricao", "endereco")).alias("tipo_imovel"),
        city.alias("cidade"), quarter.alias("bairro"), extract.cep(F.col("endereco")).alias("cep"), F.concat(listings.features(F.col("descricao")), items).alias("caracteristicas"),
    )
    return computed_once(fields)


# ---- tiers of selectors, learned for a host or generic ------------------------------------------


def accepted(kind: str, value: Column) -> Column:
    """Whether a text may be that field."""
    lower, n = F.lower(value), F.octet_length(value)
    no = lambda *parts: ~F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: lower.contains(p))
    if kind == "price":
        return lower.contains("r$") | lower.rlike(r"\d+[.,]\d+")
    if kind == "address":
        return (n > 10) & (n < 300) & no("javascript", "cookie", "todos os direitos")
    if kind == "description":
        return (n > 20) & (n < 2000) & no("javascript", "function")
    if kind in ("rooms", "bathrooms"):
        return (n < 50) & lower.rlike(r"\d|quarto|banheiro")
    if kind == "area":
        return (n < 100) & lower.rlike(r"m²|m2|\d\s*m")
    if kind == "features":
        return (n > 5) & (n < 1000) & no("javascript")
    return (n > 3) & (n < 500)


def _by_pattern(kind: str) -> Column:
    patterns = {"price": PRICE_SAID, "address": STREET, "rooms": r"\d+\s*(?:quartos?|dormitórios?)", "bathrooms": r"\d+\s*(?:banheiros?)", "area": r"\d+(?:[,.]\d+)?\s*m[²2]"}
    return F.trim(F.regexp_extract("text", patterns[kind], 0)) if kind in patterns else F.lit("")


def tiers(selectors: Column) -> Column:
    """Ranked selectors as primary (three), secondary (three more) and fallback (the rest)."""
    return F.struct(F.slice(selectors, 1, 3).alias("primary"), F.slice(selectors, 4, 3).alias("secondary"), F.when(F.size(selectors) > 6, F.slice(selectors, 7, 1000)).otherwise(F.array().cast("array<string>")).alias("fallback"))


def chosen(kind: str, learned: Column | None = None) -> tuple[Column, Column]:
    """(text, where it is from): by the host's learned selectors, the generic ones, or a pattern in the text."""
    flat = F.array(*[F.lit(s) for tier in GENERIC[kind] for s in tier])
    best = lambda selectors: F.get(select.valid(selectors, lambda t: accepted(kind, t)), F.lit(0))["text"]
    own = best(learned) if learned is not None else F.lit(None).cast("string")
    generic, said = best(flat), _by_pattern(kind)
    return F.coalesce(own, generic, said), F.when(own.isNotNull(), "domain_specific").when(generic.isNotNull(), "generic").when(said != "", "regex").otherwise("none")


#: From so many bytes on a field's text is not acceptable; prices may be of any length.
MOST = {"address": 300, "description": 2000, "rooms": 50, "bathrooms": 50, "area": 100, "features": 1000, "type": 500}
_MOST = {s: max(MOST.get(kind, 1 << 30) for kind in GENERIC if any(s in tier for tier in GENERIC[kind])) for s in GENERIC_TEXTS}


def gathered_enhanced(pages: DataFrame, more: tuple[str, ...] = (), cards: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """What enhanced() needs. Texts that are too long for all fields of their selector stay behind, unless there are selectors that were
    learned, which may be any field's: an element that holds the word for rooms is mostly the whole page."""
    bounds = {} if more else _MOST
    return select.gathered(pages, tuple(dict.fromkeys((*GENERIC_TEXTS, *more))), (ENHANCED_ITEMS,), (), cards, keep, bounds=bounds)


def _bounded(value: Column, most: int) -> Column:
    n = F.regexp_extract(value, r"\d+", 0).try_cast("int")
    return F.when((n > 0) & (n <= most), n).otherwise(0)


def enhanced(found: DataFrame, learned: str | None = None) -> DataFrame:
    """Listings of gathered_enhanced pages, by the selectors in the column learned (a map from field to selectors, null where nothing
    is known of the host) before the generic ones; and sources, a map from field to where its text is from."""
    of = lambda kind: F.try_element_at(learned, F.lit(kind)) if learned else None
    both = {kind: chosen(kind, of(kind)) for kind in GENERIC}
    base = computed_once(found.select("page_id", "card", "url", "text", select.listed(ENHANCED_ITEMS).alias("items"), *[v[0].alias(f"_{kind}") for kind, v in both.items()], F.create_map(*[x for kind, v in both.items() for x in (F.lit(kind), v[1])]).alias("sources")))
    area = F.replace(F.regexp_extract("_area", r"(\d+(?:[,.]\d+)?)\s*m[²2]", 1), F.lit(","), F.lit(".")).try_cast("double")
    is_feature = lambda t: (F.octet_length(t) > 3) & (F.octet_length(t) < 100) & ~F.upper(t).isin(*NO_FEATURES) & ~F.upper(t).rlike(r"HTTP|WWW\.|R\$")
    items = F.filter("items", is_feature)
    lines = F.filter(F.transform(F.split("_features", "\n"), F.trim), is_feature)
    given = F.when(F.size(items) > 0, items).otherwise(lines)
    distinct = F.filter(given, lambda t, i: F.array_position(F.transform(given, F.upper), F.upper(t)) == i + 1)
    city, quarter = listings.location(F.col("_address"))
    city = F.when(city == "", listings.known_city(F.col("text"))).otherwise(city)
    fields = base.select(
        "page_id", "card", "url", listings.squeezed(F.col("_address")).alias("endereco"), listings.squeezed(F.col("_price")).alias("valor_texto"), listings.squeezed(F.col("_description")).alias("descricao"),
        extract.value(F.col("_price")).alias("valor"), _bounded(F.col("_rooms"), 20).alias("quartos"), _bounded(F.col("_bathrooms"), 15).alias("banheiros"),
        F.when(area.between(10, 10_000), area).otherwise(0.0).alias("area_total"), extract.kind(F.when(F.col("_type") == "", F.concat_ws(" ", "_description", "_address")).otherwise(F.col("_type"))).alias("tipo_imovel"),
        city.alias("cidade"), quarter.alias("bairro"), extract.cep(F.concat_ws(" ", "_address", "text")).alias("cep"), F.slice(distinct, 1, 20).alias("caracteristicas"), "sources",
    )
    return computed_once(fields)


def selector_success(listings_of: DataFrame) -> DataFrame:
    """kind, source, n: how often a field's text came from where."""
    return listings_of.select(F.explode("sources").alias("kind", "source")).groupBy("kind", "source").agg(F.count("*").alias("n"))


# ---- listings from plain texts and from catalogues ----------------------------------------------


def from_texts(rows: DataFrame) -> DataFrame:
    """rows: id, endereco, cidade, descricao, valor_texto, url as found. The same with all fields that they give away."""
    clean = computed_once(rows.withColumns({c: listings.squeezed(F.coalesce(F.col(c), F.lit(""))) for c in ("endereco", "cidade", "descricao", "valor_texto")}))
    city, quarter = listings.location(F.col("endereco"))
    words = ("piscina", "churrasqueira", "garagem", "jardim", "varanda", "sacada")
    fields = clean.select(
        "id", "endereco", F.when(F.col("cidade") == "", city).otherwise(F.col("cidade")).alias("cidade"), quarter.alias("bairro"), extract.cep(F.col("endereco")).alias("cep"), "descricao", "valor_texto",
        extract.value(F.col("valor_texto")).alias("valor"), extract.rooms(F.col("descricao")).alias("quartos"), extract.baths(F.col("descricao")).alias("banheiros"), extract.area(F.col("descricao")).alias("area_total"),
        extract.kind(F.concat_ws(" ", "descricao", "endereco")).alias("tipo_imovel"), "url", extract.features(F.col("descricao"), words).alias("caracteristicas"),
    )
    return computed_once(fields)


def first_said(*selectors: str) -> Column:
    return F.coalesce(*[select.said(s) for s in selectors], F.lit(""))


PLAIN = {"endereco": (".endereco", ".address", ".localizacao"), "descricao": (".descricao", ".description", ".detalhes"), "valor_texto": (".preco", ".price", ".valor")}
PLAIN_TEXTS = tuple(s for group in PLAIN.values() for s in group)


def basic(found: DataFrame) -> DataFrame:
    """Listings from a page's plainest elements; found: pages gathered with PLAIN_TEXTS at least."""
    rows = found.select(
        F.col("page_id").alias("id"), first_said(*PLAIN["endereco"]).alias("endereco"), F.lit("").alias("cidade"),
        first_said(*PLAIN["descricao"]).alias("descricao"), first_said(*PLAIN["valor_texto"]).alias("valor_texto"), "url",
    )
    return from_texts(rows)


def catalog_items(pages: DataFrame) -> DataFrame:
    """page_id, card, url and fields of each card of a page; of pages without cards, of the text's blocks that begin with a price, fifteen
    at most."""
    found = select.gathered(pages, CARD_TEXTS, (".caracteristica, .feature, .amenity",), (), CARDS["legacy"][0])
    whole = F.trim("text")
    said = found.select(
        "page_id", "card", "url", "text",
        F.coalesce(F.nullif(first_said(".endereco", ".address", ".location", ".street"), F.lit("")), F.trim(F.regexp_extract("text", STREET, 0))).alias("endereco"),
        F.coalesce(F.nullif(first_said(".preco", ".price", ".valor", ".value"), F.lit("")), F.regexp_extract("text", PRICE_SAID, 0)).alias("valor_texto"),
        F.coalesce(F.nullif(first_said(".descricao", ".description", ".details", ".info"), F.lit("")), F.when((F.octet_length(whole) > 50) & (F.octet_length(whole) < 500), whole), F.lit("")).alias("descricao"),
    )
    cards = _item(computed_once(said).where((F.col("endereco") != "") | (F.col("valor_texto") != "")), F.concat_ws(" ", "descricao", "text"))
    texts = select.gathered(pages).join(cards.select("page_id").distinct(), "page_id", "left_anti")
    blocks = F.filter(F.transform(F.slice(F.regexp_extract_all("text", F.lit(r"(?is)(R\$\s*[\d.,]+.*?(?=R\$|\z))"), 1), 1, 15), F.trim), lambda b: F.octet_length(b) >= 10)
    plain = texts.select("page_id", "url", F.posexplode(blocks).alias("card", "text")).select(
        "page_id", "card", "url", "text", address_of_block(F.col("text")).alias("endereco"), F.regexp_extract("text", PRICE_SAID, 0).alias("valor_texto"), listings.squeezed(F.col("text")).alias("descricao")
    )
    return cards.unionByName(_item(plain, F.col("text")))


def address_of_block(block: Column) -> Column:
    """A quarter or street that a text without its prices names in capitals or not, or the text itself if it has five words at most."""
    bare = F.regexp_replace(block, PRICE_SAID, "")
    named = F.trim(F.regexp_extract(bare, r"(?iu)(?:VILA|JARDIM|CENTRO|BAIRRO|RUA|AV)[A-ZÁÊÇÕ\s,]+", 0))
    words = F.filter(F.split(bare, r"\s+"), lambda w: w != "")
    return F.when(named != "", named).when(F.size(words).between(1, 5), F.array_join(words, " ")).otherwise("")


def _item(rows: DataFrame, numbers: Column) -> DataFrame:
    fields = computed_once(rows).select(
        "page_id", "card", "url", "endereco", "valor_texto", "descricao", listings.known_city(F.concat_ws(" ", "endereco", "descricao")).alias("cidade"), extract.value(F.col("valor_texto")).alias("valor"),
        extract.kind(F.concat_ws(" ", "descricao", "endereco")).alias("tipo_imovel"), extract.rooms(numbers).alias("quartos"), extract.baths(numbers).alias("banheiros"), extract.area(numbers).alias("area_total"),
    )
    return computed_once(fields)


PRINT_NEEDS = ((), tuple(dict.fromkeys(s for group in PRINTED.values() for s in group)), ())


def fingerprints(pages: DataFrame) -> DataFrame:
    """page_id, hash of all prices, addresses and descriptions that a page shows."""
    return printed(select.gathered(pages, *PRINT_NEEDS))


def printed(found: DataFrame) -> DataFrame:
    """The same of pages that are gathered already, with PRINT_NEEDS at least."""
    return found.select("page_id", print_hash().alias("hash"))


def print_hash() -> Column:
    each = lambda kind, good: F.filter(F.flatten(F.array(*[select.listed(s) for s in PRINTED[kind]])), lambda t: (t != "") & good(t))
    prices = F.array_distinct(F.concat(each("prices", listings.like_price), F.regexp_extract_all("text", F.lit(f"({PRICE_SAID})"), 1)))
    addresses = F.array_distinct(F.concat(each("addresses", lambda t: F.octet_length(t) > 10), F.regexp_extract_all("text", F.lit(STREET_NUMBER.replace("(?iu)", "(?iu)(") + ")"), 1)))
    descriptions = F.array_distinct(each("descriptions", lambda t: (F.octet_length(t) > 50) & (F.octet_length(t) < 2000)))
    return hashing.content_hash(prices, addresses, descriptions)


COUNTED = (".property", ".imovel", ".listing", ".item", "[class*=property]", "[class*=imovel]", "[class*=listing]")


def most_cards(pages: DataFrame) -> DataFrame:
    """page_id, cards: the most elements of any one card selector that name a price or rooms."""
    found = select.gathered(pages, (), COUNTED)
    count = lambda s: F.size(F.filter(select.listed(s), lambda t: F.lower(t).rlike(r"r\$|quartos")))
    return found.select("page_id", F.greatest(*[count(s) for s in COUNTED]).alias("cards"))
