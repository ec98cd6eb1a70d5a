"""What is learned from example pages: selectors that work on a host, features of a kind of page, words and elements that most valid
pages share. Pages are analysed a row each; what is learned is aggregates over them. Empty tables teach nothing."""

from __future__ import annotations

from functools import reduce
from operator import add

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.functions import urls
from hearthline.functions.once import computed_once
from hearthline.operators import learn, markup, select
from hearthline.operators import pages as rules
from hearthline.sources import files
from hearthline.sources.shared import kept

# Selectors that are tried on reference pages, by field.
PROBED = {
    "price": (".preco", ".price", ".valor", ".value", ".property-price", ".imovel-preco", "[class*='preco']", "[class*='price']", "[class*='valor']"),
    "address": (".endereco", ".address", ".location", ".localizacao", ".property-address", "[class*='endereco']", "[class*='address']", "[class*='location']"),
    "description": (".descricao", ".description", ".detalhes", ".details", ".property-description", "[class*='descricao']", "[class*='description']", "[class*='detalhes']"),
    "features": (".caracteristicas", ".features", ".amenities", ".comodidades", "[class*='caracteristicas']", "[class*='features']"),
    "rooms": (".quartos", ".dormitorios", ".bedrooms", ".rooms", "[class*='quartos']", "[class*='dormitorios']"),
    "area": (".area", ".metragem", ".size", ".m2", "[class*='area']", "[class*='metragem']"),
}
PRICE_PATTERNS = (r"R\$\s*[\d.,]+", r"\$\s*[\d.,]+", r"[\d.,]+\s*reais?", r"Valor:?\s*R\$\s*[\d.,]+", r"Preço:?\s*R\$\s*[\d.,]+")
PRICE_ELEMENTS = (
    ".price", ".valor", ".preco", ".value", "[class*='price']", "[class*='valor']", "[class*='preco']", "[id*='price']", "[id*='valor']", "[id*='preco']",
    ".property-price", ".listing-price", ".item-price",
)
DETAIL_ELEMENTS = (
    ".details", ".detalhes", ".caracteristicas", ".features", ".property-details", ".listing-details", ".item-details", "[class*='detail']", "[class*='caracteristic']",
    "[class*='feature']", ".specs", ".specifications", ".info",
)
DETAIL_WORDS = ("quartos", "dormitórios", "suítes", "banheiros", "área", "m²", "m2", "metros", "garagem", "vagas", "estacionamento", "condomínio", "iptu")
IMPORTANT = ("h1", "h2", "h3", ".title", ".titulo", ".description", ".descricao", ".content", ".conteudo", ".property", ".imovel", ".listing", ".anuncio", ".contact", ".contato", ".phone", ".telefone")
KEYWORDS = (
    "casa", "apartamento", "terreno", "sitio", "chacara", "lote", "sobrado", "cobertura", "loft", "studio", "comercial", "kitnet", "loja", "sala", "galpao", "barracao",
    "fazenda", "rural", "residencial", "imovel", "propriedade", "edificio", "predio", "venda", "aluguel", "locacao", "comprar", "alugar", "vender", "negocio",
    "oportunidade", "investimento", "financiamento", "quartos", "dormitorios", "banheiros", "suites", "garagem", "vagas", "area", "metros", "m²", "m2", "condominio",
    "iptu", "escritura", "piscina", "jardim", "churrasqueira", "sacada", "varanda", "preco", "valor", "reais", "mil", "milhao", "parcelas", "entrada", "financiado",
    "vista", "negociavel",
)
CATALOG_TEXT = ("imóveis", "resultados", "encontrados", "buscar", "filtrar", "ordenar", "página", "próxima", "anterior", "listagem", "catálogo", "pesquisa", "busca", "filtros")
PROPERTY_TEXT = ("detalhes", "descrição", "características", "localização", "galeria", "fotos", "contato", "agendar", "visita", "proprietário", "corretor", "exclusivo")
PHONE, EMAIL = r"\(\d{2}\)\s*\d{4,5}-?\d{4}", r"(?<![a-zA-Z0-9._%+-])[a-zA-Z0-9._%+-]++@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
#: Numbers and flags of a reference page that a host's pattern keeps.
NUMBERS = ("text_length", "title_length", "price_count", "phone_count", "email_count", "property_keywords")
FLAGS = ("has_gallery", "has_contact_form", "has_pagination", "has_filters")


def probed(kind: str, value: Column) -> Column:
    """Whether a text shows that a selector finds the field."""
    lower, n = F.lower(value), F.octet_length(value)
    return {
        "price": lower.contains("r$") | lower.rlike(r"\d+[.,]\d+"),
        "address": (n > 10) & (n < 200) & lower.rlike("rua|av|jardim|vila"),
        "description": (n > 20) & (n < 1000),
        "rooms": lower.rlike("quarto|dormitório"),
        "area": lower.rlike("m²|m2"),
    }.get(kind, (n > 5) & (n < 500))


def reference_pages(pages: DataFrame, title: str | None = None) -> DataFrame:
    """page_id, url, host, numbers and flags of a page, and selectors: a map from field to those that find it there. title: a column of
    pages that has their titles; else these are parsed."""
    texts = tuple(dict.fromkeys(("title", "form", *[s for group in PROBED.values() for s in group])))
    gathered = select.gathered(pages, texts, (), (("img", "src"),), keep=(title,) if title else ())
    found = computed_once(gathered.select("page_id", "url", "text", F.lower("text").alias("lower"), "found", "given", (F.col(title) if title else select.said("title")).alias("title")))
    lower = F.col("lower")
    there = lambda kind: lambda s: F.try_element_at("found", s).isNotNull() & probed(kind, F.try_element_at("found", s))
    fits = {kind: F.filter(F.array(*[F.lit(s) for s in group]), there(kind)) for kind, group in PROBED.items()}
    # an address of mail has an at sign: texts without one need not be searched by the pattern
    mails = F.when(F.col("text").contains("@"), F.regexp_count("text", F.lit(EMAIL))).otherwise(0)
    return found.select(
        "page_id", "url", urls.host(F.col("url")).alias("host"),
        F.octet_length("text").alias("text_length"), F.coalesce(F.octet_length("title"), F.lit(0)).alias("title_length"),
        F.regexp_count("text", F.lit(PRICE_PATTERNS[0])).alias("price_count"), F.regexp_count("text", F.lit(PHONE)).alias("phone_count"), mails.alias("email_count"),
        reduce(add, [rules.count(lower, w) for w in markup.CONTENT_WORDS]).alias("property_keywords"),
        (F.size(select.given("img", "src")) > 5).alias("has_gallery"), select.said("form").isNotNull().alias("has_contact_form"),
        (lower.contains("próxima") | lower.contains("anterior")).alias("has_pagination"), (lower.contains("filtrar") | lower.contains("ordenar")).alias("has_filters"),
        F.map_filter(F.create_map(*[x for kind, s in fits.items() for x in (F.lit(kind), s)]), lambda _, s: F.size(s) > 0).alias("selectors"),
    )


def selectors_by(examples: DataFrame, key: str) -> DataFrame:
    """key, selectors: a map from field to selectors, in the order in which they were first seen. examples: key, seq, selectors."""
    each = examples.select(key, "seq", F.explode("selectors").alias("kind", "list"))
    # many pages have the same list, which is taken apart once, where it was first seen
    seen = each.groupBy(key, "kind", "list").agg(F.min("seq").alias("seq")).select(key, "seq", "kind", F.posexplode("list").alias("place", "selector"))
    first = seen.groupBy(key, "kind", "selector").agg(F.min(F.struct("seq", "place")).alias("at"))
    lists = first.groupBy(key, "kind").agg(F.array_sort(F.collect_list(F.struct("at", "selector"))).alias("all"))  # no more than are tried
    return lists.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("kind", F.col("all.selector").alias("list")))).alias("selectors"))


#: Numbers that are folded are from 0 up to below this.
MOST = 1 << 62


class Halves:
    """What a run of numbers does to the running half x before it: each number a makes x the integer part of (x + a) / 2.

    That is associative: after a, then b, x is the integer part of (x + a + 2 b) / 4. So n numbers make it that of (x + total) / 2**n,
    and once 2**n is beyond all numbers only two values are left, low and, from x = jump on, low + 1. A run is as small as a number,
    however long it is, and runs combine in order."""

    __slots__ = ("n", "total", "low", "jump")

    def __init__(self, n: int = 0, total: int = 0, low: int = 0, jump: int = MOST) -> None:
        self.n, self.total, self.low, self.jump = n, total, low, jump

    def add(self, number: int) -> None:
        if self.n < 62:
            self.total += number << self.n
            self.n += 1
            if self.n == 62:
                self.low, rest = divmod(self.total, MOST)
                self.jump = MOST - rest
        else:
            low, high = (self.low + number) // 2, (self.low + 1 + number) // 2
            self.low, self.jump = low, self.jump if high > low else MOST

    def of(self, x: int) -> int:
        return (x + self.total) >> self.n if self.n < 62 else self.low + (x >= self.jump)


def folded(examples: DataFrame, key: str) -> DataFrame:
    """key, n and, in the order of seq, each number as the running half of the sum with the next (an integer each time), and each flag
    if it ever was. The order decides; examples are dealt by ranges of key and seq, so a key with many goes through many tasks, each
    of which sums its run up, and runs, one for each task, are combined in order. Numbers are 0 or more; examples of one seq are
    taken in the order of their numbers."""
    kind = examples.schema[key].dataType.simpleString()
    dealt = examples.select(key, "seq", *NUMBERS, *FLAGS).repartitionByRange(key, "seq", *NUMBERS).sortWithinPartitions(key, "seq", *NUMBERS)
    width = len(NUMBERS)

    def runs(batches):
        place = TaskContext.get().partitionId()
        begun, now, firsts, halves, flags, n, rows = False, None, [], [], [], 0, []

        def row():
            # totals take more than 64 bits
            return (now, place, n, firsts, [[str(h.total), str(h.low), str(h.jump)] for h in halves], flags)

        def out():
            done = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            rows.clear()
            return pa.RecordBatch.from_arrays(done, ["key", "place", "n", "firsts", "halves", "flags"])

        for batch in batches:
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.string())), pa.list_(pa.bool_())]
            for value, _, *rest in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if not begun or value != now:
                    if begun:
                        rows.append(row())
                    begun, now, n = True, value, 1
                    firsts, halves, flags = rest[:width], [Halves() for _ in NUMBERS], rest[width:]
                    continue
                n += 1
                for h, a in zip(halves, rest, strict=False):
                    h.add(a)
                flags = [a or b for a, b in zip(flags, rest[width:], strict=True)]
            if len(rows) > 1000:
                yield out()
        if begun:
            rows.append(row())
            yield out()

    def combined(value, frame):
        frame = frame.sort_values("place")  # a row for each task that had the key
        state = None
        for n, firsts, halves in zip(frame["n"], frame["firsts"], frame["halves"], strict=True):
            if state is None:
                state = list(firsts)
            else:
                state = [(x + a) // 2 for x, a in zip(state, firsts, strict=True)]
            state = [Halves(min(int(n) - 1, 62), *map(int, h)).of(int(x)) for x, h in zip(state, halves, strict=True)]
        flags = [bool(any(f[k] for f in frame["flags"])) for k in range(len(FLAGS))]
        return pd.DataFrame([[value[0], int(frame["n"].sum()), *map(int, state), *flags]], columns=[key, "n", *NUMBERS, *FLAGS])

    chunks = dealt.mapInArrow(runs, f"key {kind}, place int, n long, firsts array<long>, halves array<array<string>>, flags array<boolean>")
    schema = f"`{key}` {kind}, n long, " + ", ".join([*[f"{c} long" for c in NUMBERS], *[f"{c} boolean" for c in FLAGS]])
    return chunks.groupBy("key").applyInPandas(combined, schema)


def by_host(pages: DataFrame, title: str | None = None) -> DataFrame:
    """host, n, confidence, numbers, flags, selectors: what reference pages (in the order of their ids) teach of their hosts. One page
    alone counts 0.5; else 0.3, and a tenth for each more, 0.95 at most. title: as reference_pages has it."""
    # read by both aggregates, and sampled for ranges: pages are parsed once
    examples = kept(reference_pages(pages, title).withColumn("seq", F.col("page_id")), "examples")
    confidence = F.when(F.col("n") == 1, 0.5).otherwise(learn.reference_confidence(F.col("n")))
    return folded(examples, "host").withColumn("confidence", confidence).join(selectors_by(examples, "host"), "host", "left")


def by_base_domain(hosts: DataFrame) -> DataFrame:
    """domain, hosts, n, confidence, numbers, flags, selectors: hosts of one base domain as one, in the order of their names; a domain
    with one host stays as it is."""
    named = hosts.withColumn("domain", urls.base_domain(F.col("host"))).withColumn("seq", F.col("host"))
    totals = named.groupBy("domain").agg(F.count("*").alias("hosts"), F.sum("n").alias("total"), F.max("confidence").alias("own"))
    merged = folded(named, "domain").drop("n").join(totals, "domain").join(selectors_by(named, "domain"), "domain", "left")
    confidence = F.when(F.col("hosts") > 1, learn.reference_confidence(F.col("total"))).otherwise(F.col("own"))
    return merged.select("domain", "hosts", F.col("total").alias("n"), confidence.alias("confidence"), *NUMBERS, *FLAGS, "selectors")


def url_patterns(pages: DataFrame) -> DataFrame:
    """name, domain, pattern, confidence: what the addresses of reference pages (in the order of their ids) teach of their base domains,
    as learn.best_reference takes it: the first path of a host without its numbers. Hosts of one base domain become one, without a path."""
    host = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    hosts = pages.groupBy(host.alias("host")).agg(F.count("*").alias("n"), F.min_by("url", F.struct("page_id", "url")).alias("first"))
    domains = hosts.groupBy(urls.base_domain(F.col("host")).alias("name")).agg(F.count("*").alias("hosts"), F.sum("n").alias("n"), F.min("host").alias("domain"), F.min_by("first", "host").alias("first"))
    pattern = F.when(F.col("hosts") == 1, urls.shape(urls.path(F.col("first")))).otherwise("")
    return domains.select("name", "domain", pattern.alias("pattern"), F.when(F.col("n") == 1, 0.5).otherwise(learn.reference_confidence(F.col("n"))).alias("confidence"))


def with_model(hosts: DataFrame, suggested: DataFrame, least: float = 0.7) -> DataFrame:
    """hosts with a model's selectors before their own. suggested: host, seq, kind, selector, confidence; only those above the least
    count, but every host that was looked at is surer afterwards."""
    sure = suggested.where(F.col("confidence") > least).groupBy("host", "kind").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("seq", "selector"))), lambda s: s["selector"])).alias("list"))
    maps = sure.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("kind", "list"))).alias("new"))
    seen = suggested.select("host").distinct().withColumn("seen", F.lit(True))
    none = F.create_map().cast("map<string,array<string>>")
    own, new = F.coalesce("selectors", none), F.coalesce("new", none)
    nothing = F.array().cast("array<string>")
    both = F.map_zip_with(new, own, lambda _, a, b: F.array_distinct(F.concat(F.coalesce(a, nothing), F.coalesce(b, nothing))))
    surer = F.when(F.col("seen"), (F.col("confidence") + 0.9) / 2).otherwise(F.col("confidence"))
    return hosts.join(maps, "host", "left").join(seen, "host", "left").withColumn("selectors", both).withColumn("confidence", surer).drop("new", "seen")


# ---- analysis of content pages ------------------------------------------------------------------


def _showing(group: tuple[str, ...], good, shown) -> Column:
    """(selector, text, classes, id) of each element of some selectors whose text is good, by the order of these."""
    of = lambda s, name, i: F.get(F.try_element_at("given", F.concat(s, F.lit(f"@{name}"))), i)
    classes = lambda s, i: F.filter(F.split(of(s, "class", i), r"\s+"), lambda c: c != "")
    each = lambda s: F.transform(F.coalesce(F.try_element_at("listed", s), F.array().cast("array<string>")), lambda t, i: F.struct(s.alias("selector"), shown(t).alias("text"), classes(s, i).alias("classes"), of(s, "id", i).alias("id")))
    return F.filter(F.flatten(F.transform(F.array(*[F.lit(s) for s in group]), each)), lambda e: (e["text"] != "") & good(e["text"]))


def analysed(pages: DataFrame, elements: bool = False) -> DataFrame:
    """page_id, words, has_price, has_details, price_selectors, detail_selectors, selectors, keywords, valid; with elements also title,
    price_elements and detail_elements, the elements that the selectors were found by, which consolidation has no use for."""
    shown = tuple(dict.fromkeys((*PRICE_ELEMENTS, *DETAIL_ELEMENTS)))
    gathered = select.gathered(pages, (*(("title",) if elements else ()), *IMPORTANT), shown, every=tuple((s, a) for s in shown for a in ("class", "id")) if elements else ())
    # what lambdas refer to is computed for each item that they look at, so it is made a column before
    found = computed_once(gathered.select("page_id", "text", F.lower("text").alias("lower"), "counts", "listed", *(["found", "given"] if elements else [])))
    lower, price = F.col("lower"), "|".join(PRICE_PATTERNS)
    priced, detailed = lambda t: t.rlike(price), lambda t: F.lower(t).rlike("|".join(DETAIL_WORDS))
    if elements:
        found = computed_once(found.withColumns({"price_elements": _showing(PRICE_ELEMENTS, priced, lambda t: t), "detail_elements": _showing(DETAIL_ELEMENTS, detailed, F.lower)}))
        prices, details = (F.array_distinct(F.transform(c, lambda e: e["selector"])) for c in ("price_elements", "detail_elements"))
    else:
        hit = lambda group, good: F.filter(F.array(*[F.lit(s) for s in group]), lambda s: F.exists(F.try_element_at("listed", s), lambda t: (t != "") & good(t)))
        prices, details = hit(PRICE_ELEMENTS, priced), hit(DETAIL_ELEMENTS, detailed)
    keywords = F.filter(F.array(*[F.lit(w) for w in KEYWORDS]), lambda w: lower.contains(w))
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    out = found.select(
        "page_id", words.alias("words"), ((F.size(prices) > 0) | F.col("text").rlike(price)).alias("has_price"), (F.size(details) > 0).alias("has_details"),
        prices.alias("price_selectors"), details.alias("detail_selectors"), select.with_elements(IMPORTANT).alias("selectors"), keywords.alias("keywords"),
        *([F.coalesce(select.said("title"), F.lit("")).alias("title"), "price_elements", "detail_elements"] if elements else []),
    )
    return out.withColumn("valid", (F.col("words") >= 50) & (F.size("keywords") >= 3) & (F.size("selectors") >= 3) & (F.col("has_price") | F.col("has_details")))


#: Lists of an analysis by what is made of them.
SHARED = {"selectors": "common_selectors", "keywords": "common_keywords", "price_selectors": "price_selectors", "detail_selectors": "detail_selectors"}


def shared_by_pages(analyses: DataFrame) -> DataFrame:
    """One row: what three tenths of the valid pages share (common_selectors, common_keywords), every price and detail selector that
    worked, and how long pages are; pages counts all of them. Lists are sorted. Analyses are read once: a page counts for each of its
    items and for itself."""
    nothing = F.array().cast("array<struct<kind:string,item:string>>")
    named = lambda c, name: F.transform(c, lambda x: F.struct(F.lit(name).alias("kind"), x.alias("item")))
    items = F.concat(*[named(c, name) for c, name in SHARED.items()])
    page = F.array(F.struct(F.when(F.col("valid"), "valid").otherwise("other").alias("kind"), F.lit("").alias("item")))
    each = computed_once(analyses.select("valid", "words", *SHARED)).select("words", F.inline(F.concat(page, F.when(F.col("valid"), items).otherwise(nothing))))
    counted = each.groupBy("kind", "item").agg(F.count("*").alias("n"), F.sum("words").alias("words"))  # no more than are tried
    of = lambda *kinds: F.coalesce(F.sum(F.when(F.col("kind").isin(*kinds), F.col("n"))), F.lit(0))
    words = F.sum(F.when(F.col("kind") == "valid", F.col("words")))
    all_of = lambda name: F.array_sort(F.collect_list(F.when(F.col("kind") == name, F.struct("item", "n")))).alias(name)
    one = computed_once(counted.groupBy().agg(of("valid", "other").alias("pages"), of("valid").alias("valid_pages"), F.floor(F.try_divide(words, of("valid"))).alias("typical_words"), *[all_of(name) for name in SHARED.values()]))
    least = F.greatest(F.lit(1), F.floor(F.col("valid_pages") * 30 / 100))
    lists = [F.transform(F.filter(name, lambda x: x["n"] >= least) if name.startswith("common") else F.col(name), lambda x: x["item"]).alias(name) for name in SHARED.values()]
    bounds = (F.floor(F.col("typical_words") / 2).alias("least_words"), (F.col("typical_words") * 3).alias("most_words"))
    return one.select("pages", "valid_pages", "typical_words", *bounds, *lists)


def content_patterns(features: DataFrame, kind: str = "kind") -> DataFrame:
    """kind and what pages of it are like: prices, words and structure. features: markup.features with the kind and words, text."""
    lower, n = F.lower("text"), F.count("*")
    hits = lambda words: F.sum(reduce(add, [rules.count(lower, w) for w in words]))
    words = F.sum(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")))
    share = lambda c: F.count_if(F.col(c)) / n
    out = features.groupBy(kind).agg(
        n.alias("examples"), F.avg("price_count").alias("avg_price_count"), F.min("price_count").alias("min_price_count"), F.max("price_count").alias("max_price_count"),
        F.try_divide(hits(CATALOG_TEXT), words).alias("catalog_keyword_density"), F.try_divide(hits(PROPERTY_TEXT), words).alias("property_keyword_density"),
        F.avg("link_count").alias("avg_link_count"), F.avg("image_count").alias("avg_image_count"), share("has_pagination").alias("pagination_frequency"), share("has_filters").alias("filters_frequency"),
    )
    return out.withColumns(
        {
            "price_pattern": F.when(F.col("avg_price_count") > 3, "multiple_prices").otherwise("single_price"),
            "dominant_pattern": F.when(F.col("property_keyword_density") > F.col("catalog_keyword_density"), "property").otherwise("catalog"),
            "structure_pattern": F.when((F.col("pagination_frequency") > 0.5) | (F.col("filters_frequency") > 0.3), "catalog").otherwise("property"),
            "confidence": learn.content_confidence(F.col("examples")),
        }
    )


# ---- classification by what was learned ---------------------------------------------------------

GENERIC_PRICES = (".price", ".valor", ".preco", ".value", "[class*='price']", "[class*='valor']")
GENERIC_DETAILS = (".details", ".detalhes", ".caracteristicas", ".features", ".specs", ".info")
SCORED_WORDS = ("quartos", "dormitórios", "suítes", "banheiros", "área", "m²", "m2", "metros", "garagem", "vagas")
CONTACTS = ("[href*='tel:']", "[href*='mailto:']", "[href*='whatsapp']", "[href*='wa.me']")
NAMED = ("[class*='property']", "[class*='imovel']", "[class*='listing']", "[class*='anuncio']")
STRUCTURE = (("h1, h2, h3", 3.0), ("img", 2.0), ("a", 1.0), ("form", 2.0), ("meta[property='og:title']", 1.0), (".breadcrumb, .breadcrumbs, nav", 1.0))


def _stepped(selectors: Column, start: Column, step: float, most: float) -> Column:
    """start, and a step for each selector with elements as long as the sum is below the most."""
    return F.aggregate(selectors, start, lambda s, x: F.when((s < most) & F.try_element_at("counts", x).isNotNull(), s + step).otherwise(s))


def content_scores(pages: DataFrame, learned: DataFrame) -> DataFrame:
    """page_id, score, confidence, accepted by eight parts that add up to 100. learned: shared_by_pages, one row."""
    more = tuple(dict.fromkeys((*GENERIC_PRICES, *GENERIC_DETAILS, *CONTACTS, *NAMED, *[s for s, _ in STRUCTURE], *PRICE_ELEMENTS, *DETAIL_ELEMENTS, *IMPORTANT)))
    # each step's columns are computed once: lambdas would else compute what they refer to for each item, and sums what they are made of
    gathered = computed_once(select.gathered(pages, more).select("page_id", "text", F.lower("text").alias("lower"), "counts"))
    found = gathered.crossJoin(F.broadcast(learned))
    lower = F.col("lower")
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    array = lambda group: F.array(*[F.lit(s) for s in group])
    keywords = F.size(F.filter("common_keywords", lambda w: lower.contains(F.lower(w))))
    common = F.least(F.size(F.filter("common_selectors", lambda s: F.try_element_at("counts", s).isNotNull())).cast("double"), F.lit(10.0))
    structure = reduce(add, [F.when(select.number(s) > 0, points).otherwise(0.0) for s, points in STRUCTURE])
    structure = structure + F.when(select.any_of(CONTACTS), 2.0).otherwise(0.0) + F.when(select.any_of(NAMED), 2.0).otherwise(0.0)
    first = found.select(
        "page_id", "counts", "least_words", "most_words", words.alias("words"), keywords.alias("keywords"), (select.number("h1, h2, h3") > 0).alias("heading"), common.alias("common"), structure.alias("structure"),
        _stepped(F.col("price_selectors"), F.lit(0.0), 5.0, 15.0).alias("price"), lower.rlike("|".join(PRICE_PATTERNS)).alias("says_price"),
        (_stepped(F.col("detail_selectors"), F.lit(0.0), 3.0, 12.0) + rules.hits(SCORED_WORDS, lower)).alias("details"),
    )
    price = F.when((F.col("price") < 15) & F.col("says_price"), F.col("price") + 5.0).otherwise(F.col("price"))
    price = F.least(_stepped(array(GENERIC_PRICES), price, 2.0, 15.0), F.lit(20.0))
    details = F.least(_stepped(array(GENERIC_DETAILS), F.col("details"), 2.0, 12.0), F.lit(15.0))
    second = computed_once(computed_once(first).withColumns({"price": price, "details": details}))
    length = F.when((F.col("words") >= F.col("least_words")) & (F.col("words") <= F.col("most_words")), 5.0).when(F.col("words") >= 50, 2.0).otherwise(0.0)
    score = 10.0 + length + F.least(F.col("keywords") * 2.0, F.lit(15.0)) + F.col("price") + F.col("details") + F.col("common") + F.when(F.col("heading"), 10.0).otherwise(0.0) + F.least("structure", F.lit(15.0))
    parts = second.select("page_id", "words", "keywords", "price", "details", "heading", score.alias("score"))
    confidence = F.least(F.col("score") / 100.0, F.lit(1.0))
    evidence = (F.col("price") > 0) | (F.col("details") > 0) | (F.col("keywords") >= 1) | ((confidence >= 0.1) & F.col("heading"))
    return parts.select("page_id", "score", confidence.alias("confidence"), ((F.col("words") >= 30) & evidence).alias("accepted"))


def fused_known(extracted: Column, expected: Column, confidence: Column, strict: Column) -> tuple[Column, Column]:
    """(accepted, confidence) of a page whose host's selectors are known: by how many fields they give, and the strict class."""
    own = F.when(expected > 0, extracted / expected * confidence).otherwise(confidence * 0.5)
    accepted = F.when(strict == "property", True).when(strict == "catalog", False).otherwise((extracted >= 2) & (own > 0.4))
    return accepted, F.when(strict == "property", (own + 0.8) / 2).when(strict == "catalog", own * 0.3).otherwise(own)


def fused_general(strict: Column, content: Column, content_confidence: Column, any_field: Column) -> tuple[Column, Column]:
    """(accepted, confidence) of any page by its strict class and its content's; surer if a generic selector finds a field."""
    p, c = (strict == "property", content == "property"), (strict == "catalog") | (content == "catalog")
    confidence = F.when(p[0] & p[1], (0.8 + content_confidence) / 2).when(p[0] | p[1], 0.6).when(c, 0.8).otherwise(0.3)
    return F.coalesce(p[0] | p[1], F.lit(False)), F.when(any_field, (confidence + 0.2) / 1.2).otherwise(confidence)


def improved_route(strict: Column, content: Column, content_confidence: Column) -> Column:
    """process, catalog or skip."""
    single, catalog = strict == "property", (strict == "catalog") | (content == "catalog")
    return F.when(single | ((content == "property") & (content_confidence > 0.7)), "process").when(catalog, "catalog").otherwise("skip")


def model_route(is_listing: Column, confidence: Column, talks: Column) -> Column:
    """Whether a page is processed: by a sure model, a fairly sure one that says yes, or, where it is unsure, by the text's rule; never
    without a model's word (null)."""
    by_model = F.when(confidence > 0.8, is_listing).otherwise(is_listing & (confidence > 0.6))
    return F.coalesce(by_model | ((confidence < 0.7) & talks), F.lit(False))


def retrain(validated: DataFrame, least: float = 0.6) -> DataFrame:
    """urls, successful, failed, retrain of url, accepted, confidence: each url counts once, as a success if it was accepted for more
    than the least; to be trained again if failures are more than half the successes."""
    once = validated.groupBy("url").agg(F.max(F.col("accepted") & (F.col("confidence") > least)).alias("good"))
    counts = once.agg(F.count("*").alias("urls"), F.count_if("good").alias("successful"), F.count_if(~F.col("good")).alias("failed"))
    return counts.withColumn("retrain", F.col("failed") > F.floor(F.col("successful") / 2))


# ---- whole trainings ----------------------------------------------------------------------------


def train_reference(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """domain, hosts, n, confidence, numbers, flags, selectors: what the pages of reference urls (lines: line, as in a reference file)
    teach of their base domains. A line that comes twice counts once; urls without a page teach nothing."""
    named = files.reference_urls(lines).select("url").distinct()
    return by_base_domain(by_host(pages.join(named, "url", "left_semi").select("page_id", "url", "html")))


def train_content(pages: DataFrame) -> DataFrame:
    """One row of what valid pages share, as shared_by_pages gives it, with how many were looked at. Each page is parsed once."""
    return shared_by_pages(analysed(pages))


def train_with_model(pages: DataFrame, suggested: DataFrame, least: float = 0.7) -> DataFrame:
    """domain, hosts, n, confidence, numbers, flags, selectors: what pages teach of their hosts, a model's selectors before it, hosts of
    one base domain as one."""
    return by_base_domain(kept(with_model(by_host(pages), suggested, least), "hosts"))
