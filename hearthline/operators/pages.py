"""Page classes by the words of text, title and url. Texts and titles come in lower case. Where a rule also counts elements of the
page's markup, the counts are an optional argument; without them the rule goes by words alone."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthline.functions import urls
from hearthline.operators.links import has_any

# Words and url patterns by what they tell.
PROPERTY_WORDS = (
    "área útil", "área total", "iptu", "condomínio", "código do imóvel", "ref:", "código:", "agendar visita", "entre em contato", "solicitar informações",
    "características do imóvel", "detalhes do imóvel", "localização", "mapa", "street view", "fotos do imóvel", "galeria de fotos", "financiamento", "documentação",
    "dormitórios:", "suítes:", "vagas:", "ano de construção", "estado de conservação",
)
CATALOG_WORDS = (
    "resultados encontrados", "imóveis encontrados", "ordenar por", "filtrar por", "buscar por", "página anterior", "próxima página", "página 1", "ver mais imóveis",
    "mais resultados", "refinar busca", "nova busca", "imóveis similares", "outras opções", "a partir de r$", "valores a partir", "diversos imóveis", "várias opções",
)
PROPERTY_URLS = (
    r"/imovel/\d+", r"/propriedade/\d+", r"/anuncio/\d+", r"/detalhes/\d+", r"/casa/\d+", r"/apartamento/\d+", r"/ref-\d+", r"/codigo-\d+", r"/id-\d+", r"-\d{4,}/?$",
    r"/[a-z]+-\d+-[a-z]+",
)
CATALOG_URLS = (
    r"/imoveis/?$", r"/busca", r"/pesquisa", r"/listagem", r"/catalogo", r"/resultados", r"[?&]page=", r"[?&]pagina=", r"[?&]filtro", r"[?&]ordenar", r"/venda/?$",
    r"/aluguel/?$", r"/casa/?$", r"/apartamento/?$", r"/comercial/?$", r"/categoria/",
)
STRICT_CATALOG_WORDS = (
    "você encontra diversos", "você encontra mais de", "imóveis encontrados", "resultados encontrados", "escolha o seu imóvel", "diversas opções", "várias opções",
    "mais opções", "outros imóveis", "imóveis similares", "ordenar por", "filtrar por", "refinar busca", "nova busca", "página anterior", "próxima página",
    "ver mais imóveis", "mais resultados", "todos os bairros", "todas as regiões",
)
STRICT_PROPERTY_WORDS = (
    "código do imóvel:", "ref:", "referência:", "agendar visita", "solicitar informações", "entre em contato", "características do imóvel", "detalhes do imóvel",
    "documentação regular", "financiamento disponível", "iptu:", "condomínio:", "área útil:", "área total:", "ano de construção:", "estado de conservação:",
    "aceita financiamento", "aceita fgts",
)
STRICT_CATALOG_URLS = (
    r"/venda/?$", r"/aluguel/?$", r"/casa/?$", r"/apartamento/?$", r"/comercial/?$", r"/imoveis/?$", r"/busca", r"/pesquisa", r"/listagem", r"/catalogo", r"/resultados",
    r"[?&]page=", r"[?&]pagina=", r"[?&]filtro", r"[?&]ordenar", r"/categoria/", r"/bairro/[^/]+/?$", r"/cidade/[^/]+/?$", r"/regiao/[^/]+/?$", r"/tipo/[^/]+/?$",
    r"/preco/[^/]+/?$", r"/quartos/[^/]+/?$", r"/venda/[^/]+/[^/]+/?$", r"/aluguel/[^/]+/[^/]+/?$",
)
STRICT_PROPERTY_URLS = (
    r"/imovel/\d+", r"/propriedade/\d+", r"/anuncio/\d+", r"/detalhes/\d+", r"/ref-\d+", r"/codigo-\d+", r"/id-\d+", r"-\d{5,}/?$", r"/imovel-\d+", r"/casa-\d+",
    r"/apartamento-\d+", r"/[a-z]+-\d+-[a-z]+-\d+",
)
VALIDATOR_WORDS = (
    "quartos", "dormitórios", "suítes", "banheiros", "área construída", "área total", "área útil", "garagem", "vagas", "estacionamento", "condomínio", "iptu", "escritura",
    "financiamento", "entrada", "parcelas", "código do imóvel", "ref:", "código:", "localização", "endereço", "bairro", "aceita financiamento", "documentação em ordem",
)
VALIDATOR_EXCLUDED = (
    "todos os bairros", "todas as regiões", "diversos imóveis", "várias opções", "encontre seu imóvel", "busque por", "filtros de busca", "ordenar por", "página anterior",
    "próxima página", "resultados encontrados", "nenhum resultado", "nossa equipe", "sobre nós", "contato", "política de privacidade", "termos de uso",
)
#: Of the price patterns those that lower-cased text can match.
VALIDATOR_PRICES = (r"\$\s*[\d.,]+", r"[\d.,]+\s*reais?")
NAVIGATION_URLS = (
    "/venda/", "/aluguel/", "/comprar/", "/alugar/", "/imoveis/", "/properties/", "/listings/", "/busca", "/search", "/pesquisa", "/catalogo", "/listagem", "/resultados",
    "todos-os-bairros", "todas-as-regioes",
)
NAVIGATION_WORDS = (
    "ordenar por", "filtros", "resultados encontrados", "próxima página", "página anterior", "página 1", "nenhum imóvel foi encontrado", "realize uma nova busca",
    "mais filtros", "ver mapa", "carregando...",
)
INDIVIDUAL_URLS = ("/imovel/", "/propriedade/", "/detalhes/", "/property/", "/listing/", "/anuncio/")
INDIVIDUAL_WORDS = ("código do imóvel", "ref:", "código:", "agendar visita", "entre em contato", "características do imóvel", "detalhes do imóvel")
INCREMENTAL_URLS = ("imoveis/?", "busca", "listagem", "catalogo", "pesquisa", "resultados", "filtros", "ordenar", "pagina=", "page=")
LEARNER_CATALOG = (
    "imóveis ao buscar", "resultados encontrados", "imobiliária em", "filtrar por", "ordenar por", "próxima página", "página anterior", "buscar imóveis", "encontrados",
    "resultados para", "8 imóveis", "resultados da busca", "refinar busca", "ordenar resultados", "mostrando resultados", "total de imóveis", "páginas de resultados",
)
LEARNER_PROPERTY = (
    "descrição do imóvel", "características do imóvel", "detalhes do imóvel", "agendar visita", "entre em contato", "proprietário", "corretor responsável",
    "valor do imóvel", "área construída", "área total", "iptu",
)
SITE_WORDS = ("imovel", "imóvel", "propriedade", "casa", "apartamento", "venda", "aluguel", "real estate", "property", "house", "r$", "reais", "preço", "valor")
EXCLUDED_PATHS = (
    "/sobre", "/about", "/nossa-equipe", "/equipe", "/team", "/contato", "/contact", "/fale-conosco", "/politica-privacidade", "/privacy", "/termos", "/terms",
    "/servicos", "/services", "/como-funciona", "/venda$", "/aluguel$", "/comprar$", "/alugar$", "/imoveis$", "/properties$", "/listings$", "/buscar", "/search",
    "/filtros", "/filters", "/login", "/cadastro", "/register", "/admin", "/blog", "/noticias", "/news", "/dicas", "/financiamento", "/financing", "/simulador",
    "/avaliar", "/avaliacao", "/evaluation", "/condominios$", "/condominio$", "/empreendimentos$", "/imoveis-favoritos", "/favoritos", "/wishlist", "/anuncie",
    "/anuncie-seu-imovel", "/cadastrar-imovel", "/documentos", "/docs", "/area-cliente", "/cliente",
)
KIND_WORDS = (
    "imovel", "casa", "apartamento", "terreno", "sitio", "chacara", "sobrado", "cobertura", "loft", "studio", "comercial", "loja", "sala", "galpao", "barracao", "fazenda",
    "rural",
)


def hits(words: tuple[str, ...], *texts: Column) -> Column:
    """How many of the words are in any of the texts."""
    total = F.lit(0)
    for w in words:
        total = total + reduce(or_, [t.contains(w) for t in texts]).cast("int")
    return total


def matches(text: Column, patterns: tuple[str, ...]) -> Column:
    """Whether any pattern occurs; a dollar sign at the end means the end of the text."""
    return text.rlike("|".join(p[:-1] + r"\z" if p.endswith("$") else p for p in patterns))


def count(text: Column, part: str) -> Column:
    """How often a part occurs, each place once: by how much shorter a text is without it."""
    return ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(part)))) / len(part.encode())).cast("int")


def by_url(url: Column) -> Column:
    """property, catalog or null."""
    lower = F.lower(url)
    return F.when(matches(lower, PROPERTY_URLS), "property").when(matches(lower, CATALOG_URLS), "catalog")


def by_content(text: Column, title: Column) -> Column:
    """property, catalog or null: whichever has more words of its kind, two at least; many prices or rooms speak for a catalogue."""
    listing = hits(PROPERTY_WORDS, text, title)
    catalog = hits(CATALOG_WORDS, text, title) + F.when(count(text, "r$") > 5, 3).otherwise(0) + F.when(count(text, "quartos") > 3, 2).otherwise(0)
    return F.when((listing > catalog) & (listing >= 2), "property").when((catalog > listing) & (catalog >= 2), "catalog")


def by_structure(details: Column, photos: Column, cards: Column, pagination: Column, filters: Column) -> Column:
    """property, catalog or null, by elements of the markup: details, pagination and filters are flags, the others counts."""
    listing = F.when(details, 1).otherwise(0) + F.when(photos > 3, 2).otherwise(0)
    catalog = F.when(cards > 2, 3).otherwise(0) + F.when(pagination, 2).otherwise(0) + F.when(filters, 2).otherwise(0)
    return F.when((listing > catalog) & (listing >= 2), "property").when((catalog > listing) & (catalog >= 3), "catalog")


def page(url: Column, text: Column, title: Column, structure: Column | None = None) -> Column:
    """The first verdict of url, content and structure, else unknown."""
    return F.coalesce(by_url(url), by_content(text, title), *([structure] if structure is not None else []), F.lit("unknown"))


def strict(url: Column, text: Column, title: Column, structure_score: Column | None = None, photos: Column | None = None) -> Column:
    """catalog if anything says so for certain, then property if something does, else unknown."""
    lower = F.lower(url)
    catalog = matches(lower, STRICT_CATALOG_URLS) | (hits(STRICT_CATALOG_WORDS, text, title) > 0) | (count(text, "r$") > 8) | (count(text, "quartos") > 5) | (count(text, "imóveis") > 3)
    said = hits(STRICT_PROPERTY_WORDS, text, title)
    listing = matches(lower, STRICT_PROPERTY_URLS) | (said >= 2)
    if structure_score is not None:
        listing = listing | (structure_score >= 3)
    if photos is not None:
        listing = listing | ((photos > 5) & (said >= 1))
    return F.when(catalog, "catalog").when(listing, "property").otherwise("unknown")


def validated(text: Column, structure_score: Column | float = 0.0) -> tuple[Column, Column]:
    """(whether the content is a listing's, confidence): a tenth for each word, two for a price; none with an excluding phrase."""
    score = F.lit(structure_score) if isinstance(structure_score, float) else structure_score
    price, said, excluded = matches(text, VALIDATOR_PRICES), hits(VALIDATOR_WORDS, text), has_any(text, VALIDATOR_EXCLUDED)
    confidence = F.when(excluded, 0.0).otherwise(F.least((said + F.when(price, 2).otherwise(0) + score) / 10.0, F.lit(1.0)))
    return ~excluded & (confidence >= 0.4) & (price | (said >= 3)), confidence


def smart(url_is: Column, url_confidence: Column, content_is: Column, content_confidence: Column) -> tuple[Column, Column]:
    """(whether url and content together are a listing's, their mean confidence)."""
    mean = (url_confidence + content_confidence) / 2.0
    return url_is & content_is & (mean >= 0.8) & (url_confidence >= 0.7), mean


def navigation(url: Column, text: Column, structure_score: Column | None = None, interactive: Column | None = None) -> tuple[Column, Column]:
    """(catalog, property or generic; confidence)."""
    lower = F.lower(url)
    in_url, said = hits(NAVIGATION_URLS, lower), hits(NAVIGATION_WORDS, text)
    catalog = ((in_url >= 1) & (said >= 2)) | (in_url >= 2)
    if structure_score is not None:
        catalog = catalog | ((said >= 3) & (structure_score >= 2))
    single = (has_any(lower, INDIVIDUAL_URLS) | url.rlike(r"/\d+/?\z")) & (hits(INDIVIDUAL_WORDS, text) >= 1)
    generic = F.lit(0.3) if interactive is None else F.when(interactive > 0, 0.6).otherwise(0.3)
    return F.when(catalog, "catalog").when(single, "property").otherwise("generic"), F.when(catalog, 0.9).when(single, 0.8).otherwise(generic)


def catalog_incremental(url: Column, text: Column) -> Column:
    return has_any(url, INCREMENTAL_URLS) & ((count(text, "r$") > 5) | (count(text, "quartos") > 3))


def by_phrases(text: Column, prices: Column) -> tuple[Column, Column]:
    """(catalog, property or null; confidence): strong phrases first, then how many prices and how often listings are spoken of."""
    catalog, single = has_any(text, LEARNER_CATALOG), has_any(text, LEARNER_PROPERTY)
    many = count(text, "imóveis") + count(text, "imoveis") > 8
    label = F.when(catalog, "catalog").when(single, "property").when((prices > 3) | many, "catalog")
    return label, F.when(catalog, 0.95).when(single, 0.90).when(prices > 3, 0.85).when(many, 0.80)


def prices(raw: Column) -> Column:
    """How many prices a text names, as written."""
    return F.regexp_count(raw, F.lit(r"R\$\s*[\d.,]+"))


def site(text: Column, least: int = 3) -> Column:
    """Whether a site is of the trade."""
    return hits(SITE_WORDS, text) >= least


def talks_of_listing(text: Column) -> Column:
    """A price, and rooms or a street."""
    return text.contains("r$") & has_any(text, ("quartos", "dormitórios", "rua", "avenida"))


def reference_path(url: Column) -> Column:
    """A path in lower case with its numbers and long hexadecimal runs taken out."""
    return F.regexp_replace(F.regexp_replace(F.lower(urls.path(url)), r"\d+", "{ID}"), "[a-f0-9]{8,}", "{GUID}")


def required_parts(pattern: Column) -> Column:
    return F.filter(F.split(pattern, "/"), lambda p: (p != "") & ~p.contains("{"))


def keywords(pattern: Column) -> Column:
    lower = F.lower(pattern)
    return F.filter(F.array(*[F.lit(w) for w in KIND_WORDS]), lambda w: lower.contains(w))


def excluded_path(url: Column) -> Column:
    return matches(F.lower(urls.path(url)), EXCLUDED_PATHS)


def similarity(a: Column, b: Column) -> Column:
    """Of two path patterns: equal parts, placeholders counting as equal, over the longer one's parts."""
    x, y = F.split(a, "/"), F.split(b, "/")
    same = F.filter(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p: (p["x"] == p["y"]) | (p["x"].contains("{") & p["y"].contains("{")))
    return F.when(a == b, 1.0).otherwise(F.size(same) / F.greatest(F.size(x), F.size(y)))
