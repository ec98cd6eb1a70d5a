"""Which links are followed, in what order, and where sites may be found."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hearthline.functions import urls

# Parts of addresses by what they tell.
SKIPPED = ("javascript:", "#", "mailto:", "tel:", ".pdf", ".jpg", ".png", ".gif", ".css", ".js", "login", "admin", "wp-admin", "cadastro")
SOCIAL = ("wa.me", "whatsapp", "mailto:", "tel:", "facebook", "instagram", "twitter", "javascript:", "#", "void(0)")
FILES = (".pdf", ".jpg", ".png", ".gif", ".css", ".js")
FILE_ENDS = (".pdf", ".jpg", ".jpeg", ".png", ".gif", ".css", ".js", ".zip", ".rar", ".doc", ".docx", ".xls", ".xlsx")
CONTACT = ("javascript:", "mailto:", "tel:", "#", "facebook.com", "instagram.com", "twitter.com", "whatsapp")
PRIORITY = (
    "/venda", "/aluguel", "/comprar", "/alugar", "/imovel", "/imoveis", "/propriedade", "/propriedades", "/apartamento", "/casa", "/terreno", "/sitio", "/chacara",
    "/buscar", "/pesquisar", "/catalogo", "/listagem", "/resultado", "/filtro", "id=", "/detalhes",
)
LOW = (
    "/contato", "/sobre", "/empresa", "/equipe", "/historia", "/politica", "/privacidade", "/termos", "/condicoes", "/integre", "/anuncie", "/cadastr", "/login", "/admin",
    "/ajuda", "/faq", "/suporte", "/blog", "/noticias",
)
LISTING_PATHS = (
    "/imovel/", "/propriedade/", "/detalhes/", "/property/", "/listing/", "/anuncio/", "/casa/", "/apartamento/", "/terreno/", "/comercial/", "/rural/", "/loja/",
    "/publicacao.aspx", "/comprar/", "/alugar/",
)
LIKELY_PATHS = ("/imovel/", "/propriedade/", "/anuncio/", "/detalhes/", "/casa/", "/apartamento/", "/ref-", "/codigo-", "/id-")
LISTING_PARAMETERS = r"[?&]id=\d+|[?&]imovel=\d+|[?&]codigo=[0-9A-Za-z_]+"
SITE_WORDS = ("imovel", "imobiliaria", "corretor", "real", "estate", "propriedade", "casa", "apartamento", "venda", "aluguel")
HOST_WORDS = ("imoveis", "imobiliaria", "corretor", "casas", "propriedades")
DOMAINS = (
    "imobiliaria%s.com.br", "%simobiliaria.com.br", "imoveis%s.com.br", "%simoveis.com.br", "corretor%s.com.br", "%scorretor.com.br", "casas%s.com.br", "%scasas.com.br",
    "imob%s.com.br", "%simob.com.br", "creci%s.com.br", "%screci.com.br", "propriedades%s.com.br", "%spropriedades.com.br", "realestate%s.com.br", "%srealestate.com.br",
    "vendas%s.com.br", "%svendas.com.br", "loteamentos%s.com.br", "%sloteamentos.com.br",
)
CATALOG_PATHS = (
    "/venda/imovel/brasil/todos-os-bairros", "/aluguel/imovel/brasil/todos-os-bairros", "/busca/imoveis", "/pesquisa/imoveis", "/imoveis/venda", "/imoveis/aluguel",
    "/venda/todos", "/aluguel/todos", "/venda/apartamento", "/venda/casa", "/venda/terreno", "/venda/comercial", "/aluguel/apartamento", "/aluguel/casa", "/aluguel/comercial",
    "/busca?operacao=venda", "/busca?operacao=aluguel", "/imoveis?tipo=todos&operacao=venda", "/pesquisa?cidade=todos&operacao=venda", "/comprar/imoveis", "/alugar/imoveis",
    "/resultados/venda", "/resultados/aluguel", "/listagem/imoveis", "/catalogo/imoveis",
)
#: What a form is tried with; parameters are written by name.
FORM_PARAMETERS = (
    "", "operacao=venda", "operacao=aluguel", "operacao=venda&tipo=apartamento", "operacao=venda&tipo=casa", "operacao=venda&tipo=terreno", "operacao=venda&tipo=todos",
    "cidade=todos&operacao=venda", "bairro=todos-os-bairros&operacao=venda",
)
#: Links followed from a page by its depth: the first bound that the depth reaches. Low-priority links are left out from LOW_DEPTH on.
CAPS, LOW_DEPTH = ((8, 10), (6, 20), (0, 50)), 4


def has_any(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(or_, [text.contains(p) for p in parts])


def skipped(url: Column) -> Column:
    """Addresses that are no pages to read."""
    return has_any(F.lower(url), SKIPPED)


def skipped_incremental(url: Column) -> Column:
    """The same for incremental runs: empty, contact or social addresses."""
    return (url == "") | has_any(F.lower(url), SOCIAL)


def internal(url: Column, host: Column) -> Column:
    """Links that mention the host, but no files, contacts or social networks."""
    return (url != "") & url.contains(host) & ~has_any(F.lower(url), SOCIAL + FILES)


def valid(url: Column, parent: Column) -> Column:
    """Links of the parent's host that are no files and no contacts."""
    lower = F.lower(url)
    return (url != "") & url.contains(urls.host(parent)) & ~reduce(or_, [lower.endswith(e) for e in FILE_ENDS]) & ~has_any(lower, CONTACT)


def priority(url: Column) -> Column:
    return has_any(F.lower(url), PRIORITY)


def low(url: Column) -> Column:
    return has_any(F.lower(url), LOW)


def _ends_in_number(url: Column) -> Column:
    return url.rlike(r"/\d+/?\z")


def like_listing(url: Column) -> Column:
    """Navigation's rule: a path of listings, a number at the end, or a parameter that names one."""
    return (url != "") & (has_any(F.lower(url), LISTING_PATHS) | _ends_in_number(url) | F.lower(url).rlike(LISTING_PARAMETERS))


def likely_listing(url: Column) -> Column:
    return has_any(F.lower(url), LIKELY_PATHS)


def likely_listing_or_code(url: Column) -> Column:
    """likely_listing, or a last part of more than three bytes with a digit in it."""
    last = F.substring_index(F.lower(url), "/", -1)
    return likely_listing(url) | (url.contains("/") & (F.octet_length(last) > 3) & last.rlike("[0-9]"))


def site_url(url: Column) -> Column:
    """Discovery's rule: a host, and a word of the trade anywhere."""
    return (urls.host(url) != "") & has_any(F.lower(url), SITE_WORDS)


def site_url_searched(url: Column) -> Column:
    """Web search's rule: http or https, and a .com.br host or a word of the trade in the host."""
    host = urls.host(url)
    return url.rlike("^https?://") & (host != "") & (host.endswith(".com.br") | has_any(host, HOST_WORDS))


def external(url: Column, parent: Column) -> Column:
    return (urls.host(url) != "") & (urls.host(url) != urls.host(parent))


def unclear(url: Column, label: Column) -> Column:
    """Whether a model should look at a link: its words speak of listings, its address does not."""
    return has_any(F.lower(label), ("imovel", "casa", "apartamento")) & ~has_any(url, ("/imovel/", "/propriedade/", "/casa/"))


def followed(links: DataFrame, depth: int, parent: str = "parent", url: str = "link", order: str = "id") -> DataFrame:
    """Of each parent's links the ones that are followed at a depth: priority links first, up to the cap. Adds rank (from 1)."""
    cap = next(most for least, most in CAPS if depth >= least)
    open_links = links.where(~low(F.col(url))) if depth >= LOW_DEPTH else links
    by = Window.partitionBy(parent).orderBy(F.when(priority(F.col(url)), 0).otherwise(1), order)
    return open_links.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= cap)


def distinct_by_strategy(candidates: DataFrame, most: int) -> DataFrame:
    """candidates: city, url, strategy, at. Each url of a city once, from the first strategy that has it; the first so many of a city."""
    first = candidates.groupBy("city", "url").agg(F.min(F.struct("strategy", "at")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("city").orderBy("first", "url"))
    return first.withColumn("rank", rank).where(F.col("rank") <= most).select("city", "url", "first.strategy", "rank")


def domain_guesses(city: Column) -> Column:
    """The addresses a city's agencies may have, an array."""
    return F.array(*[F.concat(F.lit("https://" + before), urls.city_domain(city), F.lit(after)) for before, after in (t.split("%s") for t in DOMAINS)])


def catalog_urls(base: Column) -> Column:
    """Addresses under a site's host where its catalogue may be."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    return F.transform(F.array(*[F.lit(p) for p in CATALOG_PATHS]), lambda p: F.concat(root, p))


def form_urls(action: Column, method: Column, base: Column) -> Column:
    """What a search form may be asked for: the known catalogue addresses, then its action with each set of parameters. Forms that
    post have none. The action's own parameters are taken to be none."""
    asked = F.transform(F.array(*[F.lit(p) for p in FORM_PARAMETERS]), lambda p: F.when(p == "", action).otherwise(F.concat(action, F.lit("?"), p)))
    return F.when(method == "GET", F.concat(catalog_urls(base), asked)).otherwise(F.array().cast("array<string>"))


# What a search result must not lead to, and words of a title that speak of the trade.
ELSEWHERE = ("duckduckgo.com", "facebook.com", "instagram.com", "twitter.com", "youtube.com", "google.com", "maps.google.com", "wikipedia.org")
TITLE_WORDS = ("imobiliária", "imobiliaria", "imoveis", "imóveis", "corretor", "casas", "apartamentos", "venda", "aluguel", "propriedades", "terrenos", "lotes")


def relevant(link: Column, title: Column) -> Column:
    """Search results worth a visit: an address of its own, and a word of the trade in the title."""
    return (link != "") & (title != "") & ~has_any(link, ELSEWHERE) & has_any(F.lower(title), TITLE_WORDS)
