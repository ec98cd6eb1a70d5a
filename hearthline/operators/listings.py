"""Rules over listing records and candidate texts: what is worth a model call, complete, sufficient or savable; clean-up and inference.
Lengths count bytes. Texts are never null; numbers that are not known are 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.functions import text
from hearthline.operators.links import has_any

# Words by what they tell.
ADDRESS_WORDS = ("rua", "avenida", "praça", "estrada", "rodovia", "alameda", "travessa", "largo", "beco", "vila", "jardim", "centro", "bairro", "distrito", "setor", "quadra", "lote")
ADDRESS_PATTERN = r"\d|-\s*mg|minas\s+gerais"
PRICE_WORDS = ("r$", "real", "reais", "mil", "milhão", "milhões", "valor", "preço", "preco", "venda", "à vista")
DESCRIBING = (
    "casa", "apartamento", "imóvel", "propriedade", "residência", "quartos", "dormitórios", "banheiros", "sala", "cozinha", "garagem", "jardim", "área", "localização",
    "próximo", "amplo", "espaçoso", "confortável", "moderno", "reformado", "venda", "aluguel", "locação", "oportunidade",
)
NOT_DESCRIBING = (
    "copyright", "todos os direitos", "política de privacidade", "termos de uso", "desenvolvido por", "powered by", "javascript", "css", "html", "error", "404", "menu",
    "navegação", "footer", "header", "sidebar",
)
FEATURES = ("piscina", "churrasqueira", "garagem", "jardim", "varanda", "sacada", "área gourmet", "playground", "portaria", "elevador")
CITIES = ("Muzambinho", "Alfenas", "Guaxupé", "Juruaia", "Monte Belo", "Poços de Caldas", "Varginha", "Três Pontas", "Machado")
INFERRED_TYPES = (("Casa", ("casa", "residência")), ("Apartamento", ("apartamento", "apto")), ("Terreno", ("terreno", "lote")), ("Comercial", ("comercial", "loja")))


def _some(*columns: str) -> Column:
    found = F.lit(True)
    for c in columns:
        found = found & (F.col(c) != "")
    return found


def _above(*columns: str) -> Column:
    found = F.lit(True)
    for c in columns:
        found = found & (F.col(c) > 0)
    return found


def needs_model() -> Column:
    """Something important is missing, or the record looks dirty."""
    known = _some("endereco", "tipo_imovel") & _above("valor", "quartos", "banheiros", "area_total")
    return ~known | F.col("endereco").contains("\n") | (F.octet_length("descricao") > 1000) | (F.col("tipo_imovel") == "Outro")


def complete() -> Column:
    return _some("endereco", "tipo_imovel", "cidade", "bairro") & _above("valor", "quartos", "banheiros") & (F.octet_length("descricao") > 50)


def _between(column: str, low: int, high: int) -> Column:
    n = F.octet_length(column)
    return (F.col(column) == "") | ((n > low) & (n < high))


def sufficient(check_description: bool = True) -> Column:
    """An address or a price, a description, and lengths and price within bounds."""
    found = (_some("endereco") | _above("valor")) & _some("descricao") & _between("endereco", 10, 300) & (F.col("valor") >= 0) & (F.col("valor") < 100_000_000)
    return found & _between("descricao", 20, 2000) if check_description else found


def savable() -> Column:
    return _some("endereco", "cidade", "descricao")


def like_address(value: Column) -> Column:
    lower = F.lower(value)
    return F.octet_length(value).between(5, 200) & (has_any(lower, ADDRESS_WORDS) | lower.rlike(ADDRESS_PATTERN))


def like_price(value: Column) -> Column:
    lower = F.lower(value)
    return F.octet_length(value).between(2, 50) & lower.rlike(r"\d") & (has_any(lower, PRICE_WORDS) | lower.rlike(r"^\s*\$?\s*\d"))


def like_description(value: Column) -> Column:
    lower = F.lower(value)
    words = F.lit(0)
    for w in DESCRIBING:
        words = words + lower.contains(w).cast("int")
    sentence = lower.contains(" ") & lower.rlike("[.,;:!?]")
    return F.octet_length(value).between(15, 5000) & ~has_any(lower, NOT_DESCRIBING) & ((words >= 2) | (sentence & (words >= 1)))


def features(value: Column) -> Column:
    lower = F.lower(value)
    return F.filter(F.array(*[F.lit(f) for f in FEATURES]), lambda f: lower.contains(f))


def known_city(value: Column) -> Column:
    """The first known city that a text names, however it is cased; empty if none."""
    lower = F.lower(value)
    return F.coalesce(F.get(F.filter(F.array(*[F.lit(c) for c in CITIES]), lambda c: lower.contains(F.lower(c))), F.lit(0)), F.lit(""))


def location(value: Column) -> tuple[Column, Column]:
    """(city, neighbourhood): of a text that ends in two or three parts between commas the first is the neighbourhood, and the second
    the city if none is known by name."""
    ending = r"(?s)([^,]+),\s*([^,]+)(?:,\s*[^,]+)?\z"
    second, known = F.trim(F.regexp_extract(value, ending, 2)), known_city(value)
    return F.when(known == "", second).otherwise(known), F.trim(F.regexp_extract(value, ending, 1))


def inferred_type(value: Column) -> Column:
    lower, out = F.lower(value), F.lit("Outro")
    for name, words in reversed(INFERRED_TYPES):
        out = F.when(has_any(lower, words), name).otherwise(out)
    return out


def squeezed(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"[\t\n\f\r ]+", " "))


def cleaned(listings: DataFrame) -> DataFrame:
    """Texts squeezed, impossible numbers 0, a type for all."""
    bounded = lambda c, most: F.when((F.col(c) < 0) | (F.col(c) > most), 0).otherwise(F.col(c)).cast(listings.schema[c].dataType)
    numbers = {"quartos": bounded("quartos", 20), "banheiros": bounded("banheiros", 15), "area_total": bounded("area_total", 10_000)}
    texts = {c: squeezed(F.col(c)) for c in ("endereco", "descricao", "cidade", "bairro")}
    kind = F.when(F.col("tipo_imovel") == "", "Outro").otherwise(F.col("tipo_imovel"))
    return listings.withColumns({**texts, **numbers, "valor": F.greatest("valor", F.lit(0.0)), "tipo_imovel": kind})


def enhanced(listings: DataFrame) -> DataFrame:
    """Type and city inferred where they are missing, texts squeezed."""
    kind = F.when(F.col("tipo_imovel").isin("", "Outro"), inferred_type(F.concat_ws(" ", "endereco", "descricao"))).otherwise(F.col("tipo_imovel"))
    city = F.when(F.col("cidade") == "", known_city(F.col("endereco"))).otherwise(F.col("cidade"))
    return listings.select(*[c for c in listings.columns if c not in ("tipo_imovel", "cidade", "endereco", "descricao", "bairro")], kind.alias("tipo_imovel"), squeezed(city).alias("cidade"), *[squeezed(F.col(c)).alias(c) for c in ("endereco", "descricao", "bairro")])


def price_text(value: Column) -> Column:
    """A price in Brazilian form, with two decimals."""
    return F.concat(F.lit("R$ "), F.translate(F.format_number(value, 2), ",.", ".,"))


def page_window(current: Column, pages: Column) -> Column:
    """The page numbers shown around the current one."""
    return F.when(pages >= 1, F.sequence(F.greatest(F.lit(1), current - 2), F.least(pages, current + 2)))


def keyed(value: Column) -> Column:
    return F.md5(value.cast("binary"))


def prompt(endereco: str = "endereco", descricao: str = "descricao", valor: str = "valor_texto") -> Column:
    """What a model is asked about one listing; long fields are cut."""
    head, tail = "Extraia dados estruturados do imóvel em JSON:\nDados: Endereço:", "\n\nJSON com: endereco, cidade, bairro, cep, descricao, valor, quartos, banheiros, area_total, area_util, tipo_imovel, caracteristicas"
    cut = lambda c, most: text.truncate(F.col(c), most)
    return F.concat(F.lit(head), cut(endereco, 300), F.lit(" | Descrição:"), cut(descricao, 1500), F.lit(" | Valor:"), cut(valor, 100), F.lit(tail))
