"""Hashes that identify listings, page contents and cities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthline.functions import text, urls


def whole(number: Column) -> Column:
    """A double without decimals, halves to even."""
    return F.bround(number, 0).cast("decimal(38,0)").cast("string")


def listing_hash() -> Column:
    """Over the listing columns; a listing without content is known by its url and type."""
    endereco, descricao, cidade, bairro = (text.content(F.coalesce(F.col(c), F.lit(""))) for c in ("endereco", "descricao", "cidade", "bairro"))
    valor, url = whole(F.col("valor")), urls.for_hash(F.col("url"))
    empty = (endereco == "") & (descricao == "") & (cidade == "") & (valor == "0")
    full = F.concat_ws("|", endereco, descricao, cidade, bairro, valor, whole(F.col("area_total")), F.col("quartos").cast("string"), F.col("banheiros").cast("string"), url)
    return F.sha2(F.when(empty, F.concat_ws("|", F.lit("empty_property"), url, "tipo_imovel")).otherwise(full), 256)


def city_hash(city: Column, state: Column) -> Column:
    return F.sha2(F.concat(F.lit("city:"), F.lower(city), F.lit("|state:"), F.upper(state)), 256)


def content_hash(prices: Column, addresses: Column, descriptions: Column) -> Column:
    joined = lambda a: F.array_join(F.filter(F.transform(a, lambda x: F.trim(F.lower(x))), lambda x: x != ""), " ")
    parts = [F.lit("prices:["), joined(prices), F.lit("]|addresses:["), joined(addresses), F.lit("]|descriptions:["), joined(descriptions), F.lit("]")]
    return F.sha2(F.concat(*parts), 256)


def city_key(city: Column, state: Column) -> Column:
    return F.concat(F.lower(city), F.lit("-"), F.upper(state))
