"""Model replies merged into listings, cached replies, and the part of a page that a model is shown. A reply is a column of text, from
wherever it comes; nothing here calls a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.operators.links import has_any

REPLY = "endereco string, cidade string, bairro string, cep string, descricao string, valor double, quartos double, banheiros double, area_total double, tipo_imovel string"
SINGLE = ("endereco", "cidade", "bairro", "cep", "descricao", "valor", "quartos", "banheiros", "area_total", "tipo_imovel")
BATCH = ("endereco", "cidade", "bairro", "valor", "quartos", "banheiros", "area_total", "tipo_imovel")
#: Class words of the lines that matter. Fixed values.
RELEVANT = (
    "price", "preco", "valor", "value", "address", "endereco", "location", "localizacao", "description", "descricao", "details", "detalhes", "property", "imovel", "listing",
    "anuncio", "features", "caracteristicas", "amenities", "rooms", "quartos", "bedrooms", "dormitorios", "bathrooms", "banheiros", "area", "size",
)


def json_part(reply: Column) -> Column:
    """From the first opening brace to the last closing one; empty if there is none."""
    return F.regexp_extract(reply, r"(?s)\{.*\}", 0)


def merged(listings: DataFrame, reply: str = "reply", batch: bool = False) -> DataFrame:
    """listings with what the reply knows: non-empty texts and positive numbers. Replies that are no JSON object change nothing."""
    parsed = F.from_json(json_part(F.col(reply)), REPLY)
    known = listings.withColumn("__reply", parsed)
    out = []
    for c in listings.columns:
        if c in (BATCH if batch else SINGLE):
            new = F.col(f"__reply.{c}")
            good = (new != "") if dict(listings.dtypes)[c] == "string" else (new > 0)
            out.append(F.when(good, new.cast(listings.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        elif c != reply:
            out.append(F.col(c))
    return known.select(*out)


def cached(asked: DataFrame, cache: DataFrame, as_of: Column, ttl: str = "INTERVAL 24 HOURS") -> DataFrame:
    """asked (with key) and the reply that the cache (key, reply, stored_at) still holds at as_of, null where a model must be asked."""
    fresh = cache.where(as_of - F.col("stored_at") <= F.expr(ttl)).groupBy("key").agg(F.max_by("reply", "stored_at").alias("reply"))
    return asked.join(fresh, "key", "left")


def cache_statistics(cache: DataFrame, as_of: Column, ttl: str = "INTERVAL 24 HOURS") -> DataFrame:
    return cache.agg(F.count("*").alias("total"), F.count_if(as_of - F.col("stored_at") > F.expr(ttl)).alias("expired"))


def batches(asked: DataFrame, group: str, order: str, size: int = 5) -> DataFrame:
    """Adds batch and place: so many listings of a group go into one call."""
    from pyspark.sql.window import Window

    at = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    return asked.withColumn("place", at).withColumn("batch", F.floor(F.col("place") / size)).withColumn("place", F.col("place") % size)


def without_scripts(html: Column) -> Column:
    return F.regexp_replace(html, r"(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", "")


def relevant_lines(html: Column, most: int) -> Column:
    """The lines with a word that matters, joined, up to the one that passes the bound; a longer result is cut and marked."""
    lines = F.filter(F.transform(F.split(without_scripts(html), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+\z", "")), lambda x: (x != "") & has_any(F.lower(x), RELEVANT))
    joined = F.aggregate(lines, F.lit(""), lambda a, x: F.when(F.octet_length(a) > most, a).when(a == "", x).otherwise(F.concat(a, F.lit("\n"), x)))
    return F.when(F.octet_length(joined) > most, F.concat(F.substring(joined, 1, most), F.lit("..."))).otherwise(joined)
