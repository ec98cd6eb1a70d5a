"""Listing fields out of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _int(found: Column) -> Column:
    return F.coalesce(F.when(found != "", found).try_cast("int"), F.lit(0))


def rooms(text: Column) -> Column:
    return _int(F.regexp_extract(F.lower(text), r"(\d+)[\t\n\f\r ]*(?:quartos?|dormitórios?|dorms?|suítes?)", 1))


def baths(text: Column) -> Column:
    return _int(F.regexp_extract(F.lower(text), r"(\d+)[\t\n\f\r ]*(?:banheiros?|lavabos?)", 1))


def area(text: Column) -> Column:
    found = F.regexp_extract(text, r"(\d+(?:[,.]\d+)?)[\t\n\f\r ]*m²", 1)
    return F.coalesce(F.when(found != "", F.replace(found, F.lit(","), F.lit("."))).try_cast("double"), F.lit(0.0))


def cep(text: Column) -> Column:
    return F.regexp_extract(text, r"\d{5}-?\d{3}", 0)


def value(price: Column) -> Column:
    """A price as a number. Thousands come in groups with dots: without them, only the first three digits are read."""
    found = F.regexp_extract(F.regexp_replace(price, r"[^\d,.]", ""), r"\d{1,3}(?:\.\d{3})*(?:,\d{1,2})?", 0)
    return F.coalesce(F.when(found != "", F.replace(F.replace(found, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).try_cast("double"), F.lit(0.0))


def value_fixed(price: Column) -> Column:
    """A price as a number, however its digits are grouped."""
    found = F.regexp_extract(F.regexp_replace(price, r"[^\d,.]", ""), r"\d+(?:\.\d{3})*(?:,\d{1,2})?", 0)
    return F.coalesce(F.when(found != "", F.replace(F.replace(found, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).try_cast("double"), F.lit(0.0))


#: Property types by the words that name them, the first that occurs. Fixed values.
TYPES = (("Casa", ("casa",)), ("Apartamento", ("apartamento", "apto")), ("Terreno", ("terreno", "lote")), ("Comercial", ("comercial", "sala")), ("Rural", ("rural", "fazenda")))


def kind(text: Column) -> Column:
    lower, out = F.lower(text), F.lit("Outro")
    for name, words in reversed(TYPES):
        has = lower.contains(words[0])
        for word in words[1:]:
            has = has | lower.contains(word)
        out = F.when(has, name).otherwise(out)
    return out


def features(text: Column, words: tuple[str, ...]) -> Column:
    lower = F.lower(text)
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: lower.contains(w))
