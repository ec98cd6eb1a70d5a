"""Listing search: optional predicates, count, page, relevance order within the page."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.functions import text


@dataclass(frozen=True)
class SearchFilter:
    """Zero, empty or None: not asked for. fixed=True takes accents off the stored side too."""

    q: str = ""
    cidade: str = ""
    bairro: str = ""
    tipo_imovel: str = ""
    valor_min: float = 0
    valor_max: float = 0
    quartos_min: int = 0
    quartos_max: int = 0
    banheiros_min: int = 0
    banheiros_max: int = 0
    area_min: float = 0
    area_max: float = 0
    fixed: bool = False

    def __post_init__(self) -> None:
        if len(self.q) > 200:
            raise ValueError("q is longer than 200 characters")
        for low, high in ((self.valor_min, self.valor_max), (self.quartos_min, self.quartos_max), (self.banheiros_min, self.banheiros_max), (self.area_min, self.area_max)):
            if (low or 0) < 0 or (high or 0) < 0 or (low and high and high < low):
                raise ValueError("a range is negative or ends before it begins")

    def predicate(self) -> Column:
        found = F.lit(True)
        if words := text.search_terms(self.q):
            pattern = "(?iu)" + "|".join(map(re.escape, words))
            found = found & reduce(or_, [F.col(c).rlike(pattern) for c in ("endereco", "cidade", "bairro", "descricao", "tipo_imovel")])
        for column in ("cidade", "bairro", "tipo_imovel"):
            if asked := getattr(self, column):
                stored = text.normalize(F.col(column)) if self.fixed else F.col(column)
                found = found & stored.rlike("(?iu)" + re.escape(text.normalized(asked)))
        for name, column in (("valor", "valor"), ("quartos", "quartos"), ("banheiros", "banheiros"), ("area", "area_total")):
            if low := getattr(self, f"{name}_min"):
                found = found & (F.col(column) >= low)
            if high := getattr(self, f"{name}_max"):
                found = found & (F.col(column) <= high)
        return found


#: How much a field counts in the order of a page. Fixed values.
WEIGHTS = {"descricao": 3.0, "endereco": 2.0, "cidade": 1.5, "bairro": 1.5, "tipo_imovel": 1.0}


def score(q: str) -> Column:
    words, total = text.search_terms(q), F.lit(0.0)
    for column, weight in WEIGHTS.items():
        total = total + text.relevance(F.col(column), words) * weight
    return total


def matching(listings: DataFrame, asked: SearchFilter) -> DataFrame:
    return listings.where(asked.predicate())


def page(listings: DataFrame, asked: SearchFilter, number: int = 1, size: int = 10, rank_all: bool = False) -> DataFrame:
    """A page by price, its rows then by relevance; rank_all orders everything by relevance before the page is cut."""
    number, size = max(1, number), size if size > 0 else 10
    found = matching(listings, asked).withColumn("score", score(asked.q))
    order = [F.desc("score"), F.desc("valor"), "id"] if rank_all else [F.desc("valor"), "id"]
    return found.orderBy(*order).offset((number - 1) * size).limit(size).orderBy(F.desc("score"), F.desc("valor"), "id")


def totals(listings: DataFrame, asked: SearchFilter, size: int = 10) -> DataFrame:
    return matching(listings, asked).agg(F.count("*").alias("total")).withColumn("total_pages", F.ceil(F.col("total") / size).cast("long"))
