"""Rule-based page classes from text and url, without the page's markup."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of a single listing. Fixed values.
REQUIRED = (
    r"\d+\s+quartos?", r"\d+\s+dormit[óo]rios?", r"\d+\s+banheiros?", r"\d+\s+su[íi]tes?", r"\d+\s+vagas?", r"\d+\s*m[²2]",
    r"[áa]rea\s+de\s+\d+", r"rua\s+[a-zA-ZÀ-ÿ\s]+,\s*\d+", r"avenida\s+[a-zA-ZÀ-ÿ\s]+,\s*\d+", r"c[óo]digo:?\s*[a-zA-Z0-9]+", r"ref:?\s*[a-zA-Z0-9]+",
)
#: Price patterns that can match lower-cased text. Fixed values.
PRICES = (r"[\d]{1,3}(?:\.[\d]{3})*(?:,[\d]{2})?\s*reais", r"[\d]+\s*mil", r"por\s*R\$\s*[\d]+", r"valor\s*[\d]+")
CATALOG = (r"p[áa]gina\s+(anterior|pr[óo]xima)", r"todos\s+os\s+bairros", r"diversos\s+im[óo]veis", r"mais\s+de\s+\d+\s+im[óo]veis")


def count_of(text: Column, patterns: tuple[str, ...]) -> Column:
    """How many of the patterns occur."""
    total = F.lit(0)
    for p in patterns:
        total = total + text.rlike(f"(?iu){p}").cast("int")
    return total


def any_of(text: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(or_, [text.rlike(f"(?iu){p}") for p in patterns])


def listing_score(text: Column) -> Column:
    """20 for each required pattern, 25 for each price pattern, less for very short or long texts; 0 to 1."""
    words = F.size(F.split(F.trim(text), r"\s+"))
    points = 20 * count_of(text, REQUIRED) + 25 * count_of(text, PRICES) + F.when(words < 50, -20).when(words > 2000, -10).otherwise(0)
    return F.least(F.greatest(points, F.lit(0)), F.lit(100)) / 100.0


def is_catalog(url: Column, text: Column) -> Column:
    """A catalog word in the url, and many prices or rooms in the text."""
    return any_of(url, ("catalogo", "busca", "imoveis", "lista")) & ((F.regexp_count(text, F.lit(r"r\$")) > 5) | (F.regexp_count(text, F.lit("quartos")) > 3))
