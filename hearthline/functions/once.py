"""A stop for the optimiser between columns and what is made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame) -> DataFrame:
    """df with each of its columns computed once a row, whatever refers to them later. Filters and projections above would else be
    merged with what the columns are made of, as many times as they name them: for fields found by dozens of selectors and patterns
    that takes the compiler longer than the data. A generator of one row is such a stop; it costs no shuffle and no write."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))
