"""Discovery jobs, requests and runs: what is valid, what is active, what is left after a clean-up, and rates that are 0 where nothing
was done. Null columns count as not asked for; empty tables give empty results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The longest texts and the highest numbers of a search request. Fixed values.
LONGEST = {"q": 200, "cidade": 50, "bairro": 50, "tipo_imovel": 30}
HIGHEST = {"valor": 100_000_000, "quartos": 20, "banheiros": 20, "area": 100_000}
PAGES, PAGE_SIZE = 1000, 100
ACTIVE = ("queued", "running")


def problems(columns: list[str]) -> Column:
    """What is wrong with a search request, by field; only fields that the request has are looked at."""
    found = [F.when(F.length(c) > most, f"{c}: too long") for c, most in LONGEST.items() if c in columns]
    for name, most in HIGHEST.items():
        for c in (f"{name}_min", f"{name}_max"):
            if c in columns:
                found.append(F.when((F.col(c) < 0) | (F.col(c) > most), f"{c}: out of bounds"))
        if {f"{name}_min", f"{name}_max"} <= set(columns):
            low, high = F.col(f"{name}_min"), F.col(f"{name}_max")
            found.append(F.when((low > 0) & (high > 0) & (high < low), f"{name}_max: below {name}_min"))
    found += [F.when((F.col(c) < 0) | (F.col(c) > most), f"{c}: out of bounds") for c, most in (("page", PAGES), ("page_size", PAGE_SIZE)) if c in columns]
    return F.array_compact(F.array(*found))


def active(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status").isin(*ACTIVE))


def kept(jobs: DataFrame, cutoff: Column) -> DataFrame:
    """Jobs but those completed before the cutoff."""
    return jobs.where(F.col("completed_at").isNull() | (F.col("completed_at") >= cutoff))


def ended(cities: DataFrame) -> DataFrame:
    """job: cities, done, failed, progress in percent, status. cities: job, city, state (done, failed or null)."""
    count = lambda s: F.count_if(F.col("state") == s)
    counted = cities.groupBy("job").agg(F.count("*").alias("cities"), count("done").alias("done"), count("failed").alias("failed"))
    progress = F.floor((F.col("done") + F.col("failed")) * 100 / F.col("cities")).cast("int")
    status = F.when(F.col("done") + F.col("failed") < F.col("cities"), "running").when(F.col("failed") > 0, "completed_with_errors").otherwise("completed")
    return counted.withColumns({"progress": progress, "status": status})


def cleanup(properties: Column, urls: Column, everything: Column) -> tuple[Column, Column, Column]:
    """(whether listings go, whether urls go, what is told): everything means both."""
    p, u = properties | everything, urls | everything
    told = (
        F.when(p & u, "Banco de dados completamente limpo (propriedades + URLs)")
        .when(p, "Propriedades limpas com sucesso")
        .when(u, "URLs processadas limpas com sucesso")
        .otherwise("Nenhuma operação de limpeza realizada")
    )
    return p, u, told


def cleared(table: DataFrame) -> DataFrame:
    """What is left of a cleared table: its columns."""
    return table.limit(0)


def rate(part: Column, whole: Column) -> Column:
    """Percent of the whole; 0 of nothing."""
    return F.when(whole > 0, part * 100.0 / whole).otherwise(0.0)


def validation_statistics(results: DataFrame) -> DataFrame:
    """results: kind (property, catalog, unknown), confidence."""
    count = lambda k: F.count_if(F.col("kind") == k)
    return results.agg(
        F.count("*").alias("total_validations"), count("property").alias("property_pages"), count("catalog").alias("catalog_pages"), count("unknown").alias("unknown_pages"),
        F.avg("confidence").alias("avg_confidence"), F.try_divide(count("property"), F.count("*")).alias("property_rate"),
    )
