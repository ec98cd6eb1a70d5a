"""What a service would offer over the engine, as plain functions with its defaults and refusals: tables in, tables out, nothing is
served or stored here. A request that may not be answered is a ValueError."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.operators import jobs, learn, registry, search, state
from hearthline.sources import files

STATE, DAYS = "MG", 30


def find(listings: DataFrame, number: int = 1, size: int = 10, **asked) -> tuple[DataFrame, DataFrame]:
    """(a page of listings, one row of totals) for a search; what is wrong with it, as jobs.problems tells, is refused."""
    row = {**asked, "page": number, "page_size": size}
    request = listings.sparkSession.createDataFrame([row])
    if wrong := request.select(jobs.problems(request.columns).alias("p")).first()["p"]:
        raise ValueError("; ".join(wrong))
    wanted = search.SearchFilter(**asked)
    return search.page(listings, wanted, number, size), search.totals(listings, wanted, size)


def city(cities: DataFrame, name: str, state_name: str = STATE) -> DataFrame:
    if not name:
        raise ValueError("a city must be named")
    return registry.by_key(cities, name, state_name)


def sites(cities: DataFrame, names: list[str]) -> DataFrame:
    """city, url of the active sites of the cities named; of all, if none is."""
    return registry.sites_active(registry.by_names(cities, names, fixed=True))


def statistics(cities: DataFrame) -> DataFrame:
    return registry.statistics(cities)


def delete_city(cities: DataFrame, name: str, state_name: str = STATE, confirm: bool = False) -> DataFrame:
    """The registry without a city; only if confirmed."""
    if not confirm:
        raise ValueError("deleting a city must be confirmed")
    return registry.without_city(cities, name, state_name)


def forget_visits(log: DataFrame, as_of: Column, days: int = DAYS) -> DataFrame:
    """The log without visits of more than so many days ago."""
    if days < 1:
        raise ValueError("days must be 1 or more")
    return state.retained(log, as_of - F.expr(f"INTERVAL {int(days)} DAYS"))


def cleanup(listings: DataFrame, log: DataFrame, properties: bool = False, urls: bool = False, everything: bool = False) -> tuple[DataFrame, DataFrame, str]:
    """(listings left, log left, what is told); refused if nothing is asked for."""
    if not (properties or urls or everything):
        raise ValueError("name what to clean up")
    told = listings.sparkSession.range(1).select(jobs.cleanup(F.lit(properties), F.lit(urls), F.lit(everything))[2].alias("told")).first()["told"]
    return jobs.cleared(listings) if properties or everything else listings, jobs.cleared(log) if urls or everything else log, told


def learn_urls(pages: DataFrame, least: int = 2) -> DataFrame:
    """kind, pattern, n, confidence of url, kind examples with an id."""
    return learn.url_patterns(pages, least)


def classify_urls(pages: DataFrame, patterns: DataFrame) -> DataFrame:
    return learn.by_url_patterns(pages, patterns)


def export_patterns(patterns: DataFrame, path: str) -> str:
    files.export_patterns(patterns, path)
    return path


def import_patterns(spark: SparkSession, path: str) -> DataFrame:
    return files.import_patterns(spark, path)
