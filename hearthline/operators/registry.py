"""City registry: sites nested in cities, views over them, updates and roll-ups. Arrays are filtered before they are exploded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def active(sites: Column) -> Column:
    return F.filter(sites, lambda s: s["status"] == "active")


def counters(cities: DataFrame) -> DataFrame:
    return cities.withColumns({"total_sites": F.size("sites").cast("long"), "active_sites": F.size(active(F.col("sites"))).cast("long")})


def sites_active(cities: DataFrame) -> DataFrame:
    return cities.select("city", F.explode(active(F.col("sites"))).alias("s")).select("city", F.col("s.url").alias("url"))


def statistics(cities: DataFrame) -> DataFrame:
    total = counters(cities).agg(F.count("*").alias("cities"), F.sum("total_sites").alias("sites"), F.sum("active_sites").alias("active"))
    return total.withColumn("inactive", F.col("sites") - F.col("active"))


def top_cities(cities: DataFrame, n: int = 10) -> DataFrame:
    balance = F.aggregate("sites", F.lit(0).cast("decimal(38,2)"), lambda a, s: (a + s["balance"].cast("decimal(20,2)")).cast("decimal(38,2)"))
    found = counters(cities).where("active_sites > 0").select("city", "active_sites", balance.cast("double").alias("balance"))
    return found.orderBy(F.desc("active_sites"), F.desc("balance"), "city").limit(n)


def set_status(cities: DataFrame, url: str, status: str) -> DataFrame:
    """The first site of that url in each city gets the status; counters are left as they are."""
    at = F.array_position(F.transform("sites", lambda s: s["url"]), url)
    return cities.withColumn("sites", F.transform("sites", lambda s, i: F.when(i == at - 1, s.withField("status", F.lit(status))).otherwise(s)))


def remove_inactive(cities: DataFrame) -> DataFrame:
    kept = cities.withColumn("sites", F.filter("sites", lambda s: ~s["status"].isin("inactive", "error")))
    return kept.where(F.size("sites") > 0)


def by_key(cities: DataFrame, city: str, region: str) -> DataFrame:
    return cities.where((F.col("city") == city) & (F.col("region") == region.upper()))


def without_city(cities: DataFrame, city: str, region: str) -> DataFrame:
    return cities.where((F.col("city") != city) | (F.col("region") != region.upper()))


def by_names(cities: DataFrame, names: list[str], fixed: bool = False) -> DataFrame:
    """Cities with one of the names, however they are cased; no names, all cities. Names are patterns, unless fixed takes them as they are."""
    if not names:
        return cities
    if fixed:
        return cities.where(F.lower("city").isin([n.lower() for n in names]))
    return cities.where(F.col("city").rlike("(?iu)" + "|".join(rf"\A(?:{n})\z" for n in names)))


def with_site(cities: DataFrame, city: str, site: Column) -> DataFrame:
    """The city with the site: in place of the one with its url, else at the end. Counters are made anew."""
    same = lambda s: s["url"] == site["url"]
    put = F.when(F.exists("sites", same), F.transform("sites", lambda s: F.when(same(s), site).otherwise(s))).otherwise(F.concat("sites", F.array(site)))
    return counters(cities.withColumn("sites", F.when(F.col("city") == city, put).otherwise(F.col("sites"))))


def without_site(cities: DataFrame, city: str, url: str) -> DataFrame:
    """The city without the first site of that url. Counters are made anew."""
    at = F.array_position(F.transform("sites", lambda s: s["url"]), url)
    left = F.filter("sites", lambda s, i: i != at - 1)
    return counters(cities.withColumn("sites", F.when((F.col("city") == city) & (at > 0), left).otherwise(F.col("sites"))))


def success_rate(found: Column, errors: Column, unchanged: Column | None = None) -> Column:
    """Percent of attempts that found something; without attempts 0, or what it was before."""
    return F.when(found + errors > 0, found * 100.0 / (found + errors)).otherwise(F.lit(0.0) if unchanged is None else unchanged)


def set_statistics(cities: DataFrame, updates: DataFrame) -> DataFrame:
    """updates: city, url, found, errors. Each site gets its newest statistics; counters are left as they are. The updates of a city
    come to it as one map, so cities are joined once, whatever the number of updates."""
    rate = F.struct("found", "errors", success_rate(F.col("found"), F.col("errors")).alias("success_rate"))
    new = updates.groupBy("city").agg(F.map_from_entries(F.collect_list(F.struct("url", rate.alias("statistics")))).alias("__new"))
    joined = cities.join(new, "city", "left")
    return joined.withColumn("sites", F.transform("sites", lambda s: s.withField("statistics", F.element_at("__new", s["url"])))).drop("__new")


def validated(sites: DataFrame) -> DataFrame:
    """sites: found, success_rate. Adds valid and the status that follows."""
    good = (F.col("found") > 0) & (F.col("success_rate") > 50)
    return sites.withColumn("valid", good).withColumn("new_status", F.when(good, "active").otherwise("inactive"))


def seeds(cities: DataFrame, fallback: DataFrame, names: list[str]) -> DataFrame:
    """The active sites to crawl, of all cities or of those named; the fallback's urls where there are none."""
    found = sites_active(by_names(cities, names)).select("url")
    any_found = found.limit(1).agg(F.count("*").alias("n"))  # one row
    return found.unionByName(fallback.select("url").crossJoin(F.broadcast(any_found)).where("n = 0").select("url"))


def upserted(cities: DataFrame, changes: DataFrame) -> DataFrame:
    """cities with changes put in by city and region, counters anew."""
    rest = cities.join(changes.select("city", "region"), ["city", "region"], "left_anti")
    return counters(rest.select("city", "region", "sites").unionByName(changes.select("city", "region", "sites")))


def counts_by_host(pages: DataFrame, host: Column) -> DataFrame:
    return pages.groupBy(host.alias("host")).agg(F.count("*").alias("pages"))
