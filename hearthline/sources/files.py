"""Sources and sinks that are files or supplied tables: seed urls, reference urls, learned patterns, settings; pages, model replies and
search results come as tables, or from any Spark reader that yields their columns, as the engine fetches nothing by itself.

Paths are anything that Spark reads. Blank lines, comments and what is no url give no rows; an empty file gives an empty table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.functions import urls

PATTERN = "kind string, pattern string, n long, confidence double"
#: The columns that supplied tables must have.
PAGES, REPLIES, RESULTS = ("page_id", "url", "html"), ("key", "reply"), ("link", "title")


@dataclass(frozen=True)
class Settings:
    """PORT, MONGO_URI and SITES_FILE of a deployment, as Spark settings spark.hearthline.*; fixed values where unset."""

    port: str = "8080"
    store: str = "mongodb://localhost:27017"
    sites_file: str = "configs/sites.json"

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        read = lambda name, default: spark.conf.get(f"spark.hearthline.{name}", default) or default
        return cls(read("port", cls.port), read("store", cls.store), read("sites_file", cls.sites_file))


def seed_urls(spark: SparkSession, path: str) -> DataFrame:
    """at, url: of a JSON array of strings, in its order."""
    texts = spark.read.text(path, wholetext=True)
    return texts.select(F.posexplode(F.from_json("value", "array<string>")).alias("at", "url")).where("url IS NOT NULL")


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def reference_urls(rows: DataFrame, line: str = "line", numbered_only: bool = False) -> DataFrame:
    """rows with url: of lines as `7|https://...`. Either what is before the first bar goes, whatever it is, and http:// or https:// must
    follow; or, numbered_only, a number and its bar go, and anything that begins with http is an url."""
    text = F.trim(F.regexp_replace(line, r"^[\s]+|[\s]+$", ""))
    if numbered_only:
        url = F.regexp_replace(text, r"^\d+\|", "")
        good = url.startswith("http")
    else:
        url = F.when(text.contains("|"), F.trim(F.regexp_replace(text, r"^[^|]*\|", ""))).otherwise(text)
        good = url.rlike("^https?://")
    found = rows.withColumn("url", url)
    return found.where((text != "") & ~text.startswith("#") & good)


def export_patterns(patterns: DataFrame, path: str) -> None:
    """Learned patterns as JSON lines, in place of what was there."""
    patterns.write.mode("overwrite").json(path)


def import_patterns(spark: SparkSession, path: str, schema: str = PATTERN) -> DataFrame:
    return spark.read.schema(schema).json(path)


def supplied(table: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The columns that a source must give; those it lacks are an error at once, others are left out."""
    if lacking := [c for c in columns if c not in table.columns]:
        raise ValueError(f"the source lacks {', '.join(lacking)}")
    return table.select(*columns)


def candidate_sites(cities: DataFrame, guesses) -> DataFrame:
    """city, url: the addresses that a city's name suggests (guesses: an array of them by the name)."""
    return cities.select("city", F.explode(guesses(F.col("city"))).alias("url"))


def searched_sites(results: DataFrame, good: Column) -> DataFrame:
    """url: of search results (link, title) those that are good, without query, each once."""
    return supplied(results, RESULTS).where(good).select(urls.for_search(F.col("link")).alias("url")).where("url <> ''").distinct()


#: The names of settings in a file, and the fields of Settings that they give.
NAMES = {"PORT": "port", "MONGO_URI": "store", "SITES_FILE": "sites_file"}


def env_settings(texts: DataFrame, key: str, default: Settings) -> DataFrame:
    """key and the fields of Settings, of the text of a settings file each: lines NAME=value, maybe after export, the last of a name
    counts; values may be quoted, else what follows a blank and # goes; an empty value or a lacking name leaves the default."""
    pattern = r"(?m)^[ \t]*(?:export[ \t]+)?%s[ \t]*=[ \t]*(.*)$"
    columns = []
    for name, field in NAMES.items():
        last = F.trim(F.coalesce(F.try_element_at(F.regexp_extract_all("text", F.lit(pattern % name), 1), F.lit(-1)), F.lit("")))
        quoted = F.regexp_extract(last, r"""^("([^"]*)"|'([^']*)')""", 0)
        value = F.when(quoted != "", F.regexp_replace(quoted, r"""^["']|["']$""", "")).otherwise(F.trim(F.regexp_replace(last, r"\s#.*$|^#.*$", "")))
        columns.append(F.when(value != "", value).otherwise(getattr(default, field)).alias(field))
    return texts.select(key, *columns)
