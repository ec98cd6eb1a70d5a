"""What lasts between runs, through keyed stores: each query makes a store, merges two overlapping parts of its table (as two runs
would, or a run and one after it) and reads it. The oracle says what one run over all would have left."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.functions import hashing
from hearthline.operators import jobs, registry as cities, state
from hearthline.plans.base import registry
from hearthline.plans.state_queries import PRINTS
from hearthline.queries import HASH, C, L, U
from hearthline.sources import views
from hearthline.sources.shared import shared_folder
from hearthline.sources.store import FIRST, LAST, REPLACE, KeyedStore

QUERIES, ORACLES, query = registry()


def _store(spark, name: str, schema: str, keys: tuple[str, ...]) -> KeyedStore:
    return KeyedStore(spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", schema, keys, buckets=8)


def _thirds(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """The lower two thirds of the values of a column, and the upper two."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    step = ((high or 0) - (low or 0)) // 3
    return df.where(F.col(column) <= (low or 0) + 2 * step), df.where(F.col(column) >= (low or 0) + step)


def _listings(spark, sf_dir) -> DataFrame:
    return views.listings(spark, sf_dir).select(hashing.listing_hash().alias("hash"), "id", "valor")


LISTINGS = "hash string, id long, valor double"


@query(f"{L} SELECT hash, min(id) AS id FROM (SELECT id, {HASH} AS hash FROM l) GROUP BY hash")
def save_listing_dedup(spark, sf_dir):
    """The first listing of each hash, saved in two runs."""
    store = _store(spark, "listings", LISTINGS, ("hash",))
    for part in _thirds(_listings(spark, sf_dir), "id"):
        store.merge(part, FIRST, ("id",))
    return store.read().select("hash", "id")


@query(f"""{L}, h AS (SELECT id, {HASH} AS hash FROM l), b AS (SELECT min(id) + (max(id) - min(id)) // 3 AS start FROM h)
  SELECT hash, coalesce(min(id) FILTER (id >= start), min(id)) AS id FROM h, b GROUP BY hash""")
def save_listing_first_run(spark, sf_dir):
    """What the first run saved stays, though the second has lesser ids; the first, run again as the same batch, changes nothing."""
    store = _store(spark, "listings", LISTINGS, ("hash",))
    lower, upper = _thirds(_listings(spark, sf_dir), "id")
    for part, batch in ((upper, "1"), (lower, "2"), (upper, "1")):
        store.merge(part, FIRST, ("id",), batch)
    return store.read().select("hash", "id")


@query(U + " SELECT url, seq, status FROM last")
def upsert_processed_url(spark, sf_dir):
    """The last visit of each url, whichever run brings it."""
    store = _store(spark, "urls", "url string, processed_at timestamp, seq long, status string, hash string", ("url",))
    log = views.processed_urls(spark, sf_dir).withColumns({"processed_at": F.col("processed_at").cast("timestamp"), "seq": F.col("seq").cast("long")})
    for part in reversed(_thirds(log, "seq")):
        store.merge(part, LAST, ("processed_at", "seq"))
    return store.read().select("url", "seq", "status")


@query(PRINTS + " SELECT url, hash, epoch_us(last_crawled) AS last_crawled FROM f")
def upsert_fingerprint(spark, sf_dir):
    """Fingerprints of the visits so far, then of all."""
    store = _store(spark, "fingerprints", "url string, hash string, last_crawled timestamp", ("url",))
    log = views.processed_urls(spark, sf_dir)
    for part in (_thirds(log, "seq")[0], log):
        store.merge(state.fingerprints(part).select("url", "hash", F.col("last_crawled").cast("timestamp")), REPLACE)
    return store.read().select("url", "hash", F.unix_micros("last_crawled").alias("last_crawled"))


@query(C + " SELECT city, count(*) FILTER (city <> 'NATION_1' OR status = 'active') AS total_sites FROM s GROUP BY city")
def upsert_city(spark, sf_dir):
    found = views.cities(spark, sf_dir)
    store = KeyedStore(spark, f"{shared_folder(spark)}/cities-{uuid.uuid4().hex}", found.schema, ("city", "region"), buckets=4)
    store.merge(found, REPLACE)
    store.merge(store.read().where("city = 'NATION_1'").withColumn("sites", cities.active(F.col("sites"))), REPLACE)
    return cities.counters(store.read()).select("city", "total_sites")


@query(C + " SELECT city, count(*) AS sites FROM s WHERE region <> 'AMERICA' GROUP BY city")
def delete_stored_cities(spark, sf_dir):
    """Cities taken out of a store by their keys."""
    found = views.cities(spark, sf_dir)
    store = KeyedStore(spark, f"{shared_folder(spark)}/cities-{uuid.uuid4().hex}", found.schema, ("city", "region"), buckets=4)
    store.merge(found, REPLACE)
    store.remove(found.where("region = 'AMERICA'"))
    return store.read().select("city", F.size("sites").cast("long").alias("sites"))


def _counts(listings: KeyedStore, log: KeyedStore, moment: str) -> DataFrame:
    count = lambda store, what: store.read().agg(F.lit(moment).alias("moment"), F.lit(what).alias("what"), F.count("*").alias("n"))
    return count(listings, "listings").unionByName(count(log, "urls"))


CLEARED = f"""{L}, {U.removeprefix('WITH ')}, n AS (SELECT (SELECT count(DISTINCT hash) FROM (SELECT {HASH} AS hash FROM l)) AS listings, (SELECT count(*) FROM last) AS urls)"""


def _cleared(spark, sf_dir, properties: bool, urls_too: bool):
    """Stores of listings and urls, before and after what was asked for is cleared, and before once more at its version."""
    listings = _store(spark, "listings", LISTINGS, ("hash",))
    log = _store(spark, "urls", "url string, seq long", ("url",))
    listings.merge(_listings(spark, sf_dir), FIRST, ("id",))
    log.merge(state.latest(views.processed_urls(spark, sf_dir)).select("url", F.col("seq").cast("long")), LAST, ("seq",))
    before = _counts(listings, log, "before")
    for asked, store in ((properties, listings), (urls_too, log)):
        if asked:
            store.clear()
    return before.unionByName(_counts(listings, log, "after"))


@query(CLEARED + " SELECT 'before' AS moment, 'listings' AS what, listings AS n FROM n UNION ALL SELECT 'before', 'urls', urls FROM n UNION ALL SELECT 'after', 'listings', 0 UNION ALL SELECT 'after', 'urls', urls FROM n")
def clear_listings(spark, sf_dir):
    return _cleared(spark, sf_dir, True, False)


@query(CLEARED + """ SELECT 'before' AS moment, 'listings' AS what, listings AS n, m FROM n, t UNION ALL SELECT 'before', 'urls', urls, m FROM n, t UNION ALL SELECT 'after', 'listings', 0, m FROM t UNION ALL SELECT 'after', 'urls', 0, m FROM t""".replace(" SELECT 'before' AS", ", t AS (SELECT 'Banco de dados completamente limpo (propriedades + URLs)' AS m) SELECT 'before' AS", 1))
def cleanup_database(spark, sf_dir):
    """All is cleared, and what is told of it."""
    properties, urls_too, told = jobs.cleanup(F.lit(False), F.lit(False), F.lit(True))
    asked = spark.range(1).select(properties.alias("properties"), urls_too.alias("urls"), told.alias("told")).first()
    return _cleared(spark, sf_dir, asked["properties"], asked["urls"]).withColumn("m", F.lit(asked["told"]))
