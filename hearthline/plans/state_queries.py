"""Queries over the city registry and the state of visited urls, in batches and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline import queries as core
from hearthline.functions import urls
from hearthline.operators import registry as cities
from hearthline.operators import state
from hearthline.plans.base import registry
from hearthline.queries import AS_OF, C, U
from hearthline.sources import views
from hearthline.streaming import cache, changes, rate_limit
from hearthline.streaming.run import drained

QUERIES, ORACLES, query = registry()

SITE = "Supplier#000000001"


def _sites(found):
    """The documents of a registry, a row for each site."""
    return found.select("city", "region", F.explode("sites").alias("s")).select("city", "region", "s.url", "s.status", "s.balance")


@query(views.LISTING_SQL)
def scan_listings(spark, sf_dir):
    return views.listings(spark, sf_dir)


@query(C + " SELECT city, region, url, status, balance FROM s")
def scan_cities(spark, sf_dir):
    return _sites(views.cities(spark, sf_dir))


@query(C + " SELECT DISTINCT city FROM s WHERE city = 'NATION_1' AND region = 'AMERICA'")
def city_by_key(spark, sf_dir):
    return cities.by_key(views.cities(spark, sf_dir), "NATION_1", "america").select("city")


@query(C + " SELECT DISTINCT city FROM s WHERE regexp_matches(city, '(?i)^(nation_1|nation_2.)$')")
def city_by_names(spark, sf_dir):
    return cities.by_names(views.cities(spark, sf_dir), ["nation_1", "nation_2."]).select("city")


@query(C + " SELECT city, url FROM s WHERE status = 'active' AND city IN ('NATION_1', 'NATION_2')")
def sites_by_cities(spark, sf_dir):
    return cities.sites_active(cities.by_names(views.cities(spark, sf_dir), ["Nation_1", "Nation_2"]))


@query(C + " SELECT city, region, url, status, balance FROM s WHERE city <> 'NATION_1'")
def delete_city(spark, sf_dir):
    return _sites(cities.without_city(views.cities(spark, sf_dir), "NATION_1", "AMERICA"))


@query(C + " SELECT city, region, url, status, balance FROM s UNION ALL SELECT DISTINCT city, region, 'novo', 'active', 0 FROM s WHERE city = 'NATION_1'")
def site_add(spark, sf_dir):
    found = views.cities(spark, sf_dir)
    kind = found.schema["sites"].dataType.elementType["balance"].dataType
    site = F.struct(F.lit("novo").alias("url"), F.lit("active").alias("status"), F.lit(0).cast(kind).alias("balance"))
    return _sites(cities.with_site(found, "NATION_1", site))


@query(C + f" SELECT city, region, url, status, balance FROM s WHERE url <> '{SITE}'")
def site_remove(spark, sf_dir):
    """Removed from each city: only one has it."""
    found = views.cities(spark, sf_dir)
    at = found.where(F.exists("sites", lambda s: s["url"] == SITE)).select("city").first()
    return _sites(cities.without_site(found, at["city"] if at else "", SITE))


@query("SELECT s_name AS url, CASE WHEN n + e > 0 THEN n * 100.0::DOUBLE / (n + e) ELSE 0 END AS success_rate FROM (SELECT s_name, s_suppkey % 4 AS n, s_suppkey % 3 AS e FROM supplier)")
def update_site_stats(spark, sf_dir):
    updates = views.read(spark, sf_dir, "supplier").join(F.broadcast(views.read(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    updates = updates.select(F.col("n_name").alias("city"), F.col("s_name").alias("url"), (F.col("s_suppkey") % 4).alias("found"), (F.col("s_suppkey") % 3).alias("errors"))
    return cities.set_statistics(views.cities(spark, sf_dir), updates).select(F.explode("sites").alias("s")).select("s.url", F.col("s.statistics.success_rate").alias("success_rate"))


@query("SELECT s_name AS url, s_suppkey % 4 > 0 AND s_suppkey % 100 > 50 AS valid, CASE WHEN s_suppkey % 4 > 0 AND s_suppkey % 100 > 50 THEN 'active' ELSE 'inactive' END AS new_status FROM supplier")
def sites_valid(spark, sf_dir):
    sites = views.read(spark, sf_dir, "supplier").select(F.col("s_name").alias("url"), (F.col("s_suppkey") % 4).alias("found"), (F.col("s_suppkey") % 100).alias("success_rate"))
    return cities.validated(sites).select("url", "valid", "new_status")


@query("SELECT s_name AS url FROM supplier")
def crawl_seed_select(spark, sf_dir):
    """No city has the name: the fallback's urls."""
    return cities.seeds(views.cities(spark, sf_dir), views.read(spark, sf_dir, "supplier").select(F.col("s_name").alias("url")), ["Atlantis"])


@query(r"SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host, count(*) AS pages FROM pages GROUP BY 1")
def crawl_stats(spark, sf_dir):
    return cities.counts_by_host(views.read(spark, sf_dir, "pages"), urls.host(F.col("url")))


@query(U + f" SELECT seq FROM log WHERE processed_at >= {AS_OF} - INTERVAL 2 DAY")
def urls_since(spark, sf_dir):
    return state.since(views.processed_urls(spark, sf_dir), F.expr(f"{AS_OF} - INTERVAL 2 DAY")).select("seq")


@query(U + f" SELECT DISTINCT url FROM log WHERE processed_at >= {AS_OF} - INTERVAL 1 DAY AND status = 'success'")
def url_recent(spark, sf_dir):
    return state.recent_success(views.processed_urls(spark, sf_dir), F.expr(f"{AS_OF} - INTERVAL 1 DAY"))


@query(U + " SELECT 'u' || c_custkey AS url FROM customer WHERE 'u' || c_custkey NOT IN (SELECT url FROM log)")
def anti_visited(spark, sf_dir):
    found = views.read(spark, sf_dir, "customer").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("url"))
    return state.unvisited(found, views.processed_urls(spark, sf_dir))


PRINTS = U + ", c AS (SELECT *, coalesce(lag(hash) OVER (PARTITION BY url ORDER BY processed_at, seq) <> hash, true) AS cd FROM log), f AS (SELECT url, arg_max(hash, (processed_at, seq)) AS hash, max(processed_at) FILTER (cd) AS last_modified, max(processed_at) AS last_crawled, arg_max(cd, (processed_at, seq)) AS change_detected FROM c GROUP BY url)"


@query(PRINTS + " SELECT url, hash, epoch_us(last_modified) AS last_modified, change_detected FROM f")
def save_fingerprint_change(spark, sf_dir):
    return state.fingerprints(views.processed_urls(spark, sf_dir)).select("url", "hash", F.unix_micros(F.col("last_modified").cast("timestamp")).alias("last_modified"), "change_detected")


@query(PRINTS + f" SELECT url FROM f WHERE last_crawled < {AS_OF} - INTERVAL 1 DAY")
def fp_stale(spark, sf_dir):
    return state.stale(state.fingerprints(views.processed_urls(spark, sf_dir)), F.expr(f"{AS_OF} - INTERVAL 1 DAY")).select("url")


@query(PRINTS + " SELECT url, CASE WHEN url LIKE '%7' THEN 'new' ELSE hash END AS hash FROM f")
def update_fingerprint(spark, sf_dir):
    found = state.fingerprints(views.processed_urls(spark, sf_dir))
    changed = found.where("url like '%7'").select("url", F.lit("new").alias("hash")).unionByName(spark.createDataFrame([("unknown", "new")], "url string, hash string"))
    return state.updated(found, changed)[0].select("url", "hash")


@query(PRINTS + f" SELECT url, CASE WHEN url LIKE '%1' THEN 'never_ai_processed' WHEN change_detected THEN 'content_changed' WHEN {AS_OF} - last_crawled < INTERVAL 6 HOUR THEN 'ai_recently_processed' WHEN url LIKE '%2' THEN 'high_property_count' ELSE 'no_changes_no_ai_needed' END AS reason FROM f")
def should_use_ai(spark, sf_dir):
    found = state.fingerprints(views.processed_urls(spark, sf_dir))
    found = found.withColumns({"by_model": ~F.col("url").endswith("1"), "listings": F.when(F.col("url").endswith("2"), 11).otherwise(1)})
    return found.select("url", state.model_use(F.expr(AS_OF), "INTERVAL 6 HOURS").alias("reason"))


@query(U + ", c AS (SELECT count(*) AS total, count(*) FILTER (processed_at >= d) AS today, count(*) FILTER (processed_at >= d AND status = 'success') AS success, count(*) FILTER (processed_at >= d AND status = 'skipped') AS skipped FROM last, (SELECT date_trunc('day', max(ts)) AS d FROM events)) SELECT total, today, success * 100.0::DOUBLE / today AS success_rate, skipped * 100.0::DOUBLE / today AS saving_rate, skipped * 2 AS saved_seconds FROM c")
def url_stats_rates(spark, sf_dir):
    log = views.processed_urls(spark, sf_dir)
    day = log.agg(F.date_trunc("DAY", F.max("processed_at")).alias("day"))
    return state.rates(state.statistics(state.latest(log).crossJoin(F.broadcast(day)), F.col("day")))  # one row


@query(U + " SELECT url FROM last ORDER BY processed_at DESC, seq DESC LIMIT 50")
def cleanup_visited(spark, sf_dir):
    return state.newest(views.processed_urls(spark, sf_dir), 50).select("url")


def _stream(spark, sf_dir):
    batch = views.read(spark, sf_dir, "events")
    return spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query(U + " SELECT url, seq, coalesce(lag(hash) OVER (PARTITION BY url ORDER BY processed_at, seq) <> hash, true) AS change_detected FROM log")
def change_detect_stream(spark, sf_dir):
    visits = _stream(spark, sf_dir).select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("processed_at"), F.md5(F.col("event_type").cast("binary")).alias("hash"))
    return drained(changes.detected(visits), "changes").select("url", "seq", "change_detected")


@query(core.ORACLES["rate_limit_window"])
def rate_limit_stream(spark, sf_dir):
    requests = _stream(spark, sf_dir).select(F.col("user_id").cast("long").alias("client"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").cast("long").alias("seq"))
    return drained(rate_limit.limited_stream(requests, 3, 86_400), "limits").select("seq", "allowed")


CACHED = """WITH RECURSIVE e AS (SELECT user_id AS owner, event_type AS key, epoch_us(ts) AS moment, event_id AS seq, ts < (SELECT min(ts) + INTERVAL 3 DAY FROM events) AS early FROM events),
  r AS (SELECT owner, key, moment, seq, row_number() OVER (PARTITION BY owner, key ORDER BY moment, seq) AS k FROM e WHERE NOT early),
  b AS (SELECT owner, key, max(moment) AS put FROM e WHERE early GROUP BY ALL),
  w(owner, key, seq, k, put, outcome) AS (SELECT owner, key, 0, 0, put, '' FROM b UNION ALL SELECT r.owner, r.key, r.seq, 1, r.moment, 'miss' FROM r WHERE k = 1 AND (owner, key) NOT IN (SELECT (owner, key) FROM b)
   UNION ALL SELECT r.owner, r.key, r.seq, r.k, CASE WHEN r.moment - w.put <= 86400000000 THEN w.put ELSE r.moment END, CASE WHEN r.moment - w.put <= 86400000000 THEN 'hit' ELSE 'expired' END FROM w JOIN r ON r.owner = w.owner AND r.key = w.key AND r.k = w.k + 1)"""


def _cached(spark, sf_dir):
    """Requests of events after the third day, to a cache that begins with what was asked for in the first three."""
    events = views.read(spark, sf_dir, "events")
    third = events.agg(F.min("ts") + F.expr("INTERVAL 3 DAYS")).first()[0]
    named = lambda df: df.select(F.col("user_id").cast("long").alias("owner"), F.col("event_type").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").cast("long").alias("seq"), "ts")
    known = named(events).where(F.col("ts") < F.lit(third)).groupBy("owner", "key").agg(F.max("at").alias("put"))
    asked = named(_stream(spark, sf_dir)).where(F.col("ts") >= F.lit(third))
    with cache.rocks(spark):
        return drained(cache.cached(asked, 86_400, known), "cache")


@query(CACHED + " SELECT seq, outcome FROM w WHERE k > 0")
def ttl_cache_stream(spark, sf_dir):
    return _cached(spark, sf_dir).select("seq", "outcome")


@query(CACHED + " SELECT owner, count(*) FILTER (outcome = 'hit') AS hits, count(*) FILTER (outcome = 'miss') AS misses, count(*) FILTER (outcome = 'expired') AS expired FROM w WHERE k > 0 GROUP BY owner")
def ttl_cache_counts(spark, sf_dir):
    """The counters that each owner's state holds in the end."""
    return _cached(spark, sf_dir).groupBy("owner").agg(*[F.max(c).alias(c) for c in ("hits", "misses", "expired")])
