"""Queries over links, addresses and where sites may be found."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hearthline.functions import urls
from hearthline.operators import links, schedule
from hearthline.plans.base import registry, sql_any
from hearthline.sources import views

QUERIES, ORACLES, query = registry()

K = f"WITH k AS ({views.LINK_SQL})"
HOST = r"lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"
NUMBER_END = r"regexp_matches(link, '/\d+/?$')"


@query(f"{K} SELECT id, {sql_any('lower(link)', links.SKIPPED)} AS plain, link = '' OR {sql_any('lower(link)', links.SOCIAL)} AS incremental, link <> '' AND contains(link, 'site1') AND NOT {sql_any('lower(link)', links.SOCIAL + links.FILES)} AS internal FROM k")
def link_skip(spark, sf_dir):
    c = F.col("link")
    return views.links(spark, sf_dir).select("id", links.skipped(c).alias("plain"), links.skipped_incremental(c).alias("incremental"), links.internal(c, F.lit("site1")).alias("internal"))


@query(f"{K} SELECT id FROM k WHERE link <> '' AND contains(link, {HOST.format('parent')}) AND NOT {sql_any('lower(link)', links.CONTACT)} AND NOT (" + " OR ".join(f"ends_with(lower(link), '{e}')" for e in links.FILE_ENDS) + ")")
def link_valid(spark, sf_dir):
    return views.links(spark, sf_dir).where(links.valid(F.col("link"), F.col("parent"))).select("id")


@query(f"{K} SELECT id, {sql_any('lower(link)', links.PRIORITY)} AS priority, {sql_any('lower(link)', links.LOW)} AS low FROM k")
def link_priority(spark, sf_dir):
    return views.links(spark, sf_dir).select("id", links.priority(F.col("link")).alias("priority"), links.low(F.col("link")).alias("low"))


LIKELY = sql_any("lower(link)", links.LIKELY_PATHS)


@query(f"{K} SELECT id, link <> '' AND ({sql_any('lower(link)', links.LISTING_PATHS)} OR {NUMBER_END} OR regexp_matches(lower(link), '{links.LISTING_PARAMETERS}')) AS navigation, {LIKELY} AS likely, {LIKELY} OR regexp_matches(lower(link), '/[^/]*[0-9][^/]*$') AND strlen(regexp_extract(lower(link), '[^/]*$')) > 3 AS code FROM k")
def link_property_like(spark, sf_dir):
    c = F.col("link")
    return views.links(spark, sf_dir).select("id", links.like_listing(c).alias("navigation"), links.likely_listing(c).alias("likely"), links.likely_listing_or_code(c).alias("code"))


@query(f"{K} SELECT id, {HOST.format('link')} <> '' AND {sql_any('lower(link)', links.SITE_WORDS)} AS discovery, starts_with(link, 'https://') AND ({HOST.format('link')} LIKE '%.com.br' OR {sql_any(HOST.format('link'), links.HOST_WORDS)}) AS searched FROM k")
def site_url_valid(spark, sf_dir):
    c = F.col("link")
    return views.links(spark, sf_dir).select("id", links.site_url(c).alias("discovery"), links.site_url_searched(c).alias("searched"))


@query(f"{K} SELECT id FROM k WHERE {HOST.format('link')} NOT IN ('', {HOST.format('parent')})")
def link_external(spark, sf_dir):
    return views.links(spark, sf_dir).where(links.external(F.col("link"), F.col("parent"))).select("id")


@query(f"{K} SELECT id FROM k WHERE regexp_matches(label, '(?i)imovel|casa|apartamento') AND NOT regexp_matches(link, '/(imovel|propriedade|casa)/')")
def should_ai_link(spark, sf_dir):
    return views.links(spark, sf_dir).where(links.unclear(F.col("link"), F.col("label"))).select("id")


@query(f"{K} SELECT id, rank FROM (SELECT id, row_number() OVER (PARTITION BY parent ORDER BY NOT {sql_any('lower(link)', links.PRIORITY)}, id) AS rank FROM k WHERE NOT {sql_any('lower(link)', links.LOW)}) WHERE rank <= 20")
def limit_links(spark, sf_dir):
    """The links followed from pages six steps deep."""
    return links.followed(views.links(spark, sf_dir), 6).select("id", "rank")


@query(f"{K} SELECT id, row_number() OVER (PARTITION BY parent ORDER BY p, id) AS rank FROM (SELECT id, parent, 0 AS p FROM k WHERE {sql_any('lower(link)', links.PRIORITY)} UNION ALL SELECT id, parent, 1 FROM k WHERE NOT {sql_any('lower(link)', links.PRIORITY)}) QUALIFY rank <= 50")
def union_priority(spark, sf_dir):
    return links.followed(views.links(spark, sf_dir), 1).select("id", "rank")


CRAWL_BASE = r"concat(regexp_extract(link, '^([a-z]+://[^/?#]*)', 1), regexp_replace(replace(regexp_extract(link, '^[a-z]+://[^/?#]*([^?#]*)', 1), '//', '/'), '/$', ''))"
PARAMETERS = "array_to_string(list_sort(list_filter(string_split(regexp_extract(link, '\\?([^#]*)', 1), '&'), lambda p: p <> '' AND {0})), '&')"
KEY = "lower(split_part(p, '=', 1))"
CRAWL_PARAMETERS = PARAMETERS.format(f"regexp_matches({KEY}, 'id|imovel|property|codigo')")
FOUND_PARAMETERS = PARAMETERS.format(f"NOT regexp_matches({KEY}, 'utm|ref|source')")


@query(f"{K} SELECT id, CASE WHEN {HOST.format('link')} = '' THEN link WHEN {CRAWL_PARAMETERS} = '' THEN {CRAWL_BASE} ELSE concat({CRAWL_BASE}, '?', {CRAWL_PARAMETERS}) END AS url FROM k")
def url_norm_crawl(spark, sf_dir):
    return views.links(spark, sf_dir).select("id", urls.for_crawl(F.col("link")).alias("url"))


FOUND_BASE = "replace(regexp_extract(link, '^[^?#]*'), '://www.', '://')"


@query(f"{K} SELECT id, CASE WHEN {HOST.format('link')} = '' THEN link WHEN {FOUND_PARAMETERS} = '' THEN {FOUND_BASE} ELSE concat({FOUND_BASE}, '?', {FOUND_PARAMETERS}) END AS url FROM k")
def url_norm_discovery(spark, sf_dir):
    return views.links(spark, sf_dir).select("id", urls.for_discovery(F.col("link")).alias("url"))


RESOLVED = "CASE WHEN {0} IS NULL OR {0} = '' THEN '' WHEN starts_with({0}, 'http') THEN {0} WHEN starts_with({0}, '/') THEN concat('https://', " + HOST.format("parent") + ", {0}) WHEN ends_with(parent, '/') THEN concat(parent, {0}) ELSE concat(parent, '/', {0}) END"


@query(f"{K}, r AS (SELECT id, parent, regexp_replace(link, '^https://[^/]*', '') AS rest FROM k) SELECT id, {RESOLVED.format('rest')} AS url FROM r")
def url_resolve(spark, sf_dir):
    found = views.links(spark, sf_dir).withColumn("rest", F.regexp_replace("link", "^https://[^/]*", ""))
    return found.select("id", urls.resolved(F.col("rest"), F.col("parent")).alias("url"))


@query(K + r", o AS (SELECT id, parent, nullif(regexp_extract(onclick, '(window\.location=|location\.href=|window\.open\()[''\x22]([^''\x22]+)[''\x22]', 2), '') AS target FROM k) SELECT id, " + RESOLVED.format("target") + " AS url FROM o")
def url_from_onclick(spark, sf_dir):
    return views.links(spark, sf_dir).select("id", urls.from_onclick(F.col("onclick"), F.col("parent")).alias("url"))


PLAIN_CITY = "strip_accents(lower(cidade))"


@query(f"WITH l AS ({views.LISTING_SQL}) SELECT DISTINCT cidade, regexp_replace({PLAIN_CITY}, '[^a-z0-9]', '', 'g') AS domain, replace({PLAIN_CITY}, ' ', '-') AS path FROM l")
def city_slug(spark, sf_dir):
    return views.listings(spark, sf_dir).select("cidade").distinct().select("cidade", urls.city_domain(F.col("cidade")).alias("domain"), urls.city_path(F.col("cidade")).alias("path"))


@query("SELECT n_name AS city, concat('https://', replace(t, '%s', regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g'))) AS url FROM nation, (SELECT unnest(" + repr(list(links.DOMAINS)) + ") AS t)")
def cross_templates(spark, sf_dir):
    return views.read(spark, sf_dir, "nation").select(F.col("n_name").alias("city"), F.explode(links.domain_guesses(F.col("n_name"))).alias("url"))


@query(f"{K}, b AS (SELECT DISTINCT regexp_extract(parent, '^(https://[^/]*)', 1) AS base FROM k) SELECT base, concat(base, t) AS url FROM b, (SELECT unnest({list(links.CATALOG_PATHS)!r}) AS t)")
def known_catalog_urls(spark, sf_dir):
    bases = views.links(spark, sf_dir).select(F.regexp_extract("parent", "^(https://[^/]*)", 1).alias("base")).distinct()
    return bases.select("base", F.explode(links.catalog_urls(F.col("base"))).alias("url"))


@query(f"{K}, f AS (SELECT id, regexp_extract(parent, '^(https://[^/]*)', 1) AS base FROM k WHERE id % 2 = 0), u AS (SELECT id, concat(base, t) AS url FROM f, (SELECT unnest({list(links.CATALOG_PATHS)!r}) AS t) UNION ALL SELECT id, concat(base, '/busca', CASE t WHEN '' THEN '' ELSE concat('?', t) END) FROM f, (SELECT unnest({list(links.FORM_PARAMETERS)!r}) AS t)) SELECT * FROM u")
def form_urls(spark, sf_dir):
    base = F.regexp_extract("parent", "^(https://[^/]*)", 1)
    method = F.when(F.col("id") % 2 == 0, "GET").otherwise("POST")
    return views.links(spark, sf_dir).select("id", F.explode(links.form_urls(F.concat(base, F.lit("/busca")), method, F.col("parent"))).alias("url"))


@query("WITH c AS (SELECT n_name AS city, s_name AS url, s_suppkey % 3 AS strategy, s_suppkey AS seq FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT n_name, s_name, 4, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey), f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY city, url ORDER BY strategy, seq) = 1) SELECT city, url, strategy, row_number() OVER (PARTITION BY city ORDER BY strategy, seq, url) AS rank FROM f QUALIFY rank <= 20")
def union_strategies_distinct(spark, sf_dir):
    sites = views.read(spark, sf_dir, "supplier").join(F.broadcast(views.read(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    one = sites.select(F.col("n_name").alias("city"), F.col("s_name").alias("url"), (F.col("s_suppkey") % 3).alias("strategy"), F.col("s_suppkey").alias("at"))
    return links.distinct_by_strategy(one.unionByName(one.withColumn("strategy", F.lit(4).cast(one.schema["strategy"].dataType))), 20)


SCHEDULED = f"""{K}, g AS (SELECT id, link, {HOST.format('link')} AS host, id % 4 AS depth, CASE WHEN {sql_any('lower(link)', links.PRIORITY)} THEN 0 WHEN {sql_any('lower(link)', links.LOW)} THEN 2 ELSE 1 END AS place
  FROM k WHERE NOT {sql_any('lower(link)', links.SKIPPED)} AND id % 4 <= 2),
  t AS (SELECT id, host, (row_number() OVER (PARTITION BY host ORDER BY place, depth, id) - 1) // 2 * 3 AS start FROM g)"""


def _fetched(spark, sf_dir):
    return views.links(spark, sf_dir).select("id", F.col("link").alias("url"), (F.col("id") % 4).alias("depth"))


@query(SCHEDULED + " SELECT id, host, start FROM t")
def fetch_schedule(spark, sf_dir):
    """When each url is fetched, by two at once for a host and three seconds between."""
    return schedule.polite(_fetched(spark, sf_dir), slots=2, delay=3, max_depth=2).select("id", "host", "start")


@query(SCHEDULED + " SELECT host, count(*) AS urls, max(start) AS last FROM t WHERE start < 60 GROUP BY host")
def fetch_budget(spark, sf_dir):
    """What a minute's crawl fetches of each host."""
    timed = schedule.polite(_fetched(spark, sf_dir), slots=2, delay=3, horizon=60, max_depth=2)
    return timed.groupBy("host").agg(F.count("*").alias("urls"), F.max("start").alias("last"))


@query(f"{K} SELECT count(*) AS found, count(*) FILTER ({sql_any('lower(link)', links.SKIPPED)}) AS skipped, count(*) FILTER (NOT {sql_any('lower(link)', links.SKIPPED)}) AS read, count(*) FILTER (NOT {sql_any('lower(link)', links.SKIPPED)} AND {sql_any('lower(link)', links.PRIORITY)}) AS priority FROM k")
def crawl_counts(spark, sf_dir):
    """What the stages of a crawl let through, counted while it runs."""
    url = F.col("link")
    found, first = schedule.watched(views.links(spark, sf_dir).select("id", "link"), f"found-{uuid.uuid4().hex}", skipped=links.skipped(url))
    read, second = schedule.watched(found.where(~links.skipped(url)), f"read-{uuid.uuid4().hex}", priority=links.priority(url))
    read.write.format("noop").mode("overwrite").save()
    counts = (first.get["rows"], first.get["skipped"], second.get["rows"], second.get["priority"])
    return spark.createDataFrame([counts], "found long, skipped long, read long, priority long")
