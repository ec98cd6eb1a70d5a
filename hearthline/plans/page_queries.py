"""Queries that classify pages by their words and urls."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline.functions import urls
from hearthline.operators import learn, pages
from hearthline.plans.base import registry, sql_any, sql_count, sql_hits, sql_matches
from hearthline.sources import views

QUERIES, ORACLES, query = registry()

P = f"WITH p AS ({views.PAGE_SQL})"
BOTH = ("text", "title")
BY_URL = f"CASE WHEN {sql_matches('lower(url)', pages.PROPERTY_URLS)} THEN 'property' WHEN {sql_matches('lower(url)', pages.CATALOG_URLS)} THEN 'catalog' END"
CONTENT = f"{P}, s AS (SELECT *, {BY_URL} AS by_url, {sql_hits(BOTH, pages.PROPERTY_WORDS)} AS a, {sql_hits(BOTH, pages.CATALOG_WORDS)} + 3 * ({sql_count('text', 'r$')} > 5)::INT + 2 * ({sql_count('text', 'quartos')} > 3)::INT AS b FROM p)"
BY_CONTENT = "CASE WHEN a > b AND a >= 2 THEN 'property' WHEN b > a AND b >= 2 THEN 'catalog' END"


@query(f"{P} SELECT id, {BY_URL} AS kind FROM p")
def cls_url_basic(spark, sf_dir):
    return views.page_texts(spark, sf_dir).select("id", pages.by_url(F.col("url")).alias("kind"))


@query(f"{CONTENT} SELECT id, {BY_CONTENT} AS kind FROM s")
def cls_content_basic(spark, sf_dir):
    return views.page_texts(spark, sf_dir).select("id", pages.by_content(F.col("text"), F.col("title")).alias("kind"))


@query(f"{CONTENT} SELECT id, coalesce(by_url, {BY_CONTENT}, 'unknown') AS kind FROM s")
def cls_page(spark, sf_dir):
    return views.page_texts(spark, sf_dir).select("id", pages.page(F.col("url"), F.col("text"), F.col("title")).alias("kind"))


@query(f"{P} SELECT id, CASE WHEN {sql_matches('lower(url)', pages.STRICT_CATALOG_URLS)} OR {sql_hits(BOTH, pages.STRICT_CATALOG_WORDS)} > 0 OR {sql_count('text', 'r$')} > 8 OR {sql_count('text', 'quartos')} > 5 OR {sql_count('text', 'imóveis')} > 3 THEN 'catalog' WHEN {sql_matches('lower(url)', pages.STRICT_PROPERTY_URLS)} OR {sql_hits(BOTH, pages.STRICT_PROPERTY_WORDS)} >= 2 THEN 'property' ELSE 'unknown' END AS kind FROM p")
def cls_strict(spark, sf_dir):
    return views.page_texts(spark, sf_dir).select("id", pages.strict(F.col("url"), F.col("text"), F.col("title")).alias("kind"))


@query(f"{P}, s AS (SELECT id, {sql_any('text', pages.VALIDATOR_EXCLUDED)} AS x, {sql_matches('text', pages.VALIDATOR_PRICES)} AS price, {sql_hits(('text',), pages.VALIDATOR_WORDS)} AS n FROM p), c AS (SELECT *, (CASE WHEN x THEN 0 ELSE least((n + 2 * price::INT) / 10.0, 1) END)::DOUBLE AS confidence FROM s) SELECT id, NOT x AND confidence >= 0.4 AND (price OR n >= 3) AS accepted, confidence FROM c")
def cls_content_validator(spark, sf_dir):
    accepted, confidence = pages.validated(F.col("text"))
    return views.page_texts(spark, sf_dir).select("id", accepted.alias("accepted"), confidence.alias("confidence"))


@query(f"{P}, s AS (SELECT id, {sql_hits(('lower(url)',), pages.NAVIGATION_URLS)} AS u, {sql_hits(('text',), pages.NAVIGATION_WORDS)} AS c, ({sql_any('lower(url)', pages.INDIVIDUAL_URLS)} OR regexp_matches(url, '/\\d+/?$')) AND {sql_any('text', pages.INDIVIDUAL_WORDS)} AS single FROM p), k AS (SELECT id, CASE WHEN u >= 1 AND c >= 2 OR u >= 2 THEN 'catalog' WHEN single THEN 'property' ELSE 'generic' END AS kind FROM s) SELECT id, kind, CASE kind WHEN 'catalog' THEN 0.9 WHEN 'property' THEN 0.8 ELSE 0.3 END::DOUBLE AS confidence FROM k")
def cls_navigation(spark, sf_dir):
    kind, confidence = pages.navigation(F.col("url"), F.col("text"))
    return views.page_texts(spark, sf_dir).select("id", kind.alias("kind"), confidence.alias("confidence"))


@query(f"{P} SELECT id FROM p WHERE {sql_any('url', pages.INCREMENTAL_URLS)} AND ({sql_count('text', 'r$')} > 5 OR {sql_count('text', 'quartos')} > 3)")
def cls_catalog_incremental(spark, sf_dir):
    return views.page_texts(spark, sf_dir).where(pages.catalog_incremental(F.col("url"), F.col("text"))).select("id")


@query(P + f", s AS (SELECT id, {sql_any('text', pages.LEARNER_CATALOG)} AS a, {sql_any('text', pages.LEARNER_PROPERTY)} AS b, len(regexp_extract_all(raw, 'R\\$\\s*[\\d.,]+')) AS n, len(regexp_extract_all(text, 'im[óo]veis')) AS m FROM p) SELECT id, CASE WHEN a THEN 'catalog' WHEN b THEN 'property' WHEN n > 3 OR m > 8 THEN 'catalog' END AS kind, CASE WHEN a THEN 0.95 WHEN b THEN 0.90 WHEN n > 3 THEN 0.85 WHEN m > 8 THEN 0.80 END::DOUBLE AS confidence FROM s")
def cls_content_learned(spark, sf_dir):
    """The rules that come before what was learned."""
    kind, confidence = pages.by_phrases(F.col("text"), pages.prices(F.col("raw")))
    return views.page_texts(spark, sf_dir).select("id", kind.alias("kind"), confidence.alias("confidence"))


@query(f"{P} SELECT id, {sql_hits(('text',), pages.SITE_WORDS)} >= 3 AS by_three, {sql_hits(('text',), pages.SITE_WORDS)} >= 1 AS by_one FROM p")
def cls_site(spark, sf_dir):
    return views.page_texts(spark, sf_dir).select("id", pages.site(F.col("text")).alias("by_three"), pages.site(F.col("text"), 1).alias("by_one"))


@query(f"{P} SELECT id FROM p WHERE regexp_matches(text, 'r\\$') AND regexp_matches(text, 'quartos|dormitórios|rua|avenida')")
def traditional_property(spark, sf_dir):
    return views.page_texts(spark, sf_dir).where(pages.talks_of_listing(F.col("text"))).select("id")


@query(f"{P} SELECT id, false AS catalog, true AS property FROM p")
def stubs(spark, sf_dir):
    """The simplified rules: nothing is a catalogue, everything may be a listing."""
    return views.page_texts(spark, sf_dir).select("id", F.lit(False).alias("catalog"), F.lit(True).alias("property"))


PATH = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1))"
REFERENCE = rf"regexp_replace(regexp_replace({PATH}, '\d+', '{{ID}}', 'g'), '[a-f0-9]{{8,}}', '{{GUID}}', 'g')"
R = f"{P}, r AS (SELECT id, {PATH} AS path, {REFERENCE} AS pattern FROM p)"


@query(f"{R} SELECT id, pattern, array_to_string(list_filter(string_split(pattern, '/'), lambda x: x <> '' AND NOT contains(x, '{{')), ',') AS parts, array_to_string(list_filter({list(pages.KIND_WORDS)!r}, lambda w: contains(lower(pattern), w)), ',') AS words FROM r")
def ref_path_pattern(spark, sf_dir):
    found = views.page_texts(spark, sf_dir).select("id", pages.reference_path(F.col("url")).alias("pattern"))
    return found.select("id", "pattern", F.array_join(pages.required_parts(F.col("pattern")), ",").alias("parts"), F.array_join(pages.keywords(F.col("pattern")), ",").alias("words"))


LEARNED = "n AS (SELECT pattern FROM r GROUP BY pattern HAVING count(*) >= 2)"
PARTS = "string_split({0}, '/')"
SAME = f"len(list_filter(list_zip({PARTS.format('r.pattern')}, {PARTS.format('n.pattern')}), lambda z: z[1] = z[2] OR contains(z[1], '{{') AND contains(z[2], '{{')))"
SIMILAR = f"CASE WHEN r.pattern = n.pattern THEN 1.0 ELSE {SAME} / greatest(len({PARTS.format('r.pattern')}), len({PARTS.format('n.pattern')}))::DOUBLE END"


@query(f"""{R}, {LEARNED}, b AS (SELECT id, path, coalesce(max({SIMILAR}), 0) AS best FROM r LEFT JOIN n ON true GROUP BY id, path)
  SELECT id, round(confidence, 9) AS confidence, round(confidence, 9) >= 0.6 AS accepted FROM (SELECT id, CASE WHEN {sql_matches('path', pages.EXCLUDED_PATHS)} OR NOT {sql_any('path', pages.KIND_WORDS)} THEN 0
    ELSE best + 0.2 * regexp_matches(path, '/\\d+/?$')::INT + 0.1 * ({sql_count('path', '/')} >= 3)::INT - 0.3 * ({sql_count('path', '/')} <= 1)::INT END::DOUBLE AS confidence FROM b)""")
def cls_ref_url(spark, sf_dir):
    found = views.page_texts(spark, sf_dir)
    return learn.by_reference(found, learn.reference_patterns(found))


@query(f"{R}, c AS (SELECT pattern, count(*) AS n FROM r GROUP BY pattern) SELECT pattern, n, n / (SELECT count(*) FROM r)::DOUBLE AS confidence FROM c WHERE n >= 2")
def ref_url_pattern(spark, sf_dir):
    return learn.reference_patterns(views.page_texts(spark, sf_dir))


GENERAL = r"""WITH v AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'catalog' ELSE 'property' END AS kind, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS whole, regexp_extract(url, '\?([^#]*)', 1) AS q FROM p),
 t AS (SELECT *, regexp_replace(whole, '/$', '') AS path FROM v),
 g AS (SELECT id, kind, host, unnest(list_filter([path, CASE WHEN regexp_matches(path, '\d') THEN regexp_replace(path, '\d+', '{id}', 'g') END,
   CASE WHEN len(string_split(path, '/')) > 2 THEN concat(array_to_string(list_slice(string_split(path, '/'), 1, 3), '/'), '/*') END,
   CASE WHEN len(string_split(path, '/')) > 3 AND regexp_matches(list_extract(string_split(path, '/'), -1), '\d') THEN concat(regexp_replace(path, '/[^/]*$', ''), '/{id}') END], lambda x: x IS NOT NULL)) AS pattern FROM t
  UNION ALL SELECT id, kind, host, unnest(list_filter([CASE WHEN regexp_matches(q, 'page=|pagina=') THEN 'has_pagination' END, CASE WHEN regexp_matches(q, 'filtro|filter') THEN 'has_filters' END, CASE WHEN regexp_matches(q, 'ordenar|sort') THEN 'has_sorting' END,
   CASE WHEN regexp_matches(q, 'busca|search|q=') THEN 'has_search' END], lambda x: x IS NOT NULL)) FROM t)"""
GENERAL = f"{P}, " + GENERAL.removeprefix("WITH ")
MERGED = ", h AS (SELECT kind, host, pattern, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 2), m AS (SELECT kind, pattern, sum(n)::BIGINT AS n, least(sum(n) / 10.0, 1)::DOUBLE AS confidence FROM h GROUP BY ALL)"


@query(GENERAL + " SELECT id, pattern FROM g")
def path_generalise(spark, sf_dir):
    return learn.generalised(_labelled(spark, sf_dir)).select("id", "pattern")


@query(GENERAL + MERGED + " SELECT kind, pattern, n, confidence FROM m")
def pipe_learn_urls(spark, sf_dir):
    return learn.url_patterns(_labelled(spark, sf_dir))


MATCH = r"""CASE WHEN contains(pattern, '/') AND (whole = pattern OR ends_with(pattern, '/*') AND starts_with(whole, left(pattern, len(pattern) - 2))
   OR contains(pattern, '{id}') AND regexp_full_match(whole, replace(regexp_replace(pattern, '([.*+?()|])', '\\\1', 'g'), '{id}', '\d+'))) THEN confidence
  WHEN (pattern = 'has_pagination' AND regexp_matches(q, 'page=|pagina=')) OR (pattern = 'has_filters' AND regexp_matches(q, 'filtro|filter')) OR (pattern = 'has_sorting' AND regexp_matches(q, 'ordenar|sort')) OR (pattern = 'has_search' AND regexp_matches(q, 'busca|search|q=')) THEN 0.8 * confidence ELSE 0 END"""


@query(GENERAL + MERGED + f", x AS (SELECT id, max(CASE WHEN m.kind = 'catalog' THEN {MATCH} ELSE 0 END) AS a, max(CASE WHEN m.kind = 'property' THEN {MATCH} ELSE 0 END) AS b FROM t, m GROUP BY id) SELECT id, CASE WHEN a > b AND a > 0.1 THEN 'catalog' WHEN b > a AND b > 0.1 THEN 'property' ELSE 'unknown' END AS kind, round(CASE WHEN a <> b AND greatest(a, b) > 0.1 THEN greatest(a, b) ELSE 0 END, 9)::DOUBLE AS confidence FROM x")
def cls_url_learned(spark, sf_dir):
    labelled = _labelled(spark, sf_dir)
    return learn.by_url_patterns(labelled, learn.url_patterns(labelled))


def _labelled(spark, sf_dir):
    return views.page_texts(spark, sf_dir).select("id", "url", F.when(F.col("id") % 3 == 0, "catalog").otherwise("property").alias("kind"))


@query("WITH n AS (SELECT p_partkey AS id, (p_partkey % 15)::INT AS n FROM part) SELECT id, least(n / 10.0, 1)::DOUBLE AS by_url, least(greatest(n / 5.0, 0.3), 1)::DOUBLE AS by_content, round(least(0.3 + (n - 1) * 0.1, 0.95), 9)::DOUBLE AS by_reference FROM n")
def conf_examples(spark, sf_dir):
    n = (F.col("p_partkey") % 15).cast("int")
    return views.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), learn.url_confidence(n).alias("by_url"), learn.content_confidence(n).alias("by_content"), F.round(learn.reference_confidence(n), 9).alias("by_reference"))


@query(f"{R}, q AS (SELECT id, unnest(string_split(pattern, '/')) AS part FROM r) SELECT id, part, count(*) AS n FROM q WHERE part <> '' AND NOT contains(part, '{{') GROUP BY ALL")
def ref_required_parts(spark, sf_dir):
    """The segments that a reference path must have, each with how many times."""
    found = views.page_texts(spark, sf_dir).select("id", F.explode(pages.required_parts(pages.reference_path(F.col("url")))).alias("part"))
    return found.groupBy("id", "part").agg(F.count("*").alias("n"))


@query(f"{R}, q AS (SELECT id, unnest(list_filter({list(pages.KIND_WORDS)!r}, lambda w: contains(lower(pattern), w))) AS word FROM r) SELECT word, count(*) AS paths FROM q GROUP BY word")
def ref_keywords(spark, sf_dir):
    """How many reference paths speak of each kind of listing."""
    found = views.page_texts(spark, sf_dir).select(F.explode(pages.keywords(pages.reference_path(F.col("url")))).alias("word"))
    return found.groupBy("word").agg(F.count("*").alias("paths"))


@query(f"""WITH q AS (SELECT id, regexp_extract(link, '^[^?#]*\\?([^#]*)', 1) AS q FROM ({views.LINK_SQL}))
  SELECT id, array_to_string(list_filter([CASE WHEN regexp_matches(q, 'page=|pagina=') THEN 'has_pagination' END, CASE WHEN regexp_matches(q, 'filtro|filter') THEN 'has_filters' END, CASE WHEN regexp_matches(q, 'ordenar|sort') THEN 'has_sorting' END,
  CASE WHEN regexp_matches(q, 'busca|search|q=') THEN 'has_search' END], lambda x: x IS NOT NULL), ',') AS uses FROM q""")
def query_features(spark, sf_dir):
    """What each link's query string is used for."""
    return views.links(spark, sf_dir).select("id", F.array_join(learn.query_uses(urls.query(F.col("link"))), ",").alias("uses"))


HOST = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
WHOLE = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
BASE = "CASE WHEN ends_with({0}, '.br') THEN array_to_string(list_slice(string_split(regexp_replace({0}, '^www\\.', ''), '.'), -3, -1), '.') ELSE array_to_string(list_slice(string_split(regexp_replace({0}, '^www\\.', ''), '.'), -2, -1), '.') END"


@query(rf"""{P}, r AS (SELECT id, {HOST} AS host, {WHOLE} AS path FROM p), s AS (SELECT id, host, path, {BASE.format('host')} AS base FROM r),
  n AS (SELECT concat(host, ' ', regexp_replace(path, '\d+', '{{id}}', 'g')) AS name, host AS domain, base AS known, regexp_replace(path, '\d+', '{{id}}', 'g') AS pattern, least(0.3 + (count(*) - 1) * 0.1, 0.95)::DOUBLE AS confidence FROM s GROUP BY ALL),
  d AS (SELECT DISTINCT host, base, path FROM s),
  m AS (SELECT host, path, name, round(CASE WHEN base = known THEN 0.4 WHEN contains(host, known) OR contains(known, base) THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN regexp_full_match(path, replace(regexp_replace(pattern, '([.*+?()|\[\]])', '\\\1', 'g'), '{{id}}', '\d+')) THEN 0.3 ELSE 0 END::DOUBLE + 0.3 * confidence, 9) AS score FROM d, n),
  b AS (SELECT host, path, name, score FROM m QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY score DESC, name) = 1)
  SELECT id, name, score FROM s JOIN b USING (host, path)""")
def ref_match(spark, sf_dir):
    """The best reference pattern of each page, of patterns learned from all."""
    found = views.page_texts(spark, sf_dir).select("id", "url")
    host, pattern = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), urls.shape(urls.path(F.col("url")))
    counted = found.groupBy(host.alias("domain"), pattern.alias("pattern")).agg(F.count("*").alias("n"))
    learned = counted.select(F.concat_ws(" ", "domain", "pattern").alias("name"), "domain", "pattern", learn.reference_confidence(F.col("n")).alias("confidence"))
    return learn.best_reference(found, learned)
