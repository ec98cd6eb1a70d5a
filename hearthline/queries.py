"""Registry of the listing-engine queries and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.functions import extract, hashing, text, urls
from hearthline.operators import classify, frontier, learn, markup, quality, registry, search, state
from hearthline.sources import views
from hearthline.streaming import rate_limit

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


L = f"WITH l AS ({views.LISTING_SQL})"
C = """WITH s AS (SELECT n_name AS city, r_name AS region, s_name AS url, CASE WHEN s_acctbal > 0 THEN 'active' ELSE 'inactive' END AS status, s_acctbal AS balance
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
U = """WITH log AS (SELECT event_id AS seq, concat('u', user_id) AS url, ts AS processed_at,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'skipped' ELSE 'success' END AS status, md5(event_type) AS hash FROM events),
  last AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY url ORDER BY processed_at DESC, seq DESC) = 1)"""
ASKED = search.SearchFilter(q="imóvel bolt", valor_min=900, valor_max=1_500_000)
NORM = r"trim(regexp_replace(regexp_replace(strip_accents(lower({0})), '[^a-z0-9\t\n\f\r ]', '', 'g'), '[\t\n\f\r ]+', ' ', 'g'))"
CONTENT = r"lower(trim(regexp_replace({0}, '[\n\t\r ]+', ' ', 'g')))"
URL1 = r"regexp_replace(replace(replace(url, '%20', ''), '//', '/'), '/$', '')"
URL = f"trim(lower(CASE WHEN instr({URL1}, '?') = 0 OR regexp_matches(regexp_extract({URL1}, '\\?(.*)', 1), 'id=|imovel=') THEN {URL1} ELSE regexp_replace({URL1}, '\\?.*', '') END))"
WHERE = "regexp_matches(concat_ws(chr(10), endereco, cidade, bairro, descricao, tipo_imovel), '(?i)imovel|bolt') AND valor BETWEEN 900 AND 1500000"


def _relevance(column: str, weight: float) -> str:
    plain = NORM.format(column)
    return f"{weight} * (({' + '.join(f'len(regexp_extract_all({plain}, {w!r})) * {1 + len(w) / 10}' for w in ('imovel', 'bolt'))}) / 2.0)"


SCORE = " + ".join(_relevance(c, w) for c, w in search.WEIGHTS.items())


@query(f"{L} SELECT id, valor, score FROM (SELECT id, valor, round({SCORE}, 6) AS score FROM l WHERE {WHERE} ORDER BY valor DESC, id LIMIT 10) ORDER BY score DESC")
def search_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.page(views.listings(spark, sf_dir), ASKED).select("id", "valor", F.round("score", 6).alias("score"))


@query(f"{L} SELECT count(*) AS total, CAST(ceil(count(*) / 10.0) AS BIGINT) AS total_pages FROM l WHERE {WHERE}")
def count_filtered(spark, sf_dir):
    return search.totals(views.listings(spark, sf_dir), ASKED)


@query(f"{L} SELECT id FROM l WHERE regexp_matches(concat_ws(chr(10), endereco, cidade, bairro, descricao, tipo_imovel), '(?i)imovel|bolt')")
def f_keyword(spark, sf_dir):
    return search.matching(views.listings(spark, sf_dir), search.SearchFilter(q="imóvel bolt")).select("id")


@query(f"{L} SELECT id FROM l WHERE regexp_matches(cidade, '(?i)sao paulo')")
def f_city(spark, sf_dir):
    return search.matching(views.listings(spark, sf_dir), search.SearchFilter(cidade="São Paulo")).select("id")


@query(f"{L} SELECT id FROM l WHERE {NORM.format('cidade')} LIKE '%sao paulo%'")
def f_city_fixed(spark, sf_dir):
    return search.matching(views.listings(spark, sf_dir), search.SearchFilter(cidade="São Paulo", fixed=True)).select("id")


@query(f"{L} SELECT id FROM l WHERE quartos BETWEEN 2 AND 4 AND banheiros >= 1 AND area_total <= 90")
def f_ranges(spark, sf_dir):
    return search.matching(views.listings(spark, sf_dir), search.SearchFilter(quartos_min=2, quartos_max=4, banheiros_min=1, area_max=90)).select("id")


@query(f"{L} SELECT id, round({SCORE}, 6) AS score FROM l ORDER BY score DESC, valor DESC, id LIMIT 20")
def rank_relevance(spark, sf_dir):
    return _ranked(views.listings(spark, sf_dir))


def _ranked(listings: DataFrame) -> DataFrame:
    scored = listings.select("id", "valor", F.round(search.score("imóvel bolt"), 6).alias("score"))
    return scored.orderBy(F.desc("score"), F.desc("valor"), "id").limit(20).select("id", "score")


@query(f"SELECT doc_id, {NORM.format('text')} AS plain FROM documents")
def normalize_text(spark, sf_dir):
    return views.read(spark, sf_dir, "documents").select("doc_id", text.normalize(F.col("text")).alias("plain"))


@query(f"{L} SELECT id, array_to_string(list_filter(string_split({NORM.format('descricao')}, ' '), lambda t: len(t) >= 2 AND t NOT IN {text.STOP_WORDS!r}), ',') AS terms FROM l")
def search_terms(spark, sf_dir):
    return views.listings(spark, sf_dir).select("id", F.array_join(text.terms(F.col("descricao")), ",").alias("terms"))


@query(f"{L} SELECT id, regexp_replace(regexp_replace(descricao, '(?i)casa', '<mark>\\0</mark>', 'g'), '(?i)amplo', '<mark>\\0</mark>', 'g') AS marked FROM l")
def highlight(spark, sf_dir):
    return views.listings(spark, sf_dir).select("id", text.highlight(F.col("descricao"), ["casa", "amplo"]).alias("marked"))


@query(f"SELECT doc_id, {CONTENT.format('text')} AS content FROM documents")
def content_normalise(spark, sf_dir):
    return views.read(spark, sf_dir, "documents").select("doc_id", text.content(F.col("text")).alias("content"))


@query(f"{L} SELECT id, substr(trim(translate(descricao, '<>\"''&', '')), 1, 40) AS clean, CASE WHEN strlen(descricao) > 60 THEN concat(substr(descricao, 1, 60), '...') ELSE descricao END AS short FROM l")
def f_sanitize(spark, sf_dir):
    return views.listings(spark, sf_dir).select("id", text.sanitize(F.col("descricao"), 40).alias("clean"), text.truncate(F.col("descricao"), 60).alias("short"))


@query(f"{L} SELECT id, {URL} AS url FROM l")
def url_norm_hash(spark, sf_dir):
    return views.listings(spark, sf_dir).select("id", urls.for_hash(F.col("url")).alias("url"))


@query(r"SELECT page_id, regexp_replace(url, '[?#].*', '') AS clean, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host FROM pages")
def url_domain(spark, sf_dir):
    return views.read(spark, sf_dir, "pages").select("page_id", urls.without_query(F.col("url")).alias("clean"), urls.host(F.col("url")).alias("host"))


P = r"WITH p AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host, regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '\d+', '{id}', 'g') AS shape FROM pages)"


@query(P + " SELECT host, shape, count(*) AS n FROM p GROUP BY ALL HAVING count(*) >= 2")
def url_pattern_learn(spark, sf_dir):
    return learn.shapes(views.read(spark, sf_dir, "pages"))


@query(P + ", k AS (SELECT host, shape, count(*) AS n FROM p GROUP BY ALL HAVING count(*) >= 2) SELECT page_id, CASE WHEN n IS NOT NULL THEN least(n / 10.0::DOUBLE, 1.0) END AS confidence FROM p LEFT JOIN k USING (host, shape)")
def pattern_match(spark, sf_dir):
    pages = views.read(spark, sf_dir, "pages")
    return learn.matched(pages, learn.shapes(pages))


@query(P + " SELECT DISTINCT host, array_to_string(list_slice(string_split(regexp_replace(host, '^www\\.', ''), '.'), -2, -1), '.') AS base FROM p")
def base_domain(spark, sf_dir):
    return views.read(spark, sf_dir, "pages").select(urls.host(F.col("url")).alias("host")).distinct().withColumn("base", urls.base_domain(F.col("host")))


HASH = f"""CASE WHEN {CONTENT.format('endereco')} = '' AND {CONTENT.format('descricao')} = '' AND {CONTENT.format('cidade')} = '' AND printf('%.0f', valor) = '0'
  THEN sha256(concat_ws('|', 'empty_property', {URL}, tipo_imovel)) ELSE sha256(concat_ws('|', {", ".join(CONTENT.format(c) for c in ("endereco", "descricao", "cidade", "bairro"))},
  printf('%.0f', valor), printf('%.0f', area_total), quartos, banheiros, {URL})) END"""


@query(f"{L} SELECT id, {HASH} AS hash FROM l")
def listing_hash(spark, sf_dir):
    return views.listings(spark, sf_dir).select("id", hashing.listing_hash().alias("hash"))


@query("SELECT n_name AS city, sha256(concat('city:', lower(n_name), '|state:', upper(r_name))) AS hash FROM nation JOIN region ON n_regionkey = r_regionkey")
def city_hash(spark, sf_dir):
    return views.read(spark, sf_dir, "nation").join(F.broadcast(views.read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("city"), hashing.city_hash(F.col("n_name"), F.col("r_name")).alias("hash"))


PRICE = "regexp_extract(regexp_replace(descricao, '[^\\d,.]', '', 'g'), '\\d{1,3}(?:\\.\\d{3})*(?:,\\d{1,2})?')"


@query(f"{L} SELECT id, coalesce(try_cast(regexp_extract(lower(descricao), '(\\d+)[\\t\\n\\f\\r ]*(?:quartos?|dormitórios?|dorms?|suítes?)', 1) AS INT), 0) AS rooms, coalesce(try_cast(regexp_extract(lower(descricao), '(\\d+)[\\t\\n\\f\\r ]*(?:banheiros?|lavabos?)', 1) AS INT), 0) AS baths, coalesce(try_cast(replace(regexp_extract(descricao, '(\\d+(?:[,.]\\d+)?)[\\t\\n\\f\\r ]*m²', 1), ',', '.') AS DOUBLE), 0) AS area FROM l")
def x_rooms_baths_area(spark, sf_dir):
    d = F.col("descricao")
    return views.listings(spark, sf_dir).select("id", extract.rooms(d).alias("rooms"), extract.baths(d).alias("baths"), extract.area(d).alias("area"))


@query(f"{L} SELECT id, coalesce(try_cast(replace(replace({PRICE}, '.', ''), ',', '.') AS DOUBLE), 0) AS price, regexp_extract(cep, '\\d{{5}}-?\\d{{3}}') AS cep FROM l")
def x_value(spark, sf_dir):
    return views.listings(spark, sf_dir).select("id", extract.value(F.col("descricao")).alias("price"), extract.cep(F.col("cep")).alias("cep"))


TYPE = "CASE " + " ".join(f"WHEN regexp_matches(lower(descricao), '{'|'.join(w)}') THEN '{n}'" for n, w in extract.TYPES) + " ELSE 'Outro' END"


@query(f"{L} SELECT id, {TYPE} AS kind FROM l")
def x_type(spark, sf_dir):
    return views.listings(spark, sf_dir).select("id", extract.kind(F.col("descricao")).alias("kind"))


ERRORS = """array_to_string(list_filter([CASE WHEN url = '' THEN 'URL é obrigatória' END, CASE WHEN endereco = '' AND valor <= 0 THEN 'Endereço ou valor deve estar presente' END,
  CASE WHEN valor > 0 AND valor < 1000 THEN 'Valor muito baixo, provavelmente inválido' END, CASE WHEN valor > 100000000 THEN 'Valor muito alto, provavelmente inválido' END,
  CASE WHEN quartos > 50 THEN 'Número de quartos impossível' END, CASE WHEN banheiros > 20 THEN 'Número de banheiros impossível' END,
  CASE WHEN area_total > 0 AND area_total < 10 AND tipo_imovel <> 'Terreno' THEN 'Área muito pequena para o tipo de imóvel' END], lambda x: x IS NOT NULL), ';')"""
WARNINGS = """array_to_string(list_filter([CASE WHEN strlen(descricao) BETWEEN 1 AND 19 THEN 'Descrição muito curta' END, CASE WHEN strlen(endereco) BETWEEN 1 AND 9 THEN 'Endereço muito genérico' END,
  CASE WHEN quartos = 0 AND tipo_imovel <> 'Terreno' THEN 'Número de quartos não informado' END, CASE WHEN area_total = 0 THEN 'Área total não informada' END,
  CASE WHEN cidade = '' THEN 'Cidade não identificada' END], lambda x: x IS NOT NULL), ';')"""
COMPLETE = """round(25 * CASE WHEN strlen(endereco) = 0 THEN 0 WHEN strlen(endereco) < 10 THEN 0.3 WHEN strlen(endereco) >= 20 THEN 1 ELSE 0.7 END
  + 20 * CASE WHEN strlen(descricao) = 0 THEN 0 WHEN strlen(descricao) < 20 THEN 0.2 WHEN strlen(descricao) < 50 THEN 0.5 WHEN strlen(descricao) >= 100 THEN 1 ELSE 0.8 END
  + 20 * (cidade <> '')::INT + 15 * CASE WHEN valor <= 0 THEN 0 WHEN valor < 10000 OR valor > 50000000 THEN 0.3 ELSE 1 END
  + 5 * CASE WHEN quartos <= 0 THEN 0 WHEN quartos > 10 THEN 0.3 ELSE 1 END + 4 * CASE WHEN area_total <= 0 THEN 0 WHEN area_total < 20 OR area_total > 10000 THEN 0.3 ELSE 1 END
  + 3 * CASE WHEN banheiros <= 0 THEN 0 WHEN banheiros > 8 THEN 0.3 ELSE 1 END + 3 * (tipo_imovel NOT IN ('', 'Outro'))::INT + 2 * (bairro <> '')::INT
  + 2 * CASE WHEN cep = '' THEN 0 WHEN strlen(cep) IN (8, 9) THEN 1 ELSE 0.5 END, 6)::DOUBLE"""


@query(f"{L} SELECT id, {ERRORS} AS errors, {WARNINGS} AS warnings FROM l")
def validate_listing(spark, sf_dir):
    return views.listings(spark, sf_dir).select("id", F.array_join(quality.errors(), ";").alias("errors"), F.array_join(quality.warnings(), ";").alias("warnings"))


@query(f"{L} SELECT id, {COMPLETE} AS completeness FROM l")
def completeness(spark, sf_dir):
    return views.listings(spark, sf_dir).select("id", quality.completeness().alias("completeness"))


@query(f"{L} SELECT id FROM l WHERE {COMPLETE} >= 60 AND {ERRORS} = ''")
def valid_for_saving(spark, sf_dir):
    return views.listings(spark, sf_dir).where(quality.valid_for_saving()).select("id")


def _count_of(patterns: tuple[str, ...]) -> str:
    return " + ".join(f"regexp_matches(lower(descricao), '(?i){p}')::INT" for p in patterns)


WORDS = r"len(regexp_split_to_array(trim(lower(descricao)), '\s+'))"


@query(f"{L} SELECT id, (least(greatest(20 * ({_count_of(classify.REQUIRED)}) + 25 * ({_count_of(classify.PRICES)}) + CASE WHEN {WORDS} < 50 THEN -20 WHEN {WORDS} > 2000 THEN -10 ELSE 0 END, 0), 100) / 100.0)::DOUBLE AS score, ({_count_of(classify.CATALOG)}) > 0 AS excluded FROM l")
def cls_precise(spark, sf_dir):
    lower = F.lower("descricao")
    return views.listings(spark, sf_dir).select("id", classify.listing_score(lower).alias("score"), classify.any_of(lower, classify.CATALOG).alias("excluded"))


@query(C + " SELECT city, count(*) AS total_sites, count(*) FILTER (status = 'active') AS active_sites FROM s GROUP BY city")
def city_counters(spark, sf_dir):
    return registry.counters(views.cities(spark, sf_dir)).select("city", "total_sites", "active_sites")


@query(C + " SELECT city, url FROM s WHERE status = 'active'")
def sites_active(spark, sf_dir):
    return registry.sites_active(views.cities(spark, sf_dir))


@query(C + " SELECT count(DISTINCT city) AS cities, count(*)::BIGINT AS sites, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status <> 'active') AS inactive FROM s")
def city_stats(spark, sf_dir):
    return registry.statistics(views.cities(spark, sf_dir))


@query(C + " SELECT city, count(*) FILTER (status = 'active') AS active_sites, sum(balance::DECIMAL(20,2))::DOUBLE AS balance FROM s GROUP BY city HAVING active_sites > 0 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 10")
def city_top10(spark, sf_dir):
    return registry.top_cities(views.cities(spark, sf_dir))


@query(C + " SELECT city, count(*) AS sites FROM s WHERE status = 'active' GROUP BY city")
def cleanup_inactive_sites(spark, sf_dir):
    return registry.remove_inactive(views.cities(spark, sf_dir)).select("city", F.size("sites").cast("long").alias("sites"))


@query(C + " SELECT city, count(*) FILTER (status = 'error') AS errors FROM (SELECT city, CASE WHEN url = 'Supplier#000000001' THEN 'error' ELSE status END AS status FROM s) GROUP BY city")
def update_site_status(spark, sf_dir):
    changed = registry.set_status(views.cities(spark, sf_dir), "Supplier#000000001", "error")
    return changed.select("city", F.size(F.filter("sites", lambda s: s["status"] == "error")).cast("long").alias("errors"))


@query(C + " SELECT DISTINCT city FROM s WHERE regexp_matches(region, '(?i)america')")
def city_by_region(spark, sf_dir):
    return views.cities(spark, sf_dir).where(F.col("region").rlike("(?iu)america")).select("city")


@query(U + " SELECT url, seq, coalesce(lag(hash) OVER (PARTITION BY url ORDER BY processed_at, seq) <> hash, true) AS change_detected FROM log")
def change_detect(spark, sf_dir):
    return state.changes(views.processed_urls(spark, sf_dir)).select("url", "seq", "change_detected")


AS_OF = "TIMESTAMP '2024-01-20 00:00:00'"


@query(U + f" SELECT seq FROM log WHERE processed_at >= {AS_OF} - INTERVAL 5 DAY")
def ttl_cleanup_urls(spark, sf_dir):
    return state.retained(views.processed_urls(spark, sf_dir), F.expr(f"{AS_OF} - INTERVAL 5 DAY")).select("seq")


@query(U + " SELECT count(*) AS total, count(*) FILTER (processed_at >= d) AS today, count(*) FILTER (processed_at >= d AND status = 'success') AS success, count(*) FILTER (processed_at >= d AND status = 'failed') AS failed, count(*) FILTER (processed_at >= d AND status = 'skipped') AS skipped FROM last, (SELECT date_trunc('day', max(ts)) AS d FROM events)")
def url_stats(spark, sf_dir):
    log = views.processed_urls(spark, sf_dir)
    day = log.agg(F.date_trunc("DAY", F.max("processed_at")).alias("day"))
    return state.statistics(state.latest(log).crossJoin(F.broadcast(day)), F.col("day"))  # one row


@query(U + f", c AS (SELECT *, coalesce(lag(hash) OVER (PARTITION BY url ORDER BY processed_at, seq) <> hash, true) AS cd FROM log) SELECT seq, CASE WHEN status = 'success' AND processed_at >= {AS_OF} - INTERVAL 1 DAY THEN 'recently_processed' WHEN {AS_OF} - processed_at < INTERVAL 3 DAY THEN 'fingerprint_fresh' WHEN NOT cd AND {AS_OF} - processed_at < INTERVAL 6 DAY THEN 'no_changes_detected' ELSE 'process' END AS reason FROM c")
def should_process(spark, sf_dir):
    log = state.changes(views.processed_urls(spark, sf_dir))
    return log.select("seq", state.decision(F.expr(AS_OF), "INTERVAL 1 DAY", "INTERVAL 3 DAY").alias("reason"))


@query("""WITH RECURSIVE r AS (SELECT user_id AS client, epoch_us(ts) AS moment, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
  w(client, seq, k, began, n, allowed) AS (SELECT client, seq, k, moment, 1, true FROM r WHERE k = 1 UNION ALL
   SELECT r.client, r.seq, r.k, CASE WHEN r.moment - w.began > 86400000000 THEN r.moment ELSE w.began END,
     CASE WHEN r.moment - w.began > 86400000000 THEN 1 WHEN w.n < 3 THEN w.n + 1 ELSE w.n END, r.moment - w.began > 86400000000 OR w.n < 3
   FROM w JOIN r ON r.client = w.client AND r.k = w.k + 1) SELECT seq, allowed FROM w""")
def rate_limit_window(spark, sf_dir):
    events = views.read(spark, sf_dir, "events").select(F.col("user_id").alias("client"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq"))
    return rate_limit.limited(events, 3, 86_400).select("seq", "allowed")


@query(ORACLES["rate_limit_window"])
def rate_limit_jumps(spark, sf_dir):
    """The same rows, with each client's requests dealt to many tasks."""
    events = views.read(spark, sf_dir, "events").select(F.col("user_id").alias("client"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq"))
    return rate_limit.by_jumps(events, 3, 86_400).select("seq", "allowed")


@query("""WITH s AS (SELECT p_partkey AS page_id, p_size AS size, concat('https://site', p_partkey % 7, '.com.br') AS host FROM part),
  k AS (SELECT page_id, unnest([(0, concat(host, '/b', size)), (1, concat(host, '/lista/c?x=1&y=2')), (2, CASE WHEN page_id % 2 = 1 THEN concat(host, '/b1') END), (3, concat(host, '/e')), (4, concat(host, '/d', page_id % 3)),
    (5, 'https://outro.com/f'), (6, concat(host, '/fim')), (7, concat(host, '/c')), (8, concat(host, '/g'))]) AS x FROM s),
  f AS (SELECT page_id, x[2] AS link, min(x[1]) AS place FROM k WHERE x[2] IS NOT NULL GROUP BY ALL)
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY place) - 1 AS "at", link FROM f""")
def links_all(spark, sf_dir):
    """All addresses of a page that may be clicked, in whatever form, each once."""
    return markup.links(markup.parsed(views.clickable_pages(spark, sf_dir))).withColumn("at", F.col("at").cast("long"))


@query("""SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages""")
def links_quoted(spark, sf_dir):
    return frontier.links(views.read(spark, sf_dir, "pages"))


@query("""WITH e AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1),
  one AS (SELECT DISTINCT dst FROM e WHERE src = 1 AND dst <> 1), two AS (SELECT DISTINCT e.dst FROM e JOIN one ON e.src = one.dst WHERE e.dst <> 1 AND e.dst NOT IN (SELECT dst FROM one))
  SELECT 1::BIGINT AS node, 0 AS depth UNION ALL SELECT dst, 1 FROM one UNION ALL SELECT dst, 2 FROM two""")
def frontier_bfs(spark, sf_dir):
    """Parts reachable from part 1 over parts that share an order, two steps deep."""
    lines = views.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    nxt = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    edges = lines.join(nxt, ["l_orderkey", "l_linenumber"]).select(F.col("l_partkey").alias("src"), "dst").distinct()
    return frontier.breadth_first(edges, spark.range(1, 2).select(F.col("id").alias("node")), 2)
