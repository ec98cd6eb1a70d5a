"""Queries of single predicates, lookups, sources and clean-ups."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hearthline import api
from hearthline.functions import extract, hashing, text, urls
from hearthline.operators import jobs, links, registry as cities, replies, search, state
from hearthline.plans.base import registry
from hearthline.plans.state_queries import PRINTS, SITE
from hearthline.queries import AS_OF, C, L, U
from hearthline.sources import archive, files, views
from hearthline.sources.shared import shared_folder

QUERIES, ORACLES, query = registry()

K = f"WITH k AS ({views.LINK_SQL})"


@query(f"{L} SELECT id FROM l WHERE contains(lower(bairro), 'centro')")
def f_bairro(spark, sf_dir):
    return search.matching(views.listings(spark, sf_dir), search.SearchFilter(bairro="Centro")).select("id")


@query(f"{L} SELECT id FROM l WHERE contains(lower(tipo_imovel), 'casa')")
def f_type(spark, sf_dir):
    return search.matching(views.listings(spark, sf_dir), search.SearchFilter(tipo_imovel="casa")).select("id")


@query(f"{L} SELECT id, regexp_matches(descricao, '(?i)quartos|amplo') AS found FROM l")
def search_regex(spark, sf_dir):
    words = text.search_terms("quartos amplo")
    return views.listings(spark, sf_dir).select("id", F.col("descricao").rlike("(?iu)" + "|".join(words)).alias("found"))


@query(f"{L} SELECT id, contains(lower(strip_accents(descricao)), 'imovel') OR contains(lower(strip_accents(descricao)), 'piscina') AS matches FROM l")
def is_text_match(spark, sf_dir):
    return views.listings(spark, sf_dir).select("id", text.matches_any(F.col("descricao"), ["imovel", "piscina"]).alias("matches"))


@query("""WITH r AS (SELECT o_orderkey AS id, o_orderkey % 210 AS n, (o_orderkey % 7 - 1)::INT AS quartos_min, (o_orderkey % 23)::INT AS quartos_max, (o_orderkey % 5 * 30000000)::DOUBLE AS valor_min, (o_orderkey % 3 * 50000000)::DOUBLE AS valor_max, (o_orderkey % 1100)::INT AS page, (o_orderkey % 103)::INT AS page_size FROM orders)
  SELECT id, concat_ws(',', CASE WHEN n > 200 THEN 'q: too long' END, CASE WHEN valor_min > 100000000 THEN 'valor_min: out of bounds' END, CASE WHEN valor_min > 0 AND valor_max > 0 AND valor_max < valor_min THEN 'valor_max: below valor_min' END,
   CASE WHEN quartos_min < 0 THEN 'quartos_min: out of bounds' END, CASE WHEN quartos_max > 20 THEN 'quartos_max: out of bounds' END, CASE WHEN quartos_min > 0 AND quartos_max > 0 AND quartos_max < quartos_min THEN 'quartos_max: below quartos_min' END,
   CASE WHEN page > 1000 THEN 'page: out of bounds' END, CASE WHEN page_size > 100 THEN 'page_size: out of bounds' END) AS problems FROM r""")
def f_request_validate(spark, sf_dir):
    key = F.col("o_orderkey")
    asked = views.read(spark, sf_dir, "orders").select(
        key.alias("id"), F.repeat(F.lit("x"), (key % 210).cast("int")).alias("q"), (key % 7 - 1).cast("int").alias("quartos_min"), (key % 23).cast("int").alias("quartos_max"),
        (key % 5 * 30_000_000).cast("double").alias("valor_min"), (key % 3 * 50_000_000).cast("double").alias("valor_max"), (key % 1100).cast("int").alias("page"), (key % 103).cast("int").alias("page_size"),
    )
    return asked.select("id", F.array_join(jobs.problems(asked.columns), ",").alias("problems"))


@query(f"{L} SELECT id FROM l ORDER BY valor DESC, id LIMIT 10 OFFSET 20")
def page_by_price(spark, sf_dir):
    return search.page(views.listings(spark, sf_dir), search.SearchFilter(), 3, 10).select("id")


@query(C + " SELECT city, url FROM s WHERE status = 'active' AND city = 'NATION_1'")
def sites_by_city(spark, sf_dir):
    return cities.sites_active(cities.by_key(views.cities(spark, sf_dir), "NATION_1", "AMERICA"))


@query(C + " SELECT city, count(*) FILTER (status = 'active') AS active_sites, count(*) FILTER (status = 'active') > 0 AS has_active, bool_or(url = 'Supplier#000000001') AS has_site FROM s GROUP BY city")
def sites_active_inline(spark, sf_dir):
    inline = F.size(cities.active(F.col("sites"))).cast("long")
    return views.cities(spark, sf_dir).select("city", inline.alias("active_sites"), (inline > 0).alias("has_active"), F.exists("sites", lambda s: s["url"] == SITE).alias("has_site"))


@query(C + f", u AS (SELECT city, CASE WHEN url = '{SITE}' THEN 'error' ELSE status END AS status FROM s) SELECT city, count(*) AS total_sites, count(*) FILTER (status = 'active') AS active_sites FROM u GROUP BY city")
def site_model_update(spark, sf_dir):
    """As on the document itself: the counters follow the change at once."""
    return cities.counters(cities.set_status(views.cities(spark, sf_dir), SITE, "error")).select("city", "total_sites", "active_sites")


@query("SELECT n_name AS city, r_name AS region, concat(lower(n_name), '-', upper(r_name)) AS key FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)")
def city_key(spark, sf_dir):
    return views.cities(spark, sf_dir).select("city", "region", hashing.city_key(F.col("city"), F.col("region")).alias("key"))


@query(U + " SELECT url, seq, status FROM last WHERE url = 'u7'")
def url_lookup(spark, sf_dir):
    return state.latest(views.processed_urls(spark, sf_dir).where("url = 'u7'")).select("url", "seq", "status")


@query(PRINTS + " SELECT url, hash, change_detected FROM f WHERE url = 'u7'")
def fp_lookup(spark, sf_dir):
    return state.fingerprints(views.processed_urls(spark, sf_dir).where("url = 'u7'")).select("url", "hash", "change_detected")


def _customer_urls(spark, sf_dir):
    return views.read(spark, sf_dir, "customer").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("url"))


@query(U + f" SELECT 'u' || c_custkey AS url FROM customer WHERE 'u' || c_custkey IN (SELECT url FROM log WHERE processed_at >= {AS_OF} - INTERVAL 1 DAY AND status = 'success')")
def semi_recent(spark, sf_dir):
    recent = state.recent_success(views.processed_urls(spark, sf_dir), F.expr(f"{AS_OF} - INTERVAL 1 DAY"))
    return _customer_urls(spark, sf_dir).join(recent, "url", "left_semi")


@query(PRINTS + " SELECT 'u' || c_custkey AS url, hash FROM customer LEFT JOIN f ON f.url = 'u' || c_custkey")
def left_fingerprint(spark, sf_dir):
    return _customer_urls(spark, sf_dir).join(state.fingerprints(views.processed_urls(spark, sf_dir)).select("url", "hash"), "url", "left")


@query(K + " SELECT id, regexp_matches(lower(link), '/contato|/sobre|/empresa|/equipe|/historia|/politica|/privacidade|/termos|/condicoes|/integre|/anuncie|/cadastr|/login|/admin|/ajuda|/faq|/suporte|/blog|/noticias') AS low FROM k")
def link_low(spark, sf_dir):
    return views.links(spark, sf_dir).select("id", links.low(F.col("link")).alias("low"))


@query("""WITH k AS (SELECT p_partkey AS id, concat('https://', CASE p_partkey % 5 WHEN 0 THEN 'www.facebook.com' WHEN 1 THEN 'duckduckgo.com' ELSE 'site.com.br' END, '/', p_partkey) AS link, CASE p_partkey % 4 WHEN 0 THEN 'Imóveis em Alfenas' WHEN 1 THEN 'Venda e ALUGUEL' WHEN 2 THEN '' ELSE 'Notícias' END AS title FROM part)
  SELECT id FROM k WHERE regexp_matches(lower(title), 'im[oó]veis|venda|aluguel') AND NOT regexp_matches(link, 'facebook|duckduckgo')""")
def link_relevant(spark, sf_dir):
    return _results(spark, sf_dir).where(links.relevant(F.col("link"), F.col("title"))).select("id")


def _results(spark, sf_dir):
    """Search results, as an engine would supply them."""
    host = "CASE p_partkey % 5 WHEN 0 THEN 'www.facebook.com' WHEN 1 THEN 'duckduckgo.com' ELSE 'site.com.br' END"
    title = "CASE p_partkey % 4 WHEN 0 THEN 'Imóveis em Alfenas' WHEN 1 THEN 'Venda e ALUGUEL' WHEN 2 THEN '' ELSE 'Notícias' END"
    return views.read(spark, sf_dir, "part").selectExpr("p_partkey AS id", f"concat('https://', {host}, '/', p_partkey) AS link", f"{title} AS title")


@query("SELECT concat('https://site.com.br/', p_partkey) AS url FROM part WHERE p_partkey % 5 > 1 AND p_partkey % 4 < 2")
def src_site_search(spark, sf_dir):
    return files.searched_sites(_results(spark, sf_dir), links.relevant(F.col("link"), F.col("title")))


@query(f"{L} SELECT id, regexp_extract(cep, '[0-9]{{5}}-?[0-9]{{3}}') AS cep FROM l")
def x_cep(spark, sf_dir):
    return views.listings(spark, sf_dir).select("id", extract.cep(F.col("cep")).alias("cep"))


@query(f"{K} SELECT id, CASE WHEN starts_with(link, 'http') THEN regexp_extract(link, '^[^?#]*') ELSE '' END AS clean FROM k")
def url_clean_search(spark, sf_dir):
    return views.links(spark, sf_dir).select("id", urls.for_search(F.col("link")).alias("clean"))


@query(f"{L} SELECT id, CASE WHEN len(descricao) > 150 THEN concat(trim(left(descricao, 150)), '...') ELSE descricao END AS shown FROM l")
def truncate_text(spark, sf_dir):
    return views.listings(spark, sf_dir).select("id", text.truncate_shown(F.col("descricao")).alias("shown"))


@query(f"{L} SELECT id, sha256(concat('prices:[', CASE WHEN valor > 0 THEN valor::BIGINT::VARCHAR ELSE '' END, ']|addresses:[', array_to_string(list_filter([trim(lower(endereco)), trim(lower(cidade))], lambda x: x <> ''), ' '), ']|descriptions:[', trim(lower(descricao)), ']')) AS hash FROM l")
def content_hash(spark, sf_dir):
    price = F.when(F.col("valor") > 0, F.bround("valor", 0).cast("long").cast("string")).otherwise("")
    return views.listings(spark, sf_dir).select("id", hashing.content_hash(F.array(price), F.array("endereco", "cidade"), F.array("descricao")).alias("hash"))


@query(U + f" SELECT seq, date_trunc('day', processed_at)::DATE AS day, processed_at < {AS_OF} - INTERVAL 3 DAY AS old, floor((epoch_us({AS_OF}) - epoch_us(processed_at)) / 1000000.0)::BIGINT AS seconds FROM log")
def date_ops(spark, sf_dir):
    at, now = F.col("processed_at").cast("timestamp"), F.expr(AS_OF).cast("timestamp")
    return views.processed_urls(spark, sf_dir).select("seq", F.to_date("processed_at").alias("day"), (F.col("processed_at") < F.expr(f"{AS_OF} - INTERVAL 3 DAY")).alias("old"), F.floor((F.unix_micros(now) - F.unix_micros(at)) / 1_000_000).cast("long").alias("seconds"))


@query("SELECT o_orderkey AS id, min(l_quantity)::DOUBLE AS least, max(l_quantity)::DOUBLE AS most FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def min_max(spark, sf_dir):
    lists = views.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("l_quantity").alias("q"))
    return lists.select("id", F.array_min("q").cast("double").alias("least"), F.array_max("q").cast("double").alias("most"))


@query(U + " SELECT count(*) FILTER (status = 'skipped') * 2 AS saved_seconds FROM last")
def ai_savings_estimate(spark, sf_dir):
    return state.latest(views.processed_urls(spark, sf_dir)).agg((F.count_if(F.col("status") == "skipped") * 2).alias("saved_seconds"))


@query("SELECT count(*) AS total_validations, count(*) FILTER (p_partkey % 3 = 0) AS property_pages, count(*) FILTER (p_partkey % 3 = 1) AS catalog_pages, count(*) FILTER (p_partkey % 3 = 2) AS unknown_pages, round(avg(p_size / 50.0), 9)::DOUBLE AS avg_confidence, round(count(*) FILTER (p_partkey % 3 = 0) / count(*)::DOUBLE, 9) AS property_rate FROM part")
def validation_stats(spark, sf_dir):
    kind = "CASE p_partkey % 3 WHEN 0 THEN 'property' WHEN 1 THEN 'catalog' ELSE 'unknown' END AS kind"
    found = jobs.validation_statistics(views.read(spark, sf_dir, "part").selectExpr(kind, "p_size / 50.0D AS confidence"))
    return found.withColumns({c: F.round(c, 9) for c in ("avg_confidence", "property_rate")})


def _jobs(spark, sf_dir):
    """Orders as discovery jobs, their items as cities."""
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "queued").otherwise("running")
    done = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate").cast("date"))
    return views.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), status.alias("status"), done.alias("completed_at"))


@query("SELECT o_orderkey AS job FROM orders WHERE o_orderstatus <> 'F'")
def job_state(spark, sf_dir):
    return jobs.active(_jobs(spark, sf_dir)).select("job")


@query("SELECT o_orderkey AS job FROM orders WHERE o_orderstatus <> 'F' OR o_orderdate::DATE >= DATE '1995-01-01'")
def cleanup_jobs(spark, sf_dir):
    return jobs.kept(_jobs(spark, sf_dir), F.lit("1995-01-01").cast("date")).select("job")


@query("""WITH c AS (SELECT l_orderkey AS job, CASE WHEN l_linestatus = 'O' THEN NULL WHEN l_returnflag = 'R' THEN 'failed' ELSE 'done' END AS state FROM lineitem), n AS (SELECT job, count(*) AS cities, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'failed') AS failed FROM c GROUP BY job)
  SELECT *, ((done + failed) * 100 // cities)::INT AS progress, CASE WHEN done + failed < cities THEN 'running' WHEN failed > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status FROM n""")
def discover_job(spark, sf_dir):
    state_of = F.when(F.col("l_linestatus") == "O", F.lit(None)).when(F.col("l_returnflag") == "R", "failed").otherwise("done")
    return jobs.ended(views.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("city"), state_of.alias("state")))


@query(C + " SELECT city, CASE WHEN count(*) > 0 THEN count(*) FILTER (status = 'active') * 100.0::DOUBLE / count(*) ELSE 0 END AS success_rate FROM s GROUP BY city")
def stats_views(spark, sf_dir):
    return cities.counters(views.cities(spark, sf_dir)).select("city", jobs.rate(F.col("active_sites"), F.col("total_sites")).alias("success_rate"))


REFERENCE = "SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN '# comment' WHEN 2 THEN concat('  ', p_partkey, '|https://a.com/', p_size, ' ') WHEN 3 THEN concat('x|http://b.com/', p_size) WHEN 4 THEN concat('httpx:', p_size) ELSE concat('https://c.com/', p_size, '|y') END AS line FROM part"


@query(f"WITH r AS ({REFERENCE}) SELECT id, CASE id % 6 WHEN 2 THEN trim(substr(trim(line), instr(trim(line), '|') + 1)) WHEN 3 THEN substr(line, 3) END AS url FROM r WHERE id % 6 IN (2, 3)")
def src_reference_ini(spark, sf_dir):
    return files.reference_urls(views.read(spark, sf_dir, "part").selectExpr("p_partkey AS id", f"{_line()} AS line")).select("id", "url")


@query(f"WITH r AS ({REFERENCE}) SELECT id, CASE id % 6 WHEN 2 THEN substr(trim(line), instr(trim(line), '|') + 1) ELSE line END AS url FROM r WHERE id % 6 IN (2, 4, 5)")
def src_reference_ini_numbered(spark, sf_dir):
    return files.reference_urls(views.read(spark, sf_dir, "part").selectExpr("p_partkey AS id", f"{_line()} AS line"), numbered_only=True).select("id", "url")


def _line() -> str:
    return REFERENCE.split("p_partkey AS id, ", 1)[1].rsplit(" AS line", 1)[0]


@query("SELECT n_nationkey AS place, concat('https://site', n_nationkey, '.com.br') AS url FROM nation")
def src_sites_json(spark, sf_dir):
    """A file of seeds, one for each nation, is written and read."""
    path = f"{shared_folder(spark)}/sites-{uuid.uuid4().hex}"
    keys = views.read(spark, sf_dir, "nation").agg(F.array_sort(F.collect_list("n_nationkey")).alias("ids"))
    keys.select(F.to_json(F.transform("ids", lambda i: F.concat(F.lit("https://site"), i.cast("string"), F.lit(".com.br")))).alias("value")).write.text(path)
    return files.seed_urls(spark, path).withColumnRenamed("at", "place")


@query("SELECT 'property' AS kind, p_type AS pattern, count(*) AS n, least(count(*) / 10.0, 1)::DOUBLE AS confidence FROM part GROUP BY p_type")
def src_patterns_json(spark, sf_dir):
    """Patterns are exported as JSON and imported again."""
    path = f"{shared_folder(spark)}/patterns-{uuid.uuid4().hex}"
    learned = views.read(spark, sf_dir, "part").groupBy(F.lit("property").alias("kind"), F.col("p_type").alias("pattern")).agg(F.count("*").alias("n"))
    files.export_patterns(learned.withColumn("confidence", F.least(F.col("n") / 10.0, F.lit(1.0))), path)
    return files.import_patterns(spark, path)


@query("""SELECT concat('{"kind":"property","pattern":"', p_type, '","n":', count(*), ',"confidence":', least(count(*) / 10.0, 1)::DOUBLE, '}') AS line FROM part GROUP BY p_type""")
def export_patterns(spark, sf_dir):
    """The lines of the exported file, which an earlier export does not add to."""
    path = f"{shared_folder(spark)}/patterns-{uuid.uuid4().hex}"
    learned = views.read(spark, sf_dir, "part").groupBy(F.lit("property").alias("kind"), F.col("p_type").alias("pattern")).agg(F.count("*").alias("n")).withColumn("confidence", F.least(F.col("n") / 10.0, F.lit(1.0)))
    files.export_patterns(learned.limit(1), path)
    files.export_patterns(learned, path)
    return files.lines(spark, path)


@query("SELECT page_id, url, html FROM pages")
def src_pages(spark, sf_dir):
    """An archive of the pages is written and read through its data source."""
    path = f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}"
    archive.write(files.supplied(views.read(spark, sf_dir, "pages"), files.PAGES), path)
    return files.supplied(archive.read(spark, path), files.PAGES)


HOST_SQL = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"


@query(f"WITH h AS (SELECT page_id, {HOST_SQL} AS host FROM pages) SELECT host, page_id FROM h WHERE host IN (SELECT min(host) FROM h UNION ALL SELECT max(host) FROM h)")
def src_pages_of_hosts(spark, sf_dir):
    """Of an archive only what holds two hosts is read, and no page is decoded."""
    path = f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}"
    pages = views.read(spark, sf_dir, "pages")
    archive.write(pages, path)
    asked = pages.agg(F.min(urls.host(F.col("url"))), F.max(urls.host(F.col("url")))).first()
    return archive.read(spark, path, ("page_id", "host")).where(F.col("host").isin(*asked))


@query(f"{L} SELECT md5(descricao) AS key, concat('{{\"quartos\": ', quartos, '}}') AS reply FROM l")
def src_llm(spark, sf_dir):
    """Replies of a model come as a table."""
    replied = views.listings(spark, sf_dir).select(F.md5(F.col("descricao").cast("binary")).alias("key"), F.concat(F.lit('{"quartos": '), F.col("quartos").cast("string"), F.lit("}")).alias("reply"), "id")
    return files.supplied(replied, files.REPLIES)


@query("""SELECT n_nationkey AS deployment, CASE WHEN n_nationkey % 5 IN (1, 2) THEN (8000 + n_nationkey)::VARCHAR ELSE '8080' END AS port,
  CASE WHEN n_nationkey % 5 = 3 THEN concat('mongodb://', n_name, ':27017/a#b') ELSE 'mongodb://localhost:27017' END AS store, CASE WHEN n_nationkey % 5 = 4 THEN concat(n_name, '.json') ELSE 'configs/sites.json' END AS sites_file FROM nation""")
def src_env_config(spark, sf_dir):
    """Settings files of deployments, one for each nation; what they leave out is as the session says, or by default."""
    n, name = F.col("n_nationkey"), F.col("n_name")
    line = (
        F.when(n % 5 == 1, F.concat(F.lit("PORT="), (8000 + n).cast("string"), F.lit("  # own")))
        .when(n % 5 == 2, F.concat(F.lit("PORT=1\nexport PORT = '"), (8000 + n).cast("string"), F.lit("'")))
        .when(n % 5 == 3, F.concat(F.lit('MONGO_URI="mongodb://'), name, F.lit(':27017/a#b"')))
        .when(n % 5 == 4, F.concat(F.lit("#PORT=1\nSITES_FILE="), name, F.lit(".json\nOTHER=x\nPORT=")))
        .otherwise(F.lit("# nothing\n\n"))
    )
    texts = views.read(spark, sf_dir, "nation").select(n.alias("deployment"), line.alias("text"))
    return files.env_settings(texts, "deployment", files.Settings.of(spark))


@query("SELECT p_partkey AS id, concat('{\"quartos\": ', p_size, '}') AS found FROM part")
def ai_parse(spark, sf_dir):
    """The JSON within a reply that says more."""
    reply = F.concat(F.lit("Claro! ```json\n"), F.lit('{"quartos": '), F.col("p_size").cast("string"), F.lit("}"), F.lit("\n``` Pronto."))
    return views.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), replies.json_part(reply).alias("found"))


@query(K + r" SELECT id, regexp_replace(regexp_extract(link, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '[0-9]+', '{id}', 'g') AS shape FROM k")
def ref_url_shape(spark, sf_dir):
    return views.links(spark, sf_dir).select("id", urls.shape(urls.path(F.col("link"))).alias("shape"))


@query("""SELECT page_id, host, selector FROM (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host FROM pages) p
  LEFT JOIN (SELECT DISTINCT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host, '.price' AS selector FROM pages WHERE contains(url, '1')) USING (host)""")
def selector_map(spark, sf_dir):
    """Each page with the selectors that are known for its host."""
    pages = views.read(spark, sf_dir, "pages").select("page_id", "url", urls.host(F.col("url")).alias("host"))
    known = pages.where(F.col("url").contains("1")).select("host", F.lit(".price").alias("selector")).distinct()
    return pages.select("page_id", "host").join(known, "host", "left")


@query(C + " SELECT count(DISTINCT city) AS cities, count(*)::BIGINT AS sites, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status <> 'active') AS inactive FROM s WHERE city <> 'NATION_1'")
def api_city_delete(spark, sf_dir):
    return api.statistics(api.delete_city(views.cities(spark, sf_dir), "NATION_1", "AMERICA", confirm=True))


@query(C + " SELECT city, url FROM s WHERE status = 'active' AND city IN ('NATION_2', 'NATION_3', 'NATION_1')")
def api_city_sites(spark, sf_dir):
    return api.sites(views.cities(spark, sf_dir), ["Nation_2", "Nation_3", "Nation_1"])


@query(f"{L}, {U.removeprefix('WITH ')} SELECT 'listings' AS what, 0::BIGINT AS n UNION ALL SELECT 'urls', count(*) FROM log")
def api_cleanup(spark, sf_dir):
    left, log, _ = api.cleanup(views.listings(spark, sf_dir), views.processed_urls(spark, sf_dir), properties=True)
    count = lambda df, what: df.agg(F.lit(what).alias("what"), F.count("*").alias("n"))
    return count(left, "listings").unionByName(count(log, "urls"))


@query("SELECT 'property' AS kind, concat('/imovel/', p_size) AS pattern, count(*) AS n, least(count(*) / 10.0, 1)::DOUBLE AS confidence FROM part GROUP BY p_size HAVING count(*) >= 2")
def api_learn(spark, sf_dir):
    """Learned, exported, imported: of the patterns, the paths as they are."""
    size = F.col("p_size").cast("string")
    examples = views.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("https://a.com/imovel/"), size).alias("url"), F.lit("property").alias("kind"))
    path = api.export_patterns(api.learn_urls(examples), f"{shared_folder(spark)}/learned-{uuid.uuid4().hex}")
    return api.import_patterns(spark, path).where(F.col("pattern").rlike(r"\A/imovel/\d+\z"))
