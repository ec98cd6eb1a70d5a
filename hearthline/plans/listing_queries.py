"""Queries over listing records, candidate texts, model replies and page sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline.operators import listings, replies
from hearthline.plans.base import registry, sql_any, sql_hits
from hearthline.sources import views

QUERIES, ORACLES, query = registry()

L = f"WITH l AS ({views.LISTING_SQL})"
SQUEEZE = r"trim(regexp_replace({0}, '[\t\n\f\r ]+', ' ', 'g'))"


@query(f"{L} SELECT id FROM l WHERE endereco = '' OR valor <= 0 OR tipo_imovel = '' OR quartos <= 0 OR banheiros <= 0 OR area_total <= 0 OR strlen(descricao) > 1000 OR tipo_imovel = 'Outro'")
def needs_ai(spark, sf_dir):
    return views.listings(spark, sf_dir).where(listings.needs_model()).select("id")


@query(f"{L} SELECT id FROM l WHERE endereco <> '' AND valor > 0 AND tipo_imovel <> '' AND cidade <> '' AND bairro <> '' AND quartos > 0 AND banheiros > 0 AND strlen(descricao) > 50")
def data_complete(spark, sf_dir):
    return views.listings(spark, sf_dir).where(listings.complete()).select("id")


FAIR = "(endereco <> '' OR valor > 0) AND descricao <> '' AND (endereco = '' OR strlen(endereco) BETWEEN 11 AND 299) AND valor >= 0 AND valor < 100000000"


@query(f"{L} SELECT id, {FAIR} AND strlen(descricao) BETWEEN 21 AND 1999 AS improved, {FAIR} AS integrated FROM l")
def listing_sufficient(spark, sf_dir):
    return views.listings(spark, sf_dir).select("id", listings.sufficient().alias("improved"), listings.sufficient(False).alias("integrated"))


@query(f"{L} SELECT id FROM l WHERE endereco <> '' AND cidade <> '' AND descricao <> ''")
def save_required(spark, sf_dir):
    return views.listings(spark, sf_dir).where(listings.savable()).select("id")


D = r"regexp_matches({0}, '\d')"
WORDS = sql_hits(("lower(descricao)",), listings.DESCRIBING)


@query(f"""{L} SELECT id, strlen(endereco) BETWEEN 5 AND 200 AND ({sql_any('lower(endereco)', listings.ADDRESS_WORDS)} OR regexp_matches(lower(endereco), '\\d|-\\s*mg|minas\\s+gerais')) AS address,
  strlen(cep) BETWEEN 2 AND 50 AND {D.format('cep')} AND ({sql_any('lower(cep)', listings.PRICE_WORDS)} OR regexp_matches(lower(cep), '^\\s*\\$?\\s*\\d')) AS price,
  strlen(descricao) BETWEEN 15 AND 5000 AND NOT {sql_any('lower(descricao)', listings.NOT_DESCRIBING)} AND ({WORDS} >= 2 OR contains(descricao, ' ') AND regexp_matches(descricao, '[.,;:!?]') AND {WORDS} >= 1) AS description FROM l""")
def looks_like(spark, sf_dir):
    return views.listings(spark, sf_dir).select("id", listings.like_address(F.col("endereco")).alias("address"), listings.like_price(F.col("cep")).alias("price"), listings.like_description(F.col("descricao")).alias("description"))


@query(f"{L} SELECT id, array_to_string(list_filter({list(listings.FEATURES)!r}, lambda f: contains(lower(descricao), f)), ',') AS features FROM l")
def x_features(spark, sf_dir):
    return views.listings(spark, sf_dir).select("id", F.array_join(listings.features(F.col("descricao")), ",").alias("features"))


KNOWN = f"coalesce(list_filter({list(listings.CITIES)!r}, lambda c: contains(lower({{0}}), lower(c)))[1], '')"
PLACE = "concat(endereco, ', ', cidade)"
ENDING = r"'([^,]+),\s*([^,]+)(?:,\s*[^,]+)?$'"


@query(f"{L} SELECT id, CASE WHEN {KNOWN.format(PLACE)} = '' THEN trim(regexp_extract({PLACE}, {ENDING}, 2)) ELSE {KNOWN.format(PLACE)} END AS city, trim(regexp_extract({PLACE}, {ENDING}, 1)) AS neighbourhood FROM l")
def x_location(spark, sf_dir):
    city, neighbourhood = listings.location(F.concat("endereco", F.lit(", "), "cidade"))
    return views.listings(spark, sf_dir).select("id", city.alias("city"), neighbourhood.alias("neighbourhood"))


@query(f"{L} SELECT id, {SQUEEZE.format('descricao')} AS descricao, greatest(valor, 0) AS valor, CASE WHEN quartos BETWEEN 0 AND 20 THEN quartos ELSE 0 END AS quartos, CASE WHEN area_total BETWEEN 0 AND 10000 THEN area_total ELSE 0 END AS area_total, CASE WHEN tipo_imovel = '' THEN 'Outro' ELSE tipo_imovel END AS tipo_imovel FROM l")
def clean_listing(spark, sf_dir):
    return listings.cleaned(views.listings(spark, sf_dir)).select("id", "descricao", "valor", "quartos", "area_total", "tipo_imovel")


INFER = "CASE " + " ".join(f"WHEN {sql_any('lower(descricao)', w)} THEN '{n}'" for n, w in listings.INFERRED_TYPES) + " ELSE 'Outro' END"


@query(f"{L} SELECT id, CASE WHEN tipo_imovel IN ('', 'Outro') THEN {INFER} ELSE tipo_imovel END AS tipo_imovel, CASE WHEN cidade = '' THEN {KNOWN.format('endereco')} ELSE cidade END AS cidade, {SQUEEZE.format('descricao')} AS descricao FROM l")
def enhance_listing(spark, sf_dir):
    return listings.enhanced(views.listings(spark, sf_dir)).select("id", "tipo_imovel", "cidade", "descricao")


@query(f"{L} SELECT id, concat('R$ ', translate(printf('%,.2f', round(valor, 2)), ',.', '.,')) AS price FROM l")
def format_price(spark, sf_dir):
    return views.listings(spark, sf_dir).select("id", listings.price_text(F.round("valor", 2)).alias("price"))


@query(f"{L} SELECT id, array_to_string(range(greatest(1, id % 7 - 1), least(7, id % 7 + 3) + 1), ',') AS pages FROM l")
def page_window(spark, sf_dir):
    asked = views.listings(spark, sf_dir).withColumn("page", F.col("id") % 7 + 1)
    return asked.select("id", F.array_join(F.transform(listings.page_window(F.col("page"), F.lit(7)), lambda p: p.cast("string")), ",").alias("pages"))


@query(f"{L} SELECT id, md5(descricao) AS key FROM l")
def md5_key(spark, sf_dir):
    return views.listings(spark, sf_dir).select("id", listings.keyed(F.col("descricao")).alias("key"))


@query(f"{L} SELECT id, md5(concat('Extraia dados estruturados do imóvel em JSON:', chr(10), 'Dados: Endereço:', endereco, ' | Descrição:', descricao, ' | Valor:', cep, chr(10), chr(10), 'JSON com: endereco, cidade, bairro, cep, descricao, valor, quartos, banheiros, area_total, area_util, tipo_imovel, caracteristicas')) AS prompt FROM l")
def ai_prompt(spark, sf_dir):
    return views.listings(spark, sf_dir).select("id", F.md5(listings.prompt(valor="cep").cast("binary")).alias("prompt"))


REPLY = """concat('Aqui está: ', case when id % 7 = 0 then 'nada' else concat('{"cidade":"', case when id % 2 = 0 then 'Alfenas' else '' end, '","quartos":', cast(id % 4 as {0}), '.0,"valor":', cast(id % 3 * 1000 as {0}), ',"cep":"37800-000"}') end, ' fim')"""


@query(f"{L} SELECT id, CASE WHEN id % 7 <> 0 AND id % 2 = 0 THEN 'Alfenas' ELSE cidade END AS cidade, CASE WHEN id % 7 <> 0 AND id % 4 > 0 THEN (id % 4)::INT ELSE quartos END AS quartos, CASE WHEN id % 7 <> 0 AND id % 3 > 0 THEN id % 3 * 1000.0::DOUBLE ELSE valor END AS valor, CASE WHEN id % 7 <> 0 THEN '37800-000' ELSE cep END AS cep FROM l")
def ai_merge(spark, sf_dir):
    asked = views.listings(spark, sf_dir).withColumn("reply", F.expr(REPLY.replace("{0}", "string")))
    return replies.merged(asked).select("id", "cidade", "quartos", "valor", "cep")


@query(f"{L} SELECT id, CASE WHEN id % 7 <> 0 AND id % 2 = 0 THEN 'Alfenas' ELSE cidade END AS cidade, cep FROM l")
def ai_merge_batch(spark, sf_dir):
    asked = views.listings(spark, sf_dir).withColumn("reply", F.expr(REPLY.replace("{0}", "string")))
    return replies.merged(asked, batch=True).select("id", "cidade", "cep")


@query(f"{L}, n AS (SELECT id, tipo_imovel, row_number() OVER (PARTITION BY tipo_imovel ORDER BY id) - 1 AS r FROM l) SELECT id, r // 5 AS batch, r % 5 AS place FROM n")
def ai_batch(spark, sf_dir):
    return replies.batches(views.listings(spark, sf_dir), "tipo_imovel", "id").select("id", "batch", "place")


AS_OF = "TIMESTAMP '2024-01-20 00:00:00'"
CACHE = "c AS (SELECT concat('u', user_id) AS key, event_type AS reply, ts AS stored_at FROM events)"


def _cache(spark, sf_dir):
    return views.read(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), F.col("event_id").alias("reply"), F.col("ts").cast("timestamp").alias("stored_at"))


@query(f"WITH {CACHE} SELECT count(*) AS total, count(*) FILTER ({AS_OF} - stored_at > INTERVAL 24 HOUR) AS expired FROM c")
def cache_stats(spark, sf_dir):
    return replies.cache_statistics(_cache(spark, sf_dir), F.expr(AS_OF))


@query(f"WITH {CACHE} SELECT DISTINCT key, key IN (SELECT key FROM c WHERE {AS_OF} - stored_at <= INTERVAL 24 HOUR) AS held FROM c")
def ai_cache(spark, sf_dir):
    cache = _cache(spark, sf_dir)
    return replies.cached(cache.select("key").distinct(), cache, F.expr(AS_OF)).select("key", F.col("reply").isNotNull().alias("held"))


@query(r"SELECT page_id, md5(regexp_replace(html, '(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g')) AS plain FROM pages")
def html_strip_scripts(spark, sf_dir):
    return views.read(spark, sf_dir, "pages").select("page_id", F.md5(replies.without_scripts(F.col("html")).cast("binary")).alias("plain"))


@query(r"SELECT page_id, len(list_filter(string_split(regexp_replace(html, '(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g'), chr(10)), lambda x: trim(x) <> '' AND " + sql_any("lower(x)", replies.RELEVANT) + ")) AS lines FROM pages")
def html_relevant(spark, sf_dir):
    found = replies.relevant_lines(F.col("html"), 1 << 30)
    return views.read(spark, sf_dir, "pages").select("page_id", F.when(found == "", 0).otherwise(F.size(F.split(found, "\n"))).cast("long").alias("lines"))
