"""Queries over the markup of pages. SQL cannot parse it, though it can find the classes of pages as regular as the driver's; for the
others tests compare small pages with what is plain to see."""

from __future__ import annotations

from hearthline.operators import markup
from hearthline.plans.base import registry
from hearthline.sources import views

QUERIES, ORACLES, query = registry()


def _parsed(spark, sf_dir):
    return markup.parsed(views.pages(spark, sf_dir), linked=False)


SITE = "p_partkey AS page_id FROM part"


@query(f"""SELECT 1 AS price_count, 1 AS quartos_count, CASE WHEN p_partkey % 5 < 4 THEN 1 ELSE 0 END AS banheiros_count, 5 AS link_count, 0 AS image_count, 1 AS form_count, true AS has_pagination, false AS has_filters,
  2 + (p_partkey % 3 = 0)::INT + (p_partkey % 5 < 4)::INT AS div_count, {SITE}""")
def page_features(spark, sf_dir):
    found = markup.features(markup.parsed(views.site_pages(spark, sf_dir), linked=False))
    return found.select("page_id", "price_count", "quartos_count", "banheiros_count", "link_count", "image_count", "form_count", "has_pagination", "has_filters", "div_count")


@query()
def page_features_any(spark, sf_dir):
    """The same, and more, of the driver's pages."""
    return markup.features(_parsed(spark, sf_dir))


@query(f"SELECT NULL::VARCHAR AS kind, {SITE}")
def cls_structure_basic(spark, sf_dir):
    """One card and pagination are too little for a catalogue, and there are no details or photos."""
    return markup.structure(markup.parsed(views.site_pages(spark, sf_dir), linked=False))


@query()
def cls_structure_any(spark, sf_dir):
    return markup.structure(_parsed(spark, sf_dir))


@query("""WITH c AS (SELECT page_id, unnest(regexp_extract_all(html, '<[a-z0-9]+ [^>]*class="([^"]*)"', 1)) AS names FROM pages), d AS (SELECT page_id, unnest(string_split(names, ' ')) AS class FROM c),
  f AS (SELECT page_id, class, count(*) AS n FROM d WHERE strlen(class) > 3 GROUP BY ALL HAVING count(*) > 1) SELECT page_id, class, n FROM f QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n DESC, class) <= 10""")
def class_freq(spark, sf_dir):
    return markup.common_classes(_parsed(spark, sf_dir))


@query("""WITH s AS (SELECT p_partkey AS page_id, concat('https://site', p_partkey % 7, '.com.br') AS host FROM part), k AS (SELECT page_id, unnest([(0, concat(host, '/venda')), (1, concat(host, '/contato')), (2, concat(host, '/imovel/', page_id + 1)), (3, concat(host, '/lista?page=2')), (4, concat(host, '/x')), (5, concat(host, '/busca'))]) AS x FROM s)
  SELECT page_id, x[1] AS "at", x[2] AS link FROM k""")
def links_clickable(spark, sf_dir):
    return markup.links(markup.parsed(views.site_pages(spark, sf_dir)))
