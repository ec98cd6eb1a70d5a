"""The engine's entities as views over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Deterministic Portuguese listing text, an expression that Spark and DuckDB read alike but for the name of the string type.
TEXT = """concat(
 case p_size % 5 when 0 then 'Casa' when 1 then 'Apartamento' when 2 then 'Terreno' when 3 then 'Loja comercial' else 'Fazenda' end,
 ' ', p_name, case when p_partkey % 3 <> 0 then concat(' com ', cast(p_size % 6 as varchar), ' quartos e ', cast(p_size % 4 as varchar), ' banheiros') else '' end,
 case when p_partkey % 4 <> 0 then concat(', ', cast(p_size * 10 as varchar), ' m²') else '' end,
 case when p_partkey % 5 <> 0 then concat('. Rua ', p_type, ', ', cast(p_partkey % 300 as varchar)) else '' end,
 case when p_partkey % 2 = 0 then concat('. Valor ', cast(cast(floor(p_retailprice) as bigint) as varchar), ' mil. R$ ', cast(cast(floor(p_retailprice) as bigint) as varchar), '.000,00') else '' end,
 case when p_partkey % 6 = 0 then '. Piscina e churrasqueira' else '' end,
 case when p_partkey % 7 = 0 then '. Resultados encontrados. Próxima página' else '' end,
 case when p_partkey % 9 = 0 then '. Código: AB12. São Sebastião do Paraíso' else '' end,
 repeat(' imóvel amplo e ensolarado', p_size % 20))"""

LISTING = {
    "id": "p_partkey",
    "descricao": TEXT,
    "endereco": "case when p_partkey % 5 = 0 then '' else concat('Rua ', p_brand, ', ', cast(p_partkey % 300 as varchar)) end",
    "cidade": "case p_partkey % 4 when 0 then 'São Paulo' when 1 then 'Muzambinho' when 2 then 'Poços de Caldas' else '' end",
    "bairro": "case when p_partkey % 3 = 0 then 'Centro' else '' end",
    "cep": "case when p_partkey % 4 = 0 then '37890-000' when p_partkey % 4 = 1 then '378' else '' end",
    "valor": "case when p_partkey % 11 = 0 then 0.0 else cast(p_retailprice as double) * (case when p_partkey % 2 = 0 then 1000 else 1 end) end",
    "quartos": "cast(p_size % 6 as int)",
    "banheiros": "cast(p_size % 4 as int)",
    "area_total": "cast(case when p_partkey % 13 = 0 then 0 else p_size * 3 end as double)",
    "tipo_imovel": "case p_size % 5 when 0 then 'Casa' when 1 then 'Apartamento' when 2 then 'Terreno' else 'Outro' end",
    "url": "concat('https://Site', cast(p_partkey % 7 as varchar), '.com.br/imovel//', cast(p_size as varchar), case when p_partkey % 3 = 0 then '/?utm=1' when p_partkey % 3 = 1 then '/?id=5' else '/' end)",
}

LISTING_SQL = "SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in LISTING.items()) + " FROM part"

#: Found links with the page they are on, in the forms that link rules tell apart.
LINK = {
    "id": "p_partkey",
    "link": """concat(case p_partkey % 19 when 0 then 'mailto:corretor' when 1 then '' else concat('https://', case when p_partkey % 3 = 0 then 'www.' else '' end, 'site', cast(p_partkey % 7 as varchar), case when p_partkey % 11 = 0 then '.net' else '.com.br' end) end,
 case p_partkey % 23 when 0 then '/venda/' when 1 then concat('/imovel/', cast(p_partkey as varchar)) when 2 then '/contato' when 3 then '/imoveis' when 4 then concat('/venda/casa/centro/', cast(p_partkey as varchar), '/')
 when 5 then '/foto.JPG' when 6 then '/login' when 7 then concat('/casa-', cast(p_partkey as varchar), '-venda') when 8 then '/busca?page=2&ordenar=preco' when 9 then concat('/imovel?utm_source=x&id=', cast(p_partkey as varchar), '&cidade=alfenas')
 when 10 then '/blog/noticias#topo' when 11 then '//detalhes//ref-12/' when 12 then '/wp-admin' when 13 then concat('/terreno/lote/', cast(p_partkey % 50 as varchar)) when 14 then '/aluguel/apartamento/centro' when 15 then '/sobre' when 16 then '/doc.pdf'
 when 17 then concat('/publicacao.aspx?codigo=ab', cast(p_partkey as varchar)) when 18 then '/anuncie' when 19 then '/resultados?filtro=1&busca=casa' when 20 then '/bairro/centro' when 21 then '/Casa/%20/x?ref=1' else '/' end)""",
    "parent": "concat('https://site', cast(p_partkey % 5 as varchar), '.com.br/pagina', case when p_partkey % 2 = 0 then '/' else '' end)",
    "onclick": """case p_partkey % 4 when 0 then concat('window.location=', chr(39), '/imovel/', cast(p_partkey as varchar), chr(39)) when 1 then 'go();location.href="https://outro.com.br/x";' when 2 then concat('window.open(', chr(39), 'mapa', chr(39), ')') else 'alert(1)' end""",
    "label": "case p_partkey % 4 when 0 then 'Ver Casa' when 1 then 'Imovel em destaque' when 2 then 'Contato' else '' end",
}
LINK_SQL = "SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in LINK.items()) + " FROM part"

#: Texts of pages of several kinds, lower case, with url and title.
PAGE = {
    "id": "p_partkey",
    "url": LINK["link"],
    "title": "case when p_partkey % 10 = 0 then 'detalhes do imóvel' when p_partkey % 10 = 1 then 'imóveis similares' else 'site' end",
    "raw": f"""concat({TEXT}, case p_partkey % 8 when 0 then ' Agendar visita. Entre em contato. Características do imóvel, IPTU: 10' when 1 then ' Ordenar por preço. Filtrar por bairro. Página anterior. Filtros' when 2 then repeat(' R$ 1', 9)
 when 3 then repeat(' quartos', 6) when 4 then ' Código do imóvel: 7. Ref: 9. Área total: 90. Condomínio: 5' when 5 then ' Valor do imóvel 500 reais, garagem, bairro, localização' when 6 then repeat(' imóveis', 9) else '' end)""",
}
PAGE_SQL = "SELECT id, url, title, raw, lower(raw) AS text FROM (SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in PAGE.items()) + " FROM part)"


#: Pages of agencies, each of a listing that its markup or its text gives away.
SITE = {
    "page_id": "p_partkey",
    "url": "concat('https://site', cast(p_partkey % 7 as varchar), '.com.br/imovel/', cast(p_partkey as varchar))",
    "html": """concat('<html><head><title>Imobiliária</title><meta name="description" content="Imóveis"></head><body><nav><a href="/venda">Venda</a><a href="/contato">Contato</a></nav><h1>Oferta especial</h1>',
 case p_partkey % 3 when 0 then concat('<div class="endereco"> Rua ', p_brand, ', ', cast(p_size as varchar), '</div>') when 1 then concat('<p>Fica na Rua ', p_brand, ', ', cast(p_size as varchar), '.</p>') else '' end,
 case p_partkey % 2 when 0 then concat('<span class="preco">R$ ', cast(cast(floor(p_retailprice) as bigint) % 900 + 100 as varchar), '.000,00</span>') else concat('<p>Por R$ ', cast(cast(floor(p_retailprice) as bigint) % 900 + 100 as varchar), '.000,00 apenas</p>') end,
 case when p_partkey % 5 < 4 then concat('<div class="descricao">', case p_size % 3 when 0 then 'Casa' when 1 then 'Apartamento' else 'Terreno' end, ' com ', cast(p_size % 6 as varchar), ' quartos e ', cast(p_size % 4 as varchar), ' banheiros, ', cast(p_size * 3 as varchar), ' m². Ótima localização.</div>')
  else concat('<p>', case p_size % 3 when 0 then 'Casa' when 1 then 'Apartamento' else 'Terreno' end, ' com ', cast(p_size % 6 as varchar), ' quartos, sala ampla.</p>') end,
 '<ul class="caracteristicas"><li>Piscina grande</li><li>ok</li></ul><div class="property-card"><a href="/imovel/', cast(p_partkey + 1 as varchar), '">Ver</a></div>',
 '<div class="pagination"><a href="/lista?page=2">2</a><a href="/x">abc</a></div><form action="/busca"><input name="cidade"><input name="tipo"><button>Buscar</button></form></body></html>')""",
}
SITE_SQL = "SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in SITE.items()) + " FROM part"


#: Pages with an address in each form that a page may have one: quoted, bare, behind other attributes, in scripts, forms and data.
CLICKABLE = {
    "page_id": "p_partkey",
    "url": "concat('https://site', cast(p_partkey % 7 as varchar), '.com.br/lista/')",
    "html": """concat('<body data-url="/fim"><A CLASS=x HREF=/b', cast(p_size as varchar), '>1</A><a href=', chr(39), 'c?x=1&amp;y=2', chr(39), '>2</a><a href="', case when p_partkey % 2 = 0 then '#topo' else '/b1' end, '">3</a>',
 '<button onclick="window.location=', chr(39), '/d', cast(p_partkey % 3 as varchar), chr(39), '">4</button><form action="/e"><input onclick="window.open(', chr(39), 'https://outro.com/f', chr(39), ')"></form>',
 '<div data-link=" /g " data-href="/c" onclick="window.location=', chr(39), '/nunca', chr(39), '"></div><a href="/e">5</a><a>6</a><button onclick="alert(1)">7</button></body>')""",
}
CLICKABLE_SQL = "SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in CLICKABLE.items()) + " FROM part"


#: So many pages are one task's at most.
PAGES = 5_000


def clickable_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _viewed(spark, sf_dir, CLICKABLE, True)


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """A small file, or a large one written as a whole, is one task's, but its rows are pages or become such, which are many times as
    large and are parsed: they are dealt out first."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // PAGES))
    return rows.repartition(tasks, *keys)


def _viewed(spark: SparkSession, sf_dir: str, columns: dict[str, str], dealt: bool = False) -> DataFrame:
    part = read(spark, sf_dir, "part")
    return (_dealt(part, "p_partkey") if dealt else part).selectExpr(*[f"{sql.replace('as varchar', 'as string')} AS {name}" for name, sql in columns.items()])


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _viewed(spark, sf_dir, LINK)


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _viewed(spark, sf_dir, PAGE).withColumn("text", F.lower("raw"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's pages."""
    return _dealt(read(spark, sf_dir, "pages"), "page_id", "url")


def site_pages(spark: SparkSession, sf_dir: str, **more: str) -> DataFrame:
    """The pages, with more columns by their SQL."""
    return _viewed(spark, sf_dir, SITE | more, True)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _viewed(spark, sf_dir, LISTING)


def cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """city, region, sites: array of (url, status, balance), by name."""
    nation, region, supplier = (read(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    site = F.struct(F.col("s_name").alias("url"), F.when(F.col("s_acctbal") > 0, "active").otherwise("inactive").alias("status"), F.col("s_acctbal").alias("balance"))
    joined = supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy(F.col("n_name").alias("city"), F.col("r_name").alias("region")).agg(F.array_sort(F.collect_list(site)).alias("sites"))


def processed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "skipped").otherwise("success")
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), F.col("ts").alias("processed_at"), status.alias("status"), F.md5(F.col("event_type").cast("binary")).alias("hash"))
