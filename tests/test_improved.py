"""The improved crawl: which links it follows, and what it takes from where they lead."""

from hearthline.operators import crawls, discovery, training

PAGES = "page_id long, url string, html string"
LISTING = "<body><div class='endereco'>Rua das Flores, {0}, Centro</div><span class='preco'>R$ 250.000,00</span><div class='descricao'>Casa com 3 quartos e 2 banheiros, 90 m². Entre em contato, agendar visita.</div>{1}</body>"


def anchors(*links):
    return "".join(f'<a href="{x}">x</a>' for x in links)


def found(spark, pages, seeds, patterns=None):
    """Pages read, and the catalogues among them that link to listings."""
    rows = spark.createDataFrame(pages, PAGES)
    routed, linked = crawls._reached(rows, spark.createDataFrame([(s,) for s in seeds], "url string"), patterns)
    return sorted(r.page_id for r in routed.collect()), sorted(r.page_id for r in linked.collect())


def test_links_are_matched_by_patterns_or_else_by_their_looks(spark):
    reference = spark.createDataFrame([(k, f"https://a.com.br/oferta/{k}", "") for k in range(3)] + [(9, "https://x.d.com.br/1", ""), (8, "https://y.d.com.br/2/z", "")], PAGES)
    patterns = training.url_patterns(reference)
    got = {r.name: (r.domain, r.pattern, round(r.confidence, 9)) for r in patterns.collect()}
    assert got == {"a.com.br": ("a.com.br", "/oferta/{id}", 0.5), "d.com.br": ("x.d.com.br", "", 0.4)}
    seeds = [(1, "https://a.com.br/", anchors("/oferta/7", "/oferta", "https://b.com.br/oferta/7")), (2, "https://c.com.br/l", anchors("/oferta/7", "/imovel/q", "/oferta", "/z/ab12"))]
    links = lambda p: sorted(r.link for r in discovery.matched_links(spark.createDataFrame(seeds, PAGES), p).collect())
    # on a known domain the domain and the trust in it are enough
    assert links(patterns) == ["https://a.com.br/oferta", "https://a.com.br/oferta/7", "https://c.com.br/imovel/q", "https://c.com.br/z/ab12"]
    assert links(None) == links(patterns.limit(0)) == ["https://c.com.br/imovel/q", "https://c.com.br/z/ab12"]


def test_the_crawl_reads_what_its_links_lead_to(spark, monkeypatch):
    monkeypatch.setattr(crawls.training, "improved_route", lambda *_: crawls.F.when(crawls.F.col("url").contains("/detalhes/"), "catalog").otherwise("process"))
    few, many = [f"/imovel/{k}" for k in (3, 4)], [f"/imovel/{k}" for k in range(5, 26)]
    url = "https://a.com.br"
    pages = [
        (1, url + "/venda", anchors("/imovel/1", "/detalhes/few", "/detalhes/many", "/detalhes/none", "https://b.com.br/imovel/9", "/sobre")),
        (2, url + "/imovel/1", anchors("/imovel/2")),  # links of listings lead nowhere
        (3, url + "/detalhes/few", anchors(*few, "/imovel/1", "/venda")),
        (4, url + "/detalhes/many", anchors(*many)),
        (5, url + "/detalhes/none", anchors("/sobre", "mailto:x@a.com.br/imovel/")),
        *[(100 + k, f"{url}/imovel/{k}", "") for k in range(2, 26)],
        (200, "https://b.com.br/imovel/9", ""), (201, url + "/sobre", ""),
    ]
    assert found(spark, pages, [url + "/venda"]) == ([2, 3, 4, 5, 103, 104], [3, 4])
    assert found(spark, pages, []) == ([], [])


def test_listings_are_saved_from_pages_that_are_reached(spark):
    url = "https://a.com.br"
    pages = [(1, url + "/venda", anchors("/imovel/1", "/imovel/2")), (2, url + "/imovel/1", LISTING.format(1, "")), (3, url + "/imovel/2", LISTING.format(2, "")), (4, url + "/imovel/3", LISTING.format(3, ""))]
    rows = spark.createDataFrame(pages, PAGES)
    every = sorted(r.page_id for r in crawls.improved(rows).collect())
    reached = sorted(r.page_id for r in crawls.improved(rows, seeds=rows.where("page_id = 1").select("url")).collect())
    assert every == [2, 3, 4] and reached == [2, 3]
