"""What pages share: read once, and as counted by hand."""

import os
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from hearthline.operators import markup, pages, training
from hearthline.plans import site_queries
from hearthline.sources import views

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "page_id long, words int, valid boolean, selectors array<string>, keywords array<string>, price_selectors array<string>, detail_selectors array<string>"


def reads(df):
    """How often a plan parses pages."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")


def test_pages_are_parsed_once(spark):
    site = views.site_pages(spark, SF)
    assert reads(training.shared_by_pages(training.analysed(site))) == 1
    assert reads(training.train_content(site)) == 1
    assert reads(site_queries.docfreq_consolidate(spark, SF)) == 1
    assert reads(site_queries.cls_content_scored(spark, SF)) == 2  # the pages scored and those that teach


def test_view_brings_its_sizes_along(spark):
    """Long pages are not joined with what their view is made of."""
    assert "Join" not in site_queries.pipe_train_content(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    site = views.site_pages(spark, SF, size="p_size")
    assert site.drop("size").columns == views.site_pages(spark, SF).columns


def test_shared_as_counted_by_hand(spark):
    rows = [(k, 50 + k, k < 7, ["h1"] + (["h2"] if k < 2 else []), ["casa"] if k % 2 else [], [".preco"] if k == 3 else [], []) for k in range(9)]
    row = training.shared_by_pages(spark.createDataFrame(rows, SCHEMA)).first()
    assert (row.pages, row.valid_pages, row.typical_words, row.least_words, row.most_words) == (9, 7, 53, 26, 159)
    # three tenths of seven are two
    assert (row.common_selectors, row.common_keywords, row.price_selectors, row.detail_selectors) == (["h1", "h2"], ["casa"], [".preco"], [])


def test_nothing_is_shared_by_no_pages(spark):
    for rows in ([], [(1, 5, False, ["h1"], ["casa"], [".preco"], [])]):
        row = training.shared_by_pages(spark.createDataFrame(rows, SCHEMA)).first()
        assert (row.pages, row.valid_pages, row.typical_words, row.least_words) == (len(rows), 0, None, None)
        assert row.common_selectors == row.common_keywords == row.price_selectors == row.detail_selectors == []


def test_analysis_of_a_page(spark):
    pages = spark.createDataFrame([(1, "u", "<h1>Casa</h1><p class='preco'>R$ 5,00</p> venda<i> ÁREA </i>"), (2, "v", None)], "page_id long, url string, html string")
    row, empty = training.analysed(pages).orderBy("page_id").collect()
    assert (row.words, row.has_price, row.has_details, row.selectors, row.price_selectors, row.valid) == (4, True, False, ["h1"], [".preco", "[class*='preco']"], False)
    assert row.keywords == ["casa", "venda"]
    assert (empty.words, empty.keywords, empty.valid) == (0, [], False)


def test_an_analysis_has_the_elements_it_was_made_of(spark):
    html = "<title>Oi</title><p class='preco x' id='p'>R$ 5,00</p><p class='preco'> </p><b class='preco'>R$ 6</b><div class='info'> 2 QUARTOS </div><div class='info'>nada</div>"
    row = training.analysed(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"), elements=True).first()
    prices = [("R$ 5,00", ["preco", "x"], "p"), ("R$ 6", ["preco"], "")]
    assert [tuple(e) for e in row.price_elements] == [(s, *p) for s in (".preco", "[class*='preco']") for p in prices]
    assert [tuple(e) for e in row.detail_elements] == [(".info", "2 quartos", ["info"], "")]
    assert (row.title, row.has_price, row.has_details, row.price_selectors, row.detail_selectors) == ("Oi", True, True, [".preco", "[class*='preco']"], [".info"])


def test_analysis_gives_all_that_it_finds(spark):
    found = site_queries.page_analyse(spark, SF)
    assert {"title", "words", "price_elements", "detail_elements", "price_selectors", "detail_selectors", "selectors", "keywords", "valid"} <= set(found.columns)
    assert found.where("keywords = '' OR words < 5").isEmpty()


def test_consolidation_takes_valid_pages_and_gives_all_that_they_share(spark):
    row = site_queries.docfreq_consolidate(spark, SF).first()
    assert 0 < row.valid_pages < row.pages and row.least_words == row.typical_words // 2 and row.most_words == 3 * row.typical_words
    assert {"h1", "h2", ".titulo"} <= set(row.common_selectors.split(",")) and {"quartos", "venda"} <= set(row.common_keywords.split(","))


def test_pages_of_one_file_are_dealt_out(spark):
    """A file with one group of rows is one task's, however many pages it holds."""
    dealt = views.pages(spark, SF)
    assert dealt.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(dealt.collect()) == sorted(views.read(spark, SF, "pages").collect())


def test_content_is_learned_of_pages_parsed_once(spark):
    assert reads(site_queries.content_learn(spark, SF)) == 1
    plan = site_queries.content_features_agg(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan


@pytest.mark.parametrize("base", ["https://a.com.br/x/y?z", "http://a.com", "HTTPS://A.com/x", "https://u@a.com:80/x", "", "a/b", "https://a.com/;p", "https://a.com?q"])
def test_links_are_joined_as_the_library_does(base):
    for link in ("/b", "/b/", "/b/c?d=1&e=2", "/b?", "/b//c", "//c/d", "/b/../c", "/b;c", "/b#c", "b", "?x=1", "/", "https://d/e", "/b?c=d?e", "/é"):
        assert markup._joined(base, link) == urljoin(base, link)


def test_elements_with_text_and_their_order(spark):
    html = "<div class='a'><p class='b'></p>x<p class='c'><b id='d'>y</b></p></div><i class='e'> </i><u class='a f'>z</u></x>"
    row = markup.parsed(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"), linked=False).first()
    assert row.filled == [".a", ".c", "#d", ".f"] and "links" not in row


def test_selectors_are_listed_where_first_seen(spark):
    """Pages with equal lists count as one, by the first of them; order is that of pages and then of places."""
    rows = [("h", 3, {"price": ["c", "a"]}), ("h", 1, {"price": ["b", "a"], "area": ["z"]}), ("h", 2, {"price": ["c", "a"]}), ("h", 5, {"price": ["d"]}), ("i", 1, {"price": ["d", "b"]}), ("i", 0, {})]
    found = training.selectors_by(spark.createDataFrame(rows, "host string, seq long, selectors map<string,array<string>>"), "host")
    assert {r.host: r.selectors for r in found.collect()} == {"h": {"price": ["b", "a", "c", "d"], "area": ["z"]}, "i": {"price": ["d", "b"]}}
    # many pages' lists are counted by their numbers, without sorting them
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate posexplode") < plan.rindex("HashAggregate(keys=[host")


def test_reference_page_by_hand(spark):
    html = "<title>Oi</title><p class='preco'>R$ 5,00</p><p class='price'>nada</p><i class='quartos'>2 quartos, quartos</i> A@B.com x@y PRÓXIMA ORDENAR"
    pages = spark.createDataFrame([(1, "http://h/x", html), (2, "http://h/y", None), (3, "http://h/z", "m²m² iptu IPTU")], "page_id long, url string, html string")
    one, two, three = training.reference_pages(pages).orderBy("page_id").collect()
    assert (one.email_count, one.property_keywords, one.has_pagination, one.has_filters) == (1, 2, True, True)
    assert one.selectors == {"price": [".preco", "[class*='preco']"], "rooms": [".quartos", "[class*='quartos']"]}
    assert (two.email_count, two.property_keywords, two.has_pagination, two.selectors) == (0, 0, False, {}) and three.property_keywords == 4


def test_parts_are_counted_as_they_divide(spark):
    texts = ["", "aaaa", "aaa", "xaax", "éé", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(pages.count(F.col("t"), "aa").alias("n"), pages.count(F.col("t"), "é").alias("m")).collect()
    assert [r.n for r in rows] == [0, 2, 1, 1, 0, None] and [r.m for r in rows] == [0, 0, 0, 0, 2, None]
