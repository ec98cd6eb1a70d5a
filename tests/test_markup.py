"""Markup operators on pages small enough to read."""

from hearthline.operators import markup

CARD = '<div class="property-card big"><a href="/imovel/{0}">Casa</a> R$ {0},00</div>'
PAGES = [
    (1, "https://a.com.br/x/", "<html><body>" + "".join(CARD.format(n) for n in (1, 2, 3)) + '<div class="pagination">1 <a href="?p=2">Próxima</a></div><form action="busca"></form></body>'),
    (2, "https://a.com.br/y", '<div id="property-info">3 quartos</div><div class="fotos">' + '<img src="f.jpg">' * 4 + '</div><span data-url="/z">m</span><a href="/z">z</a>'),
    (3, None, None),
    (4, "https://a.com.br/", "<div class='pagination'> </div><p>texto</p></div></section><p"),
]


def found(spark):
    return markup.parsed(spark.createDataFrame(PAGES, "page_id long, url string, html string"))


def test_structure(spark):
    assert {r.page_id: r.kind for r in markup.structure(found(spark)).collect()} == {1: "catalog", 2: "property", 3: None, 4: None}


def test_features(spark):
    rows = {r.page_id: r for r in markup.features(found(spark)).collect()}
    one, two = rows[1], rows[2]
    assert (one.price_count, one.link_count, one.div_count, one.form_count, one.has_pagination, one.has_filters) == (3, 4, 4, 1, True, False)
    assert (two.quartos_count, two.image_count, two.property_keywords, two.has_pagination) == (1, 4, 1, False)
    assert rows[3].text_length == 0 and not rows[4].has_pagination


def test_classes_and_links(spark):
    assert [tuple(r) for r in markup.common_classes(found(spark)).collect()] == [(1, "property-card", 3)]
    links = [(r.page_id, r.link) for r in markup.links(found(spark)).orderBy("page_id", "at").collect()]
    assert links == [(1, f"https://a.com.br/imovel/{n}") for n in (1, 2, 3)] + [(1, "https://a.com.br/x/?p=2"), (1, "https://a.com.br/x/busca"), (2, "https://a.com.br/z")]


def test_no_pages(spark):
    empty = markup.parsed(spark.createDataFrame([], "page_id long, url string, html string"))
    assert markup.features(empty).count() == markup.structure(empty).count() == 0
