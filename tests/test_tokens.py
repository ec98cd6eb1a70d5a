"""Tags and texts by pattern against html.parser, and how pages are dealt out and handed on."""

import gc
import os
import weakref

import pytest

pa = pytest.importorskip("pyarrow")

from hearthline.operators import discovery, select, tokens  # noqa: E402
from hearthline.sources import views  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
PLAIN = (
    "", "a &amp; b", '<p CLASS="a b">x<br/>y</P >', "<!DOCTYPE html><!-- <b> -->t", "<script>if (a<b) x='</p>';</script><style>p{}</style>", "<a href='q?a=1&amp;b' data-x=1 b>c</a>", "<img src=a/b/>", "&copy &lt",
)
ODD = ("<", "a < b", "<p", "<p class=>x", "</>", "<!-- a", "<![CDATA[x]]>", "<?x?>", "<script>a</script", '<a b="1"c="2">', "<p></p x>", "<!-->x-->", "<script>a", "<a b='>", "<b/ >")


def joined(found):
    out = []
    for t in found:
        if t[0] == tokens.DATA and out and out[-1][0] == tokens.DATA:
            out[-1] = (tokens.DATA, out[-1][1] + t[1])
        else:
            out.append(t[:3])
    return out


@pytest.mark.parametrize("html", [*PLAIN, *ODD, *[a + b for a in PLAIN for b in ODD]])
def test_like_html_parser(html):
    assert joined(tokens.tokens(html)) == joined(tokens.parsed(html))


@pytest.mark.parametrize("html", PLAIN)
def test_plain_pages_by_pattern_alone(monkeypatch, html):
    monkeypatch.setattr(tokens, "parsed", lambda _: pytest.fail("left to html.parser"))
    tokens.tokens(html)


def test_pages_are_dealt_out(spark):
    """A small file is one task; the pages that a view makes of it must not be."""
    site = views.site_pages(spark, SF)
    assert site.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert min(site.rdd.glom().map(len).collect()) > 0


def test_batches_leave_in_pieces():
    """What is made of pages leaves a task a few hundred rows at a time, however many a batch has."""
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(2000)), "url": ["u"] * 2000, "html": ["<p>x</p>"] * 2000})
    assert [len(columns[2]) for _, columns in select.pieces([batch])] == [512, 512, 512, 464]


def test_columns_are_kept_and_cards_have_own_attributes(spark):
    pages = spark.createDataFrame([(1, "u", "<form action='/a'><b>1</b></form><form><b>2</b></form>", "k"), (2, "v", None, None)], "page_id long, url string, html string, more string")
    rows = select.gathered(pages, ("b", "i"), ("i",), (), "form", ("more",), ("action",)).orderBy("card").collect()
    assert [(r.page_id, r.card, r.found, r.listed, r.given, r.more) for r in rows] == [(1, 0, {"b": "1"}, {}, {"@action": ["/a"]}, "k"), (1, 1, {"b": "2"}, {}, {}, "k")]
    assert [(r.page_id, r.more, r.text) for r in select.gathered(pages, keep=("more",)).orderBy("page_id").collect()] == [(1, "k", "12"), (2, None, "")]


def test_bounds_leave_out_what_is_too_long(spark):
    pages = spark.createDataFrame([(1, "u", "<b>ção</b><i>ção</i><u>ção</u>")], "page_id long, url string, html string")
    row = select.gathered(pages, ("b", "i", "u"), bounds={"b": 5, "i": 6}).first()
    assert row.found == {"i": "ção", "u": "ção"} and row.counts == {"b": 1, "i": 1, "u": 1}


def test_links_of_three_kinds_from_one_table(spark):
    site = views.site_pages(spark, SF)
    links = discovery.links_of(site)
    for each in (discovery.listing_links, discovery.pagination_links, discovery.catalog_links):
        assert sorted(each(None, found=links).collect()) == sorted(each(site).collect()) != []


@pytest.mark.parametrize("html", [*PLAIN, *ODD, *[a + b for a in PLAIN for b in ODD], "<p><!-- a>b --></p>", "<p><!-- a<b --></p>", "<a b='x>y'>z</a>", "<script/>x</script>", "a>b<p>c>d</p>"])
def test_cut_at_brackets_like_the_pattern(html):
    assert tokens.tokens(html) == tokens.matched(html)


def test_plain_pages_are_cut_and_not_matched(spark, monkeypatch):
    """A tag's spelling is read once for all pages; the pattern is not walked over a plain page."""
    site = [r.html for r in views.site_pages(spark, SF).limit(20).collect()]
    want = [tokens.matched(html) for html in site]
    monkeypatch.setattr(tokens, "matched", lambda _: pytest.fail("left to the pattern"))
    assert [tokens.tokens(html) for html in site] == want
    longest = "<a href='" + "x" * tokens.LONGEST + "'>"
    assert tokens.tokens(longest)[0][2] == {"href": "x" * tokens.LONGEST} and not any(len(k) > tokens.LONGEST for k in (*tokens._tags, *tokens._known))


def test_a_page_is_freed_without_a_search_for_cycles():
    """Pages leave memory as soon as they are done with."""
    gc.disable()
    try:
        page = select.Page("<div><p>a</p><br>b</div>")
        gone = weakref.ref(page)
        element = page.find("p")[0]
        del page
        assert gone() is None and element.text() == "a"
    finally:
        gc.enable()


def test_catalog_links_meet_once(spark):
    """The rows of a page are brought together once, and only addresses whose label fits are resolved."""
    found = discovery.catalog_links(views.site_pages(spark, SF))
    plan = found._jdf.queryExecution().executedPlan().toString()
    # the pages dealt out, and the links
    assert plan.split("== Initial Plan ==")[-1].count("Exchange ") == 2
    pages = spark.createDataFrame([(1, "https://a.com/x", "<a href='/b'>Nada</a><a href='/c'>VENDA</a><a>Venda</a><a href='#'>Venda</a><a href='/d'>Casas</a><a href='/c'>Venda</a>")], "page_id long, url string, html string")
    assert [tuple(r) for r in discovery.catalog_links(pages).orderBy("at").collect()] == [(1, 0, "https://a.com/c"), (1, 1, "https://a.com/d")]


def test_interactive_parses_a_page_once(spark):
    """Buttons and forms are counted from one parse, as each counts alone; a form may be a button too."""
    html = [
        "<form class='search-form' id='busca'><input name='cidade' placeholder='Tipo'><select name='preco'></select><button>Buscar</button></form>",
        "<button class='search'>x</button><input type='submit' value='Buscar' class='busca'><a role='button' id='pesquisa' class='search' title='t'> </a><form><input name='x'></form>",
        "<form action='/a'><input name='q'><input placeholder='city'></form><form><input name='q'><input name='size'><input type='submit' value='SEARCH'></form>",
        "<p>nada</p>", None,
    ]
    pages = spark.createDataFrame([(k, f"https://a.com/{k}", h) for k, h in enumerate(html)], "page_id long, url string, html string")
    got = {r.page_id: (r.buttons, r.forms) for r in discovery.interactive(pages).collect()}
    count = lambda found: {r["page_id"]: r["count"] for r in found.groupBy("page_id").count().collect()}
    alone, forms = count(discovery.buttons(pages)), count(discovery.forms(pages))
    assert got == {k: (alone.get(k, 0), forms.get(k, 0)) for k in range(len(html))} and got[0] == (1, 1) and got[3] == got[4] == (0, 0)
    plan = discovery.interactive(views.site_pages(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
