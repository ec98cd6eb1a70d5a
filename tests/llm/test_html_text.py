import time

import pytest

from hearthline.llm import html_text as H

CASES = [
    ("", ""),
    ("just text &amp; more", "just text & more"),
    ("<p>a <b>b<br>c</b>\n d<p>e&nbsp;f</p>", "a b c d\n\ne f"),
    ("<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><a>menu</a></nav><div class=ad>buy</div><article><h1>Head</h1><p><b>One<br><p>Two</p>three</article><footer>f</footer>", "Head\n\nOne\n\nTwo\n\nthree"),
    ("<main><header><h1>Title</h1><p>by me</p></header><section><p>Body</p></section><section class='comments'><article class='comment'><p>troll</p></article></section><form><p>x</p></form></main>", "Title\n\nBody"),
    ("<article><p>a</p><aside>side</aside><div class=\"cookie-notice\">cookies</div><ul><li>x<li>y</ul><table><tr><td>1<td>2</table></article><p>outside</p>", "a\n\nx\n\ny\n\n1\n\n2"),
    ("<header>site</header><div id='sidebar'>s</div><div hidden>h</div><div>kept <!-- no --> text</div><!-- open", "kept text"),
    ("<article><p>5 < 6 &lt;b&gt; &#233; &#x65e5; &bogus; <a href='a>b' title=\"<p>\">link</a></article>", "5 < 6 <b> é 日 &bogus; link"),
    ("<ARTICLE><P CLASS=lead>Caps</P></ARTICLE>", "Caps"),
    ("<article><p>Of.</p><p>Of.</p></article>", "Of.\n\nOf."),
    ("<p class=\"unclosed>text</p><p>more", "text\n\nmore"),  # a quote that never ends: the tag ends at the first >
    ("<p class='never ends", "<p class='never ends"),
]


@pytest.mark.parametrize("page, text", CASES)
def test_main_text(page, text):
    assert H.main_text(page) == text


def test_broken_markup_is_linear_and_never_fails():
    for page in ("<div>" * 3000 + "x", "<p " * 3000, "<a b='" * 2000, "<!--" * 3000, "</p>" * 3000, "<script>" * 2000, "&" * 5000, "<table><tr><td>" * 800):
        H.main_text(page)


def site(spark, n, extra=()):
    body = lambda i: f"<html><body><div class='top'><p>Welcome to the site</p><p>All topics</p></div><div class='body'><p>Story {i} tells of {i * 7}.</p><p>It ends with {i * 13}.</p></div><div>Part {i % 2} of two</div></body></html>"
    rows = [(i, f"https://Example.com/{i}", body(i), "clash") for i in range(n)] + [(1000 + i, u, h, "clash") for i, (u, h) in enumerate(extra)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, text string")


@pytest.mark.parametrize("broadcast_rows", [20_000, 0])
def test_style_tree_removes_what_recurs_on_a_host(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(H, "BROADCAST_ROWS", broadcast_rows)
    extra = [(None, None), ("http://other.org/", "<div class='top'><p>Only page</p></div>"), ("http://other.org/", "<div class='top'><p>Only page</p></div>"), ("notaurl", "")]
    rows = {r.page_id: r for r in H.extract(site(spark, 12, extra)).collect()}
    assert len(rows) == 16
    assert rows[3].text == "Story 3 tells of 21.\n\nIt ends with 39." and rows[3].n_chars == len(rows[3].text)
    assert (rows[1000].text, rows[1001].text, rows[1002].text, rows[1003].n_chars) == ("", "Only page", "Only page", 0)


def test_importance(spark):
    tree = {r.style: r for r in H.style_tree(site(spark, 12)).collect()}
    assert tree["html>body>div.top"].importance < 0.2 < 0.9 < tree["html>body>div.body>p"].importance
    assert tree["html>body>div.top>p"].importance == pytest.approx(1 - 1 * __import__("math").log(12) / __import__("math").log(24))
    assert H.extract(site(spark, 0)).count() == 0


def texts_of(spark, pages, url="https://site.org/"):
    rows = [(i, url and f"{url}{i}", h) for i, h in enumerate(pages)]
    return [r.text for r in sorted(H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())]


@pytest.mark.parametrize("n", [6, 300, 10_000])
def test_a_site_is_cleaned_alike_whatever_its_page_count(spark, n):
    menu = "".join(f"<li>Entry {k}</li>" for k in range(40))
    links = "".join(f"<p>Link {k}</p>" for k in range(40))
    body = lambda i: f"<html><body><nav><ul>{menu}</ul></nav><div class='links'>{links}</div><div>{''.join(f'<p>Paragraph {k} of story {i}.</p>' for k in range(3))}</div><div class='kind'>Kind {i % 25}</div><section>Always here<p>Tale {i}</p></section></body></html>"
    texts = texts_of(spark, [body(i) for i in range(n)])
    assert texts == ["\n\n".join([*(f"Paragraph {k} of story {i}." for k in range(3)), f"Kind {i % 25}", f"Tale {i}"]) for i in range(n)]


def test_copies_of_a_page_are_one_page(spark):
    copy = "<html><body><footer>at {}</footer><h1>Head</h1>" + "".join(f"<p>Part {k}.</p>" for k in range(5)) + "</body></html>"
    whole = "\n\n".join(["Head", *(f"Part {k}." for k in range(5))])
    for n in (4, 10, 400):
        assert texts_of(spark, [copy.format(i) for i in range(n)]) == [whole] * n
        assert texts_of(spark, [copy] * n, url=None) == [whole] * n
    # beside other pages of the host, whose common block goes
    other = lambda i: f"<html><body><h1>Title {i}</h1><div class='top'>Welcome</div><p>Story {i}.</p></body></html>"
    assert texts_of(spark, [copy] * 60 + [other(i) for i in range(8)]) == [whole] * 60 + [f"Title {i}\n\nStory {i}." for i in range(8)]
    # many blocks are not many pages
    assert texts_of(spark, ["<p>One</p><p>Two</p><div>Same</div><div>Same</div><div>Same</div>" + f"<i>{i}</i>" for i in range(3)])[2].startswith("One\n\nTwo\n\nSame")


def test_tree_decides_within_articles(spark):
    page = lambda i: f"<nav>menu</nav><article><h1>Title {i}</h1><p>Story {i}.</p><div class='box'><p>Join our club</p></div><p>End of {i}.</p></article>"
    assert texts_of(spark, [page(i) for i in range(9)]) == [f"Title {i}\n\nStory {i}.\n\nEnd of {i}." for i in range(9)]
    # an article that recurs does not hide the text beside it
    page = lambda i: f"<article class='box'>Join our club</article><div><p>Story {i}.</p></div>"
    assert texts_of(spark, [page(i) for i in range(9)]) == [f"Story {i}." for i in range(9)]


WORDED = [
    "<article class='post category-privacy'><p>Story {}.</p></article>",
    "<article class='privacy'><p>Story {}.</p></article>",
    "<div class='content no-sidebar'><p>Story {}.</p></div>",
    "<div class='content no-sidebar'><article><p>Story {}.</p><div class='related'>r</div></article></div>",
    "<div class='widget'><main><p>Story {}.</p><section class='comments'><article class='comment'>troll {}</article></section></main></div>",
    "<main><article class='privacy'><p>Story {}.</p><article class='comment'>troll {}</article></article></main>",
]


@pytest.mark.parametrize("page", WORDED)
def test_words_are_hints_on_what_holds_the_article(spark, page):
    assert H.main_text(page.replace("{}", "1")) == "Story 1."
    assert texts_of(spark, [page.replace("{}", str(i)) for i in range(9)]) == [f"Story {i}." for i in range(9)]


def test_importance_overrules_words(spark):
    page = "<main><p>News of day {0}.</p><article class='privacy'><p>Story {0}.</p></article><article class='cookie'><p>We bake.</p></article></main><div class='related'><article>Teaser {0}</article></div>"
    assert H.main_text(page.format(1)) == "News of day 1."
    assert texts_of(spark, [page.format(i) for i in range(9)]) == [f"News of day {i}.\n\nStory {i}." for i in range(9)]


def test_hostile_markup_takes_time_as_its_length():
    for page in ("<a " * 350_000, "<!a" * 350_000, "<div>" * 200_000, "<div>" * 100_000 + "</span>" * 100_000, "<div>" * 100_000 + "<li>x" * 100_000, "<!--" * 250_000):
        began = time.monotonic()
        H.main_text(page)
        assert time.monotonic() - began < 20


def test_references_end_at_tags():
    assert H.main_text("<p>&am<b>p;</b> a&amp;b</p>") == "&amp; a&b"


def test_ids_ties_and_clashing_columns(spark):
    rows = [(None, None, "<p>A</p>", 1), (1, "http://h/a", "<p>A</p>", 2), (1, "http://h/a", "<p>A</p>", 2), (2, "http://h/b", None, 3), (3, "http://h/c", "<p>" + "word " * 300_000 + "</p>", 4)]
    out = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert sorted((r.page_id or 0, r.text[:4], r.n_chars) for r in out) == [(0, "A", 1), (1, "A", 1), (1, "A", 1), (2, "", 0), (3, "word", 1_499_999)]


NAMES = [
    ("related-work", False), ("warning-signs", False), ("share-price", False), ("search-algorithms", False), ("no-sidebar", False), ("footer-theory", False), ("story", False), ("", False),
    ("ad", True), ("ad-leaderboard", True), ("Ad_Slot_3", True), ("site-footer", True), ("related-posts", True), ("comment-17", True), ("share", True), ("cookie-notice", True), ("main-menu", True), ("sidebar-history", True),
]


@pytest.mark.parametrize("name, marks", NAMES)
def test_names_mark_boilerplate_as_a_whole(spark, name, marks):
    assert H.boilerplate(name) == marks
    for kind in ("class", "id", "role"):
        assert H.main_text(f"<article><p>Intro.</p><section {kind}='{name}'>Part.</section></article>") == ("Intro." if marks else "Intro.\n\nPart.")
        assert H.main_text(f"<p>Intro.</p><section {kind}='{name}'>Part.</section>") == ("Intro." if marks else "Intro.\n\nPart.")


def test_the_tree_decides_where_a_word_stands_beside_others(spark):
    page = "<article><p>Story {0}.</p><div class='related-work'>Others did {0}.</div><div class='share-price'>Ask us</div></article>"
    assert texts_of(spark, [page.format(i) for i in range(9)]) == [f"Story {i}.\n\nOthers did {i}." for i in range(9)]
    assert texts_of(spark, [page.format(i) for i in range(3)])[0] == "Story 0.\n\nOthers did 0.\n\nAsk us"


def test_a_form_around_the_page_is_no_form(spark):
    long = "A sentence of the story, which goes on for a while. " * 5
    assert H.main_text(f"<form action='/x'><div>{long}</div><button>Go</button></form><p>End.</p>") == f"{long.strip()}\n\nEnd."
    assert H.main_text("<form><nav>menu</nav><article><p>Story.</p><form><p>Your name</p></form></article></form>") == "Story."
    assert H.main_text("<form id='aspnetForm'><main>Story.</main><div>x</div></form>") == "Story."
    assert H.main_text(f"<p>{long}{long}</p><form>{long}</form>") == (long + long).strip()
    assert H.main_text("<form>Name Password</form>") == H.main_text(f"<form class='search-form'>{long}</form>") == ""
    assert H.main_text(f"<article><p>Story.</p><form>{long}</form></article>").startswith("Story.")
    page = "<form><div class='top'>Welcome</div><p>Story {0} goes on " + "and on and on " * 20 + "until {0}.</p></form>"
    assert [t.split()[:2] for t in texts_of(spark, [page.format(i) for i in range(9)])] == [["Story", str(i)] for i in range(9)]


class Node:
    def __init__(self):
        self.pages, self.texts, self.shapes, self.below = 0, [], [], set()


def plain_tree(pages):
    """The importance of each style of one host, from its distinct pages: entropies as the method has them, in plain Python."""
    from math import log

    entropy = lambda values: sum(-(n / len(values)) * log(n / len(values)) for n in (values.count(v) for v in set(values)))
    nodes = {}
    for page in {tuple((b.path, b.text) for b in H.parse(p)[0] if b.state != "out"): p for p in pages}.values():
        blocks, elements = H.parse(page)
        kept = {(b.path, b.text) for b in blocks if b.state != "out"}
        for style in {a for path, _ in kept for a in H.ancestors(path)}:
            nodes.setdefault(style, Node()).pages += 1
        for path, text in kept:
            nodes[path].texts.append(text)
        for path, shape in set(elements):
            nodes.setdefault(path, Node()).shapes.append(shape)
    leaf = {}
    for style, node in nodes.items():
        if node.texts:
            m = len(node.texts)
            # each content's entropy over the blocks of its style is that of its even spread over the pages that hold it
            leaf[style] = (m, 1 - sum(log(node.texts.count(t)) for t in set(node.texts)) / len(set(node.texts)) / log(m) if m > 1 else 1.0)
    out = {}
    for style, node in nodes.items():
        below = [v for s, v in leaf.items() if s == style or s.startswith(style + ">")]
        if not below or not node.pages:
            continue
        mean = sum(m * v for m, v in below) / sum(m for m, _ in below)
        if node.shapes:
            share = H.GAMMA ** len(set(node.shapes))
            variety = entropy(node.shapes) / log(len(node.shapes)) if len(node.shapes) > 1 else 1.0
            mean = (1 - share) * variety + share * mean
        out[style] = mean
    return out


def test_importance_against_a_plain_tree(spark):
    import random

    rng = random.Random(5)
    part = lambda i: rng.choice([f"<p>Text {i} {rng.random()}</p>", "<p>Same</p>", "<div class='a'>Menu<i>x</i></div>", f"<div class='b'><p>{i % 3}</p><p>{i % 2}</p></div>", "<section><div>Deep</div></section>", ""])
    pages = ["<body>" + "".join(part(i) for _ in range(rng.randrange(1, 7))) + "</body>" for i in range(40)]
    pages += pages[:10]
    rows = spark.createDataFrame([(i, f"http://h/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r.style: r.importance for r in H.style_tree(rows).collect()}
    assert got == pytest.approx(plain_tree(pages), abs=1e-9) and len(got) > 5
