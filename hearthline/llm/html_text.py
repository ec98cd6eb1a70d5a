"""Main text of web pages, with a site style tree deciding on branches that markup alone leaves open.

Pages are read by a tolerant tokeniser into blocks: runs of text between block-level tags, each with its style path (tags and
classes from the root). Some branches are boilerplate by their markup: by tag, because they are hidden, or by a name (a class, an id
or a role) that says so as a whole: all its words are words of boilerplate or neutral ones (related-posts, site-footer, share), or one
never names anything else (ad-leaderboard). Such a word beside others (related-work, share-price, warning-signs; no-sidebar and
category-privacy too) marks nothing, and the tree decides as on every other branch. Names that say so as a whole drop a branch
whatever its importance, as comments, teasers and adverts differ from page to page like the text does. A form that holds an article
or main, or most of a page's text and FORM_CHARS of it or more, is the page and not a form. Where a page has article or main elements,
the text is what lies in them.

A name is only a hint on an article or main that is not within an article, and on what contains one. Such an article or main is
read if its style is important over MIN_PAGES pages or more, or if the page's other articles have headings at most; what contains
one is read if all that leaves headings at most (those with the fewest hints around them first), with the open branches unless
an article without such a hint was found.

The style tree merges the pages of a host: per style path, how often each content (the hash of a block's text) and each
presentation (the sequence of child styles) occurs. What markup drops is not counted, and pages of a host with the same blocks
(path and text) count as one page. Content that recurs over m blocks has
entropy near 1 (log n / log m), content of one page 0; a block style's importance is 1 less the mean entropy of its contents. An
inner style's importance is (1 - GAMMA**l) times the entropy of its l presentations plus GAMMA**l times the mean importance of
the block styles below.

What is decided must not depend on the number of pages or blocks: there, a content's entropy is log n over the log of the pages
that have text of this style, and a host of more than REFERENCE_PAGES counts as one of so many (n in proportion), so that one of
25 equally common contents weighs the same on every large host. A branch that markup does not drop, within an article or main or not, goes from every page of its host if its
style and all styles below it are under THRESHOLD, over MIN_PAGES distinct pages or more; so does text directly in an element
that stays for what is below it.

Pages are made distinct by host and a hash of their blocks, and the statistics summed per (host, style, content) before they are
shuffled, so a host with a third of all pages, or a page copied as often, meets in no single task. What comes of them, the styles to remove or to keep in spite of a word, is sent to all tasks only if it is small (checked), else it is joined to
the pages by host and a salt.

Null html counts as empty, null urls as one nameless host. Pages without text have an empty string. Repeated rows are extracted
each on its own, an empty table gives no rows. Broken and very long markup never fails and takes time as its length: what is not
a tag is text, elements nested deeper than DEPTH have the style of the one around them. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
import html
import re
import struct
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import small_batches, text_or_empty, written

GAMMA, THRESHOLD, MIN_PAGES = 0.9, 0.35, 4
#: Elements nested deeper than this have the style of the one around them.
DEPTH = 256
#: A larger host's counts are taken in proportion to so many pages.
REFERENCE_PAGES = 1000
#: Styles that are judged are broadcast up to so many rows, and joined beyond.
BROADCAST_ROWS, SALTS = 20_000, 32

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/)(?P<close>[a-zA-Z][^\s/>]*)[^>]*>"
    r"|<(?P<open>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>",
    re.S,
)
#: What may still come where no ">" follows: all else that begins like a tag is text.
_REST = re.compile(r"<!--.*|<!\[CDATA\[.*", re.S)
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z]+")
#: Words behind these say what an element lacks, leaves room for or is about.
_QUALIFIED = re.compile(r"(?<![a-z])(?:no|not|without|has|with|category|tag|topic)[-_]+[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(rf"</{t}(?=[\s/>])|\Z", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noframes")}
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary"
    " table tbody td tfoot th thead tr ul".split()
)
#: What an opening tag closes when it is the innermost open element of its kind, and where looking for it ends.
CLOSES = {
    **{t: ({"p"}, {"button", "table", "td", "th", "article", "section", "div", "li"}) for t in BLOCK - {"li", "dd", "dt", "tr", "td", "th", "option", "html", "head", "body", "tbody", "thead", "tfoot"}},
    "li": ({"li", "p"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt", "p"}, {"dl"}),
    "dt": ({"dd", "dt", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}),
    "td": ({"td", "th", "p"}, {"tr", "table"}),
    "th": ({"td", "th", "p"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
BOILERPLATE_TAGS = frozenset("nav footer aside head button select dialog menu search svg math object canvas audio video fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of a class, an id or a role that mark boilerplate.
BOILERPLATE_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertising advertorial alert alertdialog announcement banner breadcrumb breadcrumbs"
    " comment comments commentlist complementary consent contentinfo cookie cookies copyright dialog disclaimer disqus feedback footer"
    " form gdpr login masthead menu modal nav navbar navigation newsletter notice notification notifications overlay pager pagination"
    " paywall popup privacy promo promoted promotion recommendations recommended related reply respond search share sharing sidebar"
    " signup skip social sponsor sponsored subscribe subscription teaser toolbar trending warning widget".split()
)
#: Of these, those that name boilerplate whatever stands beside them.
SURE_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertising advertorial breadcrumb breadcrumbs commentlist contentinfo disqus gdpr"
    " navbar newsletter pagination paywall popup sidebar".split()
)
#: Words for parts, places and sizes, which say nothing of their own beside a word of boilerplate.
NEUTRAL_WORDS = frozenset(
    "a above after all and area article articles author avatar bar before below block body bottom box btn button buttons card cards"
    " center class col column component container content count cta date desktop div el element elements entry entries first fixed"
    " float foot footer for full global group head header heading hidden holder home icon icons id in info inline inner is item items"
    " js label large last layer layout left level line link links list lists lg local main mark md media message messages meta mini"
    " mobile module name new node of on open outer page pages panel parent part placeholder popular post posts primary region right"
    " row rows secondary sect section sections site slot sm small sticky stories story sub tab tabs tertiary text the thread title to"
    " top tray ui unit user view visible wp wrap wrapper xl xs you your zone".split()
)
#: A form with so many characters and most of a page's text is the page.
FORM_CHARS = 200


@dataclass(slots=True, eq=False)
class Element:
    tag: str
    path: str
    state: str  # "out": boilerplate by markup, "in": within article or main, "head": a header within one, "open": neither
    children: list[str]
    hints: tuple[Element, ...] = ()  # this and those above that a name marks, and forms
    inside: bool = False  # within an article
    main: bool = False  # an article or main, not within an article
    holds: bool = False  # contains one, and is not within an article
    form: bool = False  # a form that no name marks


@dataclass(slots=True)
class Block:
    text: str
    path: str
    state: str
    hints: tuple[Element, ...] = ()

    @property
    def level(self) -> int:
        """0: no hint against it, 1: only on articles or mains themselves, 2 and more: on so many less 1 that contain them."""
        return 1 + sum(not e.main for e in self.hints) if self.hints else 0

    @property
    def heading(self) -> bool:
        return self.path.rsplit(">", 1)[-1].split(".", 1)[0] in HEADINGS


def boilerplate(name: str) -> bool:
    """Whether a class, an id or a role says as a whole that it names boilerplate."""
    words = set(_WORD.findall(_QUALIFIED.sub(" ", name.lower())))
    marking = words & BOILERPLATE_WORDS
    return bool(marking) and (not SURE_WORDS.isdisjoint(marking) or words <= BOILERPLATE_WORDS | NEUTRAL_WORDS)


def _marked(attrs: str) -> tuple[str, bool, bool]:
    """A style suffix of the classes, whether the element is hidden, and whether a name marks it as boilerplate."""
    if not attrs:
        return "", False, False
    found = {m[1].lower(): next((g for g in m.groups()[1:] if g is not None), "") for m in _ATTR.finditer(attrs)}
    classes, named = found.get("class", ""), " ".join((found.get("class", ""), found.get("id", ""), found.get("role", "")))
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    names = sorted(set(classes.split())) or ([re.sub(r"\d+", "0", found["id"])] if found.get("id") else [])
    return "".join("." + n.replace(">", "") for n in names), hidden, any(map(boilerplate, named.split()))


def parse(page: str) -> tuple[list[Block], list[tuple[str, str]]]:
    """(blocks in page order, (path, child styles) of each element that markup does not drop)."""
    root = Element("", "", "open", [])
    stack, blocks, elements, held, forms = [root], [], [], [], []

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            blocks.append(Block(text, stack[-1].path, stack[-1].state if not (stack[-1].state == "head" and stack[-1].tag not in HEADINGS) else "out", stack[-1].hints))

    def close(upto: int) -> None:
        while len(stack) > upto:
            gone = stack.pop()
            there[gone.tag] -= 1
            if gone.children and gone.state != "out":
                elements.append(gone)

    def closed(found: re.Match, at: int) -> None:
        held.append(html.unescape(page[at : found.start()]))  # a reference does not go on behind a tag

    at, last, there = 0, page.rfind(">"), Counter()
    while found := _TAG.search(page, at) if at <= last else None:
        closed(found, at)
        at = found.end()
        tag = found["open"]
        if tag is not None:
            tag = tag.lower()
            if tag in RAW:
                at = RAW[tag].search(page, at).start()
                if (end := page.find(">", at)) >= 0:
                    at = end + 1
                continue
            block = tag in BLOCK
            if block:
                flush()
                if tag in CLOSES:
                    what, until = CLOSES[tag]
                    for k in range(len(stack) - 1, 0, -1) if any(there[t] for t in what) else ():
                        if stack[k].tag in what:
                            close(k)
                            if not any(there[t] for t in what):
                                break
                        elif stack[k].tag in until:
                            break
            elif tag == "br":
                held.append(" ")
            if tag in VOID:
                continue
            attrs = found["attrs"] or ""
            suffix, hidden, hinted = _marked(attrs)
            above = stack[-1]
            if not block and not hidden and not hinted and tag not in BOILERPLATE_TAGS:
                continue  # inline markup makes no branch
            if not block:
                flush()
            style, main = tag + suffix, False
            if above.state == "out" or tag in BOILERPLATE_TAGS or (hidden and tag not in ("html", "body")):
                state = "out"
            elif tag == "header":
                state = "head" if above.state in ("in", "head") else "out"
            elif main := tag in ("article", "main") or "role=\"main\"" in attrs:
                state = "in"
                for e in above.hints:
                    e.holds = not e.inside
            else:
                state = above.state
            deep = len(stack) > DEPTH
            if not deep:
                above.children.append(style)
            if not attrs.endswith("/") or block:
                inside = above.inside or above.tag == "article"
                new = Element(tag, above.path if deep else f"{above.path}>{style}" if above.path else style, state, [], above.hints, inside, main and not inside)
                new.form = tag == "form" and not hinted
                if (hinted and tag not in ("html", "body")) or new.form:
                    new.hints = (*above.hints, new)
                if new.form:
                    forms.append(new)
                stack.append(new)
                there[tag] += 1
        elif found["end"]:
            tag = found["close"].lower()
            if tag in BLOCK:
                flush()
            for k in range(len(stack) - 1, 0, -1) if there[tag] else ():
                if stack[k].tag == tag:
                    if tag not in BLOCK:
                        flush()
                    close(k)
                    break
    if rest := _REST.search(page, at):
        closed(rest, at)
    else:
        held.append(html.unescape(page[at:]))
    flush()
    close(1)
    if root.children:
        elements.append(root)
    dropped = lambda hints: any(not (e.main or e.holds) for e in hints)
    if forms:
        sizes, total = Counter(), 0
        for b in blocks:
            if b.state != "out" and not dropped([e for e in b.hints if not e.form]):
                total += len(b.text)
                sizes.update({e: len(b.text) for e in b.hints if e.form})
        pages = {e for e in forms if e.holds or (sizes[e] >= FORM_CHARS and 2 * sizes[e] > total)}
        for x in (*blocks, *elements) if pages else ():
            x.hints = tuple(e for e in x.hints if e not in pages)
    for b in blocks:
        if b.hints and dropped(b.hints):
            b.state = "out"
    return blocks, [(e.path, " ".join(e.children)) for e in elements if not dropped(e.hints)]


def main_text(page: str, judged: frozenset[str] = frozenset()) -> str:
    """The text of a page. judged: styles of its host that go, and with + before them those that stay in spite of a word."""
    blocks = [b for b in parse(page)[0] if b.state != "out" and not (judged and _gone(b.path, judged))]
    inside = [b for b in blocks if b.state in ("in", "head")]
    chosen = inside
    for level in sorted({b.level for b in inside}):
        chosen = [b for b in inside if b.level <= level or (b.level == 1 and all("+" + e.path in judged for e in b.hints))]
        if not all(b.heading for b in chosen):
            break
    if not any(b.level < 2 for b in chosen):
        most = max((b.level for b in chosen), default=0)
        chosen = [b for b in blocks if (b.state in ("in", "head") and b.level <= most) or (b.state == "open" and not b.hints)]
    return "\n\n".join(b.text for b in chosen)


def _gone(path: str, judged: frozenset[str]) -> bool:
    """Whether a style or one above it goes, or the text directly in it (a style with > behind)."""
    return f"{path}>" in judged or any(p in judged for p in ancestors(path))


def ancestors(path: str) -> list[str]:
    parts = path.split(">")
    return [">".join(parts[: k + 1]) for k in range(len(parts))]


def host_of(url: str | None) -> str:
    found = re.match(r"[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", (url or "").strip().lower())
    return found[1] if found else ""


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


_STATS = "host long, page long, features array<struct<path:long,kind:int,feature:long>>, path long, name string, hinted boolean"


def _counts(batches):
    """Per page the hash of its blocks and its features: contents (kind 0) and presentations (kind 1) by path, styles (kind 2) and
    those with text directly in them (kind 3). Per batch and host, the names of paths and whether a word marks
    an article or main there."""
    known: dict[str, int] = {}

    def short(text: str) -> int:
        if text not in known:
            if len(known) > 100_000:
                known.clear()
            known[text] = _hash(text)
        return known[text]

    kind = pa.list_(pa.struct([("path", pa.int64()), ("kind", pa.int32()), ("feature", pa.int64())]))
    for batch in batches:
        hosts, hashes, features, names = [], [], [], set()
        for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            blocks, elements = parse(page)
            kept = [(short(b.path), _hash(b.text), b.path) for b in blocks if b.state != "out"]
            if not kept:
                continue
            host = short(host_of(url))
            leaves = {b[2] for b in kept}
            styles = {style: short(style) for path in leaves for style in ancestors(path)}
            hinted = {e.path for b in blocks if b.state != "out" for e in b.hints if e.main}
            names.update((host, path, style, style in hinted) for style, path in styles.items())
            hosts.append(host)
            hashes.append(int.from_bytes(hashlib.blake2b(b"".join(struct.pack("<qq", *b[:2]) for b in kept), digest_size=8).digest(), "little", signed=True))
            features.append(
                [
                    *({"path": path, "kind": 0, "feature": text} for path, text in {b[:2] for b in kept}),
                    *({"path": short(path), "kind": 1, "feature": short(children)} for path, children in set(elements)),
                    *({"path": path, "kind": 2, "feature": 0} for path in styles.values()),
                    *({"path": styles[path], "kind": 3, "feature": 0} for path in leaves),
                ]
            )
        n, more = len(hosts), sorted(names)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(hosts + [k[0] for k in more], pa.int64()),
                pa.array(hashes + [None] * len(more), pa.int64()),
                pa.array(features + [None] * len(more), kind),
                pa.array([None] * n + [k[1] for k in more], pa.int64()),
                pa.array([None] * n + [k[2] for k in more], pa.string()),
                pa.array([None] * n + [k[3] for k in more], pa.bool_()),
            ],
            ["host", "page", "features", "path", "name", "hinted"],
        )


def style_tree(pages: DataFrame, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Per style of a host: host (hash), style (path), distinct pages, hinted (a word marks an article or main), importance; and what is decided by: highest, of this style and all
    below it, and text_pages and text, of the text directly in it (null without)."""
    small_batches(pages.sparkSession)
    slim = pages.select(text_or_empty(url_column).alias("url"), text_or_empty(html_column).alias("html"))
    found = written(slim.mapInArrow(_counts, _STATS), "features")
    distinct = found.where("name IS NULL").groupBy("host", "page").agg(F.first("features").alias("features")).select("host", F.explode("features").alias("f"))
    counted = written(distinct.groupBy("host", "f.path", "f.kind", "f.feature").agg(F.count("*").alias("n")), "styles")
    names = found.where("name IS NOT NULL").groupBy("host", "path").agg(F.first("name").alias("style"), F.max("hinted").alias("hinted"))
    log = lambda c: F.log(F.col(c).cast("double"))
    named = counted.where("kind = 2").select("host", "path", F.col("n").alias("pages")).join(names, ["host", "path"])
    with_text = counted.where("kind = 3").select("host", "path", F.col("n").alias("text_pages"))
    # contents by how often they occur: few rows per path, however many contents it has
    alike = counted.where("kind = 0").groupBy("host", "path", "n").agg(F.count("*").alias("c"))
    beyond = F.greatest(F.lit(0.0), log("text_pages") - F.log(F.lit(float(REFERENCE_PAGES))))
    scaled = F.sum(F.col("c") * F.greatest(F.lit(0.0), log("n") - beyond)) / F.sum("c")
    sums = alike.join(with_text, ["host", "path"]).groupBy("host", "path", "text_pages")
    sums = sums.agg(F.sum(F.col("c") * F.col("n")).alias("m"), (F.sum(F.col("c") * log("n")) / F.sum("c")).alias("plain"), scaled.alias("scaled"))
    importance = F.when(F.col("m") > 1, 1 - F.col("plain") / log("m")).otherwise(1.0)
    text = F.when(F.col("text_pages") > 1, 1 - F.col("scaled") / F.log(F.least(F.col("text_pages"), F.lit(REFERENCE_PAGES)).cast("double"))).otherwise(1.0)
    leaves = sums.join(named, ["host", "path"]).select("host", "style", "m", "text_pages", importance.alias("importance"), text.alias("text"))
    per_path = counted.where("kind = 1").groupBy("host", "path").agg(F.sum("n").alias("m"), F.count("*").alias("l"), F.sum(F.col("n") * log("n")).alias("s2"))
    shapes = per_path.select("host", "path", "l", F.when(F.col("m") > 1, (log("m") - F.col("s2") / F.col("m")) / log("m")).otherwise(1.0).alias("variety"))
    mean = lambda c: (F.sum(F.col("m") * F.col(c)) / F.sum("m"))
    below = leaves.withColumn("style", _upwards("style")).groupBy("host", "style").agg(mean("importance").alias("mean"), mean("text").alias("mean_text"))
    share = F.pow(F.lit(GAMMA), F.col("l"))
    weighed = lambda c: F.when(F.col("l").isNull(), F.col(c)).otherwise((1 - share) * F.col("variety") + share * F.col(c))
    styles = named.join(shapes, ["host", "path"], "left").join(below, ["host", "style"]).select("host", "style", "pages", "hinted", weighed("mean").alias("importance"), weighed("mean_text").alias("own"))
    judged = styles.select("host", "style", "own").unionByName(leaves.select("host", "style", F.col("text").alias("own")))
    highest = judged.withColumn("style", _upwards("style")).groupBy("host", "style").agg(F.max("own").alias("highest"))
    return styles.drop("own").join(highest, ["host", "style"]).join(leaves.select("host", "style", "text_pages", "text"), ["host", "style"], "left")


def _upwards(style: str):
    """A row for a style and each above it."""
    parts = F.split(style, ">")
    return F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), ">")))


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Per page: the id, the url, text, n_chars (code points)."""
    spark = pages.sparkSession
    tree = style_tree(pages, url_column, html_column)
    branch, text = (F.col("highest") < THRESHOLD) & (F.col("pages") >= MIN_PAGES), (F.col("text") < THRESHOLD) & (F.col("text_pages") >= MIN_PAGES)
    stays = F.col("hinted") & (F.col("highest") >= THRESHOLD) & (F.col("pages") >= MIN_PAGES)
    verdicts = F.array_compact(F.array(F.when(branch, F.col("style")).when(text, F.concat("style", F.lit(">"))), F.when(stays, F.concat(F.lit("+"), "style"))))
    judged = written(tree.select("host", F.explode(verdicts).alias("style")), "judged")
    small_batches(spark)
    slim = pages.select(pages[id_column], pages[url_column], text_or_empty(html_column).alias("html"))
    kinds = [slim.schema[c].dataType.simpleString() for c in (id_column, url_column)]
    schema = f"`{id_column}` {kinds[0]}, `{url_column}` {kinds[1]}, text string, n_chars long"

    def run(batches, styles_of):
        for batch in batches:
            texts = [main_text(page, styles) for page, styles in zip(batch.column(2).to_pylist(), styles_of(batch), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_column, url_column, "text", "n_chars"])

    if len(rows := judged.take(BROADCAST_ROWS + 1)) <= BROADCAST_ROWS:
        by_host: dict[int, set[str]] = {}
        for host, style in rows:
            by_host.setdefault(host, set()).add(style)
        shared = spark.sparkContext.broadcast({h: frozenset(s) for h, s in by_host.items()})  # at most BROADCAST_ROWS styles

        def looked_up(batch):
            none = frozenset()
            return [shared.value.get(_hash(host_of(u)), none) if shared.value else none for u in batch.column(1).to_pylist()]

        return slim.mapInArrow(lambda batches: run(batches, looked_up), schema)

    def hosts(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_hash(host_of(u)) for u in batch.column(1).to_pylist()], pa.int64())], [id_column, url_column, "html", "host"])

    salted = slim.mapInArrow(hosts, f"`{id_column}` {kinds[0]}, `{url_column}` {kinds[1]}, html string, host long").withColumn("salt", F.pmod(F.xxhash64(id_column, "html"), F.lit(SALTS)).cast("int"))
    styles = judged.groupBy("host").agg(F.collect_set("style").alias("styles")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = salted.join(styles, ["host", "salt"], "left").select(id_column, url_column, "html", "styles")
    return joined.mapInArrow(lambda batches: run(batches, lambda batch: [frozenset(s or ()) for s in batch.column(3).to_pylist()]), schema)
