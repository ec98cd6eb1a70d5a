"""Elements of pages by selectors. Pages are parsed once, in Python, an Arrow batch at a time, and what the asked-for selectors find
becomes columns; all rules over them are expressions.

Selectors are lists, divided by commas, of compounds that stand within each other: tag or *, .class, #id, [attribute],
[attribute=value], [attribute*=value], :contains('text'), :not([attribute]). Null html counts as empty. Repeated pages are parsed
each on its own; a very long page is held by itself."""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.operators.tokens import DATA, START, tokens

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: So many spellings of tags and attributes are remembered for a plan, and so many rows or characters leave a task at once.
REMEMBERED, ROWS, CHARACTERS = 20_000, 512, 1 << 22
#: An open element of these ends where the next of its kind begins.
FOLLOWED = frozenset("p li dt dd tr td th option".split())

_PART = re.compile(r"(?P<not>:not\()?(?:\.(?P<class>[\w-]+)|#(?P<id>[\w-]+)|\[(?P<name>[\w:-]+)(?:(?P<how>\*?=)(?P<value>'[^']*'|\"[^\"]*\"|[^\]]*))?\]|:contains\('(?P<text>[^']*)'\))\)?")


class _Element:
    __slots__ = ("attrs", "end", "key", "parent", "place", "said", "start", "stop", "tag")

    def __init__(self, said: list[str], tag: str, attrs: dict[str, str], key, parent: _Element | None, place: int, start: int) -> None:
        # elements have the page's text, not the page, so that a page is freed as soon as it is done with, without a search for cycles
        self.said, self.tag, self.attrs, self.key, self.parent, self.place = said, tag, attrs, key, parent, place
        self.start = start

    def text(self) -> str:
        return self.said[0][self.start : self.stop]

    def says(self, value: str) -> bool:
        return self.said[0].find(value, self.start, self.stop) >= 0


class Page:
    """The elements of a page in their order, each a stretch of the page's text."""

    __slots__ = ("__weakref__", "all", "root", "text")

    def __init__(self, html: str) -> None:
        said: list[str] = []
        root = _Element(said, "", {}, None, None, 0, 0)
        every, opened, last, place, length = [root], [root], root, 1, 0
        for token in tokens(html):
            kind, tag = token[0], token[1]
            if kind == DATA:
                said.append(tag)
                length += len(tag)
            elif kind == START:
                if tag in FOLLOWED and last.tag == tag:
                    last.end, last.stop = place, length
                    opened.pop()
                    last = opened[-1]
                new = _Element(said, tag, token[2], token[3], last, place, length)
                every.append(new)
                place += 1
                if tag in VOID:
                    new.end, new.stop = place, length
                else:
                    opened.append(new)
                    last = new
            elif last.tag == tag:
                last.end, last.stop = place, length
                opened.pop()
                last = opened[-1]
            else:
                for k in range(len(opened) - 1, 0, -1):
                    if opened[k].tag == tag:
                        for e in opened[k:]:
                            e.end, e.stop = place, length
                        del opened[k:]
                        last = opened[-1]
                        break
        for e in opened:
            e.end, e.stop = place, length
        self.root, self.all, self.text = root, every, "".join(said)
        said[:] = [self.text]

    def find(self, selector: str, within: _Element | None = None) -> list[_Element]:
        """All elements within another that the selector names, in their order."""
        return among(Plan.of((selector,)).hits(self).get(selector, []), within or self.root)


def among(found: list[_Element], within: _Element) -> list[_Element]:
    """Those elements that stand within another, of some in their order."""
    if within.parent is None or not found:
        return found
    return found[bisect_left(found, within.place + 1, key=lambda e: e.place) : bisect_left(found, within.end, key=lambda e: e.place)]


class Plan:
    """Many selectors at once. What an element's tag and attributes say about all of them is found out once for each spelling of a tag
    and its attributes; what stands around it and what it says is looked at in each element."""

    _plans: dict[tuple[str, ...], Plan] = {}

    @classmethod
    def of(cls, selectors: tuple[str, ...]) -> Plan:
        if selectors not in cls._plans:
            cls._plans[selectors] = cls(selectors)
        return cls._plans[selectors]

    def __init__(self, selectors: tuple[str, ...]) -> None:
        #: Paths by what their last compound needs: a class, an attribute, a tag, or nothing of these.
        self.by: dict[tuple[str, str] | None, list] = {}
        self.known: dict = {}
        for selector in selectors:
            for path in compiled(selector):
                tag, parts = path[-1]
                needs = [("class", v) if k == "class" else ("name", v[0] if k in ("is", "holds") else "id" if k == "id" else v) for k, v in parts if k in ("class", "id", "has", "is", "holds")]
                key = min(needs, default=("tag", tag) if tag != "*" else None)
                words = [v for k, v in parts if k == "says"]
                self.by.setdefault(key, []).append((selector, (tag, [p for p in parts if p[0] != "says"]), words, path if len(path) > 1 else None))

    def _candidates(self, e: _Element) -> list:
        keys = [None, ("tag", e.tag), *[("name", a) for a in e.attrs], *[("class", c) for c in dict.fromkeys(e.attrs.get("class", "").split())]]
        found = [(selector, words, path) for key in keys for selector, compound, words, path in self.by.get(key, ()) if _fits(e, compound)]
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[e.key] = found
        return found

    def hits(self, page: Page) -> dict[str, list[_Element]]:
        """By selector the elements that it names, in their order; without those that name none."""
        hits: dict[str, list[_Element]] = {}
        known, said = self.known, {}
        for e in page.all[1:]:
            found = known.get(e.key)
            if found is None:
                found = self._candidates(e)
            for selector, words, path in found:
                if words:
                    for w in words:
                        if w not in said:
                            said[w] = w in page.text
                    if not all(said[w] and e.says(w) for w in words):
                        continue
                if path is not None and not _around(e, path):
                    continue
                have = hits.get(selector)
                if have is None:
                    hits[selector] = [e]
                elif have[-1] is not e:
                    have.append(e)
        return hits


def _fits(e: _Element, compound) -> bool:
    tag, parts = compound
    if tag not in ("*", e.tag):
        return False
    for kind, value in parts:
        if kind == "class":
            good = value in e.attrs.get("class", "").split()
        elif kind == "id":
            good = e.attrs.get("id") == value
        elif kind == "has":
            good = value in e.attrs
        elif kind == "lacks":
            good = value not in e.attrs
        elif kind == "is":
            good = e.attrs.get(value[0]) == value[1]
        elif kind == "holds":
            good = value[1] in e.attrs.get(value[0], "")
        else:
            good = e.says(value)
        if not good:
            return False
    return True


def _around(e: _Element, path) -> bool:
    """Whether an element stands within what its path names before it."""
    left, e = len(path) - 2, e.parent
    while left >= 0 and e is not None:
        if _fits(e, path[left]):
            left -= 1
        e = e.parent
    return left < 0


_COMPILED: dict[str, list] = {}


def compiled(selector: str) -> list:
    """Paths of (tag, parts) for each of a selector's alternatives."""
    if selector not in _COMPILED:
        paths = []
        for one in re.split(r",(?![^\[(]*[\])])", selector):
            path = []
            for word in re.findall(r"(?:\[[^\]]*\]|\([^)]*\)|[^\s\[(])+", one.strip()):
                tag = re.match(r"[a-zA-Z][\w]*|\*", word)
                parts = []
                for m in _PART.finditer(word, tag.end() if tag else 0):
                    value = (m["value"] or "").strip("'\"")
                    if m["class"]:
                        parts.append(("class", m["class"]))
                    elif m["id"]:
                        parts.append(("id", m["id"]))
                    elif m["name"]:
                        parts.append(("lacks" if m["not"] else "has", m["name"]) if not m["how"] else ("is" if m["how"] == "=" else "holds", (m["name"], value)))
                    else:
                        parts.append(("says", m["text"]))
                path.append((tag[0].lower() if tag else "*", parts))
            paths.append(path)
        _COMPILED[selector] = paths
    return _COMPILED[selector]


def pieces(batches):
    """(a few hundred rows of a batch, their columns as lists): what a task makes of pages leaves it before it takes the next."""
    for batch in batches:
        for begin in range(0, batch.num_rows, ROWS):
            piece = batch.slice(begin, ROWS)
            yield piece, [piece.column(k).to_pylist() for k in range(3)]


def _maps(rows: list[list[tuple]], values: pa.DataType) -> pa.MapArray:
    """Maps from texts, by their entries."""
    offsets = [0]
    for entries in rows:
        offsets.append(offsets[-1] + len(entries))
    flat = [pair for entries in rows for pair in entries]
    keys = pa.array([k for k, _ in flat], pa.string())
    if pa.types.is_list(values):
        ends = [0]
        for _, v in flat:
            ends.append(ends[-1] + len(v))
        items = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([x for _, v in flat for x in v], values.value_type))
    else:
        items = pa.array([v for _, v in flat], values)
    return pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), keys, items)


def gathered(pages: DataFrame, texts: tuple[str, ...] = (), lists: tuple[str, ...] = (), attributes: tuple[tuple[str, str], ...] = (), cards: str | None = None, keep: tuple[str, ...] = (), own: tuple[str, ...] = (), bounds: dict[str, int] | None = None, kinds: tuple[str, ...] = (), outer: bool = False, every: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """pages: page_id, url, html, and columns to keep. Per page: page_id, url, card, text, and maps: found (texts: what all elements of
    a selector say, joined and trimmed, where they say something), counts (texts: how many elements), listed (lists: what each element
    says, trimmed), given (attributes: selector@attribute, what each element has there; every: the
    same, empty where an element lacks it), all without selectors that find nothing. With
    cards, a row for each element of that selector, numbered from 0, all is looked for within it, and given has its own attributes too
    (own: @attribute), and counts has 1 for those selectors that name the element itself (kinds); a page without such elements gives a row
    without anything if asked (outer). bounds: selectors whose texts are of no use to the reader from so many
    bytes on; found leaves those out."""
    wanted = tuple(dict.fromkeys((*texts, *lists, *[s for s, _ in (*attributes, *every)], *kinds, *([cards] if cards else []))))
    bounds = bounds or {}

    def run(batches):
        plan = Plan.of(wanted)
        text_lists = pa.list_(pa.string())

        def record(piece, out, taken):
            columns = [
                pa.array(out[0], piece.schema.field(0).type), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.string()),
                _maps(out[4], pa.string()), _maps(out[5], pa.int32()), _maps(out[6], text_lists), _maps(out[7], text_lists),
            ]
            rows = pa.array(taken, pa.int64())
            return pa.RecordBatch.from_arrays([*columns, *[piece.column(3 + k).take(rows) for k in range(len(keep))]], [*NAMES, *keep])

        for piece, columns in pieces(batches):
            out, taken, held = [[] for _ in NAMES], [], 0
            for at, (page_id, url, html) in enumerate(zip(*columns, strict=True)):
                page = Page(html or "")
                hits = plan.hits(page)
                named = [(s, set(hits.get(s, ()))) for s in kinds]
                if outer and cards not in hits:
                    for column, value in zip(out, (page_id, url, None, "", [], [], [], []), strict=True):
                        column.append(value)
                    taken.append(at)
                for card, within in enumerate(hits.get(cards, ()) if cards else (page.root,)):
                    inner = {s: some for s, found in hits.items() if (some := among(found, within))} if cards else hits
                    found, counts = [], [(s, 1) for s, some in named if within in some]
                    for s in texts:
                        if s in inner:
                            counts.append((s, len(inner[s])))
                            said = "".join([e.text() for e in inner[s]]).strip()
                            # a character takes a byte at least, so most texts need not be coded to be measured
                            if said and not (s in bounds and (len(said) >= bounds[s] or len(said.encode("utf-8", "surrogatepass")) >= bounds[s])):
                                found.append((s, said))
                    row = (
                        page_id, url, card if cards else None, within.text(), found, counts,
                        [(s, [e.text().strip() for e in inner[s]]) for s in lists if s in inner],
                        [(f"@{a}", [within.attrs[a]]) for a in own if a in within.attrs]
                        + [(f"{s}@{a}", some) for s, a in attributes if s in inner and (some := [e.attrs[a] for e in inner[s] if a in e.attrs])]
                        + [(f"{s}@{a}", [e.attrs.get(a, "") for e in inner[s]]) for s, a in every if s in inner],
                    )
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    taken.append(at)
                    held += within.stop - within.start
                    if held > CHARACTERS:
                        yield record(piece, out, taken)
                        out, taken, held = [[] for _ in NAMES], [], 0
            if taken:
                yield record(piece, out, taken)

    kind = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, card int, text string, found map<string,string>, counts map<string,int>, listed map<string,array<string>>, given map<string,array<string>>"
    kept = "".join(f", `{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.select("page_id", "url", "html", *keep).mapInArrow(run, schema + kept)


def needs(*some: tuple[tuple, tuple, tuple]) -> tuple[tuple, tuple, tuple]:
    """What several readers need of a page, each thing once, so that it is parsed once for all of them."""
    return tuple(tuple(dict.fromkeys(x for part in some for x in part[k])) for k in range(3))


def elements(pages: DataFrame, selector: str, attributes: tuple[str, ...]) -> DataFrame:
    """page_id, card, url, text and the attributes of each element of a selector, empty where it lacks one."""
    names = ["page_id", "card", "url", "text", *attributes]

    def run(batches):
        for piece, columns in pieces(batches):
            out: list[list] = [[] for _ in names]
            for page_id, url, html in zip(*columns, strict=True):
                for card, e in enumerate(Page(html or "").find(selector)):
                    for column, value in zip(out, (page_id, card, url, e.text(), *[e.attrs.get(a, "") for a in attributes]), strict=True):
                        column.append(value)
            kinds = [piece.schema.field(0).type, pa.int32(), *[pa.string()] * (len(names) - 2)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, card int, url string, text string, " + ", ".join(f"`{a}` string" for a in attributes))


NAMES = ["page_id", "url", "card", "text", "found", "counts", "listed", "given"]


def said(selector: str) -> Column:
    """What the elements of a selector say, null if nothing."""
    return F.try_element_at("found", F.lit(selector))


def listed(selector: str) -> Column:
    """What each element of a selector says."""
    return F.coalesce(F.try_element_at("listed", F.lit(selector)), F.array().cast("array<string>"))


def given(selector: str, attribute: str) -> Column:
    """What each element of a selector has as an attribute, of those that have it."""
    return F.coalesce(F.try_element_at("given", F.lit(f"{selector}@{attribute}")), F.array().cast("array<string>"))


def number(selector: str) -> Column:
    return F.coalesce(F.try_element_at("counts", F.lit(selector)), F.lit(0))


def any_of(selectors: tuple[str, ...]) -> Column:
    """Whether any selector has elements."""
    return F.exists(F.array(*[F.lit(s) for s in selectors]), lambda s: F.try_element_at("counts", s).isNotNull())


def with_elements(selectors: tuple[str, ...]) -> Column:
    """The selectors that have elements, in the order given."""
    return F.filter(F.array(*[F.lit(s) for s in selectors]), lambda s: F.try_element_at("counts", s).isNotNull())


def valid(selectors: Column, good) -> Column:
    """Of an array of selectors those whose text is good, with it: (selector, text), in the order given."""
    pairs = F.transform(selectors, lambda s: F.struct(s.alias("selector"), F.try_element_at("found", s).alias("text")))
    return F.filter(pairs, lambda p: p["text"].isNotNull() & good(p["text"]))


def first(selectors: tuple[str, ...], good) -> Column:
    """The text of the first selector whose text is good, null if none is."""
    return F.get(valid(F.array(*[F.lit(s) for s in selectors]), good), F.lit(0))["text"]
