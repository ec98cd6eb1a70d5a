"""Tags and texts of a page as html.parser finds them. A page is cut at its brackets, and what a tag's spelling says is remembered, as
most tags are spelled alike on many pages. What cannot be cut so (scripts, styles, brackets in quotes or comments) is read by one pattern,
tag by tag, and what the pattern does not take (stray brackets, tags cut short, odd attributes, marked sections) is left to html.parser,
for the whole page."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

#: What may stand behind a tag's name: attributes that are divided by blanks, quoted or bare.
_ATTRIBUTES = r"(?:[ \t\n\r\f]+[a-zA-Z_][a-zA-Z0-9_:.-]*(?:=(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>=`]+))?)*"
_TOKEN = re.compile(
    rf"([^<]+)|<([a-zA-Z][a-zA-Z0-9]*)({_ATTRIBUTES})[ \t\n\r\f]*(/?)>|</([a-zA-Z][a-zA-Z0-9]*)[ \t\n\r\f]*>|<!--(?!-?>)(?:(?!--)[\s\S])*-->|<![dD][oO][cC][tT][yY][pP][eE][^<>]*>"
)
#: The same between two brackets: a tag, the end of one, a comment or a document type.
_SPELLED = re.compile(rf"([a-zA-Z][a-zA-Z0-9]*)({_ATTRIBUTES})[ \t\n\r\f]*(/?)|/([a-zA-Z][a-zA-Z0-9]*)[ \t\n\r\f]*|!--(?!-?\Z)(?:(?!--)[\s\S])*--|![dD][oO][cC][tT][yY][pP][eE][^<>]*")
_ATTRIBUTE = re.compile(r"([a-zA-Z_][a-zA-Z0-9_:.-]*)(?:=(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>=`]+)))?")
#: Text that is no markup, up to the end of its element.
_RAW = {tag: re.compile(rf"</\s*{tag}(>?)", re.IGNORECASE) for tag in ("script", "style")}
#: So many spellings of tags and of attributes, each of so many characters at most, are remembered by a worker.
REMEMBERED, LONGEST = 20_000, 500

START, END, DATA = 0, 1, 2
_known: dict[str, dict[str, str]] = {"": {}}
_tags: dict[str, tuple[tuple, ...]] = {}


class _Parser(HTMLParser):
    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple] = []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        given = {k: v or "" for k, v in attrs}
        self.found.append((START, tag, given, (tag, tuple(given.items()))))

    def handle_endtag(self, tag):
        self.found.append((END, tag))

    def handle_data(self, data):
        self.found.append((DATA, data))


def parsed(html: str) -> list[tuple]:
    """The same by html.parser alone."""
    return _Parser(html).found


def _attributes(raw: str) -> dict[str, str]:
    given = _known.get(raw)
    if given is None:
        values = ((name, double or single or bare) for name, double, single, bare in _ATTRIBUTE.findall(raw))
        given = {name.lower(): unescape(v) if "&" in v else v for name, v in values}
        if len(raw) <= LONGEST:
            if len(_known) >= REMEMBERED:
                _known.clear()
                _known[""] = {}
            _known[raw] = given
    return given


def _spelled(between: str) -> tuple[tuple, ...] | None:
    """The tokens of what stands between two brackets, null where more than that must be looked at."""
    m = _SPELLED.fullmatch(between)
    if m is None:
        return None
    tag, raw, closed, end = m.groups()
    if tag is not None:
        tag = tag.lower()
        if tag in _RAW and not closed:
            return None
        start = (START, tag, _attributes(raw), (tag, raw))
        found = (start, (END, tag)) if closed else (start,)
    else:
        found = ((END, end.lower()),) if end is not None else ()
    if len(between) <= LONGEST:
        if len(_tags) >= REMEMBERED:
            _tags.clear()
        _tags[between] = found
    return found


def tokens(html: str) -> list[tuple]:
    """(START, tag, attributes, a key that is equal only for equal tags and attributes), (END, tag) and (DATA, text), in order. Attributes are
    shared between elements: not to be changed."""
    text, *tags = html.split("<")
    found: list[tuple] = [(DATA, unescape(text) if "&" in text else text)] if text else []
    known, add = _tags.get, found.append
    for piece in tags:
        between, bracket, text = piece.partition(">")
        some = known(between)
        if some is None:
            some = _spelled(between)
        if some is None or not bracket:
            return matched(html)
        found += some
        if text:
            add((DATA, unescape(text) if "&" in text else text))
    return found


def matched(html: str) -> list[tuple]:
    """The same by the pattern alone."""
    found: list[tuple] = []
    place, n, match = 0, len(html), _TOKEN.match
    while place < n:
        m = match(html, place)
        if m is None:
            return parsed(html)
        text, tag, raw, closed, end = m.groups()
        place = m.end()
        if text is not None:
            found.append((DATA, unescape(text) if "&" in text else text))
        elif tag is not None:
            tag = tag.lower()
            found.append((START, tag, _attributes(raw), (tag, raw)))
            if closed:
                found.append((END, tag))
            elif tag in _RAW:
                m = _RAW[tag].search(html, place)
                if m is None or not m[1]:
                    return parsed(html)
                if m.start() > place:
                    found.append((DATA, html[place : m.start()]))
                found.append((END, tag))
                place = m.end()
        elif end is not None:
            found.append((END, end.lower()))
    return found
