"""A small reader of HTML: from text to a tree of elements, as browsers close what is left open.

Only what extraction needs: elements with their class, id and role, texts with character references
decoded, the content of scripts and styles dropped, comments and declarations dropped.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
# elements whose content is no markup
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes", "template"))
# what the start of one element closes, up to the nearest of the second group
_CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "option": (("option",), ("select",)),
    "optgroup": (("option", "optgroup"), ("select",)),
}
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup html hr legend li main menu nav ol p pre "
    "section summary table tbody td tfoot th thead tr ul caption".split()
)
_OWN = frozenset("p h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"'=]++|=\s*+\"[^\"]*+\"?|=\s*+'[^']*+'?|[\"'=])*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?:^|[\s/])(class|id|role|aria-hidden|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?(?=[\s/>]|$)", re.I)


class Element:
    __slots__ = ("name", "marks", "children", "parent")

    def __init__(self, name: str, marks: dict[str, str], parent: Element | None):
        self.name = name
        self.marks = marks
        self.children: list[Element | str] = []
        self.parent = parent


def parse(source: str) -> Element:
    """The tree of a page; its root has no name."""
    root = Element("", {}, None)
    at, here = 0, root
    for m in _tokens(source):
        if m.start() > at:
            here.children.append(_text(source[at : m.start()]))
        at = m.end()
        if m[1]:
            here = _close(here, m[1].lower())
        elif m[2]:
            name = m[2].lower()
            here = _open(here, name, m[3] or "")
            if name in RAW:
                # its text is dropped; without an end it takes the rest of the page
                here, at = here.parent, m.raw_end
    if at < len(source):
        here.children.append(_text(source[at:]))
    return root


def _text(raw: str) -> str:
    return html.unescape(raw) if "&" in raw else raw


class _Match:
    """A token, and for an element without markup inside where that element ends."""

    __slots__ = ("m", "raw_end")

    def __init__(self, m: re.Match, raw_end: int):
        self.m, self.raw_end = m, raw_end

    def __getitem__(self, i: int):
        return self.m[i]

    def start(self) -> int:
        return self.m.start()

    def end(self) -> int:
        return self.m.end()


def _tokens(source: str) -> Iterator[_Match]:
    at = 0
    while m := _TOKEN.search(source, at):
        raw_end = at = m.end()
        if m[2] and m[2].lower() in RAW and not m[0].endswith("/>"):
            end = re.compile(rf"</{re.escape(m[2])}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
            raw_end = at = end.end() if end else len(source)
        yield _Match(m, raw_end)


def _up(here: Element, names: tuple[str, ...], stop: tuple[str, ...]) -> Element | None:
    """The outermost open element of `names` below the nearest of `stop`."""
    found = None
    while here.parent is not None and here.name not in stop:
        if here.name in names:
            found = here
        here = here.parent
    return found


def _open(here: Element, name: str, inside: str) -> Element:
    if name in BLOCKS:
        # a block ends an open paragraph
        paragraph = _up(here, ("p",), ("td", "th", "button", "body", "div", "article", "section", "li"))
        if paragraph is not None:
            here = paragraph.parent
    if name in _CLOSES:
        open_ = _up(here, *_CLOSES[name])
        if open_ is not None:
            here = open_.parent
    marks = {}
    if inside:
        for k, a, b, c in _ATTRIBUTE.findall(inside):
            marks.setdefault(k.lower(), html.unescape(a or b or c))
    element = Element(name, marks, here)
    here.children.append(element)
    return here if name in VOID else element


def _close(here: Element, name: str) -> Element:
    at = here
    while at.parent is not None and at.name != name:
        # the end of a part does not reach out of the table cell or block it stands in
        if name not in BLOCKS and at.name in BLOCKS:
            return here
        at = at.parent
    return at.parent if at.parent is not None else here
