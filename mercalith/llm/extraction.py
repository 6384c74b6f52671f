"""Main text of web pages: what recurs across a host goes, then what markup declares to be surroundings.

Pages are read twice.  The first reading hashes every element's subtree bottom up, in two ways: exactly
(names, class marks and texts) and by shape (names and class marks, where like neighbours count once, so
that menus of any length are alike).  For each host it is counted on how many different pages each
subtree stands and how long its text is there at least and at most; a page counts a subtree once, exact
copies of a page count as one page, and both steps combine within a task before they shuffle, so a host
with a third of all pages is no hot spot.

Exact subtrees on at least RECURS_ON pages and RECURS_SHARE of a host's pages are its template.  So are
shapes on SHAPE_SHARE of its pages, whatever words they hold, if they can be told from prose: they hold no
prose element, are marked by a class or made of several elements, and their text is short on every page or
of much the same length.  The second reading deletes both, then what markup alone declares to be
surroundings, which is all there is to go by on hosts with few pages.

Inside an article's own element, prose (headings, paragraphs, quotations, code, tables and lists)
is never taken for template however often it recurs: a sentence that many articles share is still
theirs.  Pages that have no such element are judged by recurrence throughout; one of which shapes would
leave nothing keeps what exact recurrence leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercalith.llm.common import stored
from mercalith.llm.markup import BLOCKS, RAW, Element, parse

RECURS_ON = 5
RECURS_SHARE = 0.1
SHAPE_SHARE = 0.8
SHORT_TEXT = 300  # characters; longer texts of one shape have to be of much the same length

_DROP = RAW | frozenset(
    ("head", "nav", "footer", "aside", "form", "button", "select", "input", "option", "label", "dialog", "menu", "object", "audio", "video", "canvas")
)
_MAIN = frozenset(("article", "main"))
_PROSE = frozenset(
    ("h1", "h2", "h3", "h4", "h5", "h6", "p", "blockquote", "pre", "table", "tbody", "thead", "tr", "td", "th", "dl", "dt", "dd", "figure", "figcaption", "code")
)
_ROLES = frozenset(
    ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar")
)
# names in class (and, outside an article, id) that mark surroundings, each compared as a whole (fixed
# values of this operator)
_SURROUNDINGS = frozenset(
    (
        "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "breadcrumb", "breadcrumbs",
        "byline-share", "comment", "comments", "commentlist", "comment-list", "consent", "cookie", "cookies", "cookie-banner",
        "cookie-notice", "copyright", "disqus", "dropdown", "footer", "gdpr", "header", "header-nav", "login", "main-nav",
        "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "overlay",
        "page-footer", "page-header", "pager", "pagination", "popup", "promo", "promoted", "promotion", "reader-comments",
        "recommended", "related", "related-links", "related-posts", "replies", "respond", "share", "share-buttons", "sharing",
        "shares", "sidebar", "side-bar", "signup", "site-footer", "site-header", "site-nav", "sitemap", "skip", "skip-link",
        "social", "social-links", "sponsor", "sponsored", "subscribe", "subscription", "tags", "teaser", "toolbar", "topbar",
        "top-bar", "user-comments", "widget", "widgets",
    )
)


def _surrounding(e: Element, in_main: bool) -> bool:
    if e.name in _DROP or (e.name == "header" and not in_main):
        return True
    if not e.marks:
        return False
    if "hidden" in e.marks or e.marks.get("aria-hidden") == "true" or e.marks.get("role") in _ROLES:
        return True
    classes = set(e.marks.get("class", "").lower().split())
    if e.name in _MAIN or e.name in ("body", "html"):
        # an article that is marked as a comment is one
        return e.name == "article" and "comment" in classes
    if in_main:
        # an article's own headings, paragraphs and other prose may be called anything
        return e.name not in _PROSE and e.name != "header" and not _SURROUNDINGS.isdisjoint(classes)
    return not _SURROUNDINGS.isdisjoint(classes | set(e.marks.get("id", "").lower().split()))


@dataclass
class Subtree:
    """What is counted of one element's subtree."""

    exact: int
    shape: int
    chars: int
    elements: int  # of its shape
    marked: bool
    prose: bool


def subtrees(root: Element) -> dict[int, Subtree]:
    """The subtree of every element, by the element's identity."""
    out: dict[int, Subtree] = {}
    number = lambda h: int.from_bytes(h.digest(), "little", signed=True)
    stack: list[tuple[Element, bool]] = [(root, False)]
    while stack:  # children before parents, without recursion: pages may be nested deeply
        e, ready = stack.pop()
        if not ready:
            stack.append((e, True))
            stack += [(c, False) for c in e.children if not isinstance(c, str)]
            continue
        name = f"<{e.name} {e.marks.get('class', '')}>".encode()
        exact, shape = hashlib.blake2b(name, digest_size=8), hashlib.blake2b(name, digest_size=8)
        chars, elements, marked, prose = 0, 1, bool(e.marks.get("class")), e.name in _PROSE
        before = None
        for c in e.children:
            if isinstance(c, str):
                text = " ".join(c.split())
                if text:
                    exact.update(text.encode("utf-8", "surrogatepass"))
                    chars += len(text)
                continue
            s = out[id(c)]
            exact.update(s.exact.to_bytes(8, "little", signed=True))
            chars += s.chars
            marked, prose = marked or s.marked, prose or s.prose
            if s.shape != before:
                shape.update(s.shape.to_bytes(8, "little", signed=True))
                elements += s.elements
                before = s.shape
        out[id(e)] = Subtree(number(exact), number(shape), chars, elements, marked, prose)
    return out


def _has_main(root: Element) -> bool:
    stack = [root]
    while stack:
        e = stack.pop()
        if e.name in _MAIN and not _surrounding(e, False):
            return True
        if e.name in _MAIN or not _surrounding(e, False):
            stack += [c for c in e.children if not isinstance(c, str)]
    return False


def _may_recur(e: Element, inside: bool) -> bool:
    """Whether recurrence may delete an element; in an article only blocks without prose."""
    if e.parent is None or e.name in ("html", "body", *_MAIN):
        return False
    return not inside or (e.name in BLOCKS and e.name not in _PROSE and not _holds_prose(e))


def _candidates(root: Element, found: dict[int, Subtree]) -> dict[tuple[bool, int], int]:
    """(by shape, hash) -> characters on this page, of all subtrees that recurrence may delete."""
    out: dict[tuple[bool, int], int] = {}
    stack = [(root, False)]
    while stack:
        e, inside = stack.pop()
        inside_now = inside or e.name in _MAIN
        if _may_recur(e, inside_now):
            s = found[id(e)]
            out[False, s.exact] = s.chars
            if not s.prose and (s.marked or s.elements > 2):
                out[True, s.shape] = max(out.get((True, s.shape), 0), s.chars)
        if not (inside_now and e.name in _PROSE):  # prose of an article stays as it is
            stack += [(c, inside_now) for c in e.children if not isinstance(c, str)]
    return out


def _holds_prose(e: Element) -> bool:
    stack = [c for c in e.children if not isinstance(c, str)]
    while stack:
        c = stack.pop()
        if c.name in _PROSE or c.name == "li":
            return True
        stack += [x for x in c.children if not isinstance(x, str)]
    return False


def main_text(source: str, template: set[int] = frozenset(), shapes: set[int] = frozenset()) -> str:
    """The text of a page's article without its host's template (exact subtrees and shapes) and without surroundings."""
    root = parse(source)
    found = subtrees(root) if template or shapes else {}
    focused = _has_main(root)
    text = _text_of(root, found, template, shapes, focused)
    return text if text or not shapes else _text_of(root, found, template, frozenset(), focused)


def _text_of(root: Element, found: dict[int, Subtree], template: set[int], shapes: set[int], focused: bool) -> str:
    blocks: list[str] = []
    run: list[str] = []

    def end_block() -> None:
        text = " ".join("".join(run).split())
        if text:
            blocks.append(text)
        run.clear()

    def recurs(e: Element, inside: bool) -> bool:
        s = found.get(id(e))
        if s is None or not _may_recur(e, inside):
            return False
        return s.exact in template or (not s.prose and s.shape in shapes)

    # (element or text, inside an article); None is the end of a block
    stack: list[tuple[Element | str | None, bool]] = [(root, False)]
    while stack:
        e, inside = stack.pop()
        if e is None:
            end_block()
        elif isinstance(e, str):
            if inside or not focused:
                run.append(e)
        elif e.name == "br":
            run.append(" ")
        else:
            block = e.name in BLOCKS
            inside_now = inside or e.name in _MAIN
            if e.parent is not None and (recurs(e, inside_now) or _surrounding(e, inside)):
                if block:
                    end_block()
                continue
            if block:
                end_block()
                stack.append((None, inside))
            stack += [(c, inside_now) for c in reversed(e.children)]
    end_block()
    return " ".join(blocks)


def host(url: Column) -> Column:
    """The host of a URL, lower case, without port; the empty string if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def templates(pages: DataFrame, least_pages: int = RECURS_ON, share: float = RECURS_SHARE, shape_share: float = SHAPE_SHARE) -> DataFrame:
    """(host, by_shape, subtree): the recurring subtrees of each host, from (host, html)."""

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for name, page, copy in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "copy"))):
                root = parse(page or "")
                found = _candidates(root, subtrees(root))
                rows += [(name, by_shape, h, copy, chars) for (by_shape, h), chars in found.items()]
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(columns, kinds)], names=["host", "by_shape", "subtree", "copy", "chars"]
            )

    key = ["host", "by_shape", "subtree"]
    found = pages.withColumn("copy", F.xxhash64("html")).mapInArrow(
        candidates, "host string, by_shape boolean, subtree bigint, copy bigint, chars bigint"
    )
    counts = (
        found.groupBy(*key, "copy").agg(F.max("chars").alias("chars"))
        .groupBy(*key).agg(F.count("*").alias("n"), F.min("chars").alias("least"), F.max("chars").alias("most"))
    )
    sizes = pages.select("host", F.xxhash64("html").alias("copy")).distinct().groupBy("host").agg(F.count("*").alias("pages"))
    often = F.col("n") >= F.when(F.col("by_shape"), F.lit(shape_share)).otherwise(F.lit(share)) * F.col("pages")
    alike = ~F.col("by_shape") | (F.col("most") <= F.greatest(F.lit(SHORT_TEXT), 2 * F.col("least")))
    return counts.filter(F.col("n") >= least_pages).join(sizes, "host").filter(often & alike).select(*key)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every page; text is empty where there is none.

    NULL html is an empty page, pages without a host share one empty host name and are judged by
    markup alone; repeated rows stay; an empty table gives an empty result; other columns are
    ignored.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                main_text(page.as_py() or "", set(known.as_py() or ()), set(shapes.as_py() or ()))
                for page, known, shapes in zip(*(batch.column(c) for c in ("html", "subtrees", "shapes")))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())],
                names=["page_id", "url", "text"],
            )

    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"), host(F.col("url").cast("string")).alias("host"),
    )
    found = templates(rows.filter("host <> ''").select("host", "html"))
    # every subtree is on a tenth of its host's pages, so a host has at most ten times the
    # subtrees of a page; written, so that Spark knows the table's size before it plans the join
    listed = [
        F.collect_list(F.when(~F.col("by_shape"), F.col("subtree"))).alias("subtrees"),
        F.collect_list(F.when(F.col("by_shape"), F.col("subtree"))).alias("shapes"),
    ]
    by_host = stored(found.groupBy("host").agg(*listed), "templates")
    return rows.join(by_host, "host", "left").select("page_id", "url", "html", "subtrees", "shapes").mapInArrow(
        read, "page_id bigint, url string, text string"
    )
