"""Main text of web pages by the line-block distribution.

Markup is stripped first: each block of a page is a line, and its length counts the characters that are neither in a link nor in
a part that is no article by its own declaration (menus, asides, forms, scripts and the like). Lengths are summed over windows
of WINDOW lines. Where a window's sum rises from nothing to SURGE characters the text surges, where it falls back to nothing it
dives; the stretch of most characters between a surge and a dive is the core of the article. The article is what its container
holds: the innermost element around SHARE of the core's characters, or the declared <article> or <main> that the core lies in.
Lines of the container that are not declared otherwise and no runs of bare links are kept, short ones too.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import release, text_or_empty

#: Lines a window, characters that make a surge, share of the core that its container has to hold, and a declared one.
WINDOW, SURGE, SHARE, DECLARED_SHARE = 3, 80, 0.8, 0.1

#: Elements whose content is no text: read on to their end tag, whatever stands between.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that hold no article, beside those that say so in an attribute.
OUTSIDE = frozenset("head nav footer aside form menu dialog button select option datalist noscript template object svg math canvas audio video map fieldset".split())
#: A header is one of the page unless it stands in one of these.
DECLARED = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements inside a line; all others begin and end one.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that may stand in <head>, that end an open <p>, and that end an open one of a kind.
IN_HEAD = frozenset("title meta link style script base noscript template".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words of an id or class, and roles, of parts that are not the article; words beside which they mean something else.
WORDS_OUTSIDE = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter "
    "subscribe subscription signup sidebar rail widget widgets menu menus nav navbar navigation navi breadcrumb breadcrumbs pager pagination masthead topbar toolbar footer copyright legal "
    "comment comments commentlist disqus reply replies respond discussion feedback share sharing social related recommended recommendations teaser teasers login search searchbox skip header".split()
)
WORDS_ABOUT_OTHERS, WORDS_OF_ARTICLES = frozenset("has with without no enabled disabled supports".split()), frozenset("article post entry story content".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES_OUTSIDE = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())

_TOKEN = re.compile(
    r"<!--(?:>|->|[\s\S]*?(?:--!?>|\Z))|<(?P<slash>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"'=]|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?|[\"'])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S
)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_MAIN_ROLE = re.compile(r"""\brole\s*=\s*["']?main\b""", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.I) for tag in RAW}


@dataclass
class Element:
    """An open or closed element: its parent's number (-1: none), whether it is outside the article, whether it or one around it
    is a declared container, whether it is that itself."""

    tag: str
    number: int
    parent: int
    outside: bool
    within: bool
    declared: bool = False


@dataclass
class Line:
    """A block's text, its characters outside links, its innermost element and whether that is part of a heading. A block that is
    outside the article has no text."""

    text: str
    unlinked: int = 0
    element: int = -1
    heading: bool = False


def _says_outside(tag: str, attrs: str, within: bool) -> bool:
    """Whether an element says by its attributes that it is no part of an article."""
    if not attrs or tag in ("html", "body"):
        return False
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN.search(value)):
            return True
        if name == "role" and not ROLES_OUTSIDE.isdisjoint(value.lower().split()):
            return True
        if name in ("class", "id"):
            for token in value.split():
                words = {w.lower() for w in _WORD.findall(token)}
                if words & WORDS_ABOUT_OTHERS:
                    continue
                if within or tag in HEADINGS or words & WORDS_OF_ARTICLES:
                    words.discard("header")
                if words & WORDS_OUTSIDE:
                    return True
    return False


class _Page:
    """Reads a page tag by tag, as tolerant as browsers are of end tags that are missing or in excess."""

    def __init__(self, page: str):
        self.elements: list[Element] = []
        self.lines: list[Line] = []
        self._stack: list[Element] = []
        self._open: Counter = Counter()
        self._clear()
        at = 0
        for m in _TOKEN.finditer(page):
            if m.start() < at:
                continue  # inside an element whose content is no text
            self._text(page[at : m.start()])
            at = m.end()
            tag = (m["tag"] or "").lower()
            if tag in RAW and not m["slash"]:
                at = _ENDS[tag].search(page, at).end()
            elif tag == "br":
                self._text(" ")
            elif tag and tag not in VOID:
                (self._end if m["slash"] else self._begin)(tag, m["attrs"])
            elif tag and tag not in INLINE:
                self._end_line()
        self._text(page[at:])
        self._end_line()

    def _clear(self) -> None:
        self._parts, self._aside, self._unlinked, self._element, self._heading = [], False, 0, None, False

    def _text(self, text: str) -> None:
        bare = text.strip()
        top = self._stack[-1] if self._stack else None
        if top and top.outside:
            self._aside = self._aside or bool(bare)
            return
        if bare and self._element is None:
            self._element = top.number if top else -1
            self._heading = any(self._open[h] for h in HEADINGS)
        self._parts.append(text)
        if not self._open["a"]:
            self._unlinked += len(bare)

    def _end_line(self) -> None:
        text = " ".join(html.unescape("".join(self._parts)).split()) if self._element is not None else ""
        if text:
            self.lines.append(Line(text, self._unlinked, self._element, self._heading))
        elif self._aside:
            self.lines.append(Line(""))
        self._clear()

    def _close(self, upto: int) -> None:
        for e in self._stack[upto:]:
            self._open[e.tag] -= 1
        del self._stack[upto:]

    def _nearest_block(self) -> int:
        k = len(self._stack) - 1
        while k >= 0 and self._stack[k].tag in INLINE:
            k -= 1
        return k

    def _end(self, tag: str, _: str | None) -> None:
        if tag not in INLINE:
            self._end_line()
        if self._open[tag]:
            k = len(self._stack) - 1
            while self._stack[k].tag != tag and (tag not in INLINE or self._stack[k].tag in INLINE):
                k -= 1
            if self._stack[k].tag == tag:  # the end of an inline element ends no block
                self._close(k)

    def _begin(self, tag: str, attrs: str) -> None:
        if tag not in INLINE:
            self._end_line()
        if self._open["head"] and tag not in IN_HEAD and self._stack[-1].tag == "head":
            self._close(len(self._stack) - 1)
        if tag == "a" and self._open["a"]:
            self._end("a", None)
        ends = {"p"} if tag in CLOSES_P and self._open["p"] else SELF_CLOSING.get(tag, ())
        if ends and self._stack:
            k = self._nearest_block()
            if k >= 0 and self._stack[k].tag in ends:
                self._close(k)
        top = self._stack[-1] if self._stack else Element("", -1, -1, False, False)
        outside = top.outside or tag in OUTSIDE or (tag == "header" and not top.within) or _says_outside(tag, attrs, top.within)
        declared = not outside and (tag in DECLARED or bool(_MAIN_ROLE.search(attrs)))
        e = Element(tag, len(self.elements), top.number, outside, top.within or declared, declared)
        self.elements.append(e)
        self._stack.append(e)
        self._open[tag] += 1

    def held(self, weights: list[int]) -> list[int]:
        """The sum of the lines' weights in each element, those inside included."""
        sums = [0] * len(self.elements)
        for line, w in zip(self.lines, weights):
            if line.element >= 0:
                sums[line.element] += w
        for e in reversed(self.elements):
            if e.parent >= 0:
                sums[e.parent] += sums[e.number]
        return sums

    def inside(self, container: int | None) -> list[Line]:
        """The lines with text in an element; all of them without one."""
        if container is None:
            return [x for x in self.lines if x.text]
        part = [False] * len(self.elements)
        for e in self.elements:
            part[e.number] = e.number == container or (e.parent >= 0 and part[e.parent])
        return [x for x in self.lines if x.text and x.element >= 0 and part[x.element]]


def core(lengths: list[int]) -> tuple[int, int]:
    """The stretch (first line, line after the last) of most characters between a surge and a dive of the windows' sums; if
    nothing surges, of most characters between two dives; (0, 0) without any length."""
    n = len(lengths)
    best, begin, surged, window = (False, 0, 0, 0), None, False, sum(lengths[:WINDOW])
    for k in range(n + 1):
        if window and k < n:
            begin = k if begin is None else begin
            surged = surged or window >= SURGE
        elif begin is not None:
            while not lengths[begin]:
                begin += 1
            best = max(best, (surged, sum(lengths[begin:k]), -begin, k))
            begin, surged = None, False
        if k < n:
            window += (lengths[k + WINDOW] if k + WINDOW < n else 0) - lengths[k]
    return -best[2], best[3]


def main_text(page: str) -> str:
    """The article's blocks in the page's order, joined by line feeds; empty if the page has none."""
    read = _Page(page)
    lengths = [x.unlinked for x in read.lines]
    lo, hi = core(lengths)
    total, of_page = sum(lengths[lo:hi]), read.held(lengths)
    of_core = read.held([n if lo <= k < hi else 0 for k, n in enumerate(lengths)])
    marked = [e for e in read.elements if e.declared and of_core[e.number] >= DECLARED_SHARE * total]
    if marked:
        container = max((e for e in marked if e.tag == "article"), key=lambda e: (of_page[e.number], -e.number), default=marked[0]).number
    elif total:
        container = max((e.number for e in read.elements if of_core[e.number] >= SHARE * total), default=None)
    else:
        return ""
    lines = read.inside(container)
    if container is not None and not any(x.heading for x in lines):
        lines = _headline(read, lines) + lines
    return "\n".join(x.text for x in _without_menus(read, lines))


def _headline(read: _Page, lines: list[Line]) -> list[Line]:
    """The page's only first-order heading, if it stands before these lines and outside their container."""
    tops = [x for x in read.lines if x.heading and x.text and _block(read, x) == "h1"]
    return tops if len(tops) == 1 and lines and tops[0].element < lines[0].element else []


def _block(read: _Page, line: Line) -> str:
    """The tag of a line's block, `` for none."""
    at = line.element
    while at >= 0 and read.elements[at].tag in INLINE:
        at = read.elements[at].parent
    return read.elements[at].tag if at >= 0 else ""


def _without_menus(read: _Page, lines: list[Line]) -> list[Line]:
    """The lines but for runs of two and more that are nothing but links; headings and paragraphs are no part of a run."""
    bare = [not x.unlinked and not x.heading and _block(read, x) != "p" for x in lines]
    alone = [b and not (k and bare[k - 1]) and not (k + 1 < len(bare) and bare[k + 1]) for k, b in enumerate(bare)]
    return [x for x, b, one in zip(lines, bare, alone) if not b or one]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (the text's code points).

    A null page is empty, and so is the text of a page without an article. Repeated rows and null ids are rows like others;
    other columns are ignored. An empty table gives an empty result. Each page is read in one pass, whatever its length.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text_or_empty(html_col).alias("html"))
    kinds = dict(rows.dtypes)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])
        release()

    out = rows.mapInArrow(read, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
