"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block of text. Lines in menus, page headers,
footers, sidebars, notices, adverts, forms and reader comments go with the markup; an
element is one of these by its tag, its role, or a word of its class or id. Every other
line weighs as many characters as it has outside links. Sums over sliding windows of
lines surge where the main text begins and dive to nothing where it ends; the lines from
each surge to its dive are kept. The edge of a page section counts as empty lines, so
that a window doesn't run over it. Where a page marks its article, lines outside weigh nothing and links
inside weigh like text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lines in a window, and the sum that counts as a surge (or half the page's highest, if less).
WINDOW, SURGE = 3, 86

#: Elements by what they hold.
RAW = "script style noscript template svg math iframe object canvas video audio select datalist textarea title"
BOILERPLATE = "nav footer aside form button menu dialog"
VOID = "area base br col embed hr img input link meta param source track wbr"
BLOCKS = (
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul"
)
ROLES = "navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar"
#: Words of a class or id, without a plural s.
NAMES = (
    "ad advert advertisement advertising sponsor sponsored promo promotion sidebar nav navbar navigation menu breadcrumb "
    "footer masthead cookie consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendation comment disqus reply pagination pager toolbar widget banner skip"
)
#: The element, and the word, of a page header where no article holds it.
HEADERS = "header"

_RAW, _BOILERPLATE, _VOID, _BLOCKS, _ROLES, _NAMES = (frozenset(x.split()) for x in (RAW, BOILERPLATE, VOID, BLOCKS, ROLES, NAMES))
_SECTIONS = frozenset("nav header footer aside article main".split())
_COMMENTS = frozenset("comment disqus reply".split())
#: Elements that end where another of their kind, or of the second set, begins.
_ENDS = {"p": _BLOCKS - {"body", "html", "head"}, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "option": frozenset(["option"])}

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<({'|'.join(RAW.split())})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"([\w:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([\w:-]+)")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


class Line(NamedTuple):
    """A block's text; its characters in links; its article's number (-1: none); whether a
    section's edge stands before it."""

    text: str
    linked: int
    article: int
    edge: bool


def _boilerplate(name: str, attributes: str, in_article: bool) -> str | None:
    """"comments" or "other" for an element that holds no main text."""
    if name in _BOILERPLATE or (name == HEADERS and not in_article):
        return "other"
    if not attributes:
        return None
    for key, a, b, c, flag in _ATTRIBUTE.findall(attributes):
        key, value = (key or flag).lower(), a or b or c
        if key in ("class", "id") and name not in ("html", "body", "main"):
            words = {w.lower() for w in _WORD.findall(value)}
            words |= {w[:-1] for w in words if w.endswith("s")}
            if words & _COMMENTS:
                return "comments"
            if words & _NAMES and name != "article" or HEADERS in words and not in_article:
                return "other"
        elif (key == "role" and value.lower() in _ROLES) or key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and _HIDDEN.search(value)):
            return "other"
    return None


class _Page:
    """Lines of a page, gathered tag by tag."""

    def __init__(self) -> None:
        self.lines: list[Line] = []
        self.open: list[tuple[str, str | None, bool]] = []  # name, boilerplate or not, article or not
        self.held: list[str] = []
        self.linked, self.links, self.edge = 0, 0, True
        self.articles, self.depth, self.out = 0, 0, 0
        self.count: dict[str, int] = {}

    def text(self, raw: str) -> None:
        if not self.out:
            self.held.append(raw)
            if self.links:
                self.linked += len(raw)

    def end_line(self) -> None:
        # White space inside a block, no-break spaces too, is one space.
        line = " ".join(html.unescape("".join(self.held)).split())
        if line:
            self.lines.append(Line(line, min(self.linked, len(line)), self.articles if self.depth else -1, self.edge))
            self.edge = False
        self.held, self.linked = [], 0

    def pop(self) -> None:
        name, zone, article = self.open.pop()
        self.count[name] -= 1
        self.out -= zone is not None
        self.depth -= article
        self.links -= name == "a"

    def start(self, name: str, attributes: str) -> None:
        if name in _BLOCKS:
            self.end_line()
        if name in _SECTIONS:
            self.edge = True
        if name in _VOID:
            self.held.append(" " if name == "br" else "")
            return
        if name == "a" and self.links:
            self.stop("a")
        while self.open and name in _ENDS.get(self.open[-1][0], ()):
            self.pop()
        marked = name in ("article", "main") or 'role="main"' in attributes
        if marked and self.out and all(zone != "comments" for _, zone, _ in self.open):
            while self.out:  # what stands open before an article was never closed
                self.pop()
        zone = _boilerplate(name, attributes, self.depth > 0)
        marked = marked and not zone and not self.out
        if marked:
            self.articles += not self.depth
            self.depth += 1
        self.out += zone is not None
        self.links += name == "a"
        self.open.append((name, zone, marked))
        self.count[name] = self.count.get(name, 0) + 1

    def stop(self, name: str) -> None:
        if name in _BLOCKS:
            self.end_line()
        if name in _SECTIONS:
            self.edge = True
        if self.count.get(name):
            while self.open[-1][0] != name:
                self.pop()
            self.pop()


def lines_of(page: str) -> list[Line]:
    """A page's blocks outside scripts and boilerplate, character references decoded."""
    out, at = _Page(), 0
    for tag in _TAG.finditer(page):
        if tag.start() > at:
            out.text(page[at : tag.start()])
        at = tag.end()
        name = tag.group(3)
        if name:
            (out.stop if tag.group(2) else lambda n: out.start(n, tag.group(4)))(name.lower())
    out.text(page[at:])
    out.end_line()
    return out.lines


def kept(lines: list[Line]) -> list[bool]:
    """Which lines stand between a surge and a dive."""
    mass: dict[int, int] = {}
    for line in lines:
        if line.article >= 0:
            mass[line.article] = mass.get(line.article, 0) + len(line.text)
    article = max(mass, key=lambda a: (mass[a], -a), default=None)  # the largest, the first of equals
    weights, places = [], []
    for line in lines:
        if line.edge and article is None:
            weights += [0] * WINDOW
        places.append(len(weights))
        weights.append(len(line.text) - line.linked if article is None else len(line.text) if line.article == article else 0)
    sums = np.convolve(np.array(weights + [0] * WINDOW, np.int64), np.ones(WINDOW, np.int64))[WINDOW - 1 :]
    surge = min(SURGE, sums.max(initial=0) / 2)
    out, inside = np.zeros(len(weights), bool), False
    start = 0
    for i in range(len(weights)):
        if sums[i] == 0:  # a dive
            out[start:i] |= inside
            start, inside = i + 1, False
        elif sums[i] >= surge:
            inside = True
    out[start:] |= inside
    # A window reaches ahead: what lies before the first line with a weight isn't main text.
    held = out[places]
    weighs = np.array(weights)[places] > 0
    for i in range(len(lines)):
        if held[i] and not weighs[i] and (i == 0 or not held[i - 1] or lines[i].edge):
            held[i] = False
    for i in range(len(lines) - 1, -1, -1):
        if held[i] and not weighs[i] and (i + 1 == len(lines) or not held[i + 1] or lines[i + 1].edge):
            held[i] = False
    return held.tolist()


def main_text(page: str | None) -> str:
    lines = lines_of(page or "")
    if not lines:
        return ""
    return "\n\n".join(line.text for line, keep in zip(lines, kept(lines), strict=True) if keep)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The columns of ``pages`` without ``html_col``, with text (empty if there is none) and n_chars,
    its code points; columns of these names are replaced.

    Blocks stand in the order of the page, joined by two line feeds. A null or empty page has the empty
    text; tags that are never closed, cut-off pages and stray brackets are read as far as
    they go. Pages that repeat are pages of their own.
    """
    rest = [f for f in pages.schema.fields if f.name not in (html_col, "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x.as_py()) for x in batch.column("page")], pa.string())
            columns = [batch.column(f"c{i}") for i in range(len(rest))]
            yield pa.RecordBatch.from_arrays([*columns, texts, pc.utf8_length(texts).cast(pa.int64())], [*(f.name for f in rest), "text", "n_chars"])

    schema = T.StructType([*rest, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    plain = pages.select(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(rest)], F.col(f"`{html_col}`").alias("page"))
    return plain.mapInArrow(run, schema)
