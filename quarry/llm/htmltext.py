"""HTML extraction: flat text blocks, judged by a decision tree over their own and their neighbours' words and links.

A page is cut at block-level tags into flat blocks. A block's features are its words and link density, those of the blocks before and after, what kinds
of element it lies in (by tag, role and the names in class and id), and its tag. A CART tree, trained here on the table in ``labelled_blocks``,
says which blocks are main text. Scripts, styles, comments and other unseen content never become blocks.

A name counts by its telling words, unless it says what a wrapper has or in which state it is (``has-sidebar``, ``content-with-sidebar``, ``menu-open``); names of html and
body don't count. An element whose name calls it boilerplate but that holds most of the page's words and, beside it, next to nothing that could be main text, is a
wrapper: its name doesn't count either.

Defined results: null or blank html, and pages without main text, give the empty string; tags that aren't closed or never opened are tolerated, and what
holds text of its own kind (svg, button, select, object and the like) holds nothing if it is never closed; a page of any length takes time that grows with its length;
truncated references stay as they are; repeated rows are extracted each on its own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import dom
from . import labelled_blocks

_ATTR = re.compile(r"([a-z][\w:-]*)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?", re.I)
_WHOLE = {"button": "form", "select": "form", "svg": "hidden", "math": "hidden", "canvas": "hidden", "object": "hidden", "template": "hidden", "noscript": "hidden"}  # text of another kind, until they are closed
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input picture source font nobr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_HOLDS = frozenset("table ul ol dl div article section main aside nav body html td th li blockquote form".split())

KINDS = ["nav", "header", "footer", "aside", "form", "hidden", "ad", "notice", "comment", "share", "article", "main"]
_BIT = {k: 1 << i for i, k in enumerate(KINDS)}
_CONTENT = _BIT["article"] | _BIT["main"]
_BOILERPLATE = sum(_BIT.values()) & ~_CONTENT
_BY_TAG = {"nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "fieldset": "form", "article": "article", "main": "main", "dialog": "notice", "head": "hidden"}
_BY_ROLE = {"navigation": "nav", "banner": "header", "contentinfo": "footer", "complementary": "aside", "search": "form", "alert": "notice", "alertdialog": "notice", "dialog": "notice", "main": "main", "article": "article", "menu": "nav", "menubar": "nav"}
_BY_WORD = {
    w: k
    for k, ws in {
        "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion promoted adsense adbox adslot",
        "nav": "nav menu navbar navigation breadcrumb breadcrumbs pagination pager toc tabs skip submenu menubar",
        "header": "masthead topbar siteheader",
        "footer": "footer copyright colophon foot",
        "aside": "sidebar aside side widget widgets related recommended recommendations trending popular rail",
        "notice": "cookie cookies consent notice notices gdpr alert alerts popup modal overlay newsletter subscribe subscription signup paywall warning banner disclaimer",
        "comment": "comment comments disqus reply replies respond discussion commentlist feedback reader",
        "share": "share sharing social shares follow",
        "main": "content article post entry story main maintext",
    }.items()
    for w in ws.split()
}
_HIDDEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_WORDS = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
_ABOUT = frozenset("has no with without is not hide show js".split())  # a name that begins so, and what follows within it, is about something else
_STATES = frozenset("open opened closed active inactive enabled disabled visible fixed sticky collapsed expanded on off toggled ready loaded".split())


def _named(value: str) -> int:
    """The kinds that the names in a class or id tell of."""
    k = 0
    for name in value.split():
        words = [w.lower() for w in _WORDS.split(name) if w]
        about = next((i for i, w in enumerate(words) if w in _ABOUT), len(words))
        words = words[:about]
        if not words or words[-1] in _STATES:
            continue
        for w in words:
            if w in _BY_WORD:
                k |= _BIT[_BY_WORD[w]]
        if words[-1] == "header" and not {"article", "post", "entry", "story"} & set(words):
            k |= _BIT["header"]
    return k


def _kind(tag: str, attr: str) -> tuple[int, int]:
    """The kinds of an element by its tag and role, and by its names."""
    k, named = _BIT.get(_BY_TAG.get(tag, ""), 0), 0
    if tag in ("html", "body") or "=" not in attr and "hidden" not in attr.lower():
        return k, named
    for name, a, b, c in _ATTR.findall(attr):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            named |= _named(value)
        elif name == "role":
            k |= _BIT.get(_BY_ROLE.get(value.lower(), ""), 0)
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN.search(value)):
            k |= _BIT["hidden"]
    return k, named


class Block:
    __slots__ = ("text", "words", "links", "kinds", "tag", "label", "within")

    def __init__(self, text: str, links: int, kinds: int, tag: str, label: bool, within: tuple[int, ...]):
        self.text, self.words, self.links, self.kinds, self.tag, self.label, self.within = text, text.count(" ") + 1, links, kinds, tag, label, within


def _unclosed(found: list[tuple]) -> set[int]:
    """Places of the starts of _WHOLE elements that are never closed; none of these lies in its like."""
    open_: dict[str, int] = {}
    out = set()
    for i, (kind, tag, _, closed) in enumerate(found):
        if kind is dom.START and tag in _WHOLE and not closed:
            if tag in open_:
                out.add(open_[tag])
            open_[tag] = i
        elif kind is dom.END:
            open_.pop(tag, None)
    return out | set(open_.values())


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page, white space in each made one space."""
    out: list[Block] = []
    # (tag, kinds, whether its label says main text, the elements it lies in whose names count)
    stack: list[tuple[str, int, bool, tuple[int, ...]]] = [("", 0, False, ())]
    names: list[int] = []  # the named kinds of those elements
    parts: list[str] = []
    linked: list[str] = []
    link_depth = 0  # of the stack where a link was opened; 0: none
    open_: dict[str, int] = {}

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                tag, kinds, label, within = stack[-1]
                out.append(Block(text, len("".join(linked).split()), kinds, tag, label, within))
        linked.clear()

    def push(tag: str, kinds: int, label: bool, within: tuple[int, ...]) -> None:
        stack.append((tag, kinds, label, within))
        open_[tag] = open_.get(tag, 0) + 1

    def pop(upto: int) -> None:
        for e in stack[upto:]:
            open_[e[0]] -= 1
        del stack[upto:]

    found = list(dom.tokens(page))
    ignored = _unclosed(found)
    for place, (kind, tag, attr, closed) in enumerate(found):
        if kind is dom.TEXT:
            if not attr:  # else it is the text of a script or the like
                s = html.unescape(tag) if "&" in tag else tag
                parts.append(s)
                if link_depth:
                    linked.append(s + " ")
            continue
        if kind is dom.NOTE:
            continue
        closing = kind is dom.END
        if tag == "a":
            link_depth = 0 if closing else len(stack)
            continue
        if tag in _INLINE:
            if not closing and attr and ("hidden" in attr or "style" in attr) and tag not in _VOID and _kind(tag, attr)[0] & _BIT["hidden"]:
                flush()
                push(tag, stack[-1][1] | _BIT["hidden"], False, stack[-1][3])
            elif closing and stack[-1][0] == tag:
                flush()
                pop(len(stack) - 1)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if place in ignored or closed and tag in _WHOLE:
            continue
        flush()
        if closing:
            if open_.get(tag):
                i = len(stack) - 1
                while stack[i][0] != tag:
                    i -= 1
                pop(i)
            if link_depth > len(stack):
                link_depth = 0
            continue
        if tag in _VOID:
            continue
        ends = _CLOSES.get(tag)
        if ends or (stack[-1][0] == "p"):
            ends = ends or {"p"}
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in ends:
                    pop(i)
                    break
                if stack[i][0] in _HOLDS and tag not in ("tr", "td", "th") or stack[i][0] == "table":
                    break
        if link_depth > len(stack):
            link_depth = 0
        _, kinds, _, within = stack[-1]
        new, named = _kind(tag, attr)
        if tag in _WHOLE:
            new |= _BIT[_WHOLE[tag]]
        if tag == "header" and kinds & (_BIT["article"]):
            new &= ~_BIT["header"]  # an article's own head
        if named & _BOILERPLATE:
            within = (*within, len(names))
            names.append(named)
            named = 0
        if len(stack) < dom.DEPTH:
            push(tag, kinds | new | named, " y=1" in attr, within)
    flush()
    _name(out, names)
    return out


def _name(found: list[Block], names: list[int]) -> None:
    """Adds to blocks the kinds of the names that they lie in, but for those of wrappers."""
    total = np.zeros(len(names))
    for b in found:
        for i in b.within:
            total[i] += b.words - b.links
    every = sum(b.words - b.links for b in found)
    for i in range(len(names)):
        if 2 * total[i] > every:
            beside = sum(b.words - b.links for b in found if i not in b.within and not functools.reduce(int.__or__, (names[j] for j in b.within), b.kinds) & _BOILERPLATE)
            if 10 * beside < total[i]:
                names[i] = 0
    for b in found:
        for i in b.within:
            b.kinds |= names[i]


# features and the tree

FEATURES = ["words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", *KINDS, "in_boilerplate", "in_content", "page_has_content", "heading", "listed"]
def features(found: list[Block]) -> np.ndarray:
    n = len(found)
    x = np.zeros((n, len(FEATURES)))
    if n == 0:
        return x
    words = np.array([b.words for b in found], float)
    density = np.array([b.links for b in found], float) / words
    x[:, 0], x[:, 1] = words, density
    x[1:, 2], x[1:, 3] = words[:-1], density[:-1]
    x[:-1, 4], x[:-1, 5] = words[1:], density[1:]
    kinds = np.array([b.kinds for b in found])
    for i in range(len(KINDS)):
        x[:, 6 + i] = kinds >> i & 1
    k = 6 + len(KINDS)
    x[:, k] = (kinds & _BOILERPLATE) > 0
    x[:, k + 1] = (kinds & _CONTENT) > 0
    x[:, k + 2] = ((kinds & _CONTENT > 0) & (kinds & _BOILERPLATE == 0)).any()
    x[:, k + 3] = [b.tag in _HEADINGS for b in found]
    x[:, k + 4] = [b.tag in ("li", "td", "th", "dd", "dt", "option") for b in found]
    return x


class Tree:
    """CART with Gini impurity, as arrays: feature (-1: leaf), threshold, the children, and the leaf's verdict."""

    def __init__(self, x: np.ndarray, y: np.ndarray, max_depth: int = 10, min_leaf: int = 2):
        self.feature, self.threshold, self.left, self.right, self.verdict = [], [], [], [], []
        self._grow(x, y.astype(float), max_depth, min_leaf)
        self.feature, self.threshold = np.array(self.feature), np.array(self.threshold)
        self.left, self.right, self.verdict = np.array(self.left), np.array(self.right), np.array(self.verdict)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, least: int) -> int:
        me = len(self.feature)
        for a, v in ((self.feature, -1), (self.threshold, 0.0), (self.left, 0), (self.right, 0), (self.verdict, bool(y.mean() >= 0.5))):
            a.append(v)
        p = y.mean()
        if depth == 0 or p in (0.0, 1.0):
            return me
        best = (2 * p * (1 - p) * len(y) - 1e-9, -1, 0.0)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, c = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(y))
            ok = (v[1:] > v[:-1]) & (n >= least) & (len(y) - n >= least)
            if not ok.any():
                continue
            l, r = c[:-1], c[-1] - c[:-1]
            cost = np.where(ok, 2 * l * (1 - l / n) + 2 * r * (1 - r / (len(y) - n)), np.inf)
            i = int(np.argmin(cost))
            if cost[i] < best[0]:
                best = (cost[i], f, (v[i] + v[i + 1]) / 2)
        if best[1] < 0:
            return me
        go = x[:, best[1]] <= best[2]
        self.feature[me], self.threshold[me] = best[1], best[2]
        self.left[me] = self._grow(x[go], y[go], depth - 1, least)
        self.right[me] = self._grow(x[~go], y[~go], depth - 1, least)
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while (inner := self.feature[at] >= 0).any():
            i = np.flatnonzero(inner)
            f = self.feature[at[i]]
            at[i] = np.where(x[i, f] <= self.threshold[at[i]], self.left[at[i]], self.right[at[i]])
        return self.verdict[at]


def training_table(variants: int = 6, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    found = [blocks(p) for p in labelled_blocks.pages(variants, seed)]
    return np.concatenate([features(b) for b in found]), np.concatenate([[x.label for x in b] for b in found])


@functools.cache
def model() -> Tree:
    return Tree(*training_table())


def main_texts(pages: list[str | None]) -> list[str]:
    found = [blocks(p) if p else [] for p in pages]
    x = np.concatenate([features(b) for b in found]) if found else np.zeros((0, len(FEATURES)))
    keep = iter(model().predict(x).tolist())
    return [" ".join([b.text for b in bs if next(keep)]) for bs in found]


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars): the main text of every page."""
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = main_texts(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")
