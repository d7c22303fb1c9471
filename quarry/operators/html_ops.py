"""Cleaning, splitting and rebuilding of HTML documents."""

from __future__ import annotations

import re

from ..functions import dom
from ..functions.dom import Comment, Element

REMOVED = frozenset("canvas embed iframe noscript object script style svg".split())
_EVENTS = tuple(
    "on" + e
    for e in "abort blur change click copy cut dblclick error focus keydown keypress keyup load mousedown "
    "mouseenter mouseleave mousemove mouseout mouseover mouseup paste reset resize scroll select submit unload".split()
)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|opacity\s*:\s*0", re.I)

ATOMIC = frozenset("code dl figure ol pre table ul".split())
BLOCK = frozenset("article aside blockquote div fieldset figure footer form h1 h2 h3 h4 h5 h6 header li main nav noscript p section".split())
INLINE = frozenset("a b big br cite em i img label q small span strong sub sup u".split())
_STRIPPED = ("script", "style", "meta", "noscript", "link", "svg", "iframe")
_KEPT_ATTRS = frozenset("href src alt colspan rowspan title target".split())
_UNSEEN = frozenset("script style noscript template head meta link".split())


def collapse(s: str) -> str:
    return " ".join(s.split())


# cleaning


def hidden(e: Element) -> bool:
    return "hidden" in e.attrs or e.attrs.get("aria-hidden") == "true" or bool(_HIDDEN.search(e.attrs.get("style", "")))


def _stripped(html: str, drop_tail: bool) -> Element:
    root = dom.from_string(html, as_written=True)
    dom.prune(root, lambda x: isinstance(x, Comment) or x.tag in REMOVED or hidden(x), drop_tail)
    for e in root.iter():
        if e.attrs:
            for a in ("style", *_EVENTS):
                e.attrs.pop(a, None)
    return root


def structural_clean(html: str | None, drop_tail: bool = False) -> str:
    """Without comments, scripts and other unseen tags, hidden elements, and style and event attributes. Blank input gives ''."""
    if not html or not html.strip():
        return ""
    return dom.to_string(_stripped(html, drop_tail))


def simplify(root: Element) -> Element:
    """Our own simplification: no attributes, no empty elements, chains of single wrappers joined into their innermost. Changes the tree it is given."""
    instead: dict[int, Element | None] = {}  # what stands for an element below: nothing, or its only child
    for e in reversed(list(root.iter())):
        e.attrs = {}
        kept: list = []
        for c in e.children:
            c = instead.get(id(c), c) if isinstance(c, Element) else c
            if c is None:
                continue
            if isinstance(c, str) and kept and isinstance(kept[-1], str):
                kept[-1] += c
                continue
            kept.append(c)
            if isinstance(c, Element):
                c.parent = e
        e.children = kept
        if e is root or e.tag in ("img", "br", "hr", "input"):
            continue
        inner = e.elements()
        text = any(isinstance(c, str) and c.strip() for c in kept)
        if not inner and not text:
            instead[id(e)] = None
        elif len(inner) == 1 and not text and e.tag in ("div", "span", "section", "article", "main"):
            instead[id(e)] = inner[0]
    return root


def clean(html: str | None, simplified: bool = True, drop_tail: bool = False) -> str:
    """structural_clean(), then simplify()."""
    if not html or not html.strip():
        return ""
    root = _stripped(html, drop_tail)
    return dom.to_string(simplify(root) if simplified else root).strip()


def sanitise(e: Element) -> Element:
    """A copy without unseen tags, comments and all but a few attributes."""
    e = e.copy()
    dom.prune(e, lambda x: isinstance(x, Comment) or x.tag in _STRIPPED)
    for x in e.iter():
        x.attrs = {k: v for k, v in x.attrs.items() if k in _KEPT_ATTRS and not (k == "href" and v.strip().lower().startswith("javascript:"))}
    return e


# splitting


def layout_table(e: Element) -> bool:
    """A table for layout: no header cell, and a table inside or fewer than two rows."""
    if e.tag != "table":
        return False
    tags = [x.tag for x in e.iter()]
    return "th" not in tags and (tags.count("table") > 1 or tags.count("tr") < 2)


def nodes(html: str | None) -> list[dict]:
    """The addressable nodes of a document, in reading order: id, xpath, content, type ('text' or 'atomic')."""
    if not isinstance(html, str) or not html.strip():
        return []
    root = dom.from_string(html)
    out: list[dict] = []
    buffer: list[str] = []
    where = dom.paths(root)

    def emit(xpath: str, content: str, kind: str) -> None:
        out.append({"id": len(out), "xpath": xpath, "content": content, "type": kind})

    def flush(e: Element) -> None:
        raw = "".join(buffer)
        buffer.clear()
        text = collapse(raw)
        if text and (len(text) > 1 or "<img" in raw):
            emit(where[id(e)], text, "text")

    stack: list[tuple[Element, int]] = [(root, 0)]
    while stack:
        e, at = stack.pop()
        if at >= len(e.children):
            flush(e)
            continue
        stack.append((e, at + 1))
        c = e.children[at]
        if isinstance(c, Comment):
            continue
        if isinstance(c, str):
            buffer.append(c)
            continue
        tag = c.tag
        atomic, block = tag in ATOMIC, tag in BLOCK
        if layout_table(c) or not (atomic or block or tag in INLINE):
            flush(e)
            stack.append((c, 0))
        elif atomic:
            flush(e)
            text = dom.to_string(sanitise(c))
            emit(where[id(c)], text.strip() if tag == "pre" else collapse(text), "atomic")
        elif block:
            flush(e)
            if any((x.tag in BLOCK or x.tag in ATOMIC) and not layout_table(x) for x in c.elements()):
                stack.append((c, 0))
            else:
                s = sanitise(c)
                if s.text_content().strip() or any(x.tag == "img" for x in s.iter()):
                    emit(where[id(c)], collapse(dom.to_string(s)), "text")
        elif tag == "br":
            buffer.append(" ")
        else:
            buffer.append(dom.to_string(sanitise(c)))
    return out


def visible_leaves(html: str | None, min_length: int = 1, dedupe: bool = True) -> list[dict]:
    """(xpath, text) of every visible piece of text, in reading order; text behind a child belongs to the parent. Of equal texts the first stays."""
    if not html or not html.strip():
        return []
    root = dom.from_string(html)
    out, seen, where = [], set(), dom.paths(root)
    stack: list[tuple[Element, int]] = [(root, 0)]
    while stack:
        e, at = stack.pop()
        if at >= len(e.children):
            continue
        stack.append((e, at + 1))
        c = e.children[at]
        if isinstance(c, Element):
            if c.tag not in _UNSEEN:
                stack.append((c, 0))
        elif isinstance(c, str) and not (at and isinstance(e.children[at - 1], Comment)):
            text = collapse(c)
            if len(text) >= min_length and text and not (dedupe and text in seen):
                seen.add(text)
                out.append({"xpath": where[id(e)], "text": text})
    return out


_NOT_WORD = re.compile(r"[^\w\s]")


def match_text(s: str | None) -> str:
    return collapse(_NOT_WORD.sub(" ", s or "").lower())


def search_index(html: str | None) -> list[dict]:
    """Every element's pieces in document order, with their text for matching.

    An element's pieces are its own strings between children, and each child's whole text, its strings joined by spaces. Whole texts, matching texts and
    words are put together from those of the children, so that wrappers around one piece share it.
    """
    if not html or not html.strip():
        return []
    root = dom.parse(html, nested=True)
    where = dom.paths(root)
    every = list(root.iter())
    known: dict[str, tuple] = {}

    def leaf(s: str) -> tuple:
        if s not in known:
            norm = match_text(s)
            known[s] = (s, norm, sorted(set(norm.split())))
        return known[s]

    whole: dict[int, tuple | None] = {}
    mine: dict[int, list[tuple]] = {}
    for e in reversed(every):
        found: list[tuple] = []
        for c in e.children:
            if isinstance(c, str):
                c = c.strip()
                if c:
                    found.append(leaf(c))
            elif isinstance(c, Element) and whole[id(c)] is not None:
                found.append(whole[id(c)])
        mine[id(e)] = found
        if len(found) > 1:
            words = sorted(w for f in found for w in f[2])  # of runs that are sorted already
            whole[id(e)] = (" ".join(f[0] for f in found), " ".join(f[1] for f in found if f[1]), list(dict.fromkeys(words)))
        else:
            whole[id(e)] = found[0] if found else None
    out: list[dict] = []
    for e in every:
        if e is root:
            continue
        for i, (text, norm, words) in enumerate(mine[id(e)]):
            out.append({"ord": len(out), "xpath": where[id(e)], "chunk": text, "norm_chunk": norm, "norm_tokens": words, "sub_index": i})
    return out


_TOKENS = re.compile(r"\w+|[^\w\s]")


def count_tokens(s: str) -> int:
    """Our own estimate: words and single marks."""
    return sum(1 for _ in _TOKENS.finditer(s))


def chunk(html: str | None, max_tokens: int = 500, attr_cutoff: int = 5) -> list[str]:
    """Splits a document into parts of at most max_tokens, each with the tags around it; one piece of text is never cut. Attribute values are shortened."""
    if not html or not html.strip():
        return []
    root = dom.from_string(html)
    for e in root.iter():
        e.attrs = {k: v[:attr_cutoff] for k, v in e.attrs.items()}
    size: dict[int, int] = {}
    for e in reversed(list(root.iter())):
        size[id(e)] = 2 + count_tokens(e.tag) * 2 + sum(size[id(c)] if isinstance(c, Element) else count_tokens(c) if isinstance(c, str) else 0 for c in e.children)
    if size[id(root)] <= max_tokens:
        return [dom.to_string(root)]
    # leaves of the cut: strings, and elements that fit
    parts: list[tuple[list[Element], object, int]] = []
    todo: list = [(root, 0, [root])]
    while todo:
        e, at, line = todo.pop()
        if at >= len(e.children):
            continue
        todo.append((e, at + 1, line))
        c = e.children[at]
        if isinstance(c, str):
            if c.strip():
                parts.append((line, c, count_tokens(c)))
        elif isinstance(c, Element):
            if size[id(c)] <= max_tokens or not c.children:
                parts.append((line, c, size[id(c)]))
            else:
                todo.append((c, 0, [*line, c]))
    out, group, used = [], [], 0
    for p in parts:
        if group and used + p[2] > max_tokens:
            out.append(_wrap(group))
            group, used = [], 0
        group.append(p)
        used += p[2]
    if group:
        out.append(_wrap(group))
    return out


def _wrap(group: list[tuple]) -> str:
    made: dict[int, Element] = {}
    top = None
    for line, what, _ in group:
        parent = None
        for e in line:
            x = made.get(id(e))
            if x is None:
                x = made[id(e)] = Element(e.tag, dict(e.attrs))
                if parent is None:
                    top = x
                else:
                    parent.append(x)
            parent = x
        parent.append(what if isinstance(what, str) else what.copy())
    return dom.to_string(top)


# rebuilding

_STEP = re.compile(r"([^\[\]]+)(?:\[(\d+)\])?$")
_TAG = re.compile(r"[A-Za-z_][\w.\-]*$")


def rebuild(pairs: list[tuple[str, str]], root_tag: str = "html") -> str:
    """A document that has each content inside the element its path names, elements made as they are needed."""
    root = Element(root_tag)
    if root_tag == "html":
        root.append(Element("head"))
        root.append(Element("body"))
    for xpath, content in pairs:
        if not xpath or not xpath.startswith("/"):
            continue
        steps = [s for s in xpath.split("/") if s]
        if steps and _STEP.match(steps[0]) and _STEP.match(steps[0])[1] == root_tag:
            steps = steps[1:]
        at = root
        for s in steps:
            m = _STEP.match(s)
            tag, nth = (m[1].replace(":", "_"), int(m[2] or 1)) if m else (s, 1)
            attrs = {}
            if not _TAG.match(tag):
                tag, attrs = "div", {"original_tag": tag}
            same = [c for c in at.elements() if c.tag == tag]
            while len(same) < nth:
                e = Element(tag, dict(attrs))
                at.append(e)
                same.append(e)
            at = same[nth - 1]
        if not content:
            continue
        found = dom.parse(content, nested=True)
        for c in found.children:
            if isinstance(c, str) and at.children:
                last = at.children[-1]
                at.append(" " + c.strip() if isinstance(last, str) and last and not last.endswith(" ") else c)
            else:
                at.append(c)
    return dom.to_string(root)


def merge(kept: list[list[dict]] | None, fallback: str | None) -> str:
    """The clean document of the kept nodes of all chunks; without any, the fallback, a page that is clean already."""
    pairs = [(n["xpath"], n["content"]) for chunk_ in kept or [] for n in chunk_ or [] if n]
    return clean(rebuild(pairs)) if pairs else fallback or ""


def skeleton(html: str, chosen: list[dict]) -> str:
    """The page cleaned, with only the chosen nodes, their ancestors and the inline elements inside them; nothing chosen gives ''."""
    if not chosen:
        return ""
    root = dom.from_string(clean(html, simplified=False) or "<html></html>")
    wanted = {n["xpath"] for n in chosen}
    keep: set[int] = set()
    full: set[int] = set()
    where = dom.paths(root)
    for e in root.iter():
        if where[id(e)] in wanted:
            full.update(id(x) for x in e.iter())
            x = e
            while x is not None:
                keep.add(id(x))
                x = x.parent
    if not keep:
        return ""
    dom.prune(root, lambda x: not isinstance(x, Comment) and id(x) not in keep and id(x) not in full)
    for e in root.iter():
        if id(e) not in full:
            e.children = [c for c in e.children if isinstance(c, Element)]
    return dom.to_string(root)
