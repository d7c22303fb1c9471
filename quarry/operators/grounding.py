"""Grounding of answers: each value is replaced by the page text it matches, with the XPath it came from."""

from __future__ import annotations

import difflib
import json
import re

from ..functions import jsonrepair
from . import html_ops

NOT_FOUND = {"text": None, "xpath": None, "sub_index": None, "score": 0.0, "found": False}


def similarity(chunk: str, search: str) -> float:
    """Ratcliff-Obershelp ratio; the arguments' order matters."""
    return difflib.SequenceMatcher(None, chunk, search.strip()).ratio()


def _most(chunk: str, search: str) -> float:
    """What the similarity can't exceed."""
    a, b = len(chunk), len(search.strip())
    return 2 * min(a, b) / (a + b) if a + b else 1.0


def match(search: str, index: list[dict]) -> dict:
    """The entry that an ordered fold over all candidates keeps: later ones replace it if they are no worse in score and in shared words.

    A similarity is worked out only where its bound from the lengths doesn't decide, which spares the long texts of a page's outer elements.
    """
    norm = html_ops.match_text(search)
    if not norm:
        return dict(NOT_FOUND)
    words = set(norm.split())
    known: dict[str, float] = {}

    def score(e: dict) -> float:
        c = e["chunk"]
        if c not in known:
            known[c] = similarity(c, search)
        return known[c]

    def no_worse(e: dict, best: dict) -> bool:
        c, b = e["chunk"], best["chunk"]
        if c == b:
            return True
        if b in known or len(c) > len(b):
            return _most(c, search) >= score(best) and score(e) >= score(best)
        return score(e) >= _most(b, search) or score(e) >= score(best)

    best, overlap = None, 0
    for e in index:
        shared = len(words.intersection(e["norm_tokens"]))
        if (shared or norm in e["norm_chunk"]) and shared >= overlap and (best is None or no_worse(e, best)):
            best, overlap = e, shared
    if best is None:
        return dict(NOT_FOUND)
    return {"text": best["chunk"], "xpath": best["xpath"], "sub_index": best["sub_index"], "score": score(best), "found": True}


def closest(html: str, search: str) -> dict:
    """match() on a page that isn't indexed yet."""
    return match(search, html_ops.search_index(html))


def ground(value, index: list[dict]):
    """(grounded values, xpaths) of the same shape; what isn't found, and null, is null in both."""
    if isinstance(value, dict):
        both = {k: ground(v, index) for k, v in value.items()}
        return {k: b[0] for k, b in both.items()}, {k: b[1] for k, b in both.items()}
    if isinstance(value, list):
        both = [ground(v, index) for v in value]
        return [b[0] for b in both], [b[1] for b in both]
    if value is None:
        return None, None
    m = match(str(value), index)
    return (" ".join(m["text"].split()), f"/{m['xpath'].lstrip('/')}") if m["found"] else (None, None)


def is_schema(t: str | None) -> bool:
    t = (t or "").strip()
    return t.startswith("dict_keys(") or bool(re.fullmatch(r"\{.*\}|\[.*\]", t, re.S)) or t.count(":") >= 2


def postprocess(response: str | None, content: str | None, request: str | None, exact: bool) -> tuple[str, str | None, str | None]:
    """(prediction, xpaths, error) as JSON texts. Questions give their spread strings and are never grounded."""
    if not response:
        return json.dumps(""), None, None
    try:
        schema = bool(request) and is_schema(request)
        found = jsonrepair.extract(response, spread=not schema)
        if isinstance(found, str):
            return json.dumps(found, ensure_ascii=False), None, None
        if not isinstance(found, dict):
            why = "[PARSE_ERROR] the response holds no JSON object"
            return json.dumps({"__error__": why}), None, why
        if not exact:
            return json.dumps(found, ensure_ascii=False), None, None
        if not content:
            why = "[PARSE_ERROR] nothing to ground the answer in"
            return json.dumps({"__error__": why}), None, why
        values, xpaths = ground(found, html_ops.search_index(content))
        return json.dumps(values, ensure_ascii=False), json.dumps(xpaths, ensure_ascii=False), None
    except Exception as e:  # a bad row is reported in its own columns
        why = f"[PARSE_ERROR] {e}"
        return json.dumps({"__error__": why}), None, why
