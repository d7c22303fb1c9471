"""Objects out of model text: fences and surrounding prose removed, small damage repaired."""

from __future__ import annotations

import json
import re

_BARE = re.compile(r"[^\s,:{}\[\]\"']+(?:[ \t]+[^\s,:{}\[\]\"']+)*")
_ESC = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "/": "/", "\\": "\\", '"': '"', "'": "'"}
_CONSTANT = {"true": True, "false": False, "null": None, "True": True, "False": False, "None": None}


class _Reader:
    """Recursive reading that ends whatever is open at the end of the text; nested at most ``limit`` deep."""

    def __init__(self, text: str, limit: int = 200):
        self.s, self.i, self.limit = text, 0, limit

    def skip(self) -> None:
        while self.i < len(self.s):
            if self.s[self.i].isspace():
                self.i += 1
            elif self.s.startswith("//", self.i):
                end = self.s.find("\n", self.i)
                self.i = len(self.s) if end < 0 else end
            elif self.s.startswith("/*", self.i):
                end = self.s.find("*/", self.i)
                self.i = len(self.s) if end < 0 else end + 2
            else:
                return

    def value(self, depth: int = 0):
        if depth > self.limit:
            raise ValueError("nested too deeply")
        self.skip()
        if self.i >= len(self.s):
            return None
        c = self.s[self.i]
        if c == "{":
            return self.object(depth)
        if c == "[":
            return self.array(depth)
        if c in "\"'":
            return self.string(c)
        m = _BARE.match(self.s, self.i)
        if not m:
            self.i += 1
            return None
        self.i = m.end()
        word = m[0]
        if word in _CONSTANT:
            return _CONSTANT[word]
        try:
            return json.loads(word)
        except ValueError:
            return word

    def string(self, quote: str) -> str:
        out, self.i = [], self.i + 1
        while self.i < len(self.s):
            c = self.s[self.i]
            if c == "\\" and self.i + 1 < len(self.s):
                n = self.s[self.i + 1]
                if n == "u" and re.match(r"[0-9a-fA-F]{4}", self.s[self.i + 2 : self.i + 6]):
                    out.append(chr(int(self.s[self.i + 2 : self.i + 6], 16)))
                    self.i += 6
                    continue
                out.append(_ESC.get(n, n))
                self.i += 2
                continue
            self.i += 1
            if c == quote:
                break
            out.append(c)
        return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")

    def object(self, depth: int) -> dict:
        out: dict = {}
        self.i += 1
        while True:
            self.skip()
            if self.i >= len(self.s):
                return out
            c = self.s[self.i]
            if c == "}":
                self.i += 1
                return out
            if c in ",:":
                self.i += 1
                continue
            if c in "\"'":
                key = self.string(c)
            else:
                m = _BARE.match(self.s, self.i)
                if not m:
                    self.i += 1
                    continue
                self.i, key = m.end(), m[0]
            self.skip()
            if self.i < len(self.s) and self.s[self.i] == ":":
                self.i += 1
                self.skip()
                out[key] = "" if self.i < len(self.s) and self.s[self.i] in ",}" else self.value(depth + 1)
            else:
                out[key] = None

    def array(self, depth: int) -> list:
        out: list = []
        self.i += 1
        while True:
            self.skip()
            if self.i >= len(self.s):
                return out
            c = self.s[self.i]
            if c == "]":
                self.i += 1
                return out
            if c == ",":
                self.i += 1
                continue
            if c in "}:":
                self.i += 1
                continue
            out.append(self.value(depth + 1))


def repair(text: str):
    """The value a text stands for: strict JSON if it is, else read leniently."""
    try:
        return json.loads(text)
    except ValueError:
        pass
    if not re.search(r"[{\[]", text):
        raise ValueError("no object or array")
    return _Reader(text[re.search(r"[{\[]", text).start() :]).value()


def extract(response, spread: bool = False):
    """Null gives {}; an object as it is; a text its (repaired) JSON, or the text itself if it has none. spread joins an object's top-level strings."""
    if response is None:
        return {}
    if isinstance(response, dict):
        return response
    text = response
    fence = text.find("```json")
    if fence >= 0:
        end = text.find("```", fence + 7)
        text = text[fence + 7 : end if end >= 0 else len(text)]
    if "{" in text and "}" in text:
        text = text[text.index("{") : text.rindex("}") + 1]
    try:
        found = repair(text)
        if not isinstance(found, (dict, list)):
            return response if spread else found
        if spread:
            if not isinstance(found, dict):
                return response
            return "".join(v for v in found.values() if isinstance(v, str))
        return found
    except (ValueError, RecursionError):
        return response
