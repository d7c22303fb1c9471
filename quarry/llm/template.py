"""A small sandboxed template language and its compiler: syntax tree, constant folding, Python closures.

Text is literal but for ``{{ expression }}`` and ``{% statement %}``: ``for x in e``/``endfor``, ``if e``/``elif e``/``else``/``endif``, ``set x = e``,
``generation``/``endgeneration`` (what it renders is marked). ``-`` inside a brace strips white space on that side. Expressions have
strings, integers, true/false/none, names, ``a.b``, ``a[e]``, ``+``, ``== != in``, ``not and or``, ``e | filter(args)`` and in loops
``loop.first/last/index0/index``. There are no calls and no Python attributes: ``.`` and ``[]`` look up keys of mappings and
places of lists and give none where there is nothing, so a template reaches its arguments and nothing else.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

MAX_DEPTH = 64


class TemplateError(ValueError):
    """The template can't be parsed or names a filter that doesn't exist."""


# syntax tree


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Get:
    of: object
    key: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Not:
    of: object


@dataclass(frozen=True)
class Filter:
    name: str
    of: object
    args: tuple


@dataclass(frozen=True)
class Output:
    expr: object


@dataclass(frozen=True)
class Set:
    name: str
    expr: object


@dataclass(frozen=True)
class If:
    branches: tuple  # of (condition, body)
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


# parsing

_PIECE = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[.\[\]()|,+]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", "'": "'", '"': '"'}
_WORDS = {"true": True, "false": False, "none": None}


class _Expression:
    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at : at + 10]!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.at, self.depth = 0, 0

    def peek(self) -> tuple:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None, kind: str | None = None) -> str:
        k, v = self.peek()
        if (value is not None and v != value) or (kind is not None and k != kind) or k == "end":
            raise TemplateError(f"expected {value or kind or 'more'}, got {v!r}")
        self.at += 1
        return v

    def accept(self, *values: str) -> str | None:
        k, v = self.peek()
        if k in ("op", "name") and v in values:
            self.at += 1
            return v
        return None

    def whole(self):
        e = self.either()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return e

    def either(self):
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise TemplateError("nested too deeply")
        e = self.both()
        while self.accept("or"):
            e = Binary("or", e, self.both())
        self.depth -= 1
        return e

    def both(self):
        e = self.negated()
        while self.accept("and"):
            e = Binary("and", e, self.negated())
        return e

    def negated(self):
        n = 0
        while self.accept("not"):
            n += 1
        e = self.compared()
        for _ in range(n):
            e = Not(e)
        return e

    def compared(self):
        e = self.added()
        while op := self.accept("==", "!=", "in"):
            e = Binary(op, e, self.added())
        return e

    def added(self):
        e = self.filtered()
        while self.accept("+"):
            e = Binary("+", e, self.filtered())
        return e

    def filtered(self):
        e = self.postfix()
        while self.accept("|"):
            name, args = self.take(kind="name"), []
            if self.accept("("):
                while not self.accept(")"):
                    args.append(self.either())
                    if not self.accept(","):
                        self.take(")")
                        break
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            e = Filter(name, e, tuple(args))
        return e

    def postfix(self):
        kind, v = self.peek()
        if kind == "str":
            self.at += 1
            e = Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), v[1:-1], flags=re.S))
        elif kind == "int":
            self.at += 1
            e = Const(int(v))
        elif kind == "name":
            self.at += 1
            e = Const(_WORDS[v]) if v in _WORDS else Name(v)
        elif self.accept("("):
            e = self.either()
            self.take(")")
        else:
            raise TemplateError(f"unexpected {v!r}")
        while op := self.accept(".", "["):
            if op == ".":
                e = Get(e, Const(self.take(kind="name")))
            else:
                e = Get(e, self.either())
                self.take("]")
        return e


class _Parser:
    def __init__(self, source: str):
        self.pieces = []
        strip = False
        for i, piece in enumerate(_PIECE.split(source)):
            if i % 2 == 0:
                if strip:
                    piece = piece.lstrip()
                self.pieces.append(("text", piece))
                strip = False
                continue
            inner = piece[2:-2]
            if inner.startswith("-"):
                inner = inner[1:]
                self.pieces[-1] = ("text", self.pieces[-1][1].rstrip())
            if inner.endswith("-"):
                inner, strip = inner[:-1], True
            self.pieces.append(("out" if piece[1] == "{" else "do", inner.strip()))
        self.at = 0

    def body(self, *ends: str, depth: int = 0) -> tuple[tuple, str]:
        """Nodes up to the statement that begins with one of ends, and that statement."""
        if depth > MAX_DEPTH:
            raise TemplateError("nested too deeply")
        nodes = []
        while self.at < len(self.pieces):
            kind, s = self.pieces[self.at]
            self.at += 1
            if kind == "text":
                if s:
                    nodes.append(Output(Const(s)))
                continue
            if kind == "out":
                nodes.append(Output(_Expression(s).whole()))
                continue
            word, _, rest = s.partition(" ")
            if word in ends:
                return tuple(nodes), s
            if word == "for":
                m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.*)", rest, re.S)
                if not m:
                    raise TemplateError(f"not a loop: {s!r}")
                inner, _ = self.body("endfor", depth=depth + 1)
                nodes.append(For(m[1], _Expression(m[2]).whole(), inner))
            elif word == "if":
                branches, other, cond = [], (), _Expression(rest).whole()
                while True:
                    inner, end = self.body("elif", "else", "endif", depth=depth + 1)
                    if cond is not None:
                        branches.append((cond, inner))
                    else:
                        other = inner
                    if end == "endif":
                        break
                    cond = _Expression(end[4:]).whole() if end.startswith("elif") else None
                nodes.append(If(tuple(branches), other))
            elif word == "set":
                name, eq, expr = rest.partition("=")
                if not eq or not re.fullmatch(r"[A-Za-z_]\w*", name.strip()):
                    raise TemplateError(f"not a set: {s!r}")
                nodes.append(Set(name.strip(), _Expression(expr).whole()))
            elif word == "generation":
                inner, _ = self.body("endgeneration", depth=depth + 1)
                nodes.append(Generation(inner))
            else:
                raise TemplateError(f"unknown statement {s!r}")
        if ends:
            raise TemplateError(f"missing {' or '.join(ends)}")
        return tuple(nodes), ""


def parse(source: str) -> tuple:
    return _Parser(source).body()[0]


# filters: pure functions of strings and lists


def escape(text: str, controls: Iterable[str]) -> str:
    """A backslash before every backslash and before every control string; unescape() takes it back."""
    text = text.replace("\\", "\\\\")
    for c in controls:
        text = text.replace(c, "\\" + c)
    return text


_UNESCAPE = re.compile(r"\\(.)", re.S)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def show(x: object) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x)


FILTERS: dict[str, Callable] = {
    "trim": lambda x: show(x).strip(),
    "upper": lambda x: show(x).upper(),
    "lower": lambda x: show(x).lower(),
    "length": lambda x: len(x) if isinstance(x, (str, list, tuple, dict)) else 0,
    "default": lambda x, d: d if x is None else x,
    "escape": lambda x, *controls: escape(show(x), [show(c) for c in controls]),
}


# folding


def _equal(a, b) -> bool:
    return type(a) is type(b) and a == b


def _binary(op: str, a, b):
    if op == "+":
        return a + b if isinstance(a, int) and isinstance(b, int) and not isinstance(a, bool) and not isinstance(b, bool) else show(a) + show(b)
    if op == "==":
        return _equal(a, b)
    if op == "!=":
        return not _equal(a, b)
    if op == "in":
        return show(a) in b if isinstance(b, (str, list, tuple, dict)) else False
    raise TemplateError(op)


def _get(of, key):
    if isinstance(of, dict):
        return of.get(key)
    if isinstance(of, (list, tuple)) and isinstance(key, int) and 0 <= key < len(of):
        return of[key]
    return None


def fold_expression(e):
    if isinstance(e, Binary):
        a, b = fold_expression(e.left), fold_expression(e.right)
        if e.op in ("and", "or"):
            if isinstance(a, Const):
                return b if bool(a.value) == (e.op == "and") else a
            return Binary(e.op, a, b)
        return Const(_binary(e.op, a.value, b.value)) if isinstance(a, Const) and isinstance(b, Const) else Binary(e.op, a, b)
    if isinstance(e, Not):
        a = fold_expression(e.of)
        return Const(not a.value) if isinstance(a, Const) else Not(a)
    if isinstance(e, Get):
        a, k = fold_expression(e.of), fold_expression(e.key)
        return Const(_get(a.value, k.value)) if isinstance(a, Const) and isinstance(k, Const) else Get(a, k)
    if isinstance(e, Filter):
        a, args = fold_expression(e.of), tuple(fold_expression(x) for x in e.args)
        if isinstance(a, Const) and all(isinstance(x, Const) for x in args):
            return Const(FILTERS[e.name](a.value, *[x.value for x in args]))
        return Filter(e.name, a, args)
    return e


def fold(nodes: Iterable) -> tuple:
    """Constant expressions worked out, branches that never or always run settled, neighbouring text joined."""
    out: list = []

    def add(n) -> None:
        if isinstance(n, Output) and isinstance(n.expr, Const):
            n = Output(Const(show(n.expr.value)))
            if not n.expr.value:
                return
            if out and isinstance(out[-1], Output) and isinstance(out[-1].expr, Const):
                n = Output(Const(out.pop().expr.value + n.expr.value))
        out.append(n)

    for n in nodes:
        if isinstance(n, Output):
            add(Output(fold_expression(n.expr)))
        elif isinstance(n, Set):
            add(Set(n.name, fold_expression(n.expr)))
        elif isinstance(n, For):
            add(For(n.name, fold_expression(n.over), fold(n.body)))
        elif isinstance(n, Generation):
            add(Generation(fold(n.body)))
        elif isinstance(n, If):
            branches, other = [], fold(n.other)
            for cond, body in n.branches:
                cond, body = fold_expression(cond), fold(body)
                if isinstance(cond, Const):
                    if cond.value:
                        other = body
                        break
                    continue
                branches.append((cond, body))
            if branches:
                add(If(tuple(branches), other))
            else:
                for x in other:
                    add(x)
    return tuple(out)


# closures


@dataclass
class Sink:
    parts: list[str] = field(default_factory=list)
    size: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def write(self, s: str) -> None:
        self.parts.append(s)
        self.size += len(s)


def _expression(e) -> Callable[[dict], object]:
    if isinstance(e, Const):
        value = e.value
        return lambda env: value
    if isinstance(e, Name):
        name = e.name
        return lambda env: env.get(name)
    if isinstance(e, Get):
        of, key = _expression(e.of), _expression(e.key)
        return lambda env: _get(of(env), key(env))
    if isinstance(e, Not):
        of = _expression(e.of)
        return lambda env: not of(env)
    if isinstance(e, Filter):
        f, of, args = FILTERS[e.name], _expression(e.of), [_expression(x) for x in e.args]
        if not args:
            return lambda env: f(of(env))
        return lambda env: f(of(env), *[a(env) for a in args])
    a, b, op = _expression(e.left), _expression(e.right), e.op
    if op == "and":
        return lambda env: a(env) and b(env)
    if op == "or":
        return lambda env: a(env) or b(env)
    return lambda env: _binary(op, a(env), b(env))


def _node(n) -> Callable[[dict, Sink], None]:
    if isinstance(n, Output):
        if isinstance(n.expr, Const):
            text = show(n.expr.value)
            return lambda env, out: out.write(text)
        e = _expression(n.expr)
        return lambda env, out: out.write(show(e(env)))
    if isinstance(n, Set):
        e, name = _expression(n.expr), n.name
        return lambda env, out: env.__setitem__(name, e(env))
    if isinstance(n, Generation):
        body = _nodes(n.body)

        def generation(env: dict, out: Sink) -> None:
            start = out.size
            body(env, out)
            out.spans.append((start, out.size))

        return generation
    if isinstance(n, If):
        branches, other = [(_expression(c), _nodes(b)) for c, b in n.branches], _nodes(n.other)

        def choose(env: dict, out: Sink) -> None:
            for cond, body in branches:
                if cond(env):
                    return body(env, out)
            return other(env, out)

        return choose
    over, body, name = _expression(n.over), _nodes(n.body), n.name

    def loop(env: dict, out: Sink) -> None:
        items = over(env)
        items = items if isinstance(items, (list, tuple)) else []
        inner = dict(env)
        for i, x in enumerate(items):
            inner[name] = x
            inner["loop"] = {"index0": i, "index": i + 1, "first": i == 0, "last": i == len(items) - 1}
            body(inner, out)

    return loop


def _nodes(nodes: tuple) -> Callable[[dict, Sink], None]:
    steps = [_node(n) for n in nodes]
    if len(steps) == 1:
        return steps[0]

    def run(env: dict, out: Sink) -> None:
        for s in steps:
            s(env, out)

    return run


def compile_template(source: str) -> Callable[..., tuple[str, list[tuple[int, int]]]]:
    """A function of the template's names that gives the rendered text and the spans of its generations."""
    run = _nodes(fold(parse(source)))

    def render(**names) -> tuple[str, list[tuple[int, int]]]:
        out = Sink()
        run(dict(names), out)
        return "".join(out.parts), out.spans

    return render
