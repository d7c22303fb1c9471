"""Plain Python versions that the operators' results are held against."""

from __future__ import annotations

import collections
import functools
import hashlib
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def words(t: str | None) -> list[str]:
    return WORD.findall(t or "")


# op6


def quality(t: str | None, least: int = 6) -> dict:
    t = t or ""
    w, n = words(t), len(words(t))
    seen = collections.Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    three = {j for i in range(n - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    covered, longest = set(), 0
    for i in range(n):
        best = 0
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and w[i + k] == w[j + k]:
                k += 1
            best = max(best, k)
        longest = max(longest, best)
        if best >= least:
            covered.update(range(i, i + best))
    dup, lines = 0, set()
    for x in t.split("\n"):
        if WORD.search(x):
            dup += x in lines
            lines.add(x)
    return {"n_words": n, "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_dup_lines": dup, "n_repeat_words": len(three), "covered_words": len(covered), "longest_repeat": longest}


# op5


def line_dedup(rows: list[tuple]) -> dict:
    key = lambda x: x.strip(SPACE).translate(LOWER)
    held = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 10:
                held[key(x)].add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if i is None or len(key(x)) < 10 or len(held[key(x)]) < 2 or min(held[key(x)]) == i]
        out[i, t] = (len(lines), len(lines) - len(left), sha("\n".join(left)))
    return out


# op7


def substring_dedup(rows: list[tuple], window: int = 13) -> dict:
    order = lambda i: -(1 << 63) if i is None else i
    least: dict = {}
    for i, t in rows:
        w = words(t)
        for j in range(len(w) - window + 1):
            g = tuple(w[j : j + window])
            least[g] = min(least.get(g, order(i)), order(i))
    out = {}
    for i, t in rows:
        w, gone = words(t), set()
        for j in range(len(w) - window + 1):
            if least[tuple(w[j : j + window])] < order(i):
                gone.update(range(j, j + window))
        out[i, t] = (len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


# op3


def near_duplicates(rows: list[tuple]) -> dict:
    sets = {}
    for i, t in rows:
        w = words((t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[j : j + 3]) for j in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else [])
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    inside = collections.defaultdict(list)
    for i in sorted(sets):
        for j, k in collections.Counter(j for g in sets[i] for j in inside[g]).items():
            if 100 * k >= 85 * (len(sets[i]) + len(sets[j]) - k):
                a, b = sorted((find(i), find(j)))
                top[b] = a
        for g in sets[i]:
            inside[g].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_links(rows: list[tuple]) -> dict:
    """Of each document the number of others that it is linked with."""
    sets = {}
    for i, t in rows:
        w = words((t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[j : j + 3]) for j in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else [])
    linked = lambda a, b: bool(a and b) and 100 * len(a & b) >= 85 * len(a | b)
    return {i: sum(i != j and linked(a, b) for j, b in sets.items()) for i, a in sets.items()}


# op1


def katz(rows: list[tuple], order: int, discounts) -> tuple[dict, list[float]]:
    """Scores, and the sums of some distributions."""
    import numpy as np

    texts = {i: words((t or "").translate(LOWER)) + ["</s>"] for i, t in rows}
    train = [i for i in texts if zlib.crc32(str(i).encode()) % 5 != 1]
    grams = lambda ts, m: [tuple((["<s>"] * (m - 1) + ts)[j : j + m]) for j in range(len(ts))]
    count = [collections.Counter(g for i in train for g in grams(texts[i], m)) for m in range(1, order + 1)]
    n, v = sum(count[0].values()), len(count[0])
    first = lambda w: (count[0][(w,)] + 0.5) / (n + 0.5 * (v + 1))
    d, after = [None], [None]
    for m in range(2, order + 1):
        cc = collections.Counter(count[m - 1].values())
        d.append(discounts(np.array([0] + [cc[c] for c in range(1, 7)]))[0])
        f = collections.defaultdict(list)
        for g, c in count[m - 1].items():
            f[g[:-1]].append((g[-1], c))
        after.append(f)
    keep = lambda m, c: c * d[m - 1][c] if c <= 5 else c

    @functools.cache
    def history(m, h):
        f = after[m - 1].get(h)
        if not f:
            return 0, 1.0
        kept, total = sum(keep(m, c) for _, c in f), sum(c for _, c in f)
        den = total + 1 if kept >= total else total
        return den, (1 - kept / den) / (1 - sum(p(m - 1, h[1:] + (w,)) for w, _ in f))

    def p(m, g):
        if m == 1:
            return first(g[0])
        c = count[m - 1][g]
        den, alpha = history(m, g[:-1])
        return keep(m, c) / den if c else alpha * p(m - 1, g[1:])

    sums = [sum(p(order, h + (w,)) for (w,) in count[0]) + p(order, h + ("\0",)) for h in list(after[order - 1])[:4]] if order > 1 else []
    scores = {i: (len(ts), sum(count[0][(w,)] > 0 for w in ts), n, sum(math.log10(first(w)) for w in ts), sum(math.log10(p(order, g)) for g in grams(ts, order))) for i, ts in texts.items()}
    return scores, sums


# op4


def mixture(rows: list[tuple], mix) -> list[tuple]:
    """rows of (id, text, lang, source) to sorted (id, epoch)."""

    def domain(s):
        m = re.search(r"([0-9]{1,9})$", s)
        return f"d{int(m[1]) % 4}" if m else "other"

    leaves = collections.defaultdict(list)
    for i, t, lang, source in rows:
        leaves[domain(source or ""), lang or "", source or ""].append((i, len(words(t))))
    tokens = {k: sum(n for _, n in v) for k, v in leaves.items()}
    tokens = {k: n for k, n in tokens.items() if n}

    def fill(budget, rooms, weights):
        """Shares by weight; whoever is full leaves the rest to the others."""
        out, open_ = dict.fromkeys(rooms, 0.0), sorted(rooms, key=lambda k: (rooms[k] / weights[k], k))
        left = budget
        while open_:
            rate = left / sum(weights[k] for k in open_)
            full = [k for k in open_ if rooms[k] <= weights[k] * rate]
            if not full:
                return out | {k: weights[k] * rate for k in open_}
            for k in full:
                out[k] = float(rooms[k])
                left -= rooms[k]
                open_.remove(k)
        return out

    def down(prefix, budget):
        depth = len(prefix)
        mine = [k for k in tokens if k[:depth] == prefix]
        if depth == 3:
            return {prefix: budget}
        rooms = collections.Counter()
        for k in mine:
            rooms[k[depth]] += tokens[k] * mix.max_epochs
        names, default = ((mix.domains, mix.default), (mix.languages, mix.default), (mix.sources, 1.0))[depth]
        shares = fill(budget, rooms, {k: names.get(k, default) for k in rooms})
        return {k: b for c in rooms for k, b in down((*prefix, c), shares[c]).items()}

    out = []
    for k, b in down((), mix.share * sum(tokens.values())).items():
        take = math.floor(b + 0.001)
        whole, rest = divmod(take, tokens[k])
        out += [(i, e) for e in range(whole) for i, _ in leaves[k]]
        if rest:
            digest = lambda i: hashlib.md5(f"{mix.seed}:{whole}:{'' if i is None else i}".encode()).hexdigest()  # noqa: B023,E731
            before, last = 0, None
            for i, n in sorted(leaves[k], key=lambda x: digest(x[0])):
                if before >= rest and digest(i) != last:
                    break
                out.append((i, whole))
                before, last = before + n, digest(i)
    return sorted(out, key=repr)
