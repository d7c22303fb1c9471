"""Maximal repeats against brute force."""

from __future__ import annotations

import collections
import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute
from test_text_ops import frame

from quarry.llm import suffixtree


def repeats(rows, least, depth):
    """All word runs of least..depth words that occur twice and can't be extended to either side at all their places."""
    at = collections.defaultdict(list)
    texts = {i: brute.words(t) for i, t in rows}
    for i, w in texts.items():
        for p in range(len(w)):
            for k in range(least, min(depth, len(w) - p) + 1):
                at[tuple(w[p : p + k])].append((i, p))
    out = set()
    for g, places in at.items():
        if len(places) < 2:
            continue
        right = {texts[i][p + len(g)] if p + len(g) < len(texts[i]) else (i, p) for i, p in places}
        left = {texts[i][p - 1] if p else (i, p) for i, p in places}
        if len(left) > 1 and (len(right) > 1 or len(g) == depth):
            out.add((len(g), len(places), len({i for i, _ in places}), *min(places), " ".join(g)))
    return out


@pytest.mark.parametrize("group", [100_000, 7])
def test_maximal_repeats(spark, group):
    rng = random.Random(4)
    part = [" ".join(rng.choice("abcdef") + str(rng.randint(0, 4)) for _ in range(rng.randint(4, 12))) for _ in range(5)]
    rows = [(i, "\n".join(rng.choice(part) for _ in range(rng.randint(0, 4)))) for i in range(25)] + [(90, None), (91, ""), (92, "a1")]
    got = suffixtree.maximal_repeats(frame(spark, rows, node=1, h0=2, id=3), min_words=4, depth=32, group=group).collect()
    assert {tuple(r) for r in got} == repeats(rows, 4, 32) and len(got) == len(set(got))


def test_hot_passage_is_one_node(spark):
    rows = [(i, "p q r s t u v w x y") for i in range(50)]
    got = suffixtree.maximal_repeats(frame(spark, rows), min_words=4, depth=8, group=10).collect()
    assert ("p q r s t u v w", 50) in {(r["text"], r["occurrences"]) for r in got}
    assert suffixtree.maximal_repeats(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("group", [100_000, 3])
def test_long_passages_are_whole(spark, group):
    """Passages beyond the depth that suffixes are first read to, against brute force without a bound."""
    long, other = " ".join(f"w{i}" for i in range(200)), " ".join(f"v{i}" for i in range(70))
    rows = [(1, f"a {long} b {other}"), (2, f"c {long} d"), (3, f"e {other} f"), (4, f"g {long}"), (5, f"h {long.rsplit(' ', 60)[0]} i")]
    got = suffixtree.maximal_repeats(frame(spark, rows), group=group).collect()
    assert {tuple(r) for r in got} == repeats(rows, 13, 10_000) and len(got) == len(set(got))
    assert {r["n_words"] for r in got} == {200, 140, 70}
