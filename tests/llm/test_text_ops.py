"""Operators on texts against brute force, with nulls, blanks, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import random
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

from quarry.llm import linestore, quality, storage, substrings
from quarry.llm import textkernel as tk

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma"


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    lines = [" ".join(rng.choice("ab é the of ÄX qu 日本 line word".split()) for _ in range(rng.randint(0, 9))) for _ in range(25)] + [LONG, "  A Shared Licence Line\t", "a shared licence line"]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(0, 12))) for _ in range(n)]
    texts += [None, "", "\n", " \t", LONG, LONG + " more", "x " * 40, "é" * 9 + "\n" + "é" * 10, "é" * 10, "one\r\none two"]
    return [(i * 3, t) for i, t in enumerate(texts)]


def frame(spark, rows, **clash):
    df = spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in rows], DOCS)
    return df.withColumns({c: F.lit(v) for c, v in clash.items()})


def test_words_and_hashes():
    texts = ["a b", "", None, "b", "  x\ty\x0bz ", "é b"]
    words, hashes = [], {}
    for c in tk.chunks(tk.strings(pa.array(texts)), size=4):
        s, e, d = c.words()
        data = c.buf.tobytes()
        for i, j, k, h in zip(s, e, d, tk.span_hash(c.prefix(), s, e)):
            words.append((c.lo + int(k), data[i:j].decode()))
            hashes.setdefault(data[i:j], set()).add(int(h))
    assert words == [(0, "a"), (0, "b"), (3, "b"), (4, "x"), (4, "y"), (4, "z"), (5, "é"), (5, "b")]
    assert all(len(v) == 1 for v in hashes.values()) and len(set().union(*hashes.values())) == len(hashes)


def test_long_word_is_one_chunk():
    big = "z" * 3_000_000
    cs = list(tk.chunks(pa.array(["a", big, "b"])))
    assert sum(len(c) for c in cs) == 3 and sum(len(c.words()[0]) for c in cs) == 3


# quality


def test_quality_measures():
    rng = random.Random(3)
    texts = [t for _, t in corpus()] + ["".join(rng.choice(["a ", "b ", "c\n", "\n", "é\t", "#* "]) for _ in range(rng.randint(0, 120))) for _ in range(150)]
    got = quality.judged(pa.array(texts))
    for i, t in enumerate(texts):
        assert {k: got[k][i] for k in brute.quality(None)} == brute.quality(t), t


def test_quality_verdicts(spark):
    rng = random.Random(5)
    clean = " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(300))
    half = " ".join(f"v{i}" for i in range(100))
    rows = [(1, clean), (2, "short text"), (3, "spam it " * 60), (4, half + " " + half), (5, clean + " " + " ".join(f"u{i}" for i in range(45)) * 1), (6, None)]
    got = {r["doc_id"]: r for r in quality.score_quality(frame(spark, rows, kept=True, n_words=1)).collect()}
    assert [got[i]["kept"] for i in range(1, 7)] == [True, False, False, False, True, False] and got[2]["base_failed"] and got[6]["n_words"] == 0
    part = " ".join(f"p{i}" for i in range(45))
    doc = " ".join([part, *[f"q{i}" for i in range(15)], part])  # 86 % covered, but base counts the same words
    m = quality.judge(quality.measure(next(tk.chunks(pa.array([doc + " " + " ".join(f"r{i}" for i in range(90))])))))
    assert not m["base_failed"][0] and not m["kept"][0]
    kept = quality.filter_quality(frame(spark, rows, kept=True))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 5] and kept.columns[-1] == "kept"
    assert quality.score_quality(frame(spark, rows).limit(0)).count() == 0


def test_suffix_array():
    rng = np.random.default_rng(2)
    for n in (1, 2, 30, 200):
        key = np.append(rng.integers(0, 3, n), -1)
        sa, levels = quality.suffix_array(key)
        suffixes = [tuple(key[i:].tolist()) for i in sa]
        assert suffixes == sorted(suffixes)
        lcp = quality.neighbours_lcp(sa, levels)
        for i in range(1, len(sa)):
            k = 0
            while k < min(len(suffixes[i]), len(suffixes[i - 1])) and suffixes[i][k] == suffixes[i - 1][k]:
                k += 1
            assert lcp[i] == k


# lines


def lines_of(df):
    return {(r["doc_id"], r["text"]): (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in df.collect()}


@pytest.mark.parametrize("hot", [1, 1000])
def test_line_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(linestore, "HOT_SHARE", hot if hot > 1 else 30)
    rows = corpus() + [(0, "a shared licence line"), (None, "a shared licence line\nx"), (9, LONG)]
    rows = list(dict.fromkeys(rows))
    df = frame(spark, rows, k1=1, keys="x", id=5, lost_id=3)
    got = linestore.dedup_lines(df).collect()
    want = brute.line_dedup(rows)
    assert len(got) == len(rows) and sorted(brute.sha(r["text"] or "") for r in got) == sorted(v[2] for v in want.values())
    digest = linestore.line_digest(df).collect()
    assert sorted((r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in digest) == sorted(want.values())
    assert linestore.line_digest(df.limit(0)).count() == 0


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(1, 2**63, 20_000, dtype=np.uint64))
    f = linestore.CuckooFilter.load(linestore.CuckooFilter.of(keys).dump())
    assert f.contains(keys).all()
    other = rng.integers(1, 2**63, 20_000, dtype=np.uint64)
    assert f.contains(other).mean() < 0.002
    f.delete(keys[:500])
    assert f.contains(keys[500:]).all() and f.contains(keys[:500]).mean() < 0.01
    assert not linestore.CuckooFilter.of(np.zeros(0, np.uint64)).contains(keys).any()


def test_store_is_reversible(spark, tmp_path):
    rows = [r for r in corpus(2, 30)]
    path = str(tmp_path)
    store = linestore.LineStore(spark, path, shards=3)
    half = frame(spark, rows[::2])
    store.insert(half)
    before = sorted((r["k1"], r["k2"], r["refs"], r["least"]) for r in store.counts().collect())
    store = linestore.LineStore(spark, path)  # opened again: goes on where it stood
    assert store.shards == 3 and store.state["version"] == 1
    store.insert(frame(spark, rows[1::2]))
    store.insert(half)  # already held
    whole = {r["doc_id"]: r["text"] for r in store.dedup(frame(spark, rows)).collect()}
    assert {k: brute.sha(v or "") for k, v in whole.items()} == {k[0]: v[2] for k, v in brute.line_dedup(rows).items()}
    held = {(r["k1"], r["k2"]) for r in store.counts().where("least <> most").collect()}
    kept = {r["shard"]: linestore.CuckooFilter.load(bytes(r["filter"])) for r in store.filters().collect()}
    assert sum(int((f.table > 0).sum()) for f in kept.values()) == len(held)
    assert all(kept[a % 3].contains(linestore.filter_key(np.array([a]), np.array([b])))[0] for a, b in held)
    store = linestore.LineStore(spark, path)
    other = linestore.LineStore(spark, path)
    store.delete(frame(spark, rows[1::2]))
    assert sorted((r["k1"], r["k2"], r["refs"], r["least"]) for r in store.counts().collect()) == before
    left = {r["doc_id"]: brute.sha(r["text"] or "") for r in store.dedup(half).collect()}
    assert left == {k[0]: v[2] for k, v in brute.line_dedup(rows[::2]).items()}
    with pytest.raises(RuntimeError):
        other.delete(half)  # it was opened before the last change
    store.vacuum()
    again = linestore.LineStore(spark, path, shards=99)
    assert {r["doc_id"]: brute.sha(r["text"] or "") for r in again.dedup(half).collect()} == left
    again.delete(half)
    assert again.counts().count() == again.ids().count() == 0
    again.insert(half)
    assert sorted((r["k1"], r["k2"], r["refs"], r["least"]) for r in again.counts().collect()) == before


def test_a_change_rewrites_its_shards_only(spark, tmp_path):
    store = linestore.LineStore(spark, str(tmp_path), shards=16)
    store.insert(frame(spark, [(i, f"line number {i} of them\nthe same line again") for i in range(40)]))
    was = dict(store.state["parts"])
    store.insert(frame(spark, [(100, "one single new line")]))
    changed = {s for s, v in store.state["parts"].items() if was.get(s) != v}
    assert len(was) > 8 and len(changed) == 1
    store.delete(frame(spark, [(100, None)]))
    assert store.ids().count() == 40


# substrings


@pytest.mark.parametrize("unit_bytes", [400, 1 << 24])
def test_substring_dedup(spark, unit_bytes):
    rng = random.Random(8)
    part = [" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 9)) for _ in range(rng.randint(10, 30))) for _ in range(6)]
    rows = [(i, " ".join(rng.choice(part) for _ in range(rng.randint(0, 4)))) for i in rng.sample(range(1000), 50)]
    rows += [(5000, None), (5001, ""), (5002, "a b c"), (rows[0][0], part[0] + " tail"), (None, part[1]), (-4, part[2] + "\n" + part[3])]
    rows = list(dict.fromkeys(rows))
    df = frame(spark, rows, unit=1, key=2, id=3)
    got = substrings.repeat_digest(df, unit_bytes=unit_bytes).collect()
    assert sorted((r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == sorted(brute.substring_dedup(rows).values())
    texts = substrings.remove_repeats(df, unit_bytes=unit_bytes).collect()
    assert sorted(brute.sha(r["text"]) for r in texts) == sorted(v[2] for v in brute.substring_dedup(rows).values())
    assert substrings.repeat_digest(df.limit(0)).count() == 0


def test_shared_folder_comes_from_the_session(spark):
    class Session:
        def __init__(self, folder, master):
            self.conf, self.sparkContext = self, type("C", (), {"master": master})
            self.folder = folder

        def get(self, name, default):
            return self.folder if name == "spark.checkpoint.dir" and self.folder else default

    assert storage.shared_dir(Session("hdfs://somewhere/shared/", "yarn")) == "hdfs://somewhere/shared"
    assert storage.shared_dir(Session(None, "local[2]")).startswith("file://")
    with pytest.raises(ValueError):
        storage.shared_dir(Session(None, "yarn"))
    assert storage.written(spark.range(3), "t").count() == 3
