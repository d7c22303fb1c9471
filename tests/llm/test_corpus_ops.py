"""Models, joins and packing against brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import collections
import random
import sys
import time
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute
from test_text_ops import DOCS, frame

from quarry.llm import ctph, graph, katz, mixing, neardup, packing
from quarry.llm import textkernel as tk
from quarry.llm import units as un

SMALL = "/root/testdata/sf0.001"


def small(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    return df, [(r["doc_id"], r["text"]) for r in df.collect()]


# compact columns


def test_compact_columns():
    rng = np.random.default_rng(1)
    h = np.sort(rng.integers(0, 2**63, 1000, dtype=np.uint64) * np.uint64(2))
    for x in (h, h[:1], np.array([0, 0, 2**64 - 1], np.uint64)):
        assert (un.expand_sorted(un.squeeze_sorted(x)) == x).all()
    c = rng.integers(0, 5, 1000)
    assert (un.expand(un.squeeze(c), np.int64) == c).all() and len(un.squeeze(c)) < 600


# op1


def test_katz_registered_order(spark):
    rows = [(i, "a b c a b d e f a b c") for i in range(6)] + [(9, "x b c"), (10, "c a b c")]
    df = frame(spark, rows)
    score = lambda **k: {r["doc_id"]: r["score"] for r in katz.score_corpus(df, **k).collect()}
    got = score()
    assert got == pytest.approx(score(order=3)) and got != pytest.approx(score(order=2))


@pytest.mark.parametrize(("order", "unit_bytes"), [(1, 1 << 24), (2, 20_000), (3, 30_000), (3, 4_000), (4, 20_000)])
def test_katz(spark, order, unit_bytes):
    df, rows = small(spark)
    rows = rows[:60] + [(9001, None), (9002, ""), (9003, "The THE the"), (-5, "unheard words only")]
    df = frame(spark, rows, unit=1, score=2.0, id=9)
    want, sums = brute.katz(rows, order, katz.discounts)
    assert all(abs(s - 1) < 1e-9 for s in sums)
    got = katz.score_corpus(df, order=order, unit_bytes=unit_bytes).collect()
    assert len(got) == len(rows)
    for r in got:
        n, known, total, base, score = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)
        assert abs(r["base_score"] - base) < 1e-6 and abs(r["score"] - score) < 1e-6


def test_katz_edges(spark, tmp_path):
    assert katz.score_corpus(frame(spark, [(1, "a")]).limit(0)).count() == 0
    one = katz.score_corpus(frame(spark, [(7, "a b"), (7, "a b"), (None, "c")])).collect()
    assert len(one) == 3 and all(np.isfinite(r["score"]) for r in one)
    out = [i for i in range(40) if katz.held_out(i)]
    only = katz.score_corpus(frame(spark, [(i, "x y") for i in out[:3]])).collect()  # nothing to learn from
    assert all(r["train_tokens"] == 0 and r["score"] == 0 and r["n_known"] == 0 for r in only)


def test_katz_memory_of_scoring():
    """What scoring a unit holds at most: two of them run beside an executor's heap."""
    rng = np.random.default_rng(2)
    words = np.array([f"w{i}" for i in range(30_000)])
    texts = [" ".join(words[np.minimum(rng.zipf(1.3, 150), 30_000) - 1]) for _ in range(2_000)]
    rows = pa.record_batch([pa.array([i for i in range(4_000) if not katz.held_out(i)][:2_000]), pa.array(texts)], ["id", "text"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as w:
        w.write_batch(rows)
    own = pa.table({"unit": pa.array([0], pa.int32()), "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})
    k = katz._Katz(1, 3)
    tokens = katz._Tokens(rows.column(1), 3)
    train, told, below = np.ones(len(tokens.tok), bool), [], None
    for m in range(1, 4):
        x = katz._Level(tokens, m, train, below, int(k.spare))
        x.shared[:] = True
        # as a unit that shares all n-grams and is the first to hold them
        told += [{"kind": m, "bucket": 0, "reply": un.squeeze(4 * x.count + 3), "stats": None}, {"kind": m, "bucket": -1, "reply": None, "stats": [m, *katz._counts(x.count).tolist()]}]
        if m > 1:
            n = int((below.count[np.unique(below.inv[:-1][tokens.since[1:] > 0])] > katz.GT_MAX).sum()) + 1
            told.append({"kind": 100 + m, "bucket": 0, "reply": katz._two(un.squeeze(np.ones(6 * n, np.int64)), un.squeeze(np.ones(n, np.int64))), "stats": None})
        below = x
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("bucket", pa.int32()), ("reply", pa.binary()), ("stats", pa.list_(pa.int64()))]))
    replies = pa.table({"unit": pa.array([0], pa.int32()), "c1": pa.array([told], kind)})
    n = len(tokens.tok)
    del tokens, x, below, told
    tracemalloc.start()
    k.scores(own, replies)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 98 * n  # bytes a token; 111 when arrays of earlier steps were held on


def test_katz_saved(spark, tmp_path):
    rows = [(i, t) for i, t in small(spark)[1][:40]]
    df = frame(spark, rows)
    want, _ = brute.katz(rows, 3, katz.discounts)
    katz.save_model(df, str(tmp_path / "m"), order=3, unit_bytes=20_000)
    assert (tmp_path / "m/ngrams/level=2").exists()
    for r in katz.score_saved(spark, str(tmp_path / "m"), df).collect():
        assert abs(r["score"] - want[r["doc_id"]][4]) < 1e-6


def test_discounts():
    d, ok = katz.discounts(np.array([0, 1000, 300, 150, 90, 60, 40]))
    assert ok and (d[1:] > 0).all() and (d[1:] < 1).all()
    d, ok = katz.discounts(np.array([0, 5, 0, 9, 0, 0, 0]))
    assert not ok and (d[1:] > 0).all() and (d[1:] < 1).all()


# op3


def variants(seed: int = 4) -> list[tuple]:
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, i = [], 10
    for _ in range(8):
        base = [rng.choice(vocab) for _ in range(rng.randint(20, 160))]
        for _ in range(rng.randint(1, 9)):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            rows.append((i, " ".join(t)))
            i += rng.randint(1, 5)
    rows += [(1000, None), (1001, ""), (1002, "one"), (1003, "One"), (1004, "one two"), (1005, "ONE  two"), (1006, "one two three"), (1007, rows[0][1]), (1008, "two one")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("block", "node"), [(4096, 250_000), (3, 250_000), (4096, 6)])
def test_near_duplicates(spark, monkeypatch, block, node):
    monkeypatch.setattr(neardup, "NODE", node)
    rows = variants()
    df = frame(spark, rows, n=1, rep=2, cluster=3, id=4, component_id=5)
    want = brute.near_duplicates(rows)
    got = neardup.near_duplicates(df, block=block).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want and len(got) == len(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert {r["doc_id"]: r["n_links"] for r in got} == brute.near_links(rows)


def test_exact_links_of_a_long_chain_and_of_unlinked_sets():
    rng = np.random.default_rng(3)
    chain = [np.sort(rng.choice(2**40, 200, replace=False).astype(np.uint64))]
    for _ in range(4000):
        keep = rng.choice(200, 185, replace=False)
        chain.append(np.unique(np.r_[chain[-1][keep], rng.integers(2**41, 2**42, 15, dtype=np.uint64)]))
    began = time.time()
    ids, one = rng.permutation(len(chain)), np.ones(len(chain), np.int64)
    links, degree = neardup.exact_links(ids, chain, one)
    assert len(links) == len(chain) - 1 and (degree >= 1).all() and (degree <= 4).all()
    template = rng.integers(0, 2**40, 170, dtype=np.uint64)
    apart = [np.unique(np.r_[template, rng.integers(2**41, 2**42, 30, dtype=np.uint64)]) for _ in range(3000)]
    assert neardup.exact_links(np.arange(3000), apart, one[:3000])[0] == []
    same = [np.unique(np.r_[template, rng.integers(2**41, 2**42, 3, dtype=np.uint64)]) for _ in range(2000)]
    links, degree = neardup.exact_links(np.arange(2000), same, np.full(2000, 2))
    assert len(links) == 1999 and (degree == 2 * 1999).all()
    halves = np.arange(2000) >= 1000
    assert (neardup.exact_links(np.arange(2000), same, one[:2000], halves)[1] == 1000).all()
    assert time.time() - began < 60


def test_near_duplicate_edges(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (3, "A b c  d"), (None, "a b c d")]
    got = neardup.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in got) == [(-1, -1, True), (3, 3, True), (5, 3, False), (5, 3, False)]
    kept = neardup.deduplicate(frame(spark, rows, gone_id=1, kept=False))
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 3] and kept.columns[-1] == "kept"
    assert neardup.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_node_links_span_all_candidates():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 256, (5, neardup.MINHASHES), dtype=np.uint8)
    sketch = np.concatenate([np.repeat(base, 500, 0), rng.integers(0, 256, (500, neardup.MINHASHES), dtype=np.uint8)])
    change = rng.random(sketch.shape) < 0.06
    sketch = np.where(change, rng.integers(0, 256, sketch.shape, dtype=np.uint8), sketch)
    ids = np.arange(len(sketch))
    top = ids.copy()

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    links = [x for seed in range(4) for x in neardup.node_links(ids, ids, sketch, seed)]  # branching misses some; trees are independent
    assert sum(len(a) for a, _ in links) < 4 * 4 * len(ids)  # far fewer than pairs
    for a, b in links:
        for x, y in zip(a.tolist(), b.tolist()):
            top[find(y)] = find(x)
    for g in range(5):
        assert len({find(i) for i in range(g * 500, g * 500 + 500)}) == 1
    assert len({find(i) for i in ids}) == 505


def test_components(spark, monkeypatch):
    path = [(i, i + 1) for i in range(30)] + [(100, 200), (200, 150), (7, 7)]
    df = spark.createDataFrame([(b, a) for a, b in path], "a long, b long")
    for local in (0, 1_000_000):
        got = {r["node"]: r["label"] for r in graph.components(df, local_edges=local).collect()}
        assert got == {i: 0 for i in range(31)} | {100: 100, 150: 100, 200: 100}
    assert graph.components(df.limit(0)).count() == 0
    monkeypatch.setattr(graph, "HOT", 5)  # every large centre is hot
    monkeypatch.setattr(graph, "HOT_NODES", 4)
    star = spark.range(1, 400).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b")).unionAll(spark.createDataFrame([(399, 500)], "a long, b long"))
    assert {r["label"] for r in graph.components(star, local_edges=0).collect()} == {0}


# op4


@pytest.mark.parametrize(("mix", "few"), [(mixing.Mix(), 0), (mixing.Mix(max_epochs=1), 100), (mixing.Mix(share=3.5, max_epochs=3, seed=4), 0), (mixing.Mix(share=99.0), 100)])
def test_mixture(spark, monkeypatch, mix, few):
    monkeypatch.setattr(mixing, "LEAVES_BROADCAST", few)
    monkeypatch.setattr(mixing, "SALTS", 4)
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(0, 30), rng.choice(["en", "en", "en", "de", "fr", None]), rng.choice(["src0"] * 6 + ["src1", "src2", "src5", "blog", None])) for i in range(200)]
    rows += [(3, "again", "en", "src0"), (900, None, "en", "src0"), (None, "x y", "xx", "lone1")]
    df = spark.createDataFrame([(i, t, a, b, 0) for i, t, a, b in rows], DOCS).withColumn("epoch", F.lit(7)).withColumn("domain", F.lit("z"))
    got = mixing.mixture(df, mix)
    assert sorted(((r["doc_id"], r["epoch"]) for r in got.collect()), key=repr) == brute.mixture(rows, mix)
    docs = mixing.mix_documents(df, mix)
    assert docs.columns == df.columns and docs.count() == len(brute.mixture(rows, mix))
    assert mixing.mixture(df.limit(0), mix).count() == 0


def test_mixture_reaches_weights(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(1, 20), "en", f"src{rng.choice([0, 0, 0, 0, 1, 2, 3])}", 0) for i in range(3000)]
    mix = mixing.Mix(domains={"d0": 0.1, "d1": 0.2, "d2": 0.3, "d3": 0.4}, share=0.3, max_epochs=1)
    got = {r["domain"]: r["t"] for r in mixing.mixture(spark.createDataFrame(rows, DOCS), mix).groupBy("domain").agg(F.sum("n_tokens").alias("t")).collect()}
    whole = sum(got.values())
    assert all(abs(got[d] / whole - w) < 0.01 for d, w in mix.domains.items())


# op8


def test_token_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    whole, fast = Tokenizer.from_file(path), packing.PieceTokenizer(path)
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "\r\n", "a", "B", "é", " ", " ", "　", " ", "\x85", "1", "23", "'s", "'ll", "!", "##", "<|endoftext|>", "word", "the", "\x1c", "日本", "🙂", "​", "\n\n", "<"]
    texts = [None, "", " ", "\n", "word" * 3000, " x" * 2000, *["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(4000)]]
    ids, size = fast.encode(tk.strings(pa.array(texts)))
    for t, x in zip(texts, np.split(ids, np.cumsum(size)[:-1])):
        assert x.tolist() == [*whole.encode(t or "", add_special_tokens=False).ids, 0], t


@pytest.mark.parametrize("unit_bytes", [20_000, 1 << 24])
def test_packing(spark, unit_bytes):
    df, rows = small(spark)
    rows = rows[:80] + [(7001, None), (7002, ""), (7003, rows[0][1]), (7004, "long text " * 4000)]
    got = packing.pack(frame(spark, rows, s0=1, ids="x", sequence_id=2), unit_bytes=unit_bytes, with_ids=True).collect()
    whole = packing.PieceTokenizer(packing.tokenizer_path()).tokenizer
    docs, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        docs[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append(r)
        assert r["length"] == len(r["ids"]) > 0 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    for i, t in rows:
        own = sorted(docs[i], key=lambda r: r["start"])
        assert [x for r in own for x in r["ids"]] == [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        assert [r["start"] for r in own] == np.cumsum([0, *[r["length"] for r in own]])[:-1].tolist() and own[0]["doc_tokens"] == sum(r["length"] for r in own)
    for s in seqs.values():
        s.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in s] == np.cumsum([0, *[r["length"] for r in s]])[:-1].tolist()
        n = sum(r["length"] for r in s)
        assert n == 1024 or (n < 1024 and n & (n - 1) == 0)
    assert packing.pack(df.limit(0)).count() == 0


def test_packing_repeated_and_null_rows(spark):
    got = packing.pack(frame(spark, [(1, "a b"), (1, "a b"), (None, "c"), (None, None)])).collect()
    assert sum(r["length"] for r in got) == 3 + 3 + 2 + 1


def test_paths_join_related_documents():
    rng = np.random.default_rng(1)
    topics = [rng.integers(0, 2**63, 30, dtype=np.uint64) for _ in range(10)]
    of = rng.integers(0, 10, 200)
    low = np.stack([(rng.choice(topics[t], 20, replace=False)[:, None] * packing._FACTORS[None, :]).min(0) for t in of])
    order = packing.walk(packing.neighbours(low))
    assert sorted(order) == list(range(200))
    assert (of[order][1:] == of[order][:-1]).mean() > 0.6


def neighbour_recall(low, near):
    """The share of each document's four nearest, by brute force, that are found or replaced by equally near ones."""
    hit = total = 0
    for i, found in enumerate(near):
        like = (low == low[i]).sum(1)
        like[i] = 0
        top = np.sort(like)[::-1][: packing.NEIGHBOURS]
        top = top[top >= packing.ALIKE]
        hit += sum(like[j] >= top[-1] for j in found) if len(top) else 0
        total += len(top)
    return hit / total


def test_neighbours_within_a_hot_minwise_value():
    """600 documents of one template, five to a topic: the four nearest lie anywhere in the runs of the template's words."""
    rng = np.random.default_rng(2)
    template, topics = rng.integers(0, 2**63, 40, dtype=np.uint64), rng.integers(0, 2**63, (120, 25), dtype=np.uint64)
    low = np.stack([(np.r_[template, rng.choice(topics[i % 120], 20, replace=False)][:, None] * packing._FACTORS[None, :] >> np.uint64(32)).min(0) for i in range(600)]).astype(np.uint32)
    near = packing.neighbours(low)
    assert neighbour_recall(low, near) > 0.9
    same = packing.neighbours(np.repeat(low[:1], 500, 0))  # equal ones are each other's nearest, however many
    assert all(len(x) == packing.NEIGHBOURS and i not in x for i, x in enumerate(same))


def test_related_documents_meet_over_several_units(spark):
    """60 topics of 5 documents that share 40 % of their words, in about 12 units: most of a topic lands in one unit, and the graph is that of brute force."""
    rng = random.Random(6)
    topics = [[f"t{t}w{i}" for i in range(40)] for t in range(60)]
    rows = [(i, " ".join(rng.sample(topics[i % 60], 30) + [f"d{i}n{k}" for k in range(12)])) for i in range(300)]
    df = frame(spark, rows)
    units = {r["doc_id"]: r["sequence_id"] >> 40 for r in packing.pack(df, unit_bytes=10_000).collect()}
    assert len(set(units.values())) > 5
    assert np.mean([units[i] == units[j] for i in units for j in units if i < j and i % 60 == j % 60]) > 0.8
    low = np.concatenate([packing.minwise(c) for c in tk.chunks(tk.strings(pa.array([t for _, t in rows])))])
    nodes = spark.createDataFrame([(i, 100, x.tobytes()) for i, x in enumerate(low)], "node long, size long, low binary")
    for band in (packing.BAND, 3):
        near = {r["node"]: np.frombuffer(r["near"], np.int64).tolist() for r in packing.neighbour_graph(nodes, band).collect()}
        assert neighbour_recall(low, [near.get(i, []) for i in range(300)]) > (0.95 if band > 3 else 0.5)
    edges = packing._edges(packing.neighbour_graph(nodes))
    for local in (0, 1000_000):  # by rounds over the table, and by the driver
        of = dict(packing._clusters(nodes, edges, 500, local).collect())
        assert len(of) == 300 and max(collections.Counter(of.values()).values()) <= 5
        assert np.mean([of[i] == of[j] for i in of for j in of if i < j and i % 60 == j % 60]) > 0.8


@pytest.mark.parametrize("cap", [10_000, 2_000])
def test_clusters_of_a_hub_take_few_turns(spark, monkeypatch, cap):
    """A node with 80 links, which would take 80 turns if it were joined to one other at a time; each turn is a shuffle of the whole table."""
    nodes = spark.createDataFrame([(i, 100 + i % 3) for i in range(81)], "node long, size long")
    edges = spark.createDataFrame([(0, i, 2 + i % 5) for i in range(1, 81)], "a long, b long, like byte")
    turns, written = [], packing.storage.written
    monkeypatch.setattr(packing.storage, "written", lambda df, name: (turns.append(name), written(df, name))[1])
    of = dict(packing._clusters(nodes, edges, cap, 5).collect())
    assert turns.count("merges") <= 16
    size = collections.Counter()
    for i in range(81):
        size[of[i]] += 100 + i % 3
    assert len(of) == 81 and max(size.values()) <= cap
    assert size[of[0]] > cap - 103 or len(size) == 1  # full, or all are joined
    if cap == 2_000:
        like = {i: 2 + i % 5 for i in range(1, 81)}
        assert np.mean([like[i] for i in like if of[i] == of[0]]) > 4.5  # the most alike first; 4 on average


# op10


def scalar_print(t: str | None) -> str:
    b = (t or "").encode()
    if not b:
        return "4::"
    c = tk.Chunk(0, 1, np.frombuffer(b, np.uint8), np.array([0, len(b)]))
    p = c.prefix()
    h = lambda s, e: int(tk.span_hash(p, np.array([s]), np.array([e]))[0])
    roll = [h(max(0, i - 6), i + 1) for i in range(len(b))]
    ends = lambda k: [i for i, r in enumerate(roll) if r & ((1 << k) - 1) == (1 << k) - 1]
    k = 2
    while len(b) > (64 << k):
        k += 1
    while k > 2 and len(ends(k)) < 31:
        k -= 1
    letters = ctph._ALPHABET.tobytes().decode()

    def sig(k, wide):
        out, s = "", 0
        for i in ends(k)[: wide - 1]:
            out, s = out + letters[h(s, i + 1) & 63], i + 1
        return out + (letters[h(s, len(b)) & 63] if s < len(b) else "")

    return f"{1 << k}:{sig(k, 64)}:{sig(k + 1, 32)}"


def scalar_likeness(f: str, g: str) -> float:
    if f == g:
        return 1.0
    (k, a, b), (m, c, d) = f.split(":"), g.split(":")

    def score(x, y):
        r = min(7, max(min(len(x), len(y)) // 2, min(len(x), len(y), 1)))
        if not r or not any(x[i : i + r] in y for i in range(len(x) - r + 1)):
            return 0.0
        row = [0] * (len(y) + 1)
        for ch in x:
            last = 0
            for j, e in enumerate(y):
                last, row[j + 1] = row[j + 1], last + 1 if ch == e else max(row[j + 1], row[j])
        return 2 * row[-1] / (len(x) + len(y))

    k, m = int(k), int(m)
    return max([score(a, c), score(b, d)] if k == m else [score(a, d)] if k == 2 * m else [score(b, c)] if m == 2 * k else [0.0])


@pytest.mark.parametrize("unit_bytes", [9_000, 1 << 24])
def test_fingerprints(spark, unit_bytes):
    _, rows = small(spark)
    rows = [(i, t[:3000]) for i, t in rows[:40]] + [(500, None), (501, ""), (502, "é" * 50), (503, rows[0][1][:3000]), (-1, "tiny"), (504, "And " * 700)]
    got = {r["doc_id"]: r for r in ctph.compare_edits(frame(spark, rows, unit=1, key=2, extra=3, fingerprint="x"), unit_bytes=unit_bytes).collect()}
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: -r[0])
    assert len(got) == len(rows)
    for n, (i, t) in enumerate(order):
        nxt = order[(n + 1) % len(order)][1]
        k = len(t) // 3
        edited = t[: len(t) - k] + nxt[:k]
        f, g = scalar_print(t), scalar_print(edited)
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(t), brute.sha(edited), f, g)
        assert abs(r["near_edited"] - scalar_likeness(f, g)) < 1e-12 and abs(r["near_next"] - scalar_likeness(f, scalar_print(nxt))) < 1e-12
    assert got[503]["fingerprint"] == got[rows[0][0]]["fingerprint"]


def test_fingerprint_edges(spark):
    one = ctph.compare_edits(frame(spark, [(1, "only one")])).first()
    assert one["near_next"] == 1.0
    got = ctph.compare_edits(frame(spark, [(4, "same text"), (4, "same text"), (None, None)])).collect()
    assert len(got) == 3 and ctph.compare_edits(frame(spark, [(1, "x")]).limit(0)).count() == 0
    assert ctph.fingerprint(frame(spark, [(1, None)])).first()["fingerprint"] == "4::"
    a, b = ctph.Prints.parse(["4:abcdefgh:abcd", "8:abcd:ab"]), ctph.Prints.parse(["4:abcdefgh:abcd", "4:zzzz:abcd"])
    assert ctph.compare(a, b).tolist() == [1.0, 1.0]


def test_units(spark, monkeypatch):
    rng = random.Random(1)
    ids = rng.sample(range(10**9), 400) + [None]
    df = frame(spark, [(i, "x" * 100) for i in ids])
    for most in (2000, 3):
        monkeypatch.setattr(un, "QUANTILES", most)
        units = un.make(df, "doc_id", "text", 4000)
        got = {r["doc_id"]: r["u"] for r in df.select("doc_id", units.of("doc_id").alias("u")).collect()}
        order = sorted(ids, key=lambda i: -(1 << 63) if i is None else i)
        assert [got[i] for i in order] == sorted(got.values()) and 8 <= units.n <= 12 and len(set(got.values())) >= 8
    assert un.make(df.limit(0), "doc_id", "text").n == 1
    assert [(b, p.tolist()) for b, p in un.split_by(np.array([2, 0, 2]))] == [(0, [1]), (2, [0, 2])]


def test_units_follow_bytes(spark):
    sizes = {i: 20_000 if 100 <= i < 110 else 10 for i in range(1000)}  # long documents lie side by side
    df = frame(spark, [(i * i, "x" * n) for i, n in sizes.items()])
    units = un.make(df, "doc_id", "text", 20_000)
    of = {r["doc_id"]: r["u"] for r in df.select("doc_id", units.of("doc_id").alias("u")).collect()}
    held = collections.Counter()
    for i, n in sizes.items():
        held[of[i * i]] += n
    assert max(held.values()) <= 30_000 and units.n <= 25
    same = frame(spark, [(7, "x" * 10_000)] * 5 + [(None, "x" * 10_000)] * 3 + [(8, "y")])
    assert un.make(same, "doc_id", "text", 10_000).n <= 4
