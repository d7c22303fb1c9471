"""Very long texts, and columns with clashing names, through every operator over documents and conversations."""

from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

from quarry.llm import chat, ctph, htmltext, katz, linestore, mixing, neardup, packing, quality, substrings

SHARED = " ".join(f"s{i}" for i in range(20))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    long = "\n".join(" ".join(f"word{rng.randint(0, 10**9):030d}" for _ in range(50)) for _ in range(600))  # 1.05 MB: more than a chunk
    return [(1, f"a start\n{SHARED} end"), (2, f"{long}\n{SHARED}"), (3, f"before {SHARED} behind"), (4, None), (5, "")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame([(i, t, "en", f"src{i % 2}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int").cache()
    df.count()
    return df


def test_scores(docs, rows):
    got = {r["doc_id"]: r for r in katz.score_corpus(docs.withColumn("score", F.lit("x")), unit_bytes=100_000).collect()}
    assert {i: r["n_tokens"] for i, r in got.items()} == {i: len(brute.words(t)) + 1 for i, t in rows}
    assert all(r["score"] < 0 for r in got.values())


def test_near_duplicates(docs, rows):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs.withColumn("component_id", F.lit(0))).collect()}
    assert got == brute.near_duplicates(rows)


def test_mixture(docs, rows):
    got = {r["doc_id"]: r["n_tokens"] for r in mixing.mixture(docs.withColumn("tokens", F.lit(1)), mixing.Mix(share=9.0, max_epochs=1)).collect()}
    assert got == {i: len(brute.words(t)) for i, t in rows}


def test_lines_and_substrings(docs, rows):
    lines = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in linestore.line_digest(docs.withColumn("lost_keys", F.lit(1))).collect()}
    assert lines == {k[0]: v for k, v in brute.line_dedup(rows).items()}
    parts = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.repeat_digest(docs.withColumn("unit", F.lit(1)), unit_bytes=100_000).collect()}
    assert parts == {k[0]: v for k, v in brute.substring_dedup(rows).items()} and parts[2][1] == parts[3][1] == 20


def test_quality(docs, rows):
    got = {r["doc_id"]: r for r in quality.score_quality(docs.withColumn("kept", F.lit(1))).collect()}
    assert {i: (r["n_words"], r["word_chars"]) for i, r in got.items()} == {i: (len(brute.words(t)), sum(map(len, brute.words(t)))) for i, t in rows}
    assert got[2]["kept"] and not got[2]["base_failed"]


def test_packing(docs, rows):
    got = packing.pack(docs.withColumn("offset", F.lit(1)), unit_bytes=100_000).collect()
    for i, _ in rows:
        mine = sorted((r["start"], r["length"]) for r in got if r["doc_id"] == i)
        assert [a for a, _ in mine] == [sum(n for _, n in mine[:k]) for k in range(len(mine))] and sum(n for _, n in mine) == next(r["doc_tokens"] for r in got if r["doc_id"] == i)


def test_fingerprints(docs, rows):
    got = {r["doc_id"]: r for r in ctph.compare_edits(docs.withColumn("fingerprint", F.lit(1)), unit_bytes=100_000).collect()}
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: -r[0])
    for n, (i, t) in enumerate(order):
        k = len(t) // 3
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == brute.sha(t[: len(t) - k] + order[(n + 1) % len(order)][1][:k])


def test_conversations_and_pages(spark, rows):
    said = spark.createDataFrame([(1, 0, "user", rows[1][1]), (1, 1, "assistant", rows[1][1])], "conv_id long, turn int, role string, text string")
    one = chat.chat_digest(said.withColumn("n_turns", F.lit("x")).withColumn("loss_chars", F.lit(0))).first()
    assert one["n_turns"] == 2 and one["loss_chars"] == len(rows[1][1]) and one["loss_sha256"] == brute.sha(rows[1][1])
    page = spark.createDataFrame([(1, "u", f"<article><p>{rows[1][1]}</p></article>")], "page_id long, url string, html string").withColumn("n_chars", F.lit("x"))
    assert htmltext.extract_text(page).first()["text"] == " ".join(rows[1][1].split())
