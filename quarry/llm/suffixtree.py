"""Maximal repeats from prefix-partitioned suffix trees.

Every suffix of at least ``min_words`` words goes to a group by its prefix. Prefixes have variable length: a prefix that more than ``group`` suffixes share is
replaced by longer ones (1, 2, 4, ... up to ``min_words`` words), so that a group fits a task; counting prefixes combines before it shuffles. In a group the suffixes are
sorted by their words; neighbours' common prefixes form intervals, which are the internal nodes of the group's subtree. Nodes of at least
``min_words`` words with leaves whose preceding words differ are maximal repeats. Suffixes are read DEPTH words deep; those that still share all of them, and not the
word before, are read twice as deep, and so on until every common prefix ends. With ``depth`` given, a repeat that long is cut there.

Prefixes of ``min_words`` words that still more than ``group`` suffixes share aren't gathered: the nodes below those are found by counting, for every length,
the suffixes that share that many words and whether the words on either side differ, which combines before it shuffles.

Defined results: null, empty and short texts have no suffixes; ids must be integers that don't repeat, and rows without an id are left out; a text of any length is followed
whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from . import textkernel as tk

MIN_WORDS, DEPTH, GROUP = 13, 64, 100_000
BROADCAST_ROWS = 1_000_000  # 8 bytes each
SCHEMA = "n_words int, occurrences long, documents long, first_id long, first_word long, text string"


def _lengths(depth: int) -> list[int]:
    out = [1]
    while out[-1] < depth:
        out.append(min(depth, 2 * out[-1]))
    return out


def subtree(suffixes: list[tuple[str, ...]], before: list[str | None], least: int) -> Iterator[tuple[int, int, int]]:
    """(first place, end, length) of the left-maximal internal nodes of at least ``least`` words; suffixes must be sorted. before: the preceding words."""
    n = len(suffixes)
    lcp = [0] * (n + 1)
    for i in range(1, n):
        a, b, k = suffixes[i - 1], suffixes[i], 0
        while k < len(a) and k < len(b) and a[k] == b[k]:
            k += 1
        lcp[i] = k
    stack: list[tuple[int, int]] = []  # (length, first place) of open intervals
    for i in range(1, n + 1):
        start = i - 1
        while stack and stack[-1][0] > lcp[i]:
            length, start = stack.pop()
            left = before[start:i]
            if length >= least and (left[0] is None or any(x != left[0] for x in left)):
                yield start, i, length
        if lcp[i] > 0 and (not stack or stack[-1][0] < lcp[i]):
            stack.append((lcp[i], start))


def _suffixes(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(id, pos, h0, h1, ...): each suffix and the hashes of its prefixes."""
    sizes = _lengths(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for c in tk.chunks(tk.strings(b.column(1))):
                s, e, doc = c.words()
                h = tk.span_hash(c.prefix(), s, e)
                count = np.bincount(doc, minlength=len(c))
                pos = np.arange(len(s)) - np.repeat(np.cumsum(count) - count, count)
                left = count[doc] - pos
                use = np.flatnonzero(left >= least)
                g, cols, at = np.zeros(len(use), np.uint64), [], 0
                for k in sizes:
                    while at < k:
                        g = g * np.uint64(0xD6E8FEB86659FD93) + h[use + at]
                        at += 1
                    cols.append(pa.array(tk.mix(g).view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(c.lo + doc[use])), pa.array(pos[use]), *cols], ["id", "pos", *[f"h{i}" for i in range(len(sizes))]])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(run, "id long, pos long, " + ", ".join(f"h{i} long" for i in range(len(sizes))))


def maximal_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, depth: int | None = None, group: int = GROUP) -> DataFrame:
    """One row per maximal repeat: its words, occurrences, documents, first place and text. Ids must be integers and not repeat."""
    bounded = depth is not None
    deep = max(depth or DEPTH, min_words + 1)
    sizes = _lengths(min_words)
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = storage.written(_suffixes(keyed, "doc_id", "text", min_words), "suffixes")
    open_, parts, total = found, [], found.count()
    for i in range(len(sizes)):
        h = f"h{i}"
        many = open_.groupBy(h).agg(F.count("*").alias("n"))
        # prefixes that occur once are leaves; large ones, at most rows / group of them, get longer prefixes
        sized = open_.join(many.where(f"n > 1 and n <= {group}").select(h), h, "left_semi")
        parts.append(sized.select("id", "pos", F.struct(F.lit(i).alias("level"), F.col(h).alias("prefix")).alias("node")))
        # a prefix with 1/BROADCAST_ROWS of all suffixes or more is broadcast: there are at most so many; the others are spread by a shuffle
        least_share = -(-total // BROADCAST_ROWS)
        hot_ = open_.join(F.broadcast(many.where(f"n > {group} and n >= {least_share}").select(h)), h, "left_semi")
        open_ = hot_ if least_share <= group else hot_.unionAll(open_.join(many.where(f"n > {group} and n < {least_share}").select(h), h, "left_semi"))
    grouped = parts[0]
    for p in parts[1:]:
        grouped = grouped.unionAll(p)

    differ = lambda c: (F.count(c) < F.count("*")) | (F.min(c) != F.max(c))
    blank = F.struct(F.lit(-1).alias("level"), F.lit(0).cast("long").alias("prefix")).alias("node")
    hot, out, least = open_.select("id", "pos", blank), None, min_words
    while True:
        met, heads, longer = _read(keyed, grouped, hot, least, deep, bounded, differ)
        out = met.unionAll(heads) if out is None else out.unionAll(met).unionAll(heads)
        if bounded:
            return out
        # suffixes that share all the words read, after differing ones: the passages that begin here may go on
        longer = storage.written(longer, "longer")
        if longer.isEmpty():
            return out
        many = longer.groupBy("prefix").agg(F.count("*").alias("n"))
        longer = longer.join(many, "prefix")
        grouped = longer.where(f"n <= {group}").select("id", "pos", F.struct(F.lit(0).alias("level"), "prefix").alias("node"))
        hot = longer.where(f"n > {group}").select("id", "pos", blank)
        least, deep = deep, 2 * deep


def _read(keyed: DataFrame, grouped: DataFrame, hot: DataFrame, least: int, depth: int, bounded: bool, differ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Repeats of least words and more among groups, and among hot suffixes, read depth words deep; (id, pos, prefix) of the suffixes to read on."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words of each suffix and the one before it."""
        for b in batches:
            rows, seqs, before = [], [], []
            for t, places in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = [x for x in t.translate(_BLANK).split(" ") if x]
                for p in places:
                    rows.append((p["id"], p["pos"], p["node"]))
                    seqs.append(w[p["pos"] : p["pos"] + depth])
                    before.append(w[p["pos"] - 1] if p["pos"] else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.struct([("level", pa.int32()), ("prefix", pa.int64())])), pa.array(seqs, pa.list_(pa.string())), pa.array(before, pa.string())],
                ["id", "pos", "node", "words", "before"],
            )

    def content(rows: DataFrame) -> DataFrame:
        places = rows.groupBy("id").agg(F.collect_list(F.struct("id", "pos", "node")).alias("places"))  # a document's own suffixes
        return keyed.join(places, keyed["doc_id"] == places["id"]).select("text", "places").mapInArrow(words, "id long, pos long, node struct<level: int, prefix: long>, words array<string>, before string")

    def nodes(t: pa.Table) -> pa.Table:
        ids, pos, seqs, before = (t[c].to_pylist() for c in ("id", "pos", "words", "before"))
        order = sorted(range(len(ids)), key=lambda i: (seqs[i], ids[i], pos[i]))
        sorted_ = [tuple(seqs[i]) for i in order]
        out, longer = [], []
        for a, b, k in subtree(sorted_, [before[i] for i in order], least):
            if not bounded and k == depth:
                prefix = xxhash.xxh3_64_intdigest(" ".join(sorted_[a]).encode()) - (1 << 63)
                longer += [(ids[order[i]], pos[order[i]], prefix) for i in range(a, b)]
                continue
            here = [(ids[order[i]], pos[order[i]]) for i in range(a, b)]
            out.append((k, b - a, len({i for i, _ in here}), *min(here), " ".join(sorted_[a][:k])))
        out = [(*o, None, None, None) for o in out] + [(*[None] * 6, *x) for x in longer]
        kinds = [pa.int32(), *[pa.int64()] * 4, pa.string(), *[pa.int64()] * 3]
        return pa.table([pa.array([o[j] for o in out], k) for j, k in enumerate(kinds)], names=["n_words", "occurrences", "documents", "first_id", "first_word", "text", "id", "pos", "prefix"])

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each suffix its prefixes of ``least`` words and more, with the words before and behind."""
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for i, p, w, prev in zip(*(b.column(c).to_pylist() for c in (0, 1, 3, 4))):
                for k in range(least, len(w) + 1):
                    for column, x in zip(out, (k, xxhash.xxh3_128_digest(" ".join(w[:k]).encode()), i, p, prev, w[k] if k < len(w) else None)):
                        column.append(x)
            kinds = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["n_words", "h", "id", "pos", "prev", "next"])

    both = content(grouped).groupBy("node").applyInArrow(nodes, SCHEMA + ", id long, pos long, prefix long")
    both = both if bounded else storage.written(both, "repeats")
    spread = content(hot).mapInArrow(lengths, "n_words int, h binary, id long, pos long, prev string, next string")
    counted = (
        spread.groupBy("n_words", "h")
        .agg(F.count("*").alias("occurrences"), F.count_distinct("id").alias("documents"), F.min(F.struct("id", "pos")).alias("f"), differ("prev").alias("left"), differ("next").alias("right"))
        .where("occurrences > 1 and left and right")
    )
    counted = counted if bounded else storage.written(counted, "counted")
    part = F.slice(F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != ""), (F.col("f.pos") + 1).cast("int"), F.col("n_words"))
    ended = counted if bounded else counted.where(F.col("n_words") < depth)
    heads = ended.join(keyed, F.col("f.id") == keyed["doc_id"]).select("n_words", "occurrences", "documents", F.col("f.id").alias("first_id"), F.col("f.pos").alias("first_word"), F.array_join(part, " ").alias("text"))
    on = spread.where(F.col("n_words") == depth).join(counted.where(F.col("n_words") == depth).select("h"), "h", "left_semi").select("id", "pos", F.xxhash64("h").alias("prefix"))
    return both.where("n_words is not null").select(*heads.columns), heads, both.where("n_words is null").select("id", "pos", "prefix").unionAll(on)


_BLANK = str.maketrans(dict.fromkeys("\t\n\x0b\x0c\r", " "))
