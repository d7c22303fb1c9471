"""Substring dedup: word sequences that occur in more than one document, over prefix-partitioned suffix groups.

A suffix of a document's words is followed from the root of a suffix tree by its words; the tree is cut into
groups by prefix so that none needs more memory than a task has. Two rounds cut it. First, of every
window of ``window`` words the suffix whose ``prefix``-word beginning has the least hash is taken (equal windows choose
alike, so a repeated window always has its chosen suffix repeated too); groups of these prefixes find those
that a second document shares, and every other branch ends there as a leaf. Then the words below the shared prefixes are gathered, consecutive windows
that chose the same suffix as one run of words, and each group sorts the suffixes of its runs by 1, 2, 4, 8 and ``window`` words (prefix doubling): suffixes that
still share their rank are the leaves below an internal node of at least that depth, a repeat. What comes back to a document's unit is a bit per window.

Units are ranges of document ids, and a run that several documents of a unit have goes to its group once, with the smallest of their ids: a passage in a third of all
documents is an entry per unit, no larger a group than any. Prefixes are told apart by 64-bit hashes, where a false match only costs work; in groups words are, each by
64 bits.

Defined results: words are taken unchanged; null or empty text has no words; fewer than ``window`` words never repeat; a text of any length is one document; rows
with one id are one document as far as smaller ids go (none of them removes from another); null ids count as smaller than
all others; repeats within one document only are kept; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from . import units as un

WINDOW, PREFIX = 13, 7
UNIT_BYTES = 9 << 20
GROUPS = 4  # groups of suffixes for each unit


class _Words:
    """Words of a chunk, and of each window its chosen prefix."""

    def __init__(self, chunk: tk.Chunk, window: int, prefix: int):
        self.chunk, self.window = chunk, window
        self.s, self.e, self.doc = chunk.words()
        self.sums = chunk.prefix()
        h = tk.span_hash(self.sums, self.s, self.e)
        self.at = np.flatnonzero(tk.within(self.doc, window))  # places where a window begins
        gram = tk.gram_hash(h, prefix)
        chosen = np.zeros(0, np.uint64)
        if len(self.at):
            chosen = gram[self.at]
            for k in range(1, window - prefix + 1):
                np.minimum(chosen, gram[self.at + k], out=chosen)
        self.chosen = chosen

    def runs(self, shared: np.ndarray) -> np.ndarray:
        """The runs of windows that chose the same shared prefix."""
        below = np.zeros(0, np.int64)
        if len(shared) and len(self.at):
            i = np.minimum(np.searchsorted(shared, self.chosen), len(shared) - 1)
            below = np.flatnonzero(shared[i] == self.chosen)
        if not len(below):
            return np.zeros(0, _RUN)
        at = self.at[below]
        new = np.r_[True, (np.diff(at) != 1) | (np.diff(self.doc[at]) != 0) | (self.chosen[below[1:]] != self.chosen[below[:-1]])]
        first = np.flatnonzero(new)
        out = np.zeros(len(first), _RUN)
        out["many"] = np.diff(np.append(first, len(below)))
        out["word"], out["prefix"] = at[first], self.chosen[below[first]]
        out["begin"], out["end"] = self.s[at[first]], self.e[at[first] + out["many"] + self.window - 2]
        out["doc"] = self.doc[at[first]]
        out["hash"] = tk.mix(tk.span_hash(self.sums, out["begin"].astype(np.int64), out["end"].astype(np.int64)) ^ out["prefix"])
        return out


# a run of windows: its hash and chosen prefix, its first word and bytes in its chunk, how many windows, its document in the chunk, the chunk, the document's id
_RUN = np.dtype([("hash", "<u8"), ("prefix", "<u8"), ("key", "<i8"), ("word", "<i4"), ("begin", "<i4"), ("end", "<i4"), ("many", "<i4"), ("doc", "<i4"), ("chunk", "<i4")])


def _texts(t: pa.Table) -> pa.Array:
    return tk.strings(t["text"])


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _unpack(column: pa.ChunkedArray, dtype) -> list[np.ndarray]:
    return [np.frombuffer(b.as_buffer(), dtype) for b in column if b.is_valid]


class _Finder:
    def __init__(self, units: int, buckets: int, window: int, prefix: int):
        self.units, self.buckets, self.window, self.prefix = units, buckets, window, prefix

    def words(self, texts: pa.Array) -> Iterator[_Words]:
        for c in tk.chunks(texts):
            yield _Words(c, self.window, self.prefix)

    # round 1: prefixes -----------------------------------------------------------------------------
    def ask_prefixes(self, t: pa.Table) -> pa.Table:
        unit = t["unit"][0].as_py()
        key = t["key"].to_numpy()
        seen, docs = [], []
        for w in self.words(_texts(t)):
            if len(w.at):
                new = np.r_[True, (w.chosen[1:] != w.chosen[:-1]) | (w.doc[w.at][1:] != w.doc[w.at][:-1])]
                seen.append(w.chosen[new])
                docs.append(key[w.chunk.lo + w.doc[w.at][new]])
        h = np.concatenate(seen) if seen else np.zeros(0, np.uint64)
        d = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        order = np.argsort(h)
        h, d = h[order], d[order]
        first = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
        at = np.flatnonzero(first)
        shared = np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at) if len(h) else np.zeros(0, bool)
        h = h[at]
        rows = [(i, unit, h[at].tobytes(), np.packbits(shared[at]).tobytes()) for i, at in un.split_by(_bucket(h, self.buckets))]
        return un.blobs(rows, ["bucket", "unit", "hashes", "shared"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()])

    def tell_prefixes(self, t: pa.Table) -> pa.Table:
        """Of a group of prefixes, to each unit those that a second document has."""
        hs = _unpack(t["hashes"], np.uint64)
        flags = [np.unpackbits(f, count=len(h)).astype(bool) for h, f in zip(hs, _unpack(t["shared"], np.uint8))]
        unit = np.repeat(t["unit"].to_numpy(), [len(h) for h in hs])
        h, flag = np.concatenate(hs), np.concatenate(flags)
        order = np.argsort(h, kind="stable")
        h, flag, unit = h[order], flag[order], unit[order]
        first = np.r_[True, h[1:] != h[:-1]]
        group = np.cumsum(first) - 1
        many = np.bincount(group) > 1
        many |= np.bincount(group, weights=flag) > 0
        use = many[group]
        rows = [(u, 1, t["bucket"][0].as_py(), h[use][at].tobytes()) for u, at in un.split_by(unit[use])]
        return un.blobs(rows, ["unit", "round", "bucket", "reply"], [pa.int32(), pa.int32(), pa.int32(), pa.binary()])

    # round 2: the words below shared prefixes
    def _shared(self, r: pa.Table) -> np.ndarray:
        rows = [b for b, k in zip(r["reply"], r["round"].to_pylist()) if k == 1]
        return np.sort(np.concatenate([np.frombuffer(b.as_buffer(), np.uint64) for b in rows])) if rows else np.zeros(0, np.uint64)

    def _runs(self, t: pa.Table, shared: np.ndarray) -> tuple[list[tk.Chunk], np.ndarray]:
        """(chunks, runs of all of them); the words themselves aren't held."""
        key = t["key"].to_numpy()
        chunks, parts = [], [np.zeros(0, _RUN)]
        for i, w in enumerate(self.words(_texts(t))):
            r = w.runs(shared)
            r["chunk"] = i
            r["key"] = key[w.chunk.lo + r["doc"]]
            chunks.append(w.chunk)
            parts.append(r)
        return chunks, np.concatenate(parts)

    @staticmethod
    def _distinct(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a place of each distinct run, in order of hashes and with the smallest id; each run's number among them)."""
        order = np.lexsort((runs["key"], runs["hash"]))
        h = runs["hash"][order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        number = np.empty(len(h), np.int64)
        number[order] = np.cumsum(new) - 1
        return order[new], number

    def ask_windows(self, t: pa.Table, r: pa.Table) -> pa.Table:
        names, types = ["bucket", "unit", "runs"], [pa.int32(), pa.int32(), pa.binary()]
        shared = self._shared(r)
        if not t.num_rows or not len(shared):
            return un.blobs([], names, types)
        chunks, runs = self._runs(t, shared)
        first, _ = self._distinct(runs)
        one = runs[first]
        unit, rows = t["unit"][0].as_py(), []
        for b, place in un.split_by(_bucket(one["prefix"], self.buckets)):
            these = one[place]
            size = (these["end"] - these["begin"]).astype(np.int64)
            off = np.r_[0, np.cumsum(size)]
            data = np.zeros(int(off[-1]), np.uint8)
            for i, at in un.split_by(these["chunk"]):
                n = size[at]
                nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                data[np.repeat(off[at], n) + nth] = chunks[i].buf[np.repeat(these["begin"][at].astype(np.int64), n) + nth]
            column = pa.Array.from_buffers(pa.large_binary(), len(these), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data)])
            batch = pa.record_batch([column, pa.array(these["key"].astype(np.int64))], names=["run", "least"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch)
            rows.append((b, unit, sink.getvalue().to_pybytes()))
        return un.blobs(rows, names, types)

    def tell_windows(self, t: pa.Table) -> pa.Table:
        """Of a group's runs, to each unit which windows a smaller id has: the leaves of nodes of at least ``window`` words."""
        parts = [pa.ipc.open_stream(pa.BufferReader(b.as_buffer())).read_all() for b in t["runs"]]
        every = pa.concat_tables(parts).combine_chunks()
        column = every["run"].combine_chunks() if isinstance(every["run"], pa.ChunkedArray) else every["run"]
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        buf, off = tk.buffers(column)
        c = tk.Chunk(0, len(column), buf, off)
        s, e, run = c.words()
        rank = un.distinct(tk.span_hash(c.prefix(), s, e))[2]
        start = np.flatnonzero(tk.within(run, self.window))
        del s, e
        depth = 1

        def deeper(step: int, rank: np.ndarray) -> np.ndarray:
            behind = np.zeros(len(rank), np.uint64)
            behind[: len(rank) - step] = rank[step:]
            behind |= rank.astype(np.uint64) << np.uint64(32)
            return un.distinct(tk.mix(behind))[2]

        while 2 * depth <= self.window:
            rank, depth = deeper(depth, rank), 2 * depth
        if depth < self.window:
            rank = deeper(self.window - depth, rank)
        key = every["least"].to_numpy()[run[start]]
        node = rank[start]
        least = np.full(int(node.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, node, key)
        later = least[node] < key
        cut = np.searchsorted(run[start], np.cumsum([0, *(p.num_rows for p in parts)]))
        rows = [(u, 2, t["bucket"][0].as_py(), np.packbits(later[a:b]).tobytes()) for u, a, b in zip(t["unit"].to_pylist(), cut, cut[1:])]
        return un.blobs(rows, ["unit", "round", "bucket", "reply"], [pa.int32(), pa.int32(), pa.int32(), pa.binary()])

    # round 3: removal
    def removed(self, t: pa.Table, r: pa.Table) -> Iterator[tuple[tk.Chunk, tuple, np.ndarray]]:
        """Each chunk with its words and the flags of those that go."""
        chunks, runs = self._runs(t, self._shared(r))
        first, number = self._distinct(runs)
        one = runs[first]
        told = {b: x for b, x, k in zip(r["bucket"].to_pylist(), r["reply"], r["round"].to_pylist()) if k == 2}
        sizes = one["many"].astype(np.int64)
        begin = np.cumsum(sizes) - sizes
        later = np.zeros(int(sizes.sum()), bool)
        for b, place in un.split_by(_bucket(one["prefix"], self.buckets)):
            n = sizes[place]
            flat = np.arange(int(n.sum())) + np.repeat(begin[place] - (np.cumsum(n) - n), n)
            later[flat] = np.unpackbits(np.frombuffer(told[b].as_buffer(), np.uint8), count=len(flat)).astype(bool)
        edge = np.searchsorted(runs["chunk"], np.arange(len(chunks) + 1))  # runs are in order of chunks
        for i, c in enumerate(chunks):
            mine, which = runs[edge[i] : edge[i + 1]], number[edge[i] : edge[i + 1]]
            n = mine["many"].astype(np.int64)
            nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            gone = np.repeat(mine["key"] > one["key"][which], n) | later[np.repeat(begin[which], n) + nth]
            w = c.words()
            yield c, w, tk.cover((np.repeat(mine["word"].astype(np.int64), n) + nth)[gone], self.window, len(w[0]))


def kept_texts(chunk: tk.Chunk, s: np.ndarray, e: np.ndarray, doc: np.ndarray, keep: np.ndarray) -> list[bytes]:
    """Of each document the kept words, joined by one space."""
    s, n, doc = s[keep], (e - s)[keep], doc[keep]
    end = np.cumsum(n + 1)
    begin = end - n - 1
    total = int(end[-1]) if len(end) else 0
    at = np.arange(total) + np.repeat(s - begin, n + 1)
    out = chunk.buf[np.minimum(at, len(chunk.buf) - 1)] if total else np.zeros(0, np.uint8)
    out[end - 1] = 32
    i = np.searchsorted(doc, np.arange(len(chunk) + 1))
    data = out.tobytes()
    edge = np.append(begin, total)
    return [data[edge[i[d]] : max(edge[i[d]], edge[i[d + 1]] - 1)] for d in range(len(chunk))]


def _found(docs: DataFrame, id_col: str, text_col: str, window: int, prefix: int, unit_bytes: int) -> tuple[DataFrame, DataFrame, _Finder]:
    units = un.make(docs, id_col, text_col, unit_bytes)
    # runs overlap by up to a window, so that a group of suffixes has several times the bytes of what it was cut from
    f = _Finder(units.n, GROUPS * units.n, window, prefix)
    # one shuffle of the texts, which all three rounds read
    own = docs.select(un.key_of(id_col).alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), units.of(id_col).alias("unit")).repartitionById(units.n, "unit")
    reply = "unit int, round int, bucket int, reply binary"
    one = own.groupBy("unit").applyInArrow(lambda t: f.ask_prefixes(t), "bucket int, unit int, hashes binary, shared binary").repartitionById(f.buckets, "bucket").groupBy("bucket").applyInArrow(lambda t: f.tell_prefixes(t), reply)
    two = (
        own.groupBy("unit").cogroup(one.repartitionById(f.units, "unit").groupBy("unit")).applyInArrow(lambda t, r: f.ask_windows(t, r), "bucket int, unit int, runs binary")
        .repartitionById(f.buckets, "bucket").groupBy("bucket").applyInArrow(lambda t: f.tell_windows(t), reply)
    )
    return own, one.unionAll(two), f


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, prefix: int = PREFIX, unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """(id, n_words, n_removed, text): each document's kept words joined by one space."""
    return _removal(docs, id_col, text_col, window, prefix, unit_bytes, "text string", lambda kept: [pa.array([k.decode() for k in kept], pa.string())])


def repeat_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, prefix: int = PREFIX, unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256)."""
    return _removal(docs, id_col, text_col, window, prefix, unit_bytes, "kept_sha256 string", lambda kept: [pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())])


def _removal(docs, id_col, text_col, window, prefix, unit_bytes, last: str, make) -> DataFrame:
    own, replies, f = _found(docs, id_col, text_col, window, prefix, unit_bytes)
    id_type = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_words", "n_removed", last.split()[0]]

    def run(t: pa.Table, r: pa.Table) -> pa.Table:
        n, gone, out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        for c, (s, e, doc), hit in f.removed(t, r):
            n.append(np.bincount(doc, minlength=len(c)))
            gone.append(np.bincount(doc[hit], minlength=len(c)))
            out += kept_texts(c, s, e, doc, ~hit)
        return pa.table([t["id"], pa.array(np.concatenate(n)), pa.array(np.concatenate(gone)), *make(out)], names=names)

    return own.groupBy("unit").cogroup(replies.repartitionById(f.units, "unit").groupBy("unit")).applyInArrow(run, f"`{id_col}` {id_type}, n_words long, n_removed long, {last}")
