"""Packing: related documents behind one another in windows of tokens.

A nearest-neighbour graph is built over the whole table: documents that share any of 16 minwise values of their words are compared,
exhaustively where few share it and after branching by further values where many do, and the most alike stay. Documents with equal values are
one node. The graph is cut into clusters of at most half a unit by joining over the most alike links first, and clusters fill units. In a unit
paths start at the document of lowest degree and go on to the most alike unvisited neighbour; only links between two units are not followed.
The token stream along the paths is cut into windows of ``window`` tokens; the rest of a unit's stream is cut into powers of two, so nothing is padded.

Token ids are those of the tokenizer file over the whole text. They are worked out per distinct piece of text: the tokenizer's pattern never joins
what precedes a single blank to what follows, so a text may be cut before it.

Defined results: null or empty text is the closing id alone; repeated rows are documents of their own; a document longer than a window
fills several; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import storage
from . import textkernel as tk

WINDOW, CLOSING = 1024, 0
UNIT_BYTES = 16 << 20
MINHASHES, NEIGHBOURS, ALIKE = 16, 4, 2
RUN, HELD = 64, 4_000_000  # documents of one minwise value that are compared exhaustively; pairs held before the nearest are picked
BAND = 50_000  # documents of one minwise value that a task compares; beyond, the value is branched before the shuffle
LOCAL_EDGES = 2_000_000  # links that the driver merges clusters by; more are first contracted by turns over the table
MERGED = 100_000  # links that are lists at a time while the driver merges
BROADCAST_ROWS = 1_000_000  # about 80 bytes each; beyond that the places are joined by a shuffle
CACHE = 1_000_000  # pieces remembered, about 40 bytes each

_FACTORS = np.random.Generator(np.random.PCG64(5)).integers(1, 2**63, MINHASHES, dtype=np.uint64) | np.uint64(1)
_UNSURE = np.zeros(256, bool)  # first bytes of blanks beyond ASCII and of special tokens, before which texts end
_UNSURE[[0xC2, 0xE1, 0xE2, 0xE3, 0x3C]] = True

_BLANKS = frozenset(bytes([b]) for b in range(256) if tk.SPACE[b])
_NO_START = frozenset([b"", *(bytes([b]) for b in range(256) if tk.SPACE[b] or _UNSURE[b])])


# token ids


_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _bytes_of_characters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PieceTokenizer:
    """Ids of whole texts, each distinct piece encoded once while it is remembered.

    If the file is a byte-level BPE whose merges are in the order of their ids, new pieces are merged together by a faster
    implementation with the file's own ranks; all else, and pieces with special tokens, is left to the tokenizers library.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special, self.merger = [], None
        with open(path, encoding="utf-8") as f:
            self._load(json.load(f))
        self._forget()

    def _load(self, spec: dict) -> None:
        self.special = [t["content"].encode() for t in spec.get("added_tokens") or []]
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model["type"] != "BPE":
            return
        added = {t["content"] for t in spec.get("added_tokens") or []}
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if any(x >= y for x, y in zip(merged, merged[1:])):
            return
        import tiktoken

        back = _bytes_of_characters()
        ranks = {bytes(back[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
        self.merger = tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, i in ranks.items():
            self.length[i] = len(t)

    def _forget(self) -> None:
        self.known, self.start, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0

    def _encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where those of each piece begin, how many it has)."""
        n = len(pieces)
        start, size = np.zeros(n, np.int64), np.zeros(n, np.int64)
        joined, single, parts, used = [], [], [], 0
        # pieces that begin with one blank don't change each other's ids
        plain = self.merger is not None
        for i, p in enumerate(pieces):
            (joined if plain and p[:1] in _BLANKS and p[1:2] not in _NO_START else single).append(i)
        text = b"".join([pieces[i] for i in joined])
        if any(s in text for s in self.special):
            single += [i for i in joined if any(s in pieces[i] for s in self.special)]
            joined = [i for i in joined if not any(s in pieces[i] for s in self.special)]
            text = b"".join([pieces[i] for i in joined])
        if joined:
            ids = np.array(self.merger.encode_ordinary(text.decode()), np.uint32)
            ends = np.searchsorted(np.cumsum(self.length[ids]), np.cumsum([len(pieces[i]) for i in joined])) + 1
            size[joined] = np.diff(ends, prepend=0)
            start[joined] = ends - size[joined]
            parts, used = [ids], len(ids)
        for i in single:
            p = pieces[i]
            if self.merger is None or any(s in p for s in self.special):
                ids = self.tokenizer.encode(p.decode(), add_special_tokens=False).ids
            else:
                ids = self.merger.encode_ordinary(p.decode())
            start[i], size[i] = used, len(ids)
            used += len(ids)
            parts.append(np.array(ids, np.uint32))
        return np.concatenate(parts), start, size

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        ids, start, size = self._encode(pieces)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        start += self.used
        self.used += len(ids)
        at = np.searchsorted(self.known, hashes)
        self.known, self.start, self.size = np.insert(self.known, at, hashes), np.insert(self.start, at, start), np.insert(self.size, at, size)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by CLOSING; how many each has)."""
        out, sizes = [], []
        for c in tk.chunks(texts):
            ids, n = self._chunk(c)
            out.append(ids)
            sizes.append(n)
        return (np.concatenate(out), np.concatenate(sizes)) if out else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _chunk(self, c: tk.Chunk) -> tuple[np.ndarray, np.ndarray]:
        b, n = c.buf, len(c)
        if len(b) == 0:
            return np.full(n, CLOSING, np.uint32), np.ones(n, np.int64)
        blank = tk.SPACE[b]
        cut = np.zeros(len(b), bool)
        cut[:-1] = blank[:-1] & ~blank[1:] & ~_UNSURE[b[1:]]
        last = c.off[1:] - 1
        cut[last[last >= 0]] &= False  # a blank that ends a document stays with what precedes it
        first = c.off[:-1][np.diff(c.off) > 0]
        cut[first] = True
        s = np.flatnonzero(cut)
        e = np.append(s[1:], len(b))
        h, at, inv = np.unique(tk.span_hash(c.prefix(), s, e), return_index=True, return_inverse=True)
        if len(self.known) + len(h) > CACHE:
            self._forget()
        place = np.searchsorted(self.known, h)
        new = np.flatnonzero(place == len(self.known)) if not len(self.known) else np.flatnonzero(self.known[np.minimum(place, len(self.known) - 1)] != h)
        if len(new):
            data = b.tobytes()
            self._learn(h[new], [data[i:j] for i, j in zip(s[at[new]].tolist(), e[at[new]].tolist())])
            place = np.searchsorted(self.known, h)
        start, size = self.start[place][inv], self.size[place][inv]
        doc = c.doc_of(s)
        count = np.bincount(doc, weights=size, minlength=n).astype(np.int64) + 1
        end = np.cumsum(count)
        ids = np.full(int(end[-1]), CLOSING, np.uint32)
        begin = np.cumsum(size) - size + doc  # one closing id after each document before it
        total = int(size.sum())
        nth = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
        ids[np.repeat(begin, size) + nth] = self.flat[np.repeat(start, size) + nth]
        return ids, count


# signatures and neighbours


def _vocabulary(c: tk.Chunk) -> tuple[np.ndarray, ...]:
    """(document, word hash, bytes of the word, how often) of each document's distinct words, and where each document with words begins."""
    s, e, doc = c.words()
    h = tk.span_hash(c.prefix(tk.LOWER), s, e)
    h >>= np.uint64(24)  # 40 bits tell the words of a document apart well enough, and let one key sort by document and word
    order = np.argsort(h | doc.astype(np.uint64) << np.uint64(40))
    h, doc, size = tk.mix(h[order]), doc[order], (e - s)[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    many = np.diff(np.append(at, len(h)))
    doc = doc[at]
    full = np.flatnonzero(np.bincount(doc, minlength=len(c)))
    return doc, h[at], size[at], many, full, np.searchsorted(doc, full)


def minwise(c: tk.Chunk) -> np.ndarray:
    """Minwise values of each document's words."""
    _, h, _, _, full, edge = _vocabulary(c)
    low = np.full((len(c), MINHASHES), np.uint32(2**32 - 1), np.uint32)
    if len(h):
        for j in range(MINHASHES):
            low[full, j] = np.minimum.reduceat((h * _FACTORS[j] >> np.uint64(32)).astype(np.uint32), edge)
    return low


def _narrow(key: np.ndarray, low: np.ndarray, stride: int = 1) -> np.ndarray:
    """Keys under which every run of over RUN alike keys is branched again, by one further minwise value after another, until it is small or its values are all equal."""
    key, wide = key.copy(), low.shape[1]
    start = (tk.mix(key + np.uint64(stride)) % np.uint64(wide)).astype(np.int64)
    at = np.arange(len(key))
    for level in range(wide):
        _, inv, many = np.unique(key[at], return_inverse=True, return_counts=True)
        at = at[many[inv] > RUN]
        if not len(at):
            break
        c = (start[at] + stride * level) % wide
        key[at] = tk.mix(key[at] * np.uint64(0xD6E8FEB86659FD93) + low[at, c].astype(np.uint64) + np.uint64(level + 1))
    return key


def _run_pairs(key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within runs of a key. Runs of over RUN have equal values throughout, so that any RUN of one's fellows are as near as can be."""
    order = np.argsort(key, kind="stable")
    v = key[order]
    end = np.searchsorted(v, v, "right")
    at = np.arange(len(v))
    for step in range(1, RUN):
        at = at[at + step < end[at]]
        if not len(at):
            return
        yield order[at], order[at + step]


def _best(a: np.ndarray, b: np.ndarray, like: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each a the NEIGHBOURS most alike b, each once; among equally alike ones chance decides, so that none is everybody's neighbour."""
    chance = tk.mix(a.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) ^ tk.mix(b.astype(np.uint64)))
    order = np.lexsort((b, chance, -like.astype(np.int8), a))
    a, b, like = a[order], b[order], like[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b, like = a[new], b[new], like[new]
    keep = np.arange(len(a)) - np.searchsorted(a, a) < NEIGHBOURS
    return a[keep], b[keep], like[keep]


def nearest(key: np.ndarray, who: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, alike values) of the nearest pairs, both ways, among those that share a key. key: of each entry; who: its row in low."""
    found, held = [], 0
    values = low[who]
    for stride in (1, 5):  # a large run is branched along two ways
        if stride > 1:
            _, inv, many = np.unique(key, return_inverse=True, return_counts=True)
            use = many[inv] > RUN
            key, who, values = key[use], who[use], values[use]
        for i, j in _run_pairs(_narrow(key, values, stride)):
            like = (values[i] == values[j]).sum(1, dtype=np.uint8)
            use = like >= ALIKE
            i, j, like = who[i[use]], who[j[use]], like[use]
            found.append((np.r_[i, j], np.r_[j, i], np.r_[like, like]))
            held += 2 * len(i)
            if held > HELD:
                found = [_best(*map(np.concatenate, zip(*found)))]
                held = len(found[0][0])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
    return _best(*map(np.concatenate, zip(*found)))


def neighbours(low: np.ndarray) -> list[list[int]]:
    """Of each document the most alike others, both ways, among those that share a minwise value; large runs of one value are branched, small ones compared exhaustively."""
    n, wide = low.shape
    key = tk.mix(low.T.astype(np.uint64).ravel() + (np.repeat(np.arange(wide, dtype=np.uint64), n) << np.uint64(56)))
    a, b, _ = nearest(key, np.tile(np.arange(n), wide), low)
    edge = np.searchsorted(a, np.arange(n + 1))
    return [b[edge[i] : edge[i + 1]].tolist() for i in range(n)]


def walk(near: list[list[int]]) -> list[int]:
    """All documents along greedy paths that start where the degree is lowest and go on to the most alike unvisited neighbour."""
    n = len(near)
    around = [list(x) for x in near]
    for i, x in enumerate(near):
        for j in x:
            if i not in around[j]:
                around[j].append(i)
    degree = np.array([len(x) for x in around])
    seen, out = [False] * n, []
    for start in np.argsort(degree, kind="stable").tolist():
        at = start
        while not seen[at]:
            seen[at] = True
            out.append(at)
            at = next((j for j in around[at] if not seen[j]), at)
    return out


def pieces(size: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """(document, start, length, sequence, offset) of each piece of a stream of documents of these sizes, in stream order."""
    total = int(size.sum())
    whole = total // window
    rest, tail, at = total - whole * window, [], whole * window
    for k in range(window.bit_length() - 1, -1, -1):
        if rest >> k & 1:
            tail.append(at)
            at += 1 << k
    begins = np.r_[np.arange(whole, dtype=np.int64) * window, np.array(tail, np.int64)]
    docs = np.cumsum(size) - size
    cut = np.unique(np.r_[docs, begins])
    length = np.diff(np.append(cut, total))
    doc = np.searchsorted(docs, cut, "right") - 1
    seq = np.searchsorted(begins, cut, "right") - 1
    return doc, cut - docs[doc], length, seq, cut - begins[seq]


# the graph over the whole table


def _matrix(column: pa.Array) -> np.ndarray:
    return tk.buffers(column)[0].view(np.uint32).reshape(-1, MINHASHES)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = tk.strings(b.column(1))
        parts = [minwise(c) for c in tk.chunks(texts)]
        low = np.concatenate(parts) if parts else np.zeros((0, MINHASHES), np.uint32)
        node = np.zeros(len(low), np.uint64)
        for j in range(MINHASHES):
            node = tk.mix(node * np.uint64(0xD6E8FEB86659FD93) + low[:, j] + np.uint64(j + 1))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(node.view(np.int64)), pc.add(pc.binary_length(texts).cast(pa.int64()), 64), pa.array([x.tobytes() for x in low], pa.binary())], ["row", "node", "size", "low"])


def _bands(nodes: DataFrame, hot: list[frozenset], payload: bool) -> DataFrame:
    """(key, node, low): a row per node and minwise value; hot values are branched by two others each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low = _matrix(b.column(1))
            row = np.tile(np.arange(len(low)), MINHASHES)
            key = tk.mix(low.T.astype(np.uint64).ravel() + (np.repeat(np.arange(MINHASHES, dtype=np.uint64), len(low)) << np.uint64(56)))
            done = []
            for level, keys in enumerate(hot):
                again = np.isin(key, np.array(sorted(keys), np.uint64))
                done.append((row[~again], key[~again]))
                row, key = row[again], key[again]
                parts = []
                for way in (1, 2):
                    c = ((tk.mix(key) + np.uint64(level * (2 * way - 1) + way)) % np.uint64(MINHASHES)).astype(np.int64)
                    parts.append(tk.mix(key + (np.uint64(way) << np.uint64(40)) + low[row, c].astype(np.uint64)))
                row, key = np.tile(row, 2), np.concatenate(parts)
            row, key = (np.concatenate(x) for x in zip(*done, (row, key)))
            cols = [pa.array(key.view(np.int64))] + ([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row))] if payload else [])
            yield pa.RecordBatch.from_arrays(cols, ["key", "node", "low"][: len(cols)])

    return nodes.select("node", "low").mapInArrow(run, "key long, node long, low binary" if payload else "key long")


def neighbour_graph(nodes: DataFrame, band: int = BAND) -> DataFrame:
    """(node, near, likes): the nearest nodes of each, most alike first, as 8-byte values, and how many minwise values are alike, as bytes."""
    hot: list[frozenset] = []
    for _ in range(24):
        found = [r[0] for r in _bands(nodes, hot, False).groupBy("key").count().where(F.col("count") > band).select("key").collect()]
        if not found:
            break
        hot.append(frozenset(np.array(found, np.int64).view(np.uint64).tolist()))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2))) for b in batches if b.num_rows]
        if not parts:
            return
        key, node, low = (np.concatenate(x) for x in zip(*parts))
        ids, first, who = np.unique(node, return_index=True, return_inverse=True)
        a, b, like = nearest(key.view(np.uint64), who, low[first])
        yield from pa.table([pa.array(ids[a]), pa.array(ids[b]), pa.array(like.astype(np.int8))], names=["a", "b", "like"]).to_batches(max_chunksize=100_000)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [tuple(b.column(i).to_numpy() for i in range(3)) for b in batches if b.num_rows]
        if not parts:
            return
        a, b, like = _best(*(np.concatenate(x) for x in zip(*parts)))
        at = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        cut = lambda x: pa.array([y.tobytes() for y in np.split(x, at[1:])], pa.binary())
        yield from pa.table([pa.array(a[at]), cut(b), cut(like)], names=["node", "near", "likes"]).to_batches(max_chunksize=100_000)

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = _bands(nodes, hot, True).repartition(parts, "key").mapInArrow(search, "a long, b long, like byte")
    return storage.written(pairs.repartition(parts, "a").mapInArrow(merge, "node long, near binary, likes binary"), "neighbours")


def _edges(graph: DataFrame) -> DataFrame:
    """(a, b, like) with a < b, each link once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            near, off = tk.buffers(t.column(1))
            a, b, like = np.repeat(t.column(0).to_numpy(), np.diff(off) // 8), near.view(np.int64), tk.buffers(t.column(2))[0].view(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(like)], ["a", "b", "like"])

    return graph.mapInArrow(run, "a long, b long, like byte").groupBy("a", "b").agg(F.max("like").alias("like"))


def merged(a: np.ndarray, b: np.ndarray, like: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, its cluster's node): clusters joined over the most alike links first, while both together have at most cap bytes."""
    ids = np.unique(np.r_[a, b])
    chance = tk.mix(a.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93) ^ tk.mix(b.view(np.uint64)))
    order = np.lexsort((chance, -like.astype(np.int8)))
    del chance
    x, y = np.searchsorted(ids, a).astype(np.int32), np.searchsorted(ids, b).astype(np.int32)
    total = np.zeros(len(ids), np.int64)
    total[x], total[y] = size_a, size_b
    # arrays and slices of the links: lists of all would take several times the room
    root, size = array("i", np.arange(len(ids), dtype=np.int32).tobytes()), array("q", total.tobytes())
    del total

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for at in range(0, len(order), MERGED):
        part = order[at : at + MERGED]
        for i, j in zip(x[part].tolist(), y[part].tolist()):
            i, j = top(i), top(j)
            if i != j and size[i] + size[j] <= cap:
                root[j] = i
                size[i] += size[j]
    return ids, ids[np.fromiter((top(i) for i in range(len(ids))), np.int32, len(ids))]


def _merges(edges: DataFrame, turn: int, cap: int) -> DataFrame:
    """(was, to, size): clusters to be joined to another by their most alike link, and the bytes that makes together.

    A hash of cluster and turn says which half of the clusters is joined to and which half joins; one that is joined to takes
    as many as fit, the most alike first. So a cluster with thousands of links doesn't take a turn for each, and a quarter of all join in a turn or lose links to full clusters.
    """
    chance = F.xxhash64("a", "b").alias("chance")
    both = edges.select("a", "b", "like", chance, "sa", "sb").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "like", chance, F.col("sb").alias("sa"), F.col("sa").alias("sb")))
    best = both.groupBy("a").agg(F.max(F.struct("like", "chance", "b", "sa", "sb")).alias("m")).select("a", "m.*")
    takes = lambda c: F.pmod(F.xxhash64(c, F.lit(turn)), F.lit(2)) == 1
    nth = Window.partitionBy("b").orderBy(F.desc("like"), "chance", "a").rowsBetween(Window.unboundedPreceding, 0)
    fit = best.where(takes("b") & ~takes("a")).withColumn("size", F.col("sb") + F.sum("sa").over(nth)).where(f"size <= {cap}")
    return fit.select(F.col("a").alias("was"), F.col("b").alias("to"), "size")


def _clusters(nodes: DataFrame, edges: DataFrame, cap: int, local_edges: int | None = None) -> DataFrame:
    """(node, label): clusters of at most cap bytes of nodes that are alike; a larger node is a cluster of its own."""
    local_edges = LOCAL_EDGES if local_edges is None else local_edges
    size = nodes.select("node", "size")
    edges = edges.join(size.toDF("a", "sa"), "a").join(size.toDF("b", "sb"), "b").where(f"sa + sb <= {cap}").select("a", "b", "like", "sa", "sb")
    edges, labels = storage.written(edges, "links"), nodes.select("node", F.col("node").alias("label"))

    def renamed(new: DataFrame) -> DataFrame:
        return labels.join(new.toDF("label", "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))

    turn = 0
    while edges.count() > local_edges:
        pairs = storage.written(_merges(edges, turn, cap), "merges")
        to = pairs.select("was", "to").join(pairs.groupBy("to").agg(F.max("size").alias("size")), "to").select("was", "to", "size")
        to = to.unionAll(pairs.groupBy("to").agg(F.max("size").alias("size")).select(F.col("to").alias("was"), "to", "size"))
        x, y = to.toDF("a", "ta", "na"), to.toDF("b", "tb", "nb")
        e = edges.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b"), "like", F.coalesce("na", "sa").alias("sa"), F.coalesce("nb", "sb").alias("sb")).where(f"a <> b and sa + sb <= {cap}")
        low = F.col("a") < F.col("b")
        side = lambda p, q: F.when(low, F.col(p)).otherwise(F.col(q))
        e = e.select(side("a", "b").alias("a"), side("b", "a").alias("b"), "like", side("sa", "sb").alias("sa"), side("sb", "sa").alias("sb"))
        left = storage.written(e.groupBy("a", "b").agg(F.max("like").alias("like"), F.first("sa").alias("sa"), F.first("sb").alias("sb")), "links")
        named = storage.written(renamed(pairs.select("was", "to")), "labels")
        for old in (edges, pairs, *([labels] if turn else [])):  # the first labels are the nodes
            storage.drop(old)
        edges, labels, turn = left, named, turn + 1
    t = edges.toArrow()
    ids, to = merged(*(t[c].to_numpy() for c in ("a", "b", "like", "sa", "sb")), cap)
    if not len(ids):
        return labels
    new = nodes.sparkSession.createDataFrame(pa.table({"was": pa.array(ids), "to": pa.array(to)}))
    return renamed(new)


def _places(keyed: DataFrame, unit_bytes: int) -> tuple[DataFrame, int]:
    """(row, node, unit, near) of all documents, and how many units there are.

    Clusters have up to half a unit and go one behind the other; a unit holds those that begin in its range of bytes. Byte sums
    per bucket of clusters, four to a unit, tell where they begin. What is larger than a unit is spread by row over the units it covers.
    """
    spark = keyed.sparkSession
    sketches = storage.written(keyed.select("row", "text").mapInArrow(_sketched, "row long, node long, size long, low binary"), "sketches")
    nodes = storage.written(sketches.groupBy("node").agg(F.min("low").alias("low"), F.sum("size").alias("size")), "nodes")
    graph = neighbour_graph(nodes)
    total = nodes.agg(F.sum("size")).first()[0] or 0
    n_units = total // unit_bytes + 1
    labels = storage.written(_clusters(nodes, _edges(graph), unit_bytes // 2), "clusters") if n_units > 1 else nodes.select("node", F.col("node").alias("label"))
    bucket = F.pmod(F.xxhash64("label"), F.lit(4 * n_units))
    sized = storage.written(labels.join(nodes.select("node", "size"), "node").groupBy("label").agg(F.sum("size").alias("bytes")).withColumn("bucket", bucket), "cluster_sizes")
    begins, at = [], 0
    for r in sized.groupBy("bucket").agg(F.sum("bytes").alias("bytes")).orderBy("bucket").collect():
        begins.append((r["bucket"], at))
        at += r["bytes"]
    begin = F.broadcast(spark.createDataFrame(begins, "bucket long, begin long"))
    before = F.sum("bytes").over(Window.partitionBy("bucket").orderBy("label").rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes")
    at = sized.withColumn("before", before).join(begin, "bucket").select("label", "bytes", (F.col("begin") + F.col("before")).alias("at"))
    spread = F.when(F.col("bytes") > unit_bytes, (F.pmod(F.xxhash64("row"), F.lit(1 << 20)) / (1 << 20) * F.col("bytes")).cast("long")).otherwise(0)
    rows = sketches.groupBy("row").agg(F.min("node").alias("node")).join(labels, "node").join(at, "label").join(graph.select("node", "near"), "node", "left")
    return storage.written(rows.select("row", "node", F.floor((F.col("at") + spread) / unit_bytes).cast("int").alias("unit"), "near"), "places"), n_units


def _within(node: np.ndarray, near: list[bytes | None]) -> list[list[int]]:
    """Places in node, which is in order, of each one's nearest; those in other units are left out."""
    size = np.array([len(x) // 8 if x else 0 for x in near], np.int64)
    to = np.frombuffer(b"".join([x for x in near if x]), np.int64)
    at = np.minimum(np.searchsorted(node, to), len(node) - 1)
    here = node[at] == to
    return [x[ok].tolist() for x, ok in zip(np.split(at, np.cumsum(size)[:-1]), np.split(here, np.cumsum(size)[:-1]))]


# over tables


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, tokenizer: str | None = None, unit_bytes: int = UNIT_BYTES, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids adds the token ids."""
    path = tokenizer or tokenizer_path()
    id_type = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("row", F.xxhash64("id", "text"))
    places, n_units = _places(keyed, unit_bytes)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        if not sum(b.num_rows for b in rows):
            return
        t = pa.Table.from_batches(rows).sort_by([("node", "ascending"), ("id", "ascending"), ("text", "ascending")], null_placement="at_start")
        unit, texts = t["unit"][0].as_py(), tk.strings(t["text"])
        node, first, many = np.unique(t["node"].to_numpy(), return_index=True, return_counts=True)
        path_ = np.array(walk(_within(node, t["near"].take(pa.array(first)).to_pylist())), np.int64)
        size = many[path_]
        order = np.repeat(first[path_] - (np.cumsum(size) - size), size) + np.arange(len(t))  # documents of equal values follow one another
        ids, size = PieceTokenizer(path).encode(texts.take(pa.array(order)))
        doc, start, length, seq, offset = pieces(size, window)
        at = (np.cumsum(size) - size)[doc] + start
        data = np.ascontiguousarray(ids.astype("<u4"))
        crc = [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(at.tolist(), length.tolist())]
        cols = [t["id"].combine_chunks().take(pa.array(order[doc])), *(pa.array(x) for x in (start, length)), pa.array(crc, pa.int64()), pa.array(size[doc]), pa.array((unit << 40) + seq), pa.array(offset)]
        names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            cols.append(pa.array([data[a : a + n].astype(np.int64) for a, n in zip(at.tolist(), length.tolist())], pa.list_(pa.int64())))
            names.append("ids")
        yield from pa.table(cols, names=names).to_batches(max_chunksize=20_000)

    placed = keyed.join(F.broadcast(places) if places.count() <= BROADCAST_ROWS else places, "row").select("id", "text", "unit", "node", "near")
    schema = f"`{id_col}` {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<long>" if with_ids else "")
    return placed.repartitionById(n_units, "unit").mapInArrow(fill, schema)
