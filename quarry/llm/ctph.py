"""Document fingerprints: context-triggered piecewise hashing.

A hash of the last 7 bytes decides where pieces end: at block size 2^k wherever its k lowest bits are all
set. Every piece gives one of 64 characters. A fingerprint is "block:signature:signature at twice the block",
the block chosen so that the first has at most 64 characters and, if the text allows, at least 32. As
in published fuzzy hashes, what follows the 63rd (31st) boundary is one last piece.

Two fingerprints are compared at a block size that both have: one less the insertions and deletions that turn one
signature into the other, over their joint length; 0 if no run of 7 characters is common (or of half the
shorter signature, where that is less) or no block size is; 1 if the fingerprints are equal.

Defined results: null is the empty text, whose fingerprint is "4::"; of a text of any length the block size grows with it; repeated rows and equal ids are neighbours of each
other in the order of their texts; null ids come after all others; a lone document is its own next one; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from . import units as un

UNIT_BYTES = 8 << 20
WINDOW, LEAST_K, LONG, SHORT, RUN = 7, 2, 64, 32, 7
_ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_LEVELS = 48


class Prints:
    """Fingerprints of n texts as arrays: k, and for both signatures codes (255 beyond the end) and lengths."""

    def __init__(self, k: np.ndarray, sigs: list[tuple[np.ndarray, np.ndarray]]):
        self.k, self.sigs = k, sigs

    def take(self, at: np.ndarray) -> Prints:
        return Prints(self.k[at], [(c[at], n[at]) for c, n in self.sigs])

    def strings(self) -> list[str]:
        chars = [_ALPHABET[np.minimum(c, 63)].tobytes().decode() for c, _ in self.sigs]
        wide = [c.shape[1] for c, _ in self.sigs]
        (_, n1), (_, n2) = self.sigs
        return [f"{1 << k}:{chars[0][i * wide[0] : i * wide[0] + n1[i]]}:{chars[1][i * wide[1] : i * wide[1] + n2[i]]}" for i, k in enumerate(self.k.tolist())]

    @classmethod
    def parse(cls, texts: list[str]) -> Prints:
        back = np.full(256, 255, np.uint8)
        back[_ALPHABET] = np.arange(64)
        k = np.array([int(t.split(":")[0]).bit_length() - 1 for t in texts], np.int64)
        sigs = []
        for j, wide in ((1, LONG), (2, SHORT)):
            codes = np.full((len(texts), wide), 255, np.uint8)
            n = np.zeros(len(texts), np.int64)
            for i, t in enumerate(texts):
                s = back[np.frombuffer(t.split(":")[j].encode(), np.uint8)]
                codes[i, : len(s)], n[i] = s, len(s)
            sigs.append((codes, n))
        return cls(k, sigs)


def _join(parts: list[Prints]) -> Prints:
    if not parts:
        return Prints(np.zeros(0, np.int64), [(np.full((0, w), 255, np.uint8), np.zeros(0, np.int64)) for w in (LONG, SHORT)])
    return Prints(np.concatenate([p.k for p in parts]), [(np.concatenate([p.sigs[j][0] for p in parts]), np.concatenate([p.sigs[j][1] for p in parts])) for j in (0, 1)])


def _signature(at: np.ndarray, doc: np.ndarray, chunk: tk.Chunk, prefix: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    nd = len(chunk)
    begin = np.searchsorted(doc, np.arange(nd))
    nth = np.arange(len(at)) - begin[doc]
    use = nth < wide - 1
    at, doc, nth = at[use], doc[use], nth[use]
    start = np.where(nth > 0, np.roll(at, 1) + 1, chunk.off[doc])
    codes = np.full((nd, wide), 255, np.uint8)
    codes[doc, nth] = (tk.span_hash(prefix, start, at + 1) & np.uint64(63)).astype(np.uint8)
    n = np.bincount(doc, minlength=nd)
    rest = chunk.off[:-1].copy()
    rest[doc] = at + 1  # the last boundary of each document is written last
    more = np.flatnonzero(rest < chunk.off[1:])
    codes[more, n[more]] = (tk.span_hash(prefix, rest[more], chunk.off[1:][more]) & np.uint64(63)).astype(np.uint8)
    n[more] += 1
    return codes, n


def _prints(chunk: tk.Chunk) -> Prints:
    nd, nb = len(chunk), len(chunk.buf)
    prefix = chunk.prefix()
    size = np.diff(chunk.off)
    at = np.arange(nb)
    start = np.maximum(at - (WINDOW - 1), np.repeat(chunk.off[:-1], size))
    rolling = tk.span_hash(prefix, start, at + 1)
    least = np.uint64((1 << LEAST_K) - 1)
    at = np.flatnonzero((rolling & least) == least)
    rolling = rolling[at]
    level = np.full(len(at), LEAST_K)
    on, k = np.arange(len(at)), LEAST_K
    while len(on) and k < _LEVELS - 1:
        on = on[(rolling[on] >> np.uint64(k)) & np.uint64(1) == 1]
        k += 1
        level[on] = k
    doc = chunk.doc_of(at)
    many = np.bincount(doc * _LEVELS + level, minlength=nd * _LEVELS).reshape(nd, _LEVELS)[:, ::-1].cumsum(1)[:, ::-1]
    k = np.full(nd, LEAST_K)
    while (small := (size > (LONG << k))).any():
        k[small] += 1
    rows = np.arange(nd)
    while (few := (k > LEAST_K) & (many[rows, np.minimum(k, _LEVELS - 1)] < SHORT - 1)).any():
        k[few] -= 1
    sigs = []
    for more, wide in ((0, LONG), (1, SHORT)):
        use = level >= k[doc] + more
        sigs.append(_signature(at[use], doc[use], chunk, prefix, wide))
    return Prints(k, sigs)


def fingerprints(texts: pa.Array) -> Prints:
    return _join([_prints(c) for c in tk.chunks(tk.strings(texts))])


# comparison


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each pair of code rows, bit-parallel over a's places."""
    n, wide = a.shape
    v = np.full(n, 2**64 - 1, np.uint64)
    pad = np.full((n, 64), 255, np.uint8)
    pad[:, :wide] = a
    for j in range(b.shape[1]):
        c = b[:, j]
        live = c != 255
        same = pad == np.where(live, c, 254)[:, None]
        m = np.packbits(same, axis=1, bitorder="little").view(np.uint64).ravel()
        u = v & m
        v = (v + u) | (v - u)
    return np.bitwise_count(~v).astype(np.int64)


def _shared_run(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    need = np.minimum(RUN, np.maximum(np.minimum(na, nb) // 2, np.minimum(np.minimum(na, nb), 1)))
    out = np.zeros(len(a), bool)

    def runs(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = x.shape[1] - RUN + 1
        g = np.zeros((len(x), m), np.uint64)
        for j in range(RUN):
            g = (g << np.uint64(6)) | x[:, j : j + m].astype(np.uint64)
        return g, np.arange(m)[None, :] <= (n - RUN)[:, None]

    full = np.flatnonzero(need == RUN)
    if len(full):
        ga, oka = runs(a[full], na[full])
        gb, okb = runs(b[full], nb[full])
        gb = np.where(okb, gb, np.uint64(2**64 - 1))
        hit = np.zeros(len(full), bool)
        for j in range(ga.shape[1]):
            hit |= ((gb == ga[:, j : j + 1]).any(1)) & oka[:, j]
        out[full] = hit
    for i in np.flatnonzero((need > 0) & (need < RUN)):
        x, y, m = a[i, : na[i]].tobytes(), b[i, : nb[i]].tobytes(), need[i]
        out[i] = any(x[j : j + m] in y for j in range(len(x) - m + 1))
    return out


def _score(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    (ca, na), (cb, nb) = a, b
    total = na + nb
    sim = np.where(total > 0, 2 * _common(ca, cb) / np.maximum(total, 1), 0.0)
    return np.where(_shared_run(ca, na, cb, nb), sim, 0.0)


def compare(a: Prints, b: Prints) -> np.ndarray:
    """Likeness, 0 to 1, of the i-th fingerprints of a and b."""
    out = np.zeros(len(a.k))
    for shift, pairs in ((0, ((0, 0), (1, 1))), (1, ((0, 1),)), (-1, ((1, 0),))):
        at = np.flatnonzero(a.k - b.k == shift)
        if len(at):
            x, y = a.take(at), b.take(at)
            out[at] = np.max([_score(x.sigs[i], y.sigs[j]) for i, j in pairs], axis=0)
    same = a.k == b.k
    for (ca, na), (cb, nb) in zip(a.sigs, b.sigs):
        same &= (na == nb) & (ca[:, : cb.shape[1]] == cb).all(1)
    return np.where(same, 1.0, out)


# over tables


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every row."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints(b.column(1)).strings(), pa.string())], [id_col, "fingerprint"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, fingerprint string")


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like they are.

    The edited text has the last third replaced by as much of the beginning of the next document in descending order of id.
    Rows are shuffled once, to units that are ranges of ids; the first row of each unit also goes to the unit before it.
    """
    units = un.make(docs, id_col, text_col, unit_bytes)
    own = docs.select(un.key_of(id_col).alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), units.of(id_col).alias("unit"))
    # the largest id of each unit: as many rows as there are units
    top = sorted((r["unit"], r["top"]) for r in own.groupBy("unit").agg(F.max("key").alias("top")).collect())
    heads = np.array([t for _, t in top], np.int64)
    to = np.array([u for u, _ in top[1:]] + [u for u, _ in top[:1]], np.int32)

    @F.pandas_udf("array<int>")
    def copies(key: pd.Series, unit: pd.Series) -> pd.Series:
        # the own unit u as 2u; the unit that needs this row as its last one's successor as 2u + 1
        i = np.minimum(np.searchsorted(heads, key.to_numpy(np.int64)), max(0, len(heads) - 1))
        is_head = heads[i] == key.to_numpy() if len(heads) else np.zeros(len(key), bool)
        return pd.Series([[2 * u, 2 * int(to[j]) + 1] if h else [2 * u] for u, h, j in zip(unit.tolist(), is_head.tolist(), i.tolist())])

    sent = own.withColumn("place", F.explode(copies("key", "unit"))).select("key", "id", "text", F.shiftright("place", 1).alias("unit"), (F.col("place") % 2 == 1).alias("extra"))
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(t: pa.Table) -> pa.Table:
        t = t.set_column(t.column_names.index("text"), "text", tk.strings(t["text"]))
        t = t.sort_by([("extra", "ascending"), ("key", "descending"), ("text", "ascending")])
        n = t["extra"].to_numpy().tolist().index(True) if t["extra"].to_numpy().any() else t.num_rows
        t = t.slice(0, n + 1)
        texts = tk.strings(t["text"])
        words = texts.to_pylist()
        edited, sha = [], []
        for i in range(n):
            a, b = words[i], words[i + 1]
            k = len(a) // 3
            e = a[: len(a) - k] + b[:k]
            edited.append(e)
            sha.append(hashlib.sha256(e.encode()).hexdigest())
        whole = fingerprints(texts)
        new = fingerprints(pa.array(edited, pa.string()))
        mine, nxt = whole.take(np.arange(n)), whole.take(np.arange(1, n + 1))
        return pa.table(
            [t["id"].slice(0, n), pa.array([len(w) for w in words[:n]], pa.int64()), pa.array(sha, pa.string()), pa.array(mine.strings(), pa.string()), pa.array(new.strings(), pa.string()), pa.array(compare(mine, new)), pa.array(compare(mine, nxt))],
            names=[id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    return sent.repartitionById(units.n, "unit").groupBy("unit").applyInArrow(run, schema)
