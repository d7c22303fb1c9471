"""Vectorised text primitives shared by the operators of this subpackage.

Everything works on the UTF-8 bytes of an Arrow string column without copying it: words are
runs of bytes outside ``\\x20\\x09-\\x0D`` (all ASCII, so no multi-byte character is ever cut),
and a word, line or n-gram gets a 64-bit hash from differences of one running sum, a handful
of numpy operations per byte instead of a Python call per word.

Documents are taken in chunks of about a megabyte that never cut a document; a longer document
is a chunk of its own and only enlarges the power tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240611))
#: A random 64-bit value for each byte; LOWER maps A-Z to the values of a-z.
EXACT = _rng.integers(1, 2**64 - 1, 256, dtype=U64)
LOWER = EXACT.copy()
LOWER[65:91] = EXACT[97:123]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)


class _Powers:
    """p**i and p**-i modulo 2**64, extended on demand."""

    def __init__(self) -> None:
        self.pow = np.ones(1, U64)
        self.inv = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.pow) <= n:
            size = max(n + 1, int(CHUNK_BYTES * 1.25))
            for name, base in (("pow", _P), ("inv", _PINV)):
                x = np.full(size, base, U64)
                x[0] = 1
                with np.errstate(over="ignore"):
                    np.multiply.accumulate(x, out=x)
                setattr(self, name, x)
        return self.pow, self.inv


_POWERS = _Powers()


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (all bits depend on all bits)."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One contiguous string array; null becomes the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "") if column.null_count else column


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array without nulls."""
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, off, data = array.buffers()
    if off is None or len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    o = np.frombuffer(off, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    b = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return b[o[0] : o[-1]], o - o[0]


class Chunk:
    """Documents lo..hi of a batch: their bytes and where each begins (off has hi - lo + 1 entries)."""

    __slots__ = ("lo", "hi", "buf", "off")

    def __init__(self, lo: int, hi: int, buf: np.ndarray, off: np.ndarray):
        self.lo, self.hi, self.buf, self.off = lo, hi, buf, off

    def __len__(self) -> int:
        return self.hi - self.lo

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.off, at, "right") - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, document) of every word, in text order."""
        n = len(self.buf)
        if n == 0:
            z = np.zeros(0, np.int64)
            return z, z, z
        solid = ~SPACE[self.buf]
        cut = self.off[:-1]
        cut = cut[cut < n]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        first[cut] = solid[cut]
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        before = cut[cut > 0] - 1
        last[before] = solid[before]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        return s, e, self.doc_of(s)

    def prefix(self, table: np.ndarray = EXACT) -> np.ndarray:
        """Running sum from which span_hash() takes the hash of any span of bytes."""
        n = len(self.buf)
        p, _ = _POWERS.upto(n)
        v = table[self.buf]
        v *= p[:n]
        out = np.zeros(n + 1, U64)
        np.cumsum(v, out=out[1:])
        return out

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """How many of the bytes are flagged, per document."""
        c = np.zeros(len(self.buf) + 1, np.int64)
        np.cumsum(flags, out=c[1:])
        return c[self.off[1:]] - c[self.off[:-1]]


def span_hash(prefix: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    _, inv = _POWERS.upto(len(prefix))
    h = prefix[e] - prefix[s]
    h *= inv[s]
    h += (e - s).astype(U64)
    return mix(h)


def chunks(array: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    buf, off = buffers(array)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        hi = min(hi, n)
        yield Chunk(lo, hi, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi


def by_doc(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Order by document, then hash: one fast sort and a stable one of small numbers instead of two stable ones."""
    order = np.argsort(h)
    d = doc[order]
    small = len(d) == 0 or int(d.max()) < 1 << 16
    return order[np.argsort(d.astype(np.uint16) if small else d, kind="stable")]


def gram_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive values; the caller masks those that cross a document."""
    m = max(0, len(h) - n + 1)
    g = np.zeros(m, U64)
    for k in range(n):
        g *= U64(0xD6E8FEB86659FD93)
        g += h[k : k + m]
    return mix(g)


def within(doc: np.ndarray, n: int) -> np.ndarray:
    """For every n consecutive words, whether they lie in one document."""
    m = max(0, len(doc) - n + 1)
    return doc[:m] == doc[n - 1 : n - 1 + m]


def cover(starts: np.ndarray, length: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n places the spans [start, start + length) cover."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.subtract.at(d, starts + length, 1)
    return np.cumsum(d[:-1]) > 0


def code_points(buf: np.ndarray) -> np.ndarray:
    """Flags the first byte of each code point."""
    return (buf & 0xC0) != 0x80
