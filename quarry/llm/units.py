"""Units: ranges of documents by id, sized to a task's memory, the same however often they are worked out.

The bounds follow the bytes of text, however they lie among the ids. They are fixed once on the driver (as many ids as there are units), so a task that is run again finds
the same documents. Ids must be integers; null counts as smaller than any. The number of units grows with
the bytes of text; their size is a parameter.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT_BYTES = 16 << 20
QUANTILES = 2000
LEAST = -(1 << 63)


def key_of(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST))


@dataclass(frozen=True)
class Units:
    bounds: np.ndarray  # unit u holds ids in (bounds[u - 1], bounds[u]]

    @property
    def n(self) -> int:
        return len(self.bounds) + 1

    def of(self, id_col: str) -> Column:
        bounds = self.bounds

        @F.pandas_udf("int")
        def unit(ids: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(bounds, ids.to_numpy(np.int64), "left").astype(np.int32))

        return unit(key_of(id_col))


def make(docs: DataFrame, id_col: str, text_col: str, unit_bytes: int = UNIT_BYTES) -> Units:
    """Bounds for units of about unit_bytes of text each.

    Quantiles of the ids give ranges, at most QUANTILES at first; ranges with much more than a unit's bytes are cut at quantiles of their own ids until none
    is left that can be cut, and neighbours that are small are put together. What can't be cut by ids is one unit: a document, the rows of one id, the rows without an id.
    """
    octets = F.octet_length(F.col(text_col)).cast("long")
    size, rows = docs.agg(F.sum(octets), F.count("*")).first()
    n = max(1, -(-(size or 0) // unit_bytes))
    if n == 1 or not rows:
        return Units(np.zeros(0, np.int64))
    q = min(n, QUANTILES)
    found = docs.agg(F.percentile_approx(key_of(id_col), [i / q for i in range(1, q)], 100 * q)).first()[0] if q > 1 else []
    edges = {int(x) for x in found or []}
    keyed = docs.select(key_of(id_col).alias("key"), F.coalesce(octets, F.lit(0)).alias("bytes"))
    for _ in range(4):
        units = Units(np.array(sorted(edges), np.int64))
        # as many rows as there are units
        sums = keyed.groupBy(units.of("key").alias("unit")).agg(F.sum("bytes").alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
        heavy = [r["unit"] for r in sums if 2 * r["bytes"] > 3 * unit_bytes and r["low"] < r["high"]]
        if not heavy:
            break
        large = F.broadcast(docs.sparkSession.createDataFrame([(u,) for u in heavy], "unit int"))
        most = max(r["bytes"] for r in sums) // unit_bytes + 1
        parts = int(min(64, max(2, 2 * most)))
        cut = keyed.withColumn("unit", units.of("key")).join(large, "unit").groupBy("unit").agg(F.percentile_approx("key", [i / parts for i in range(1, parts)], 100 * parts).alias("at"), F.min("key").alias("low"), F.max("key").alias("high"))
        new = {int(x) for r in cut.collect() for x in (*r["at"], r["low"]) if x < r["high"]} - edges
        if not new:
            break
        edges |= new
    units = Units(np.array(sorted(edges), np.int64))
    weight = np.zeros(units.n, np.int64)
    for r in keyed.groupBy(units.of("key").alias("unit")).agg(F.sum("bytes").alias("bytes")).collect():
        weight[r["unit"]] = r["bytes"]
    kept, held = [], 0
    for i, bound in enumerate(units.bounds.tolist()):
        held += weight[i]
        # a bound stays unless what is before and behind it fits one unit
        if 4 * (held + weight[i + 1]) > 5 * unit_bytes:
            kept.append(bound)
            held = 0
    return Units(np.array(kept, np.int64))


def blobs(parts: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.Table:
    return pa.table({n: pa.array([p[i] for p in parts], t) for i, (n, t) in enumerate(zip(names, types))})


def split_by(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places) of each bucket that occurs; places keep their order."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    at = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
    for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(b)]):
        yield int(b[lo]), order[lo:hi]


Rows = Callable[[pa.Table], pa.Table]


def trim() -> None:
    """Gives memory that earlier tasks of this worker have freed back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


# compact columns


def squeeze(values: np.ndarray) -> bytes:
    """Values of 8 bytes as byte planes, compressed; of integers that aren't negative only the planes that the largest needs."""
    n = len(values)
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8)) if values.dtype.kind in "iu" else 8
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(n, 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expand(blob: bytes, dtype) -> np.ndarray:
    width = blob[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8).reshape(width, -1)
    full = np.zeros((planes.shape[1], 8), np.uint8)
    full[:, :width] = planes.T
    return full.view(dtype).ravel()


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values in order, a place of each, of each value its number among them)."""
    # sorting values whose low bits are their places is several times faster than sorting places; if two
    # different values agree in what is left of them, the slower way is taken
    low = np.uint64((1 << max(1, (len(values) - 1).bit_length())) - 1)
    key = values & ~low
    key |= np.arange(len(values), dtype=np.uint64)
    key.sort()
    order = (key & low).view(np.int64)
    v = values[order]
    first = np.ones(len(v), bool)
    first[1:] = v[1:] != v[:-1]
    key &= ~low
    same = bool((first[1:] & (key[1:] == key[:-1])).any())
    del key
    if same:
        order = np.argsort(values)
        v = values[order]
        first[1:] = v[1:] != v[:-1]
    del values
    nth = np.cumsum(first, dtype=np.int32)
    nth -= np.int32(1)
    number = np.empty(len(v), np.int32)
    number[order] = nth
    del nth
    return v[first], order[first], number


def squeeze_sorted(values: np.ndarray) -> bytes:
    """Ascending 64-bit values by their differences, in as many bytes as the largest of them needs."""
    d = np.diff(values, prepend=np.uint64(0))
    width = max(1, -(-int(d.max()).bit_length() // 8)) if len(d) else 1
    planes = np.ascontiguousarray(d).view(np.uint8).reshape(len(d), 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expand_sorted(blob: bytes) -> np.ndarray:
    width = blob[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8).reshape(width, -1)
    full = np.zeros((planes.shape[1], 8), np.uint8)
    full[:, :width] = planes.T
    return np.cumsum(full.view(np.uint64).ravel(), dtype=np.uint64)


def packed(docs: DataFrame, units: Units, id_col: str, text_col: str) -> DataFrame:
    """(unit, rows): per batch of the scan and unit one compressed Arrow stream of (id, text), so that texts take less room between tasks."""
    bounds = units.bounds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = pc.fill_null(b.column(0).cast(pa.int64()), LEAST).to_numpy(zero_copy_only=False)
            of, blobs_ = [], []
            for u, at in split_by(np.searchsorted(bounds, ids, "left")):
                part = b.take(pa.array(at))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_batch(part)
                of.append(u)
                blobs_.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(blobs_, pa.binary())], ["unit", "rows"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "unit int, rows binary")


def unpacked(t: pa.Table) -> pa.Table:
    """The (id, text) rows of a unit."""
    return pa.concat_tables([pa.ipc.open_stream(pa.BufferReader(b.as_buffer())).read_all() for b in t["rows"]])
