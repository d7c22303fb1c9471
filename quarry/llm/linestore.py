"""Line dedup: sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased. The exact table has
one row per key: how many documents hold it and the smallest and largest of their ids; keys are split into
shards by hash. Each shard's cuckoo filter answers "may several documents hold this key?" from
two bytes a key. While all filters together have at most FILTER_BYTES they go to the scan of the postings, and the many
lines that one document holds go no further; the exact table decides on what passes. Larger filters stay where they are, and the exact table decides alone, with the same result.

``LineStore`` keeps postings, counts and filters in shared storage: ``insert`` adds documents, ``delete`` takes documents out again (counts fall, a key that
reaches one document leaves its filter), so the result after any sequence is that of the documents that are left.

Defined results: null or empty text is one empty line; keys shorter than ``min_chars`` code points are
never dropped; a line of any length has a key of 16 bytes; rows with the same id count as one document (every row keeps the lines its id keeps);
rows with a null id are kept whole and hold nothing; an empty table gives an empty result; columns
besides id and text are passed through by ``dedup_lines`` whatever they are called.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage
from . import textkernel as tk

MIN_CHARS = 10
FILTER_BYTES = 64 << 20  # of all filters together, sent to every executor
SHARD_KEYS = 1_000_000  # a shard's filter is built by one task
HOT_SHARE = 1000  # a key is hot from 1/HOT_SHARE of all postings on; so at most HOT_SHARE keys are
_STRIP = b" \t\n\x0b\x0c\r"


# the filter


class CuckooFilter:
    """Partial-key cuckoo hashing, 4 slots a bucket, 16-bit fingerprints; whole arrays at a time."""

    SLOTS = 4

    def __init__(self, n: int, table: np.ndarray | None = None):
        need = max(2, int(n / (self.SLOTS * 0.85)) + 1)
        self.buckets = 1 << (need - 1).bit_length()
        self.table = np.zeros((self.buckets, self.SLOTS), np.uint16) if table is None else table

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter that holds the keys; built larger until all of them find a place."""
        n = len(keys)
        while True:
            f = cls(n)
            if f.insert(keys):
                return f
            n = max(2 * n, 8)

    @classmethod
    def load(cls, blob: bytes) -> CuckooFilter:
        t = np.frombuffer(blob, np.uint16).reshape(-1, cls.SLOTS).copy()
        f = cls(0, t)
        f.buckets = len(t)
        return f

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = tk.mix(keys.astype(np.uint64))
        print_ = ((h >> np.uint64(48)) % np.uint64(65535)).astype(np.uint16) + np.uint16(1)
        one = (h & np.uint64(self.buckets - 1)).astype(np.int64)
        return print_, one, self._other(one, print_)

    def _other(self, bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
        return bucket ^ (tk.mix(print_.astype(np.uint64)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def insert(self, keys: np.ndarray) -> bool:
        """Adds distinct keys; False if some found no place (the filter is then incomplete)."""
        print_, at, _ = self._places(keys)
        rng = np.random.Generator(np.random.PCG64(1))
        for turn in range(500):
            if not len(at):
                return True
            # as many of each bucket's newcomers as it has free slots
            order = np.argsort(at, kind="stable")
            at, print_ = at[order], print_[order]
            first = np.r_[True, at[1:] != at[:-1]]
            nth = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            free = self.table[at] == 0
            rank = np.cumsum(free, 1) * free
            fits = nth < free.sum(1)
            slot = np.argmax(rank == (nth + 1)[:, None], 1)
            self.table[at[fits], slot[fits]] = print_[fits]
            at, print_ = at[~fits], print_[~fits]
            if not len(at):
                return True
            if turn % 2 == 0:
                at = self._other(at, print_)  # the other bucket may have room
                continue
            # both full: the first newcomer of a bucket takes the place of one that moves on
            first = np.r_[True, at[1:] != at[:-1]] if len(at) else np.zeros(0, bool)
            order = np.argsort(at, kind="stable")
            at, print_ = at[order], print_[order]
            first = np.r_[True, at[1:] != at[:-1]]
            s = rng.integers(0, self.SLOTS, int(first.sum()))
            out = self.table[at[first], s].copy()
            self.table[at[first], s] = print_[first]
            moved = out != 0
            nxt = self._other(at[first], out)
            at = np.concatenate([nxt[moved], at[~first]])
            print_ = np.concatenate([out[moved], print_[~first]])
        return False

    def contains(self, keys: np.ndarray) -> np.ndarray:
        print_, one, two = self._places(keys)
        return (self.table[one] == print_[:, None]).any(1) | (self.table[two] == print_[:, None]).any(1)

    def delete(self, keys: np.ndarray) -> None:
        """Removes keys that were inserted."""
        print_, one, two = self._places(keys)
        for at in (one, two):
            left = np.arange(len(print_))
            while len(left):
                _, first = np.unique(at[left], return_index=True)  # one of each bucket at a time
                turn = left[first]
                hit = self.table[at[turn]] == print_[turn][:, None]
                has = hit.any(1)
                self.table[at[turn[has]], np.argmax(hit[has], 1)] = 0
                print_[turn[has]] = 0
                left = np.setdiff1d(left, turn, assume_unique=True)
            rest = print_ > 0
            print_, two = print_[rest], two[rest]


def filter_key(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    return k1.view(np.uint64) ^ k2.view(np.uint64)


# keys


def line_key(line: bytes, min_chars: int) -> bytes | None:
    k = line.strip(_STRIP).lower()  # bytes.lower() changes A-Z only
    n = len(k)
    if n < min_chars or (n < 4 * min_chars and len(k.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(k)


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(k1, k2, id) for each distinct key of each row."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = tk.buffers(tk.strings(b.column(1)))
            data, keys, owner = buf.tobytes(), [], []
            for i in range(len(off) - 1):
                own = {line_key(x, min_chars) for x in data[off[i] : off[i + 1]].split(b"\n")}
                own.discard(None)
                keys.extend(own)
                owner.extend([i] * len(own))
            k = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy()), b.column(0).take(pa.array(owner, pa.int64()))], ["k1", "k2", "id"])

    source = docs.where(F.col(id_col).isNotNull()).select(id_col, text_col)
    return source.mapInArrow(run, f"k1 long, k2 long, id {id_type}")


def counts(posted: DataFrame) -> DataFrame:
    """The exact table: each key's number of documents and smallest id. Combines before it shuffles."""
    # min = max tells a key that one document holds, however often that id is repeated
    return posted.groupBy("k1", "k2").agg(F.count("*").alias("refs"), F.min("id").alias("least"), F.max("id").alias("most"))


def _shard(shards: int) -> Column:
    return F.pmod(F.col("k1"), F.lit(shards)).cast("int").alias("shard")


def filters(held: DataFrame, shards: int) -> DataFrame:
    """(shard, keys, filter): a filter of each shard's keys."""

    def build(t: pd.DataFrame) -> pd.DataFrame:
        f = CuckooFilter.of(filter_key(t["k1"].to_numpy(), t["k2"].to_numpy()))
        return pd.DataFrame({"shard": [int(t["shard"].iloc[0])], "keys": [len(t)], "filter": [f.dump()]})

    return held.select("k1", "k2", _shard(shards)).groupBy("shard").applyInPandas(build, "shard int, keys long, filter binary")


def may_be_held(posted: DataFrame, built: DataFrame, shards: int) -> DataFrame:
    """The postings whose keys the filters let pass; all of them if the filters are too large to be sent."""
    built = storage.written(built, "line_filters")
    if (built.agg(F.sum(F.length("filter"))).first()[0] or 0) > FILTER_BYTES:
        return posted
    sent = posted.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["filter"]) for r in built.collect()})
    names = posted.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {s: CuckooFilter.load(b) for s, b in sent.value.items()}
        for b in batches:
            k1, k2 = (b.column(names.index(k)).to_numpy() for k in ("k1", "k2"))
            key, shard = filter_key(k1, k2), k1 % shards
            ok = np.zeros(len(key), bool)
            for s in np.unique(shard).tolist():
                at = np.flatnonzero(shard == s)
                if s in known:
                    ok[at] = known[s].contains(key[at])
            yield b.filter(pa.array(ok))

    return posted.mapInArrow(run, posted.schema)


def drops(posted: DataFrame, table: DataFrame, built: DataFrame | None = None, shards: int | None = None) -> DataFrame:
    """(id, keys): the keys whose lines the document loses, 16 bytes each.

    Hot keys, at most HOT_SHARE of them by their share of all postings, are looked up without a
    shuffle; of the others none fills more than 1/HOT_SHARE of the postings, so hashing spreads them.
    """
    held = table.where("least <> most")
    if built is None:
        shards = -(-held.count() // SHARD_KEYS) or 1
        built = filters(held, shards)
    passed = may_be_held(posted, built, shards)
    total = table.agg(F.sum("refs")).first()[0] or 0
    is_hot = F.col("refs") * HOT_SHARE >= F.lit(total)
    hot = F.broadcast(held.where(is_hot).select("k1", "k2", F.col("least").alias("hot")))
    looked = passed.join(hot, ["k1", "k2"], "left")
    by_hot = looked.where("hot is not null and id <> hot").select("k1", "k2", "id")
    others = looked.where("hot is null").select("k1", "k2", "id").join(held.where(~is_hot).select("k1", "k2", "least"), ["k1", "k2"]).where("id <> least").select("k1", "k2", "id")
    key = F.concat(F.lpad(F.hex("k1"), 16, "0"), F.lpad(F.hex("k2"), 16, "0"))
    return by_hot.unionAll(others).groupBy("id").agg(F.unhex(F.concat_ws("", F.array_sort(F.collect_list(key)))).alias("keys"))


def _lose(text: bytes, keys: bytes | None, min_chars: int) -> tuple[bytes, int, int]:
    """(what is left, lines before, lines dropped)."""
    lines = text.split(b"\n")
    if not keys:
        return text, len(lines), 0
    gone = {keys[i : i + 16] for i in range(0, len(keys), 16)}
    left = [x for x in lines if _big_endian(line_key(x, min_chars)) not in gone]
    return b"\n".join(left), len(lines), len(lines) - len(left)


def _big_endian(key: bytes | None) -> bytes | None:
    return key and key[7::-1] + key[:7:-1]


def _apply(docs: DataFrame, lost: DataFrame, id_col: str, run: Callable, schema) -> DataFrame:
    # aliases by position: whatever the other columns are called, nothing clashes
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(id_col)
    joined = docs.toDF(*names).join(lost.toDF("lost_id", "lost_keys"), F.col(names[at]) == F.col("lost_id"), "left").drop("lost_id")
    return joined.mapInArrow(run, schema)


def _losses(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    posted = postings(docs, id_col, text_col, min_chars)
    # read by the counts, the filters and the joins: written once rather than worked out thrice
    posted = storage.written(posted, "line_postings")
    table = storage.written(counts(posted), "line_counts")
    return drops(posted, table)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents, all columns, each text without the lines that a document of a smaller id holds."""
    at, size, names = docs.columns.index(text_col), len(docs.columns), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            was, keys = b.column(at), b.column(size).to_pylist()
            new = [None if t is None else _lose(t.encode(), k, min_chars)[0].decode() if k else t for t, k in zip(was.to_pylist(), keys)]
            cols = [b.column(i) if i != at else pa.array(new, was.type) for i in range(size)]
            yield pa.RecordBatch.from_arrays(cols, names)

    return _apply(docs, _losses(docs, id_col, text_col, min_chars), id_col, run, docs.schema)


def line_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """Per document: n_lines, n_dropped and the hash of the text that dedup_lines() leaves."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_lose((t or "").encode(), k, min_chars) for t, k in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([hashlib.sha256(r[0]).hexdigest() for r in rows], pa.string())],
                [id_col, "n_lines", "n_dropped", "kept_sha256"],
            )

    lost = _losses(docs, id_col, text_col, min_chars)
    return _apply(docs.select(id_col, text_col), lost, id_col, run, f"`{id_col}` {id_type}, n_lines long, n_dropped long, kept_sha256 string")


# the incremental store


class LineStore:
    """Postings, exact counts and per-shard filters below ``path`` (shared storage), changed shard by shard.

    A change writes the shards it touches under a name of its own, then a manifest of what holds for each shard, and last the pointer
    to that, so that a lost job leaves the store as it was and a store that is opened again goes on where it stood. If another writer came
    first the change is refused. ``insert`` ignores documents already held; ``delete`` ignores those that aren't. ``vacuum`` deletes what no manifest needs any more.
    """

    TABLES = ("postings", "counts", "filters")

    def __init__(self, spark: SparkSession, path: str, shards: int = 64, min_chars: int = MIN_CHARS):
        self.spark, self.path = spark, path.rstrip("/")
        found = self._read("CURRENT")
        self.state = json.loads(found) if found else {"version": 0, "shards": shards, "min_chars": min_chars, "parts": {}, "ids": []}
        self.shards, self.min_chars = self.state["shards"], self.state["min_chars"]

    # files

    def _fs(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _read(self, name: str) -> str | None:
        fs, at = self._fs(name)
        return "".join(r[0] for r in self.spark.read.text(str(at), wholetext=True).collect()) if fs.exists(at) else None

    def _put(self, name: str, text: str) -> None:
        """Writes a file beside its place and moves it there."""
        fs, at = self._fs(f"{name}.{uuid.uuid4().hex}")
        out = fs.create(at, False)
        out.write(bytearray(text.encode()))
        out.close()
        _, to = self._fs(name)
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self.spark._jsc.hadoopConfiguration())
        how = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(context.makeQualified(at), context.makeQualified(to), how)

    def _table(self, name: str, of: list[int] | None = None) -> DataFrame:
        id_type = self.state.get("id_type", "bigint")
        kinds = {"postings": f"k1 long, k2 long, id {id_type}", "counts": f"k1 long, k2 long, refs long, least {id_type}, most {id_type}", "filters": "keys long, filter binary"}
        paths = [f"{self.path}/{name}/{v}/shard={s}" for s, v in self.state["parts"].items() if of is None or int(s) in of]
        if not paths:
            return self.spark.createDataFrame([], f"{kinds[name]}, shard int")
        # a filter knows its shard, the other tables have it by their keys
        if name == "filters":
            return self.spark.read.schema(f"{kinds[name]}, of int").parquet(*paths).withColumnRenamed("of", "shard")
        return self.spark.read.schema(kinds[name]).parquet(*paths).select("*", _shard(self.shards))

    def postings(self) -> DataFrame:
        return self._table("postings").drop("shard")

    def counts(self) -> DataFrame:
        return self._table("counts").drop("shard")

    def filters(self) -> DataFrame:
        return self._table("filters").select("shard", "keys", "filter")

    def ids(self) -> DataFrame:
        """(id) of the documents held."""
        id_type = self.state.get("id_type", "bigint")
        if not self.state["ids"]:
            return self.spark.createDataFrame([], f"id {id_type}")
        log = self.spark.read.schema(f"id {id_type}, at long, held boolean").parquet(*[f"{self.path}/ids/{v}" for v in self.state["ids"]])
        return log.groupBy("id").agg(F.max(F.struct("at", "held")).alias("last")).where("last.held").select("id")

    # changes

    def _commit(self, state: dict, name: str, touched: list[int], posted: DataFrame, counted: DataFrame, ids: DataFrame, held: bool) -> None:
        """posted, counted: all rows of the touched shards after the change."""
        version = self.state["version"] + 1
        write = lambda df, table: df.repartition("shard").write.partitionBy("shard").parquet(f"{self.path}/{table}/{name}")
        write(posted, "postings")
        write(counted, "counts")
        now = self.spark.read.schema(counted.drop("shard").schema).parquet(f"{self.path}/counts/{name}")
        both = (
            now.where("least <> most").select("k1", "k2", F.lit(True).alias("now"))
            .join(self._table("counts", touched).where("least <> most").select("k1", "k2", F.lit(True).alias("was")), ["k1", "k2"], "full")
            .select("k1", "k2", F.coalesce("now", F.lit(False)).alias("now"), F.coalesce("was", F.lit(False)).alias("was"), _shard(self.shards))
        )
        # a row for each shard, so that one without such keys has a filter too
        every = self.spark.createDataFrame([(0, 0, False, False, s) for s in touched], "k1 long, k2 long, now boolean, was boolean, shard int")

        def change(key: tuple, keys: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
            k, now, was = filter_key(keys["k1"].to_numpy(), keys["k2"].to_numpy()), keys["now"].to_numpy(bool), keys["was"].to_numpy(bool)
            f = CuckooFilter.load(old["filter"].iloc[0]) if len(old) else CuckooFilter(int(now.sum()))
            f.delete(k[was & ~now])
            if not f.insert(k[now & ~was]):  # full: a larger one
                f = CuckooFilter.of(k[now])
            return pd.DataFrame({"keys": [int(now.sum())], "filter": [f.dump()], "of": [int(key[0])], "shard": [int(key[0])]})

        built = both.unionByName(every).groupBy("shard").cogroup(self._table("filters", touched).groupBy("shard")).applyInPandas(change, "keys long, filter binary, of int, shard int")
        write(built, "filters")
        ids.select("id", F.lit(version).cast("long").alias("at"), F.lit(held).alias("held")).write.parquet(f"{self.path}/ids/{name}")
        # a shard that lost its last key has no folder
        kept = {int(r[0]) for r in self.spark.read.parquet(f"{self.path}/postings/{name}").select("shard").distinct().collect()} if not posted.isEmpty() else set()
        parts = {s: v for s, v in state["parts"].items() if int(s) not in touched} | {str(s): name for s in touched if s in kept}
        new = state | {"version": version, "parts": parts, "ids": [*state["ids"], name], "shards": self.shards, "min_chars": self.min_chars}
        there = self._read("CURRENT")
        if (json.loads(there)["version"] if there else 0) != self.state["version"]:
            raise RuntimeError("another writer has changed the store; open it again")
        self._put(f"manifests/v{version}.json", json.dumps(new))
        self._put("CURRENT", json.dumps(new))
        self.state = new

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Adds the documents that aren't held yet; rows of one id are one document."""
        state = dict(self.state)
        state.setdefault("id_type", docs.schema[id_col].dataType.simpleString())
        self.state = self.state | {"id_type": state["id_type"]}
        fresh = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(self.ids(), "id", "left_anti")
        with storage.scope():
            new = storage.written(postings(fresh, "id", "text", self.min_chars).distinct().select("*", _shard(self.shards)), "new_postings")
            touched = sorted(r[0] for r in new.select("shard").distinct().collect())
            added = counts(new).select("k1", "k2", "refs", "least", "most")
            sums = self._table("counts", touched).drop("shard").unionByName(added).groupBy("k1", "k2").agg(F.sum("refs").alias("refs"), F.min("least").alias("least"), F.max("most").alias("most"))
            self._commit(state, f"c{state['version'] + 1}-{uuid.uuid4().hex[:8]}", touched, self._table("postings", touched).unionByName(new), sums.select("*", _shard(self.shards)), fresh.select("id").distinct(), True)

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> None:
        """Takes documents out."""
        gone = ids.select(F.col(id_col).alias("id")).where("id is not null").distinct().join(self.ids(), "id", "left_semi")
        with storage.scope():
            gone = storage.written(gone, "gone")
            touched = sorted(r[0] for r in self._table("postings").join(gone, "id", "left_semi").select("shard").distinct().collect())
            left = storage.written(self._table("postings", touched).join(gone, "id", "left_anti").select("k1", "k2", "id", "shard"), "left_postings")
            self._commit(dict(self.state), f"c{self.state['version'] + 1}-{uuid.uuid4().hex[:8]}", touched, left, counts(left).select("*", _shard(self.shards)), gone, False)

    def vacuum(self) -> None:
        """Deletes the shards and manifests of earlier versions."""
        used = {t: {f"{v}/shard={s}" for s, v in self.state["parts"].items()} for t in self.TABLES}
        for t in self.TABLES:
            fs, at = self._fs(t)
            for change in fs.listStatus(at) if fs.exists(at) else []:
                for part in fs.listStatus(change.getPath()):
                    name = f"{change.getPath().getName()}/{part.getPath().getName()}"
                    if part.isDirectory() and name not in used[t]:
                        fs.delete(part.getPath(), True)
        fs, at = self._fs("manifests")
        for f in fs.listStatus(at) if fs.exists(at) else []:
            if f.getPath().getName() != f"v{self.state['version']}.json":
                fs.delete(f.getPath(), True)

    def dedup(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Held documents without the lines that a smaller held id has."""
        at, size, names, min_chars = docs.columns.index(text_col), len(docs.columns), docs.columns, self.min_chars

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                new = [None if t is None else _lose(t.encode(), k, min_chars)[0].decode() for t, k in zip(b.column(at).to_pylist(), b.column(size).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(i) if i != at else pa.array(new, b.column(at).type) for i in range(size)], names)

        return _apply(docs, drops(self.postings(), self.counts(), self.filters(), self.shards), id_col, run, docs.schema)
