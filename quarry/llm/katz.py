"""LM scoring: a Katz backoff model learnt from part of the documents that scores all of them.

Tokens are the words with A-Z lower-cased and one end after each text; histories before the first word are filled with a
begin mark that is never predicted. Level 1 gives every known token (c + 0.5) / (N + 0.5 (V + 1)) and the same with
c = 0 to the one class of unknown tokens, which sums to 1. At level m > 1 a seen n-gram keeps d(c) c / c(h), d being Good-Turing
discounts for c <= 5 (absolute discounts where the counts of counts give no valid ones), and an unseen one gets
alpha(h) P(w | h'), with alpha(h) = (1 - kept mass) / (1 - lower mass of the seen) so that every history sums to 1. If no n-gram
of a history is discounted, its denominator is c(h) + 1, or nothing would be left for unseen tokens. An unseen history has alpha 1.

Each unit of documents asks the hash buckets of the count tables once per distinct n-gram, with its own counts; a bucket adds up and answers in
the order asked, and says which n-grams other units have too. From level 3 on only n-grams are asked for both of whose parts other units have: the others
are the unit's own, and so are their counts. A hot n-gram is thus one entry per unit. The first unit that holds an n-gram adds its kept and
lower mass to its history; histories that other units have are added up where their n-grams were counted, in the order asked, and answered to the units that need them: those
of held-out tokens, and those whose count doesn't tell the denominator. Nothing is collected; the counts of counts are one row. Hashes of n-grams have 20 bits more
than it takes to number the bytes of text, 64 at most, and lower masses are added up in units of 2^-40.
``ngram_tables`` and ``save_model`` give the same model as tables partitioned by level and bucket, ``score_saved`` scores from those.

Defined results: null text is empty (one token, the end); a text of any length is scored whole; rows with equal ids are scored and learnt each on its own; a null id is never
held out; with no training tokens every probability is 1 / (V + 1) = 1; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from . import units as un

ORDER = 3
UNIT_BYTES = 12 << 20
FOLDS, HELD_OUT = 5, 1
GT_MAX = 5
HOT_SHARE = 1000
_END, _BEGIN = np.uint64(0x51A7C0DE00000001), np.uint64(0x51A7C0DE00000002)
_K = np.uint64(0xD6E8FEB86659FD93)
_REPLY = "unit int, kind int, bucket int, reply binary, stats array<long>"


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def discounts(n: np.ndarray) -> tuple[np.ndarray, bool]:
    """d(c) for c = 0..GT_MAX from the numbers n[c] of n-grams seen c times, c = 1..GT_MAX + 1; whether Good-Turing was valid."""
    n = n.astype(float)
    k, d = GT_MAX, np.ones(GT_MAX + 1)
    with np.errstate(all="ignore"):
        share = (k + 1) * n[k + 1] / n[1]
        for c in range(1, k + 1):
            d[c] = ((c + 1) * n[c + 1] / n[c] / c - share) / (1 - share)
    ok = bool(np.isfinite(d).all() and (d[1:] > 0).all() and (d[1:] < 1).all())
    if not ok:
        cut = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        cut = min(max(cut, 0.1), 0.9)
        d[1:] = 1 - cut / np.arange(1, k + 1)
    return d, ok


def _kept(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(c <= GT_MAX, c * d[np.minimum(c, GT_MAX)], c.astype(float))


class _Tokens:
    """Tokens of a unit and of each its document; n-grams and histories of a level are hashed when they are asked for."""

    def __init__(self, texts: pa.Array, order: int):
        toks, counts = [], []
        for c in tk.chunks(texts):
            s, e, doc = c.words()
            nd = len(c)
            t = np.full(len(s) + nd, _END, np.uint64)
            t[np.arange(len(s)) + doc] = tk.span_hash(c.prefix(tk.LOWER), s, e)
            toks.append(t)
            counts.append(np.bincount(doc, minlength=nd) + 1)
        self.tok = np.concatenate(toks) if toks else np.zeros(0, np.uint64)
        count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.n_docs = len(texts)
        self.doc = np.repeat(np.arange(self.n_docs, dtype=np.int32), count)
        self.since = (np.arange(len(self.tok)) - np.repeat(np.cumsum(count) - count, count)).astype(np.int32)

    def _past(self, m: int) -> np.ndarray:
        n, h = len(self.tok), np.zeros(len(self.tok), np.uint64)
        for j in range(m - 1, 0, -1):
            x = np.full(n, _BEGIN, np.uint64)
            if n > j:
                x[j:] = self.tok[: n - j]
            x[self.since < j] = _BEGIN
            h += x
            h *= _K
        return h

    def gram(self, m: int) -> np.ndarray:
        if m == 1:
            return self.tok
        h = self._past(m)
        h += self.tok
        h *= _K
        h += np.uint64(m)
        return tk.mix(h)

    def history(self, m: int) -> np.ndarray:
        return tk.mix(self._past(m))


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _slices(h: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    b = _bucket(h, n)
    at = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
    for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(b)]):
        yield int(b[lo]), slice(lo, hi)


def _two(a: bytes, b: bytes) -> bytes:
    return len(a).to_bytes(8, "little") + a + b


class _Level:
    """The distinct n-grams of a unit at one level: of each its count in training, whether this unit is the first that has it, whether others have it."""

    def __init__(self, k: _Tokens, m: int, train: np.ndarray, below: _Level | None, spare: int):
        self.g, self.first, self.inv = un.distinct(k.gram(m) & ~np.uint64((1 << spare) - 1))
        self.first = self.first.astype(np.int32)
        self.count = np.bincount(self.inv[train], minlength=len(self.g)).astype(np.int64)
        self.mine, self.shared = np.ones(len(self.g), bool), np.zeros(len(self.g), bool)
        self.asked = np.ones(len(self.g), bool)
        if m > 2:
            s = below.shared[below.inv]
            before = np.concatenate([[True], s[:-1]])
            before[k.since == 0] = True
            self.asked = (s & before)[self.first]

    def told(self, replies: list[memoryview]) -> None:
        places, n = np.flatnonzero(self.asked), 0
        for b in replies:
            got = un.expand(b, np.int64)
            at = places[n : n + len(got)]
            self.count[at], self.shared[at], self.mine[at] = got >> 2, (got & 2) > 0, (got & 1) > 0
            n += len(got)
        if n != len(places):
            raise ValueError(f"{n} counts for {len(places)} n-grams")


class _Katz:
    def __init__(self, units: int, order: int, unit_bytes: int = UNIT_BYTES, every: bool = False):
        """every: units are told of all histories they have."""
        self.spare = np.uint64(max(0, 64 - 20 - (units * unit_bytes).bit_length()))  # low bits of hashes that are left out
        self.units, self.buckets, self.order, self.every = units, units, order, every
        self.places = order * self.buckets + order + 1  # a bucket of a level's n-grams each, and the histories of begin marks only

    def _tokens(self, t: pa.Table) -> tuple[pa.Table, _Tokens, np.ndarray]:
        un.trim()
        t = un.unpacked(t)
        k = _Tokens(tk.strings(t["text"]), self.order)
        return t, k, np.array([not held_out(i) for i in t["id"].to_pylist()], bool)[k.doc]

    # counts

    def _ask(self, unit: int, m: int, x: _Level) -> list[tuple]:
        g, c = x.g[x.asked], x.count[x.asked]
        rows = [((m - 1) * self.buckets + b, unit, un.squeeze_sorted(g[at] >> self.spare), un.squeeze(c[at]), None) for b, at in _slices(g, self.buckets)]
        own = x.count[~x.asked]
        if len(own):
            rows.append(((m - 1) * self.buckets + unit % self.buckets, unit, None, None, _counts(own)))
        return rows

    def _asked(self, rows: list[tuple]) -> pa.Table:
        return un.blobs(rows, ["place", "unit", "keys", "counts", "stats"], [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())])

    def ask_first(self, t: pa.Table) -> pa.Table:
        unit = t["unit"][0].as_py()
        _, k, train = self._tokens(t)
        return self._asked([r for m in range(1, min(2, self.order) + 1) for r in self._ask(unit, m, _Level(k, m, train, None, int(self.spare)))])

    def _groups(self, t: pa.Table) -> tuple[list[int], list[np.ndarray], int]:
        """(units, the group of each key that a unit asked for, groups); t is in order of units."""
        keys = [un.expand_sorted(b) << self.spare for b in t["keys"].to_pylist()]
        distinct, _, group = un.distinct(np.concatenate(keys))
        return t["unit"].to_pylist(), np.split(group, np.cumsum([len(x) for x in keys])[:-1]), len(distinct)

    def tell_counts(self, t: pa.Table) -> pa.Table:
        un.trim()
        place = t["place"][0].as_py()
        m, b = place // self.buckets + 1, place % self.buckets
        # what is added to histories comes by the same exchange; a filter before it would make it another one
        t = t.filter(pc.or_(t["keys"].is_valid(), t["stats"].is_valid()))
        if not t.num_rows:
            return self._replies([])
        stats = np.array([x for x in t["stats"].to_pylist() if x] or [[0] * (GT_MAX + 3)], np.int64).sum(0)
        t, rows = t.filter(t["keys"].is_valid()).sort_by("unit"), []
        if t.num_rows:
            units, groups, n = self._groups(t)
            total, owner, many = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n, np.int32)
            for u, g, c in reversed(list(zip(units, groups, t["counts"].to_pylist()))):  # the smallest unit is written last
                total[g] += un.expand(c, np.int64)
                owner[g] = u
                many[g] += 1
            rows = [(u, m, b, un.squeeze(4 * total[g] + 2 * (many[g] > 1) + (owner[g] == u)), None) for u, g in zip(units, groups)]
            stats = stats + _counts(total)
        rows.append((-1, m, b, None, [m, *stats.tolist()]))
        return self._replies(rows)

    @staticmethod
    def _replies(rows: list[tuple]) -> pa.Table:
        return un.blobs(rows, ["unit", "kind", "bucket", "reply", "stats"], [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())])

    # what a unit was told

    def _levels(self, k: _Tokens, train: np.ndarray, told: pa.Table, upto: int, keep: bool = True) -> Iterator[tuple]:
        """For m = 1..upto: (level, history of each token, (seen, low) of the histories, probability of each token); the last two as far as they were told.

        A history is the number of the n-gram before a token, and after all of those the one of begin marks only. seen: how many of its n-grams that are
        this unit's to add were seen 1..GT_MAX times, and the count of the others; low: the lower mass of all of these. Without keep a level's n-grams and their places are let go as soon as they have been used.
        """
        replies: dict[int, list] = {}
        stats: dict[int, np.ndarray] = {}
        for column in told.column_names[1:]:
            for r in told[column][0].values or []:
                if r["stats"].is_valid and len(r["stats"]):
                    of_level = r["stats"].as_py()
                    stats[of_level[0]] = np.array(of_level[1:], np.int64)
                elif r["reply"].is_valid:  # read where it lies, not copied
                    replies.setdefault(r["kind"].as_py(), []).append((r["bucket"].as_py(), memoryview(r["reply"].as_buffer())))
        of = lambda kind: [b for _, b in sorted(replies.get(kind, []), key=lambda x: x[0])]
        p = below = None
        for m in range(1, upto + 1):
            x = _Level(k, m, train, below, int(self.spare))
            x.told(of(m))
            if not keep:
                x.g = None
            if m == 1:
                p = ((x.count + 0.5) / (stats[1][-2] + 0.5 * (stats[1][-1] + 1)))[x.inv]
                yield x, None, None, None, p, stats
                below = x
                continue
            n = len(below.count) + 1
            h = np.concatenate([np.array([n - 1], np.int32), below.inv[:-1]])
            h[k.since == 0] = n - 1
            use = np.flatnonzero(x.mine & (x.count > 0))
            to, c = h[x.first[use]], x.count[use]
            seen = [np.bincount(to[c == i], minlength=n).astype(np.int32) for i in range(1, GT_MAX + 1)]
            seen.append(np.bincount(to[c > GT_MAX], weights=c[c > GT_MAX], minlength=n).astype(np.int64))
            low = np.bincount(to, weights=p[x.first[use]], minlength=n).astype(float)  # without any it would be of integers
            del to, c, use
            if not keep:
                x.first = None
            need = np.zeros(n, bool)
            need[h[~train | (np.append(below.count, GT_MAX + 1)[h] > GT_MAX)]] = True
            need |= self.every
            need[n - 1] = True
            common = np.append(below.shared, True)
            answer = of(100 + m)
            if answer:
                d, _ = discounts(np.r_[0, stats[m][: GT_MAX + 1]])
                wanted, done = np.flatnonzero(common & need), 0
                for b in answer:
                    e = int.from_bytes(b[:8], "little") + 8
                    mass = un.expand(b[e:], np.int64)
                    at = wanted[done : done + len(mass)]
                    for row, got in zip(seen, un.expand(b[8:e], np.int64).reshape(GT_MAX + 1, -1)):
                        row[at] = got
                    low[at] = mass / _MASS
                    done += len(mass)
                    del mass, row, got
                if done != len(wanted):
                    raise ValueError(f"{done} answers for {len(wanted)} histories")
                den, alpha = self.weigh(seen, low, d)
                # of histories that weren't asked for, tokens of training only follow, and the count tells the denominator
                quiet = common & ~need
                den[quiet] = np.append(below.count, 0)[quiet]
                del seen, low, wanted, answer
                q = _kept(x.count, d)[x.inv]
                there = q > 0
                np.divide(q, den[h], out=q, where=there)
                p = alpha[h] * p
                np.copyto(p, q, where=there)
                del q, there
                yield x, h, (den, alpha), need & common, p, stats
                del h, den, alpha, need, common, quiet  # before the next level's n-grams are hashed and sorted
            else:
                yield x, h, (seen, low), need & common, None, stats
            below = x

    # histories

    def ask_more(self, t: pa.Table, told: pa.Table, m: int) -> pa.Table:
        """What a unit adds to the histories of level m, and the n-grams of level m + 1 that it asks for."""
        names, types = ["place", "unit", "keys", "counts", "stats", "seen", "low", "need"], [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
        if not t.num_rows:
            return un.blobs([], names, types)
        unit = t["unit"][0].as_py()
        _, k, train = self._tokens(t)
        under = x = None
        for level, _, sums, need, _, _ in self._levels(k, train, told, m):
            under, x = x, level
        seen, low = sums
        at = np.flatnonzero(under.shared)
        rows = []
        for b, part in _slices(under.g[at], self.buckets):
            i = at[part]
            rows.append(((m - 2) * self.buckets + b, unit, None, None, None, un.squeeze(np.concatenate([x[i] for x in seen])), un.squeeze(_mass(low[i])), np.packbits(need[i]).tobytes()))
        rows.append((self.order * self.buckets + m, unit, None, None, None, un.squeeze(np.array([x[-1] for x in seen], np.int64)), un.squeeze(_mass(low[-1:])), b"\x80"))
        if m < self.order:
            rows += [(*r, None, None, None) for r in self._ask(unit, m + 1, _Level(k, m + 1, train, x, int(self.spare)))]
        return un.blobs(rows, names, types)

    @staticmethod
    def weigh(seen: list[np.ndarray], low: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(denominator, alpha) of histories."""
        den, keep, some = seen[GT_MAX].astype(float), seen[GT_MAX].astype(float), np.zeros(len(low), bool)
        for i in range(GT_MAX):
            den += (i + 1) * seen[i]
            keep += (i + 1) * d[i + 1] * seen[i]
            some |= seen[i] > 0
        none = den == 0
        den += ~some & ~none
        with np.errstate(all="ignore"):
            keep /= den
            alpha = np.subtract(1, keep, out=keep)
            alpha /= 1 - low
        alpha[none] = 1.0
        return den, alpha

    def tell_histories(self, asked: pa.Table, added: pa.Table, m: int) -> pa.Table:
        added = added.filter(added["seen"].is_valid()).sort_by("unit")
        if not added.num_rows:
            return self._replies([])
        place = added["place"][0].as_py()
        units = added["unit"].to_pylist()
        if place >= self.order * self.buckets:
            groups, n, bucket = {u: np.zeros(1, np.int64) for u in units}, 1, self.buckets
        else:
            asked = asked.filter(asked["keys"].is_valid()).sort_by("unit")
            us, gs, n = self._groups(asked)
            many = np.bincount(np.concatenate(gs), minlength=n) > 1
            groups, bucket = {u: g[many[g]] for u, g in zip(us, gs)}, place % self.buckets
        seen, low = np.zeros((GT_MAX + 1, n), np.int64), np.zeros(n, np.int64)
        # a unit has each history once
        for u, s, x in zip(units, added["seen"].to_pylist(), added["low"].to_pylist()):
            seen[:, groups[u]] += un.expand(s, np.int64).reshape(GT_MAX + 1, -1)
            low[groups[u]] += un.expand(x, np.int64)
        rows = []
        for u, need in zip(units, added["need"].to_pylist()):
            g = groups[u]
            g = g[np.unpackbits(np.frombuffer(need, np.uint8), count=len(g)).astype(bool)]
            rows.append((u, 100 + m, bucket, _two(un.squeeze(seen[:, g].ravel()), un.squeeze(low[g])), None))
        return self._replies(rows)

    # scores

    def scores(self, t: pa.Table, told: pa.Table) -> pa.Table:
        t, k, train = self._tokens(t)
        n = k.n_docs
        add = lambda x: np.bincount(k.doc, weights=x, minlength=n)
        for m, (x, _, _, _, p, stats) in enumerate(self._levels(k, train, told, self.order, keep=False), 1):
            if m == 1:  # sums of documents; a value for each token would be held to the end
                base, known, tokens = add(np.log10(p)), add(x.count[x.inv] > 0), stats[1][-2]
        return pa.table(
            [t["id"], pa.array([held_out(i) for i in t["id"].to_pylist()], pa.bool_()), pa.array(np.bincount(k.doc, minlength=n)), pa.array(known.astype(np.int64)), pa.array(np.full(n, tokens)), pa.array(base), pa.array(add(np.log10(p)))],
            names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )


_MASS = float(1 << 40)


def _mass(low: np.ndarray) -> np.ndarray:
    return np.rint(low * _MASS).astype(np.int64)


def _counts(c: np.ndarray) -> np.ndarray:
    """How many n-grams were seen 1..GT_MAX + 1 times, the sum of all counts, and how many were seen."""
    return np.concatenate([np.bincount(np.minimum(c, GT_MAX + 2), minlength=GT_MAX + 3)[1 : GT_MAX + 2], [c.sum(), (c > 0).sum()]]).astype(np.int64)


def _by_unit(replies: DataFrame, k: _Katz, name: str) -> DataFrame:
    """(unit, name): all replies to a unit in one row, where its documents are."""
    one = F.struct("kind", "bucket", "reply", "stats")
    return replies.repartitionById(k.units, "unit").groupBy("unit").agg(F.collect_list(one).alias(name))


def _with_stats(told: DataFrame, units: int) -> DataFrame:
    """Replies of the count tables, and each level's counts of counts for every unit."""
    add = F.array(*[F.sum(F.col("stats")[i]) if i else F.max(F.col("stats")[0]) for i in range(GT_MAX + 4)])
    total = told.where("unit < 0").groupBy("kind").agg(add.alias("stats"))
    spread = total.select(F.explode(F.sequence(F.lit(0), F.lit(units - 1))).alias("unit"), "kind", F.lit(-1).alias("bucket"), F.lit(None).cast("binary").alias("reply"), "stats")
    return told.where("unit >= 0").unionAll(spread)


def _told(own: DataFrame, k: _Katz) -> DataFrame:
    """A row per unit with all replies, each exchanged once: those of one step are a column."""
    asked = own.groupBy("unit").applyInArrow(lambda t: k.ask_first(t), "place int, unit int, keys binary, counts binary, stats array<long>").repartitionById(k.places, "place")
    told = _by_unit(_with_stats(asked.groupBy("place").applyInArrow(lambda t: k.tell_counts(t), _REPLY), k.units), k, "c1")
    levels = {1: asked, 2: asked}  # where the n-grams of a level were asked for
    for m in range(2, k.order + 1):
        more = _asked_more(own, told, k, m)
        both = levels[m - 1].groupBy("place").cogroup(more.groupBy("place")).applyInArrow(_histories(k, m), _REPLY)
        told = told.join(_by_unit(both, k, f"h{m}"), "unit", "left")
        if m < k.order:
            grams = more.groupBy("place").applyInArrow(lambda t: k.tell_counts(t), _REPLY)
            told = told.join(_by_unit(_with_stats(grams, k.units), k, f"c{m + 1}"), "unit", "left")
            levels[m + 1] = more
    return told


def _asked_more(own: DataFrame, told: DataFrame, k: _Katz, m: int) -> DataFrame:
    schema = "place int, unit int, keys binary, counts binary, stats array<long>, seen binary, low binary, need binary"
    return own.groupBy("unit").cogroup(told.groupBy("unit")).applyInArrow(lambda t, r: k.ask_more(t, r, m), schema).repartitionById(k.places, "place")


def _histories(k: _Katz, m: int):
    return lambda a, b: k.tell_histories(a, b, m)


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """Learns from the training documents and scores all of them."""
    units = un.make(docs, id_col, text_col, unit_bytes)
    k = _Katz(units.n, order, unit_bytes)
    own = un.packed(docs, units, id_col, text_col).repartitionById(units.n, "unit")  # a unit is a task; read by every step
    id_type = docs.schema[id_col].dataType.simpleString()
    out = own.groupBy("unit").cogroup(_told(own, k).groupBy("unit")).applyInArrow(
        lambda t, r: k.scores(t, r),
        f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
    return out.withColumnRenamed("id", id_col)


# the model as tables


def ngram_tables(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, unit_bytes: int = UNIT_BYTES) -> tuple[DataFrame, DataFrame]:
    """(level, bucket, gram, count, history) of all n-grams of training documents, and (level, bucket, history, denominator, alpha)."""
    units = un.make(docs, id_col, text_col, unit_bytes)
    k = _Katz(units.n, order, unit_bytes, every=True)
    own = un.packed(docs, units, id_col, text_col).repartitionById(units.n, "unit")  # a unit is a task; read by every step

    def grams(t: pa.Table) -> pa.Table:
        _, x, train = k._tokens(t)
        parts = []
        for m in range(1, order + 1):
            g, first, n = np.unique(x.gram(m)[train], return_index=True, return_counts=True)
            h = x.history(m)[train][first] if m > 1 else np.zeros(len(g), np.uint64)
            parts.append(pa.table([pa.array(np.full(len(g), m, np.int32)), pa.array(_bucket(g, k.buckets).astype(np.int32)), pa.array(g.view(np.int64)), pa.array(n), pa.array(h.view(np.int64))], names=["level", "bucket", "gram", "count", "history"]))
        return pa.concat_tables(parts)

    counted = own.groupBy("unit").applyInArrow(grams, "level int, bucket int, gram long, count long, history long").groupBy("level", "bucket", "gram").agg(F.sum("count").alias("count"), F.first("history").alias("history"))

    def weights(t: pa.Table, r: pa.Table) -> pa.Table:
        parts = []
        if t.num_rows:
            _, x, train = k._tokens(t)
            for m, (_, of, both, _, _, _) in enumerate(k._levels(x, train, r, order), 1):
                if m == 1:
                    continue
                den, alpha = both
                h = np.zeros(len(den), np.uint64)
                h[of] = x.history(m)
                ok = (den > 0) & (np.bincount(of, minlength=len(den)) > 0)
                parts.append(pa.table([pa.array(np.full(ok.sum(), m, np.int32)), pa.array(_bucket(h[ok], k.buckets).astype(np.int32)), pa.array(h[ok].view(np.int64)), pa.array(den[ok]), pa.array(alpha[ok])], names=["level", "bucket", "history", "denominator", "alpha"]))
        kinds = [("level", pa.int32()), ("bucket", pa.int32()), ("history", pa.int64()), ("denominator", pa.float64()), ("alpha", pa.float64())]
        return pa.concat_tables(parts) if parts else pa.schema(kinds).empty_table()

    histories = own.groupBy("unit").cogroup(_told(own, k).groupBy("unit")).applyInArrow(weights, "level int, bucket int, history long, denominator double, alpha double")
    return counted, histories.groupBy("level", "bucket", "history").agg(F.first("denominator").alias("denominator"), F.first("alpha").alias("alpha"))


def save_model(docs: DataFrame, path: str, **options) -> None:
    """Writes the tables below path, partitioned by level and bucket, and the counts of counts."""
    counted, histories = ngram_tables(docs, **options)
    counted.repartition("level", "bucket").write.mode("overwrite").partitionBy("level", "bucket").parquet(f"{path}/ngrams")
    histories.repartition("level", "bucket").write.mode("overwrite").partitionBy("level", "bucket").parquet(f"{path}/histories")
    spark = docs.sparkSession
    stats = spark.read.parquet(f"{path}/ngrams").groupBy("level").agg(*[F.sum((F.col("count") == c).cast("long")).alias(f"n{c}") for c in range(1, GT_MAX + 2)], F.sum("count").alias("total"), F.count("*").alias("kinds"))
    stats.write.mode("overwrite").parquet(f"{path}/stats")


def score_saved(spark: SparkSession, path: str, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, score) of every row under a saved model: tokens look their n-grams and histories up by joins.

    N-grams and histories with 1/HOT_SHARE of a level's count or more, at most HOT_SHARE of each, are broadcast; of the others none has more tokens than that share of
    documents like those of the model. Rows of one id stay apart.
    """
    stats = {r["level"]: r.asDict() for r in spark.read.parquet(f"{path}/stats").collect()}  # one row a level
    order = max(stats)
    base = spark.read.parquet(f"{path}/ngrams")
    past = spark.read.parquet(f"{path}/histories")
    id_type = docs.schema[id_col].dataType.simpleString()

    def looked_up(t: DataFrame, table: DataFrame, key: str, weight: str, total: int) -> DataFrame:
        """t with the table's columns; key is a column of both."""
        is_hot = F.col(weight) * HOT_SHARE >= F.lit(total)
        mine = [c for c in table.columns if c != key]
        few = F.broadcast(table.where(is_hot).select(key, F.struct(*mine).alias("_few")))
        t = t.join(few, key, "left")
        rest = t.where("_few is null").drop("_few").join(table.where(~is_hot), key, "left")
        return t.where("_few is not null").select("*", "_few.*").drop("_few").unionByName(rest)

    def explode(batches):
        for b in batches:
            x = _Tokens(tk.strings(b.column(1)), order)
            at = pa.array(x.doc)
            cols = [b.column(0).take(at), b.column(2).take(at), *(pa.array(g.view(np.int64)) for g in [x.gram(m) for m in range(1, order + 1)]), *(pa.array(h.view(np.int64)) for h in [x.history(m) for m in range(2, order + 1)])]
            yield pa.RecordBatch.from_arrays(cols, ["id", "row", *[f"g{m}" for m in range(1, order + 1)], *[f"h{m}" for m in range(2, order + 1)]])

    fields = ", ".join(f"g{m} long" for m in range(1, order + 1)) + "".join(f", h{m} long" for m in range(2, order + 1))
    t = docs.select(id_col, text_col, F.monotonically_increasing_id().alias("row")).mapInArrow(explode, f"id {id_type}, row long, {fields}")
    n, v = stats[1]["total"], stats[1]["kinds"]
    p = None
    for m in range(1, order + 1):
        grams = base.where(F.col("level") == m).select(F.col("gram").alias(f"g{m}"), F.col("count").alias(f"c{m}"))
        t = looked_up(t, grams, f"g{m}", f"c{m}", stats[m]["total"])
        c = F.coalesce(F.col(f"c{m}"), F.lit(0))
        if m == 1:
            p = (c + 0.5) / F.lit(n + 0.5 * (v + 1))
            continue
        d, _ = discounts(np.array([0, *[stats[m][f"n{i}"] for i in range(1, GT_MAX + 2)]]))
        of = past.where(F.col("level") == m).select(F.col("history").alias(f"h{m}"), F.col("denominator").alias(f"d{m}"), F.col("alpha").alias(f"a{m}"))
        t = looked_up(t, of, f"h{m}", f"d{m}", stats[m]["total"])
        keep = F.when(c > GT_MAX, c.cast("double")).otherwise(c * F.element_at(F.array(*[F.lit(float(x)) for x in d]), (F.least(c, F.lit(GT_MAX)) + 1).cast("int")))
        p = F.when(c > 0, keep / F.col(f"d{m}")).otherwise(F.coalesce(F.col(f"a{m}"), F.lit(1.0)) * p)
    return t.groupBy("row").agg(F.first("id").alias("id"), F.count("*").alias("n_tokens"), F.sum(F.log10(p)).alias("score")).select(F.col("id").alias(id_col), "n_tokens", "score")
