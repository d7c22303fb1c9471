"""MinHash near-dedup: a chosen-path set similarity join, and its classes.

A document's set holds its distinct 3-word shingles (A-Z lower-cased). Documents with equal sets form a group and only one stands for it. Each of ``trees``
independent trees branches the sets by one of their minwise tokens; a node that is still large is branched again by two more of them, a node
that is small is compared exhaustively on 128 minwise values. Within a node, all that lie within the candidate distance of a
pivot are settled at once: by the triangle inequality they can have links only to what lies within twice that, so a tight group of any size costs one
comparison a member, and a node emits a spanning star instead of its pairs.

Candidates are far looser than links (0.72 estimated similarity for 0.85, four standard deviations), so the connected candidate classes hold all links but for
a miss of 0.15^trees. Links are then confirmed and counted on the full sets, class by class: all intersections of a class at once, from a product of matrices for
shingles that many sets have and from inverted lists for the others. A class beyond ``block`` sets or BLOCK_BYTES is compared in pairs of blocks, each
a task of bounded size, and joined up afterwards.

Defined results: null, empty or wordless text has an empty set and is linked with nothing; with fewer than three words the whole sequence is one shingle;
a text of any length has a set; repeated rows of an id are one document; a null id is linked with nothing and its component is null, and it is kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, storage
from . import textkernel as tk

SHINGLE, NUM, DEN = 3, 85, 100
TREES, MINHASHES, SMALL, NODE, BLOCK = 8, 128, 1024, 250_000, 4096
CANDIDATE = 92  # of 128 minwise values alike
BLOCK_BYTES = 16 << 20  # of full sets
MOST_HOT = 1_000_000  # nodes that are branched again, 8 bytes each
BROADCAST_ROWS = 1_000_000  # 16 bytes each; beyond that the sides are shuffled
HOT_SHARE = 1000

_rng = np.random.Generator(np.random.PCG64(77))
_FACTORS = _rng.integers(1, 2**63, MINHASHES, dtype=np.uint64) | np.uint64(1)


def shingles(chunk: tk.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of all distinct shingles, sorted by both."""
    s, e, doc = chunk.words()
    h = tk.span_hash(chunk.prefix(tk.LOWER), s, e)
    ok = tk.within(doc, SHINGLE)
    g, d = tk.gram_hash(h, SHINGLE)[ok], doc[: len(ok)][ok]
    count = np.bincount(doc, minlength=len(chunk))
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(short):
        first = np.searchsorted(doc, short)
        two = count[short] == 2
        nxt = h[np.minimum(first + 1, len(h) - 1)]
        g = np.concatenate([g, tk.mix(h[first] + np.where(two, nxt * np.uint64(0x9E3779B97F4A7C15) + np.uint64(2), np.uint64(1)))])
        d = np.concatenate([d, short])
    order = tk.by_doc(d, g)
    g, d = g[order], d[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
    return d[new], g[new]


def _sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, f1, f2, sketch, keys): set size, fingerprint, one byte of each minwise value, and the trees' first branches."""
    id_type = docs.schema[id_col].dataType.simpleString()
    pick = np.random.Generator(np.random.PCG64(3)).permutation(MINHASHES)[:TREES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, f1, f2, sketch, keys = [], [], [], [], []
            for c in tk.chunks(tk.strings(b.column(1))):
                d, g = shingles(c)
                size = np.bincount(d, minlength=len(c))
                full = np.flatnonzero(size)
                at = np.cumsum(size)[full] - size[full]
                one, two = np.zeros(len(c), np.uint64), np.zeros(len(c), np.uint64)
                low = np.zeros((len(c), MINHASHES), np.uint8)
                key = np.zeros((len(c), TREES), np.uint64)
                if len(full):
                    one[full], two[full] = np.add.reduceat(tk.mix(g ^ np.uint64(0xABCD)), at), np.bitwise_xor.reduceat(tk.mix(g), at)
                    for j in range(MINHASHES):
                        m = np.minimum.reduceat((g * _FACTORS[j]) >> np.uint64(20), at)
                        low[full, j] = (tk.mix(m) & np.uint64(255)).astype(np.uint8)
                        for t in np.flatnonzero(pick == j):
                            key[full, t] = tk.mix(m + np.uint64(t << 50))
                n.append(size)
                f1.append(one.view(np.int64))
                f2.append(two.view(np.int64))
                sketch += [r.tobytes() for r in low]
                keys += [r.tobytes() for r in key]
            cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cat(n)), pa.array(cat(f1)), pa.array(cat(f2)), pa.array(sketch, pa.binary()), pa.array(keys, pa.binary())], ["id", "n", "f1", "f2", "sketch", "keys"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {id_type}, n long, f1 long, f2 long, sketch binary, keys binary")


# nodes


def _alike(x: np.ndarray, one: np.ndarray) -> np.ndarray:
    return (x == one).sum(1)


def node_links(ids: np.ndarray, size: np.ndarray, sketch: np.ndarray, seed: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect, within a node, all sets that are candidates of each other: at most a few per set."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    rng = np.random.Generator(np.random.PCG64(seed))
    far = 2 * CANDIDATE - MINHASHES  # what is less alike than this to a pivot can't be a candidate of its candidates

    def settle(at: np.ndarray, pivot: int) -> np.ndarray:
        """Links the pivot's candidates, finds all their links, and returns what is left of the node."""
        near = _alike(sketch[at], sketch[pivot])
        mine = near >= CANDIDATE
        group, rest = at[mine], at[~mine]
        others = group[group != pivot]
        if len(others):
            out.append((np.full(len(others), ids[pivot]), ids[others]))
            band = rest[near[~mine] >= far]
            for b in band.tolist():
                for lo in range(0, len(others), 65536):
                    part = others[lo : lo + 65536]
                    hit = part[_alike(sketch[part], sketch[b]) >= CANDIDATE]
                    if len(hit):
                        out.append((ids[b : b + 1], ids[hit[:1]]))  # one link joins it to the group
                        break
        return rest

    stack = [(np.arange(len(ids)), 0)]
    while stack:
        at, depth = stack.pop()
        if len(at) > SMALL:
            for pivot in rng.choice(at, 4, replace=False).tolist():
                if pivot in at and (_alike(sketch[at], sketch[pivot]) >= CANDIDATE).sum() * 8 >= len(at):
                    at = settle(at, pivot)
        if len(at) > SMALL and depth < 40:
            for c in rng.choice(MINHASHES, 2, replace=False).tolist():
                v = sketch[at, c]
                order = np.argsort(v, kind="stable")
                cut = np.flatnonzero(np.diff(v[order])) + 1
                stack += [(p, depth + 1) for p in np.split(at[order], cut) if len(p) > 1]
            continue
        while len(at) > 1:
            at = settle(at, int(at[0]))
    return out


def _branches(hot: list[frozenset], batch_keys: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, node) of each record: a first branch per tree, branched again by two minwise values where a node is hot."""
    n = len(batch_keys)
    row, key = np.repeat(np.arange(n), TREES), batch_keys.ravel()
    done_r, done_k = [], []
    for level, keys in enumerate(hot):
        again = np.isin(key, np.array(sorted(keys), np.uint64)) if keys else np.zeros(len(key), bool)
        done_r.append(row[~again])
        done_k.append(key[~again])
        row, key = row[again], key[again]
        rr, kk = [], []
        for c in np.random.Generator(np.random.PCG64(100 + level)).permutation(MINHASHES)[:2].tolist():
            rr.append(row)
            kk.append(tk.mix(key + np.uint64((c + 1) << 40) + sketch[row, c].astype(np.uint64)))
        row, key = np.concatenate(rr), np.concatenate(kk)
    return np.concatenate([*done_r, row]), np.concatenate([*done_k, key])


def _nodes(reps: DataFrame, hot: list[frozenset], payload: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            sk, ky = (tk.buffers(c)[0] for c in (b.column(2), b.column(3)))
            row, key = _branches(hot, ky.view(np.uint64).reshape(n, TREES), sk.reshape(n, MINHASHES))
            cols, names = [pa.array(key.view(np.int64))], ["node"]
            if payload:
                at = pa.array(row)
                cols += [b.column(0).take(at), b.column(1).take(at), b.column(2).take(at)]
                names += ["rep", "n", "sketch"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return reps.select("rep", "n", "sketch", "keys").mapInArrow(run, "node long, rep long, n long, sketch binary" if payload else "node long")


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of the nodes in a partition sorted by node; a node that continues in the next batch is carried over."""
    carry: list[pa.RecordBatch] = []

    def work(t: pa.Table) -> pa.RecordBatch:
        node = t["node"].to_numpy()
        cut = np.flatnonzero(np.diff(node)) + 1
        lo, hi = np.r_[0, cut], np.r_[cut, len(node)]
        more = hi - lo > 1
        ids, size = t["rep"].to_numpy(), t["n"].to_numpy()
        col = t["sketch"].combine_chunks()
        sketch = tk.buffers(col.chunk(0) if isinstance(col, pa.ChunkedArray) else col)[0].reshape(-1, MINHASHES)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in zip(lo[more].tolist(), hi[more].tolist()):
            if j - i == 2:
                if int((sketch[i] == sketch[i + 1]).sum()) >= CANDIDATE:
                    a.append(ids[i : i + 1])
                    b.append(ids[j - 1 : j])
                continue
            for x, y in node_links(ids[i:j], size[i:j], sketch[i:j], int(node[i]) & 0xFFFF):
                a.append(x)
                b.append(y)
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        node = batch.column(0).to_numpy()
        last = int(np.searchsorted(node, node[-1]))
        if last > 0:
            yield work(pa.Table.from_batches([*carry, batch.slice(0, last)]))
            carry = []
        elif carry and carry[-1].column(0)[0].as_py() != node[0]:
            yield work(pa.Table.from_batches(carry))
            carry = []
        carry.append(batch.slice(last))
    if carry:
        yield work(pa.Table.from_batches(carry))


# confirmation


def _intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many values each of the sets a shares with each of the sets b."""
    ka, kb = len(a), len(b)
    value, inv = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    cut = sum(map(len, a))
    owners = np.repeat(np.arange(ka), [len(x) for x in a]), np.repeat(np.arange(kb), [len(x) for x in b])
    tokens = inv[:cut], inv[cut:]
    times = [np.bincount(t, minlength=len(value)) for t in tokens]
    both = (times[0] > 0) & (times[1] > 0)
    dense = both & (times[0] > max(8, ka // 8)) & (times[1] > max(8, kb // 8))
    out = np.zeros((ka, kb), np.int32)
    columns = np.flatnonzero(dense)
    for lo in range(0, len(columns), 1024):
        place = np.full(len(value), -1)
        place[columns[lo : lo + 1024]] = np.arange(len(columns[lo : lo + 1024]))
        parts = []
        for k, owner, t in zip((ka, kb), owners, tokens):
            use = place[t] >= 0
            m = np.zeros((k, 1024), np.float32)
            m[owner[use], place[t[use]]] = 1
            parts.append(m)
        out += (parts[0] @ parts[1].T).astype(np.int32)
    rare = both & ~dense
    use = rare[tokens[1]]
    order = np.argsort(tokens[1][use], kind="stable")
    listed, token = owners[1][use][order], tokens[1][use][order]
    use = rare[tokens[0]]
    owner, want = owners[0][use], tokens[0][use]
    first, many = np.searchsorted(token, want), times[1][want]
    # an entry of a with every entry of b that has the same value, some millions at a time
    edge = np.searchsorted(np.cumsum(many), np.arange(0, int(many.sum()), 4_000_000), "right")
    flat = out.reshape(-1)
    for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(many)]):
        m = many[lo:hi]
        at = np.arange(int(m.sum())) + np.repeat(first[lo:hi] - (np.cumsum(m) - m), m)
        pair, n = np.unique(np.repeat(owner[lo:hi], m) * kb + listed[at], return_counts=True)
        flat[pair] += n.astype(np.int32)
    return out


def exact_links(ids: np.ndarray, sets: list[np.ndarray], copies: np.ndarray, other: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(links that span every class of sets with 100 |A and B| >= 85 |A or B|, documents that each set is linked with).

    copies: documents that have each set. other: flags the sets of a second block; then only sets of different blocks are compared.
    """
    size, n = np.array([len(s) for s in sets]), len(sets)
    one, two = (np.arange(n), np.arange(n)) if other is None else (np.flatnonzero(~other), np.flatnonzero(other))
    found, degree = [], np.zeros(n, np.int64)
    if not len(one) or not len(two):
        return found, degree
    shared = _intersections([sets[i] for i in one], [sets[i] for i in two])
    root = np.arange(n)
    for row, i in enumerate(one.tolist()):
        s = shared[row]
        hit = DEN * s >= NUM * (size[two] + size[i] - s)
        to = two[hit]
        to = to[to != i]
        degree[i] += copies[to].sum()
        if other is not None:
            degree[to] += copies[i]
        for r in np.unique(root[to]).tolist():
            if r != root[i]:
                found.append((int(ids[i]), int(ids[to[root[to] == r][0]])))
                root[root == r] = root[i]
    return found, degree


def _confirm(t: pa.Table) -> pa.Table:
    """Links of a task as (a, b), and of each set the documents it is linked with as (a, null, links)."""
    ids, first = np.unique(t["rep"].to_numpy(), return_index=True)  # rows of one id are one document
    t = t.take(pa.array(first))
    sets = [np.frombuffer(b.as_buffer(), np.uint64) for b in t["hashes"]]
    block = t["mine"].to_numpy()
    task = t["task"][0].as_py()
    links, degree = exact_links(ids, sets, t["copies"].to_numpy(), None if task["i"] == task["j"] else block == task["j"])
    some = np.flatnonzero(degree)
    a = np.concatenate([np.array([x[0] for x in links], np.int64), ids[some]])
    b = pa.array([*(x[1] for x in links), *[None] * len(some)], pa.int64())
    n = pa.array([*[None] * len(links), *degree[some].tolist()], pa.int64())
    return pa.table({"a": pa.array(a), "b": b, "links": n})


def _full_sets(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = []
            for c in tk.chunks(tk.strings(b.column(1))):
                d, g = shingles(c)
                edge = np.searchsorted(d, np.arange(len(c) + 1))
                blobs += [g[edge[i] : edge[i + 1]].tobytes() for i in range(len(c))]
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(blobs, pa.binary())], ["rep", "cluster", "blocks", "copies", "hashes"])

    return docs.select("rep", "text", "cluster", "blocks", "copies").mapInArrow(run, "rep long, cluster long, blocks int, copies long, hashes binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(id, n_shingles, component_id, kept, n_links) of every row; n_links: documents that it is linked with, copies among them. Ids must be integers."""
    sets = storage.written(_sets(docs, id_col, text_col), "shingle_sets")
    groups = sets.where("n > 0 and id is not null").groupBy("n", "f1", "f2").agg(F.min(F.col("id").cast("long")).alias("rep"), F.count_distinct("id").alias("copies"), F.count("*").alias("rows"), F.min(F.struct("sketch", "keys")).alias("s"))
    reps = storage.written(groups.select("n", "f1", "f2", "rep", "copies", "rows", "s.sketch", "s.keys"), "set_groups")
    # nodes too large for a task are branched again; at most TREES * sets / large of them come to the driver, so MOST_HOT
    large = max(NODE, TREES * reps.count() // MOST_HOT)
    hot: list[frozenset] = []
    for _ in range(24):
        found = [r[0] for r in _nodes(reps, hot, False).groupBy("node").count().where(F.col("count") > large).select("node").collect()]
        if not found:
            break
        hot.append(frozenset(np.array(found, np.int64).view(np.uint64).tolist()))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = _nodes(reps, hot, True).repartition(parts, "node").sortWithinPartitions("node").mapInArrow(_links, "a long, b long")
    clusters = graph.components(edges)
    linked = storage.written(_linked(docs, clusters, reps.select("rep", "n", "copies"), id_col, text_col, block), "exact_links")
    exact = graph.components(linked.where("b is not null").select("a", "b"))
    degrees = linked.where("b is null").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "rep")
    key = ["n", "f1", "f2"]
    # a row for each set that several documents have, or that is linked: the others' components are their own ids
    labels = reps.join(exact, reps["rep"] == exact["node"], "left").join(degrees, "rep", "left").where("node is not null or copies > 1")
    labels = storage.written(labels.select(*key, F.coalesce("label", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "rows"), "components")
    # sets with many documents, at most HOT_SHARE of them by their share of all rows, are looked up without a shuffle
    total = sets.count()
    is_hot = F.col("rows") * HOT_SHARE >= F.lit(total)
    few = F.broadcast(labels.where(is_hot).select(*key, F.col("component_id").alias("hot_id"), F.col("n_links").alias("hot_links")))
    alone = F.col("n") == 0
    out = sets.select("id", *key).where(~alone & F.col("id").isNotNull()).join(few, key, "left")
    known = out.where("hot_id is not null").select("id", "n", F.col("hot_id").alias("component_id"), F.col("hot_links").alias("n_links"))
    others = out.where("hot_id is null").drop("hot_id", "hot_links").join(labels.where(~is_hot).select(*key, "component_id", "n_links"), key, "left").select("id", "n", F.coalesce("component_id", F.col("id").cast("long")).alias("component_id"), "n_links")
    bare = sets.where(alone | F.col("id").isNull()).select("id", "n", F.col("id").cast("long").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    every = known.unionAll(others).unionAll(bare)
    return every.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id").cast("long") == F.col("component_id"), F.lit(True)).alias("kept"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _linked(docs: DataFrame, clusters: DataFrame, reps: DataFrame, id_col: str, text_col: str, block: int) -> DataFrame:
    known = clusters.join(reps, clusters["node"] == reps["rep"]).select("rep", F.col("label").alias("cluster"), "n", "copies")
    sizes = known.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(8 * F.sum("n") / BLOCK_BYTES)).cast("int").alias("blocks"))
    one = storage.written(known.join(sizes, "cluster").select("rep", "cluster", "blocks", "copies"), "candidates")
    n = one.count()
    # a table of ids: broadcast while it has a checked number of rows, else both sides are shuffled
    side = F.broadcast(one) if n <= BROADCAST_ROWS else one
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text")).join(side, "rep")
    full = _full_sets(texts)
    # a class beyond one block: every pair of its blocks is a task
    full = full.withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    sent = full.select("rep", "cluster", "hashes", "copies", "mine", other)
    task = F.struct("cluster", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")).alias("task")
    return sent.select("rep", "hashes", "copies", "mine", task).groupBy("task").applyInArrow(_confirm, "a long, b long, links long")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, of which one of each component stays (the smallest id)."""
    gone = near_duplicates(docs.select(id_col, text_col), id_col, text_col).where("not kept").select(F.col(id_col).alias("gone_id")).distinct()
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    return plain.join(gone, plain[names[docs.columns.index(id_col)]] == gone["gone_id"], "left_anti").toDF(*docs.columns)
