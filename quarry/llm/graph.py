"""Connected components of an edge table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage

LOCAL_EDGES = 1_000_000  # 16 bytes each: labelled by the driver; more are labelled by rounds over the table, with the same result
HOT, HOT_NODES = 100_000, 10_000


def components(edges: DataFrame, max_rounds: int = 60, local_edges: int | None = None) -> DataFrame:
    """(node, label): of every node of the edges (a, b), the smallest node it reaches.

    Large-star and small-star steps alternate: each links a node's neighbours to the smallest of them, so that the number of rounds
    grows with the logarithm of a component's width and the number of edges doesn't grow. Both steps are aggregations with map-side
    combining and a join with one row per node, in which the edges of a node that has many stay where they are; every round is written, so a
    lost executor costs one round's tasks, and what it was made of is deleted.
    """
    edges = storage.written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    count = edges.count()
    if count <= (LOCAL_EDGES if local_edges is None else local_edges):
        t = edges.toArrow()
        node, label = labelled(t["a"].to_numpy(), t["b"].to_numpy())
        return edges.sparkSession.createDataFrame(pa.table({"node": pa.array(node), "label": pa.array(label)}))
    before = None
    for _ in range(max_rounds):
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, 2 * count).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()
        down = storage.written(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
        small = _with_least(down, count)
        new = storage.written(small.select("a", F.col("m").alias("b")).unionAll(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        storage.drop(edges)
        storage.drop(down)
        edges = new
        # stars: every node that points anywhere points at one that points nowhere
        now = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if now == before:
            break
        before, count = now, now[0]
    else:
        raise RuntimeError("components did not settle")
    labels = edges.groupBy("a").agg(F.min("b").alias("label"))
    return labels.select(F.col("a").alias("node"), "label").unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def _with_least(edges: DataFrame, count: int) -> DataFrame:
    """(a, b, m): m is the smallest b of a. At most HOT_NODES nodes have more than 1/HOT_NODES of the edges: their m is broadcast."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    is_hot = F.col("n") > max(HOT, count // HOT_NODES)
    if count <= HOT:
        return edges.join(least.select("a", "m"), "a")
    looked = edges.join(F.broadcast(least.where(is_hot).select("a", F.col("m").alias("hot"))), "a", "left")
    return looked.where("hot is not null").select("a", "b", F.col("hot").alias("m")).unionAll(looked.where("hot is null").select("a", "b").join(least.where(~is_hot).select("a", "m"), "a"))


def labelled(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, label) of edges in memory: labels sink to the smallest neighbour's, then to their label's label."""
    node, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(node))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            return node, node[label]
        label = new
