"""Connected components of an edge table: contraction within slices, then alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Edges that one task contracts, about; memory for a slice is a small multiple of them.
EDGES_A_TASK = 1 << 20


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges -> (node, smallest node that these edges reach), for the nodes that are not the smallest."""
    node, at = np.unique(np.r_[u, v], return_inverse=True)
    u, v, root = at[: len(u)], at[len(u) :], np.arange(len(node))
    while len(u):
        u, v = root[u], root[v]
        apart = u != v
        u, v = u[apart], v[apart]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    low = node[root]
    return node[low < node], low[low < node]


def _contracted(batches):
    """The edges of a slice as stars: at most one edge for each node."""
    import pyarrow as pa

    held, n = [], 0
    for batch in batches:
        held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
        n += batch.num_rows
        if n > 2 * EDGES_A_TASK:
            held = [stars(*(np.concatenate(x) for x in zip(*held)))]
            n = len(held[0][0]) if len(held[0][0]) < EDGES_A_TASK else 0  # nothing more to gain: the next slice starts
            if not n:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], ["u", "v"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars(*(np.concatenate(x) for x in zip(*held)))], ["u", "v"])


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """edges (u, v) of longs -> (node, component): the smallest node that each node reaches.

    Nodes without an edge do not occur; no edges give no rows; more than max_rounds rounds raise an error. Slices of
    EDGES_A_TASK edges are contracted to stars first; where one slice is all, that is the result. Each round then is two
    joins on the edges, whose number never grows, and a group-by with map-side minimum; only counts and a checksum come
    to the driver.
    """
    raw = written(edges.select("u", "v").where("u <> v"), "edges")
    slices = max(1, -(-raw.count() // EDGES_A_TASK))
    now = written(raw.coalesce(slices).mapInArrow(_contracted, "u long, v long"), "stars")
    if slices > 1:
        now = _settled(now.distinct(), max_rounds)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct())


def _settled(edges: DataFrame, max_rounds: int) -> DataFrame:
    """Stars (u, v) of all edges (u > v)."""
    now = written(edges, "edges")
    state = _state(now)
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, so that a node with very many edges is a large partition of a plain join, which Spark splits.
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = written(both.where("v > u").join(low.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low.hint("merge"), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = written(small, "edges")
        last, state = state, _state(now)
        if last == state:
            return now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
