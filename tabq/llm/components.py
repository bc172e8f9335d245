"""Connected components of an edge list by alternating large-star and small-star steps; nothing comes to the driver but two numbers a round."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the nodes of the edges a-b."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        lo = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, x, lo)
        np.minimum.at(root, y, lo)
        np.minimum.at(root, before[x], lo)
        np.minimum.at(root, before[y], lo)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            break
    return nodes, nodes[root]


#: A node with over 1/HOT_SHARE of the edges is joined by broadcast; there are at most 2 * HOT_SHARE of them.
HOT_SHARE = 500


def _with_least(edges: DataFrame, around: DataFrame, total: int) -> DataFrame:
    """`edges` with the smallest neighbour m of u in `around`; nodes with a large share of all edges do not go to one task."""
    least = around.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hot = least.filter(F.col("n") * HOT_SHARE > total).select("u", "m").collect()
    least = least.select("u", "m")
    if not hot:
        return edges.join(least, "u")
    hubs = F.broadcast(edges.sparkSession.createDataFrame(hot, least.schema))
    return edges.join(hubs, "u").unionByName(edges.join(hubs.select("u"), "u", "left_anti").join(least, "u"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (long columns u, v): root is the smallest node of its component. Unsettled after `rounds`, it raises."""

    def state(e: DataFrame):
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r.n, r.h

    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = checkpointed(edges.distinct())
    last = state(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = checkpointed(_with_least(both.filter("v > u"), both, last[0]).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
        joined = _with_least(large, large, last[0])
        small = joined.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = checkpointed(small.filter("u <> v").distinct())
        now = state(edges)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
