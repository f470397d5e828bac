"""Connected components of link tables; only up to GATHERED distinct links pass through the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.llm.common import cut

#: Links that are joined in the driver, 16 bytes each: rounds of jobs for a few links cost it more memory than the links.
GATHERED = 1 << 16


def _tie(links: DataFrame, larger: bool) -> DataFrame:
    """Tie the larger (or the smaller and equal) neighbours of every node to its least one."""
    both = links.union(links.select("b", "a")) if larger else links
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.withColumn("m", F.least("a", "m")) if larger else least
    tied = both.join(least, "a")
    if larger:
        out = tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def _joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links and the least node that each reaches."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = list(range(len(nodes)))
    for x, y in zip(ends[: len(a)].tolist(), ends[len(a) :].tolist()):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        root[max(x, y)] = min(x, y)
    for x, above in enumerate(root):  # roots are below what they hold, so theirs are final
        root[x] = root[above]
    return nodes, nodes[np.array(root, np.int64)]


def components(links: DataFrame, most_rounds: int = 40, gathered: int = GATHERED) -> DataFrame:
    """``node, component`` for every node of the links ``a, b``; component is the least node.

    Up to ``gathered`` distinct links are joined in the driver. More of them stay on the executors, which
    alternate two steps: large star ties a node's larger neighbours to its least neighbour,
    small star its smaller ones. Both keep components whole, and after a number of rounds
    logarithmic in practice each component is a star around its least node. Links may come
    in both directions and repeat; links of a node with itself only make it appear. Empty
    links give an empty result.
    """
    alone = links.where("a = b").select(F.col("a").alias("node"))
    edges = cut(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if edges.count() <= gathered:
        few = edges.toArrow()
        nodes, least = _joined(few["a"].to_numpy(), few["b"].to_numpy())
        found = links.sparkSession.createDataFrame(pa.table({"node": pa.array(nodes, pa.int64()), "component": pa.array(least, pa.int64())}))
        only = alone.distinct().join(found, "node", "left_anti")
        return found.union(only.select("node", F.col("node").alias("component")))
    state = None
    for _ in range(most_rounds):
        edges = cut(_tie(_tie(edges, True), False))
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    centres = edges.select(F.col("b").alias("node")).distinct().union(alone).distinct()
    return found.union(centres.join(found, "node", "left_anti").select("node", F.col("node").alias("component")))


def spanning(a: np.ndarray, b: np.ndarray, size: int) -> list[int]:
    """Indices of those of the links a, b that join what the links before them have not joined."""
    root, kept = list(range(size)), []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x != y:
            root[x] = y
            kept.append(i)
    return kept
