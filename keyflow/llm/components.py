"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a partial minimum per node and a join on the node; the edge table is written to the shared folder
between steps, so lost executors repeat one step only; what a step has read is deleted after the next. Nothing is
collected but three numbers a round. Nodes with more than ``HUB_EDGES`` edges (there are as many as edges / ``HUB_EDGES``
at most) are joined by broadcast, so a component of a third of all nodes is no hot key. Tables of up to ``FEW_EDGES`` edges
are dealt over a few tasks, with their minima broadcast.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyflow.llm.common import forget, materialize, partitions

#: Edges of a node from which it is joined apart.
HUB_EDGES = 1 << 20
#: Edges up to which a step has a few tasks and minima are broadcast.
FEW_EDGES = 1 << 18


def local_stars(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replace edges by stars round the smallest node of each of their components: as many rows as nodes at most."""
    if not len(left):
        return left, right
    nodes, place = np.unique(np.concatenate([left, right]), return_inverse=True)
    i, j = place[: len(left)], place[len(left) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label, new)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _dealt(edges: DataFrame, count: int) -> DataFrame:
    """A few edges (``count`` at most) over a few tasks, those of a hub over all of them, so that what is written has no file
    for each shuffle partition."""
    if count > FEW_EDGES:
        return edges
    return edges.repartition(min(partitions(edges.sparkSession), max(8, count // 32_768)), "a", "b")


def _lowest(edges: DataFrame, name: str) -> DataFrame:
    return materialize(edges.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n")), name)


def _with_lowest(edges: DataFrame, low: DataFrame, count: int) -> DataFrame:
    """``edges`` with the low of their a; ``count`` edges there are at most."""
    if count <= FEW_EDGES:
        return edges.join(F.broadcast(low.drop("n")), "a")  # FEW_EDGES rows at most
    if count <= HUB_EDGES:
        return edges.join(low.drop("n"), "a")
    hubs = F.broadcast(low.where(F.col("n") > HUB_EDGES).drop("n"))  # count / HUB_EDGES rows at most
    rest = edges.join(hubs, "a", "left_anti").join(low.where(F.col("n") <= HUB_EDGES).drop("n"), "a")
    return edges.join(hubs, "a").unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of one type, in any direction, loops and repeats allowed: (node, root), root the smallest
    node of the component, for each node that has an edge to another. Null ends are no nodes."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), (F.col("a") != F.col("b")).alias("ok"))
    edges = materialize(edges.where("ok").select("a", "b").distinct(), "edges")
    seen, count = None, edges.count()
    while True:
        many = 2 * count
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _lowest(both, "large")
        low = least.withColumn("low", F.least("a", "low"))
        large = _with_lowest(both, low, many).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = materialize(_dealt(large.where("a != b"), many).distinct(), "large-star")
        forget(edges, least)
        low = _lowest(large, "small")
        small = _with_lowest(large, low, many).where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        small = small.unionByName(low.select("a", F.col("low").alias("b")))
        edges = materialize(_dealt(small, many).distinct(), "small-star")
        forget(large, low)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum((F.xxhash64("b", "a") % 1000003))).first()
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen, count = now, now[0]
