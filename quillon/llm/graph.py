"""Connected components of a link table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import few, stored

#: Edges of a task (4 MB). Contracted links of this number at most need one task and no rounds.
TASK_EDGES = 1 << 18


def smallest_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node reachable) of the edges u-v, by hooking roots to smaller ones and halving paths."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        if (low == high).all():
            return nodes, nodes[root]
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]


def _forest(edges: DataFrame) -> DataFrame:
    """Each partition's edges (u, v) contracted to stars around their smallest nodes, without a shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            nodes, roots = smallest_reached(frame["u"].to_numpy(), frame["v"].to_numpy())
            keep = nodes != roots
            yield pd.DataFrame({"u": nodes[keep], "v": roots[keep]})

    return edges.select("u", "v").mapInPandas(run, "u long, v long")


def _last(edges: DataFrame) -> DataFrame:
    """(node, component) of a task's edges (u, v)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [*frames]
        if parts:
            every = pd.concat(parts)
            nodes, roots = smallest_reached(every["u"].to_numpy(), every["v"].to_numpy())
            yield pd.DataFrame({"node": nodes, "component": roots})

    return edges.select("u", "v").coalesce(1).mapInPandas(run, "node long, component long")


def components(links: DataFrame, rounds: int = 60, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, component = smallest node reachable) for every node of links (a, b), by alternating large and small stars.

    Every round is a few minima and equi-joins; its table is contracted inside partitions and written, so lineage stays short and a
    lost executor costs one round. Rounds end when a task's edges are left.
    """
    edges = stored(_forest(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "edges")
    for _ in range(rounds):
        count = edges.count()
        if count <= task_edges:
            return _last(edges)
        heads = edges.groupBy("u").agg(F.min("v").alias("v"), F.max("v").alias("w"))
        # All are stars around their smallest nodes: one edge a node, and none leads to a node that has an edge itself.
        if heads.where("v <> w").isEmpty() and edges.join(heads.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(_forest(few(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v"), count, task_edges)), "edges")
    else:
        raise RuntimeError("components did not settle")
    edges = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return edges.unionByName(edges.select(F.col("component").alias("node"), "component").distinct())
