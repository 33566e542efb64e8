"""Graph operators on edge tables (src, dst)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import settled


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree, role): driven if anything points to it, source if it only points, else isolated."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("out_degree"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"))
    joined = nodes.join(into, "node", "left").join(out, "node", "left").na.fill(0, ["in_degree", "out_degree"])
    return joined.withColumn("role", F.when(F.col("in_degree") > 0, "driven").when(F.col("out_degree") > 0, "source").otherwise("isolated"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select("dst", "src")).distinct()


def random_dag(nodes: int, most_parents: int, seed: int) -> list[tuple[int, int]]:
    """Edges from lower to higher numbers, each node with at most `most_parents` of them; a driver-sized plan of a system."""
    rng = np.random.default_rng(seed)
    edges = []
    for j in range(1, nodes):
        for i in rng.choice(j, min(j, int(rng.integers(0, most_parents + 1))), replace=False):
            edges.append((int(i), j))
    return edges


def pair_classes(edges: DataFrame) -> DataFrame:
    """(i, j, class) of the unordered pairs that share an edge (edge) or only a neighbour (two_hop); all others are far."""
    both = both_ways(edges).where("src <> dst")
    direct = both.where("src < dst").select(F.col("src").alias("i"), F.col("dst").alias("j"))
    through = both.select(F.col("dst").alias("m"), F.col("src").alias("i")).join(both.select(F.col("src").alias("m"), F.col("dst").alias("j")), "m").where("i < j").select("i", "j").distinct()
    return direct.withColumn("class", F.lit("edge")).unionByName(through.join(direct, ["i", "j"], "left_anti").withColumn("class", F.lit("two_hop")))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component = smallest node reachable), by least labels over neighbours and a jump to the label's label each round."""
    both = settled(both_ways(links))
    labels = settled(both.select(F.col("src").alias("node")).distinct().withColumn("component", F.col("node")))
    before = None
    for _ in range(rounds):
        near = both.join(labels, F.col("dst") == F.col("node")).groupBy("src").agg(F.min("component").alias("_near"))
        stepped = labels.join(near, F.col("node") == F.col("src"), "left").select("node", F.least("component", "_near").alias("component"))
        jump = stepped.select(F.col("node").alias("_n"), F.col("component").alias("_j"))
        labels = settled(stepped.join(jump, F.col("component") == F.col("_n"), "left").select("node", F.least("component", "_j").alias("component")))
        now = tuple(labels.agg(F.sum(F.xxhash64("node", "component").cast("decimal(38,0)")), F.count(F.lit(1))).first())
        if now == before:
            return labels
        before = now
    raise RuntimeError("components did not settle")
