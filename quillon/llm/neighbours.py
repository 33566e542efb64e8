"""Approximate nearest neighbours by cosine: an NN-descent graph and greedy graph search.

Vectors of one direction (equal but for a positive factor, to ten decimals of the unit vector) are one node: a class with its smallest row ids. Nodes
are dealt over shards of about `shard_nodes` by hash, so every table's groups have a bounded size. In each shard a first graph comes from exact neighbours inside small cells of random
projections; NN-descent then joins, round by round, each node's neighbours (both ways) with their neighbours, and keeps the nearest.
Queries, in blocks, search each shard greedily: from fixed entry nodes the best nodes not yet expanded are expanded, over their own links
and a few far ones that keep groups of near copies in reach, until the `beam` nearest found are all expanded. The nearest over all shards are scored
in double precision on the original vectors; scores that agree to twelve decimals are ties. A shard's table travels once for `QUERY_BLOCK` queries.

Every row is indexed. Defined results: vectors that are null, zero, or hold null or non-finite components take no part, neither do empty
ones; vectors of another dimension than the query's are no candidates; rows that repeat id and vector are one row;
a null id takes no part; other columns are dropped; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import stored

DEGREE, BEAM, ROUNDS, SHARD_NODES, QUERY_BLOCK = 20, 128, 3, 4096, 1 << 14
_CELL, _TREES, _ENTRIES, _EXPAND, _FAR, _AT_ONCE, _DECIMALS = 64, 3, 256, 6, 4, 512, 12


def directions(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that no square over- or underflows."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def unit(vectors: np.ndarray) -> np.ndarray:
    return directions(vectors).astype(np.float32)


def nearest_of(x: np.ndarray, candidates: list[np.ndarray], degree: int) -> list[np.ndarray]:
    """Of each node's candidates the `degree` nearest, nearest first."""
    out = []
    for i, c in enumerate(candidates):
        c = np.unique(c)
        c = c[c != i]
        out.append(c[np.argsort(-(x[c] @ x[i]), kind="stable")[:degree]].astype(np.int32))
    return out


def cells(x: np.ndarray, rng: np.random.Generator, most: int = _CELL) -> list[np.ndarray]:
    """The nodes halved along random directions until at most `most` are left in a cell."""
    todo, out = [np.arange(len(x))], []
    while todo:
        own = todo.pop()
        if len(own) <= most:
            out.append(own)
            continue
        order = own[np.argsort(x[own] @ rng.normal(size=x.shape[1]).astype(np.float32), kind="stable")]
        todo += [order[: len(own) // 2], order[len(own) // 2 :]]
    return out


def first_graph(x: np.ndarray, degree: int, seed: int) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    found: list[list[np.ndarray]] = [[] for _ in range(len(x))]
    for _ in range(_TREES):
        for own in cells(x, rng):
            near = x[own] @ x[own].T
            np.fill_diagonal(near, -2)
            best = np.argsort(-near, axis=1, kind="stable")[:, : min(degree, len(own) - 1)]
            for i, b in zip(own, best):
                found[i].append(own[b])
    return nearest_of(x, [np.concatenate(f) if f else np.zeros(0, np.int64) for f in found], degree)


def greedy_search(x: np.ndarray, adjacency: np.ndarray, queries: np.ndarray, beam: int, expand: int = _EXPAND) -> np.ndarray:
    """For each query the `beam` nearest nodes found, nearest first, -1 where there are fewer. adjacency: a row of nodes each, -1 padded."""
    n, q = len(x), len(queries)
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True  # stands for -1
    entries = np.unique(np.linspace(0, n - 1, min(_ENTRIES, n)).astype(np.int64))
    seen[:, entries] = True
    ids = np.full((q, beam + max(len(entries), expand * adjacency.shape[1])), -1, np.int64)
    near = np.full(ids.shape, -np.inf, np.float32)
    done = np.ones(ids.shape, bool)
    ids[:, : len(entries)], near[:, : len(entries)], done[:, : len(entries)] = entries, queries @ x[entries].T, False
    active = np.arange(q)
    while len(active):
        order = np.argsort(-near[active], axis=1, kind="stable")
        rows = active[:, None]
        ids[active], near[active], done[active] = ids[rows, order], near[rows, order], done[rows, order]
        ids[active, beam:], near[active, beam:], done[active, beam:] = -1, -np.inf, True
        open_ = ~done[active, :beam]
        active, open_ = active[open_.any(axis=1)], open_[open_.any(axis=1)]
        if not len(active):
            break
        pick = np.argsort(~open_, axis=1, kind="stable")[:, :expand]
        valid = np.take_along_axis(open_, pick, 1)
        rows = active[:, None]
        nodes = np.where(valid, ids[rows, pick], -1)
        done[rows, pick] = True
        reached = np.where(nodes[..., None] >= 0, adjacency[np.maximum(nodes, 0)], -1).reshape(len(active), -1)
        reached = np.where(seen[rows, reached], -1, reached)
        reached = np.sort(reached, axis=1)
        reached[:, 1:][reached[:, 1:] == reached[:, :-1]] = -1
        seen[rows, reached] = True
        width = reached.shape[1]
        score = np.einsum("qmd,qd->qm", x[np.maximum(reached, 0)], queries[active])
        ids[active, beam : beam + width] = reached
        near[active, beam : beam + width] = np.where(reached >= 0, score, -np.inf)
        done[active, beam : beam + width] = reached < 0
    return ids[:, :beam]


def _nodes(rows: DataFrame, shard_nodes: int) -> DataFrame:
    """(dim, shard, node, vector) of the distinct vectors."""
    nodes = stored(rows.dropDuplicates(["node"]).select("node", "vector"), "nodes")
    shards = nodes.count() // shard_nodes + 1
    return nodes.select(F.size("vector").alias("dim"), F.pmod(F.xxhash64("node"), F.lit(shards)).alias("shard"), "node", "vector")


def build_graph(nodes: DataFrame, degree: int = DEGREE, rounds: int = ROUNDS) -> DataFrame:
    """(dim, shard, i, node, vector, near) of each node: its place in its shard and its neighbours' places."""

    def first(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node").reset_index(drop=True)
        x = unit(np.stack(frame["vector"]))
        return frame.assign(i=np.arange(len(frame), dtype=np.int32), near=first_graph(x, degree, int(key[1]) + 1))[["dim", "shard", "i", "node", "vector", "near"]]

    graph = stored(nodes.groupBy("dim", "shard").applyInPandas(first, "dim int, shard long, i int, node long, vector array<double>, near array<int>"), "graph")

    def nearer(frame: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("i").reset_index(drop=True)
        x = unit(np.stack(frame["vector"]))
        candidates = [c for c in frame["near"]]
        for i, c in zip(found["place"], found["found"]):
            candidates[i] = np.concatenate([candidates[i], c])
        return frame.assign(near=nearest_of(x, candidates, degree))[["dim", "shard", "i", "node", "vector", "near"]]

    at = ["dim", "shard"]
    for _ in range(rounds):
        forward = graph.select(*at, "i", F.explode("near").alias("j"))
        both = forward.union(forward.select(*at, F.col("j").alias("i"), F.col("i").alias("j"))).groupBy(*at, "i").agg(F.collect_set("j").alias("around"))
        steps = both.select(*at, "i", F.explode("around").alias("j"))
        second = steps.join(both.withColumnRenamed("i", "j"), [*at, "j"]).groupBy(*at, "i").agg(F.array_distinct(F.flatten(F.collect_list("around"))).alias("found"))
        second = second.select(F.col("dim").alias("d"), F.col("shard").alias("s"), F.col("i").alias("place"), "found")
        graph = stored(graph.groupBy(*at).cogroup(second.groupBy("d", "s")).applyInPandas(nearer, graph.schema), "graph")
    return graph


def _adjacency(near: list[np.ndarray], degree: int) -> np.ndarray:
    """Neighbours of each node, up to as many that have it as theirs, nearest ranks first, and a few nodes drawn at random."""
    n = len(near)
    source = np.repeat(np.arange(n), [len(x) for x in near])
    target = np.concatenate(near) if n else np.zeros(0, np.int64)
    rank = np.concatenate([np.arange(len(x)) for x in near]) if n else target
    order = np.lexsort((rank, target))
    source, target = source[order], target[order]
    place = np.arange(len(target)) - np.searchsorted(target, target, "left")
    out = np.full((n, 2 * degree + _FAR), -1, np.int64)
    out[:, 2 * degree :] = np.random.default_rng(n).integers(0, n, (n, _FAR))
    for i, x in enumerate(near):
        out[i, : len(x)] = x
    good = place < degree
    out[target[good], degree + place[good]] = source[good]
    return out


def search_graph(graph: DataFrame, queries: DataFrame, found: int, degree: int = DEGREE, beam: int = BEAM, block: int = QUERY_BLOCK) -> DataFrame:
    """(query, node, score) of the `found` nearest nodes of each shard; queries: (query, vector), the query a node of its own or not."""
    queries = queries.select("query", F.size("vector").alias("dim"), "vector")
    blocks = queries.count() // block + 1
    shards = graph.select("dim", "shard").distinct()
    shards = shards.select(F.col("dim").alias("d"), F.col("shard").alias("s"))
    asked = queries.withColumn("b", F.pmod(F.xxhash64("query"), F.lit(blocks))).join(shards, F.col("dim") == F.col("d")).select("d", "s", "b", "query", "vector")
    dealt = graph.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def search(index: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(index):
            return pd.DataFrame({"query": [], "node": [], "score": []})
        index = index.sort_values("i")
        exact, asked_ = directions(np.stack(index["vector"])), directions(np.stack(own["vector"]))
        x, adjacency, nodes, keys = exact.astype(np.float32), _adjacency([*index["near"]], degree), index["node"].to_numpy(), own["query"].to_numpy()
        out = []
        for at in range(0, len(keys), _AT_ONCE):
            part = asked_[at : at + _AT_ONCE]
            for k, ids in enumerate(greedy_search(x, adjacency, part.astype(np.float32), beam)):
                ids = ids[ids >= 0]
                score = exact[ids] @ part[k]
                least = np.round(np.sort(score)[::-1][:found][-1], _DECIMALS)
                ids, score = ids[np.round(score, _DECIMALS) >= least], score[np.round(score, _DECIMALS) >= least]  # all ties stay: their ids decide
                out.append(pd.DataFrame({"query": keys[at + k], "node": nodes[ids], "score": score}))
        return pd.concat(out)

    return dealt.groupBy("dim", "shard", "block").cogroup(asked.groupBy("d", "s", "b")).applyInPandas(search, "query long, node long, score double")


def nearest_neighbours(embeddings: DataFrame, every: int = 50, k: int = 5, degree: int = DEGREE, beam: int = BEAM, rounds: int = ROUNDS, shard_nodes: int = SHARD_NODES, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows of each row whose id is divisible by `every`; ties to smaller ids."""
    rows = embeddings.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.where(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))
    largest = F.array_max(F.transform("vector", F.abs))
    scaled = F.transform("vector", lambda x: x / F.col("largest"))
    norm = F.sqrt(F.aggregate("scaled", F.lit(0.0), lambda s, x: s + x * x))
    rows = rows.withColumn("largest", largest).withColumn("scaled", scaled).withColumn("norm", norm)
    rows = rows.select("id", "vector", F.xxhash64(F.transform("scaled", lambda x: F.round(x / F.col("norm"), 10) + F.lit(0.0))).alias("node"))
    rows = stored(rows, "vectors")
    graph = build_graph(_nodes(rows, shard_nodes), degree, rounds)
    queries = rows.where(F.pmod("id", F.lit(every)) == 0).select("id", "node").distinct()
    asked = rows.where(F.pmod("id", F.lit(every)) == 0).dropDuplicates(["node"]).select(F.col("node").alias("query"), "vector")
    hits = search_graph(graph, stored(asked, "queries"), k + 1, degree, beam)
    hits = stored(hits.withColumn("r", F.rank().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", _DECIMALS))))).where(F.col("r") <= k + 1).drop("r"), "hits")
    wanted = hits.select("node").distinct()
    members = rows.join(wanted, "node", "left_semi").select("node", "id").distinct()
    members = members.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("id"))).where(F.col("r") <= k + 1).drop("r")
    found = hits.join(members, "node").join(queries.select(F.col("node").alias("query"), F.col("id").alias("query_id")), "query").where("id <> query_id")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", _DECIMALS)), "id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
