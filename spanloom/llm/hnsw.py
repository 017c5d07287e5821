"""Approximate nearest neighbours by one navigable small-world graph per shard.

Vectors that are equal are one node.  Nodes are dealt to shards by a hash; each shard
builds a hierarchical navigable small-world graph and stores it as flat arrays: the
vectors, the neighbours of every node on the ground layer (a matrix with -1 for no
neighbour) and, for each upper layer, its nodes and their neighbours.  A query is
searched in every shard, and the shards' results are merged by exact cosine in
double precision.

Nodes are inserted from the highest layers down, those that reach higher first, so a
layer's nodes are the first ones of the layer below.  An insertion descends the
hierarchy above to its entry and is then a beam search in its layer.  Building and
searching work on blocks of vectors at once (numpy): the members of a block see the
earlier blocks through the graph and each other exactly.

Queries are dealt in blocks of `QUERY_BLOCK`, so that one task holds one shard
and one block.

Defined cases: vectors that are null, zero, empty, or hold null or non-finite
components take no part, neither as queries nor as candidates; so do rows with a
null id; rows with the same id and vector count once; of different vectors with one id
the one that sorts first counts; a query with fewer than k candidates gets all of them; ties go to
the smaller id; vectors of different length are compared only with their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

SHARD_ROWS, QUERY_BLOCK = 50_000, 4_096
LINKS, BUILD_WIDTH, SEARCH_WIDTH = 16, 64, 160


# ---- one graph


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest of each row, largest first."""
    k = min(k, scores.shape[1])
    part = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    return np.take_along_axis(part, np.argsort(-np.take_along_axis(scores, part, 1), axis=1, kind="stable"), 1)


def beam_search(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of a block of queries; returns (nodes, similarities), best first, -1 for none.

    Each step expands the best node of every query that is not expanded yet; a
    query is done when all of its ``width`` best are.
    """
    n, m = len(queries), links.shape[1]
    seen = np.zeros((n, len(vectors)), bool)
    rows = np.arange(n)
    nodes = np.full((n, width), -1, np.int64)
    sims = np.full((n, width), -np.inf, np.float32)
    done = np.ones((n, width), bool)
    nodes[:, 0] = entry
    sims[:, 0] = np.einsum("ij,ij->i", vectors[entry], queries)
    done[:, 0] = False
    seen[rows, entry] = True
    live = rows
    while len(live):
        open_sims = np.where(done[live], -np.inf, sims[live])
        at = open_sims.argmax(axis=1)
        going = open_sims[np.arange(len(live)), at] > -np.inf
        live, at = live[going], at[going]
        if not len(live):
            break
        done[live, at] = True
        near = links[nodes[live, at]]
        fresh = (near >= 0) & ~seen[live[:, None], near]
        seen[live[:, None], np.where(near >= 0, near, nodes[live, at][:, None])] = True
        new_sims = np.where(fresh, np.einsum("imj,ij->im", vectors[near], queries[live]), -np.inf).astype(np.float32)
        all_sims = np.concatenate([sims[live], new_sims], axis=1)
        all_nodes = np.concatenate([nodes[live], np.where(fresh, near, -1)], axis=1)
        all_done = np.concatenate([done[live], ~fresh], axis=1)
        order = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        sims[live], nodes[live], done[live] = (np.take_along_axis(x, order, 1) for x in (all_sims, all_nodes, all_done))
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(nodes, order, 1), np.take_along_axis(sims, order, 1)


def spread(vectors: np.ndarray, candidates: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
    """Of each row's candidates (best first) those nearer to the node than to one kept before; then the best others."""
    n, k = candidates.shape
    held = vectors[candidates]
    among = np.einsum("iaj,ibj->iab", held, held)
    kept = np.zeros((n, k), bool)
    count = np.zeros(n, np.int64)
    for j in range(k):
        closer = (np.where(kept[:, :j], among[:, j, :j], -np.inf) > sims[:, j : j + 1]).any(axis=1) if j else np.zeros(n, bool)
        ok = (candidates[:, j] >= 0) & ~closer & (count < keep)
        kept[:, j] = ok
        count += ok
    rank = np.where(kept, 0, np.where(candidates >= 0, 1, 2)) * k + np.arange(k)
    order = np.argsort(rank, axis=1)[:, :keep]
    return np.where(np.take_along_axis(candidates, order, 1) >= 0, np.take_along_axis(candidates, order, 1), -1)


def _layer(vectors: np.ndarray, width: int, above: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The neighbours on one layer (two times LINKS columns) of all ``vectors``, inserted in doubling blocks.

    ``above``: the finished layers above, the highest first; their nodes are the first of ``vectors``.
    """
    upper = len(above[-1][0]) if above else 0
    n, m = len(vectors), 2 * LINKS
    links = np.full((n, m), -1, np.int64)
    size = min(n, 256)
    sims = vectors[:size] @ vectors[:size].T
    np.fill_diagonal(sims, -np.inf)
    if size > 1:
        near = _top(sims, min(width, size - 1))
        chosen = spread(vectors, near, np.take_along_axis(sims, near, 1), LINKS)
        _connect(vectors, links, np.arange(size), chosen)
    at = size
    while at < n:
        block = np.arange(at, min(n, at + min(1_024, at)))
        if at >= upper > 0:
            entry = descend(vectors, above, vectors[block])
        else:  # the nodes of the layers above have no entry from there
            block = block[block < upper] if upper > at else block
            entry = _entries(vectors[:at], vectors[block])
        found, found_sims = beam_search(vectors[:at], links[:at], vectors[block], entry, width)
        inside = vectors[block] @ vectors[block].T
        np.fill_diagonal(inside, -np.inf)
        near = _top(inside, min(LINKS, len(block) - 1) or 1)
        both = np.concatenate([found, block[near] if len(block) > 1 else np.full((len(block), 1), -1)], axis=1)
        both_sims = np.concatenate([found_sims, np.take_along_axis(inside, near, 1)], axis=1)
        order = np.argsort(-both_sims, axis=1, kind="stable")[:, :width]
        chosen = spread(vectors, np.take_along_axis(both, order, 1), np.take_along_axis(both_sims, order, 1), LINKS)
        _connect(vectors, links, block, chosen)
        at = block[-1] + 1
    return links


def descend(vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], queries: np.ndarray) -> np.ndarray:
    """The nearest node that each query meets on its way down the layers, the highest first."""
    entry = None
    for nodes, links in layers:
        held = vectors[: len(nodes)]
        entry = _entries(held, queries) if entry is None else entry
        entry = beam_search(held, links, queries, entry, 4)[0][:, 0]
    return entry


def _entries(held: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """The best of 32 spread-out nodes for each query."""
    some = np.linspace(0, len(held) - 1, min(32, len(held))).astype(np.int64)
    return some[(queries @ held[some].T).argmax(axis=1)]


def _connect(vectors: np.ndarray, links: np.ndarray, nodes: np.ndarray, chosen: np.ndarray) -> None:
    """Set the nodes' links and the links back; a node with too many keeps the most useful."""
    links[nodes, : chosen.shape[1]] = chosen
    src = np.repeat(nodes, chosen.shape[1])
    dst = chosen.ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    starts = np.flatnonzero(np.append(True, dst[1:] != dst[:-1])) if len(dst) else []
    for a, b in zip(starts, np.append(starts[1:], len(dst)) if len(dst) else []):
        node = dst[a]
        held = links[node][links[node] >= 0]
        want = np.concatenate([held, np.setdiff1d(src[a:b], held)])
        if len(want) > links.shape[1]:
            sims = vectors[want] @ vectors[node]
            best = np.argsort(-sims, kind="stable")[: 3 * links.shape[1]]
            want = spread(vectors, want[best][None], sims[best][None], links.shape[1])[0]
        links[node] = -1
        links[node, : len(want)] = want


def heights(draw: np.ndarray) -> np.ndarray:
    """How high nodes reach, from a number in [0, 1) for each: one in LINKS goes on to each next layer."""
    return np.floor(-np.log(np.maximum(draw, 1e-12)) / np.log(LINKS)).astype(int)


class Graph:
    """A hierarchy of layers over unit vectors, those that reach higher first; layer 0 holds all nodes."""

    def __init__(self, vectors: np.ndarray, height: np.ndarray):
        self.vectors = vectors
        done: list[tuple[np.ndarray, np.ndarray]] = []  # the highest first
        for level in range(int(height.max(initial=0)), -1, -1):
            n = int((height >= level).sum())
            if level and n < 2:
                continue
            done.append((np.arange(n), _layer(vectors[:n], BUILD_WIDTH, done)))
        self.layers = done[::-1]

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        upper = self.layers[:0:-1]
        entry = descend(self.vectors, upper, queries) if upper else _entries(self.vectors, queries)
        return beam_search(self.vectors, self.layers[0][1], queries, entry, width)

    def arrays(self) -> list[bytes]:
        """The layers as flat arrays: nodes and neighbours in turn."""
        return [x.astype(np.int32).tobytes() for layer in self.layers for x in layer]

    @classmethod
    def of(cls, vectors: np.ndarray, arrays: list[bytes]) -> "Graph":
        out = cls.__new__(cls)
        out.vectors = vectors
        flat = [np.frombuffer(x, np.int32).astype(np.int64) for x in arrays]
        out.layers = [(nodes, links.reshape(-1, 2 * LINKS)) for nodes, links in zip(flat[::2], flat[1::2])]
        return out


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times a power of two that takes its largest component below 1, which changes no cosine."""
    _, power = np.frexp(np.abs(vectors).max(axis=1))
    return np.ldexp(vectors, -power[:, None])


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = scaled(vectors)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


# ---- the distributed index


def usable(rows: DataFrame, ident: str, vector: str) -> DataFrame:
    """(id, vector array<double>): the rows that take part."""
    v = F.col(vector).cast("array<double>")
    kept = rows.where(F.col(ident).isNotNull() & F.col(vector).isNotNull()).select(F.col(ident).cast("long").alias("id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0))
    kept = kept.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0))
    return kept.groupBy("id").agg(F.min("v").alias("v"))


def build(vectors: DataFrame, k: int) -> DataFrame:
    """The index of (id, v): a row per shard with ids, vectors and the graph's flat arrays.

    Each node has the k + 1 smallest ids of its vector (one of them may be the query itself).
    """
    nodes = (
        vectors.withColumn("nth", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("nth") <= k + 1)
        .groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    )
    nodes = common.materialize(nodes, "nodes")
    shards = max(1, -(-nodes.count() // SHARD_ROWS))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("ids"), F.lit(shards)).cast("int")).withColumn("dim", F.size("v"))

    def graph(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ids", key=lambda s: s.map(lambda x: x[0]))
        v = np.array(group.v.tolist(), np.float64)
        u = unit(v).astype(np.float32)
        height = heights(np.random.default_rng(2).random(len(u)))
        order = np.random.default_rng(1).permutation(len(u))  # inserted in no order of the data
        order = order[np.argsort(-height[order], kind="stable")]
        v, u, ids = v[order], u[order], [group.ids.iloc[i] for i in order]
        g = Graph(u, height[order])
        return pd.DataFrame({"shard": [group.shard.iloc[0]], "dim": [group.dim.iloc[0]], "sizes": [[len(x) for x in ids]], "ids": [np.concatenate(ids).astype(np.int64)], "vectors": [v.tobytes()], "graph": [g.arrays()]})

    index = dealt.groupBy("shard", "dim").applyInPandas(graph, "shard int, dim int, sizes array<int>, ids array<long>, vectors binary, graph array<binary>")
    return common.materialize(index, "index")


def search(index: DataFrame, queries: DataFrame, k: int, width: int = SEARCH_WIDTH) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest that are found for each (id, v), the query itself left out."""
    total = queries.count()
    blocks = max(1, -(-total // QUERY_BLOCK))
    places = index.select(F.col("shard").alias("to_shard"), F.col("dim").alias("to_dim"))
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("to_dim", F.size("v")).join(places, "to_dim")
    copies = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("block", F.col("block").cast("int"))

    def find(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        row = right.iloc[0]
        v = scaled(np.frombuffer(row.vectors, np.float64).reshape(len(row.sizes), -1))
        starts = np.concatenate([[0], np.cumsum(row.sizes)])
        g = Graph.of(unit(v).astype(np.float32), list(row.graph))
        out = []
        for at in range(0, len(left), 256):
            q = scaled(np.array(left.v.iloc[at : at + 256].tolist(), np.float64))
            nodes, _ = g.search(unit(q).astype(np.float32), min(width, len(v)))
            for ident, vector, found in zip(left.id.iloc[at : at + 256], q, nodes):
                found = found[found >= 0]
                cosines = (v[found] @ vector) / (np.linalg.norm(v[found], axis=1) * np.linalg.norm(vector))
                best = []
                for j in np.argsort(-cosines, kind="stable")[: 4 * k + 4]:
                    best += [(-cosines[j], i) for i in row.ids[starts[found[j]] : starts[found[j] + 1]] if i != ident]
                out += [(ident, i, -c) for c, i in sorted(best)[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = dealt.groupBy("to_shard", "to_dim", "block").cogroup(copies.groupBy("shard", "dim", "block")).applyInPandas(find, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run() -> DataFrame:
        vectors = common.materialize(usable(common.table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "vectors")
        return search(build(vectors, 5), vectors.where("id % 50 = 0"), 5)

    return common.finished(spark, run)
