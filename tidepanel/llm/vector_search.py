"""Nearest vectors by inner product through a hierarchical k-means tree.

The tree is fitted on a bounded sample, then every vector is put into its leaf.  A query walks the tree
best bin first: a priority queue holds the branches not yet taken, by the nearness of their centres, and
leaves come out one after the other.  How many leaves a query visits is calibrated: for some queries the true
neighbours among all vectors are found by brute force, and the visits are widened until the share of
them found reaches the recall asked for.  Leaves and their queries are cut into blocks, so that a leaf
that holds a third of all vectors is many tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import kept, sampled

#: Vectors the tree is fitted on, children of a node, vectors of the sample in a leaf.
TRAIN_VECTORS, BRANCHES, LEAF = 20_000, 8, 128
#: Queries used for calibration, and the recall that they must reach.
CALIBRATED, RECALL = 200, 0.97
#: Vectors and queries of a leaf that one task compares.
BLOCK, QUERY_BLOCK = 4096, 1024


@dataclass
class Tree:
    """``centres`` of all nodes; ``children`` of each node; ``leaf`` number of each node, -1 inside."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector, by the nearest centre at every level."""
        node = np.zeros(len(vectors), np.int64)
        for _ in range(64):
            inner = [n for n in np.unique(node) if self.children[n]]
            if not inner:
                break
            for n in inner:
                rows, below = np.flatnonzero(node == n), np.array(self.children[n])
                centres = self.centres[below]
                node[rows] = below[np.argmax(vectors[rows] @ centres.T - (centres**2).sum(axis=1) / 2, axis=1)]
        return self.leaf[node]

    def visits(self, query: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves in best-bin-first order."""
        order, queue, found = 0, [(0.0, 0, 0)], []
        while queue and len(found) < most:
            _, _, node = heapq.heappop(queue)
            while self.children[node]:
                below = np.array(self.children[node])
                near = self.centres[below] @ query
                best = int(np.argmax(near))
                for i, child in enumerate(below):
                    if i != best:
                        order += 1
                        heapq.heappush(queue, (-float(near[i]), order, int(child)))
                node = int(below[best])
            found.append(int(self.leaf[node]))
        return found


def _kmeans(vectors: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = vectors[rng.choice(len(vectors), k, replace=False)].copy()
    for _ in range(rounds):
        own = np.argmax(vectors @ centres.T - (centres**2).sum(axis=1) / 2, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, vectors)
        counts = np.bincount(own, minlength=k)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return np.unique(centres, axis=0)


def grown(vectors: np.ndarray, branches: int = BRANCHES, leaf: int = LEAF, seed: int = 17) -> Tree:
    """A tree over a sample; equal vectors are never split."""
    rng = np.random.default_rng(seed)
    width = vectors.shape[1] if vectors.ndim == 2 else 0
    centres, children, numbers = [vectors.mean(axis=0) if len(vectors) else np.zeros(width)], [[]], [-1]
    waiting, leaves = [(0, vectors)], 0
    while waiting:
        node, part = waiting.pop()
        split = None
        if len(part) > leaf:
            below = _kmeans(part, branches, rng)
            own = np.argmax(part @ below.T - (below**2).sum(axis=1) / 2, axis=1)
            used = np.unique(own)
            split = [(below[u], part[own == u]) for u in used] if len(used) > 1 else None
        if split is None:
            numbers[node], leaves = leaves, leaves + 1
            continue
        for centre, rows in split:
            centres.append(centre)
            children.append([])
            numbers.append(-1)
            children[node].append(len(centres) - 1)
            waiting.append((len(centres) - 1, rows))
    return Tree(np.array(centres), children, np.array(numbers))


def usable(vector: Column) -> Column:
    """Whether a vector has components, none NULL or infinite or no number, and not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.size(vector) > 0, F.lit(False)) & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, 0))


def _best(queries: pd.DataFrame, vectors: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` nearest of ``vectors`` for each query, itself left out; ties to the smaller id."""
    order = np.argsort(vectors["vec_id"].to_numpy(), kind="stable")
    ids, leaf = vectors["vec_id"].to_numpy()[order], vectors["leaf"].to_numpy()[order]
    own, most = queries["query_id"].to_numpy(), min(k, len(ids))
    parts: list[tuple[np.ndarray, ...]] = []
    if most and len(own):
        held, asked = _matrix(vectors["vector"])[order], _matrix(queries["vector"])
        longest = np.sqrt((held**2).sum(axis=1)).max()
        for at in range(0, len(own), 256):
            some = asked[at : at + 256]
            # a product to find those that may be among the nearest, whatever its rounding
            rough = some @ held.T
            rough[own[at : at + 256, None] == ids[None, :]] = -np.inf
            edge = -np.partition(-rough, most - 1, axis=1)[:, most - 1] - 1e-9 * longest * np.sqrt((some**2).sum(axis=1))
            q, v = np.nonzero((rough >= np.where(np.isfinite(edge), edge, -np.inf)[:, None]) & (rough > -np.inf))
            # then one sum per pair in a fixed order of components, the same wherever the pair is computed
            scores = np.zeros(len(q))
            for c in range(held.shape[1]):
                scores += some[q, c] * held[v, c]
            ranked = np.lexsort((v, -scores, q))
            q, v, scores = q[ranked], v[ranked], scores[ranked]
            near = np.arange(len(q)) - np.searchsorted(q, q) < most
            parts.append((own[at + q[near]], ids[v[near]], scores[near], leaf[v[near]]))
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [[], [], [], []]
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score", "leaf"), columns, strict=True)))


_FOUND = "query_id long, vec_id long, score double, leaf int"


def _top(found: DataFrame, k: int) -> DataFrame:
    turn = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(turn)).filter(F.col("rank") <= k)


def nearest(embeddings: DataFrame, queries: DataFrame, k: int = 20, recall: float = RECALL) -> DataFrame:
    """For each of ``queries`` (query_id, vector) its ``k`` nearest rows of ``embeddings`` (vec_id, embedding): query_id, rank, vec_id, score.

    Vectors that are NULL, zero, of another length than most or hold NULL or non-finite components take no part.  Rows that repeat an
    id and vector count once.  A query's own id is no candidate.  Fewer than ``k`` candidates are all returned.  Other columns are not read.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.filter(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    width = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("vector") == width.n)
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
    asked = asked.filter(usable(F.col("vector")) & (F.size("vector") == width.n)).dropDuplicates(["query_id"])

    sample = _matrix(pd.Series([r.vector for r in sampled(rows, TRAIN_VECTORS, "vec_id").collect()], dtype=object))
    shared = spark.sparkContext.broadcast(grown(sample))

    def into_leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(leaf=shared.value.assign(_matrix(batch["vector"])) if len(batch) else 0)

    indexed = kept(rows.mapInPandas(into_leaves, "vec_id long, vector array<double>, leaf int").dropDuplicates(["vec_id", "vector"]), "leaves")
    visits = _calibrated(indexed, asked, shared, k, recall)

    def walks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(leaves=[shared.value.visits(np.asarray(v), visits) for v in batch["vector"]])

    walked = asked.mapInPandas(walks, "query_id long, vector array<double>, leaves array<int>").select("query_id", "vector", F.explode("leaves").alias("leaf"))
    sizes = indexed.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    turns = kept(walked, "walks")
    asked_sizes = turns.groupBy("leaf").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("query_blocks"))
    left = (
        turns.join(sizes, "leaf").join(asked_sizes, "leaf")
        .withColumn("q", F.pmod(F.xxhash64("query_id"), F.col("query_blocks")).cast("int"))
        .withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("leaf", "q", "b", "query_id", "vector")
    )
    right = (
        indexed.join(sizes, "leaf").join(asked_sizes, "leaf")
        .withColumn("b", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
        .withColumn("q", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1))).select("leaf", "q", "b", "vec_id", "vector")
    )
    found = left.groupBy("leaf", "q", "b").cogroup(right.groupBy("leaf", "q", "b")).applyInPandas(lambda a, b: _best(a, b, k) if len(a) and len(b) else _best(a[:0], b, k), _FOUND)
    return _top(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _calibrated(indexed: DataFrame, asked: DataFrame, shared, k: int, recall: float) -> int:
    """The leaves to visit so that ``recall`` of the true neighbours of some queries lie in them."""
    some = sampled(asked, CALIBRATED, "query_id").collect()
    if not some:
        return 1
    tried = pd.DataFrame({"query_id": [r.query_id for r in some], "vector": [r.vector for r in some]})
    held = indexed.sparkSession.sparkContext.broadcast(tried)

    def brute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield _best(held.value, batch, k)

    true = _top(indexed.mapInPandas(brute, _FOUND), k).select("query_id", "leaf").toPandas()
    places = {r.query_id: {leaf: i for i, leaf in enumerate(shared.value.visits(np.asarray(r.vector), shared.value.leaves))} for r in some}
    needed = np.sort([places[q][leaf] + 1 for q, leaf in zip(true["query_id"], true["leaf"], strict=True)])
    visits = 1
    while len(needed) and visits < shared.value.leaves and np.mean(needed <= visits) < recall:
        visits += max(1, visits // 4)
    return min(visits, shared.value.leaves)
