"""Centroid clustering with a vantage-point tree over the centroids.

Vectors are integers, so distances and means are exact. Each round builds a vantage-point tree
over the centroids on the driver (``k`` points, a bound the caller sets) and broadcasts it;
tasks search it for every vector best first: of the tree's nodes seen so far the one with the
smallest lower bound is opened next, until no bound is within the best distance. The bound is
inclusive, so a centroid at exactly the best distance is still met and the smaller number wins.
Only sums and counts for each centroid come back.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topiclens.session import cut_lineage

FRONTIER = 1 << 21  # (vector, tree node) bounds held at once
FAR = np.iinfo(np.int64).max


class VantageTree:
    """Nodes as arrays. An inner node has a vantage centroid and two children with the range of
    their centroids' distances from it; a leaf has up to ``leaf_size`` centroids."""

    def __init__(self, centroids: np.ndarray, leaf_size: int = 2):
        self.centroids = centroids
        self.buckets: list[list[int]] = []  # of a leaf its centroids, of an inner node its vantage centroid
        self.children: list[list[tuple[int, float, float]]] = []
        waiting = [(list(range(len(centroids))), None)]
        while waiting:
            members, parent = waiting.pop()
            node = len(self.buckets)
            if parent is not None:
                above, low, high = parent
                self.children[above].append((node, low, high))
            self.children.append([])
            if len(members) <= leaf_size:
                self.buckets.append(members)
                continue
            vantage, rest = members[0], members[1:]
            self.buckets.append([vantage])
            squared = ((centroids[rest] - centroids[vantage]) ** 2).sum(1)
            order = np.lexsort((rest, squared))
            half = (len(rest) + 1) // 2
            for side in (order[:half], order[half:]):
                if len(side):
                    reach = np.sqrt(squared[side].astype(np.float64))
                    waiting.append((sorted(rest[i] for i in side), (node, reach.min(), reach.max())))

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of each vector's nearest centroid, and the distances measured."""
        step = max(1, FRONTIER // len(self.buckets))
        found = [self._search(vectors[at : at + step]) for at in range(0, len(vectors), step)]
        if not found:
            return np.zeros(0, np.int32), np.zeros(0, np.int64), 0
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), sum(f[2] for f in found)

    def _search(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        n, measured = len(vectors), 0
        best, number, reach = np.full(n, FAR), np.full(n, -1, np.int32), np.full(n, np.inf)
        bound = np.full((n, len(self.buckets)), np.inf)  # each vector's queue of seen, unopened nodes
        bound[:, 0] = 0.0
        open_ = np.arange(n)
        while len(open_):
            node = bound[open_].argmin(1)
            near = bound[open_, node] <= reach[open_]  # inclusive
            open_, node = open_[near], node[near]
            bound[open_, node] = np.inf
            for v in np.unique(node):
                rows = open_[node == v]
                own = vectors[rows]
                for c in self.buckets[v]:
                    away = own - self.centroids[c]
                    squared = np.einsum("ij,ij->i", away, away)
                    measured += len(rows)
                    better = (squared < best[rows]) | ((squared == best[rows]) & (c < number[rows]))
                    at = rows[better]
                    best[at], number[at] = squared[better], c
                    reach[at] = np.sqrt(squared[better].astype(np.float64))
                if self.children[v]:  # an inner node: ``squared`` is the distance from its vantage centroid
                    distance = np.sqrt(squared.astype(np.float64))
                    for child, low, high in self.children[v]:
                        slack = 1e-13 * (distance + high)  # above any rounding: never prunes a tie
                        bound[rows, child] = np.maximum(0.0, np.maximum(distance - high, low - distance) - slack)
        return number, best, measured


def largest_component(dim: int) -> int:
    """Up to here the squared distance of two vectors of ``dim`` integers fits a long."""
    return math.isqrt(int(FAR) // dim) // 2


def integer_vectors(vectors: DataFrame, dim: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, _q``: the vectors of ``dim`` finite components, each floor(scale * x)."""
    v: Column = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(v, lambda x: F.floor(scale * x.cast("double")))
    kept = vectors.filter(v.isNotNull() & (F.size(v) == dim) & finite).select(F.col(id_col).alias("vec_id"), scaled.alias("_q"))
    largest = largest_component(dim)
    beyond = F.exists("_q", lambda q: F.abs(q) > largest)
    message = f"a component beyond {largest} after scaling: its squared distances would not fit a long"
    return kept.withColumn("_q", F.when(beyond, F.raise_error(F.lit(message)).cast("array<int>")).otherwise(F.col("_q").cast("array<int>")))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def cluster_vectors(
    vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3,
    id_col: str = "vec_id", vector_col: str = "embedding", leaf_size: int = 2,
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid`` for every kept vector.

    Kept are vectors of exactly ``dim`` components, none null, NaN or infinite; a component x
    becomes floor(``scale`` * x), which must lie within ``largest_component(dim)`` (else an error, as
    distances would not fit a long; 189 million for 64 components). Centroids start as the ``k`` kept rows with the smallest SHA-256 of
    ``seed:vec_id``, in that order (repeated ids: by their components; null ids after all
    others). A round assigns every vector to its nearest centroid (ties: the smaller number) and
    replaces every centroid that has vectors by the floor of their mean, component by component;
    a last assignment follows. Fewer rows than ``k`` give as many centroids; an empty table no
    row. Rows that repeat stay and count as often as they stand; other columns are ignored.
    The tree of ``k`` centroids is broadcast each round: ``k * dim`` numbers, whatever the input.
    """
    spark = vectors.sparkSession
    table = cut_lineage(integer_vectors(vectors, dim, scale, id_col, vector_col))
    seeds = table.orderBy(F.col("vec_id").isNull(), F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256), "_q").limit(k)
    centroids = np.array([row._q for row in seeds.select("_q").collect()], np.int64).reshape(-1, dim)

    for _ in range(rounds if len(centroids) else 0):
        tree = spark.sparkContext.broadcast(VantageTree(centroids, leaf_size))
        centroids = _moved(table, tree, centroids)
        tree.unpersist()

    tree = spark.sparkContext.broadcast(VantageTree(centroids, leaf_size)) if len(centroids) else None

    def assign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                number, squared, _ = tree.value.nearest(_matrix(part.column(1), dim))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(number), pa.array(squared)], ["vec_id", "cluster", "distance"])

    kind = table.schema["vec_id"].dataType.simpleString()
    assigned = cut_lineage(table.mapInArrow(assign, f"vec_id {kind}, cluster int, distance bigint"))
    whole = F.sum(F.col("distance").cast("decimal(38,0)"))
    inertia = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(whole.alias("s")).collect()}  # k rows
    rows = [(c, s, sum(inertia.values()), centroids[c].tolist()) for c, s in inertia.items()]
    totals = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    return assigned.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")  # k rows


def _moved(table: DataFrame, tree, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round. Tasks return at most k rows of sums."""
    k, dim = centroids.shape

    def sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for part in parts:
            if part.num_rows:
                own = _matrix(part.column(1), dim)
                number, _, _ = tree.value.nearest(own)
                order = np.argsort(number, kind="stable")
                met, first = np.unique(number[order], return_index=True)
                total[met] += np.add.reduceat(own[order], first)
                count[met] += np.bincount(number, minlength=k)[met]
        met = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(count[met]), pa.array(total[met].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    partial = table.mapInArrow(sums, "cluster int, n bigint, total array<bigint>").select("cluster", "n", F.posexplode("total").alias("at", "value"))
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    moved = centroids.copy()
    for row in partial.groupBy("cluster", "at").agg(exact("n").alias("n"), exact("value").alias("value")).collect():  # k * dim rows
        moved[row.cluster, row.at] = int(row.value) // int(row.n)
    return moved


def centroid_digest(centroid: list[int]) -> str:
    """Lowercase hex SHA-256 of the components as decimal integers joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
