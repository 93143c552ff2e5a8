"""Centroid clustering with Hamerly's bounds, exact in integers.

Every vector keeps, between rounds, its cluster, one upper bound of the distance to that cluster's centroid and one lower bound of the
distance to the second nearest. When centroids move, the upper bound grows by the drift of its own centroid and the lower one shrinks by
the largest drift of any other. A vector whose upper bound is below its lower bound, or below half the distance from its centroid to the
nearest other one, can't change its cluster. For the others the upper bound is first made tight by one exact product; those that are
still ambiguous, ties included, get a scan of all centroids in integers. Bounds are doubles, widened by more than their rounding.

A round is a written table (lineage is cut, executors may be lost) and a job of sums: a task adds up its vectors for each cluster
before the shuffle, so a cluster with most of the rows is no task's. Only the centroids, k of them, reach the driver.

Defined cases: a vector that is null, hasn't exactly width components or has a null or non-finite one isn't kept. Repeated rows are
vectors of their own; rows without vec_id are clustered but start no centroid. Ties go to the smaller cluster. With fewer vectors
than k there are as many centroids; an empty table gives no rows. Components are clipped as vectors.MAX_COMPONENT says, and sums
of distances end at the largest long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netframe.llm.common import materialize
from netframe.llm.vectors import SCALE, integer_vectors, matrix, products
from netframe.operators.components import Rounds

WIDTH, CLUSTERS, ROUNDS, SEED = 64, 40, 5, 2
#: Bounds are widened by this part of themselves: many times what a few dozen roundings of doubles can add.
SLACK = 2.0**-40
_MAX_LONG = (1 << 63) - 1
_STATE = "vec_id long, q array<int>, cluster int, upper double, lower double"


def first_centroids(vectors: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The k vectors with the smallest sha256 of `seed:vec_id`."""
    ordered = vectors.where("vec_id IS NOT NULL").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "q")
    return np.array([r.q for r in ordered.orderBy("h", "q").limit(k).collect()], np.int64)


class Moved:
    """Centroids, and how far they have moved since the round before."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None = None):
        self.now, k = now, len(now)
        step = np.zeros(k) if before is None else np.sqrt(((now - before).astype(np.float64) ** 2).sum(1)) * (1 + SLACK)
        self.drift = step
        self.other = np.array([max((step[j] for j in range(k) if j != c), default=0.0) for c in range(k)])
        apart = np.array([[np.inf if i == j else np.sqrt(((now[i] - now[j]).astype(np.float64) ** 2).sum()) for j in range(k)] for i in range(k)])
        self.half = apart.min(axis=1, initial=np.inf) / 2 * (1 - SLACK)
        self.squares = (now * now).sum(1)

    def own_distance(self, x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        """Squared distance to the own centroid, exact."""
        apart = x - self.now[cluster]
        return np.einsum("ij,ij->i", apart, apart)

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Cluster and bounds after the move, and how many vectors had to be scanned."""
        upper, lower, cluster = upper + self.drift[cluster], lower - self.other[cluster], cluster.copy()
        least = np.maximum(lower, self.half[cluster])
        unsure = np.flatnonzero(~(upper < least))
        upper[unsure] = np.sqrt(self.own_distance(x[unsure], cluster[unsure]).astype(np.float64)) * (1 + SLACK)
        unsure = unsure[~(upper[unsure] < least[unsure])]
        if len(unsure):
            own = x[unsure]
            apart = (own * own).sum(1)[:, None] + self.squares - 2 * products(own, self.now)
            best = apart.argmin(1)  # the first of equals: the smaller number
            rows = np.arange(len(own))
            cluster[unsure], upper[unsure] = best, np.sqrt(apart[rows, best].astype(np.float64)) * (1 + SLACK)
            apart[rows, best] = _MAX_LONG
            lower[unsure] = np.inf if len(self.now) == 1 else np.sqrt(apart.min(1).astype(np.float64)) * (1 - SLACK)
        return cluster, upper, lower, len(unsure)


def _columns(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    cluster, upper, lower = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "upper", "lower"))
    return matrix(batch.column("q"), width), cluster.astype(np.int64), upper, lower


def _reassigned(state: DataFrame, moved: Moved, width: int) -> DataFrame:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, upper, lower, _ = moved.assign(*_columns(batch, width))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("q"), pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower)], ["vec_id", "q", "cluster", "upper", "lower"])

    return state.mapInArrow(step, _STATE)


def _finished(state: DataFrame, moved: Moved, width: int) -> DataFrame:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, *bounds = _columns(batch, width)
            cluster = moved.assign(x, *bounds)[0]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(moved.own_distance(x, cluster), pa.int64())], ["vec_id", "cluster", "distance"])

    return state.mapInArrow(step, "vec_id long, cluster int, distance long")


def _means(state: DataFrame, now: np.ndarray) -> np.ndarray:
    """Each centroid's vectors' exact floor(sum / count) in each component; a centroid without vectors stays."""
    k, width = now.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            cluster = batch.column("cluster").to_numpy(zero_copy_only=False)
            np.add.at(sums, cluster, matrix(batch.column("q"), width))
            counts += np.bincount(cluster, minlength=k)
        c, i = np.divmod(np.arange(k * width), width)
        seen = np.repeat(counts, width) > 0
        yield pa.RecordBatch.from_arrays([pa.array(c[seen], pa.int32()), pa.array(i[seen], pa.int32()), pa.array(sums.ravel()[seen]), pa.array(np.repeat(counts, width)[seen])], ["c", "i", "s", "n"])

    found = state.select("cluster", "q").mapInArrow(add, "c int, i int, s long, n long").groupBy("c", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    means = now.copy()
    for r in found.collect():  # k * width rows
        means[r.c, r.i] = r.s // r.n
    return means


def centroid_text(centroid: np.ndarray) -> str:
    return ",".join(str(int(x)) for x in centroid)


def cluster_vectors(
    rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", width: int = WIDTH, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each kept row; distance is squared and whole."""
    spark = rows.sparkSession
    sized = rows.where((F.size(vec_col) == width) & F.col(vec_col).isNotNull())
    vectors = integer_vectors(sized, id_col, vec_col, scale=scale)
    loop = Rounds(spark, "clusters")
    state = loop.write(vectors.select("vec_id", "q", F.lit(0).alias("cluster"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower")))
    now = first_centroids(state, k, seed)
    if not len(now):
        return state.where("false").selectExpr("vec_id", "cluster", *(f"CAST(NULL AS BIGINT) AS {c}" for c in ("distance", "cluster_inertia", "inertia")), "CAST(NULL AS STRING) AS centroid_sha256")
    moved = Moved(now)
    for _ in range(rounds):
        state = loop.write(_reassigned(state, moved, width))
        now = _means(state, moved.now)
        moved = Moved(now, moved.now)
    made = materialize(_finished(state, moved, width), "clustered")
    loop.drop()
    sums = {r.cluster: int(r.s) for r in made.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row for each of k clusters
    total = min(sum(sums.values()), _MAX_LONG)
    table = [(c, min(s, _MAX_LONG), total, hashlib.sha256(centroid_text(moved.now[c]).encode()).hexdigest()) for c, s in sums.items()]
    about = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return made.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
