"""Centroid clustering in rounds, the nearest centroid found by Orchard's search.

Vectors become integers (``floor(scale * x)``), so distances, sums and centroids are exact. Before each round the distances
between the centroids are sorted into one neighbour list per centroid. A vector starts at some centroid and reads that
centroid's list, nearest first; at a centroid that is closer (or as close, with a smaller number) it jumps to that
one's list. Each centroid is measured once (marked as visited). By the triangle inequality nothing beyond twice the current distance
is closer, nor as close if it lies strictly beyond, so the search stops there with the exact answer. All vectors of a
batch search together as numpy arrays.

Each round is one Spark job over the written vectors: a task adds its vectors to one sum per centroid, the
sums of the tasks are added up by Spark, and only ``k * dim`` sums reach the driver, which divides them. The centroids
(``k * dim`` integers) go out with the tasks. No vector is shuffled and no lineage is longer than one round.

Defined cases: vectors that are null, of another length, or hold null or non-finite components take no part; a scaled
component beyond 2**25 ends the job with an error, as squared distances must fit 64 bits; null vec_ids are clustered
but no first centroid; repeated rows are vectors of their own (first centroids with an equal hash stand in
the order of their components); fewer kept vectors than ``k`` give fewer centroids; equal centroids: the smaller number
wins, the other stays empty and unchanged; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfage.llm.common import giving_back
from shelfage.session import scratch_path

DIM = 64
SCALE = 64
K = 16
ROUNDS = 3
SEED = 1
LARGEST = 1 << 25      # of a scaled component: 4 * DIM * (2 * LARGEST)**2 stays below 2**63
BATCH = 8192

PARTIAL = "cluster int, vectors long, sums array<bigint>"
ASSIGNED = "vec_id long, cluster int, distance long"


def whole_vectors(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, q): the vectors that take part, as integers."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = vectors.select("vec_id", "embedding").where((F.size("embedding") == dim) & finite)
    too_large = F.raise_error(F.lit(f"a component beyond {LARGEST} / {scale}")).cast("bigint")
    value = lambda x: F.when(F.abs(x.cast("double") * scale) <= LARGEST, F.floor(x.cast("double") * scale)).otherwise(too_large)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", value).alias("q"))


def neighbour_lists(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances between the centroids, and for each the others by distance."""
    diff = centroids[:, None, :] - centroids[None, :, :]
    gap = np.einsum("ijk,ijk->ij", diff, diff)
    order = np.argsort(gap + 0, axis=1, kind="stable")
    k = len(centroids)
    return gap, np.stack([row[row != i] for i, row in enumerate(order)]) if k else np.zeros((0, 0), np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray, gap: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid of each vector (ties: the smaller), its squared distance, and how many distances were computed."""
    n, k = len(x), len(centroids)

    def distance(rows: np.ndarray, c: np.ndarray) -> np.ndarray:
        diff = x[rows] - centroids[c]
        return np.einsum("ij,ij->i", diff, diff)

    best = np.zeros(n, np.int64)
    dist = distance(np.arange(n), best)
    visited = np.zeros((n, k), bool)
    visited[:, 0] = True
    at = np.zeros(n, np.int64)          # place in the list of the current centroid
    live, computed = np.arange(n), n
    while True:
        live = live[at[live] < k - 1]
        here = best[live]
        other = lists[here, at[live]] if k > 1 else here
        within = gap[here, other] <= 4 * dist[live]
        live, other = live[within], other[within]
        if not len(live):
            return best, dist, computed
        at[live] += 1
        new = ~visited[live, other]
        rows, other = live[new], other[new]
        visited[rows, other] = True
        d = distance(rows, other)
        computed += len(rows)
        closer = (d < dist[rows]) | ((d == dist[rows]) & (other < best[rows]))
        rows, other = rows[closer], other[closer]
        best[rows], dist[rows], at[rows] = other, d[closer], 0


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            piece = batch.slice(at, BATCH)
            yield piece.column(0), piece.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _adder(centroids: np.ndarray):
    gap, lists = neighbour_lists(centroids)
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, count = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for _, x in _blocks(batches, dim):
            best, _, _ = nearest(x, centroids, gap, lists)
            order = np.argsort(best, kind="stable")
            some, first = np.unique(best[order], return_index=True)
            sums[some] += np.add.reduceat(x[order], first, axis=0)
            count += np.bincount(best, minlength=k)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array(count[some]), pa.array([sums[c] for c in some], pa.list_(pa.int64()))],
            names=[x.split()[0] for x in PARTIAL.split(", ")])
    return run


def _assigner(centroids: np.ndarray):
    gap, lists = neighbour_lists(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches, centroids.shape[1]):
            best, dist, _ = nearest(x, centroids, gap, lists)
            yield pa.RecordBatch.from_arrays([ids, pa.array(best, pa.int32()), pa.array(dist)], names=[x.split()[0] for x in ASSIGNED.split(", ")])
    return run


def first_centroids(whole: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The vectors with the smallest hashes of their ids (k rows reach the driver)."""
    rows = whole.where("vec_id is not null").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)) \
        .orderBy("h", "q").limit(k).collect()
    return np.array([r.q for r in rows], np.int64)


def fit(whole: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """The centroids after some rounds, from (vec_id, q); an empty array without vectors."""
    centroids = first_centroids(whole, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        part = whole.mapInArrow(giving_back(_adder(centroids)), PARTIAL)
        total = part.select("cluster", "vectors", F.posexplode("sums").alias("place", "s")).groupBy("cluster", "place") \
            .agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("vectors").alias("n"))
        centroids = centroids.copy()
        for r in total.collect():
            centroids[r.cluster, r.place] = int(r.s) // r.n
    return centroids


def cluster(spark: SparkSession, vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED,
            dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """Per vector that takes part: its cluster and squared distance, the sums of the distances, and the digest of its centroid."""
    path = scratch_path(spark, "clustering-vectors")
    whole_vectors(vectors, dim, scale).write.parquet(path)
    whole = spark.read.parquet(path)
    centroids = fit(whole, k, rounds, seed)
    if len(centroids):
        path = scratch_path(spark, "clustering-assigned")
        whole.mapInArrow(giving_back(_assigner(centroids)), ASSIGNED).write.parquet(path)
        assigned = spark.read.parquet(path)
    else:
        assigned = spark.createDataFrame([], ASSIGNED)
    # one row per centroid
    digests = spark.createDataFrame(
        [(i, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for i, row in enumerate(centroids.tolist())],
        "cluster int, centroid_sha256 string")
    spread = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("long").alias("cluster_inertia")) \
        .withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy())).join(digests, "cluster")
    return assigned.join(spread, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
