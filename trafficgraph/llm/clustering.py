"""Centroid clustering of integer vectors, filtered by n-simplex projection.

Each vector's distances to a few pivots are computed once and turned into the
apex of a simplex over the pivots (Connor, Vadicamo, Cardillo, Rabitti, "Supermetric
Search", 2019): its first coordinates are the projection on the pivots' span, the
last one the altitude over it. For two apexes the Euclidean distance is a lower
bound of the true one, and with one altitude turned around an upper bound.
A round computes the apexes of its centroids, drops for each vector the
centroids whose lower bound exceeds the smallest upper bound, and compares the
rest exactly in integers; ties go to the smaller number. The bounds leave a
margin well above the rounding error of the coordinates, so they drop no
nearest centroid, and results do not depend on the pivots.

Vectors with their apexes are written once as a table; a round is one pass over
it, and each task hands on one row of sums per centroid. Only centroids (``k`` rows)
reach the driver, so nothing there grows with the data.

Defined cases: vectors that are null, of another length, or hold null or non-finite
components take no part; components saturate at ``LIMIT`` so that squared
distances fit a long; repeated rows are vectors of their own (of equal hashes the
smaller id, then the smaller vector comes first; a null id comes last); fewer than
``k`` vectors make fewer clusters; an empty table gives no rows; an inertia
beyond the long range is null; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficgraph.llm import textscan as ts
from trafficgraph.operators.materialize import drop_table, write_table

CLUSTERS = 16
ROUNDS = 3
SCALE = 64
DIM = 64
SEED = "1"
MAX_PIVOTS = 16
LIMIT = 1 << 27              # squared distances of 64 components stay below 2**62
MIN_ALTITUDE = 1e-6          # share of the largest squared pivot distance a pivot adds at least
MARGIN = 1e-5                # of the squared distances to the first pivot, far above rounding
SLICE = 1 << 20              # bounds computed at once


def usable(vector: str) -> F.Column:
    """Not null, and without null or non-finite components."""
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return x.isNotNull() & ~bad


def scaled(vector: str, scale: int, limit: int) -> F.Column:
    """Components as ``floor(scale * x)``, ``x`` as double, within ``limit``."""
    def whole(x: F.Column) -> F.Column:
        y = F.floor(F.lit(float(scale)) * x.cast("double"))
        return F.least(F.greatest(y, F.lit(-limit)), F.lit(limit)).cast("int")
    return F.transform(F.col(vector), whole)


class Simplex:
    """The base simplex over pivots, and apexes over it, both from squared distances alone."""

    def __init__(self, candidates: np.ndarray, most: int = MAX_PIVOTS) -> None:
        self.pivots = candidates[:1].astype(np.int64)
        self.base = np.zeros((0, 0))         # lower triangular: the pivots after the first
        self.from_first = np.zeros(0)        # their squared distances from the first
        for p in candidates[1:]:
            if len(self.pivots) >= most:
                break
            p = p.astype(np.int64)
            apex = self.apexes(p[None])[0]
            far = float(((p - self.pivots[0]) ** 2).sum())
            # a pivot (almost) in the span of the others adds nothing and spoils the solution
            if apex[-1] ** 2 <= MIN_ALTITUDE * max([far, *self.from_first]):
                continue
            m = len(self.base)
            grown = np.zeros((m + 1, m + 1))
            grown[:m, :m] = self.base
            grown[m] = apex
            self.base = grown
            self.pivots = np.vstack([self.pivots, p])
            self.from_first = np.append(self.from_first, far)

    def apexes(self, x: np.ndarray) -> np.ndarray:
        """One row per vector: its projection on the pivots' span, then its altitude."""
        d = np.stack([((x - p) ** 2).sum(axis=1) for p in self.pivots], axis=1).astype(np.float64)
        g = (d[:, :1] + self.from_first[None, :] - d[:, 1:]) / 2
        y = np.zeros_like(g)
        for i in range(g.shape[1]):          # forward substitution, all vectors at once
            y[:, i] = (g[:, i] - y[:, :i] @ self.base[i, :i]) / self.base[i, i]
        altitude = np.sqrt(np.maximum(d[:, 0] - (y ** 2).sum(axis=1), 0))
        return np.concatenate([y, altitude[:, None]], axis=1)


def nearest(x: np.ndarray, apex: np.ndarray, centroids: np.ndarray,
            centroid_apex: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(cluster, squared distance, centroids compared)`` of each vector."""
    size = (apex ** 2).sum(axis=1)[:, None], (centroid_apex ** 2).sum(axis=1)[None, :]
    lower = size[0] + size[1] - 2 * apex @ centroid_apex.T
    upper = lower + 4 * apex[:, -1:] * centroid_apex[:, -1][None, :]
    margin = MARGIN * (size[0] + size[1].max())
    left = lower <= upper.min(axis=1)[:, None] + margin
    cluster = np.full(len(x), -1, np.int32)
    best = np.full(len(x), np.iinfo(np.int64).max)
    for c in np.flatnonzero(left.any(axis=0)):
        rows = np.flatnonzero(left[:, c])
        d = ((x[rows] - centroids[c]) ** 2).sum(axis=1)
        closer = d < best[rows]              # ties stay with the smaller number
        rows = rows[closer]
        cluster[rows], best[rows] = c, d[closer]
    return cluster, best, left.sum(axis=1).astype(np.int32)


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def _assigned(batch: pa.RecordBatch, dim: int, centroids: np.ndarray, centroid_apex: np.ndarray):
    """Slices of a batch of the table: ``(first row, vectors, cluster, distance, compared)``."""
    x = _matrix(batch.column(1), dim, np.int64)
    apex = _matrix(batch.column(2), centroid_apex.shape[1], np.float64)
    step = max(1, SLICE // len(centroids))
    for lo in range(0, len(x), step):
        part = slice(lo, lo + step)
        yield lo, x[part], *nearest(x[part], apex[part], centroids, centroid_apex)


def initial_vectors(points: DataFrame, k: int, seed: str) -> np.ndarray:
    """The ``k`` vectors with the smallest hashes of ``<seed>:<id>``, in that order."""
    n = points.count()
    hashed = points.withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256))
    # Of many rows only a small share of the hashes can be among the k smallest:
    # no task then sends k vectors of its own. Where the share misses (null ids), all are sorted.
    share = 64 * k / max(n, 1)
    few = hashed.where(F.col("_h") < F.lit(format(int(share * 16 ** 12), "012x"))) if share < 1 else hashed
    order = [F.asc_nulls_last("_h"), F.asc_nulls_last("id"), F.asc("v")]
    rows = few.orderBy(*order).limit(k).select("v").collect()
    if len(rows) < min(k, n):
        rows = hashed.orderBy(*order).limit(k).select("v").collect()
    return np.array([r.v for r in rows], np.int64)


def with_apexes(points: DataFrame, simplex: Simplex, dim: int) -> tuple[DataFrame, str]:
    """``(id, v, apex)`` as a written table: pivot distances are computed here, once."""
    def add(batches):
        for b in batches:
            apex = simplex.apexes(_matrix(b.column(1), dim, np.int64)) if b.num_rows else np.zeros((0, 1))
            width = apex.shape[1]
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(apex) + 1, dtype=np.int32) * width), pa.array(apex.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], ["id", "v", "apex"])

    return write_table(points.select("id", "v").mapInArrow(
        ts.returning(add), "id long, v array<int>, apex array<double>"))


def moved_centroids(table: DataFrame, simplex: Simplex, centroids: np.ndarray) -> np.ndarray:
    """One round: assign, then replace every non-empty centroid by the floor of its mean."""
    k, dim = centroids.shape
    centroid_apex = simplex.apexes(centroids)

    def sums(batches):
        count, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for b in batches:
            for _, x, cluster, _, _ in _assigned(b, dim, centroids, centroid_apex):
                order = np.argsort(cluster, kind="stable")
                held, first = np.unique(cluster[order], return_index=True)
                total[held] += np.add.reduceat(x[order], first, axis=0)
                count += np.bincount(cluster, minlength=k)
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict(
            {"cluster": pa.array(held.astype(np.int32)), "n": pa.array(count[held]),
             "sums": pa.array(list(total[held]), pa.list_(pa.int64()))})

    parts = table.mapInArrow(ts.returning(sums), "cluster int, n long, sums array<bigint>")
    rows = (parts.select("cluster", "n", F.posexplode("sums").alias("i", "s"))
            .groupBy("cluster", "i")
            .agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())
    moved = centroids.copy()
    for r in rows:
        moved[r.cluster, r.i] = int(r.s) // r.n
    return moved


def cluster_vectors(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE,
                    dim: int = DIM, seed: str = SEED, id_col: str = "vec_id",
                    vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """Assignments ``(id, cluster, distance, n_compared)`` and the final centroids.

    ``n_compared`` is the number of centroids that the bounds left to compare.
    """
    spark = vectors.sparkSession
    points = (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("_x"))
              .where(usable("_x") & (F.size("_x") == dim))
              .select("id", scaled("_x", scale, LIMIT).alias("v")))
    centroids = initial_vectors(points, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], "id long, cluster int, distance long, n_compared int"), centroids
    simplex = Simplex(centroids)
    table, path = with_apexes(points, simplex, dim)
    for _ in range(rounds):
        centroids = moved_centroids(table, simplex, centroids)
    centroid_apex = simplex.apexes(centroids)

    def assign(batches):
        for b in batches:
            for lo, x, cluster, distance, compared in _assigned(b, dim, centroids, centroid_apex):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, len(x)), pa.array(cluster), pa.array(distance),
                     pa.array(compared)], ["id", "cluster", "distance", "n_compared"])

    done, _ = write_table(table.mapInArrow(
        ts.returning(assign), "id long, cluster int, distance long, n_compared int"))
    drop_table(spark, path)
    return done, centroids


def with_summary(done: DataFrame, centroids: np.ndarray, id_name: str = "vec_id") -> DataFrame:
    """The assignments with the inertia of the cluster and of all, and the centroid's digest."""
    spark = done.sparkSession
    rows = {r.cluster: int(r.s) for r in done.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    whole = sum(rows.values())
    fits = lambda v: v if v < 1 << 63 else None
    summary = spark.createDataFrame(
        [(c, fits(s), fits(whole),
          hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
         for c, s in sorted(rows.items())],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return (done.join(F.broadcast(summary), "cluster")
            .select(F.col("id").alias(id_name), "cluster", "distance", "cluster_inertia", "inertia",
                    "centroid_sha256"))
