"""K-means in integers with PCA-rotated filtering.

Every vector is stored once with its integer components, its ``LEAD`` leading coordinates in the rotation of the principal axes (about the
mean of all vectors) and the norm of the rest. The squared distance to a centroid is at least the squared distance of the leading coordinates
plus the squared difference of the two residual norms. The centroid with the least such bound is measured in integers first; others are
measured only where their bound, less the rounding that doubles may cause, does not exceed that distance. The rotation only saves work: no result depends on it.

A round reads the stored rows, keeps one running sum per centroid and task, and adds these up in Spark; ``k`` centroids (and, for the rotation,
one row per component) are all that the driver sees.

Defined results. A vector takes part if it has exactly ``size`` components, none null or not finite. Components beyond +-2**24 steps count as
+-2**24. Start vectors are the least by the hash of their id (null: empty), then by id and components; with fewer vectors than ``k``, all of them.
Ties go to the smaller centroid; a centroid without vectors stays. Repeated rows are rows like any other. Empty table, or none that takes part: empty
result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.llm.common import stored
from spectraloom.llm.integer_vectors import binary_rows, finite_rows, integers, matrix_of

LEAD = 16
ROWS_AT_ONCE = 4_096
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def _quantise(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, flat, _ = finite_rows(batch.column(1), size)
            if len(places):
                ids = batch.column(0).take(pa.array(places))
                yield pa.RecordBatch.from_arrays([ids, binary_rows(integers(flat).reshape(-1, size))], ["vec_id", "q"])

    return run


def _added(parts: DataFrame, size: int) -> dict[int, tuple[int, list]]:
    """Sums of (key, n, v) over equal keys; few keys by construction."""
    sums = [F.sum(F.get("v", F.lit(i))).alias(f"v{i}") for i in range(size)]
    rows = parts.groupBy("key").agg(F.sum("n").alias("n"), *sums).collect()
    return {r["key"]: (r["n"], [r[f"v{i}"] for i in range(size)]) for r in rows}


def _part(keys, counts, sums, kind) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(keys, np.int32)), pa.array(np.asarray(counts, np.int64)), pa.array([list(s) for s in sums], pa.list_(kind))], ["key", "n", "v"]
    )


def _scatter(size: int):
    """Per task: row i of the sum of outer products, and the sum itself as row -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, outer = 0, np.zeros(size), np.zeros((size, size))
        for batch in batches:
            x = matrix_of(batch.column(0), size, np.int32).astype(float)
            n, total, outer = n + len(x), total + x.sum(axis=0), outer + x.T @ x
        if n:
            yield _part(range(-1, size), [n] * (size + 1), np.vstack([total, outer]), pa.float64())

    return run


def principal_axes(rows: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean, and axes (columns) by falling variance, of the stored integer vectors."""
    sums = _added(rows.select("q").mapInArrow(_scatter(size), "key int, n long, v array<double>"), size)
    n, total = sums[-1]
    mean = np.array(total) / n
    spread = np.array([sums[i][1] for i in range(size)]) / n - np.outer(mean, mean)
    return mean, np.linalg.eigh((spread + spread.T) / 2)[1][:, ::-1]


def _rotated(x: np.ndarray, mean: np.ndarray, axes: np.ndarray, lead: int) -> tuple[np.ndarray, np.ndarray]:
    y = (x - mean) @ axes
    return y[:, :lead], np.sqrt(np.square(y[:, lead:]).sum(axis=1))


def _rotate(size: int, mean: np.ndarray, axes: np.ndarray, lead: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                front, rest = _rotated(matrix_of(batch.column(1), size, np.int32).astype(float), mean, axes, lead)
                yield pa.RecordBatch.from_arrays([*batch.columns, binary_rows(front), pa.array(rest)], ["vec_id", "q", "front", "rest"])

    return run


class Nearest:
    """Nearest centroid of integer vectors: filtered by rotated bounds, measured in integers."""

    def __init__(self, centroids: np.ndarray, mean: np.ndarray, axes: np.ndarray, lead: int = LEAD):
        self.centroids = centroids.astype(np.int64)
        self.lead = min(lead, centroids.shape[1])
        self.front, self.rest = _rotated(centroids.astype(float), mean, axes, self.lead)
        self.reach = np.sqrt(np.square(centroids - mean).sum(axis=1))

    def measured(self, q: np.ndarray, rows: np.ndarray, which: np.ndarray) -> np.ndarray:
        return np.square(q[rows] - self.centroids[which]).sum(axis=1)

    def of(self, q: np.ndarray, front: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(centroid, squared distance) per vector, and how many distances were measured."""
        q = q.astype(np.int64)
        lead2 = np.square(front).sum(axis=1)
        bound = lead2[:, None] + np.square(self.front).sum(axis=1) - 2 * front @ self.front.T + np.square(rest[:, None] - self.rest)
        slack = 1e-9 * np.square(np.sqrt(lead2 + rest * rest)[:, None] + self.reach) + 1e-3
        rows, first = np.arange(len(q)), bound.argmin(axis=1)
        best, cluster = self.measured(q, rows, first), first.copy()
        open_ = bound - slack <= best[:, None]
        open_[rows, first] = False
        r, c = np.nonzero(open_)
        d = self.measured(q, r, c)
        # the first of each row's runs by distance, then by number of the centroid
        order = np.lexsort((c, d, r))
        r, c, d = r[order], c[order], d[order]
        head = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, np.int64)
        r, c, d = r[head], c[head], d[head]
        better = (d < best[r]) | ((d == best[r]) & (c < cluster[r]))
        best[r[better]], cluster[r[better]] = d[better], c[better]
        return cluster, best, len(q) + len(order)


def _assigned(batches: Iterator[pa.RecordBatch], nearest: Nearest, size: int):
    """Slices of (batch, integers, cluster, distance)."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            q = matrix_of(part.column(1), size, np.int32)
            cluster, distance, _ = nearest.of(q, matrix_of(part.column(2), nearest.lead, float), part.column(3).to_numpy())
            yield part, q, cluster, distance


def _cluster_sums(nearest: Nearest, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(nearest.centroids)
        n, sums = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for _, q, cluster, _ in _assigned(batches, nearest, size):
            n += np.bincount(cluster, minlength=k)
            order = np.argsort(cluster, kind="stable")
            held, starts = np.unique(cluster[order], return_index=True)
            sums[held] += np.add.reduceat(q[order].astype(np.int64), starts, axis=0)
        some = np.flatnonzero(n)
        if len(some):
            yield _part(some, n[some], sums[some], pa.int64())

    return run


def _final(nearest: Nearest, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, cluster, distance in _assigned(batches, nearest, size):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return run


def kept_vectors(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding", size: int = 64) -> DataFrame:
    """vec_id and integer components (q) of the vectors that take part."""
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(col).cast("array<double>").alias("x"))
    return given.mapInArrow(_quantise(size), "vec_id long, q binary")


def _text_id(salt: int) -> Column:
    return F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, salt: int = 2, id_col: str = "vec_id", col: str = "embedding", size: int = 64, lead: int = LEAD) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    spark = vectors.sparkSession
    plain = stored(kept_vectors(vectors, id_col, col, size), "cluster-integers")
    starts = plain.orderBy(F.sha2(_text_id(salt), 256), "vec_id", "q").limit(k).select("q").collect()
    if not starts:
        return spark.createDataFrame([], RESULT)
    centroids = np.array([np.frombuffer(r["q"], np.int32) for r in starts], np.int64)
    lead = min(lead, size)
    mean, axes = principal_axes(plain, size)
    rows = stored(plain.mapInArrow(_rotate(size, mean, axes, lead), "vec_id long, q binary, front binary, rest double"), "cluster-rotated")
    for _ in range(rounds):
        sums = _added(rows.mapInArrow(_cluster_sums(Nearest(centroids, mean, axes, lead), size), "key int, n long, v array<long>"), size)
        for c, (n, total) in sums.items():
            centroids[c] = [s // n for s in total]
    found = stored(rows.mapInArrow(_final(Nearest(centroids, mean, axes, lead), size), "vec_id long, cluster int, distance long"), "cluster-found")
    inertia = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    largest = (1 << 63) - 1  # sums beyond a long stay at its largest value
    total = min(sum(inertia.values()), largest)
    shas = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame([(c, min(s, largest), total, shas[c]) for c, s in inertia.items()], "c int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), F.col("cluster") == F.col("c")).drop("c")  # at most k rows
