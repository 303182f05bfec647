"""Singular values of a tall matrix by a tree of QR factors.

Every task folds its batches into one triangular factor R; factors of up to ``FANOUT`` tasks meet and are factored again, level after level.
The last R has the singular values of the whole matrix, without forming its square, which would lose those below 1e-8 of the largest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.functions.arrow import to_list_array, to_matrix

FANOUT = 32


def _factor(top: np.ndarray | None, x: np.ndarray) -> np.ndarray:
    r = np.linalg.qr(x if top is None else np.vstack([top, x]), mode="r")
    return np.vstack([r, np.zeros((r.shape[1] - len(r), r.shape[1]))])


def triangular_factor(df: DataFrame, col: str = "embedding") -> DataFrame:
    """n and r (row-major) of the whole column; no row without vectors. Null vectors are left out."""
    shape = "n long, r array<double>"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, top = 0, None
        for batch in batches:
            if batch.num_rows:
                x = to_matrix(batch.column(0))[1]
                n, top = n + len(x), _factor(top, x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), to_list_array(top.reshape(1, -1))], names=["n", "r"])

    def meet(table: pa.Table) -> pa.Table:
        flat = to_matrix(table.column("r"))[1]
        d = int(round(flat.shape[1] ** 0.5))
        out = _factor(None, flat.reshape(-1, d))
        return pa.table([pa.array([sum(table.column("n").to_pylist())], pa.int64()), to_list_array(out.reshape(1, -1))], names=["n", "r"])

    source = df.where(F.col(col).isNotNull()).select(F.col(col).cast("array<double>").alias("x"))
    factors = source.mapInArrow(fold, shape).withColumn("part", F.spark_partition_id())
    for step in (FANOUT, FANOUT**2):  # three levels serve FANOUT ** 3 tasks
        grouped = factors.withColumn("part", F.floor(F.col("part") / step)).groupBy("part")
        met = grouped.applyInArrow(lambda key, table: meet(table).append_column("part", pa.array([key[0].as_py()], pa.int64())), f"{shape}, part long")
        factors = met.withColumn("part", F.col("part") * step)
    return factors.groupBy().applyInArrow(meet, shape)


def singular_values(df: DataFrame, col: str = "embedding") -> DataFrame:
    """n, place (from 1, falling) and value of every singular value."""

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, flat in zip(batch.column(0).to_pylist(), to_matrix(batch.column(1))[1] if batch.num_rows else []):
                d = int(round(len(flat) ** 0.5))
                s = np.linalg.svd(flat.reshape(d, d), compute_uv=False)
                yield pa.RecordBatch.from_arrays([pa.array([n] * d, pa.int64()), pa.array(range(1, d + 1), pa.int64()), pa.array(s)], names=["n", "place", "value"])

    return triangular_factor(df, col).mapInArrow(values, "n long, place long, value double")


def effective_rank(df: DataFrame, col: str = "embedding", share: float = 0.01) -> DataFrame:
    """n, effective_rank (singular values above a share of the largest), largest."""
    s = singular_values(df, col)
    top = s.groupBy("n").agg(F.max("value").alias("largest"), F.collect_list("value").alias("v"))  # one value per dimension
    return top.select("n", F.size(F.filter("v", lambda x: x > share * F.col("largest"))).cast("long").alias("effective_rank"), "largest")
