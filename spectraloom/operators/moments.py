"""First and second moments of vector columns, as partial sums merged in two levels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectraloom.functions.arrow import to_list_array, to_matrix

FLUSH_BYTES = 64 << 20
MERGE_FANOUT = 64


def centroid(df: DataFrame, col: str = "embedding", by: list[str] | str | None = None) -> DataFrame:
    """Mean vector, overall or per group, with its member count. JVM aggregation, map-side combined."""
    by = [by] if isinstance(by, str) else (by or [])
    vec = array_to_vector(F.col(col).cast("array<double>"))
    return (
        df.where(F.col(col).isNotNull())
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("n"), vector_to_array(Summarizer.mean(vec)).alias("centroid"))
    )


def vector_totals(df: DataFrame, col: str, by: list[str]) -> DataFrame:
    vec = array_to_vector(F.col(col).cast("array<double>"))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), vector_to_array(Summarizer.sum(vec)).alias("total")
    )


def merge_sums(partials: DataFrame, by: list[str], vectors: list[str], counts: list[str]) -> DataFrame:
    """Add partial vectors in two levels, so no task receives one row per input partition."""

    def level(df: DataFrame, keys: list[str]) -> DataFrame:
        sums = [
            vector_to_array(Summarizer.sum(array_to_vector(F.col(v)))).alias(v) for v in vectors
        ]
        return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts], *sums)

    salted = partials.withColumn("_salt", F.spark_partition_id() % MERGE_FANOUT)
    return level(level(salted, by + ["_salt"]), by)


def scatter(df: DataFrame, col: str = "embedding", by: list[str] | None = None, l2: bool = False) -> DataFrame:
    """Per group: n, sum of x, sum of x xT (row-major). Each task sends one partial row per group."""
    by = by or []
    source = df.where(F.col(col).isNotNull()).select(*by, F.col(col).cast("array<double>").alias("_x"))
    schema = T.StructType(
        [source.schema[k] for k in by]
        + [
            T.StructField("n", T.LongType()),
            T.StructField("s", T.ArrayType(T.DoubleType())),
            T.StructField("xx", T.ArrayType(T.DoubleType())),
        ]
    )

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[tuple, list] = {}
        size = 0
        key_types = {}

        def flush():
            keys = list(acc)
            cols = [pa.array([k[i] for k in keys], type=key_types[b]) for i, b in enumerate(by)]
            vals = list(acc.values())
            cols += [
                pa.array([v[0] for v in vals], type=pa.int64()),
                to_list_array(np.stack([v[1] for v in vals])),
                to_list_array(np.stack([v[2].ravel() for v in vals])),
            ]
            acc.clear()
            return pa.RecordBatch.from_arrays(cols, names=by + ["n", "s", "xx"])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            _, x = to_matrix(batch.column("_x"))
            if l2:
                x = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)
            for b in by:
                key_types[b] = batch.schema.field(b).type
            rows: dict[tuple, list[int]] = {}
            if by:
                for i, key in enumerate(zip(*[batch.column(b).to_pylist() for b in by])):
                    rows.setdefault(key, []).append(i)
            else:
                rows[()] = slice(None)
            for key, idx in rows.items():
                part = x[idx]
                got = acc.get(key)
                if got is None:
                    acc[key] = [len(part), part.sum(axis=0), part.T @ part]
                    size += 8 * x.shape[1] * (x.shape[1] + 1)
                else:
                    got[0] += len(part)
                    got[1] += part.sum(axis=0)
                    got[2] += part.T @ part
            if size > FLUSH_BYTES:
                yield flush()
                size = 0
        if acc:
            yield flush()

    return merge_sums(source.mapInArrow(partials, schema), by, ["s", "xx"], ["n"])


def covariance_of(n: int, s: np.ndarray, xx: np.ndarray, ddof: int = 1) -> np.ndarray:
    d = len(s)
    return (xx.reshape(d, d) - np.outer(s, s) / n) / max(n - ddof, 1)


def covariance_long(df: DataFrame, col: str = "embedding", by: list[str] | None = None, ddof: int = 1) -> DataFrame:
    """Covariance as rows (group, i, j, cov), i <= j, 1-based."""
    by = by or []
    sums = scatter(df, col, by)
    dim = F.size("s")
    cell = F.explode(
        F.expr("flatten(transform(sequence(1, size(s)), i -> transform(sequence(i, size(s)), j -> struct(i, j))))")
    )
    return (
        sums.withColumn("_c", cell)
        .select(
            *by,
            F.col("_c.i").cast("long").alias("i"),
            F.col("_c.j").cast("long").alias("j"),
            (
                (
                    F.expr("element_at(xx, (_c.i - 1) * size(s) + _c.j)")
                    - F.expr("element_at(s, _c.i) * element_at(s, _c.j)") / F.col("n")
                )
                / (F.col("n") - F.lit(ddof))
            ).alias("cov"),
        )
    )
