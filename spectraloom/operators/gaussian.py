"""Gaussian models of embedding populations and distances to them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectraloom.functions.rows import attach_row
from spectraloom.functions.arrow import normalize_rows, spread, to_matrix
from spectraloom.operators.moments import covariance_of, merge_sums, scatter
from spectraloom.operators.prefix import exact_percentiles
from spectraloom.session import materialize

PERCENTILES = (0.50, 0.75, 0.90, 0.95, 0.99)
MODEL_CHUNK_BYTES = 128 << 20

_MODEL_FIELDS = [
    T.StructField("n", T.LongType()),
    T.StructField("centroid", T.ArrayType(T.DoubleType())),
    T.StructField("whitener", T.ArrayType(T.DoubleType())),
]


@dataclass(frozen=True)
class GaussianModel:
    key: object
    n: int
    centroid: np.ndarray
    whitener: np.ndarray


def whitener_of(cov: np.ndarray, reg: float) -> np.ndarray:
    """Matrix L with (x-mu) cov^-1 (x-mu) = |(x-mu) L|^2; eigenvalue form when cov is singular."""
    m = cov + reg * np.eye(len(cov))
    try:
        return np.linalg.inv(np.linalg.cholesky(m)).T
    except np.linalg.LinAlgError:
        vals, vecs = np.linalg.eigh(m)
        keep = vals > vals.max() * len(vals) * np.finfo(float).eps
        return vecs[:, keep] @ np.diag(vals[keep] ** -0.5) @ np.eye(keep.sum(), len(cov))


def fit_gaussian(
    df: DataFrame,
    col: str = "embedding",
    by: list[str] | None = None,
    reg: float = 1e-3,
    l2: bool = True,
    ddof: int = 1,
    min_members: int = 2,
) -> DataFrame:
    """One model row per group (or one row). Small groups take the pooled model of all rows."""
    by = by or []
    sums = scatter(df, col, by, l2)
    if by:
        sums = materialize(sums, "group-sums")
        pooled = merge_sums(sums, [], ["s", "xx"], ["n"]).select(
            F.col("n").alias("_gn"), F.col("s").alias("_gs"), F.col("xx").alias("_gxx")
        )
        small = F.col("n") < min_members
        sums = attach_row(sums, pooled).select(
            *by,
            F.col("n"),
            F.when(small, F.col("_gn")).otherwise(F.col("n")).alias("fit_n"),
            F.when(small, F.col("_gs")).otherwise(F.col("s")).alias("s"),
            F.when(small, F.col("_gxx")).otherwise(F.col("xx")).alias("xx"),
        )
    else:
        sums = sums.where("n > 0").withColumn("fit_n", F.col("n"))
    return _models(sums, by, reg, ddof)


def fit_without_each(df: DataFrame, family: str, col: str = "embedding", reg: float = 1e-3, l2: bool = True, ddof: int = 1) -> DataFrame:
    """One model per family, fitted on everything but it: total sums minus the family's own."""
    sums = materialize(scatter(df, col, [family], l2), "family-sums")
    total = merge_sums(sums, [], ["s", "xx"], ["n"]).select(
        F.col("n").alias("_gn"), F.col("s").alias("_gs"), F.col("xx").alias("_gxx")
    )
    rest = attach_row(sums, total).select(
        family, (F.col("_gn") - F.col("n")).alias("n"),
        F.zip_with("_gs", "s", lambda a, b: a - b).alias("s"), F.zip_with("_gxx", "xx", lambda a, b: a - b).alias("xx"),
    )
    return _models(rest.where("n > 1").withColumn("fit_n", F.col("n")), [family], reg, ddof)


def _models(sums: DataFrame, by: list[str], reg: float, ddof: int) -> DataFrame:
    """Invert each group's covariance in its own task."""
    schema = T.StructType([sums.schema[k] for k in by] + _MODEL_FIELDS)

    def invert(frames):
        for pdf in frames:
            rows = []
            for row in pdf.itertuples(index=False):
                n, s, xx = int(row.fit_n), np.asarray(row.s), np.asarray(row.xx)
                lower = whitener_of(covariance_of(n, s, xx, ddof), reg)
                rows.append((*[getattr(row, k) for k in by], int(row.n), s / n, lower.ravel()))
            yield pd.DataFrame(rows, columns=by + ["n", "centroid", "whitener"])

    return sums.mapInPandas(invert, schema)


def fit_threshold(scores: DataFrame, col: str = "dist", q: float = 0.99) -> DataFrame:
    """Exact 50/75/90/95/99 percentiles of the distances and the detection threshold at ``q``."""
    pct = exact_percentiles(scores, col, list(PERCENTILES) + [q])
    return pct.select("n", F.slice("pct", 1, 5).alias("pct"), F.element_at("pct", 6).alias("threshold"))


def save_model(models: DataFrame, path: str) -> None:
    models.write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _collect(models: DataFrame, key: str | None) -> list[GaussianModel]:
    out = []
    for row in models.collect():
        mu = np.asarray(row["centroid"])
        out.append(
            GaussianModel(row[key] if key else None, row["n"], mu, np.asarray(row["whitener"]).reshape(len(mu), -1))
        )
    return out


def _distance_udf(model: GaussianModel, l2: bool):
    mu, white = model.centroid, model.whitener

    @F.arrow_udf("double")
    def dist(vectors: pa.Array) -> pa.Array:
        valid, x = to_matrix(vectors)
        if not len(x):
            return pa.nulls(len(valid), pa.float64())
        if l2:
            x = normalize_rows(x)
        d2 = np.square((x - mu) @ white).sum(axis=1)
        return spread(valid, np.sqrt(np.maximum(d2, 0.0)))

    return dist


def mahalanobis(
    df: DataFrame, models: DataFrame, col: str = "embedding", out: str = "dist", l2: bool = True
) -> DataFrame:
    """Distance to the single model in ``models`` (one row of D + D*D doubles, shipped with the UDF)."""
    model = _collect(models.limit(2), None)
    if not model:
        raise ValueError("no model: the fit had no rows")
    if len(model) > 1:
        raise ValueError("more than one model: use mahalanobis_nearest")
    return df.withColumn(out, _distance_udf(model[0], l2)(F.col(col).cast("array<double>")))


def _nearest_udf(chunk: list[GaussianModel], l2: bool):
    mus = np.stack([m.centroid for m in chunk])
    whites = np.stack([m.whitener for m in chunk])

    @F.arrow_udf("struct<dist: double, pos: int>")
    def nearest(vectors: pa.Array) -> pa.Array:
        valid, x = to_matrix(vectors)
        if not len(x):
            return pa.nulls(len(valid), pa.struct([("dist", pa.float64()), ("pos", pa.int32())]))
        if l2:
            x = normalize_rows(x)
        best = np.full(len(x), np.inf)
        pos = np.zeros(len(x), dtype=np.int32)
        for k in range(len(mus)):
            d2 = np.square((x - mus[k]) @ whites[k]).sum(axis=1)
            closer = d2 < best
            best[closer] = d2[closer]
            pos[closer] = k
        fields = [spread(valid, np.sqrt(best)), spread(valid, pos)]
        return pa.StructArray.from_arrays(fields, names=["dist", "pos"])

    return nearest


def mahalanobis_nearest(
    df: DataFrame, models: DataFrame, key: str, col: str = "embedding", l2: bool = True
) -> DataFrame:
    """Smallest distance over all per-type models and the type it belongs to.

    Models travel in chunks of bounded size, ordered by key; every chunk adds one column and the
    smallest (distance, chunk) wins, so any number of types works without pairing rows with types.
    """
    chunks = list(model_chunks(models, key))
    if not chunks:
        raise ValueError("no models")
    vec = F.col(col).cast("array<double>")
    staged = df
    best: list[Column] = []
    for i, chunk in enumerate(chunks):
        staged = staged.withColumn(f"_m{i}", _nearest_udf(chunk, l2)(vec))
        names = F.array(*[F.lit(m.key) for m in chunk])
        best.append(
            F.when(
                F.col(f"_m{i}").isNotNull(),
                F.struct(
                    F.col(f"_m{i}.dist").alias("dist"),
                    F.element_at(names, F.col(f"_m{i}.pos") + 1).alias("type"),
                ),
            )
        )
    pick = F.least(*best) if len(best) > 1 else best[0]
    return staged.withColumn("_best", pick).select(
        *df.columns, F.col("_best.dist").alias("dist"), F.col("_best.type").alias("nearest_type")
    )


def model_chunks(models: DataFrame, key: str):
    """Models in key order, in lists of bounded size, fetched without holding all of them."""
    chunk: list[GaussianModel] = []
    size = 0
    for row in models.orderBy(key).toLocalIterator():
        mu = np.asarray(row["centroid"])
        model = GaussianModel(row[key], row["n"], mu, np.asarray(row["whitener"]).reshape(len(mu), -1))
        need = model.whitener.nbytes + mu.nbytes
        if chunk and size + need > MODEL_CHUNK_BYTES:
            yield chunk
            chunk, size = [], 0
        chunk.append(model)
        size += need
    if chunk:
        yield chunk


def all_distances(df: DataFrame, models: DataFrame, key: str, out_key: str, col: str = "embedding", l2: bool = True) -> DataFrame:
    """Distance of every row to every model, one row per (row, model), without the vectors."""
    kept = [c for c in df.columns if c != col]
    out = None
    for chunk in model_chunks(models, key):
        names = F.array(*[F.lit(m.key) for m in chunk])
        dists = _chunk_distances_udf(chunk, l2)(F.col(col).cast("array<double>"))
        part = df.select(*kept, dists.alias("_d")).select(*kept, F.posexplode("_d").alias("_p", "dist"))
        part = part.withColumn(out_key, F.element_at(names, F.col("_p") + 1)).drop("_p")
        out = part if out is None else out.unionByName(part)
    return out


def _chunk_distances_udf(chunk: list[GaussianModel], l2: bool):
    @F.arrow_udf("array<double>")
    def dists(vectors: pa.Array) -> pa.Array:
        valid, x = to_matrix(vectors)
        if not len(x):
            return pa.nulls(len(valid), pa.list_(pa.float64()))
        if l2:
            x = normalize_rows(x)
        d = np.stack([np.sqrt(np.square((x - m.centroid) @ m.whitener).sum(axis=1)) for m in chunk], axis=1)
        offsets = np.concatenate([[0], np.cumsum(valid * len(chunk))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(d.ravel()))

    return dists
