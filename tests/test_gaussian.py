"""Moments, Gaussian models and embedding quality against NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spectraloom.operators import gaussian as G
from spectraloom.operators import moments as M
from spectraloom.operators import quality as Q


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 6)) @ rng.normal(size=(6, 6)) + 1
    label = np.r_[np.zeros(140), rng.integers(1, 4, 259), [9]].astype(int)  # type 9 has one member
    pdf = pd.DataFrame({"sample_id": np.arange(400), "label": label, "embedding": [v.tolist() for v in x]})
    return x, label, spark.createDataFrame(pdf).repartition(7).persist()


def test_scatter_and_covariance(rows):
    x, label, df = rows
    got = M.scatter(df).first()
    np.testing.assert_allclose(M.covariance_of(got["n"], np.array(got["s"]), np.array(got["xx"])), np.cov(x.T), atol=1e-12)
    for row in M.scatter(df, by=["label"]).where("n > 1").collect():
        np.testing.assert_allclose(
            M.covariance_of(row["n"], np.array(row["s"]), np.array(row["xx"])), np.cov(x[label == row["label"]].T), atol=1e-10
        )


def test_flush_keeps_all_groups(rows, monkeypatch):
    x, label, df = rows
    monkeypatch.setattr(M, "FLUSH_BYTES", 100)
    assert {r["label"]: r["n"] for r in M.scatter(df, by=["label"]).collect()} == dict(zip(*np.unique(label, return_counts=True)))


def test_mahalanobis_matches_numpy_and_trace_identity(rows):
    x, _, df = rows
    model = G.fit_gaussian(df, l2=False)
    got = G.mahalanobis(df, model, l2=False).orderBy("sample_id").toPandas().dist
    diff = x - x.mean(0)
    inv = np.linalg.inv(np.cov(x.T) + 1e-3 * np.eye(6))
    np.testing.assert_allclose(got, np.sqrt(np.einsum("ij,jk,ik->i", diff, inv, diff)), rtol=1e-9)
    # without regularisation the squared distances sum to D (n - 1)
    plain = G.mahalanobis(df, G.fit_gaussian(df, l2=False, reg=0.0), l2=False)
    assert plain.agg(F.sum(F.col("dist") ** 2)).first()[0] == pytest.approx(6 * 399)


def test_normalized_distance_and_null_vectors(rows, spark):
    x, _, df = rows
    with_null = df.unionByName(spark.createDataFrame([(999, 0, None)], df.schema))
    u = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)
    diff = u - u.mean(0)
    inv = np.linalg.inv(np.cov(u.T) + 1e-3 * np.eye(6))
    got = {r["sample_id"]: r["dist"] for r in G.mahalanobis(with_null, G.fit_gaussian(with_null)).collect()}
    assert got[999] is None
    np.testing.assert_allclose([got[i] for i in range(400)], np.sqrt(np.einsum("ij,jk,ik->i", diff, inv, diff)), rtol=1e-9)


def test_singular_covariance(spark):
    x = np.random.default_rng(0).normal(size=(50, 2)) @ np.array([[1.0, 2.0, 3.0], [0.0, 1.0, 1.0]])
    df = spark.createDataFrame(pd.DataFrame({"embedding": [v.tolist() for v in x]}))
    got = sorted(r["dist"] for r in G.mahalanobis(df, G.fit_gaussian(df, l2=False, reg=0.0), l2=False).collect())
    diff = x - x.mean(0)
    want = np.sqrt(np.einsum("ij,jk,ik->i", diff, np.linalg.pinv(np.cov(x.T)), diff))
    if np.isfinite(got).all() and max(got) < 100:
        np.testing.assert_allclose(got, sorted(want), rtol=1e-5)


def test_nearest_type_with_small_group_fallback(rows, monkeypatch):
    x, label, df = rows
    models = G.fit_gaussian(df, by=["label"], l2=False)
    monkeypatch.setattr(G, "MODEL_CHUNK_BYTES", 700)  # two models per chunk
    got = G.mahalanobis_nearest(df, models, "label", l2=False).orderBy("sample_id").toPandas()
    best, kind = np.full(400, np.inf), np.zeros(400, int)
    for k in np.unique(label):
        part = x if (label == k).sum() < 2 else x[label == k]
        inv = np.linalg.inv(np.cov(part.T) + 1e-3 * np.eye(6))
        d = np.sqrt(np.einsum("ij,jk,ik->i", x - part.mean(0), inv, x - part.mean(0)))
        kind[d < best] = k
        best = np.minimum(best, d)
    np.testing.assert_allclose(got.dist, best, rtol=1e-9)
    assert (got.nearest_type == kind).all()


def test_model_round_trip(rows, spark, tmp_path):
    _, _, df = rows
    model = G.fit_gaussian(df)
    G.save_model(model, str(tmp_path / "m"))
    a, b = model.first(), G.load_model(spark, str(tmp_path / "m")).first()
    assert a["n"] == b["n"]
    np.testing.assert_allclose(a["centroid"], b["centroid"], rtol=1e-12)
    np.testing.assert_allclose(a["whitener"], b["whitener"], rtol=1e-9)


def test_effective_rank_and_gaussianity(rows, spark):
    x, _, df = rows
    sv = np.linalg.svd(x, compute_uv=False)
    assert Q.effective_rank(df).first()["effective_rank"] == (sv > 0.01 * sv[0]).sum()
    low = spark.createDataFrame(pd.DataFrame({"embedding": [[a, 2 * a, 0.0] for a in range(1, 30)]}).astype({"embedding": object}))
    assert Q.effective_rank(low.select(F.col("embedding").cast("array<double>"))).first()["effective_rank"] == 1
    dirs = Q.projections(6, 5, 1)
    p = x @ dirs
    t = np.linspace(-3, 3, 8)
    phi = np.exp(1j * p[:, :, None] * t).mean(axis=0)
    want = (np.abs(phi - np.exp(-t**2 / 2)) ** 2).mean()
    assert Q.gaussianity(df, dirs).first()["statistic"] == pytest.approx(want)
    want = ((p.var(axis=0) - 1) ** 2).mean()
    assert Q.gaussianity(df, dirs, mode="variance").first()["statistic"] == pytest.approx(want)


def test_silhouette_with_a_lone_member(rows):
    x, label, df = rows
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T
    s = []
    for i in range(400):
        own = (label == label[i]) & (np.arange(400) != i)
        if not own.any():
            s.append(0.0)
            continue
        a = d[i, own].mean()
        b = min(d[i, label == k].mean() for k in np.unique(label) if k != label[i])
        s.append((b - a) / max(a, b))
    for chunk in (64 << 20, 100):  # all class sums at once, or two per chunk
        assert Q.silhouette(df, "label", chunk_bytes=chunk).first()["silhouette"] == pytest.approx(np.mean(s))


def test_contrastive_statistic(rows):
    x, label, df = rows
    one = Q.supcon_stat(df, "label", "sample_id", block=1000).first()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.clip(u @ u.T / 0.07, -10, 10)
    off = ~np.eye(400, dtype=bool)
    same = (label[:, None] == label[None]) & off
    has = same.any(1)
    want = np.log((np.exp(sims) * off).sum(1))[has] - np.log((np.exp(sims) * same).sum(1)[has])
    assert one["statistic"] == pytest.approx(want.mean()) and one["n"] == has.sum()
    # one class only: numerator equals denominator, nothing to learn from
    assert Q.supcon_stat(df.withColumn("label", F.lit(0)), "label", "sample_id").first()["statistic"] == pytest.approx(0.0)


def test_recovery_bound(rows, spark):
    x, _, _ = rows
    rng = np.random.default_rng(3)
    y = x + rng.normal(size=x.shape)
    pairs = spark.createDataFrame(pd.DataFrame({"a": [v.tolist() for v in x], "b": [v.tolist() for v in y]}))
    got = Q.recovery_bound(pairs, 0.7).first()
    delta = max(0.0, ((x - y) ** 2).mean() * 6 - 2 * 0.3 * 6)
    eps = np.linalg.norm(np.cov(x.T) - np.eye(6))
    d = delta / (2 * 0.7 * 0.3)
    assert got["bound"] == pytest.approx(d + (eps + d) ** 2)
