"""Ranking metrics against plain NumPy, with and without range splitting, and their invariants."""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spectraloom.operators import prefix
from spectraloom.operators import ranking as K


def pairwise_auc(y, s):
    p, n = s[y == 1], s[y == 0]
    d = p[:, None] - n[None, :]
    return ((d > 0) + 0.5 * (d == 0)).mean()


@pytest.fixture(params=[1_000_000, 40])
def split(request, monkeypatch):
    """One range, or many small ones (the way a huge table runs)."""
    monkeypatch.setattr(prefix, "ROWS_PER_RANGE", request.param)
    return request.param


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(0)
    n = 3000
    y = (rng.random(n) < 0.3).astype(int)
    s = np.round(rng.normal(y * 0.7, 1.0), 2)
    s[: n // 3] = 0.5  # a third of the rows share one score
    g = rng.integers(0, 3, n)
    pdf = pd.DataFrame({"id": np.arange(n), "y": y, "s": s, "g": g})
    return pdf, spark.createDataFrame(pdf).repartition(5).persist()


def test_auc_equals_pairwise(scored, split):
    pdf, df = scored
    assert K.auc(df, "y", "s").first()["auc"] == pytest.approx(pairwise_auc(pdf.y.values, pdf.s.values), abs=1e-12)
    for row in K.auc(df, "y", "s", by=["g"]).collect():
        part = pdf[pdf.g == row["g"]]
        assert row["auc"] == pytest.approx(pairwise_auc(part.y.values, part.s.values), abs=1e-12)


def test_auc_by_type_shares_negatives(scored, split):
    pdf, df = scored
    neg = pdf[pdf.y == 0].s.values
    for row in K.auc_by_type(df.where("y = 1"), df.where("y = 0"), "s", "g").collect():
        pos = pdf[(pdf.y == 1) & (pdf.g == row["g"])].s.values
        d = pos[:, None] - neg[None, :]
        assert row["auc"] == pytest.approx(((d > 0) + 0.5 * (d == 0)).mean(), abs=1e-12)


def test_roc_points_and_operating_points(scored, split):
    pdf, df = scored
    curve = K.roc_curve(df, "y", "s").orderBy(F.desc("threshold")).toPandas()
    want_tpr = [((pdf.s >= t) & (pdf.y == 1)).sum() / (pdf.y == 1).sum() for t in curve.threshold]
    want_fpr = [((pdf.s >= t) & (pdf.y == 0)).sum() / (pdf.y == 0).sum() for t in curve.threshold]
    np.testing.assert_allclose(curve.tpr, want_tpr)
    np.testing.assert_allclose(curve.fpr, want_fpr)
    got = K.tpr_at_fpr(df, "y", "s", [0.05]).first()
    assert got["tpr"] == pytest.approx(curve[curve.fpr <= 0.05].tpr.max())
    corners = K.roc_curve(df, "y", "s", drop_collinear=True).orderBy(F.desc("threshold")).toPandas()
    assert len(corners) <= len(curve) and corners.tpr.iloc[-1] == 1.0
    # dropping collinear points leaves the area unchanged
    area = lambda c: np.trapezoid(np.r_[0, c.tpr], np.r_[0, c.fpr])
    assert area(corners) == pytest.approx(area(curve))


def test_average_precision(scored, split):
    pdf, df = scored
    ordered = pdf.groupby("s").agg(p=("y", "sum"), n=("y", "size")).sort_index(ascending=False)
    tp, all_ = ordered.p.cumsum(), ordered.n.cumsum()
    want = (ordered.p * tp / all_).sum() / ordered.p.sum()
    assert K.average_precision(df, "y", "s").first()[0] == pytest.approx(want)


def test_percentiles_and_ranks(scored, split):
    pdf, df = scored
    probs = [0.0, 0.05, 0.5, 0.99, 1.0]
    got = prefix.exact_percentiles(df, "s", probs).first()
    np.testing.assert_allclose(got["pct"], np.quantile(pdf.s, probs))
    for row in prefix.exact_percentiles(df, "s", probs, by=["g"]).collect():
        np.testing.assert_allclose(row["pct"], np.quantile(pdf[pdf.g == row["g"]].s, probs))
    ranked = K.pct_rank(df.where("y = 1"), df.where("y = 0"), "s").toPandas()
    neg = pdf[pdf.y == 0].s.values
    np.testing.assert_allclose(ranked.pct_greater, [100 * (neg > v).mean() for v in ranked.s])
    cdf = K.ecdf(df, "s").toPandas()
    np.testing.assert_allclose(cdf.cdf, [(pdf.s <= v).mean() for v in cdf.s])


def test_auc_invariants(scored):
    _, df = scored
    a = K.auc(df, "y", "s").first()["auc"]
    assert K.auc(df.withColumn("s", -F.col("s")), "y", "s").first()["auc"] == pytest.approx(1 - a)
    assert K.auc(df.withColumn("s", F.exp("s") * 3 + 1), "y", "s").first()["auc"] == pytest.approx(a)
    assert K.auc(df.where("y = 1"), "y", "s").first()["auc"] is None


def test_bootstrap(scored, monkeypatch):
    pdf, df = scored
    reps = K.bootstrap_auc(df, "y", "s", replicates=60, seed=3, reps_per_task=20)
    got = K.bootstrap_interval(reps).first()
    point = pairwise_auc(pdf.y.values, pdf.s.values)
    assert got["replicates"] == 60 and abs(got["mean"] - point) < 0.01
    assert got["ci_low"] < point < got["ci_high"]
    # the same draws at another partitioning
    again = K.bootstrap_auc(df.repartition(3), "y", "s", replicates=60, seed=3, reps_per_task=7)
    np.testing.assert_allclose(
        sorted(r["auc"] for r in reps.collect()), sorted(r["auc"] for r in again.collect())
    )
    small = K.bootstrap_interval(K.bootstrap_auc(df.limit(300), "y", "s", 60, 3)).first()
    assert small["std"] > got["std"]


def test_bootstrap_over_many_ranges(scored, monkeypatch):
    pdf, df = scored
    real = K.range_cuts
    monkeypatch.setattr(K, "range_cuts", lambda values, col, rows_per_range=None: real(values, col, 30))
    reps = K.bootstrap_auc(df, "y", "s", replicates=40, seed=3)
    got = K.bootstrap_interval(reps).first()
    assert abs(got["mean"] - pairwise_auc(pdf.y.values, pdf.s.values)) < 0.015


def test_poisson_cuts():
    cuts = K.poisson_cuts()
    share = np.diff([0, *cuts, 2**32]) / 2**32
    np.testing.assert_allclose(share[:4], np.exp(-1) / np.array([1, 1, 2, 6]), rtol=1e-8)
    assert abs((share * np.arange(len(share))).sum() - 1) < 1e-8


def test_poisson_auc_against_plain_weights(spark, monkeypatch):
    """Replicates equal the weighted pairwise AUC, also over many ranges and at another partitioning; nulls take no part."""
    real = K.range_cuts
    monkeypatch.setattr(K, "range_cuts", lambda values, col, rows_per_range=None: real(values, col, 40))
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.random() < 0.4), float(np.round(rng.normal(), 1)), "ab"[i % 2]) for i in range(120)]
    rows += [(500, 1, None, "a"), (501, None, 0.5, "a"), (502, 0, float("nan"), "b"), (None, 1, 0.3, "a"), (None, 0, 0.3, None)]
    df = spark.createDataFrame(rows, "id long, y int, s double, kind string")
    known = [r for r in rows if r[1] is not None and r[2] is not None and r[2] == r[2]]

    def plain(rep, kind=None):
        cuts, pos, neg = K.poisson_cuts(), [], []
        for i, y, s, k in known:
            h = hashlib.md5(f"{'null' if i is None else i}:{rep // 4}:9".encode()).hexdigest()
            w = sum(int(h[8 * (rep % 4) :][:8], 16) >= c for c in cuts)
            if y == 0 or kind in (None, k):
                (pos if y else neg).append((s, w))
        u = sum(a * b * ((x > z) + (x == z) / 2) for x, a in pos for z, b in neg)
        return u / (sum(a for _, a in pos) * sum(b for _, b in neg))

    for part in (1, 6):
        got = {r["replicate"]: r["auc"] for r in K.poisson_auc(df.repartition(part), "y", "s", "id", 10, 9).collect()}
        assert sorted(got) == list(range(10))
        np.testing.assert_allclose([got[i] for i in range(10)], [plain(i) for i in range(10)])
    typed = {(r["replicate"], r["kind"]): r["auc"] for r in K.poisson_auc(df, "y", "s", "id", 10, 9, "kind").collect()}
    assert len(typed) == 20
    for (rep, kind), value in typed.items():
        assert abs(value - plain(rep, kind)) < 1e-12
    assert K.poisson_auc(df.limit(0), "y", "s", "id", 10, 9).collect() == []


def test_poisson_counts_hash_once_for_four_replicates_and_return_cells(monkeypatch):
    """10,000 rows with seven scores and ten replicates: three hashes a row, and a row per score and replicate, not per draw."""
    made, real = [], hashlib.md5
    monkeypatch.setattr(K.hashlib, "md5", lambda text: made.append(text) or real(text))
    batch = pa.RecordBatch.from_pydict({"s": [float(i % 7) for i in range(10_000)], "_id": [str(i).encode() for i in range(10_000)]})
    rows = [r for part in K._drawn(["s"], 10, 9)([batch]) for r in part.to_pylist()]
    assert len(made) == 30_000 and len(set(made)) == 30_000
    assert sorted((r["replicate"], r["s"]) for r in rows) == [(rep, float(s)) for rep in range(10) for s in range(7)]
    assert abs(sum(r["w"] for r in rows) / 100_000 - 1) < 0.02


def test_snr_floor(spark):
    curve = spark.createDataFrame([(0, 25, 0.99), (1, 10, 0.88), (2, 0, 0.80), (3, -5, 0.86)], "ordinal int, snr_db int, auc double")
    got = {r["limit"]: r["floor_db"] for r in K.snr_floor(curve, [0.85, 0.90, 0.5]).collect()}
    assert got == {0.85: 0, 0.90: 10, 0.5: -5}
