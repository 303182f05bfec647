"""Exact neighbours against brute force, shipped and through cells and blocks."""

import numpy as np
import pandas as pd
import pytest

from spectraloom.operators import matching as M
from spectraloom.operators import neighbours as N


def frame(spark, x, first=0, **cols):
    pdf = pd.DataFrame({"sample_id": np.arange(first, first + len(x)), "embedding": [v.tolist() for v in x], **cols})
    return spark.createDataFrame(pdf).repartition(4)


@pytest.fixture(scope="module")
def clustered():
    """A third of the base is one tight clump; some exact duplicates."""
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(6, 8)) * 5
    base = np.concatenate([centers[0] + 0.01 * rng.normal(size=(200, 8)), centers[rng.integers(0, 6, 400)] + rng.normal(size=(400, 8))])
    base[10:20] = base[5]
    queries = centers[rng.integers(0, 6, 90)] + rng.normal(size=(90, 8))
    queries[:10] = base[5]
    return queries, base


def brute(q, b, k, metric, banned=None):
    if metric == "cosine":
        q, b = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (q, b))
    d = np.round(np.maximum((q**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * q @ b.T, 0), 12)
    if banned is not None:
        d[banned] = np.inf
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(d, order, 1)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_matches_brute_force(spark, clustered, metric, limit, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", 64)  # hot cells and query cells become several blocks
    q, b = clustered
    hits = N.knn(frame(spark, q, 1000), frame(spark, b), 7, metric=metric, broadcast_bytes=limit).toPandas()
    want = brute(q, b, 7, metric)
    assert len(hits) == want.size
    hits = hits.sort_values(["sample_id", "rank"])
    got = hits.dist.to_numpy().reshape(want.shape)
    np.testing.assert_allclose(got, want / 2 if metric == "cosine" else np.sqrt(want), atol=1e-6)
    assert not hits.duplicated(["sample_id", "neighbour"]).any()


def test_exclusions_and_self_match(spark, clustered):
    _, b = clustered
    base = frame(spark, b)
    own = N.knn(base, base, 1, metric="euclidean").toPandas()
    assert (own.dist < 1e-5).all()  # a base point finds itself (or its exact copy)
    for limit in (64 << 20, 0):
        other = N.knn(base, base, 3, metric="euclidean", exclude_equal="sample_id", broadcast_bytes=limit).toPandas()
        assert (other.sample_id != other.neighbour).all()
        want = brute(b, b, 3, "euclidean", np.eye(len(b), dtype=bool))
        got = other.sort_values(["sample_id", "rank"]).dist.to_numpy().reshape(want.shape)
        np.testing.assert_allclose(got, np.sqrt(want), atol=1e-5)


def test_fewer_rows_than_k_and_empty_base(spark, clustered):
    q, b = clustered
    assert N.knn(frame(spark, q[:3], 900), frame(spark, b[:2]), 5).count() == 6
    assert N.knn(frame(spark, q[:3], 900), frame(spark, b).limit(0), 5).count() == 0
    few = N.knn(frame(spark, q[:3], 900), frame(spark, b[:2]), 5, broadcast_bytes=0)
    assert few.count() == 6


def test_registry_edges(spark):
    reg = spark.createDataFrame(
        [("a", "t1", [1.0, 0.0]), ("b", "t2", [1.0, 0.0]), ("c", "t3", [0.0, 1.0])], "serial string, drone_type string, fingerprint array<double>"
    )
    pk = spark.createDataFrame(
        [(1, "a", [1.0, 0.0]), (2, "a", [0.0, 1.0]), (3, "zz", [0.0, 1.0]), (4, "zz", [-1.0, -1.0]), (5, "a", [-1.0, -1.0]), (6, "a", None), (7, None, [1.0, 0.1])],
        "packet_id int, serial string, fingerprint array<double>",
    )
    got = {r["packet_id"]: r for r in M.authenticate(pk, reg).collect()}
    assert [got[i]["verdict"] for i in range(1, 8)] == [
        "AUTHENTIC", "SPOOFED", "SPOOFED", "NOT_ENROLLED", "SPOOFED", "UNKNOWN", "SPOOFED",
    ]
    assert got[3]["matched"] == "c" and got[5]["confidence"] == pytest.approx(1 + 2**-0.5)
    # ties go to the first serial, negative best similarities are reported as they are
    ident = {r["packet_id"]: r for r in M.identify(pk, reg, "packet_id", "fingerprint").collect()}
    assert ident[1]["best_serial"] == "a" and ident[4]["similarity"] == pytest.approx(-(2**-0.5))
    # older rule: nothing positive counts as nothing enrolled
    compat = {r["packet_id"]: r["verdict"] for r in M.authenticate(pk, reg, compat=True).collect()}
    assert compat[5] == "NOT_ENROLLED" and compat[1] == "AUTHENTIC"
    empty = {r["packet_id"]: r["verdict"] for r in M.authenticate(pk, reg.limit(0)).collect()}
    assert empty[1] == "NOT_ENROLLED" and empty[6] == "UNKNOWN"
    unknown = M.identify(pk, reg.limit(0), "packet_id", "fingerprint").first()
    assert unknown["verdict"] == "UNKNOWN" and unknown["similarity"] == 0.0
    demo = {r["packet_id"]: r for r in M.authenticate(pk, reg, mode="demo").collect()}
    assert demo[1]["confidence"] == pytest.approx(1.0) and demo[3]["verdict"] == "NOT_ENROLLED"


def test_unit_separation_in_blocks(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5))
    df = frame(spark, x, model=[0] * 40 + [1] * 20, unit=list(range(60)))
    got = {r["model"]: r for r in M.unit_separation(df, "model", "unit", block=7).collect()}
    for m, part in ((0, x[:40]), (1, x[40:])):
        u = part / np.linalg.norm(part, axis=1, keepdims=True)
        sims = (u @ u.T)[np.triu_indices(len(u), 1)]
        assert got[m]["pairs"] == len(sims)
        np.testing.assert_allclose([got[m]["mean"], got[m]["min"], got[m]["max"]], [sims.mean(), sims.min(), sims.max()])


def test_memory_of_a_search_does_not_depend_on_its_sides():
    """Ties, marks and rows without enough neighbours as by a full sort; the peak is that of a tile, not of a matrix of distances."""
    import tracemalloc

    rng = np.random.default_rng(9)
    b = np.round(rng.normal(size=(20_000, 4)), 1)  # many equal distances
    q = b[rng.integers(0, len(b), 700)]
    marks = rng.integers(0, 3, 700), rng.integers(0, 3, len(b))
    tracemalloc.start()
    val, pos = N._topk(q, b, 7, marks)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25e6, peak
    for i in range(0, 700, 50):
        d2 = np.round(np.maximum(np.square(q[i]).sum() + np.square(b).sum(axis=1) - 2.0 * b @ q[i], 0.0), N.TIE_DECIMALS)
        d2[marks[0][i] == marks[1]] = np.inf
        order = np.argsort(d2, kind="stable")[:7]
        assert np.array_equal(pos[i], order) and np.array_equal(val[i], d2[order])
    val, pos = N._topk(q[:3], b[:5], 9, (np.array([1, 0, 0]), np.array([1, 1, 1, 1, 0])))
    assert np.isfinite(val).sum(axis=1).tolist() == [1, 4, 4] and pos[0, 0] == 4
    assert [x.shape for x in N._topk(q[:0], b, 2, None)] == [(0, 2), (0, 2)]
