"""Silhouettes over pairs of blocks, hashed tables with certificates and the segment table function, against plain NumPy and Python."""

import numpy as np
import pytest

from pyspark.errors import AnalysisException

from spectraloom.functions.sql import register_sql
from spectraloom.operators import neighbours as N
from spectraloom.operators import quality as Q


def vectors(spark, x, label):
    rows = [(i, None if k is None else int(k), None if v is None else [float(a) for a in v]) for i, (v, k) in enumerate(zip(x, label))]
    return spark.createDataFrame(rows, "id long, label int, embedding array<double>").repartition(5)


def plain_silhouettes(x, label):
    d = np.sqrt(np.square(x[:, None] - x[None]).sum(axis=2))
    out = []
    for i, c in enumerate(label):
        others = [d[i, label == o].mean() for o in set(label) - {c}]
        own = (label == c).sum() - 1
        a, b = (d[i, label == c].sum() / own if own else None), (min(others) if others else None)
        out.append(None if b is None else 0.0 if a is None or max(a, b) == 0 else (b - a) / max(a, b))
    return out


@pytest.mark.parametrize("block_rows", [7, 60, 10_000])
def test_euclidean_silhouette(spark, block_rows):
    rng = np.random.default_rng(3)
    x = 1e5 + rng.normal(size=(150, 4))
    label = rng.integers(0, 4, 150)
    x[20:60] = x[20]  # copies, also across classes
    label[149] = 9  # alone in its class
    got = Q.euclidean_silhouette(vectors(spark, [*x, None, x[0]], [*label, 1, None]), "label", "id", block_rows=block_rows).collect()
    assert len(got) == 150
    want = plain_silhouettes(x, label)
    assert all(g["silhouette"] == pytest.approx(want[g["id"]], abs=1e-9) for g in got)


def test_euclidean_silhouette_of_one_class_and_of_nothing(spark):
    one = vectors(spark, np.eye(3), [1, 1, 1])
    assert [g["silhouette"] for g in Q.euclidean_silhouette(one, "label", "id").collect()] == [None] * 3
    assert Q.euclidean_silhouette(one.limit(0), "label", "id").collect() == []


def near_sets(spark, rng, n, copies=40):
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, n)] + 0.35 * rng.normal(size=(n, 16))
    x[:copies] = x[0]
    x[copies] = 0.0
    return x, spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(n, None)], "sample_id long, embedding array<double>").repartition(4)


def plain_neighbours(x, k):
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    d2 = np.round(np.maximum(np.square(u).sum(axis=1)[:, None] + np.square(u).sum(axis=1)[None] - 2 * u @ u.T, 0), 12)
    np.fill_diagonal(d2, np.inf)
    return np.argsort(d2, axis=1, kind="stable")[:, :k]


def test_hashed_tables_are_exact_with_the_cells_behind(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", 50)  # buckets of several blocks
    x, df = near_sets(spark, np.random.default_rng(4), 400)
    want = plain_neighbours(x, 4)
    got = N.knn_hashed(df, df, 4, exclude_equal="sample_id", bits=6, tables=3, probes=8).collect()
    assert len(got) == 1600
    assert {(r["sample_id"], r["rank"]): r["neighbour"] for r in got} == {(i, j + 1): want[i, j] for i in range(400) for j in range(4)}
    assert {True, False} == {r["certified"] for r in got}


def test_certified_queries_are_exact_without_them(spark):
    x, df = near_sets(spark, np.random.default_rng(5), 400)
    want = plain_neighbours(x, 4)
    got = N.knn_hashed(df, df, 4, exclude_equal="sample_id", bits=12, tables=4, probes=64, exact_rest=False).collect()
    assert all(r["neighbour"] == want[r["sample_id"], r["rank"] - 1] for r in got if r["certified"])
    hits = sum(r["neighbour"] in want[r["sample_id"]] for r in got)
    assert hits >= 0.9 * want.size
    assert N.knn_hashed(df, df.limit(0), 4).collect() == [] and N.knn_hashed(df.limit(0), df, 4).collect() == []


@pytest.mark.parametrize("length, stride", [(1, 1), (3, 1), (4, 4), (2, 5)])
def test_segments_of_a_table_argument(spark, length, stride):
    register_sql(spark)
    rows = [(k, t, None if t == 2 else 10 * k + t) for k, n in ((1, 13), (2, 3), (3, 1)) for t in range(n)] + [(None, t, t) for t in range(6)]
    df = spark.createDataFrame(rows, "k int, t int, v long").repartition(4)
    sql = "SELECT * FROM series_segments(TABLE(SELECT * FROM {df}) PARTITION BY k ORDER BY (t), 'v', %d, %d, 'k')" % (length, stride)
    out = spark.sql(sql, df=df)
    assert out.schema.simpleString() == "struct<k:int,segment_idx:bigint,start_sample:bigint,values:array<bigint>>"
    want = []
    for k in (1, 2, 3, None):
        series = [v for key, _, v in rows if key == k]
        want += [(k, i, at, series[at : at + length]) for i, at in enumerate(range(0, len(series) - length + 1, stride))]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, out.collect()), key=order) == want
    assert spark.sql(sql, df=df.limit(0)).collect() == []


def test_segments_refuse_what_they_cannot_read(spark):
    register_sql(spark)
    df = spark.createDataFrame([(1, 1, 1)], "k int, t int, v long")
    for args in ("'w', 3, 1", "'v', 0, 1", "'v', 3, 1, 'nothing'"):
        with pytest.raises(AnalysisException):
            spark.sql("SELECT * FROM series_segments(TABLE(SELECT * FROM {df}) PARTITION BY k ORDER BY (t), %s)" % args, df=df).collect()


def test_distance_sums_hold_one_tile_at_a_time():
    """Sums over classes that end inside and at tiles, as over the whole matrix; the peak is that of the rows, not of their pairs."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(2)
    sides = []
    for n in (3000, 5000):
        x, label = rng.normal(size=(n, 4)), np.sort(rng.integers(0, 3, n))
        sides.append((x, label, pa.table({"_id": np.arange(n), "_c": label, "_x": pa.array(list(x))})))
    tracemalloc.start()
    got = Q._block_pair_sums((0, 1), sides[0][2], sides[1][2])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12e6, peak
    d = np.sqrt(np.square(sides[0][0][:, None] - sides[1][0][None]).sum(axis=2))
    want = np.concatenate([np.stack([m[:, c == k].sum(axis=1) for k in range(3)], axis=1).ravel() for m, c in ((d, sides[1][1]), (d.T, sides[0][1]))])
    assert np.allclose(got.column("_s").to_numpy(), want)
