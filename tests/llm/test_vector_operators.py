import numpy as np
import pytest

from pyspark.sql import functions as F
from spectraloom.llm import centroid_clustering, hard_negatives, queries
from spectraloom.llm.hyperplane_tree import Tree, distances
from tests.compare import differences, duck, duck_rows, sf_dir, spark_rows
from tests.llm import vectors as V


def moved():
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("k, rounds", [(7, 5), (40, 2), (300, 1)])
def test_clusters_against_plain_rounds(spark, k, rounds):
    got = centroid_clustering.cluster(V.table(spark, V.rows()), k=k, rounds=rounds, salt=2)
    assert plain(got) == sorted(V.plain_clusters(V.rows(), k, rounds, 2), key=repr)


def test_filter_leaves_out_most_and_changes_nothing():
    rng = np.random.default_rng(1)
    axes = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    x = np.rint((rng.normal(size=(3000, 64)) * np.geomspace(400, 2, 64)) @ axes.T).astype(np.int32)
    centroids = x[:40].astype(np.int64)
    mean = x.mean(axis=0)
    rotation = np.linalg.eigh(np.cov(x.T))[1][:, ::-1]
    front, rest = centroid_clustering._rotated(x.astype(float), mean, rotation, 16)
    cluster, distance, measured = centroid_clustering.Nearest(centroids, mean, rotation).of(x, front, rest)
    d = np.square(x[:, None].astype(np.int64) - centroids).sum(axis=2)
    assert (cluster == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()
    assert measured < 0.2 * d.size


def test_clusters_of_nothing(spark):
    assert plain(centroid_clustering.cluster(V.table(spark, []))) == []
    assert plain(centroid_clustering.cluster(V.table(spark, [(1, None, 1), (2, [1.0], 1)]))) == []


@pytest.mark.parametrize("small", [False, True])
def test_negatives_against_all_pairs(spark, monkeypatch, small):
    if small:  # many cells and blocks
        monkeypatch.setattr(hard_negatives, "CELL_ROWS", 12)
        monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 9)
    got = hard_negatives.mine(V.table(spark, V.rows()), moved(), F.col("vec_id") % 10 == 0, 5, 5, 80)
    assert plain(got) == sorted(V.plain_negatives(V.rows(), 10, 5, 5, 80), key=repr)


def test_negatives_of_nothing(spark):
    assert plain(hard_negatives.mine(V.table(spark, []), moved(), F.col("vec_id") % 10 == 0)) == []
    alone = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [-1.0, 0.0], 2)]
    assert plain(hard_negatives.mine(V.table(spark, alone), F.col("label"), F.col("vec_id") == 0)) == []


@pytest.mark.parametrize("depth", [0, 1, 20])
def test_ranges_exclude_only_what_lies_outside(depth):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(500, 8)) + 9 * rng.normal(size=8) for _ in range(6)] + [np.ones((90, 8))])
    tree = Tree(x, 32, depth)
    cell = tree.route(x, note=True)
    q, near, far = x[::50] + 0.1, 1.0, 4.0
    seen = {(c, i) for c, rows in tree.search(q, np.full((len(q), 1), near), lambda rows: np.full((len(rows), 1), far), np.full(len(q), 1e-6)) for i in rows}
    d = distances(q, x)
    inside = np.argwhere((d >= near) & (d <= far))
    assert {(cell[j], i) for i, j in inside} <= seen
    if depth == 20:
        assert len(seen) < 0.5 * tree.cells * len(q)


@pytest.mark.parametrize("name", ["op12_rotated_clusters", "op13_tree_negatives"])
def test_against_sql(spark, name):
    got = spark_rows(queries.QUERIES[name](spark, sf_dir("0.001")))
    assert not differences(got, duck_rows(duck(sf_dir("0.001")), queries.ORACLES[name]))
