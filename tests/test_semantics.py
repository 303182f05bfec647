"""Named behaviours: the corrected rules, seeded draws that ignore partitioning, and label helpers."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spectraloom.functions import labels as L
from spectraloom.functions import vectors as V
from spectraloom.operators import continual as C
from spectraloom.operators import matching as M
from spectraloom.operators import neighbours as N
from spectraloom.operators import prefix
from spectraloom.operators import quality as Q
from spectraloom.operators import sampling as S
from spectraloom.operators import studies as U


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    n = 300
    label = np.r_[np.zeros(100), rng.integers(1, 5, n - 100)].astype(int)  # one label holds a third
    x = rng.normal(size=(n, 6)) + label[:, None]
    pdf = pd.DataFrame({"sample_id": np.arange(n), "label": label, "rec": np.arange(n) % 17, "embedding": [v.tolist() for v in x]})
    return pdf, spark.createDataFrame(pdf).persist()


SEEDED = {
    "sample_n": lambda df: S.sample_n(df, 40, "sample_id", 1).select("sample_id"),
    "sample_per_group": lambda df: S.sample_per_group(df, "label", "sample_id", 7, 1).select("sample_id"),
    "balanced": lambda df: S.balanced_sample(df, "label", "sample_id", 25, 1).select("sample_id"),
    "halves": lambda df: S.enroll_test_split(df, "label", "sample_id", 1).select("sample_id", "half"),
    "pairs": lambda df: S.positive_pairs(df, "label", "sample_id", 1).select("sample_id", "partner_id"),
    "folds": lambda df: S.kfold(df, "sample_id", 3, 1, "label").select("sample_id", "fold"),
    "resample": lambda df: S.weighted_resample(df, "sample_id", F.lit(1.7), 1).select("sample_id", "copy"),
    "groups": lambda df: S.group_split(df, "rec", 0.7, 1).select("sample_id", "side"),
    "position": lambda df: S.position_of(df, "sample_id").select("sample_id", "position"),
}


@pytest.mark.parametrize("name", sorted(SEEDED))
def test_seeded_draws_ignore_partitioning(rows, name):
    _, df = rows
    one, seven = (sorted(map(tuple, SEEDED[name](df.repartition(k)).collect())) for k in (1, 7))
    assert one == seven and one


def test_sample_is_the_start_of_the_hash_order(rows):
    _, df = rows
    want = sorted(r[0] for r in S.sample_n(df, 40, "sample_id", 1).select("sample_id").collect())
    for size in (5, 10_000):
        ranked = S.hash_rank(df.select("sample_id"), [], "sample_id", 1, "rank", rows_per_range=size)
        got = sorted(r[0] for r in ranked.where("rank <= 40").select("sample_id").collect())
        assert got == want and len(got) == 40


def test_positions_over_ranges(rows, monkeypatch):
    pdf, df = rows
    monkeypatch.setattr(prefix, "ROWS_PER_RANGE", 20)
    got = S.position_of(df.where("sample_id % 3 = 0"), "sample_id").toPandas().sort_values("sample_id")
    assert got.position.tolist() == list(range(1, len(got) + 1))


def test_positive_pairs_stay_in_type_and_never_self(rows):
    pdf, df = rows
    lone = df.unionByName(df.limit(1).withColumn("label", F.lit(77)).withColumn("sample_id", F.lit(9999).cast("long")))
    got = S.positive_pairs(lone, "label", "sample_id", 3).toPandas()
    kind = dict(zip(pdf.sample_id, pdf.label)) | {9999: 77}
    assert len(got) == 301
    assert all(kind[a] == kind[b] for a, b in zip(got.sample_id, got.partner_id))
    same = got[got.sample_id == got.partner_id]
    assert same.sample_id.tolist() == [9999]


def test_weighted_resample_expectation(rows):
    pdf, df = rows
    w = F.when(F.col("label") == 0, 0.5).otherwise(4.0)
    got = S.weighted_resample(df, "sample_id", w, 5).toPandas()
    assert abs((got.label == 0).sum() - 50) < 30 and abs((got.label != 0).sum() - 800) < 120


def test_weighted_resample_at_any_weight(spark):
    df = spark.range(40).selectExpr("id", "element_at(array(1D, 700D, 5000D, 0D, -1D, double('nan'), NULL), int(id % 7) + 1) AS w")
    got = S.weighted_resample(df, "id", "w", 5).groupBy("id").count().toPandas().set_index("id")["count"]
    for k, w in ((1, 700), (2, 5000)):
        each = [got.get(i, 0) for i in range(40) if i % 7 == k]
        assert all(abs(n - w) < 6 * w**0.5 for n in each) and len(set(each)) > 1
    assert not any(i % 7 > 2 for i in got.index)
    with pytest.raises(Exception, match="infinite weight"):
        S.weighted_resample(spark.range(1).selectExpr("id", "double('inf') AS w"), "id", "w", 5).collect()


def test_group_split_has_no_leak(rows):
    _, df = rows
    split = S.group_split(df, "rec", 0.6, 2)
    assert S.leaked_groups(split, "rec").count() == 0
    bad = split.withColumn("side", F.when(F.col("sample_id") == 0, "other").otherwise(F.col("side")))
    assert S.leaked_groups(bad, "rec").count() == 1


def test_split_versions_are_not_overwritten(spark):
    versions = spark.createDataFrame([("a", "train", "v1")], "type string, split string, split_version string")
    new = spark.createDataFrame([("a", "holdout")], "type string, split string")
    with pytest.raises(ValueError):
        S.add_split_version(versions, new, "v1")
    forced = S.add_split_version(versions, new, "v1", force=True).collect()
    assert len(forced) == 1 and forced[0]["split"] == "holdout"
    assert S.add_split_version(versions, new, "v2").count() == 2


def test_holdout_selection_follows_the_quota(spark):
    types = [(f"t{i}", 200, "multirotor") for i in range(20)] + [(f"w{i}", 200, "fixed_wing") for i in range(3)] + [("rare", 5, "hybrid"), ("h", 150, "hybrid")]
    df = spark.createDataFrame(types, "type string, n int, category string")
    alloc = {r["category"]: r["n_holdout"] for r in S.allocate_holdout(df, 7, 100).collect()}
    assert sum(alloc.values()) == 7 and alloc["hybrid"] == 1
    out = S.select_holdout(df, 7, 100, 1).toPandas()
    assert (out.split == "holdout").sum() == 7 and out[out.type == "rare"].split.item() == "train"


# ---- corrected rules ----------------------------------------------------------------------------


def test_neighbours_come_from_train_and_negatives(rows):
    """With negatives among the candidates a holdout sample next to them is called negative."""
    _, df = rows
    base = df.withColumn("is_drone", (F.col("label") < 4).cast("int"))
    held = df.where("label = 4")
    hits = N.knn(held, base.where("sample_id % 2 = 0"), 5, metric="euclidean", payload=["is_drone"])
    votes = N.knn_vote(hits, "sample_id", "is_drone", [1, 5])
    assert votes.where("predicted = 0").count() > 0


def test_votes_are_taken_per_k(spark):
    hits = spark.createDataFrame([(1, r, int(v)) for r, v in zip(range(1, 6), "10000")], "sample_id int, rank int, is_drone int")
    got = {r["k"]: r["predicted"] for r in N.knn_vote(hits, "sample_id", "is_drone", [1, 5]).collect()}
    assert got == {1: 1, 5: 0}


def test_probe_needs_both_classes_and_sees_them(rows):
    _, df = rows
    both = df.withColumn("y", (F.col("label") < 2).cast("int"))
    out = Q.linear_probe(both.where("sample_id % 2 = 0"), both.where("sample_id % 2 = 1"), "y").toPandas()
    assert out[out.is_total == 1].recall.item() > 0.8 and len(out) == 3


def test_confidence_falls_with_distance(spark):
    df = spark.createDataFrame([(float(d),) for d in range(10)], "d double")
    from spectraloom.operators.ranking import pct_rank

    got = pct_rank(df, df, "d").withColumn("c", L.tail_confidence("pct_greater")).orderBy("d").toPandas().c
    assert (np.diff(got) < 0).all() and got[0] == pytest.approx(0.9)


def test_both_deviations_are_available(rows):
    pdf, df = rows
    for ddof in (0, 1):
        z = df.select(V.standardize_expr("embedding", ddof=ddof).alias("z")).first()["z"]
        x = np.array(pdf.embedding[0])
        np.testing.assert_allclose(z, (x - x.mean()) / x.std(ddof=ddof))


def test_negative_best_similarity_still_matches(spark):
    reg = spark.createDataFrame([("a", "t", [1.0, 0.0])], "serial string, drone_type string, fingerprint array<double>")
    q = spark.createDataFrame([(1, [-1.0, 0.2])], "id int, embedding array<double>")
    got = M.find_by_fingerprint(q, reg, "id", "embedding", thr=-1.0).first()
    assert got["found_serial"] == "a" and got["best_sim"] < 0


def test_stale_and_refreshed_registries_differ(rows):
    """The repair curve separates keeping old prints from blending towards the snapshot."""
    _, df = rows
    from spectraloom.operators.registry import enroll_means

    cur = enroll_means(df.where("rec < 8"), "label", enrolled_at="2024-01-01").withColumn(
        "fingerprint", F.transform("fingerprint", lambda x: -x)
    )
    snap = enroll_means(df, "label", enrolled_at="2024-01-01")
    curve = C.repair_curve(df, cur, snap, "label", alpha=0.6, max_steps=3, thr=-1.0)
    acc = {r["step"]: r["a"] for r in curve.groupBy("step").agg(F.avg("accuracy").alias("a")).collect()}
    assert set(acc) == {0, 1, 2, 3} and acc[3] >= acc[0]


def test_drift_uses_earlier_steps_only(spark):
    h = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.9), ("a", 3, 0.7), ("b", 1, 0.9)], "type string, step int, acc double")
    got = C.drift(h, "type", "step", "acc", 0.1).collect()
    assert [(r["type"], r["step"]) for r in got] == [("a", 3)]


def test_empty_class_and_small_groups_give_null(spark):
    one = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, s double")
    from spectraloom.operators import ranking as K

    assert K.auc(one, "y", "s").first()["auc"] is None
    assert Q.silhouette(spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0])], "label int, embedding array<double>"), "label").first()["silhouette"] is None


def test_mislabel_scan_finds_planted_rows(rows):
    _, df = rows
    planted = df.where("sample_id < 6").withColumn("sample_id", F.col("sample_id") + 1000)
    far = df.where("sample_id >= 280").withColumn("embedding", F.transform("embedding", lambda x: -x * 3 - 50))
    suspects, clusters = U.mislabel_scan(df, planted.unionByName(far))
    assert {r["sample_id"] for r in suspects.collect()} >= {1000, 1001, 1002, 1003}
    assert clusters is not None and clusters.count() == 2


def test_categories_names_and_bands(spark):
    names = ["DJI_Mavic_u1", "Delta-wing quad", "VTOL tilt", "radio", "FrSky-X9_u2", "Some Maker pro_3"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    model, unit = L.split_unit("n")
    got = df.select(L.categorize("n").alias("c"), L.manufacturer("n").alias("m"), model.alias("mo"), unit.alias("u")).collect()
    assert [r["c"] for r in got] == ["multirotor", "fixed_wing", "hybrid", "unknown", "unknown", "unknown"]
    assert [r["m"] for r in got] == ["DJI", "DELTA-WING", "VTOL", "RADIO", "FRSKY", "SOME"]
    assert (got[0]["mo"], got[0]["u"]) == ("DJI_Mavic", "u1") and got[3]["mo"] is None
    levels = spark.createDataFrame([(float(x),) for x in (0.0, 1.0, 2.5, 5.0, 9.0)], "d double").select(
        L.interp_percentile("d", F.array(*[F.lit(float(v)) for v in (1, 2, 3, 4, 5)])).alias("p")
    )
    assert [r["p"] for r in levels.collect()] == [45.0, 50.0, 82.5, 99.0, 99.0]


def test_manifest_lists_a_type_once(rows):
    from spectraloom.sources.catalog import build_manifest

    _, df = rows
    got = build_manifest(df.withColumn("split", F.lit("train")), "split", "label").first()
    assert got["types"] == [0, 1, 2, 3, 4]


def test_packets_without_time_keep_their_content(spark):
    from spectraloom.operators import registry

    rows = [("a", "x", [1.0], None), ("b", "x", [1.0], None), ("b", "y", [2.0], "2024-01-01"), ("c", "p", [1.0], "2024-01-01"), ("c", "q", [0.5], "2024-01-01")]
    packets = spark.createDataFrame(rows, "serial string, drone_type string, fingerprint array<double>, t string").withColumn("ts", F.to_timestamp("t"))
    for parts in (1, 4):
        got, _ = registry.enroll_from_packets(packets.repartition(parts))
        assert sorted((r["serial"], r["drone_type"], list(r["fingerprint"])) for r in got.collect()) == [("a", "x", [1.0]), ("b", "y", [2.0]), ("c", "q", [0.5])]


def test_auc_by_type_with_null_type_and_nan(spark):
    from spectraloom.operators import ranking

    pos = spark.createDataFrame([("a", 0.9), ("a", float("nan")), (None, 0.2), (None, 0.8)], "t string, s double")
    neg = spark.createDataFrame([(0.5,), (float("nan"),), (None,), (0.1,)], "s double")
    got = {r["t"]: (r["auc"], r["n_pos"], r["n_neg"]) for r in ranking.auc_by_type(pos, neg, "s", "t").collect()}
    assert got == {"a": (1.0, 1, 2), None: (0.75, 2, 2)}


def test_several_models_are_an_error(spark):
    from spectraloom.operators import gaussian

    df = spark.createDataFrame([(i, i % 2, [float(i), float(i * i % 7)]) for i in range(20)], "id int, k int, embedding array<double>")
    models = gaussian.fit_gaussian(df, by=["k"])
    with pytest.raises(ValueError, match="more than one model"):
        gaussian.mahalanobis(df, models)


def test_keys_are_numbers_only_when_all_are(spark):
    from spectraloom.sources import catalog

    rows = [("n", k, [k]) for k in ("10", "9", "2000")] + [("m", k, [k]) for k in ("10", "9", "x1", "sample_000010", "sample_000002")]
    groups = spark.createDataFrame(rows, "g string, key string, item array<string>")
    got = {}
    for r in catalog.explode_samples(groups, "g", "key", "item").orderBy("sample_no").collect():
        got.setdefault(r["g"], []).append(r["key"])
    assert got == {"n": ["9", "10", "2000"], "m": sorted(["10", "9", "x1", "sample_000010", "sample_000002"])}


def test_curves_do_not_depend_on_the_block_size(rows):
    _, df = rows
    from spectraloom.operators.registry import enroll_means

    cur = enroll_means(df.where("rec < 8"), "label", enrolled_at="2024-01-01")
    snap = enroll_means(df, "label", enrolled_at="2024-01-01")
    row = lambda d: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.collect())
    for run in (lambda size: C.enrollment_curve(df, cur, "label", "enrolled_at", thr=0.1, stack_bytes=size), lambda size: C.repair_curve(df, cur, snap, "label", thr=0.1, stack_bytes=size)):
        whole = row(run(1 << 20))
        assert whole == row(run(1)) and len(whole) > 3


@pytest.mark.parametrize("ranges", [1, 5])
def test_places_in_enrolment_order(spark, ranges):
    rows = [(f"s{i * 7 % 60:02d}", None if i % 10 == 0 else i % 4, [float(i)]) for i in range(60)]
    reg = spark.createDataFrame(rows, "serial string, step int, fingerprint array<double>").repartition(3)
    got = {r["serial"]: r["place"] for r in C._placed(reg, ["step"], ["fingerprint"], ranges).collect()}
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert [got[r[0]] for r in want] == list(range(60))
    assert C._placed(reg.limit(0), ["step"], ["fingerprint"], ranges).count() == 0


def test_equal_similarity_goes_to_the_earliest_enrolled(spark):
    reg = spark.createDataFrame(
        [("b", [1.0, 0.0], "2024-01-02"), ("a", [1.0, 0.0], "2024-01-05"), ("c", [1.0, 0.0], "2024-01-02"), ("z", [0.0, 1.0], None), ("y", [0.0, 1.0], "1960-01-01")],
        "serial string, fingerprint array<double>, t string",
    ).withColumn("enrolled_at", F.to_timestamp("t"))
    df = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 3.0])], "id int, embedding array<double>")
    got = {r["id"]: r["matched"] for r in M.identify(df, reg, "id", "embedding").collect()}
    assert got == {1: "b", 2: "y"}
    assert {r["id"]: r["found_serial"] for r in M.find_by_fingerprint(df, reg, "id", "embedding").collect()} == got
