"""Stored moments and sketches against the rows themselves; the growing-recording stream over ranges, growth and replays."""

import numpy as np
import pytest

from spectraloom.operators import moment_store as MS
from spectraloom.operators import sketches as K
from spectraloom.operators import tall_qr as TQ
from spectraloom.sources import iq, iq_stream
from spectraloom.streaming import jobs as J


def frame(spark, x, label):
    return spark.createDataFrame([(int(k), None if v is None else [float(a) for a in v]) for k, v in zip(label, x)], "label int, embedding array<double>").repartition(4)


def test_merged_and_removed_moments_equal_the_fit(spark):
    rng = np.random.default_rng(0)
    x, label = 1e6 + rng.normal(size=(400, 5)), rng.integers(0, 6, 400)
    slices = MS.slice_moments(frame(spark, [*x, None], [*label, 0]), ["label"])
    whole = MS.combine(slices).first()
    assert whole["n"] == 400 and np.allclose(whole["mean"], x.mean(axis=0), rtol=1e-14)
    left = MS.combine(slices, slices.where("label >= 4")).first()
    rest = x[label < 4]
    assert left["n"] == len(rest) and np.allclose(np.reshape(left["scatter"], (5, 5)) / (len(rest) - 1), np.cov(rest.T), atol=5e-3)
    assert MS.combine(slices, slices).collect() == []
    assert MS.combine(slices.limit(0)).collect() == []


def test_remove_then_add_is_the_identity():
    rng = np.random.default_rng(1)
    part = lambda x: (len(x), x.mean(axis=0), np.cov(x.T, ddof=0) * len(x))
    a, b = rng.normal(size=(50, 3)), 5 + rng.normal(size=(20, 3))
    both = MS.merge(part(a), part(b))
    back = MS.merge(MS.remove(both, part(b)), part(b))
    assert both[0] == back[0] == 70 and np.allclose(both[1], back[1]) and np.allclose(both[2], back[2])
    assert np.allclose(both[2], part(np.vstack([a, b]))[2])
    with pytest.raises(ValueError):
        MS.remove(part(b), part(a))


def test_sketches_merge_to_their_bounds(spark):
    rng = np.random.default_rng(2)
    rows = [(f"g{i % 2}", i % 30, float(v), int(k)) for i, (v, k) in enumerate(zip(rng.lognormal(size=20_000), rng.integers(0, 3_000, 20_000)))]
    rows += [("g0", 1, None, None), ("none", 1, None, None)]
    df = spark.createDataFrame(rows, "g string, day int, v double, k long")
    merged = K.merge_slices(K.merge_slices(K.sketch_slices(df, ["g", "day"], "v", "k"), ["g", "day"]), ["g"])
    got = {(r["g"], r["rank"]): r for r in K.read_sketches(merged, ["g"], [0.1, 0.5, 0.9]).collect()}
    for g in ("g0", "g1"):
        v = np.sort([r[2] for r in rows if r[0] == g and r[2] is not None])
        keys = len({r[3] for r in rows if r[0] == g and r[3] is not None})
        for p in (0.1, 0.5, 0.9):
            r = got[g, p]
            assert r["n"] == len(v) and abs(np.searchsorted(v, r["quantile"]) / len(v) - p) < 0.01 and abs(r["n_keys"] - keys) < 0.04 * keys
    assert got["none", 0.5]["n"] == 0 and got["none", 0.5]["quantile"] is None and got["none", 0.5]["n_keys"] == 0


def test_recordings_as_a_stream(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    (inbox / "a").mkdir(parents=True)
    data = np.random.default_rng(3).normal(size=(1000, 2)).astype("<f4")
    seen = []
    for a, b in [(250, 0), (250, 130), (601, 130), (1000, 999)]:
        (inbox / "a" / "one.iq").write_bytes(data[:a].tobytes())
        if b:
            (inbox / "two.dat").write_bytes(data[:b].tobytes())
        J.run_to_folder(iq_stream.read_iq_stream(spark, str(inbox), 100, range_samples=200), "append", "iq", folder=out)
        seen.append(J.read_folder(spark, out).count())
    assert seen == [2, 3, 7, 19]  # whole chunks only, each once
    for r in J.read_folder(spark, out).collect():
        at = r["start_sample"]
        assert r["chunk_no"] * 100 == at and np.array_equal(r["i"], data[at : at + 100, 0]) and np.array_equal(r["q"], data[at : at + 100, 1])
    stream = iq_stream.IqStreamReader({"path": str(inbox), "chunk": "100", "rangesamples": "200"})
    ranges = stream.partitions({"a/one.iq": 200}, {"a/one.iq": 600, "two.dat": 100})
    once, again = ([b.to_pydict() for p in ranges for b in stream.read(p)] for _ in range(2))
    assert once == again and len(once) == 5
    whole = {(r["recording_id"], r["chunk_no"]): r["i"] for r in iq.read_iq(spark, str(inbox), chunk=100).where("size(i) = 100").collect()}
    assert whole == {(r["recording_id"], r["chunk_no"]): r["i"] for r in J.read_folder(spark, out).collect()}


def test_no_recordings_yet(spark, tmp_path):
    out, _ = J.run_to_folder(iq_stream.read_iq_stream(spark, str(tmp_path / "none"), 100), "append", "iq", folder=str(tmp_path / "out"))
    assert not (tmp_path / "out" / "out").exists() or J.read_folder(spark, out).count() == 0


@pytest.mark.parametrize("parts", [1, 7, 70])
def test_singular_values_of_an_ill_conditioned_matrix(spark, parts):
    rng = np.random.default_rng(6)
    want = np.geomspace(1, 1e-9, 6)
    x = np.linalg.qr(rng.normal(size=(300, 6)))[0] * want @ np.linalg.qr(rng.normal(size=(6, 6)))[0]
    df = spark.createDataFrame([(v.tolist(),) for v in x] + [(None,)], "embedding array<double>").repartition(parts)
    got = TQ.singular_values(df).orderBy("place").collect()
    assert np.allclose([r["value"] for r in got], want, rtol=1e-5) and got[0]["n"] == 300  # squares would leave 1e-8 at best
    assert TQ.effective_rank(df, share=1e-8).first()["effective_rank"] == 5
    assert TQ.singular_values(df.limit(0)).collect() == []
