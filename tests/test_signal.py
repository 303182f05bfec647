"""Spectrogram operators against NumPy, and their invariants."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spectraloom.operators import augment as A
from spectraloom.operators import signal as S


def specs(spark, arrays, first=0):
    c, h, w = arrays[0].shape
    pdf = pd.DataFrame({"sample_id": np.arange(first, first + len(arrays)), "spec": [a.ravel().astype(np.float32).tolist() for a in arrays]})
    df = spark.createDataFrame(pdf).withColumn("spec", F.col("spec").cast("array<float>"))
    return df.select("*", F.lit(c).alias("c"), F.lit(h).alias("h"), F.lit(w).alias("w"))


def back(df, shape=None):
    out = df.orderBy("sample_id").toPandas()
    return [np.array(s).reshape(shape or (c, h, w)) for s, c, h, w in zip(out.spec, out.c, out.h, out.w)]


@pytest.fixture(scope="module")
def planes():
    rng = np.random.default_rng(0)
    return [rng.normal(size=(2, 16, 24)) * 3 + 1 for _ in range(12)]


def test_tone_peaks_at_its_bin(spark):
    n, b = 512, 9
    t = np.arange(n)
    tone = np.exp(2j * np.pi * b * t / 64)
    df = spark.createDataFrame(pd.DataFrame({"sample_id": [0], "i": [tone.real.tolist()], "q": [tone.imag.tolist()]}))
    out = S.stft(df, n_fft=64, hop=16, size=None, normalize=False).first()
    spec = np.array(out["spec"]).reshape(out["c"], out["h"], out["w"])
    assert out["h"] == 64
    assert (spec[0].argmax(axis=0)[4:-4] == b).all()
    # phase is referred to the slice centre: it advances by the tone's own rotation per hop
    phase = spec[1][b, 4:-4] * np.pi
    step = np.angle(np.exp(1j * np.diff(phase)))
    np.testing.assert_allclose(step, np.angle(np.exp(2j * np.pi * b * 16 / 64)), atol=1e-4)


def test_two_sided_stft_slices():
    x = np.random.default_rng(1).normal(size=(1, 200)) + 0j
    z = S.two_sided_stft(x, 32, 8)
    mid = 16
    centres = np.arange(-1, z.shape[2] - 1) * 8  # the first slice starts before the signal
    for col in (0, 3, z.shape[2] - 1):
        seg = np.zeros(32, complex)
        for k in range(32):
            at = centres[col] - mid + k
            if 0 <= at < 200:
                seg[k] = x[0, at]
        want = np.fft.fft(np.roll(seg * S.hann(32), -mid))
        np.testing.assert_allclose(z[0, :, col], want, atol=1e-9)
    assert centres[-1] - mid < 199 <= centres[-1] + 8 - mid


def test_gradient_features_and_versions(spark):
    rng = np.random.default_rng(2)
    iq = rng.normal(size=256) + 1j * rng.normal(size=256)
    df = spark.createDataFrame(pd.DataFrame({"sample_id": [0], "i": [iq.real.tolist()], "q": [iq.imag.tolist()]}))
    out = S.stft(df, n_fft=32, hop=8, size=None, features="db_grad", normalize=False).first()
    spec = np.array(out["spec"]).reshape(out["c"], out["h"], out["w"])
    win = S.hann(32, symmetric=False)
    frames = np.stack([iq[s : s + 32] * win / win.sum() for s in range(0, 225, 8)], axis=1)
    db = 20 * np.log10(np.abs(np.fft.fftshift(np.fft.fft(frames, axis=0), axes=0)) + 1e-8)
    np.testing.assert_allclose(spec[0], db, atol=1e-3)
    np.testing.assert_allclose(spec[1], np.gradient(db, axis=1), atol=1e-3)
    assert out["feature_version"] == "db_grad"


def test_resize(spark, planes):
    got = back(S.resize(specs(spark, planes), 8, 8))
    rows, cols = np.round(np.linspace(0, 15, 8)).astype(int), np.round(np.linspace(0, 23, 8)).astype(int)
    for a, b in zip(got, planes):
        np.testing.assert_allclose(a, b[:, rows][:, :, cols], rtol=1e-6)
    ramp = np.arange(4.0)[None, None, :].repeat(4, 1)
    np.testing.assert_allclose(S.resize_bilinear(ramp, 4, 8)[0, 0], [0, 0.25, 0.75, 1.25, 1.75, 2.25, 2.75, 3.0])
    np.testing.assert_allclose(S.resize_bilinear(ramp, 4, 2)[0, 0], [0.5, 2.5])


@pytest.mark.parametrize("ddof", [0, 1])
def test_standardize(spark, planes, ddof):
    flat = np.full((2, 16, 24), 5.0)
    got = back(S.standardize(specs(spark, planes[:2] + [flat]), ddof=ddof))
    for a, b in zip(got[:2], planes):
        want = (b - b.mean((1, 2), keepdims=True)) / b.std((1, 2), keepdims=True, ddof=ddof)
        np.testing.assert_allclose(a, want, atol=1e-5)
    np.testing.assert_allclose(got[2], 0, atol=1e-6)  # a flat channel is only centred


def test_channels_and_backfill(spark):
    a = np.arange(12.0).reshape(1, 3, 4) + 1
    assert np.array_equal(back(S.to_channels(specs(spark, [a]), 2))[0], np.concatenate([a, a]))
    b = np.concatenate([a, 2 * a])
    three = back(S.to_channels(specs(spark, [b]), 3))[0]
    assert np.array_equal(three, np.concatenate([b, np.zeros_like(a)]))
    full = np.concatenate([b, np.zeros_like(a)])
    kept = np.concatenate([b, 7 * a])
    got = back(S.backfill_channel(specs(spark, [full, kept, full]), 0, 2, F.col("sample_id") < 2))
    assert np.array_equal(got[0], np.concatenate([b, a])) and np.array_equal(got[1], kept) and np.array_equal(got[2], full)


def test_noise_reaches_its_level_and_ignores_partitioning(spark, planes):
    df = specs(spark, [np.random.default_rng(i).normal(size=(2, 32, 32)) for i in range(20)])
    clean = back(df)
    noisy = A.add_noise(df, 3.0, seed=1)
    got = back(noisy)
    ratio = np.mean([np.mean((g - c) ** 2) / np.mean(c**2) for g, c in zip(got, clean)])
    assert 10 * np.log10(1 / ratio) == pytest.approx(3.0, abs=0.2)
    again = back(A.add_noise(df.repartition(7), 3.0, seed=1))
    other = back(A.add_noise(df, 3.0, seed=2))
    assert all(np.array_equal(a, b) for a, b in zip(got, again)) and not np.array_equal(got[0], other[0])
    swept = A.snr_sweep(df, [25.0, 0.0], seed=1)
    same = [np.array_equal(a, b) for a, b in zip(back(swept.where("snr_db = 25")), clean)]
    assert all(same) and swept.count() == 40


@pytest.mark.parametrize("kind", ["wifi", "bluetooth", "microwave", "urban"])
def test_interference(spark, kind):
    df = specs(spark, [np.random.default_rng(i).normal(size=(2, 64, 120)) for i in range(6)])
    got, clean = back(A.add_noise(df, 0.0, seed=1, kind=kind)), back(df)
    changed = [np.mean(g != c) for g, c in zip(got, clean)]
    assert min(changed) > 0
    if kind == "microwave":
        assert max(changed) < 0.9  # silent half of the duty cycle
        assert all(np.array_equal(g[:, :, 50:100], c[:, :, 50:100]) for g, c in zip(got, clean))
    if kind == "bluetooth":
        assert max(changed) < 0.2
    assert all(np.array_equal(a, b) for a, b in zip(got, back(A.add_noise(df.repartition(5), 0.0, seed=1, kind=kind))))


def test_matched_background_removes_the_burst(spark):
    rng = np.random.default_rng(3)
    quiet = rng.normal(size=(1, 6, 64)) * 0.1
    loud = quiet.copy()
    loud[0, 2, 10:20] += 8.0
    zero = back(A.matched_background(specs(spark, [loud]), method="zero"))[0]
    floor = np.percentile(loud[0, 2].astype(np.float32), 10)
    np.testing.assert_allclose(zero[0, 2, 10:20], floor, rtol=1e-4)
    filled = back(A.matched_background(specs(spark, [loud]), method="replace", seed=1))[0]
    assert filled[0, 2, 10:20].max() < 1.0
    # applied once, the result has no burst left to remove
    twice = back(A.matched_background(specs(spark, [filled]), method="zero"))[0]
    assert np.abs(twice[0, 2] - filled[0, 2]).max() < 1.0


def test_hard_negatives_follow_the_envelope(spark):
    rng = np.random.default_rng(5)
    neg = [np.abs(rng.normal(size=(1, 8, 16))) + 0.5 for _ in range(30)]
    shape = np.linspace(0.2, 3, 8)[None, :, None]
    drones = [np.abs(rng.normal(size=(1, 8, 16))) * shape + 0.1 for _ in range(20)]
    out = A.shape_hard_negatives(specs(spark, neg), specs(spark, drones, 500), 25, seed=1)
    rows = out.toPandas()
    assert sorted(rows.draw) == list(range(25)) and set(rows.sample_id) <= set(range(30))
    env = np.maximum(np.mean([d[0].mean(1) for d in drones], axis=0), 0)
    for r in rows.itertuples():
        x = neg[r.sample_id].astype(np.float32).astype(float)
        scaled = x * np.clip(env / (np.maximum(x[0].mean(1), 0) + 1e-8), 0.5, 2.0)[None, :, None]
        want = (scaled - scaled.mean()) / scaled.std()
        np.testing.assert_allclose(np.array(r.spec).reshape(1, 8, 16), want, atol=1e-3)


def test_views_and_replays(spark, planes):
    df = specs(spark, planes[:3])
    views = A.augment(df, 4, seed=1)
    assert views.count() == 12
    first = views.orderBy("sample_id", "view").toPandas().spec
    second = A.augment(df.repartition(6), 4, seed=1).orderBy("sample_id", "view").toPandas().spec
    assert all(np.array_equal(a, b) for a, b in zip(first, second))
    assert not np.array_equal(first[0], first[1])
    replays = A.replay_variants(df, 5, seed=2).toPandas()
    assert len(replays) == 15
    for r in replays.itertuples():
        assert abs(np.abs(np.array(r.spec)).mean() / np.abs(planes[r.sample_id]).mean() - 1) < 0.15


def test_intent_features(spark, planes):
    got = A.intent_features(specs(spark, planes)).orderBy("sample_id").toPandas()
    x = planes[0][0].astype(np.float32).astype(float)
    assert got.temporal_variance[0] == pytest.approx(x.var(axis=1).mean(), rel=1e-6)
    assert got.doppler_spread[0] == pytest.approx(x.std(axis=0).mean(), rel=1e-6)
    assert got.burst[0] == pytest.approx(x.var(axis=1).std(), rel=1e-6)
    assert got.peakiness[0] == pytest.approx(x.max() / (x.mean() + 1e-8), rel=1e-6)


def test_gradient_rows_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "HALO_BLOCK", 7)
    v = np.random.default_rng(1).normal(size=50)
    df = spark.createDataFrame(pd.DataFrame({"s": [0] * 50, "idx": np.arange(50), "v": v}))
    got = S.gradient_rows(df, ["s"], "idx", "v").orderBy("idx").toPandas().gradient
    np.testing.assert_allclose(got, np.gradient(v))


def test_segments(spark):
    df = spark.createDataFrame([(1, [float(i) for i in range(200)])], "sample_id int, x array<double>")
    assert S.segment_arrays(df, ["x"], 20).count() == (200 - 20) // 10 + 1
    assert S.segment_arrays(df, ["x"], 20, cap=3).count() == 3
    assert S.segment_arrays(df, ["x"], 500).count() == 0
    assert (200000 - 2048) // 1024 + 1 == 194
    long = df.select("sample_id", F.posexplode("x").alias("idx", "v"))
    rows = S.segment_rows(long, ["sample_id"], "idx", ["v"], 20, 7).orderBy("segment_idx").toPandas()
    assert len(rows) == (200 - 20) // 7 + 1 and rows.v[3].tolist() == [float(i) for i in range(21, 41)]
