"""Readers, the store and the registry files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom.operators import registry as REG
from spectraloom.sources import catalog as C
from spectraloom.sources import ingest as ING
from spectraloom.sources import iq as IQ


@pytest.fixture(scope="module")
def recording(tmp_path_factory):
    folder = tmp_path_factory.mktemp("iq")
    rng = np.random.default_rng(0)
    z = (rng.normal(size=10_000) + 1j * rng.normal(size=10_000)).astype(np.complex64)
    z.tofile(folder / "a.dat")
    z[:5000].tofile(folder / "b.cf32")
    (folder / "sub").mkdir()
    (folder / "sub" / "c.csv").write_text(",".join(f"{v:.6f}" for p in zip(z[:50].real, z[:50].imag) for v in p))
    (folder / "notes.md").write_text("x")
    return folder, z


def whole(df, name):
    rows = df.where(F.col("recording_id") == name).orderBy("start_sample").toPandas()
    return np.concatenate([np.array(i) + 1j * np.array(q) for i, q in zip(rows.i, rows.q)])


@pytest.mark.parametrize("chunk,span", [(65_536, 1 << 20), (512, 512), (1000, 3000)])
def test_iq_round_trip(spark, recording, chunk, span):
    folder, z = recording
    df = IQ.read_iq(spark, str(folder / "a.dat"), chunk=chunk, range_samples=span)
    assert np.array_equal(whole(df, "a.dat").astype(np.complex64), z)
    capped = IQ.read_iq(spark, str(folder / "a.dat"), chunk=chunk, max_samples=1000, range_samples=span)
    assert np.array_equal(whole(capped, "a.dat").astype(np.complex64), z[:1000])


def test_reader_choice_and_discovery(spark, recording):
    folder, z = recording
    df = IQ.read_iq(spark, str(folder), chunk=4096)
    assert {r[0] for r in df.select("recording_id").distinct().collect()} == {"a.dat", "b.cf32", "sub/c.csv"}
    np.testing.assert_allclose(whole(df, "sub/c.csv"), z[:50], atol=1e-5)
    listed = IQ.list_recordings(spark, str(folder)).toPandas()
    assert [p.rsplit("/", 1)[1] for p in listed.path] == ["a.dat", "b.cf32", "c.csv"]


def test_object_store_path_gives_the_same_chunks(spark, recording):
    folder, z = recording
    df = IQ.read_through_spark(spark, f"file:{folder}/a.dat", F.lit("a.dat"), 3000, 500, None).orderBy("start_sample").toPandas()
    got = np.concatenate([np.array(i)[:3000] + 1j * np.array(q)[:3000] for i, q in zip(df.i, df.q)])
    assert np.array_equal(got.astype(np.complex64), z) and [len(i) for i in df.i] == [3500, 3500, 3500, 1000]


@pytest.mark.parametrize("chunk", [700, 1024, 20_000])
def test_segments_do_not_depend_on_chunks(spark, recording, chunk):
    folder, z = recording
    df = IQ.read_iq(spark, str(folder / "a.dat"), chunk=chunk, halo=2047, range_samples=chunk)
    rows = IQ.chunk_segments(df, chunk, 2048).orderBy("segment_idx").toPandas()
    assert len(rows) == (10_000 - 2048) // 1024 + 1
    for r in rows.itertuples():
        got = np.array(r.i) + 1j * np.array(r.q)
        assert np.array_equal(got.astype(np.complex64), z[r.segment_idx * 1024 : r.segment_idx * 1024 + 2048])


def test_ingest_appends_with_dense_numbers(spark, tmp_path):
    t = np.arange(20_000) / 20e6
    raw = tmp_path / "raw"
    raw.mkdir()
    for k, f in enumerate((2e6, 4e6)):
        (np.exp(2j * np.pi * f * t) + 0.05).astype(np.complex64).tofile(raw / f"tone{k}.dat")
    store = str(tmp_path / "store")
    opts = dict(segment_len=2048, n_fft=128, hop=32, size=32, chunk=4096)
    ING.ingest(spark, str(raw), store, "alpha", **opts)
    ING.ingest(spark, str(raw), store, "beta", **opts)
    ING.ingest(spark, str(raw / "tone0.dat"), store, "alpha", **opts)
    per = (20_000 - 2048) // 1024 + 1
    rows = spark.read.parquet(store)
    got = {r["drone_type"]: r["ns"] for r in rows.groupBy("drone_type").agg(F.sort_array(F.collect_list("sample_no")).alias("ns")).collect()}
    assert got == {"alpha": list(range(3 * per)), "beta": list(range(2 * per))}
    first = rows.where("drone_type = 'alpha' AND sample_no = 0").first()
    assert (first["c"], first["h"], first["w"]) == (2, 32, 32) and len(first["spec"]) == 2 * 32 * 32
    assert spark.read.parquet(store + "-manifest").count() == 5
    assert (raw / "tone0.dat").exists()


def test_xml_metadata(spark, tmp_path):
    (tmp_path / "m.xml").write_text("<rec><Fs>1e6</Fs><Drone>mavic</Drone><Gain>30</Gain></rec>")
    (tmp_path / "n.xml").write_text("<rec><Fs>2000000</Fs><State>hover</State></rec>")
    rows = C.read_xml_meta(spark, str(tmp_path)).toPandas()
    got = {(p.rsplit("/", 1)[1], k): (t, n) for p, _, k, t, n in rows.itertuples(index=False)}
    assert got[("m.xml", "Fs")][1] == 1e6 and got[("n.xml", "Fs")][1] == 2e6
    assert got[("m.xml", "Drone")][0] == "mavic" and np.isnan(got[("m.xml", "Drone")][1])
    assert ("n.xml", "Gain") not in got


def test_xml_of_any_shape(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<one><x>1</x><x>2</x><empty/><deep>t<y>3</y></deep></one>")
    (tmp_path / "b.xml").write_text("<?xml version='1.0'?><other><x>z</x></other>")
    (tmp_path / "c.xml").write_text("not xml")
    rows = C.read_xml_meta(spark, str(tmp_path)).collect()
    got = sorted((r["path"].rsplit("/", 1)[1], r["pos"], r["key"], r["text"], r["number"]) for r in rows)
    assert got == [("a.xml", 0, "x", "1", 1.0), ("a.xml", 1, "x", "2", 2.0), ("a.xml", 2, "empty", None, None), ("a.xml", 3, "deep", "t", None), ("b.xml", 0, "x", "z", None)]


def test_metric_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"auc": 0.9}, indent=1))
    (tmp_path / "b.json").write_text("{broken")
    got = C.read_metrics(spark, str(tmp_path)).collect()
    assert len(got) == 1 and json.loads(got[0]["body"]) == {"auc": 0.9}
    wide = spark.createDataFrame([("r1", 0.5, 1.0)], "run_id string, auc double, fpr double")
    C.write_metrics(wide, ["run_id"], str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out")).orderBy("metric").collect()
    assert [(r["metric"], r["value"]) for r in back] == [("auc", 0.5), ("fpr", 1.0)]


def test_images(spark, tmp_path):
    import struct
    import zlib

    def png(path, img):
        h, w, _ = img.shape
        raw = b"".join(b"\0" + img[y].tobytes() for y in range(h))

        def part(kind, data):
            return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

        path.write_bytes(
            b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")
        )

    img = np.random.default_rng(0).integers(0, 255, (8, 8, 3), dtype=np.uint8)
    png(tmp_path / "x.png", img)
    row = IQ.read_spectrogram_images(spark, str(tmp_path), 8).first()
    x = img.transpose(2, 0, 1) / 255.0
    want = (x - x.mean((1, 2), keepdims=True)) / x.std((1, 2), keepdims=True)
    np.testing.assert_allclose(np.array(row["spec"]).reshape(3, 8, 8), want, atol=1e-4)


def test_registry_files_keep_versions(spark, tmp_path):
    row = [("s1", "t", [1.0], None, "", None, 0)]
    reg = spark.createDataFrame(row, REG.REGISTRY_SCHEMA)
    path = str(tmp_path / "reg")
    REG.save_registry(reg, path)
    newer = REG.upsert(REG.load_registry(spark, path), spark.createDataFrame([("s2", "t", [2.0], None, "", None, 0)], REG.REGISTRY_SCHEMA))
    REG.save_registry(newer, path)
    assert {r["serial"] for r in REG.load_registry(spark, path).collect()} == {"s1", "s2"}
    assert REG.list_registry(newer).count() == 2


def test_read_back_of_every_recording(spark):
    from spectraloom.plans import catalogue
    from tests.compare import sf_dir

    for name in ("text_recordings_all_read_back", "raw_recordings_all_read_back"):
        rows = catalogue()[name].run(spark, sf_dir("0.001")).select("recording_id").distinct().collect()
        assert len(rows) == 20


def test_text_recordings_by_byte_ranges(spark, tmp_path, monkeypatch):
    """Every byte range finds the place of its numbers, whatever lies between them; no task holds the whole text."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=2 * 1537 + 1).astype(np.float32)  # the last number has no partner
    gaps = [",", ";", " ", "\n", ", ", ";;", "\r\n"]
    (tmp_path / "a.csv").write_text("".join(repr(float(v)) + gaps[rng.integers(7)] for v in x))
    (tmp_path / "b.TXT").write_text(",".join(repr(float(v)) for v in x[:7]))
    (tmp_path / "c.csv").write_text("")
    monkeypatch.setattr(IQ, "TEXT_BLOCK", 64)
    for chunk, halo, limit, span in ((100, 0, None, 1 << 20), (100, 30, None, 501), (7, 200, None, 64), (4096, 0, 1000, 97)):
        rows = IQ.read_iq_csv(spark, str(tmp_path), chunk, limit, halo, root=str(tmp_path), only=IQ.CSV_GLOB, range_bytes=span).collect()
        got = {(r.recording_id, r.start_sample): r for r in rows}
        assert len(got) == len(rows)
        for name, n in (("a.csv", min(1537, limit or 1537)), ("b.TXT", 3)):
            assert {s for f, s in got if f == name} == set(range(0, n, chunk))
            for start in range(0, n, chunk):
                stop, row = min(start + chunk + halo, n), got[name, start]
                assert row.chunk_no == start // chunk
                assert np.array_equal(row.i, x[2 * start : 2 * stop : 2]) and np.array_equal(row.q, x[2 * start + 1 : 2 * stop : 2])


def test_packed_text_recordings(spark, tmp_path):
    import gzip

    (tmp_path / "a.csv.gz").write_bytes(gzip.compress(b"1,2;3 4\n5"))
    (tmp_path / "b.csv").write_bytes(b"6,7")
    rows = IQ.read_iq(spark, str(tmp_path), chunk=2, format="csv").collect()
    assert {(r.recording_id, r.start_sample, *r.i, *r.q) for r in rows} == {("a.csv.gz", 0, 1.0, 3.0, 2.0, 4.0), ("b.csv", 0, 6.0, 7.0)}


def test_small_ranges_share_a_task(spark, recording):
    """The number of tasks follows the bytes, not the number of ranges."""
    folder, z = recording
    reader = IQ._IqReader({"path": str(folder), "chunk": "100", "rangesamples": "100", "halo": "20"})
    parts = reader.partitions()
    assert len(parts) == 1 and [r[1:3] for r in parts[0].ranges] == [(0, 10_000), (0, 5000)]
    tasks = IQ.packed([("a", k * 100_000, (k + 1) * 100_000) for k in range(100)])
    assert tasks == [[("a", k * 500_000, (k + 1) * 500_000)] for k in range(20)]
    batches = [b for p in parts for b in reader.read(p)]
    rows = [r for b in batches for r in b.to_pylist() if r["recording_id"] == "a.dat"]
    assert [r["start_sample"] for r in rows] == list(range(0, 10_000, 100)) and len(batches) == 2
    for r in rows:
        assert np.array_equal(np.array(r["i"]), z.real[r["start_sample"] : r["start_sample"] + 120])


def test_files_are_written_batch_after_batch(spark, tmp_path):
    """A recording is appended in the order of its samples, over several Arrow batches."""
    from spectraloom.plans.files import write_files

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.range(200).repartition(5).selectExpr("id AS sample_id", "id % 3 AS recording_id", "array(id + 0.5D, -double(id) - 1) AS embedding")
        write_files(rows, str(tmp_path / "raw"), (".dat",))
        write_files(rows, str(tmp_path / "text"), (".csv",), text=True)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for rec in range(3):
        want = np.array([v for i in range(200) if i % 3 == rec for v in (i + 0.5, -i - 1)], "<f4")
        assert np.array_equal(np.fromfile(tmp_path / f"raw/part{rec % 2}/rec{rec:02d}.dat", "<f4"), want)
        assert (tmp_path / f"text/part{rec % 2}/rec{rec:02d}.csv").read_text() == ",".join(repr(float(v)) for v in want)
