"""Streams give what the batch form gives, late rows are dropped and counted, reruns do not double."""

import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spectraloom.operators import gaussian as G
from spectraloom.streaming import jobs as J

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "id long, ts timestamp, sensor string, embedding array<double>"


def rows_at(seconds, seed=0, sensors=2, dims=4):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(5, dims))
    return [
        (i, T0 + dt.timedelta(seconds=float(s)), f"s{rng.integers(0, sensors)}", (base[rng.integers(0, 5)] + 0.01 * rng.normal(size=dims)).tolist())
        for i, s in enumerate(seconds)
    ]


def file_stream(spark, folder, batches, schema=SCHEMA):
    """One JSON file per micro-batch, read in order."""
    for n, rows in enumerate(batches):
        df = spark.createDataFrame(rows, schema)
        names = df.columns
        lines = [json.dumps(dict(zip(names, [v.isoformat() if isinstance(v, dt.datetime) else v for v in r]))) for r in rows]
        (folder / f"{n:03d}.json").write_text("\n".join(lines))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    return tmp_path / "in"


def brute_duplicates(rows, gap=1.0, sim=0.95):
    out = {}
    for i, t, s, x in rows:
        x = np.array(x) / np.linalg.norm(x)
        out[i] = any(
            s2 == s and (t2 < t or (t2 == t and j < i)) and (t - t2).total_seconds() <= gap and x @ (np.array(y) / np.linalg.norm(y)) > sim
            for j, t2, s2, y in rows
        )
    return out


@pytest.mark.parametrize("block", [8192, 3])
def test_dedup_batch_matches_brute_force(spark, block):
    rows = rows_at(np.sort(np.random.default_rng(1).uniform(0, 20, 120)))
    got = J.dedup_tracks(spark.createDataFrame(rows, SCHEMA), "sensor", "id", block=block)
    assert {r["id"]: r["is_duplicate"] for r in got.collect()} == brute_duplicates(rows)


def test_dedup_stream_matches_batch_for_closed_buckets(spark, folder):
    times = np.sort(np.random.default_rng(2).uniform(0, 20, 150))
    rows = rows_at(times)
    shuffled = [rows[i] for i in np.random.default_rng(3).permutation(50)] + rows[50:]  # out of order inside the first file
    stream = file_stream(spark, folder, [shuffled[:50], shuffled[50:100], shuffled[100:]])
    out, _ = J.run_to_folder(J.dedup_stream(stream, "sensor", "id", "5 seconds"), "append", "dedup")
    got = {r["id"]: r["is_duplicate"] for r in J.read_folder(spark, out).collect()}
    want = brute_duplicates(rows)
    assert len(got) > 50 and all(want[i] == d for i, d in got.items())


def test_scores_are_the_same(spark, folder):
    rows = rows_at(range(40))
    batch = spark.createDataFrame(rows, SCHEMA)
    model = G.fit_gaussian(batch)
    stream = file_stream(spark, folder, [rows[:15], rows[15:]])
    out, _ = J.run_to_folder(J.score_stream(stream, model, 1.5), "append", "score")
    got = {r["id"]: (round(r["dist"], 9), r["verdict"]) for r in J.read_folder(spark, out).collect()}
    want = {r["id"]: (round(r["dist"], 9), r["verdict"]) for r in J.score_stream(batch, model, 1.5).collect()}
    assert got == want


def test_alert_sessions_close_after_hold(spark, folder):
    rows = rows_at([0, 1, 2, 10, 11, 40, 41, 100], sensors=1)
    stream = file_stream(spark, folder, [rows[:4], rows[4:7], rows[7:]])
    out, _ = J.run_to_folder(J.alert_sessions(stream, "3 seconds", ["sensor"], late="2 seconds"), "append", "alert")
    got = sorted((r["on_at"], r["off_at"], r["detections"]) for r in J.read_folder(spark, out).collect())
    at = lambda s: T0 + dt.timedelta(seconds=s)
    assert got == [(at(0), at(5), 3), (at(10), at(14), 2), (at(40), at(44), 2)]  # the last one is still on


def test_late_rows_are_dropped_and_counted(spark, folder):
    rows = rows_at([0, 5, 120, 130, 135, 1, 2, 131, 300], sensors=1)
    stream = file_stream(spark, folder, [rows[:4], rows[4:5], rows[5:8], rows[8:]])
    rate = J.windowed_rate(stream, F.lit(True), "10 seconds", late="20 seconds")
    out, _, dropped = J.count_late_rows(spark, lambda: J.run_to_folder(rate, "append", "late"))
    got = {int((r["from_ts"] - T0).total_seconds()): r["n"] for r in J.read_folder(spark, out).collect()}
    assert got == {0: 2, 120: 1, 130: 3}  # seconds 1 and 2 came after the watermark had passed them
    assert dropped == 1  # both fall into one window, and rows are added up per window before the watermark is asked


def test_late_rows_of_more_reports_than_spark_keeps(spark, folder):
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", 2)
    try:
        rows = rows_at([500, 1, 2, 600, 3, 4, 5, 700], sensors=1)
        stream = file_stream(spark, folder, [[r] for r in rows])
        rate = J.windowed_rate(stream, F.lit(True), "10 seconds", late="20 seconds")
        _, query, dropped = J.count_late_rows(spark, lambda: J.run_to_folder(rate, "append", "late"))
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    assert len(query.recentProgress) <= 2
    assert dropped == 4  # the batch right after a jump still goes by the watermark before it


def test_newest_version_may_be_empty(spark, tmp_path):
    table = J.VersionedTable(spark, str(tmp_path / "t"), spark.createDataFrame([(1,)], "a int"))
    table.sink(lambda old, batch: old.limit(0))(spark.createDataFrame([(1,)], "a int"), 0)
    assert table.newest().collect() == []


def test_history_keeps_the_last_rows(spark, folder, tmp_path):
    rows = rows_at(range(60), sensors=2)
    stream = file_stream(spark, folder, [rows[30:], rows[:30]])
    table = J.VersionedTable(spark, str(tmp_path / "hist"), spark.createDataFrame([], SCHEMA))
    J.history_stream(table, stream, "sensor", "ts", 8, "id")
    got = {r["id"] for r in table.newest().collect()}
    want = set()
    for s in ("s0", "s1"):
        want |= set(sorted(r[0] for r in rows if r[2] == s)[-8:])
    assert got == want


def test_rerun_of_a_batch_does_not_count_twice(spark, tmp_path):
    start = spark.createDataFrame([("a", None, 0)], "serial string, last_seen timestamp, detection_count long")
    table = J.VersionedTable(spark, str(tmp_path / "reg"), start)
    batch = spark.createDataFrame([("a", T0), ("a", T0), ("b", T0)], "serial string, ts timestamp")
    sink = table.sink(lambda reg, b: J.touch(reg, b))
    sink(batch, 0)
    sink(batch, 0)
    assert table.newest().first()["detection_count"] == 2
    sink(batch, 1)
    assert table.newest().first()["detection_count"] == 4


def test_registry_from_a_stream_of_enrolments(spark, folder, tmp_path):
    schema = "serial string, fingerprint array<double>, enrolled_at timestamp"
    rows = [("a", [1.0], T0), ("b", [2.0], T0), ("a", [3.0], T0 + dt.timedelta(days=1)), ("b", [9.0], T0 - dt.timedelta(days=1))]
    stream = file_stream(spark, folder, [rows[:2], rows[2:]], schema)
    table = J.VersionedTable(spark, str(tmp_path / "reg"), spark.createDataFrame([], schema))
    J.upsert_registry(table, stream)
    assert {r["serial"]: r["fingerprint"] for r in table.newest().collect()} == {"a": [3.0], "b": [2.0]}
    auth_in = tmp_path / "packets"
    auth_in.mkdir()
    packets = file_stream(spark, auth_in, [[(1, "a", [3.0])], [(2, "zz", [-1.0])]], "packet_id long, serial string, fingerprint array<double>")
    reg = lambda: table.newest().withColumn("drone_type", F.lit("t"))
    out, _ = J.authenticate_stream(packets, reg)
    assert {r["packet_id"]: r["verdict"] for r in J.read_folder(spark, out).collect()} == {1: "AUTHENTIC", 2: "NOT_ENROLLED"}


def test_tables_in_several_files_are_streamed(spark, tmp_path):
    """A table may be one Parquet file or a folder of them."""
    from spectraloom.plans.streaming import stream_of

    rows = spark.range(50).repartition(4)
    rows.write.parquet(str(tmp_path / "many.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    (part,) = (tmp_path / "one").glob("*.parquet")
    part.rename(tmp_path / "single.parquet")
    for name in ("many", "single"):
        folder, _ = J.run_to_folder(stream_of(spark, str(tmp_path), name), "append", name)
        assert sorted(r.id for r in J.read_folder(spark, folder).collect()) == list(range(50))


def test_replays_meet_only_rows_of_their_gap(monkeypatch):
    """Flags as over all pairs; the pairs looked at are those in the gap, not those of the block."""
    rng = np.random.default_rng(1)
    x = np.eye(6)[rng.integers(0, 6, 6000)]
    t, ids = rng.integers(0, 100_000, 6000), rng.permutation(6000)
    seen, rounded = [0], np.round
    monkeypatch.setattr(J.np, "round", lambda m, places: seen.append(m.size) or rounded(m, places))
    got = J._duplicate_flags(t, ids, x, t, ids, x, 100, 0.95)
    monkeypatch.undo()
    assert sum(seen) < 6000 * 6000 / 10
    lag = t[:, None] - t[None]
    want = (((lag > 0) | ((lag == 0) & (ids[:, None] > ids[None]))) & (lag <= 100) & (x @ x.T > 0.95)).any(axis=1)
    assert np.array_equal(got, want) and 0 < want.sum() < 6000
