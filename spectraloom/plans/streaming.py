"""Streaming queries, run to the end of what is available, next to batch checks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spectraloom.operators import gaussian as G
from spectraloom.operators import registry as REG
from spectraloom.operators.signal import frame_spectrum, intent_rule
from spectraloom.plans.base import R, events, query, r, samples, table
from spectraloom.plans.detection import TRAIN_DIST, train_of
from spectraloom.plans.files import IQ_SQL, NAME_SQL, new_folder, write_files
from spectraloom.plans.matching import PACKET_CTE, THR, label_registry
from spectraloom.session import shared_dir
from spectraloom.sources import iq
from spectraloom.sources.iq_stream import read_iq_stream
from spectraloom.streaming import jobs as J
from spectraloom.streaming import stateful as ST


def stream_of(spark, sf_dir, name):
    """A table's Parquet file, or folder of Parquet files, as a stream source."""
    rows = table(spark, sf_dir, name)
    stream = spark.readStream.schema(rows.schema)
    if all(file.endswith(f"/{name}.parquet") for file in rows.inputFiles()):  # a source reads folders
        return stream.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return stream.parquet(f"{sf_dir}/{name}.parquet")


def event_stream(spark, sf_dir):
    return stream_of(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def sample_stream(spark, sf_dir):
    return stream_of(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("sample_id"), "label", F.col("embedding").cast("array<double>").alias("embedding")
    )


@query(
    "J1 B25",
    f"""WITH RECURSIVE {TRAIN_DIST}
SELECT sample_id, {R('dist')} AS dist, CASE WHEN dist <= 7.8 THEN 'DRONE' ELSE 'BACKGROUND' END AS verdict,
 CASE WHEN dist <= 7.8 THEN CASE WHEN label / 5.0 < 0.5 AND label / 5.0 < 1 THEN 'SURVEILLANCE' WHEN label / 5.0 > 2 OR label / 5.0 > 3 THEN 'ATTACK' ELSE 'TRANSIT' END END AS intent FROM dist""",
)
def scored_sample_stream(spark, sf_dir):
    model = G.fit_gaussian(train_of(samples(spark, sf_dir)))
    feature = F.col("label") / 5.0
    stream = J.score_stream(sample_stream(spark, sf_dir), model, 7.8, extra=lambda df: intent_rule(feature, feature))
    folder, _ = J.run_to_folder(stream, "append", "scored")
    return J.read_folder(spark, folder).select("sample_id", r("dist").alias("dist"), "verdict", "intent")


CONF_SQL = "c AS (SELECT CAST(event_type <> 'error' AS INT) AS truth, CASE WHEN value >= 20 THEN 'DRONE' ELSE 'BACKGROUND' END AS verdict, count(*) AS n FROM events GROUP BY ALL)"


@query("J2", f"WITH {CONF_SQL} SELECT truth, verdict, n FROM c")
def running_confusion_counts(spark, sf_dir):
    rows = event_stream(spark, sf_dir).select(
        (F.col("event_type") != "error").cast("int").alias("truth"), F.when(F.col("value") >= 20, "DRONE").otherwise("BACKGROUND").alias("verdict")
    )
    folder, _ = J.run_to_folder(J.stream_confusion(rows, "truth"), "complete", "confusion")
    return J.read_folder(spark, folder, latest_only=True)


@query(
    "J2",
    f"""WITH {CONF_SQL} SELECT {R("sum(n) FILTER (truth = 1 AND verdict = 'DRONE') / sum(n) FILTER (truth = 1)")} AS tpr, {R("sum(n) FILTER (truth = 0 AND verdict = 'DRONE') / sum(n) FILTER (truth = 0)")} AS fpr FROM c""",
)
def running_rates(spark, sf_dir):
    out = J.rates(running_confusion_counts(spark, sf_dir), "truth")
    return out.select(r("tpr").alias("tpr"), r("fpr").alias("fpr"))


@query(
    "J3 I",
    "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 128",
)
def recent_history_of_sensors(spark, sf_dir):
    """The rows that per-key state holds at the end of the stream."""
    folder = ST.keep_history(event_stream(spark, sf_dir), "user_id", "ts", "event_id", "value", n=128)
    held = ST.read_history(spark, folder)
    return held.select(F.col("key").cast(events(spark, sf_dir).schema["user_id"].dataType).alias("user_id"), F.col("id").alias("event_id"), "value")


ALERT_SQL = """d AS (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events WHERE value >= 10),
s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 3 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM d)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS on_at, strftime(max(ts) + INTERVAL 3 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS off_at, count(*) AS detections FROM s GROUP BY user_id, g"""
STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _stamped(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.date_format(c, STAMP))
    return df


@query("J4", f"WITH {ALERT_SQL}")
def alert_hold_sessions(spark, sf_dir):
    rows = event_stream(spark, sf_dir).where("value >= 10")
    folder, _ = J.run_to_folder(J.alert_sessions(rows, "3 hours", ["user_id"], late="1 hour"), "complete", "alerts")
    return _stamped(J.read_folder(spark, folder, latest_only=True), "on_at", "off_at")


@query("J4", f"WITH {ALERT_SQL}")
def alert_hold_sessions_batch(spark, sf_dir):
    return _stamped(J.alert_sessions(events(spark, sf_dir).where("value >= 10"), "3 hours", ["user_id"]), "on_at", "off_at")


def detections(spark, sf_dir):
    """Events carrying vectors: each event repeats the vector of its number modulo the vector table."""
    vecs = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    total = vecs.agg(F.max("vec_id") + 1).scalar()
    ev = events(spark, sf_dir).select("event_id", "ts", (F.col("user_id") % 3).alias("sensor"))
    return ev.withColumn("_v", F.pmod(F.floor(F.col("event_id") / 4), total)).join(vecs, F.col("_v") == F.col("vec_id")).drop("_v", "vec_id")


DEDUP_SQL = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), n AS (SELECT max(vec_id) + 1 AS n FROM v),
d AS (SELECT event_id, ts, user_id % 3 AS sensor, e FROM events, n, v WHERE vec_id = (event_id // 4) % n),
p AS (SELECT DISTINCT a.event_id FROM d a JOIN d b ON a.sensor = b.sensor AND b.ts <= a.ts AND (b.ts < a.ts OR b.event_id < a.event_id) AND a.ts - b.ts <= INTERVAL 600 SECOND
  WHERE round(list_cosine_similarity(a.e, b.e), 12) > 0.95)
SELECT d.event_id, d.sensor, p.event_id IS NOT NULL AS is_duplicate FROM d LEFT JOIN p USING (event_id)"""


@query("J5", f"WITH {DEDUP_SQL}")
def replay_tracks_deduplicated(spark, sf_dir):
    out = J.dedup_tracks(detections(spark, sf_dir), "sensor", "event_id", gap_us=600_000_000)
    return out.select("event_id", "sensor", "is_duplicate")


def detection_stream(spark, sf_dir):
    """``detections`` as a stream."""
    vecs = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    total = vecs.agg(F.max("vec_id") + 1).scalar()
    ev = event_stream(spark, sf_dir).select("event_id", "ts", (F.col("user_id") % 3).alias("sensor"))
    return ev.withColumn("_v", F.pmod(F.floor(F.col("event_id") / 4), total)).join(vecs, F.col("_v") == F.col("vec_id")).drop("_v", "vec_id")


#: Vectors that look alike in the given table look alike with each other, so the least id of those names a shape.
TRACK_SQL = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
shape AS (SELECT a.vec_id, min(b.vec_id) AS shape FROM v a JOIN v b ON round(list_cosine_similarity(a.e, b.e), 12) > 0.95 GROUP BY a.vec_id),
d AS (SELECT event_id, epoch_us(ts) AS t, user_id % 3 AS sensor, shape FROM events, shape WHERE vec_id = (event_id // 4) % (SELECT max(vec_id) + 1 FROM embeddings)),
closed AS (SELECT * FROM d WHERE (t // 3600000000 + 1) * 3600000 <= (SELECT max(epoch_us(ts)) FROM events) // 1000 - 3600000),
gaps AS (SELECT *, lag(t) OVER (PARTITION BY sensor, shape ORDER BY t, event_id) AS p FROM closed),
s AS (SELECT *, sum(CASE WHEN p IS NULL OR t - p > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY sensor, shape ORDER BY t, event_id) AS g FROM gaps)
SELECT event_id, CAST(sensor AS VARCHAR) AS sensor, first_value(event_id) OVER w AS track, row_number() OVER w > 1 AS repeats
FROM s WINDOW w AS (PARTITION BY sensor, shape, g ORDER BY t, event_id)"""


@query("J5", f"WITH {TRACK_SQL}")
def replay_tracks_in_state(spark, sf_dir):
    """Every detection of a closed hour with the track it belongs to; open tracks are keyed state."""
    tracked = ST.track_stream(detection_stream(spark, sf_dir), "sensor", "event_id", "1 hour", gap_us=3_600_000_000)
    with ST.rocksdb_state(spark):
        folder, _ = J.run_to_folder(tracked, "append", "tracks")
    return J.read_folder(spark, folder).select(F.col("id").alias("event_id"), "sensor", "track", "repeats")


ARRIVALS = 4
#: Events come in four deliveries of eight days each; every tenth event one delivery late.
ARRIVAL = "least(3, (dayofmonth(ts) - 1) {div} 8 + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END)"
LATE_SQL = f"""a AS (SELECT event_id, event_type, user_id, epoch_us(ts) AS t, {ARRIVAL.format(div='//')} AS arrival FROM events),
m AS (SELECT arrival, max(t) AS top FROM a GROUP BY arrival),
w AS (SELECT arrival, max(top) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) // 1000 * 1000 - 86400000000 AS mark FROM m),
k AS (SELECT event_id, event_type, user_id, t, coalesce(t <= mark, false) AS late FROM a JOIN w USING (arrival))"""


def delivered_rows(spark, sf_dir):
    """All events, marked by the watermark of the micro-batch that delivered them; each delivery is a run of the same stream."""
    source = events(spark, sf_dir).select("event_id", "event_type", "user_id", "ts", F.expr(ARRIVAL.format(div="div")).alias("arrival"))
    inbox, folder = (f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}" for kind in ("inbox", "routed"))
    for n in range(ARRIVALS):
        source.where(F.col("arrival") == n).drop("arrival").write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(source.drop("arrival").schema).parquet(inbox)
        marked = ST.mark_late(stream, "user_id", "1 day", keep=["event_id", "event_type"])
        ST.route_late(marked, folder)
    return ST.read_routed(spark, folder, marked.schema)


@query("J14", f"WITH {LATE_SQL} SELECT event_id, user_id, late FROM k")
def late_and_punctual_events(spark, sf_dir):
    """Every event once: on time, or in the side output of rows behind the watermark."""
    return delivered_rows(spark, sf_dir).select("event_id", "user_id", "late")


@query(
    "J14 J13",
    f"""WITH {LATE_SQL} SELECT event_type, strftime(make_timestamp(t // 86400000000 * 86400000000), '%Y-%m-%d') AS day,
 count(*) FILTER (NOT late) AS on_time, count(*) FILTER (late) AS behind, count(*) AS total FROM k GROUP BY ALL""",
)
def daily_counts_with_late_rows(spark, sf_dir):
    """Daily counts as first given, and what the rows behind the watermark add to them."""
    rows = delivered_rows(spark, sf_dir)
    count = lambda flag: F.count(F.when(flag, 1))
    return rows.groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        count(~F.col("late")).alias("on_time"), count(F.col("late")).alias("behind"), F.count(F.lit(1)).alias("total")
    )


@query(
    "J11 F13",
    f"""WITH {PACKET_CTE} SELECT packet_id,
 CASE WHEN NOT has_print THEN 'UNKNOWN' WHEN known AND claimed_sim >= {THR} THEN 'AUTHENTIC' WHEN known THEN 'SPOOFED'
   WHEN closest_sim >= {THR} THEN 'SPOOFED' ELSE 'NOT_ENROLLED' END AS verdict FROM j""",
)
def authenticated_packet_stream(spark, sf_dir):
    claim = F.when(F.col("sample_id") % 3 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    pk = sample_stream(spark, sf_dir).select(
        F.col("sample_id").alias("packet_id"), claim.cast("string").alias("serial"),
        F.when(F.col("sample_id") % 11 != 0, F.col("embedding")).alias("fingerprint"),
    )
    folder, _ = J.authenticate_stream(pk, lambda: label_registry(spark, sf_dir), THR)
    return J.read_folder(spark, folder).select("packet_id", "verdict")


@query(
    "J12",
    """WITH reg AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click'), d AS (SELECT user_id, max(ts) AS seen, count(*) AS n FROM events WHERE value >= 10 GROUP BY user_id)
SELECT CAST(user_id AS VARCHAR) AS serial, coalesce(n, 0) AS detection_count, strftime(seen, '%Y-%m-%dT%H:%M:%SZ') AS last_seen FROM reg LEFT JOIN d USING (user_id)""",
)
def registry_touched_by_stream(spark, sf_dir):
    start = events(spark, sf_dir).where("event_type = 'click'").select(F.col("user_id").cast("string").alias("serial")).distinct().select(
        "serial", F.lit(None).cast("timestamp").alias("last_seen"), F.lit(0).cast("long").alias("detection_count")
    )
    kept = J.VersionedTable(spark, f"{shared_dir(spark)}/registry-{uuid.uuid4().hex}", start)
    seen = event_stream(spark, sf_dir).where("value >= 10").select(F.col("user_id").cast("string").alias("serial"), "ts")
    J.touch_registry(kept, seen)
    return kept.newest().select("serial", "detection_count", F.date_format("last_seen", REG.UTC_FORMAT).alias("last_seen"))


@query(
    "J13",
    f"""WITH w AS (SELECT event_type, value, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS s FROM events)
SELECT event_type, strftime(s, '%Y-%m-%d %H:%M:%S.%f') AS from_ts, strftime(s + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS to_ts, count(*) AS n, {R('avg(CASE WHEN value >= 20 THEN 1.0 ELSE 0 END)')} AS rate FROM w GROUP BY ALL""",
)
def sliding_detection_rate(spark, sf_dir):
    out = J.windowed_rate(event_stream(spark, sf_dir), F.col("value") >= 20, "2 hours", "1 hour", ["event_type"], late="1 day")
    folder, _ = J.run_to_folder(out, "complete", "rates")
    done = _stamped(J.read_folder(spark, folder, latest_only=True), "from_ts", "to_ts")
    return done.select("event_type", "from_ts", "to_ts", "n", r("rate").alias("rate"))


@query(
    "J13 J14",
    f"""WITH m AS (SELECT max(ts) - INTERVAL 1 HOUR AS wm FROM events), w AS (SELECT event_type, value, time_bucket(INTERVAL 6 HOUR, ts) AS s FROM events)
SELECT event_type, strftime(s, '%Y-%m-%d %H:%M:%S.%f') AS from_ts, strftime(s + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS to_ts, count(*) AS n, {R('avg(CASE WHEN value >= 20 THEN 1.0 ELSE 0 END)')} AS rate
FROM w CROSS JOIN m WHERE s + INTERVAL 6 HOUR <= wm GROUP BY event_type, s""",
)
def tumbling_rate_after_watermark(spark, sf_dir):
    """Append mode: only windows the watermark has closed come out, each exactly once."""
    out = J.windowed_rate(event_stream(spark, sf_dir), F.col("value") >= 20, "6 hours", by=["event_type"], late="1 hour")
    folder, _ = J.run_to_folder(out, "append", "closed")
    done = _stamped(J.read_folder(spark, folder), "from_ts", "to_ts")
    return done.select("event_type", "from_ts", "to_ts", "n", r("rate").alias("rate"))


LIVE_CHUNK = 32  # samples of one segment
LIVE_SQL = f"""{IQ_SQL},
seg AS (SELECT recording_id, s // 32 AS chunk_no, s % 32 AS t, i, q, 0.5 - 0.5 * cos(2 * pi() * (s % 32) / 31) AS w FROM pair),
z AS (SELECT recording_id, chunk_no, k, sum(w * (i * cos(2 * pi() * k * t / 32) + q * sin(2 * pi() * k * t / 32))) AS re, sum(w * (q * cos(2 * pi() * k * t / 32) - i * sin(2 * pi() * k * t / 32))) AS im
  FROM seg CROSS JOIN (SELECT unnest(range(0, 32)) AS k) GROUP BY ALL),
p AS (SELECT recording_id, chunk_no, k, ln(1 + re * re + im * im) AS lp FROM z),
c AS (SELECT k, avg(lp) AS centre FROM p WHERE recording_id < 10 GROUP BY k),
d AS (SELECT recording_id, chunk_no, sqrt(sum((lp - centre) ** 2)) AS dist FROM p JOIN c USING (k) GROUP BY ALL)
SELECT {NAME_SQL} '.iq' AS recording_id, chunk_no, {R('dist', 4)} AS dist, CASE WHEN round(dist, 6) <= 1.5 THEN 'DRONE' ELSE 'BACKGROUND' END AS verdict FROM d"""


def live_verdicts(chunks, centre, threshold: float):
    """From I/Q segments to verdicts: spectrum, distance to a centre (one row), threshold; batch and stream alike."""
    spectra = frame_spectrum(chunks.withColumns({"i": F.col("i").cast("array<double>"), "q": F.col("q").cast("array<double>")}), "i", "q")
    far = F.sqrt(F.aggregate(F.zip_with("log_power", F.lit(centre), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x))
    scored = spectra.select("recording_id", "chunk_no", far.alias("dist"))
    return scored.withColumn("verdict", F.when(F.round("dist", 6) <= threshold, "DRONE").otherwise("BACKGROUND"))


def spectral_centre(chunks) -> list[float]:
    """Mean log-power per bin."""
    spectra = frame_spectrum(chunks.withColumns({"i": F.col("i").cast("array<double>"), "q": F.col("q").cast("array<double>")}), "i", "q")
    bins = spectra.select(F.posexplode("log_power").alias("k", "x")).groupBy("k").agg(F.avg("x").alias("m")).orderBy("k")
    return [row["m"] for row in bins.collect()]  # one row per bin


@query("J1 A1 B2", f"WITH {LIVE_SQL}")
def live_verdicts_of_growing_recordings(spark, sf_dir):
    """Every recording arrives in two parts; the stream hands out what is new, and its segments get spectra, distances and verdicts."""
    rows = samples(spark, sf_dir)
    folder = new_folder(spark, "live")
    half = rows.agg(F.max("sample_id")).first()[0] // 2
    out = f"{shared_dir(spark)}/verdicts-{uuid.uuid4().hex}"
    write_files(rows, (whole := new_folder(spark, "live-reference")), (".iq",))
    train = F.regexp_extract("recording_id", r"rec(\d+)", 1).cast("int") < 10
    centre = spectral_centre(iq.read_iq(spark, whole, chunk=LIVE_CHUNK).where(train))
    for part in (rows.where(F.col("sample_id") <= half), rows):
        write_files(part, folder, (".iq",))
        chunks = read_iq_stream(spark, folder, LIVE_CHUNK, range_samples=4 * LIVE_CHUNK)
        J.run_to_folder(live_verdicts(chunks, centre, 1.5), "append", "verdicts", folder=out)
    return J.read_folder(spark, out).select("recording_id", "chunk_no", r("dist", 4).alias("dist"), "verdict")
