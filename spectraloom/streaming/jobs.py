"""Streaming jobs: scoring, running counts, alerts, history, de-duplication, authentication, upkeep.

Transformations take and return DataFrames and work on batch and streaming input alike; the sinks
write one folder per micro-batch, so a batch that is run again replaces its own output.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from spectraloom.functions.arrow import to_matrix, unit_rows
from spectraloom.operators.gaussian import mahalanobis
from spectraloom.operators.matching import MATCH_THRESHOLD, authenticate
from spectraloom.operators.registry import latest, touch, upsert
from spectraloom.session import shared_dir

DEDUP_BLOCK = 8_192
DEDUP_STEP = 128


# ---- transformations ----------------------------------------------------------------------------


def score_stream(stream: DataFrame, models: DataFrame, threshold: float, col: str = "embedding", l2: bool = True, extra: Callable | None = None) -> DataFrame:
    """Distance and verdict per row; ``extra`` (say an intent rule) is evaluated on detections only."""
    scored = mahalanobis(stream, models, col, l2=l2).withColumn(
        "verdict", F.when(F.col("dist") <= threshold, "DRONE").otherwise("BACKGROUND")
    )
    if extra is not None:
        scored = scored.withColumn("intent", F.when(F.col("verdict") == "DRONE", extra(scored)))
    return scored


def stream_confusion(scored: DataFrame, truth: str, verdict: str = "verdict") -> DataFrame:
    """Running counts per (truth, verdict)."""
    return scored.groupBy(truth, verdict).agg(F.count(F.lit(1)).alias("n"))


def rates(counts: DataFrame, truth: str, positive: str = "DRONE", verdict: str = "verdict") -> DataFrame:
    """TPR and FPR from confusion counts."""

    def share(y: int) -> Column:
        hit = F.sum(F.when((F.col(truth) == y) & (F.col(verdict) == positive), F.col("n")))
        total = F.sum(F.when(F.col(truth) == y, F.col("n")))
        return F.coalesce(hit, F.lit(0)) / F.nullif(total, F.lit(0))

    return counts.agg(share(1).alias("tpr"), share(0).alias("fpr"))


def alert_sessions(detections: DataFrame, hold: str = "3 seconds", by: list[str] | None = None, ts: str = "ts", late: str | None = None) -> DataFrame:
    """Alerts that stay on until ``hold`` after the last detection.

    Sessions are merged inside each input partition before the shuffle (a session setting), so a
    sensor with most of the detections sends partial sessions, not rows.
    """
    detections.sparkSession.conf.set("spark.sql.sessionWindow.merge.sessions.in.local.partition", "true")
    rows = detections.withWatermark(ts, late) if late else detections
    window = F.session_window(ts, hold)
    return rows.groupBy(*(by or []), window.alias("alert")).agg(F.count(F.lit(1)).alias("detections")).select(
        *(by or []), F.col("alert.start").alias("on_at"), F.col("alert.end").alias("off_at"), "detections"
    )


def windowed_rate(rows: DataFrame, flag: Column, size: str, slide: str | None = None, by: list[str] | None = None, ts: str = "ts", late: str | None = None) -> DataFrame:
    """Detection rate per tumbling or sliding window."""
    rows = rows.withWatermark(ts, late) if late else rows
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    return rows.groupBy(*(by or []), window.alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(flag.cast("double")).alias("rate")
    ).select(*(by or []), F.col("w.start").alias("from_ts"), F.col("w.end").alias("to_ts"), "n", "rate")


def recent_history(rows: DataFrame, by: str, ts: str, n: int = 128, tie: str | None = None) -> DataFrame:
    """Last n rows per key; the limit applies before the shuffle, so a busy key stays small."""
    w = Window.partitionBy(by).orderBy(F.col(ts).desc(), *([F.col(tie).desc()] if tie else []))
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


# ---- replay de-duplication ----------------------------------------------------------------------


def _duplicate_flags(ts_q, ids_q, q, ts_b, ids_b, b, gap_us: int, sim: float) -> np.ndarray:
    """Per row of q: does an earlier row of b within the gap look the same? (earlier by time, then id)

    In order of time, so that rows meet only those of b that lie in their gap.
    """
    out = np.zeros(len(q), dtype=bool)
    asked, given = np.argsort(ts_q, kind="stable"), np.argsort(ts_b, kind="stable")
    ts_b, ids_b, b = ts_b[given], ids_b[given], b[given]
    step = max(1, min(DEDUP_STEP, (32 << 20) // (8 * max(len(b), 1))))
    for at in range(0, len(q), step):
        part = asked[at : at + step]
        span = slice(np.searchsorted(ts_b, ts_q[part[0]] - gap_us), np.searchsorted(ts_b, ts_q[part[-1]], "right"))
        lag = ts_q[part][:, None] - ts_b[None, span]
        before = (lag > 0) | ((lag == 0) & (ids_q[part][:, None] > ids_b[None, span]))
        near = before & (lag <= gap_us)
        if near.any():
            out[part] = (near & (np.round(q[part] @ b[span].T, 12) > sim)).any(axis=1)
    return out


def _time_bucket(ts: str, gap_us: int) -> Column:
    return F.expr(f"floor(unix_micros({ts}) div {gap_us})")


def dedup_tracks(
    rows: DataFrame, sensor: str, id_col: str, ts: str = "ts", col: str = "embedding", sim: float = 0.95, gap_us: int = 1_000_000,
    block: int = DEDUP_BLOCK, bucket_us: int | None = None,
) -> DataFrame:
    """Flag detections that repeat an earlier one of the same sensor within the gap; the rest start tracks.

    Only rows in the same or the previous time bucket (at least a gap long) can match. Buckets are cut into blocks on
    both sides, so a sensor that holds most detections is many tasks; a task returns flags, no pairs.
    """
    width = max(gap_us, bucket_us or 8 * gap_us)
    base = rows.select(
        F.col(sensor).alias("_s"), F.col(id_col).cast("long").alias("_id"), F.unix_micros(ts).alias("_t"),
        _time_bucket(ts, width).alias("_k"), F.col(col).cast("array<double>").alias("_x"),
    ).where("_x IS NOT NULL")
    sizes = base.groupBy("_s", "_k").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_nb"))
    here = base.join(sizes, ["_s", "_k"]).withColumn("_blk", F.pmod(F.xxhash64("_id"), F.col("_nb")).cast("int"))
    # a row asks its own bucket and the one before: (target bucket, target block)
    asked = here.withColumn("_target", F.explode(F.array(F.col("_k"), F.col("_k") - 1)))
    targets = sizes.select(F.col("_s").alias("_ts"), F.col("_k").alias("_tk"), F.col("_nb").alias("_tn"))
    left = asked.join(targets, (F.col("_s") == F.col("_ts")) & (F.col("_target") == F.col("_tk"))).withColumn(
        "_tb", F.explode(F.sequence(F.lit(0), F.col("_tn") - 1))
    ).select("_s", F.col("_k").alias("_from"), F.col("_blk").alias("_qb"), "_target", "_tb", "_id", "_t", "_x")
    # the asked side is replicated once per block that asks it
    askers = sizes.select(F.col("_s").alias("_as"), F.col("_k").alias("_ak"), F.col("_nb").alias("_an"))
    offered = here.select(
        *[F.col(c).alias(c) for c in ("_s", "_k", "_blk", "_id", "_t", "_x")], F.explode(F.array(F.col("_k"), F.col("_k") + 1)).alias("_from")
    ).join(askers, (F.col("_s") == F.col("_as")) & (F.col("_from") == F.col("_ak")))
    right = offered.withColumn("_qb", F.explode(F.sequence(F.lit(0), F.col("_an") - 1))).select(
        "_s", "_from", "_qb", F.col("_k").alias("_target"), F.col("_blk").alias("_tb"), "_id", "_t", "_x"
    )
    keys = ["_s", "_from", "_qb", "_target", "_tb"]

    def flag(lt: pa.Table, rt: pa.Table) -> pa.Table:
        if lt.num_rows == 0 or rt.num_rows == 0:
            return pa.table({"_id": pa.array([], pa.int64()), "_dup": pa.array([], pa.bool_())})
        side = [
            (t.column("_t").to_numpy(), t.column("_id").to_numpy(), unit_rows(to_matrix(t.column("_x"))[1])) for t in (lt, rt)
        ]
        return pa.table({"_id": lt.column("_id"), "_dup": _duplicate_flags(*side[0], *side[1], gap_us, sim)})

    marks = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(flag, "_id long, _dup boolean")
    found = marks.where("_dup").select("_id").distinct().withColumn("_hit", F.lit(True))
    return rows.join(found, F.col(id_col) == F.col("_id"), "left").withColumn(
        "is_duplicate", F.coalesce("_hit", F.lit(False))
    ).drop("_id", "_hit")


def dedup_stream(
    rows: DataFrame, sensor: str, id_col: str, late: str, ts: str = "ts", col: str = "embedding", sim: float = 0.95, gap_us: int = 1_000_000
) -> DataFrame:
    """Streaming form: (sensor, id, ts, is_duplicate) once the watermark has passed a bucket.

    Each row goes to its own gap-long bucket and, as history, to the next one, so a bucket closes
    with all it needs. State is what a sensor sends in two gaps.
    """
    home = _time_bucket(ts, gap_us)
    copies = F.explode(
        F.array(
            F.struct(home.alias("bucket"), F.lit(True).alias("own")),
            F.struct((home + 1).alias("bucket"), F.lit(False).alias("own")),
        )
    )
    spread = rows.select(
        F.col(sensor).alias("sensor"), F.col(id_col).cast("long").alias("id"), F.unix_micros(ts).alias("t"),
        F.col(col).cast("array<double>").alias("x"), copies.alias("_c"),
    )
    start = F.timestamp_micros(F.col("_c.bucket") * F.lit(gap_us))
    timed = spread.withColumn("bucket_ts", start).withWatermark("bucket_ts", late)
    width = f"{gap_us} microseconds"
    grouped = timed.groupBy("sensor", F.window("bucket_ts", width).alias("w")).agg(
        F.collect_list(F.struct("id", "t", F.col("_c.own").alias("own"), "x")).alias("rows")
    )

    def flags(groups: pa.Array) -> pa.Array:
        out = []
        for group in groups:
            items = group.values
            own = items.field("own").to_numpy(zero_copy_only=False)
            ids, t = items.field("id").to_numpy(), items.field("t").to_numpy()
            x = unit_rows(to_matrix(items.field("x"))[1])
            dup = _duplicate_flags(t[own], ids[own], x[own], t, ids, x, gap_us, sim)
            out.append([{"id": int(i), "t": int(s), "is_duplicate": bool(d)} for i, s, d in zip(ids[own], t[own], dup)])
        return pa.array(out, pa.list_(pa.struct([("id", pa.int64()), ("t", pa.int64()), ("is_duplicate", pa.bool_())])))

    mark = F.arrow_udf(flags, "array<struct<id: long, t: long, is_duplicate: boolean>>")
    return grouped.select("sensor", F.explode(mark("rows")).alias("r")).select(
        "sensor", F.col("r.id").alias("id"), F.timestamp_micros("r.t").alias("ts"), "r.is_duplicate"
    )


# ---- sinks --------------------------------------------------------------------------------------


def run_to_folder(stream: DataFrame, mode: str = "append", name: str = "stream", transform: Callable | None = None, folder: str | None = None):
    """Process everything available, one folder per micro-batch; returns (folder, query)."""
    spark = stream.sparkSession
    folder = folder or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, batch_id: int) -> None:
        out = transform(batch) if transform else batch
        out.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    return folder, query


def read_folder(spark: SparkSession, folder: str, latest_only: bool = False) -> DataFrame:
    """All micro-batches, or the last one (complete mode, where it holds the whole result)."""
    out = spark.read.parquet(f"{folder}/out")
    if latest_only:
        files = out.inputFiles()  # an empty batch has a file too
        out = out.where(F.col("batch") == max(int(re.search(r"/batch=(\d+)/", f)[1]) for f in files))
    return out.drop("batch")


class LateRows(StreamingQueryListener):
    """Adds up the rows that watermarks discard, over all progress reports of each query run."""

    def __init__(self):
        self.dropped: dict[str, int] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        self.dropped.setdefault(str(event.runId), 0)

    def onQueryProgress(self, event) -> None:
        late = sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)
        run = str(event.progress.runId)
        self.dropped[run] = self.dropped.get(run, 0) + late

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.runId))

    def of(self, query, wait: float = 30.0) -> int:
        """Rows dropped by a query run that has ended."""
        until = time.monotonic() + wait
        while str(query.runId) not in self.ended and time.monotonic() < until:
            time.sleep(0.05)
        return self.dropped.get(str(query.runId), 0)


def count_late_rows(spark: SparkSession, run: Callable[[], tuple]) -> tuple:
    """Call ``run`` (which returns (folder, query)) and add the number of late rows that its query dropped."""
    listener = LateRows()
    spark.streams.addListener(listener)
    try:
        folder, query = run()
        return folder, query, listener.of(query)
    finally:
        spark.streams.removeListener(listener)


def authenticate_stream(packets: DataFrame, load_registry: Callable[[], DataFrame], thr: float = MATCH_THRESHOLD, folder: str | None = None):
    """Authenticate micro-batches; the registry is loaded anew for each, so enrolments take effect."""
    return run_to_folder(packets, "append", "auth", lambda batch: authenticate(batch, load_registry(), thr), folder)


class VersionedTable:
    """A small table kept by foreachBatch: every micro-batch writes a new version made from the last one.

    A version is named after its batch, so a repeated batch rebuilds the same version from its
    predecessor instead of applying its rows twice.
    """

    def __init__(self, spark: SparkSession, folder: str, start: DataFrame):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), start.schema
        start.write.mode("overwrite").parquet(f"{self.folder}/version=-1")

    def version(self, batch_id: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/version={batch_id}")

    def newest(self) -> DataFrame:
        files = self.spark.read.schema(self.schema).parquet(f"{self.folder}/version=*").inputFiles()  # an empty version has a file too
        return self.version(max((int(re.search(r"/version=(-?\d+)/", f)[1]) for f in files), default=-1))

    def sink(self, step: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
        def write(batch: DataFrame, batch_id: int) -> None:
            out = step(self.version(batch_id - 1), batch).select(*self.schema.names)
            out.write.mode("overwrite").parquet(f"{self.folder}/version={batch_id}")

        return write

    def run(self, stream: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame]):
        query = (
            stream.writeStream.option("checkpointLocation", f"{self.folder}-checkpoint")
            .trigger(availableNow=True)
            .foreachBatch(self.sink(step))
            .start()
        )
        query.awaitTermination()
        return query


def touch_registry(table: VersionedTable, detections: DataFrame):
    """Keep last_seen and detection_count current from a stream of detections."""
    return table.run(detections, lambda registry, batch: touch(registry, batch))


def upsert_registry(table: VersionedTable, enrolments: DataFrame):
    """Apply a stream of enrolments to the registry."""

    def step(registry: DataFrame, batch: DataFrame) -> DataFrame:
        cols = [c for c in registry.columns if c != "serial"]
        newest = batch.groupBy("serial").agg(F.max_by(F.struct(*cols), latest(cols)).alias("_r")).select("serial", "_r.*")
        return upsert(registry, newest)

    return table.run(enrolments, step)


def history_stream(table: VersionedTable, rows: DataFrame, by: str, ts: str, n: int = 128, tie: str | None = None):
    """Keep the last n rows of every key."""
    return table.run(
        rows, lambda kept, batch: recent_history(kept.unionByName(batch.select(*kept.columns)), by, ts, n, tie)
    )
