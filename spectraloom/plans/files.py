"""Round trips: a given table written in a source format to the shared folder and read back."""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from spectraloom.functions import vectors as V
from spectraloom.operators import gaussian as G
from spectraloom.operators import signal as S
from spectraloom.plans.base import LONG_CTE, SAMPLES_CTE, R, query, r, samples, table
from spectraloom.session import shared_dir
from spectraloom.sources import catalog, ingest, iq


def new_folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Partitions over which recordings are dealt to be written, so that few of them share a task.
WRITERS = 64


def write_files(rows, folder: str, suffixes: tuple[str, ...], text: bool = False) -> str:
    """One file per recording with its vectors one after another, as float32 pairs or as text; a task appends sorted rows to the file, batch after batch."""

    def values(vectors: pa.Array) -> bytes:
        flat = vectors.flatten().fill_null(float("nan"))
        if not text:
            return flat.to_numpy(zero_copy_only=False).astype("<f4", copy=False).tobytes()
        return ",".join(map(repr, flat.cast(pa.float64()).to_pylist())).encode()

    def write(batches):
        from pyarrow.fs import FileSystem

        system, root = FileSystem.from_uri(iq._uri(folder))
        now, out, n = None, None, 0
        try:
            for batch in batches:
                recordings = batch.column(0).to_numpy()
                starts = np.flatnonzero(np.diff(recordings, prepend=recordings[:1] - 1))
                for start, stop in zip(starts, [*starts[1:], len(recordings)]):
                    rec = int(recordings[start])
                    data = values(batch.column(1).slice(start, stop - start))
                    if rec != now:
                        if out:
                            out.close()
                        system.create_dir(f"{root}/part{rec % 2}", recursive=True)
                        out, now = system.open_output_stream(f"{root}/part{rec % 2}/rec{rec:02d}{suffixes[rec % len(suffixes)]}"), rec
                    elif text:
                        data = b"," + data
                    out.write(data)
                    n += len(data)
        finally:
            if out:
                out.close()
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    dealt = rows.select("recording_id", "sample_id", F.col("embedding").cast("array<float>").alias("x")).repartition(WRITERS, "recording_id")
    dealt.sortWithinPartitions("recording_id", "sample_id").select("recording_id", "x").mapInArrow(write, "n long").agg(F.sum("n")).collect()
    return folder


IQ_SQL = SAMPLES_CTE + """,
flat AS (SELECT recording_id, (dense_rank() OVER (PARTITION BY recording_id ORDER BY sample_id) - 1) * 64 + d - 1 AS p, x
  FROM (SELECT recording_id, sample_id, unnest(range(1, 65)) AS d, CAST(CAST(unnest(embedding) AS FLOAT) AS DOUBLE) AS x FROM samples)),
pair AS (SELECT recording_id, p // 2 AS s, max(x) FILTER (p % 2 = 0) AS i, max(x) FILTER (p % 2 = 1) AS q FROM flat GROUP BY ALL)"""


def chunk_sql(names: str) -> str:
    return f"""WITH {IQ_SQL} SELECT {names} AS recording_id, s // 100 * 100 AS start_sample, count(*) AS n, {R('sum(i)', 4)} AS sum_i, {R('sum(q * (s % 100 + 1))', 4)} AS weighted_q
FROM pair GROUP BY ALL"""


def chunk_rows(chunks):
    weighted = F.aggregate(F.transform(V.as_doubles("q"), lambda x, k: x * (k + 1)), F.lit(0.0), lambda a, x: a + x)
    return chunks.select(
        "recording_id", "start_sample", F.size("i").cast("long").alias("n"), r(V.vec_sum("i"), 4).alias("sum_i"), r(weighted, 4).alias("weighted_q")
    )


NAME_SQL = "'part' || (recording_id % 2) || '/rec' || lpad(CAST(recording_id AS VARCHAR), 2, '0') || "


@query("A1 A2 A4", chunk_sql(NAME_SQL + "CASE WHEN recording_id % 3 = 0 THEN '.dat' WHEN recording_id % 3 = 1 THEN '.bin' ELSE '.cf32' END"))
def raw_recordings_read_back(spark, sf_dir):
    """Interleaved pairs under three suffixes, read by byte ranges of 250 samples in chunks of 100."""
    folder = write_files(samples(spark, sf_dir), new_folder(spark, "iq"), (".dat", ".bin", ".cf32"))
    return chunk_rows(iq.read_iq(spark, folder, chunk=100, range_samples=250))


@query("A3 A4", chunk_sql(NAME_SQL + "'.csv'"))
def text_recordings_read_back(spark, sf_dir):
    """Every recording as text, written by as many tasks as there are recordings."""
    folder = write_files(samples(spark, sf_dir), new_folder(spark, "csv"), (".csv",), text=True)
    return chunk_rows(iq.read_iq(spark, folder, chunk=100))


@query("A1 A2 A4", chunk_sql(NAME_SQL + "CASE WHEN recording_id % 2 = 0 THEN '.dat' ELSE '.bin' END"))
def raw_recordings_all_read_back(spark, sf_dir):
    """Every recording as interleaved pairs under one of two suffixes."""
    folder = write_files(samples(spark, sf_dir), new_folder(spark, "iq"), (".dat", ".bin"))
    return chunk_rows(iq.read_iq(spark, folder, chunk=100, range_samples=250))


@query("A3 A4", chunk_sql(NAME_SQL + "'.csv'"))
def text_recordings_all_read_back(spark, sf_dir):
    """Every recording as text."""
    folder = write_files(samples(spark, sf_dir), new_folder(spark, "csv"), (".csv",), text=True)
    return chunk_rows(iq.read_iq(spark, folder, chunk=100))


@query("A5", f"WITH {SAMPLES_CTE} SELECT {NAME_SQL} '.iq' AS name, '.iq' AS suffix, count(*) * 256 AS length FROM samples GROUP BY recording_id")
def list_recordings_of_folder(spark, sf_dir):
    folder = write_files(samples(spark, sf_dir), new_folder(spark, "list"), (".iq",))
    return iq.list_recordings(spark, folder).select(iq.recording_name(F.col("path"), folder).alias("name"), "suffix", "length")


@query("K5", chunk_sql(NAME_SQL + "'.cf32'"))
def iq_data_source_read_back(spark, sf_dir):
    """The same chunks through ``spark.read.format("iq")``."""
    folder = write_files(samples(spark, sf_dir), new_folder(spark, "source"), (".cf32",))
    spark.dataSource.register(iq.IqDataSource)
    return chunk_rows(spark.read.format("iq").option("chunk", 100).option("rangesamples", 300).load(folder))


@query("A6", "SELECT n_nationkey AS file, pos, key, text, TRY_CAST(text AS DOUBLE) AS number FROM (SELECT n_nationkey, unnest(range(0, 4)) AS pos, unnest(['Name', 'Region', 'Region', 'Empty']) AS key, unnest([n_name, CAST(n_regionkey AS VARCHAR), CAST(n_regionkey + 1 AS VARCHAR), NULL]) AS text FROM nation)")
def xml_metadata_read_back(spark, sf_dir):
    """A companion file per nation under two root names, with a repeated and an empty child."""
    folder = new_folder(spark, "xml")
    root = F.when(F.col("n_nationkey") % 2 == 0, "rec").otherwise("meta")
    body = F.format_string("<%s><Name>%s</Name><Region>%d</Region><Region>%d</Region><Empty/></%s>", root, "n_name", "n_regionkey", F.col("n_regionkey") + 1, root)
    table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("file"), body.alias("value")).repartition("file").write.partitionBy("file").text(folder)
    rows = catalog.read_xml_meta(spark, f"{folder}/file=*")
    return rows.select(F.regexp_extract("path", r"file=(\d+)", 1).cast("int").alias("file"), "pos", "key", "text", "number")


@query("A21", f"WITH m AS (SELECT l_returnflag AS run_id, avg(l_discount) AS auc, avg(l_tax) AS fpr FROM lineitem GROUP BY 1) SELECT run_id, 'auc' AS metric, {R('auc')} AS value FROM m UNION ALL SELECT run_id, 'fpr', {R('fpr')} FROM m")
def metric_files_read_back(spark, sf_dir):
    """Metrics written as JSON files and parsed again."""
    wide = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("run_id")).agg(F.avg(F.col("l_discount").cast("double")).alias("auc"), F.avg(F.col("l_tax").cast("double")).alias("fpr"))
    folder = new_folder(spark, "metrics")
    catalog.write_metrics(wide, ["run_id"], folder)
    lines = spark.read.text(folder).select(F.from_json("value", "run_id string, metric string, value double").alias("m")).select("m.*")
    return lines.select("run_id", "metric", r("value").alias("value"))


@query("A19", f"WITH {LONG_CTE} SELECT label, d AS dim, {R('avg(x)')} AS mean FROM long WHERE split = 'train' GROUP BY ALL")
def models_saved_and_loaded(spark, sf_dir):
    """One Gaussian per type through the model store; the centroids come back."""
    path = new_folder(spark, "models")
    G.save_model(G.fit_gaussian(samples(spark, sf_dir).where("split = 'train'"), by=["label"], l2=False), path)
    back = G.load_model(spark, path)
    return back.select("label", F.posexplode("centroid").alias("p", "m")).select("label", (F.col("p") + 1).cast("long").alias("dim"), r("m").alias("mean"))


@query(
    "A15",
    f"""WITH {LONG_CTE}, z AS (SELECT sample_id, d, CASE WHEN d > 32 AND label % 2 = 0 AND sample_id % 3 = 0 THEN 0 ELSE x END AS x FROM long),
e AS (SELECT sample_id, sum(abs(x)) FILTER (d > 32) < 1e-6 AS empty FROM z GROUP BY 1)
SELECT z.sample_id, {R('sum(CASE WHEN empty AND z.d > 32 THEN a.x ELSE z.x END * z.d)', 4)} AS weighted FROM z JOIN e USING (sample_id) JOIN z a ON a.sample_id = z.sample_id AND a.d = CASE WHEN z.d > 32 THEN z.d - 32 ELSE z.d END GROUP BY 1""",
)
def empty_channel_backfilled(spark, sf_dir):
    """Two 4 x 8 channels per vector; an emptied second channel is filled from the first."""
    rows = samples(spark, sf_dir)
    emptied = F.when((F.col("label") % 2 == 0) & (F.col("sample_id") % 3 == 0), F.concat(F.slice("embedding", 1, 32), F.array_repeat(F.lit(0.0), 32))).otherwise(F.col("embedding"))
    planes = rows.select("sample_id", emptied.alias("spec"), F.lit(2).alias("c"), F.lit(4).alias("h"), F.lit(8).alias("w"))
    out = S.backfill_channel(planes, 0, 1, F.lit(True))
    weighted = F.aggregate(F.transform("spec", lambda x, k: x * (k + 1)), F.lit(0.0), lambda a, x: a + x)
    return out.select("sample_id", r(weighted, 4).alias("weighted"))


@query("A13", f"WITH {SAMPLES_CTE} SELECT split, count(*) AS runs, sum(n) AS n FROM (SELECT split, label, count(*) AS n FROM samples GROUP BY ALL) GROUP BY split")
def manifest_appended(spark, sf_dir):
    """Processing records appended per type, read back per split."""
    path = new_folder(spark, "manifest")
    counts = samples(spark, sf_dir).groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))
    for side in ("train", "holdout", "negatives"):
        catalog.append_manifest(spark, counts.where(F.col("split") == side), path)
    return spark.read.parquet(path).where("processed_at IS NOT NULL").groupBy("split").agg(F.count(F.lit(1)).alias("runs"), F.sum("n").alias("n"))


@query(
    "A14 A10 A13",
    f"""WITH {SAMPLES_CTE}, rec AS (SELECT recording_id, CAST(floor((count(*) * 32 - 256) / 128) + 1 AS BIGINT) AS n FROM samples GROUP BY 1 HAVING count(*) >= 8),
kind AS (SELECT *, CASE WHEN recording_id % 2 = 0 THEN 'even' ELSE 'odd' END AS drone_type FROM rec)
SELECT drone_type, 'rec' || lpad(CAST(recording_id AS VARCHAR), 2, '0') || '.dat' AS recording, n, n AS in_manifest, 2 AS c, 8 AS h, 8 AS w,
 CAST(0 AS DOUBLE) + 1 AS energy, CAST(sum(n) OVER (PARTITION BY drone_type) - 1 AS BIGINT) AS last_no, CAST(sum(n) OVER (PARTITION BY drone_type) AS BIGINT) AS numbers FROM kind""",
)
def recordings_ingested(spark, sf_dir):
    """Every recording from its file to spectrogram rows of the store, type after type, with numbers and manifest."""
    raw, store = new_folder(spark, "raw"), new_folder(spark, "ingested")
    write_files(samples(spark, sf_dir), raw, (".dat",))
    for kind, part in (("even", "part0"), ("odd", "part1")):
        ingest.ingest(spark, f"{raw}/{part}", store, kind, segment_len=256, n_fft=32, hop=8, size=8, chunk=1024)
    rows = spark.read.parquet(store).withColumn("recording", F.regexp_extract("recording_id", r"([^/]+)$", 1))
    energy = F.aggregate(V.as_doubles("spec"), F.lit(0.0), lambda a, x: a + x * x) / F.size("spec")
    per = rows.groupBy("drone_type", "recording").agg(
        F.count(F.lit(1)).alias("n"), *[F.max(x).alias(x) for x in "chw"], r(F.avg(energy), 3).alias("energy")
    )
    numbered = rows.groupBy("drone_type").agg(F.max("sample_no").cast("long").alias("last_no"), F.count_distinct("sample_no").alias("numbers"))
    noted = spark.read.parquet(f"{store}-manifest").select(
        "drone_type", F.regexp_extract("recording_id", r"([^/]+)$", 1).alias("recording"), F.col("n_samples").alias("in_manifest")
    )
    return per.join(noted, ["drone_type", "recording"]).join(numbered, "drone_type")


def gray_png(pixels: np.ndarray) -> bytes:
    """An 8-bit grey image as PNG bytes."""
    h, w = pixels.shape

    def part(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    lines = np.hstack([np.zeros((h, 1), np.uint8), pixels]).tobytes()  # every line begins with its filter
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def write_images(rows, folder: str) -> str:
    """One 8 x 8 grey image per vector, its components as bytes 0 to 255; written by the tasks."""

    def write(frames):
        from pyarrow.fs import FileSystem

        system, root = FileSystem.from_uri(iq._uri(folder))
        for frame in frames:
            for name, rec, values in zip(frame["sample_id"], frame["recording_id"], frame["embedding"]):
                system.create_dir(f"{root}/rec{rec}", recursive=True)
                pixels = np.clip(np.floor((np.asarray(values) + 1.0) * 127.5), 0, 255).astype(np.uint8).reshape(8, 8)
                with system.open_output_stream(f"{root}/rec{rec}/v{name}.png") as out:
                    out.write(gray_png(pixels))
            yield pd.DataFrame({"n": [len(frame)]})

    rows.select("sample_id", "recording_id", "embedding").mapInPandas(write, "n long").agg(F.sum("n")).collect()
    return folder


@query(
    "A9",
    f"""WITH {SAMPLES_CTE}, px AS (SELECT sample_id, unnest(range(0, 64)) AS k, least(255, greatest(0, floor((unnest(embedding) + 1.0) * CAST(127.5 AS DOUBLE)))) / 255 AS x FROM samples),
st AS (SELECT sample_id, avg(x) AS m, stddev_pop(x) AS s FROM px GROUP BY 1)
SELECT sample_id, 3 AS c, 8 AS h, 8 AS w, {R('sum(CAST((x - m) / (CASE WHEN s < 1e-6 THEN 1 ELSE s END) AS FLOAT) * CAST(3 * k + 192 AS DOUBLE))', 2)} AS weighted
FROM px JOIN st USING (sample_id) GROUP BY sample_id""",
)
def spectrogram_images_read_back(spark, sf_dir):
    """Every vector as a grey image file, read as three equal standardised channels."""
    folder = write_images(samples(spark, sf_dir), new_folder(spark, "images"))
    images = iq.read_spectrogram_images(spark, folder, 8)
    weighted = F.aggregate(F.transform(V.as_doubles("spec"), lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return images.select(F.regexp_extract("path", r"/v(\d+)\.png$", 1).cast("long").alias("sample_id"), "c", "h", "w", r(weighted, 2).alias("weighted"))
