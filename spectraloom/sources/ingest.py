"""From recordings to stored spectrogram rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.operators.signal import drop_garbage, stft
from spectraloom.sources.catalog import append_manifest, append_samples
from spectraloom.sources.iq import chunk_segments, read_iq


def spectrogram_rows(
    spark: SparkSession, path: str, drone_type: str, split: str = "train", segment_len: int = 65_536, stride: int | None = None,
    n_fft: int = 1024, hop: int = 256, size: int = 256, chunk: int = 65_536, features: str = "log_phase",
) -> DataFrame:
    """Recordings -> segments -> spectrograms -> garbage filter; lazy and without a shuffle."""
    chunks = read_iq(spark, path, chunk=chunk, halo=segment_len - 1)
    segments = chunk_segments(chunks, chunk, segment_len, stride)
    rows = stft(segments, n_fft=n_fft, hop=hop, size=(size, size), features=features)
    return drop_garbage(rows).withColumn("drone_type", F.lit(drone_type)).withColumn("split", F.lit(split))


def ingest(spark: SparkSession, path: str, store: str, drone_type: str, split: str = "train", **options) -> None:
    """Append the spectrograms of a folder of recordings and note each file. Raw files are kept."""
    run = uuid.uuid4().hex
    rows = spectrogram_rows(spark, path, drone_type, split, **options).withColumn("ingest_run", F.lit(run))
    append_samples(rows, store)
    done = (
        spark.read.parquet(store)
        .where((F.col("drone_type") == drone_type) & (F.col("split") == split) & (F.col("ingest_run") == run))
        .groupBy("recording_id")
        .agg(F.count(F.lit(1)).alias("n_samples"))
        .withColumn("drone_type", F.lit(drone_type))
        .withColumn("split", F.lit(split))
    )
    append_manifest(spark, done, f"{store.rstrip('/')}-manifest")
