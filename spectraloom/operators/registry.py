"""The fingerprint registry: a table keyed by serial, kept current by upserts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.operators.moments import centroid

REGISTRY_COLUMNS = ["serial", "drone_type", "fingerprint", "enrolled_at", "notes", "last_seen", "detection_count"]
REGISTRY_SCHEMA = (
    "serial string, drone_type string, fingerprint array<double>, enrolled_at timestamp, notes string, "
    "last_seen timestamp, detection_count long"
)
UTC_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def latest(columns: list[str], version: str = "enrolled_at") -> Column:
    """Order key for the newest row: a row without a time is oldest, equal times go by the other columns."""
    return F.struct(version, *[c for c in columns if c != version])


def upsert(current: DataFrame, new: DataFrame, key: str = "serial", version: str = "enrolled_at") -> DataFrame:
    """Newest row per key; on equal versions the new side wins. An aggregate, so hot keys combine early."""
    cols = current.columns
    both = current.withColumn("_side", F.lit(0)).unionByName(new.select(*cols).withColumn("_side", F.lit(1)))
    pick = F.max_by(F.struct(*[c for c in cols if c != key]), F.struct(F.col(version), F.col("_side")))
    return both.groupBy(key).agg(pick.alias("_r")).select(key, "_r.*").select(*cols)


def enroll_from_packets(packets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(registry rows, rejected packets with a reason). A packet needs a serial and a fingerprint."""
    reason = F.when(F.col("fingerprint").isNull(), "no fingerprint").when(
        F.col("serial").isNull() | (F.col("serial") == ""), "no serial"
    )
    checked = packets.withColumn("reason", reason)
    accepted = checked.where("reason IS NULL").select(
        "serial",
        "drone_type",
        F.col("fingerprint").cast("array<double>").alias("fingerprint"),
        F.col("ts").alias("enrolled_at"),
        F.lit("").alias("notes"),
        F.lit(None).cast("timestamp").alias("last_seen"),
        F.lit(0).cast("long").alias("detection_count"),
    )
    cols = [c for c in REGISTRY_COLUMNS if c != "serial"]
    newest = F.max_by(F.struct(*cols), latest(cols))
    rows = accepted.groupBy("serial").agg(newest.alias("_r")).select("serial", "_r.*")
    return rows, checked.where("reason IS NOT NULL")


def enroll_means(df: DataFrame, type_col: str, col: str = "embedding", enrolled_at=None) -> DataFrame:
    """One registry row per type: the mean of its embeddings."""
    at = F.current_timestamp() if enrolled_at is None else F.lit(enrolled_at).cast("timestamp")
    return centroid(df, col, type_col).select(
        F.col(type_col).cast("string").alias("serial"),
        F.col(type_col).cast("string").alias("drone_type"),
        F.col("centroid").alias("fingerprint"),
        at.alias("enrolled_at"),
        F.lit("").alias("notes"),
        F.lit(None).cast("timestamp").alias("last_seen"),
        F.col("n").alias("detection_count"),
    )


def find_by_serial(df: DataFrame, registry: DataFrame, serial: str) -> DataFrame:
    """Left look-up by serial; the join strategy is left to the optimizer."""
    right = registry.select(
        F.col("serial").alias("_s"), F.col("drone_type").alias("enrolled_type"),
        F.col("fingerprint").alias("enrolled_fingerprint"),
    )
    return df.join(right, F.col(serial) == F.col("_s"), "left").withColumn(
        "is_enrolled", F.col("_s").isNotNull()
    ).drop("_s")


def touch(registry: DataFrame, detections: DataFrame, serial: str = "serial", ts: str = "ts") -> DataFrame:
    """Bring last_seen and detection_count up to date from detections."""
    seen = detections.groupBy(F.col(serial).alias("_s")).agg(
        F.max(ts).alias("_seen"), F.count(F.lit(1)).alias("_n")
    )
    joined = registry.join(seen, F.col("serial") == F.col("_s"), "left")
    return joined.select(
        *[c for c in registry.columns if c not in ("last_seen", "detection_count")],
        F.greatest("last_seen", "_seen").alias("last_seen"),
        (F.coalesce("detection_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("detection_count"),
    ).select(*registry.columns)


def save_registry(registry: DataFrame, path: str) -> str:
    """Write a new version next to the old ones and return its folder; readers never see half a file."""
    version = f"{path.rstrip('/')}/version={uuid.uuid4().hex}"
    registry.write.parquet(version)
    spark = registry.sparkSession
    stamp = spark.range(1).select(F.current_timestamp().alias("written_at"), F.lit(version).alias("folder"))
    stamp.write.mode("append").parquet(f"{path.rstrip('/')}-versions")
    return version


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    newest = spark.read.parquet(f"{path.rstrip('/')}-versions").agg(F.max_by("folder", "written_at")).first()[0]
    return spark.read.schema(REGISTRY_SCHEMA).parquet(newest)


def list_registry(registry: DataFrame) -> DataFrame:
    return registry.select(
        "serial", "drone_type", F.date_format("enrolled_at", UTC_FORMAT).alias("enrolled_at"), "detection_count"
    )
