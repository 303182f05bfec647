"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.session import shared_dir

ASCII_SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: fixes the rows and cuts the lineage.

    The write's shuffle files are of no use afterwards and are removed with it.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder below the shared one."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(df: DataFrame) -> None:
    """Remove the folder of a ``stored`` table that nothing reads any more."""
    files = df.inputFiles()
    if files:
        remove(df.sparkSession, files[0].rsplit("/", 1)[0])


#: A table of ids is sent to the tasks up to this many rows (8 bytes each), and shuffled beyond.
IDS_AT_MOST = 4_000_000


def shippable(ids: DataFrame) -> DataFrame:
    """One-column ids, with a broadcast hint where a count shows that there are few."""
    return F.broadcast(ids) if ids.count() <= IDS_AT_MOST else ids


def whole(text: str | Column) -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only, whatever the locale."""
    return F.translate(col, UPPER, LOWER)


def byte_length(col: Column) -> Column:
    return F.octet_length(col).cast("long")


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
