"""Sample store, manifests, metadata and metric files."""

from __future__ import annotations

from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.operators.prefix import ordered_rank

RANK_BLOCK = 65_536
KEY_BLOCK = 1024
NAME_HEAD, NAME_TAIL = 8, 4


def parse_path(col: Column | str, part: int = 3) -> tuple[Column, Column]:
    """(type, split) from a slash-separated path: type is the ``part``-th component when there are four or more."""
    c = F.col(col) if isinstance(col, str) else col
    parts = F.split(c, "/")
    kind = F.when(F.size(parts) >= 4, F.get(parts, F.lit(part - 1))).otherwise(F.lit(""))
    split = F.when(F.array_contains(parts, "train"), "train").when(F.array_contains(parts, "valid"), "valid").otherwise("")
    return kind, split


def number_samples(
    new: DataFrame, counts: DataFrame | None, split: str = "split", kind: str = "drone_type", order: tuple[str, str] = ("recording_id", "segment_idx")
) -> DataFrame:
    """Dense sample numbers per (split, type) that go on from the numbers already in the store.

    Ranks are taken inside (recording, segment block), so one recording or type with most of the
    rows is still many tasks.
    """
    blocked = new.withColumn("_blk", F.floor(F.col(order[1]) / RANK_BLOCK))
    ranked = ordered_rank(
        blocked, [split, kind], [order[0], "_blk"], [F.col(order[0]), F.col(order[1])], "sample_no", start=0
    ).drop("_blk")
    if counts is None:
        return ranked
    have = counts.select(F.col(split).alias("_s"), F.col(kind).alias("_k"), F.col("n").alias("_n"))
    joined = ranked.join(have, (F.col(split) == F.col("_s")) & (F.col(kind) == F.col("_k")), "left")
    return joined.withColumn("sample_no", F.col("sample_no") + F.coalesce("_n", F.lit(0))).drop("_s", "_k", "_n")


def append_samples(new: DataFrame, path: str) -> None:
    """Append to the Parquet store, numbered after what is there; partitioned by split and type."""
    spark = new.sparkSession
    counts = None
    try:
        counts = spark.read.parquet(path).groupBy("split", "drone_type").agg(
            (F.max("sample_no") + 1).alias("n")
        )
    except Exception as exc:  # the first append finds no store
        if "PATH_NOT_FOUND" not in str(exc):
            raise
    number_samples(new, counts).write.mode("append").partitionBy("split", "drone_type").parquet(path)


def append_manifest(spark: SparkSession, records: DataFrame, path: str) -> None:
    records.withColumn("processed_at", F.current_timestamp()).write.mode("append").parquet(path)


def list_types(df: DataFrame, split: str = "split", kind: str = "drone_type") -> DataFrame:
    return df.groupBy(split, kind).agg(F.count(F.lit(1)).alias("n"))


def count_samples(df: DataFrame, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n"))


def store_stats(df: DataFrame, split: str = "split", kind: str = "drone_type") -> DataFrame:
    """Counts per type with split subtotals and a grand total (``level`` 0, 1, 3)."""
    return df.rollup(split, kind).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("level")
    )


def build_manifest(df: DataFrame, split: str = "split", kind: str = "drone_type") -> DataFrame:
    """Sorted distinct types per split with their number."""
    types = F.sort_array(F.collect_set(kind))
    return df.groupBy(split).agg(types.alias("types"), F.count_distinct(kind).alias("n_types"))


def explode_samples(groups: DataFrame, group: str, key: str, item: str) -> DataFrame:
    """One row per stored sample in key order, numbered inside its group.

    A group whose keys are all numbers is ordered by number, any other by text. ``item`` is an array of
    samples under one key. Numbers come from key ranges (a block of numbers, or of names with the same beginning),
    so a group that holds most of the samples is still many tasks.
    """
    number = F.expr(f"try_cast({key} AS bigint)")
    kinds = groups.groupBy(F.col(group).alias("_g")).agg(F.bool_and(number.isNotNull()).alias("_numeric"))
    rows = groups.select(group, key, F.posexplode(item).alias("pos", "sample"), number.alias("_num"))
    known = rows.join(kinds, F.col(group).eqNullSafe(F.col("_g"))).drop("_g").withColumn("_num", F.when(F.col("_numeric"), F.col("_num")))
    name = F.when(~F.col("_numeric"), F.col(key).cast("string"))
    # names often end in a running number: what stands before its last NAME_TAIL characters is the block
    head = F.substring(name, F.lit(1), F.greatest(F.char_length(name) - NAME_TAIL, F.lit(0)))
    wide = F.char_length(name)
    same = known.groupBy(F.col(group).alias("_g2")).agg(F.min(wide).alias("_least"), F.max(wide).alias("_most"))
    ranged = known.join(same, F.col(group).eqNullSafe(F.col("_g2"))).withColumn("_blk", F.floor(F.col("_num") / KEY_BLOCK)).withColumn(
        "_head", F.when(F.col("_least") == F.col("_most"), head).otherwise(F.substring(name, 1, NAME_HEAD))
    )
    order = [F.col("_num"), F.col(key), F.col("pos")]
    return ordered_rank(ranged, [group], ["_blk", "_head"], order, "sample_no", start=0).drop("_num", "_numeric", "_blk", "_head", "_g2", "_least", "_most")


def read_xml_meta(spark: SparkSession, path: str) -> DataFrame:
    """Companion XML files as long rows (path, pos, key, text, number); ``number`` where the text is one.

    Keys are the children of each file's root element, whatever their names and the root's; a repeated child
    gives a row each time, an empty one a row without text, and a nested one the text before its first child.
    Files that are not XML give no rows.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")

    def children(batches):
        for batch in batches:
            rows = []
            for name, body in zip(batch["path"], batch["value"]):
                try:
                    root = ElementTree.fromstring(body)
                except ElementTree.ParseError:
                    continue
                rows += [(name, pos, child.tag, child.text) for pos, child in enumerate(root)]
            yield pd.DataFrame(rows, columns=["path", "pos", "key", "text"])

    return files.mapInPandas(children, "path string, pos long, key string, text string").withColumn("number", F.expr("try_cast(text AS double)"))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """All JSON result files as (path, body); files that are not JSON are skipped."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))
    return raw.where(F.expr("try_parse_json(body)").isNotNull())


def write_metrics(metrics: DataFrame, ids: list[str], path: str) -> None:
    """Wide metric columns as long JSON rows (ids, metric, value)."""
    long_metrics(metrics, ids).write.mode("append").json(path)


def long_metrics(metrics: DataFrame, ids: list[str]) -> DataFrame:
    values = [c for c in metrics.columns if c not in ids]
    cast = metrics.select(*ids, *[F.col(c).cast("double").alias(c) for c in values])
    return cast.unpivot(ids, values, "metric", "value")
