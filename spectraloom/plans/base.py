"""Query catalogue: each query is registered once with its check SQL and what it covers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.functions import vectors as V


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    covers: str
    oracle: str | None


CATALOGUE: dict[str, Query] = {}


def query(covers: str, oracle: str | None = None):
    def register(fn):
        if fn.__name__ in CATALOGUE:
            raise ValueError(f"query {fn.__name__} registered twice")
        CATALOGUE[fn.__name__] = Query(fn.__name__, fn, covers, oracle)
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(col: Column | str, places: int = 6) -> Column:
    """Rounded double without negative zero, so two engines agree on the printed value."""
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col.cast("double"), places) + F.lit(0.0)


def R(expr: str, places: int = 6) -> str:
    """SQL twin of ``r``."""
    return f"(round(CAST({expr} AS DOUBLE), {places}) + CAST(0 AS DOUBLE))"


# Roles of the given tables: labels 0-5 train types, 6-7 holdout types, 8-9 negatives.
SPLIT_SQL = "CASE WHEN label <= 5 THEN 'train' WHEN label <= 7 THEN 'holdout' ELSE 'negatives' END"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedding table in the role of the encoded sample store."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("sample_id"),
        F.col("label"),
        F.expr(SPLIT_SQL).alias("split"),
        (F.col("vec_id") % 20).alias("recording_id"),
        V.as_doubles("embedding").alias("embedding"),
    )


SAMPLES_CTE = f"""samples AS (
  SELECT vec_id AS sample_id, label, {SPLIT_SQL} AS split, vec_id % 20 AS recording_id,
         CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)"""

# Long form (one row per sample and dimension) used by the check SQL only.
LONG_CTE = SAMPLES_CTE + """,
long AS (SELECT sample_id, label, split, recording_id, unnest(embedding) AS x,
                unnest(range(1, len(embedding) + 1)) AS d FROM samples)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table in the role of packets and detections, with a real timestamp."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
