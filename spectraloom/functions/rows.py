"""Attaching one-row results to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Add the columns of a one-row table as a scalar subquery: no join, and an error if it has more rows."""
    packed = one.select(F.struct(*one.columns).alias("_one")).scalar()
    return df.withColumn("_one", packed).select(*df.columns, *[F.col(f"_one.{c}").alias(c) for c in one.columns])
