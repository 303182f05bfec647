"""SQL-callable functions, a table function and an aggregate for small groups."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from spectraloom.functions.arrow import normalize_rows, spread, to_matrix


SEGMENT_TYPE = T.StructType(
    [
        T.StructField("segment_idx", T.IntegerType()),
        T.StructField("start_sample", T.IntegerType()),
        T.StructField("values", T.ArrayType(T.DoubleType())),
    ]
)


@F.udtf(returnType=SEGMENT_TYPE)
class Segments:
    """segments(array, length, stride): windows of an array, partial tail dropped."""

    def eval(self, values, length: int, stride: int):
        if values is None:
            return
        for idx, start in enumerate(range(0, len(values) - length + 1, stride)):
            yield idx, start, values[start : start + length]


@F.udtf
class SeriesSegments:
    """series_segments(TABLE(t) PARTITION BY key ORDER BY (time), value, length, stride [, kept columns, comma-separated]).

    Windows over the rows of each partition in its order, for series of any length: the state carried from row to row is the last
    ``length`` values, so a partition is never held whole. The result's columns follow the input: the kept columns (those of the partition,
    as each window's first row has them), segment_idx, start_sample and the values in their own type. The partial tail is dropped; nulls are values.
    """

    @staticmethod
    def analyze(series: AnalyzeArgument, value: AnalyzeArgument, length: AnalyzeArgument, stride: AnalyzeArgument, keep: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not series.isTable:
            raise ValueError("series_segments: the first argument must be TABLE(...)")
        for name, arg in (("value", value), ("length", length), ("stride", stride), *([("keep", keep)] if keep else [])):
            if not arg.isConstantExpression or arg.value is None:
                raise ValueError(f"series_segments: {name} must be a constant")
        if length.value < 1 or stride.value < 1:
            raise ValueError("series_segments: length and stride must be at least 1")
        names = [n.strip() for n in keep.value.split(",")] if keep and keep.value else []
        known = {f.name: f for f in series.dataType}
        missing = [n for n in [value.value, *names] if n not in known]
        if missing:
            raise ValueError(f"series_segments: no column {', '.join(missing)} in the table")
        own = [T.StructField("segment_idx", T.LongType()), T.StructField("start_sample", T.LongType())]
        values = T.StructField("values", T.ArrayType(known[value.value].dataType))
        return AnalyzeResult(schema=T.StructType([*(known[n] for n in names), *own, values]))

    def __init__(self):
        self.window = deque()
        self.at = self.start = self.index = 0

    def eval(self, row, value: str, length: int, stride: int, keep: str | None = None):
        if self.at >= self.start:
            kept = [row[n.strip()] for n in keep.split(",")] if keep else []
            self.window.append((row[value], kept))
        self.at += 1
        if len(self.window) == length:
            yield (*self.window[0][1], self.index, self.start, [v for v, _ in self.window])
            self.index += 1
            self.start += stride
            for _ in range(min(stride, length)):
                self.window.popleft()


@F.pandas_udf(T.DoubleType())
def auc_agg(y: pd.Series, s: pd.Series) -> float:
    """AUC as a grouped aggregate for groups that fit in memory; ``ranking.auc`` has no such limit."""
    rank = s.rank().to_numpy()
    pos = y.to_numpy() == 1
    p, n = int(pos.sum()), int((~pos).sum())
    return float((rank[pos].sum() - p * (p + 1) / 2) / (p * n)) if p and n else None


def mahalanobis_function(spark: SparkSession, model: dict, name: str = "mahalanobis", l2: bool = True) -> None:
    """Register a one-model distance as a SQL function (centroid and whitener are a few KB to MB)."""
    mu, white = np.asarray(model["centroid"]), np.asarray(model["whitener"])
    white = white.reshape(len(mu), -1)

    @F.arrow_udf("double")
    def dist(vectors: pa.Array) -> pa.Array:
        valid, x = to_matrix(vectors)
        if not len(x):
            return pa.nulls(len(valid), pa.float64())
        x = normalize_rows(x) if l2 else x
        return spread(valid, np.sqrt(np.square((x - mu) @ white).sum(axis=1)))

    spark.udf.register(name, dist)


# Rule limits as in operators.signal.intent_rule, version 1.
SQL_FUNCTIONS = [
    """CREATE OR REPLACE TEMPORARY FUNCTION l2_norm(v ARRAY<DOUBLE>) RETURNS DOUBLE
       RETURN sqrt(aggregate(v, 0.0D, (acc, x) -> acc + x * x))""",
    """CREATE OR REPLACE TEMPORARY FUNCTION l2_normalize(v ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE>
       RETURN transform(arrays_zip(v, array_repeat(sqrt(aggregate(v, 0.0D, (acc, x) -> acc + x * x)) + 1e-8D, size(v))),
                        p -> p['v'] / p['1'])""",
    """CREATE OR REPLACE TEMPORARY FUNCTION cosine_sim(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE
       RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0.0D, (acc, x) -> acc + x)
              / (sqrt(aggregate(a, 0.0D, (acc, x) -> acc + x * x)) * sqrt(aggregate(b, 0.0D, (acc, x) -> acc + x * x)))""",
    """CREATE OR REPLACE TEMPORARY FUNCTION intent_rule(tv DOUBLE, ds DOUBLE) RETURNS STRING
       RETURN CASE WHEN tv < 0.5 AND ds < 1.0 THEN 'SURVEILLANCE' WHEN tv > 2.0 OR ds > 3.0 THEN 'ATTACK' ELSE 'TRANSIT' END""",
]


def register_sql(spark: SparkSession) -> None:
    """Make the vector functions, the intent rule, ``segments``, ``series_segments`` and ``auc_agg`` callable from SQL."""
    for statement in SQL_FUNCTIONS:
        spark.sql(statement)
    spark.udtf.register("segments", Segments)
    spark.udtf.register("series_segments", SeriesSegments)
    spark.udf.register("auc_agg", auc_agg)
