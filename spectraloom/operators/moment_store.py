"""Stored partial moments: fits that follow enrolment and removal without reading old vectors.

A slice (a type, a day) is one row: n, mean, and the scatter about that mean. Slices merge pairwise; a slice that goes is taken out of the merged
row again, so neither step touches vectors. Working about the means keeps what a difference of large sums would lose.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.functions.arrow import to_list_array, to_matrix
from spectraloom.operators.moments import scatter

NAMES = ["n", "mean", "scatter"]
SHAPE = "n long, mean array<double>, scatter array<double>"
Part = tuple[int, np.ndarray, np.ndarray]


def merge(a: Part, b: Part) -> Part:
    """Moments of two sets of rows together."""
    n = a[0] + b[0]
    if not a[0] or not b[0]:
        return a if a[0] else b
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def remove(whole: Part, part: Part) -> Part:
    """Moments of what is left of a set without some of its rows."""
    n = whole[0] - part[0]
    if n < 0:
        raise ValueError("more rows are taken out than there are")
    if not n or not part[0]:
        return (0, np.zeros_like(whole[1]), np.zeros_like(whole[2])) if not n else whole
    mean = whole[1] + (whole[1] - part[1]) * (part[0] / n)
    gap = part[1] - mean
    return n, mean, whole[2] - part[2] - np.outer(gap, gap) * (n * part[0] / whole[0])


def slice_moments(rows: DataFrame, by: list[str], col: str = "embedding", l2: bool = False) -> DataFrame:
    """One row per group of ``by``: n, mean, scatter (row-major). Null vectors are left out."""

    def centred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n = batch.column("n").to_numpy()
                s, xx = to_matrix(batch.column("s"))[1], to_matrix(batch.column("xx"))[1]
                mean = s / n[:, None]
                about = xx.reshape(len(n), s.shape[1], -1) - np.einsum("ri,rj->rij", s, mean)
                keys = [batch.column(b) for b in by]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(n), to_list_array(mean), to_list_array(about.reshape(len(n), -1))], names=[*by, *NAMES])

    sums = scatter(rows, col, by, l2)
    keys = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in sums.select(*by).schema.fields)
    return sums.select(*by, "n", "s", "xx").mapInArrow(centred, keys + SHAPE)


def _parts(table) -> list[Part]:
    mean, about = to_matrix(table.column("mean"))[1], to_matrix(table.column("scatter"))[1]
    d = mean.shape[1] if len(mean) else 0
    return [(int(n), m, s.reshape(d, d)) for n, m, s in zip(table.column("n").to_pylist(), mean, about)]


def _row(part: Part) -> list[pa.Array]:
    return [pa.array([part[0]], pa.int64()), to_list_array(part[1][None]), to_list_array(part[2].reshape(1, -1))]


def _folded(slices: DataFrame, flag: str) -> DataFrame:
    """One row per value of ``flag``: slices are merged inside each task before they meet."""

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, Part] = {}
        for batch in batches:
            for key, part in zip(batch.column(0).to_pylist(), _parts(batch)):
                held[key] = merge(held[key], part) if key in held else part
        for key, part in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([key]), *_row(part)], names=[flag, *NAMES])

    def meet(table: pa.Table) -> pa.Table:
        return pa.table([table.column(flag).slice(0, 1), *_row(reduce(merge, _parts(table)))], names=[flag, *NAMES])

    shape = f"{flag} boolean, {SHAPE}"
    return slices.select(flag, *NAMES).mapInArrow(inside, shape).groupBy(flag).applyInArrow(meet, shape)


def combine(slices: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """n, mean, scatter of all slices together, without the rows of the slices in ``gone``; no row where nothing is left."""
    marked = slices.select(F.lit(False).alias("out"), *NAMES)
    if gone is not None:
        marked = marked.unionAll(gone.select(F.lit(True).alias("out"), *NAMES))

    def last(table: pa.Table) -> pa.Table:
        parts = dict(zip(table.column("out").to_pylist(), _parts(table)))
        left = remove(parts[False], parts[True]) if len(parts) == 2 else parts.get(False)
        if left is None or not left[0]:
            return pa.table([table.column(c).slice(0, 0) for c in NAMES], names=NAMES)
        return pa.table(_row(left), names=NAMES)

    return _folded(marked, "out").groupBy().applyInArrow(last, SHAPE)


def covariance_rows(moments: DataFrame, ddof: int = 1) -> DataFrame:
    """i, j, cov of a combined row, i <= j, 1-based."""
    cell = F.explode(F.expr("flatten(transform(sequence(1, size(mean)), i -> transform(sequence(i, size(mean)), j -> struct(i, j))))"))
    value = F.expr("element_at(scatter, (_c.i - 1) * size(mean) + _c.j)") / (F.col("n") - ddof)
    return moments.withColumn("_c", cell).select(F.col("_c.i").cast("long").alias("i"), F.col("_c.j").cast("long").alias("j"), value.alias("cov"))
