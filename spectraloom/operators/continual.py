"""Continual enrolment: verification, drift, enrolment curves and registry repair."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.functions.arrow import unit_rows, to_matrix
from spectraloom.operators.matching import MATCH_THRESHOLD, identify, restrict_to_enrolled
from spectraloom.session import materialize

MAX_STACK_BYTES = 256 << 20


def drift(history: DataFrame, type_col: str, step: str, accuracy: str, threshold: float = 0.05) -> DataFrame:
    """Steps at which a type fell more than ``threshold`` below its best earlier accuracy."""
    w = Window.partitionBy(type_col).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(accuracy).over(w)
    rows = history.withColumn("best", best).withColumn("drop", F.col("best") - F.col(accuracy))
    return rows.where(F.col("drop") > threshold)


def verify(df: DataFrame, registry: DataFrame, type_col: str, df_id: str, col: str = "embedding", thr: float = MATCH_THRESHOLD) -> DataFrame:
    """Identification accuracy per enrolled type; types without an enrolment are left out."""
    known = restrict_to_enrolled(df, registry, type_col)
    found = identify(known, registry, df_id, col, thr)
    right = (F.col("matched") == F.col(type_col).cast("string")) & (F.col("verdict") == "FRIENDLY")
    return found.groupBy(type_col).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(right, F.lit(False)).cast("double")).alias("accuracy")
    )


def _placed(registry: DataFrame, order: list[str], columns: list[str], ranges: int | None = None) -> DataFrame:
    """Registry rows with their place in enrolment order, written once. Only ids and order keys are sorted.

    They are range-partitioned and written with their range number; a window inside each range and the totals of the ranges before it give the place.
    """
    ranges = ranges or max(1, int(registry.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [*order, "serial"]
    narrow = registry.select("serial", *order).repartitionByRange(ranges, *keys).withColumn("_range", F.spark_partition_id())
    fixed = materialize(narrow, "registry-order")
    inside, before = Window.partitionBy("_range").orderBy(*keys), Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = fixed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = totals.select(F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))  # one row per range
    local = fixed.withColumn("_at", F.row_number().over(inside) - 1)
    places = local.join(F.broadcast(offsets), F.col("_range") == F.col("_r")).select(
        F.col("serial").alias("_s"), (F.col("_at") + F.col("_off")).cast("int").alias("place")
    )
    return materialize(registry.join(places, F.col("serial") == F.col("_s")).select("serial", "place", *columns), "placed")


def _blocks(placed: DataFrame, n: int, row_bytes: int, stack_bytes: int):
    """Start, rows in order and whether more follow, at most ``stack_bytes`` of vectors at a time."""
    step = max(1, stack_bytes // max(1, row_bytes))
    for start in range(0, n, step):
        yield start, placed.where(F.col("place").between(start, start + step - 1)).orderBy("place").collect(), start + step < n


def _size(placed: DataFrame) -> tuple[int, int]:
    row = placed.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("fingerprint")).alias("d")).first()
    return row["n"], 8 * max(1, row["d"] or 1)


def _as_matrix(column: pa.Array, valid: np.ndarray, width: int) -> np.ndarray:
    """The list column's rows for which ``valid`` holds, as a matrix."""
    return np.array(column.filter(pa.array(valid)).to_pylist(), dtype=float).reshape(-1, width)


def _meet(unit: np.ndarray, start: int, n: int):
    """UDF (vector, own similarity, own place) -> whether an earlier entry of the block is as similar, and the first later one that is more so."""

    @F.arrow_udf("struct<beaten: boolean, until: int>")
    def meet(vectors: pa.Array, sims: pa.Array, owns: pa.Array) -> pa.Array:
        valid, x = to_matrix(vectors)
        beaten, until = np.zeros(len(valid), bool), np.full(len(valid), n, np.int32)
        if len(x):
            mine = sims.to_numpy(zero_copy_only=False)[valid][:, None]
            place, at = np.arange(start, start + len(unit))[None, :], owns.to_numpy(zero_copy_only=False)[valid][:, None]
            other = np.round(unit_rows(x) @ unit.T, 12)
            beaten[valid] = ((place < at) & (other >= mine)).any(axis=1)
            until[valid] = np.where((place > at) & (other > mine), place, n).min(axis=1)
        return pa.StructArray.from_arrays([pa.array(beaten), pa.array(until)], names=["beaten", "until"])

    return meet


def enrollment_curve(
    df: DataFrame, registry: DataFrame, type_col: str, order: str, col: str = "embedding", thr: float = MATCH_THRESHOLD,
    stack_bytes: int = MAX_STACK_BYTES,
) -> DataFrame:
    """After each enrolment step: accuracy of every type enrolled so far, for a registry of any size.

    A sample is identified rightly from its own type's step on until a later type is more similar, or never
    when an earlier one is at least as similar. The registry passes in blocks of bounded size; each leaves only
    these two facts per sample, and the curve is summed up from the steps at which samples change.
    """
    placed = _placed(registry, [order] if order != "serial" else [], ["fingerprint"])
    n, row_bytes = _size(placed)
    kind = F.col(type_col).cast("string")
    own = placed.select(F.col("serial").alias("_s"), F.col("place").alias("own"), F.col("fingerprint").alias("own_print"))
    rows = df.where(F.col(col).isNotNull()).select(kind.alias("type"), F.col(col).cast("array<double>").alias("x")).join(own, F.col("type") == F.col("_s"))

    @F.arrow_udf("double")
    def own_similarity(vectors: pa.Array, prints: pa.Array) -> pa.Array:
        valid, x = to_matrix(vectors)
        out = np.full(len(valid), np.nan)
        if len(x):
            out[valid] = np.round(np.einsum("ij,ij->i", unit_rows(x), unit_rows(_as_matrix(prints, valid, x.shape[1]))), 12)
        return pa.array(out)

    rows = rows.select("type", "x", "own", own_similarity("x", "own_print").alias("sim"), F.lit(False).alias("beaten"), F.lit(n).alias("until"))
    for start, block, more in _blocks(placed, n, row_bytes, stack_bytes):
        unit = unit_rows(np.array([r["fingerprint"] for r in block], dtype=float))

        rows = rows.withColumn("_m", _meet(unit, start, n)("x", "sim", "own")).select(
            "type", "x", "own", "sim", (F.col("beaten") | F.col("_m.beaten")).alias("beaten"), F.least("until", "_m.until").alias("until")
        )
        rows = materialize(rows, "curve-rows") if more else rows  # the block leaves the driver before the next is fetched
    right = ~F.col("beaten") & (F.col("sim") >= thr)
    ends = materialize(rows.groupBy("type", "own", "until").agg(F.count(F.lit(1)).alias("n"), F.sum(right.cast("long")).alias("ok")), "curve-ends")
    totals = ends.groupBy("type", "own").agg(F.sum("n").alias("n"), F.sum("ok").alias("ok"))
    steps = totals.select("type", "n", "ok", F.explode(F.sequence(F.col("own"), F.lit(n - 1))).alias("at"))
    lost = ends.select(F.col("type").alias("_t"), F.col("until").alias("_u"), F.col("ok").alias("lost"))
    met = steps.join(lost, (F.col("type") == F.col("_t")) & (F.col("at") == F.col("_u")), "left")
    gone = F.sum(F.coalesce("lost", F.lit(0))).over(Window.partitionBy("type").orderBy("at"))
    return met.select((F.col("at") + 1).cast("long").alias("step"), "type", "n", ((F.col("ok") - gone) / F.col("n")).alias("accuracy"))


def repair_registry(current: DataFrame, snapshot: DataFrame, alpha: float, max_steps: int) -> DataFrame:
    """Registries after 0..max_steps repairs: (1-alpha)^k current + (1-(1-alpha)^k) snapshot."""
    old = snapshot.select(F.col("serial").alias("_s"), F.col("fingerprint").alias("_f"))
    both = current.join(old, F.col("serial") == F.col("_s"), "left")
    keep = F.pow(F.lit(1.0 - alpha), F.col("step"))
    blended = F.zip_with("fingerprint", F.coalesce("_f", "fingerprint"), lambda c, s: keep * c + (F.lit(1.0) - keep) * s)
    return both.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(max_steps)))).select(
        "step", "serial", blended.alias("fingerprint")
    )


def _unbeaten(units: list[np.ndarray], start: int):
    """UDF (vector, own similarities, own place) -> per repair step whether no entry of the block is more similar."""

    @F.arrow_udf("array<boolean>")
    def unbeaten(vectors: pa.Array, sims: pa.Array, owns: pa.Array) -> pa.Array:
        valid, x = to_matrix(vectors)
        out = np.zeros((len(valid), len(units)), bool)
        if len(x):
            mine, unit = _as_matrix(sims, valid, len(units)), unit_rows(x)
            place, at = np.arange(start, start + len(units[0]))[None, :], owns.to_numpy(zero_copy_only=False)[valid][:, None]
            for k, m in enumerate(units):
                other, own_sim = np.round(unit @ m.T, 12), mine[:, k][:, None]
                out[valid, k] = ~(((place < at) & (other >= own_sim)) | ((place > at) & (other > own_sim))).any(axis=1)
        return pa.array(out.tolist(), pa.list_(pa.bool_()))

    return unbeaten


def repair_curve(
    df: DataFrame, current: DataFrame, snapshot: DataFrame, type_col: str, alpha: float = 0.15, max_steps: int = 5,
    col: str = "embedding", thr: float = MATCH_THRESHOLD, stack_bytes: int = MAX_STACK_BYTES,
) -> DataFrame:
    """Accuracy per type after every possible number of repairs, for registries of any size.

    A sample is right after k repairs when no other type's repaired fingerprint is more similar (an earlier serial: at
    least as similar) than its own. Both registries pass in blocks of bounded size.
    """
    old = snapshot.select(F.col("serial").alias("_o"), F.col("fingerprint").alias("old"))
    both = current.join(old, F.col("serial") == F.col("_o"), "left").select("serial", "fingerprint", F.coalesce("old", "fingerprint").alias("old"))
    placed = _placed(both, [], ["fingerprint", "old"])
    n, row_bytes = _size(placed)
    keep = [(1.0 - alpha) ** k for k in range(max_steps + 1)]
    kind = F.col(type_col).cast("string")
    own = placed.select(F.col("serial").alias("_s"), F.col("place").alias("own"), F.col("fingerprint").alias("own_print"), F.col("old").alias("own_old"))
    rows = df.select(kind.alias("type"), F.col(col).cast("array<double>").alias("x")).where("x IS NOT NULL").join(own, F.col("type") == F.col("_s"))

    @F.arrow_udf("array<double>")
    def own_similarity(vectors: pa.Array, prints: pa.Array, olds: pa.Array) -> pa.Array:
        valid, x = to_matrix(vectors)
        out = np.full((len(valid), len(keep)), np.nan)
        if len(x):
            unit, now, was = unit_rows(x), _as_matrix(prints, valid, x.shape[1]), _as_matrix(olds, valid, x.shape[1])
            out[valid] = np.stack([np.round(np.einsum("ij,ij->i", unit, unit_rows(k * now + (1 - k) * was)), 12) for k in keep], axis=1)
        return pa.array(out.tolist(), pa.list_(pa.float64()))

    right = F.transform(F.col("sim"), lambda s: s >= thr)
    rows = rows.select("type", "x", "own", own_similarity("x", "own_print", "own_old").alias("sim")).withColumn("right", right)
    for start, block, more in _blocks(placed, n, 2 * row_bytes * len(keep), stack_bytes):
        now, was = (np.array([r[c] for r in block], dtype=float) for c in ("fingerprint", "old"))
        units = [unit_rows(k * now + (1 - k) * was) for k in keep]

        rows = rows.withColumn("right", F.zip_with("right", _unbeaten(units, start)("x", "sim", "own"), lambda a, b: a & b))
        rows = materialize(rows, "repair-rows") if more else rows  # the block leaves the driver before the next is fetched
    flags = rows.select("type", F.posexplode("right").alias("step", "ok"))
    return flags.groupBy(F.col("step").cast("long").alias("step"), "type").agg(F.avg(F.col("ok").cast("double")).alias("accuracy"))


def first_clean_step(curve: DataFrame, best: DataFrame, threshold: float, max_steps: int) -> DataFrame:
    """Smallest number of repairs after which no type is more than ``threshold`` under its best."""
    limits = best.select(F.col("type").alias("_t"), F.col("best").alias("_b"))
    joined = curve.join(limits, F.col("type") == F.col("_t"))
    per_step = joined.groupBy("step").agg(
        F.max(F.col("_b") - F.col("accuracy")).alias("worst_drop"), F.avg("accuracy").alias("mean_accuracy")
    )
    clean = F.min(F.when(F.col("worst_drop") <= threshold, F.col("step")))
    return per_step.agg(
        F.coalesce(clean, F.lit(max_steps)).cast("long").alias("steps"), clean.isNotNull().alias("clean"),
        F.max(F.when(F.col("step") == 0, F.col("worst_drop"))).alias("drop_before"),
        F.min("worst_drop").alias("best_drop"),
    )
