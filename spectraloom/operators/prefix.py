"""Running totals, ranks and exact percentiles over one huge ordered group.

A plain window with one (or one dominant) partition key would run in a single task. Here the
order key is first cut into ranges; windows run inside (group, range) and the range totals, a
table bounded by groups x ranges, carry the offsets between them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.session import materialize

MAX_RANGES = 1024
FEW_RANGES = 16
ROWS_PER_RANGE = 200_000


def range_cuts(values: DataFrame, col: str, rows_per_range: int | None = None) -> list[float]:
    """Cut points that split ``col`` into ranges of similar size; [] when one range is enough.

    The driver receives at most MAX_RANGES numbers. Fixed literals keep the assignment the same in
    every branch of a plan and in every retried task.
    """

    def quantiles(parts: int):
        probs = ", ".join(f"{i / parts}D" for i in range(1, parts))
        cuts = F.expr(f"percentile_approx({col}, array({probs}), 10000)")
        return values.agg(F.count(F.lit(1)).alias("n"), cuts.alias("cuts")).first()

    row = quantiles(FEW_RANGES)
    want = min(MAX_RANGES, math.ceil(row["n"] / (rows_per_range or ROWS_PER_RANGE)))
    if want <= 1 or not row["cuts"]:
        return []
    if want > FEW_RANGES:
        row = quantiles(want)
    return sorted(set(float(c) for c in row["cuts"]))


def _literal(numbers: list[float]) -> Column:
    return F.expr("array(" + ", ".join(f"CAST({c!r} AS DOUBLE)" for c in numbers) + ")")


def range_of(col: Column | str, cuts: list[float]) -> Column:
    """Index of the range a value falls in; two short scans instead of one long one."""
    value = (F.col(col) if isinstance(col, str) else col).cast("double")
    if not cuts:
        return F.lit(0)
    width = max(1, math.isqrt(len(cuts)))
    heads = _literal(cuts[::width])
    blocks = F.array(*[_literal(cuts[i : i + width]) for i in range(0, len(cuts), width)])
    head = F.size(F.filter(heads, lambda c: c < value))
    inner = F.size(F.filter(F.element_at(blocks, F.greatest(head, F.lit(1))), lambda c: c < value))
    return F.when(head == 0, F.lit(0)).otherwise((head - 1) * F.lit(width) + inner)


def with_running(
    df: DataFrame,
    by: list[str],
    range_cols: list[str],
    order: list[Column],
    sums: dict[str, str],
    descending: bool = False,
    whole: bool = False,
) -> DataFrame:
    """Add, per output name, the exclusive running total of a column in the given order.

    ``range_cols`` must be an order-preserving coarsening of ``order`` within ``by``. ``whole`` says
    that the caller counted the rows and found one range enough: then one window does it.
    """
    if whole:
        alone = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.select(
            "*", *[F.coalesce(F.sum(c).over(alone), F.lit(0)).alias(o) for o, c in sums.items()]
        )
    keys = by + range_cols
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys).agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    range_order = [F.col(c).desc() if descending else F.col(c).asc() for c in range_cols]
    outer = Window.partitionBy(*by).orderBy(*range_order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        *[F.coalesce(F.sum(f"_t_{o}").over(outer), F.lit(0)).alias(f"_o_{o}") for o in sums],
    )
    local = df.select(
        "*", *[F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(f"_l_{o}") for o, c in sums.items()]
    )
    match = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    joined = local.join(offsets, on=match, how="inner")
    return joined.select(
        *[F.col(c) for c in df.columns], *[(F.col(f"_l_{o}") + F.col(f"_o_{o}")).alias(o) for o in sums]
    )


def ordered_rank(
    df: DataFrame, by: list[str], range_cols: list[str], order: list[Column], out: str = "rank", start: int = 1,
    whole: bool = False,
) -> DataFrame:
    """Dense row number within ``by``, safe for a group that holds most of the rows."""
    counted = df.withColumn("_one", F.lit(1).cast("long"))
    ranked = with_running(counted, by, range_cols, order, {"_before": "_one"}, whole=whole)
    return ranked.withColumn(out, F.col("_before") + F.lit(start)).drop("_one", "_before")


def value_counts(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """Rows per distinct value, written once: cut points and results both start from this narrow table."""
    counts = (
        df.where(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double")))
        .groupBy(*by, F.col(col).cast("double").alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return materialize(counts, "value-counts")


def exact_percentiles(df: DataFrame, col: str, probs: list[float], by: list[str] | None = None) -> DataFrame:
    """Exact linear-interpolation percentiles; one row per group with array column ``pct`` and ``n``.

    The built-in ``percentile`` keeps every distinct value of a group in one task's buffer; this
    form only keeps value counts inside a range.
    """
    by = by or []
    counts = value_counts(df, by, col)
    cuts = range_cuts(counts, "v")
    ranged = counts.withColumn("_r", range_of("v", cuts))
    running = with_running(ranged, by, ["_r"], [F.col("v")], {"before": "n"}, whole=not cuts)
    total = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    if by:
        match = [F.col(k).eqNullSafe(F.col(f"_t_{k}")) for k in by]
        renamed = total.select(*[F.col(k).alias(f"_t_{k}") for k in by], "total")
        placed = running.join(renamed, on=match, how="inner")
    else:
        placed = running.withColumn("total", total.scalar())
    picks = []
    for i, p in enumerate(probs):
        pos = (F.col("total") - 1) * F.lit(float(p))
        for name, k in ((f"lo{i}", F.floor(pos)), (f"hi{i}", F.ceil(pos))):
            inside = (F.col("before") <= k) & (k < F.col("before") + F.col("n"))
            picks.append(F.max(F.when(inside, F.col("v"))).alias(name))
    found = placed.groupBy(*by).agg(F.max("total").alias("n"), *picks)
    parts = []
    for i, p in enumerate(probs):
        pos = (F.col("n") - 1) * F.lit(float(p))
        frac = pos - F.floor(pos)
        parts.append(F.col(f"lo{i}") + frac * (F.col(f"hi{i}") - F.col(f"lo{i}")))
    return found.select(*by, "n", F.array(*parts).alias("pct"))
