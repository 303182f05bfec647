"""Ranking metrics on (truth, score) rows. Higher score = more positive; ties count one half.

All metrics start from counts per distinct score, so a third of the rows sharing one score is one
row after map-side combining, and continue over score ranges (see ``prefix``).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectraloom.functions.rows import attach_row
from spectraloom.operators.prefix import (
    exact_percentiles,
    ordered_rank,
    range_cuts,
    range_of,
    value_counts,
    with_running,
)
from spectraloom.session import materialize


def _keys(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by or [])


def score_counts(df: DataFrame, y: str, s: str, by=None) -> DataFrame:
    """Distinct scores with positive (p) and negative (n) counts, written once.

    Every metric needs the counts at least twice (cut points, then the metric); the written table
    saves scoring and shuffling the rows again.
    """
    score = F.col(s).cast("double")
    truth = F.col(y).cast("int")
    counts = (
        df.where(score.isNotNull() & ~F.isnan(score) & truth.isNotNull())
        .groupBy(*_keys(by), (score + F.lit(0.0)).alias("s"))
        .agg(
            F.sum(F.when(truth == 1, 1).otherwise(0)).alias("p"),
            F.sum(F.when(truth == 1, 0).otherwise(1)).alias("n"),
        )
    )
    return materialize(counts, "score-counts")


def auc_from_counts(counts: DataFrame, by=None, cuts: list[float] | None = None) -> DataFrame:
    keys = _keys(by)
    cuts = range_cuts(counts, "s") if cuts is None else cuts
    ranged = counts.withColumn("_r", range_of("s", cuts))
    inner = Window.partitionBy(*keys, "_r").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("n").over(inner), F.lit(0)).cast("double")
    local = (
        ranged.withColumn("_u", F.col("p") * (below + F.col("n") / 2))
        .groupBy(*keys, "_r")
        .agg(F.sum("_u").alias("u"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    )
    outer = Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    off = F.coalesce(F.sum("n").over(outer), F.lit(0)).cast("double")
    pairs = F.sum("p").cast("double") * F.sum("n")
    return (
        local.withColumn("_u", F.col("u") + F.col("p") * off)
        .groupBy(*keys)
        .agg(
            (F.sum("_u") / F.nullif(pairs, F.lit(0.0))).alias("auc"),
            F.sum("p").alias("n_pos"),
            F.sum("n").alias("n_neg"),
        )
    )


def auc(df: DataFrame, y: str, s: str, by=None) -> DataFrame:
    """ROC AUC per group (or one row); NULL when a class is empty."""
    return auc_from_counts(score_counts(df, y, s, by), by)


def auc_by_type(pos: DataFrame, neg: DataFrame, s: str, type_col: str) -> DataFrame:
    """AUC of each type's positives against one shared negative set, which is never replicated."""
    score = F.col(s).cast("double") + F.lit(0.0)
    known = F.col(s).isNotNull() & ~F.isnan(F.col(s).cast("double"))
    p = pos.where(known).groupBy(F.col(type_col).alias("type"), score.alias("s")).agg(F.count(F.lit(1)).alias("p"))
    n = neg.where(known).groupBy(score.alias("s")).agg(F.count(F.lit(1)).alias("n"))
    merged = p.withColumns({"n": F.lit(0).cast("long"), "typed": F.lit(True)}).unionByName(
        n.select(F.lit(None).cast(p.schema["type"].dataType).alias("type"), "s", F.lit(0).cast("long").alias("p"), "n", F.lit(False).alias("typed"))
    )
    merged = materialize(merged, "type-counts")
    cuts = range_cuts(merged, "s")
    ranged = merged.withColumn("_r", range_of("s", cuts))
    upto = Window.partitionBy("_r").orderBy("s").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy("_r", "s")
    local = ranged.select(
        "_r", "typed", "type", "p", "n", (F.sum("n").over(upto) - F.sum("n").over(same) / 2).alias("_below")
    )
    part = local.groupBy("_r", "typed", "type").agg(
        F.sum(F.col("p") * F.col("_below")).alias("u"), F.sum("p").alias("p"), F.sum("n").alias("n")
    )
    by_range = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    # at most MAX_RANGES rows: negatives per range
    offsets = part.groupBy("_r").agg(F.sum("n").alias("_n")).select(
        F.col("_r").alias("_or"),
        F.coalesce(F.sum("_n").over(by_range), F.lit(0)).alias("_off"),
    )
    n_neg = merged.agg(F.sum("n"))
    typed = part.where("typed")
    if cuts:
        typed = typed.join(F.broadcast(offsets), F.col("_r") == F.col("_or"))
    else:
        typed = typed.withColumn("_off", F.lit(0))
    done = (
        typed.groupBy("type")
        .agg(F.sum(F.col("u") + F.col("p") * F.col("_off")).alias("u"), F.sum("p").alias("n_pos"))
        .withColumn("n_neg", n_neg.scalar())
    )
    return done.select(
        F.col("type").alias(type_col),
        (F.col("u") / F.nullif(F.col("n_pos").cast("double") * F.col("n_neg"), F.lit(0.0))).alias("auc"),
        "n_pos",
        "n_neg",
    )


def roc_curve(df: DataFrame, y: str, s: str, by=None, drop_collinear: bool = False) -> DataFrame:
    """One row per distinct score from high to low: threshold, tp, fp, tpr, fpr.

    The start point (0, 0) above every score is implied and not emitted.
    """
    keys = _keys(by)
    counts = score_counts(df, y, s, by)
    cuts = range_cuts(counts, "s")
    ranged = counts.withColumn("_r", range_of("s", cuts))
    if drop_collinear:
        ranged = _mark_corners(ranged, keys, whole=not cuts)
    curve = with_running(
        ranged, keys, ["_r"], [F.col("s").desc()], {"_tp": "p", "_fp": "n"}, descending=True, whole=not cuts
    )
    totals = counts.groupBy(*keys).agg(F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"))
    if keys:
        renamed = totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "n_pos", "n_neg")
        curve = curve.join(renamed, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    else:
        curve = attach_row(curve, totals)
    tp, fp = F.col("_tp") + F.col("p"), F.col("_fp") + F.col("n")
    curve = curve.select(
        *keys,
        F.col("s").alias("threshold"),
        tp.alias("tp"),
        fp.alias("fp"),
        (tp / F.nullif(F.col("n_pos"), F.lit(0))).alias("tpr"),
        (fp / F.nullif(F.col("n_neg"), F.lit(0))).alias("fpr"),
        F.col("p").alias("pos_here"),
        F.col("n").alias("neg_here"),
        *(["_corner"] if drop_collinear else []),
    )
    return curve.where("_corner").drop("_corner") if drop_collinear else curve


def _mark_corners(ranged: DataFrame, keys: list[str], whole: bool) -> DataFrame:
    """A point stays when the next lower score adds another (p, n) step than it did itself."""
    step = F.struct("p", "n")

    def is_corner(following: Column) -> Column:
        return following.isNull() | (following["p"] != F.col("p")) | (following["n"] != F.col("n"))

    if whole:
        after = F.lead(step).over(Window.partitionBy(*keys).orderBy(F.col("s").desc()))
        return ranged.withColumn("_next", after).withColumn("_corner", is_corner(F.col("_next"))).drop("_next")
    w = Window.partitionBy(*keys, "_r").orderBy(F.col("s").desc())
    firsts = ranged.groupBy(*keys, "_r").agg(F.max_by(step, "s").alias("_first"))
    wr = Window.partitionBy(*keys).orderBy(F.col("_r").desc())
    nexts = firsts.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_r").alias("_kr"), F.lead("_first").over(wr).alias("_nf")
    )
    match = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_r") == F.col("_kr")]
    joined = ranged.withColumn("_next", F.lead(step).over(w)).join(nexts, match)
    corner = is_corner(F.coalesce(F.col("_next"), F.col("_nf")))
    return joined.withColumn("_corner", corner).drop("_next", "_nf", "_kr", *[f"_k_{k}" for k in keys])


def average_precision(df: DataFrame, y: str, s: str, by=None) -> DataFrame:
    keys = _keys(by)
    curve = roc_curve(df, y, s, by)
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    total = F.nullif(F.sum("pos_here"), F.lit(0))
    return curve.groupBy(*keys).agg((F.sum(F.col("pos_here") * precision) / total).alias("average_precision"))


def tpr_at_fpr(df: DataFrame, y: str, s: str, targets: list[float], by=None, mode: str = "le") -> DataFrame:
    """TPR at FPR targets: last point with fpr <= t ("le"), or first point with fpr >= t ("ge")."""
    keys = _keys(by)
    curve = roc_curve(df, y, s, by)
    aggs = []
    for i, t in enumerate(targets):
        if mode == "le":
            inside = F.col("fpr") <= F.lit(t)
            aggs += [
                F.coalesce(F.max(F.when(inside, F.col("tpr"))), F.lit(0.0)).alias(f"t{i}"),
                F.min(F.when(inside, F.col("threshold"))).alias(f"h{i}"),
            ]
        else:
            inside = F.col("fpr") >= F.lit(t)
            aggs += [
                F.min(F.when(inside, F.col("tpr"))).alias(f"t{i}"),
                F.max(F.when(inside, F.col("threshold"))).alias(f"h{i}"),
            ]
    wide = curve.groupBy(*keys).agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(float(t)).alias("target"), F.col(f"t{i}").alias("tpr"), F.col(f"h{i}").alias("threshold")
            )
            for i, t in enumerate(targets)
        ]
    )
    return wide.select(*keys, F.explode(rows).alias("_p")).select(*keys, "_p.*")


def fpr_at_tpr(df: DataFrame, y: str, s: str, target: float = 0.95, by=None) -> DataFrame:
    """FPR at the first point whose TPR reaches the target, 1.0 when none does."""
    keys = _keys(by)
    inside = F.col("tpr") >= F.lit(target)
    return roc_curve(df, y, s, by).groupBy(*keys).agg(
        F.coalesce(F.min(F.when(inside, F.col("fpr"))), F.lit(1.0)).alias("fpr"),
        F.max(F.when(inside, F.col("threshold"))).alias("threshold"),
    )


def fpr_at_order_stat(df: DataFrame, y: str, s: str, tail: float = 0.05) -> DataFrame:
    """FPR at the threshold given by the floor(tail * n)-th smallest positive score (0-based)."""
    truth = F.col(y).cast("int")
    positives = df.where(truth == 1)
    counts = value_counts(positives, [], s)
    cuts = range_cuts(counts, "v")
    ranged = counts.withColumn("_r", range_of("v", cuts))
    running = with_running(ranged, [], ["_r"], [F.col("v")], {"before": "n"}, whole=not cuts)
    pos = F.floor(F.lit(float(tail)) * counts.agg(F.sum("n")).scalar())
    threshold = running.where((F.col("before") <= pos) & (pos < F.col("before") + F.col("n"))).agg(F.max("v"))
    hit = F.col(s).cast("double") >= threshold.scalar()
    return df.where(truth == 0).agg(
        F.avg(hit.cast("double")).alias("fpr"), F.count(F.lit(1)).alias("n_neg")
    ).withColumn("threshold", threshold.scalar())


def youden(df: DataFrame, y: str, s: str, by=None) -> DataFrame:
    """Point with the largest tpr - fpr; the highest threshold wins ties."""
    keys = _keys(by)
    curve = roc_curve(df, y, s, by).withColumn("j", F.round(F.col("tpr") - F.col("fpr"), 12))
    best = F.max(F.struct(F.col("j"), F.col("threshold"), F.col("tpr"), F.col("fpr"))).alias("_b")
    return curve.where(F.col("j").isNotNull()).groupBy(*keys).agg(best).select(*keys, "_b.*")


def calibrate(train: DataFrame, background: DataFrame | None = None, col: str = "dist", q: float = 0.99) -> DataFrame:
    """Distance threshold: Youden point against background, else the train percentile ``q``."""
    if background is None:
        return exact_percentiles(train, col, [q]).select(
            F.element_at("pct", 1).alias("threshold"), F.lit("percentile").alias("source")
        )
    both = train.select(F.lit(1).alias("y"), (-F.col(col)).alias("s")).unionByName(
        background.select(F.lit(0).alias("y"), (-F.col(col)).alias("s"))
    )
    return youden(both, "y", "s").select((-F.col("threshold")).alias("threshold"), F.lit("youden").alias("source"))


def ecdf(df: DataFrame, col: str, by=None) -> DataFrame:
    """Distinct values with the fraction of rows at or below them."""
    keys = _keys(by)
    counts = value_counts(df, keys, col)
    cuts = range_cuts(counts, "v")
    ranged = counts.withColumn("_r", range_of("v", cuts))
    running = with_running(ranged, keys, ["_r"], [F.col("v")], {"before": "n"}, whole=not cuts)
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    if keys:
        renamed = totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "total")
        running = running.join(renamed, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    else:
        running = attach_row(running, totals)
    return running.select(*keys, F.col("v").alias(col), ((F.col("before") + F.col("n")) / F.col("total")).alias("cdf"))


def pct_rank(scores: DataFrame, train: DataFrame, col: str = "dist", out: str = "pct_greater") -> DataFrame:
    """Percent of training values strictly greater than each score, as a range-wise merge."""
    value = F.col(col).cast("double")
    known = train.where(value.isNotNull() & ~F.isnan(value))
    t = known.groupBy(value.alias("v")).agg(F.count(F.lit(1)).alias("t")).withColumn("asked", F.lit(0))
    q = (
        scores.where(F.col(col).isNotNull())
        .select(F.col(col).cast("double").alias("v"))
        .distinct()
        .select("v", F.lit(0).cast("long").alias("t"), F.lit(1).alias("asked"))
    )
    merged = materialize(
        t.unionByName(q).groupBy("v").agg(F.sum("t").alias("t"), F.max("asked").alias("asked")), "rank-counts"
    )
    cuts = range_cuts(merged, "v")
    ranged = merged.withColumn("_r", range_of("v", cuts))
    running = with_running(ranged, [], ["_r"], [F.col("v")], {"before": "t"}, whole=not cuts)
    total = merged.agg(F.sum("t"))
    placed = running.where("asked = 1").select(
        F.col("v").alias("_v"),
        (F.lit(100.0) * (F.lit(1.0) - (F.col("before") + F.col("t")) / total.scalar())).alias(out),
    )
    return scores.join(placed, F.col(col).cast("double") == F.col("_v"), "left").drop("_v")


def bootstrap_auc(
    df: DataFrame, y: str, s: str, replicates: int = 1000, seed: int = 42, reps_per_task: int = 100
) -> DataFrame:
    """AUC of each bootstrap replicate, drawn separately inside positives and negatives.

    A replicate first splits its draws over score ranges (a table of at most MAX_RANGES rows that
    every task holds), then each task draws inside one range. Tasks are ranges x replicate blocks,
    so neither the score table nor the replicates pass through one task. The draws are those of the
    exact multinomial resampling.
    """
    return _bootstrap_counts(score_counts(df, y, s), replicates, seed, reps_per_task)


def _bootstrap_counts(counts: DataFrame, replicates: int, seed: int, reps_per_task: int) -> DataFrame:
    ranged = counts.withColumn("_r", range_of("s", range_cuts(counts, "s", rows_per_range=20_000)))
    table = (
        ranged.groupBy("_r").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).orderBy("_r").collect()
    )  # bounded by MAX_RANGES
    ranges = [int(row["_r"]) for row in table]
    tot_p = np.array([row["p"] for row in table], dtype=np.int64)
    tot_n = np.array([row["n"] for row in table], dtype=np.int64)
    blocks = max(1, -(-replicates // reps_per_task))

    def split(totals: np.ndarray, rep: int, cls: int) -> np.ndarray:
        rng = np.random.default_rng([seed, cls, rep])
        return rng.multinomial(totals.sum(), totals / totals.sum()) if totals.sum() else totals

    def draw(key, pdf: pd.DataFrame) -> pd.DataFrame:
        r, block = int(key[0]), int(key[1])
        pdf = pdf.sort_values("s")
        p, n = pdf["p"].to_numpy(), pdf["n"].to_numpy()
        at = ranges.index(r)
        rows = []
        for rep in range(block * reps_per_task, min(replicates, (block + 1) * reps_per_task)):
            want_p, want_n = split(tot_p, rep, 1)[at], split(tot_n, rep, 0)[at]
            rng = np.random.default_rng([seed, 2, rep, r])
            got_p = rng.multinomial(want_p, p / p.sum()) if p.sum() else np.zeros_like(p)
            got_n = rng.multinomial(want_n, n / n.sum()) if n.sum() else np.zeros_like(n)
            below = np.cumsum(got_n) - got_n
            rows.append((rep, r, float((got_p * (below + got_n / 2.0)).sum()), int(got_p.sum()), int(got_n.sum())))
        return pd.DataFrame(rows, columns=["replicate", "_r", "u", "p", "n"])

    local = (
        ranged.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .groupBy("_r", "_block")
        .applyInPandas(draw, "replicate long, _r int, u double, p long, n long")
    )
    w = Window.partitionBy("replicate").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    off = F.coalesce(F.sum("n").over(w), F.lit(0))
    pairs = F.nullif(F.sum("p").cast("double") * F.sum("n"), F.lit(0.0))
    return (
        local.withColumn("_u", F.col("u") + F.col("p") * off)
        .groupBy("replicate")
        .agg((F.sum("_u") / pairs).alias("auc"))
    )


def bootstrap_interval(reps: DataFrame, col: str = "auc", level: float = 0.95, by=None) -> DataFrame:
    """Mean, deviation and percentile interval over replicate values (a table of B rows)."""
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    return reps.groupBy(*_keys(by)).agg(
        F.avg(col).alias("mean"),
        F.stddev_pop(col).alias("std"),
        F.expr(f"percentile({col}, {lo})").alias("ci_low"),
        F.expr(f"percentile({col}, {hi})").alias("ci_high"),
        F.count(F.lit(1)).alias("replicates"),
    )


def snr_curve(df: DataFrame, y: str, s: str, snr: str) -> DataFrame:
    return auc(df, y, s, by=[snr])


def snr_floor(curve: DataFrame, limits: list[float], level: str = "ordinal", snr: str = "snr_db") -> DataFrame:
    """First level, in list order, whose AUC is under each limit; the last level if none is."""
    aggs = []
    for i, limit in enumerate(limits):
        under = F.min_by(F.col(snr), F.when(F.col("auc") < F.lit(limit), F.col(level)))
        aggs.append(F.coalesce(under, F.max_by(F.col(snr), F.col(level))).alias(f"f{i}"))
    rows = F.array(
        *[F.struct(F.lit(float(x)).alias("limit"), F.col(f"f{i}").alias("floor_db")) for i, x in enumerate(limits)]
    )
    return curve.agg(*aggs).select(F.explode(rows).alias("_x")).select("_x.*")


def bootstrap_auc_by_type(
    df: DataFrame, y: str, s: str, type_col: str, replicates: int = 1000, seed: int = 42, reps_per_task: int = 100
) -> DataFrame:
    """Per-type replicates: each type's positives and, per type, a fresh draw of the shared negatives.

    Types of positives are few (a label set); each one is an independent bootstrap over the same
    negatives, so the negative counts are joined once per type as distinct scores, not as rows.
    """
    counts = score_counts(df, y, s, [type_col])
    neg = counts.groupBy("s").agg(F.sum("n").alias("n")).where("n > 0")
    types = counts.groupBy(type_col).agg(F.sum("p").alias("_p")).where("_p > 0")
    names = [row[type_col] for row in types.select(type_col).orderBy(type_col).collect()]
    out = None
    for i, name in enumerate(names):
        pos = counts.where((F.col(type_col) == F.lit(name)) & (F.col("p") > 0)).select("s", "p")
        both = pos.withColumn("n", F.lit(0).cast("long")).unionByName(
            neg.select("s", F.lit(0).cast("long").alias("p"), "n")
        )
        merged = both.groupBy("s").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
        one = _bootstrap_counts(merged, replicates, seed + 1000 * (i + 1), reps_per_task).withColumn(
            type_col, F.lit(name)
        )
        out = one if out is None else out.unionByName(one)
    return out


def bootstrap_closer_rate(
    df: DataFrame, y: str, dist: str, replicates: int = 1000, seed: int = 42
) -> DataFrame:
    """Rate of random (positive, negative) pairs whose positive is closer, per replicate.

    Pairs are drawn independently, so the number of successes among m pairs is binomial with the
    share of strictly closer pairs, which the count form of the AUC gives exactly.
    """
    counts = score_counts(df.withColumn("_s", -F.col(dist)), y, "_s")
    cuts = range_cuts(counts, "s")
    ranged = counts.withColumn("_r", range_of("s", cuts))
    running = with_running(ranged, [], ["_r"], [F.col("s")], {"below": "n"}, whole=not cuts)
    share = running.agg(
        (F.sum(F.col("p").cast("double") * F.col("below")) / (F.sum("p").cast("double") * F.sum("n"))).alias("share"),
        F.least(F.sum("p"), F.sum("n")).alias("pairs"),
    )

    def draws(frames):
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                rng = np.random.default_rng([seed, 3])
                got = rng.binomial(int(row.pairs), float(row.share), size=replicates) / row.pairs
                yield pd.DataFrame({"replicate": np.arange(replicates), "rate": got})

    return share.where("pairs > 0").mapInPandas(draws, "replicate long, rate double")


# ---- bootstrap by hashed weights ------------------------------------------------------------------


def poisson_cuts(bits: int = 32) -> list[int]:
    """Where a uniform number of ``bits`` bits passes the Poisson(1) distribution function: its draw is the cuts at or below it."""
    cuts, term, total, k = [], math.exp(-1), math.exp(-1), 0
    while (cut := math.floor(total * 2**bits)) < 2**bits and (not cuts or cut > cuts[-1]):
        cuts.append(cut)
        k += 1
        term /= k
        total += term
    return cuts


def _drawn(by: list[str], replicates: int, seed: int):
    cuts = np.array(poisson_cuts(), np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int64)
            for name in by:
                values = batch.column(name).dictionary_encode("encode")
                cell = np.unique(cell * len(values.dictionary) + values.indices.to_numpy(), return_inverse=True)[1]
            cells, first = np.unique(cell, return_index=True)
            keys, ids = batch.select(by).take(pa.array(first)), batch.column("_id").to_pylist()
            for at in range(0, replicates, 4):  # four replicates share a hash
                tail = f":{at // 4}:{seed}".encode()
                u = np.frombuffer(b"".join([hashlib.md5(i + tail).digest() for i in ids]), ">u4").astype(np.uint32)
                w = np.searchsorted(cuts, u, side="right").reshape(-1, 4)[:, : replicates - at]
                sums = np.stack([np.bincount(cell, x, len(cells)) for x in w.T]).astype(np.int64)
                lane, held = np.nonzero(sums)
                columns = [pa.array(at + lane), *keys.take(pa.array(held)).columns, pa.array(sums[lane, held])]
                yield pa.RecordBatch.from_arrays(columns, ["replicate", *by, "w"])

    return run


def poisson_counts(df: DataFrame, by: list[str], id_col: Column | str, replicates: int, seed: int) -> DataFrame:
    """replicate, the columns ``by``, and the weight ``w`` that the replicate's draws give to their rows together, where it is not zero.

    A row's weight is Poisson(1), read from the md5 of its id, the replicate and the seed, so it depends on neither partitions
    nor retries, and no task holds a resample. Rows with one id are drawn together; null ids are one id. A hash is made once for four
    replicates, and weights are summed within each Arrow batch, so no row is repeated per replicate.
    """
    key = F.col(id_col) if isinstance(id_col, str) else id_col
    narrow = df.select(*by, F.coalesce(key.cast("string"), F.lit("null")).cast("binary").alias("_id"))
    fields = [T.StructField("replicate", T.LongType()), *(narrow.schema[c] for c in by), T.StructField("w", T.LongType())]
    return narrow.mapInArrow(_drawn(by, replicates, seed), T.StructType(fields)).groupBy("replicate", *by).agg(F.sum("w").alias("w"))


def poisson_auc(df: DataFrame, y: str, s: str, id_col: Column | str, replicates: int = 1000, seed: int = 42, type_col: str | None = None) -> DataFrame:
    """AUC of each Poisson bootstrap replicate; with ``type_col``, of each type's positives against all negatives of the replicate.

    Weighted counts per replicate and distinct score are summed in every batch and map-side before the only shuffle. Null and NaN
    scores and null truths take no part; the AUC is null where a replicate draws no row of a class.
    """
    score, truth = F.col(s).cast("double"), F.col(y).cast("int")
    known = df.where(score.isNotNull() & ~F.isnan(score) & truth.isNotNull())
    kind = F.when(truth == 1, F.col(type_col)) if type_col else F.lit(None).cast("string")
    narrow = known.select((score + F.lit(0.0)).alias("s"), (truth == 1).alias("_pos"), kind.alias("_type"), (F.col(id_col) if isinstance(id_col, str) else id_col).alias("_id"))
    counts = poisson_counts(narrow, ["s", "_pos", "_type"], "_id", replicates, seed).select(
        "replicate", "s", "_pos", "_type", F.when(F.col("_pos"), F.col("w")).otherwise(0).alias("p"), F.when(F.col("_pos"), 0).otherwise(F.col("w")).alias("n")
    )
    counts = materialize(counts, "poisson-counts")
    if not type_col:
        merged = counts.groupBy("replicate", "s").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
        return auc_from_counts(merged, ["replicate"], range_cuts(counts, "s"))
    ranged = counts.withColumn("_r", range_of("s", range_cuts(counts, "s")))
    upto = Window.partitionBy("replicate", "_r").orderBy("s").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy("replicate", "_r", "s")
    local = ranged.withColumn("_below", F.sum("n").over(upto) - F.sum("n").over(same) / 2)
    part = local.groupBy("replicate", "_r", "_pos", "_type").agg(F.sum(F.col("p") * F.col("_below")).alias("u"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    earlier = Window.partitionBy("replicate").orderBy("_r").rangeBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("replicate")
    placed = part.withColumns({"_off": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "_negatives": F.sum("n").over(whole)})  # ranges x types rows a replicate
    pairs = F.nullif(F.sum("p").cast("double") * F.max("_negatives"), F.lit(0.0))
    return placed.where("_pos").groupBy("replicate", F.col("_type").alias(type_col)).agg(
        (F.sum(F.col("u") + F.col("p").cast("double") * F.col("_off")) / pairs).alias("auc"), F.sum("p").alias("n_pos"), F.max("_negatives").alias("n_neg")
    )
