"""Aggregated reports over scored, labelled or paired rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.functions.labels import artifact_grade
from spectraloom.functions.rows import attach_row
from spectraloom.functions import vectors as V
from spectraloom.operators import ranking as K
from spectraloom.operators.moments import centroid
from spectraloom.operators.prefix import exact_percentiles


def _keys(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by or [])


def top_k(df: DataFrame, col: str, k: int, by=None, tie: str | None = None, largest: bool = False) -> DataFrame:
    """First k rows by a column, overall or per group (the limit is pushed below the shuffle)."""
    order = [F.col(col).desc() if largest else F.col(col).asc()] + ([F.col(tie)] if tie else [])
    if not by:
        return df.orderBy(*order).limit(k)
    w = Window.partitionBy(*_keys(by)).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def detection_rate(df: DataFrame, threshold: Column | float, by=None, col: str = "dist") -> DataFrame:
    limit = F.lit(threshold) if isinstance(threshold, (int, float)) else threshold
    return df.groupBy(*_keys(by)).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col(col) <= limit).cast("double")).alias("detection_rate")
    )


def batch_report(df: DataFrame, threshold: Column, type_col: str, truth: str, col: str = "dist") -> DataFrame:
    """Per-type accuracy and mean distance plus an overall row (type NULL), in one rollup."""
    right = ((F.col(col) <= threshold) == (F.col(truth) == 1)).cast("double")
    return (
        df.withColumn("_right", right)
        .rollup(type_col)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("_right").alias("accuracy"),
            F.avg(col).alias("mean_dist"),
            F.grouping(type_col).cast("long").alias("is_total"),
        )
    )


def score_summary(df: DataFrame, col: str, by=None) -> DataFrame:
    """Mean, median, deviation, extremes and tails per population."""
    keys = _keys(by)
    plain = df.groupBy(*keys).agg(
        F.avg(col).alias("mean"),
        F.stddev_pop(col).alias("std"),
        F.min(col).alias("min"),
        F.max(col).alias("max"),
    )
    pct = exact_percentiles(df, col, [0.05, 0.5, 0.95], keys)
    tails = pct.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        "n",
        F.element_at("pct", 1).alias("p5"),
        F.element_at("pct", 2).alias("median"),
        F.element_at("pct", 3).alias("p95"),
    )
    if not keys:
        return attach_row(plain, tails)
    joined = plain.join(tails, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return joined.drop(*[f"_k_{k}" for k in keys])


def mean_ratio(df: DataFrame, col: str, truth: str) -> DataFrame:
    """Mean background distance over mean drone distance."""
    drone = F.avg(F.when(F.col(truth) == 1, F.col(col)))
    background = F.avg(F.when(F.col(truth) == 0, F.col(col)))
    return df.agg((background / F.nullif(drone, F.lit(0.0))).alias("ratio"))


def profile(df: DataFrame, col: str, by=None) -> DataFrame:
    """Deciles 10/25/50/75/90 of a feature as columns."""
    keys = _keys(by)
    pct = exact_percentiles(df, col, [0.10, 0.25, 0.50, 0.75, 0.90], keys)
    names = ["p10", "p25", "p50", "p75", "p90"]
    return pct.select(*keys, "n", *[F.element_at("pct", i + 1).alias(nm) for i, nm in enumerate(names)])


def box_stats(df: DataFrame, col: str, by) -> DataFrame:
    """Quartiles and the whiskers (furthest values within 1.5 IQR) per group, without fliers."""
    keys = _keys(by)
    q = exact_percentiles(df, col, [0.25, 0.5, 0.75], keys).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        "n",
        F.element_at("pct", 1).alias("q1"),
        F.element_at("pct", 2).alias("median"),
        F.element_at("pct", 3).alias("q3"),
    )
    joined = df.select(*keys, F.col(col).alias("_v")).join(q, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    iqr = F.col("q3") - F.col("q1")
    low = F.min(F.when(F.col("_v") >= F.col("q1") - F.lit(1.5) * iqr, F.col("_v")))
    high = F.max(F.when(F.col("_v") <= F.col("q3") + F.lit(1.5) * iqr, F.col("_v")))
    return joined.groupBy(*keys).agg(
        F.max("n").alias("n"),
        low.alias("whisker_low"),
        F.max("q1").alias("q1"),
        F.max("median").alias("median"),
        F.max("q3").alias("q3"),
        high.alias("whisker_high"),
    )


def histogram(df: DataFrame, col: str, bins: int, lo, hi, by=None) -> DataFrame:
    """Equal-width density histogram over [lo, hi]; the last bin includes its right edge.

    Rows outside the interval are left out; density is relative to the rows inside.
    """
    keys = _keys(by)
    low = F.lit(float(lo)) if isinstance(lo, (int, float)) else lo
    high = F.lit(float(hi)) if isinstance(hi, (int, float)) else hi
    width = (high - low) / F.lit(bins)
    value = F.col(col).cast("double")
    bin_no = F.least(F.floor((value - low) / width), F.lit(bins - 1)).cast("long")
    inside = df.select(*keys, value.alias("_v"), bin_no.alias("bin"), width.alias("_w"), low.alias("_lo")).where(
        (F.col("_v") >= low) & (F.col("_v") <= high)
    )
    counts = inside.groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.max("_w").alias("_w"), F.max("_lo").alias("_lo")
    )
    total = F.sum("n").over(Window.partitionBy(*keys))
    return counts.select(
        *keys,
        "bin",
        (F.col("_lo") + F.col("bin") * F.col("_w")).alias("left_edge"),
        "n",
        (F.col("n") / (total * F.col("_w"))).alias("density"),
    )


def seed_summary(history: DataFrame, by: list[str], value: str, seed: str, step: str) -> DataFrame:
    """Spread over seeds of the value at each seed's last step."""
    final = history.groupBy(*by, seed).agg(F.max_by(value, step).alias("_final"))
    return final.groupBy(*by).agg(
        F.avg("_final").alias("mean"),
        F.stddev_pop("_final").alias("std"),
        F.min("_final").alias("min"),
        F.max("_final").alias("max"),
        F.count(F.lit(1)).alias("seeds"),
    )


def step_curve(history: DataFrame, by: list[str], value: str) -> DataFrame:
    return history.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(F.lit(1)).alias("n")
    )


def confusion(df: DataFrame, truth: str, guess: str, labels: list) -> DataFrame:
    """Matrix with one row and one column per label in the given order, zeros included."""
    wide = df.groupBy(truth).pivot(guess, labels).count()
    items = F.array(*[F.struct(F.lit(l).alias("_label"), F.lit(i).alias("_ord")) for i, l in enumerate(labels)])
    names = df.sparkSession.range(1).select(F.inline(items))
    cells = [F.coalesce(F.col(f"`{l}`"), F.lit(0)).cast("long").alias(f"as_{l}") for l in labels]
    return names.join(wide, F.col("_label") == F.col(truth), "left").select(F.col("_label").alias(truth), F.col("_ord").cast("long").alias("ord"), *cells)


def class_report(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy and macro rows."""
    cells = df.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    tall = cells.select(
        F.explode(
            F.array(
                F.struct(F.col("t").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("guessed"), F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0).alias("hit")),
                F.struct(F.col("g").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("guessed"), F.lit(0).cast("long").alias("hit")),
            )
        ).alias("x")
    ).select("x.*")
    per = tall.groupBy("label").agg(
        F.sum("support").alias("support"), F.sum("guessed").alias("guessed"), F.sum("hit").alias("hit")
    )
    zero = F.lit(0.0)
    precision = F.when(F.col("guessed") > 0, F.col("hit") / F.col("guessed")).otherwise(zero)
    recall = F.when(F.col("support") > 0, F.col("hit") / F.col("support")).otherwise(zero)
    f1 = F.when(F.col("support") + F.col("guessed") > 0, 2 * F.col("hit") / (F.col("support") + F.col("guessed"))).otherwise(zero)
    rows = per.select(
        F.col("label").cast("string").alias("label"), precision.alias("precision"), recall.alias("recall"),
        f1.alias("f1"), "support", "hit",
    )
    overall = rows.agg(
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
        F.sum("support").alias("support"), F.sum("hit").alias("hit"),
    )
    acc = F.col("hit") / F.col("support")
    macro = overall.select(F.lit("macro").alias("label"), "precision", "recall", "f1", "support")
    accuracy = overall.select(F.lit("accuracy").alias("label"), acc.alias("precision"), acc.alias("recall"), acc.alias("f1"), "support")
    return rows.drop("hit").unionByName(macro).unionByName(accuracy)


def extremes(per_type: DataFrame, type_col: str, value: str = "auc", failing: float = 0.95) -> DataFrame:
    """Best and worst type by a metric, and how many fall under the limit."""
    best = F.max_by(F.struct(type_col, value), F.struct(F.col(value), F.col(type_col)))
    worst = F.min_by(F.struct(type_col, value), F.struct(F.col(value), F.col(type_col)))
    return per_type.agg(
        best.alias("b"), worst.alias("w"), F.sum((F.col(value) < failing).cast("long")).alias("n_failing")
    ).select(
        F.col(f"b.{type_col}").alias("best_type"), F.col(f"b.{value}").alias("best"),
        F.col(f"w.{type_col}").alias("worst_type"), F.col(f"w.{value}").alias("worst"), "n_failing",
    )


def latency_report(df: DataFrame, ms: str, by=None, per_batch: Column | int = 1) -> DataFrame:
    """Per-sample latency and the rate it allows."""
    each = F.col(ms) / (F.lit(per_batch) if isinstance(per_batch, int) else per_batch)
    keys = _keys(by)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"), F.avg(each).alias("mean_ms"), F.min(each).alias("best_ms"),
        F.max(each).alias("worst_ms"), F.stddev_pop(each).alias("std_ms"), (F.lit(1000.0) / F.avg(each)).alias("fps"),
    )


def count_modified(pairs: DataFrame, a: str, b: str) -> DataFrame:
    delta = V.vec_sum(F.zip_with(V.as_doubles(a), V.as_doubles(b), lambda x, y: F.abs(x - y)))
    return pairs.agg(
        F.count(F.lit(1)).alias("n_pairs"), F.sum((delta > 0).cast("long")).alias("n_modified")
    )


def centroid_probe(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Accuracy of the linear probe between two class means: is a row closer to its own class's mean? One row."""
    both = a.select(F.lit(1).alias("y"), F.col(col).alias("x")).unionByName(b.select(F.lit(0).alias("y"), F.col(col).alias("x")))
    means = {r["y"]: F.lit([float(v) for v in r["centroid"]]) for r in centroid(both, "x", "y").collect()}  # two rows
    first = V.sq_dist("x", means[1]) < V.sq_dist("x", means[0])
    return both.agg(F.avg((first == (F.col("y") == 1)).cast("double")).alias("accuracy"))


def artifact_check(matched: DataFrame, random: DataFrame, s: str, probe: DataFrame | None = None) -> DataFrame:
    """Can matched and random backgrounds be told apart by the score, in either direction, or by a probe?

    ``probe`` is one row with the accuracy of a classifier that was asked the same question; without it the score decides alone.
    """
    both = matched.select(F.lit(1).alias("y"), F.col(s)).unionByName(random.select(F.lit(0).alias("y"), F.col(s)))
    sep = F.greatest(F.col("auc"), F.lit(1.0) - F.col("auc"))
    rows = K.auc(both, "y", s).withColumn("separability", sep)
    asked = rows.withColumn("probe", probe.scalar() if probe is not None else F.lit(0.5))
    judged = asked.withColumn("verdict", artifact_grade("separability", "probe"))
    return judged if probe is not None else judged.drop("probe")


def surgery_check(original: DataFrame, modified: DataFrame, matched: DataFrame, s: str) -> DataFrame:
    def one(pos: DataFrame, neg: DataFrame, name: str) -> DataFrame:
        both = pos.select(F.lit(1).alias("y"), F.col(s)).unionByName(neg.select(F.lit(0).alias("y"), F.col(s)))
        return both.withColumn("test", F.lit(name))

    rows = one(original, modified, "original_vs_modified").unionByName(one(modified, matched, "modified_vs_matched"))
    auc = F.col("auc")
    verdict = F.when(auc < 0.55, "CLEAN").when(auc < 0.65, "MOSTLY_CLEAN").when(auc < 0.80, "PARTIALLY_CONTAMINATED")
    return K.auc(rows, "y", s, by=["test"]).withColumn("verdict", verdict.otherwise("HEAVILY_CONTAMINATED"))


def transfer_report(target: DataFrame, background: DataFrame, threshold: DataFrame, type_col: str, col: str = "dist") -> DataFrame:
    """How a model fitted elsewhere does on each type of another dataset."""
    stats = target.withColumn("_hit", (F.col(col) <= threshold.scalar()).cast("double")).groupBy(type_col).agg(
        F.avg(col).alias("mean_dist"), F.avg("_hit").alias("detection_rate")
    )
    score = (-F.col(col)).alias("_s")
    aucs = K.auc_by_type(target.select(type_col, score), background.select(score), "_s", type_col)
    status = F.when(F.col("auc") > 0.9, "PASS").when(F.col("auc") > 0.7, "PARTIAL").otherwise("FAIL")
    return stats.join(aucs, type_col, "left").withColumn("status", status)
