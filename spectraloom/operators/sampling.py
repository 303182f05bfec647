"""Seeded sampling, splitting and pairing by hash order: the same rows at any partitioning.

The order is md5(id ':' seed); its first characters cut the order into even ranges, so ranks inside
a group with most of the rows are still computed by many tasks. The number of characters follows the
number of rows, and only ids are ranked: wide columns are joined back afterwards.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.operators.prefix import ordered_rank, range_cuts, range_of

ROWS_PER_RANGE = 200_000
WEIGHT_PART = 500.0  # exp(-500) is still a normal number


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def hash_key(col: Column | str, seed: int) -> Column:
    return F.md5(F.concat(_c(col).cast("string"), F.lit(f":{seed}")))


def hash_int(col: Column | str, seed: int) -> Column:
    """32 hash bits as a non-negative long."""
    return F.conv(F.substring(hash_key(col, seed), 1, 8), 16, 10).cast("long")


def hash_rank(df: DataFrame, by: list[str], id_col: str, seed: int, out: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Rank of each row in hash order within ``by``. Pass ids and keys only; join wide columns back."""
    digits = max(1, math.ceil(math.log(max(1, df.count() / rows_per_range), 16)))
    keyed = df.withColumn("_h", hash_key(id_col, seed)).withColumn("_hr", F.substring("_h", 1, digits))
    return ordered_rank(keyed, by, ["_hr"], [F.col("_h"), F.col(id_col)], out).drop("_h", "_hr")


def sample_n(df: DataFrame, n: int, id_col: str, seed: int) -> DataFrame:
    """Exactly n rows (or all).

    Counts per hash prefix say which prefixes are in as a whole; only the ids of the one prefix the
    limit falls into are ordered.
    """
    ids = df.select(F.col(id_col).alias("_id"))
    prefix = F.substring(hash_key("_id", seed), 1, 4)
    counts = sorted((r[0] or "", r[1]) for r in ids.groupBy(prefix).count().collect())  # at most 65,536 rows
    taken, border = 0, None
    for value, size in counts:
        if taken + size > n:
            border = value
            break
        taken += size
    if border is None:
        return df
    last = ids.where(prefix == border).orderBy(hash_key("_id", seed), "_id").limit(n - taken)
    picked = ids.where(prefix < border).unionAll(last)
    return df.join(picked, F.col(id_col) == F.col("_id"), "left_semi")


def cap_per_group(df: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """First n rows per group in key order; the limit also runs before the shuffle."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def sample_per_group(df: DataFrame, by: str, id_col: str, n: int, seed: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(hash_key(id_col, seed), id_col)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def balanced_sample(df: DataFrame, by: str, id_col: str, n: int, seed: int) -> DataFrame:
    """Up to max(1, n // types) rows of every type in key order, then n of those at random."""
    types = df.agg(F.count_distinct(by)).first()[0]
    quota = max(1, n // max(types, 1))
    return sample_n(cap_per_group(df, by, [id_col], quota), n, id_col, seed)


def allocate_holdout(type_counts: DataFrame, k: int, min_samples: int, category: str = "category") -> DataFrame:
    """How many types each category gives to the holdout set (type_counts: type, n, category)."""
    eligible = type_counts.where(F.col("n") >= min_samples)
    sizes = eligible.groupBy(category).agg(F.count(F.lit(1)).alias("size"))
    everything = Window.partitionBy()  # one row per category
    total = F.sum("size").over(everything)
    goal = F.least(F.lit(k), total)
    share = F.bround(F.col("size") / total * goal)
    first = F.least(F.col("size"), F.greatest(F.lit(1), share.cast("long")))
    drafted = sizes.withColumn("_first", first).withColumn("_left", goal - F.sum("_first").over(everything))
    grow = F.when(F.col("_first") < F.col("size"), F.row_number().over(
        Window.partitionBy(F.col("_first") < F.col("size")).orderBy(F.col("size").desc(), category)))
    shrink = F.when(F.col("_first") > 1, F.row_number().over(
        Window.partitionBy(F.col("_first") > 1).orderBy(F.col("_first").desc(), category)))
    change = F.when((F.col("_left") > 0) & (grow <= F.col("_left")), 1).when(
        (F.col("_left") < 0) & (shrink <= -F.col("_left")), -1).otherwise(0)
    return drafted.select(category, "size", (F.col("_first") + change).alias("n_holdout"))


def select_holdout(
    type_counts: DataFrame, k: int = 7, min_samples: int = 100, seed: int = 42, type_col: str = "type", category: str = "category"
) -> DataFrame:
    """Split of every type; the holdout ones are picked by hash order inside their category."""
    quota = allocate_holdout(type_counts, k, min_samples, category).select(
        F.col(category).alias("_c"), F.col("n_holdout").alias("_q")
    )
    eligible = F.col("n") >= min_samples
    w = Window.partitionBy(category, eligible).orderBy(hash_key(type_col, seed), type_col)
    ranked = type_counts.withColumn("_rn", F.row_number().over(w)).join(quota, F.col(category) == F.col("_c"), "left")
    held = eligible & (F.col("_rn") <= F.coalesce("_q", F.lit(0)))
    return ranked.select(type_col, category, "n", F.when(held, "holdout").otherwise("train").alias("split"))


def apply_split(df: DataFrame, assignment: DataFrame, type_col: str, default: Column | str) -> DataFrame:
    """Split by assignment, falling back to the row's own; rows are not moved."""
    right = assignment.select(F.col(type_col).alias("_t"), F.col("split").alias("_split"))
    return df.join(right, F.col(type_col) == F.col("_t"), "left").withColumn(
        "split", F.coalesce("_split", _c(default))
    ).drop("_t", "_split")


def add_split_version(versions: DataFrame, new: DataFrame, version: str, force: bool = False) -> DataFrame:
    """Add an assignment under a version name; an existing version is only replaced when forced."""
    exists = not versions.where(F.col("split_version") == version).isEmpty()
    if exists and not force:
        raise ValueError(f"split {version} exists already")
    kept = versions.where(F.col("split_version") != version)
    return kept.unionByName(new.withColumn("split_version", F.lit(version)).select(*versions.columns))


def enroll_test_split(df: DataFrame, by: str, id_col: str, seed: int, least: int = 3) -> DataFrame:
    """Random halves per type; the enrolment half has at least ``least`` rows."""
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed(by, "_t")
    ranked = hash_rank(df, [by], id_col, seed, "_rank").join(sizes, F.col(by) == F.col("_t"))
    cut = F.greatest(F.lit(least), F.floor(F.col("_n") / 2))
    return ranked.withColumn("half", F.when(F.col("_rank") <= cut, "enroll").otherwise("test")).drop("_rank", "_n", "_t")


def group_split(df: DataFrame, group: str, train_share: float, seed: int) -> DataFrame:
    """Whole groups on one side or the other."""
    side = F.when(hash_int(group, seed) % 10_000 < F.lit(int(round(train_share * 10_000))), "train").otherwise("test")
    return df.withColumn("side", side)


def leaked_groups(df: DataFrame, group: str, side: str = "side") -> DataFrame:
    """Groups that appear on both sides; an honest split has none."""
    return df.groupBy(group).agg(F.count_distinct(side).alias("sides")).where("sides > 1")


def balance_weights(df: DataFrame, label: str) -> DataFrame:
    """Minority rows weigh the class ratio, others 1."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()  # one row per class
    least, most = F.min("n").over(every), F.max("n").over(every)
    return counts.withColumn("weight", F.when(F.col("n") == least, most / least).otherwise(F.lit(1.0)))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Inverse frequencies scaled to (1/c) * sum(c) / K."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()  # one row per class
    return counts.withColumn(
        "weight", F.sum("n").over(every) / (F.col("n") * F.count(F.lit(1)).over(every))
    )


def weighted_resample(df: DataFrame, id_col: str, weight: Column | str, seed: int) -> DataFrame:
    """Resample with replacement: each row appears Poisson(weight) times, drawn from its own hash.

    A large weight is the sum of equal parts of at most WEIGHT_PART with a draw each. A weight that is null,
    NaN or not positive gives no copies; an infinite one is an error.
    """

    @F.arrow_udf("long")
    def poisson(u: pa.Array, w: pa.Array) -> pa.Array:
        p = u.to_numpy(zero_copy_only=False).astype(float)
        lam = w.to_numpy(zero_copy_only=False).astype(float)
        term, k = np.exp(-lam), np.zeros(len(p), dtype=np.int64)
        total = term.copy()
        while True:
            open_ = (p > total) & (term > 1e-300) & (k < lam + 60 * np.sqrt(lam + 1))
            if not open_.any():
                return pa.array(k)
            k = k + open_
            term = np.where(open_, term * lam / np.maximum(k, 1), term)
            total = np.where(open_, total + term, total)

    w = _c(weight).cast("double")
    checked = F.when(w == float("inf"), F.raise_error(F.lit("infinite weight"))).when((w > 0) & ~F.isnan(w), w)
    weighted = df.withColumn("_w", checked.cast("double")).where("_w IS NOT NULL")
    draws = weighted.select(F.col(id_col).alias("_id"), "_w").distinct().withColumn("_parts", F.ceil(F.col("_w") / WEIGHT_PART))
    draws = draws.withColumn("_part", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_parts"))))
    key = F.when(F.col("_part") == 1, F.col("_id").cast("string")).otherwise(F.concat_ws("/", F.col("_id").cast("string"), "_part"))
    u = (hash_int(key, seed) + F.lit(0.5)) / F.lit(float(1 << 32))
    drawn = draws.select("_id", "_w", poisson(u, F.col("_w") / F.col("_parts")).alias("_k"))
    totals = drawn.groupBy("_id", "_w").agg(F.sum("_k").alias("_k")).where("_k > 0").select("_id", F.col("_w").alias("_w2"), "_k")
    counted = weighted.join(totals, (F.col(id_col) == F.col("_id")) & (F.col("_w") == F.col("_w2"))).drop("_id", "_w", "_w2")
    return counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_k")))).drop("_k")


def positive_pairs(df: DataFrame, by: str, id_col: str, seed: int) -> DataFrame:
    """A random other row of the same type for every row, itself when it is alone."""
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed(by, "_t")
    ranked = hash_rank(df.select(id_col, by), [by], id_col, seed, "_rank").join(sizes, F.col(by) == F.col("_t")).drop("_t")
    shift = F.when(F.col("_n") > 1, F.lit(1) + hash_int(id_col, seed + 1) % (F.col("_n") - 1)).otherwise(F.lit(0))
    asked = ranked.withColumn("_want", (F.col("_rank") - 1 + shift) % F.col("_n") + 1)
    partner = ranked.select(F.col(by).alias("_t"), F.col("_rank").alias("_r"), F.col(id_col).alias("partner_id"))
    return asked.join(partner, (F.col(by) == F.col("_t")) & (F.col("_want") == F.col("_r"))).select(
        id_col, by, "partner_id"
    )


def position_of(df: DataFrame, id_col: str, out: str = "position") -> DataFrame:
    """Position in id order over the whole table, by id ranges."""
    cuts = range_cuts(df.select(F.col(id_col).cast("double").alias("v")), "v")
    ranged = df.withColumn("_r", range_of(id_col, cuts))
    return ordered_rank(ranged, [], ["_r"], [F.col(id_col)], out, whole=not cuts).drop("_r")


def pair_by_position(a: DataFrame, b: DataFrame, a_id: str, b_id: str) -> DataFrame:
    """i-th row of one side with the i-th of the other; the longer side's tail is left out."""
    left = position_of(a, a_id)
    right = position_of(b, b_id, "_pos")
    return left.join(right, F.col("position") == F.col("_pos")).drop("_pos")


def pair_by_source(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Pair rows that come from the same source sample."""
    return a.join(b, key)


def kfold(df: DataFrame, id_col: str, k: int, seed: int, stratify: str | None = None) -> DataFrame:
    """Fold number per row; stratified folds deal the hash order of every class round robin."""
    if stratify is None:
        return df.withColumn("fold", (hash_int(id_col, seed) % k).cast("int"))
    ranked = hash_rank(df.select(id_col, stratify), [stratify], id_col, seed, "_rank")
    folds = ranked.select(F.col(id_col).alias("_id"), ((F.col("_rank") - 1) % k).cast("int").alias("fold"))
    return df.join(folds, F.col(id_col) == F.col("_id")).drop("_id")
