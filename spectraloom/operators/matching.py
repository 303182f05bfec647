"""Identification, packet authentication, centroid comparison and pair tests."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectraloom.functions.rows import attach_row
from spectraloom.functions import vectors as V
from spectraloom.functions.arrow import unit_rows, to_list_array, to_matrix
from spectraloom.operators.moments import centroid
from spectraloom.operators.neighbours import nearest_one
from spectraloom.operators.registry import find_by_serial

MATCH_THRESHOLD = 0.85
STACK_BYTES = 64 << 20


def _closest(df: DataFrame, registry: DataFrame, df_id: str, col: str, out_id: str, out_sim: str) -> DataFrame:
    """The most similar registry entry; of equally similar ones the earliest enrolled, then the smallest serial.

    The search breaks ties by the base's id, so the id is the enrolment time in front of the serial.
    """
    if "enrolled_at" not in registry.columns:
        return nearest_one(df, registry, df_id, "serial", col, "fingerprint", out_id, out_sim)
    since = F.coalesce(F.unix_micros(F.col("enrolled_at").cast("timestamp")), F.lit(0)) + F.lit(1 << 62)
    keyed = registry.select(F.concat(F.lpad(since.cast("string"), 20, "0"), F.col("serial")).alias("_key"), "fingerprint")
    found = nearest_one(df, keyed, df_id, "_key", col, "fingerprint", out_id, out_sim)
    return found.withColumn(out_id, F.expr(f"substring({out_id}, 21)"))


def identify(df: DataFrame, registry: DataFrame, df_id: str, col: str, thr: float = MATCH_THRESHOLD) -> DataFrame:
    """Closest registry entry; FRIENDLY at or above the threshold, else UNKNOWN. Empty registry: UNKNOWN, 0."""
    best = _closest(df, registry, df_id, col, "best_serial", "best_sim")
    friendly = F.col("best_sim") >= thr
    return best.withColumn("verdict", F.when(friendly, "FRIENDLY").otherwise("UNKNOWN")).withColumn(
        "similarity", F.coalesce("best_sim", F.lit(0.0))
    ).withColumn("matched", F.when(friendly, F.col("best_serial"))).drop("best_sim")


def all_similarities(df: DataFrame, registry: DataFrame, df_id: str, col: str) -> DataFrame:
    """Long table (id, serial, similarity) with every registry entry, in registry chunks of bounded size."""
    out = None
    for chunk in _registry_chunks(registry):
        serials = [s for s, _ in chunk]
        matrix = unit_rows(np.stack([v for _, v in chunk]))

        def make(m):
            def sims(vectors: pa.Array) -> pa.Array:
                _, x = to_matrix(vectors)
                if not len(x):
                    return pa.array([[]] * len(vectors), pa.list_(pa.float64()))
                return to_list_array(unit_rows(x) @ m.T)

            return F.arrow_udf(sims, "array<double>")

        names = F.array(*[F.lit(s) for s in serials])
        part = (
            df.where(F.col(col).isNotNull())
            .select(F.col(df_id), make(matrix)(F.col(col).cast("array<double>")).alias("_s"))
            .select(df_id, F.posexplode("_s").alias("_p", "similarity"))
            .select(df_id, F.element_at(names, F.col("_p") + 1).alias("serial"), "similarity")
        )
        out = part if out is None else out.unionByName(part)
    return out


def _registry_chunks(registry: DataFrame):
    chunk, size = [], 0
    for row in registry.select("serial", "fingerprint").orderBy("serial").toLocalIterator():
        vec = np.asarray(row["fingerprint"], dtype=float)
        if chunk and size + vec.nbytes > STACK_BYTES:
            yield chunk
            chunk, size = [], 0
        chunk.append((row["serial"], vec))
        size += vec.nbytes
    if chunk:
        yield chunk


def find_by_fingerprint(df: DataFrame, registry: DataFrame, df_id: str, col: str, thr: float = MATCH_THRESHOLD) -> DataFrame:
    """Serial of the closest entry when it is close enough, else NULL."""
    best = _closest(df, registry, df_id, col, "best_serial", "best_sim")
    return best.withColumn("found_serial", F.when(F.col("best_sim") >= thr, F.col("best_serial")))


def authenticate(
    packets: DataFrame,
    registry: DataFrame,
    thr: float = MATCH_THRESHOLD,
    compat: bool = False,
    mode: str = "full",
    packet_id: str = "packet_id",
) -> DataFrame:
    """Verdict for packets (packet_id, serial, fingerprint) against the registry.

    A claimed serial that is enrolled is judged by its own fingerprint; any other packet by the
    closest one. ``compat`` keeps the older rule that no positive similarity counts as an empty
    registry. ``mode="demo"`` reports the similarity itself as confidence and does not look for a
    known transmitter behind an unknown serial.
    """
    enrolled = find_by_serial(packets, registry, "serial")
    best = _closest(enrolled, registry, packet_id, "fingerprint", "closest", "closest_sim")
    claimed_sim = V.cosine("fingerprint", "enrolled_fingerprint")
    rows = best.withColumn("claimed_sim", claimed_sim)
    sim, near = F.col("claimed_sim"), F.col("closest_sim")
    no_print = F.col("fingerprint").isNull()
    nothing = near.isNull() | (near <= 0) if compat else near.isNull()
    known = F.col("is_enrolled")
    hit = sim >= thr
    close = near >= thr
    demo = mode == "demo"

    verdict = (
        F.when(no_print, "UNKNOWN")
        .when(nothing, "NOT_ENROLLED")
        .when(known & hit, "AUTHENTIC")
        .when(known, "SPOOFED")
    )
    confidence = (
        F.when(no_print, F.lit(0.0))
        .when(nothing, F.lit(0.5))
        .when(known & hit, sim if demo else (sim - F.lit(thr)) / F.lit(1.0 - thr + 1e-8))
        .when(known, F.lit(1.0) - sim)
    )
    matched = F.when(no_print | nothing, F.lit(None)).when(known & hit, F.col("serial")).when(known, F.lit(None))
    if not demo:
        verdict = verdict.when(close, "SPOOFED")
        confidence = confidence.when(close, near)
        matched = matched.when(close, F.col("closest"))
    else:
        matched = matched.otherwise(F.col("closest"))
    shown = F.when(no_print | nothing, F.lit(0.0)).when(known, sim).otherwise(near)
    reason = (
        F.when(no_print, F.lit("no fingerprint"))
        .when(nothing, F.lit("registry empty"))
        .when(known & hit, F.format_string("fingerprint matches %s (sim=%.3f)", F.col("serial"), sim))
        .when(known, F.format_string("fingerprint differs from %s (sim=%.3f)", F.col("serial"), sim))
        .when(close, F.format_string("transmitter of %s under another serial (sim=%.3f)", F.col("closest"), near))
        .otherwise(F.format_string("no enrolled match (max sim=%.3f)", near))
    )
    return rows.withColumn("verdict", verdict.otherwise("NOT_ENROLLED")).withColumn(
        "confidence", confidence.otherwise(F.lit(0.5))
    ).withColumn("matched", matched).withColumn("similarity", shown).withColumn("reason", reason).drop(
        "claimed_sim", "closest_sim", "closest", "enrolled_fingerprint"
    )


def centroid_analysis(
    df: DataFrame, type_col: str, split: str = "split", col: str = "embedding", metric: str = "cosine"
) -> DataFrame:
    """Per holdout type: distance of its mean to the nearest train mean and to the background mean.

    Means of types are few (one row per type). The smaller side is compared inside a per-row
    expression over the collected train means rather than by pairing rows.
    """
    means = centroid(df, col, [split, type_col])
    train = means.where(F.col(split) == "train").agg(F.collect_list("centroid").alias("_train"))
    background = centroid(df.where(F.col(split) == "negatives"), col).select(F.col("centroid").alias("_bg"))
    # one row each; the train row holds one vector per type
    held = attach_row(attach_row(means.where(F.col(split) == "holdout"), train), background)

    def dist(a, b):
        if metric == "cosine":
            return F.lit(1.0) - V.dot(a, b) / (V.l2_norm(a) * V.l2_norm(b) + F.lit(1e-8))
        return F.sqrt(V.sq_dist(a, b))

    here = F.col("centroid")
    return held.select(
        type_col,
        F.array_min(F.transform("_train", lambda t: dist(here, t))).alias("d_drone"),
        dist(here, F.col("_bg")).alias("d_background"),
    ).withColumn("detected", F.coalesce(F.col("d_background") > F.col("d_drone"), F.lit(True)))


def centroid_cosine(a: DataFrame, b: DataFrame, col: str = "embedding") -> DataFrame:
    left = centroid(a, col).select(F.col("centroid").alias("_a"))
    right = centroid(b, col).select(F.col("centroid").alias("_b"))
    return attach_row(left, right).select(
        V.cosine("_a", "_b", eps=0.0).alias("cosine")
    )


def unit_separation(df: DataFrame, model: str, unit: str, col: str = "embedding", block: int = 4096) -> DataFrame:
    """Count, mean, min and max of the cosine over all pairs of unit means of one model.

    Units are cut into blocks; a task multiplies one pair of blocks and returns one row, so no pair
    is ever emitted and a model with very many units is many tasks.
    """
    means = centroid(df, col, [model, unit]).select(model, unit, "centroid")
    sizes = means.groupBy(model).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_nb"))
    sized = means.join(sizes, model).withColumn("_b", F.pmod(F.xxhash64(unit), F.col("_nb")).cast("int"))
    left = sized.withColumn("_i", F.col("_b")).withColumn("_j", F.explode(F.sequence("_b", F.col("_nb") - 1)))
    right = sized.select(
        *[F.col(c).alias(c) for c in (model, unit, "centroid", "_b")],
        F.col("_b").alias("_j"), F.explode(F.sequence(F.lit(0), "_b")).alias("_i"),
    )
    schema = T.StructType(
        [means.schema[model]]
        + [T.StructField(n, t) for n, t in (("n", T.LongType()), ("s", T.DoubleType()), ("lo", T.DoubleType()), ("hi", T.DoubleType()))]
    )

    def compare(lt: pa.Table, rt: pa.Table) -> pa.Table:
        names = [model, "n", "s", "lo", "hi"]
        types = [lt.schema.field(model).type, pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        cells = np.empty(0)
        if lt.num_rows and rt.num_rows:
            same = lt.column("_b")[0].as_py() == rt.column("_b")[0].as_py()
            lt, rt = lt.sort_by(unit), rt.sort_by(unit)
            a, b = (unit_rows(to_matrix(t.column("centroid"))[1]) for t in (lt, rt))
            sims = a @ b.T
            cells = sims[np.triu_indices(len(a), 1)] if same else sims.ravel()
        if not cells.size:
            return pa.Table.from_arrays([pa.array([], t) for t in types], names=names)
        row = [lt.column(model)[0].as_py(), cells.size, cells.sum(), cells.min(), cells.max()]
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

    keys = [model, "_i", "_j"]
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, schema)
    return parts.groupBy(model).agg(
        F.sum("n").alias("pairs"), (F.sum("s") / F.sum("n")).alias("mean"), F.min("lo").alias("min"), F.max("hi").alias("max")
    )


def pairwise_within(df: DataFrame, model: str, unit: str, col: str = "embedding") -> DataFrame:
    """Cosine of every pair of unit means inside a model (i < j); rows are units, not samples."""
    means = centroid(df, col, [model, unit]).select(model, unit, V.l2_normalize("centroid", 0.0).alias("_u"))
    other = means.select(F.col(model).alias("_m"), F.col(unit).alias("other_unit"), F.col("_u").alias("_w"))
    pairs = means.join(other, (F.col(model) == F.col("_m")) & (F.col(unit) < F.col("other_unit")))
    return pairs.select(model, unit, "other_unit", V.dot("_u", "_w").alias("cosine"))


def pairwise_closer(pairs: DataFrame, drone: str, background: str, by: str) -> DataFrame:
    """Share of pairs whose drone is closer than its own background, per type and overall (NULL)."""
    d, b = F.col(drone), F.col(background)
    margin = F.when(d > b, d - b)
    return pairs.rollup(by).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.sum((d < b).cast("long")).alias("closer"),
        F.sum((d == b).cast("long")).alias("ties"),
        F.avg((d < b).cast("double")).alias("closer_rate"),
        F.avg(margin).alias("mean_failure_margin"),
        F.max(margin).alias("max_failure_margin"),
        F.grouping(by).cast("long").alias("is_total"),
    )


def contrast_argmax(a: DataFrame, b: DataFrame, key: str, score: str) -> DataFrame:
    """The row whose score differs most between two models."""
    other = b.select(F.col(key).alias("_k"), F.col(score).alias("_other"))
    both = a.join(other, F.col(key) == F.col("_k")).withColumn("contrast", F.col("_other") - F.col(score))
    pick = F.max_by(F.struct(key, "contrast"), F.struct(F.col("contrast"), -F.col(key)))
    return both.agg(pick.alias("_p")).select("_p.*")


def closer_fraction(df: DataFrame, dist: str, reference: DataFrame, ref_dist: str) -> DataFrame:
    """Per reference row: the share of rows in ``df`` that are closer than it."""
    from spectraloom.operators.ranking import pct_rank

    ranked = pct_rank(reference.withColumn("_d", -F.col(ref_dist)), df.select((-F.col(dist)).alias("_d")), "_d", "_pct")
    return ranked.withColumn("closer_fraction", F.col("_pct") / 100).drop("_d", "_pct")


def replay_report(originals: DataFrame, replays: DataFrame, key: str, threshold: float) -> DataFrame:
    """Per original: distance of its replays to it, verdict agreement, distance drift, ghost rate."""
    right = originals.select(
        F.col(key).alias("_k"), F.col("embedding").alias("_oe"), F.col("dist").alias("_od")
    )
    both = replays.join(right, F.col(key) == F.col("_k"))
    mine, theirs = F.col("dist") <= threshold, F.col("_od") <= threshold
    return both.groupBy(key).agg(
        F.count(F.lit(1)).alias("replays"),
        F.avg(F.sqrt(V.sq_dist("embedding", "_oe"))).alias("spread"),
        F.bool_and(mine == theirs).alias("consistent"),
        F.avg(F.abs(F.col("dist") - F.col("_od"))).alias("dist_variation"),
        F.avg(mine.cast("double")).alias("ghost_rate"),
    )


def restrict_to_enrolled(df: DataFrame, registry: DataFrame, type_col: str, registry_type: str = "drone_type", keep: bool = True) -> DataFrame:
    kind = "left_semi" if keep else "left_anti"
    return df.join(registry.select(F.col(registry_type).alias("_t")), F.col(type_col).cast("string") == F.col("_t"), kind)


def label_diff(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    return a.select(col).distinct().subtract(b.select(col).distinct())


def union_populations(populations: dict[str, tuple[DataFrame, int]], cols: list[str]) -> DataFrame:
    out = None
    for name, (df, truth) in populations.items():
        part = df.select(*cols).withColumn("population", F.lit(name)).withColumn("y", F.lit(truth))
        out = part if out is None else out.unionByName(part)
    return out
