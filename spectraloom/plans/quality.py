"""Embedding-space quality queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from spectraloom.functions import vectors as V
from spectraloom.operators import quality as Q
from spectraloom.operators import tall_qr as TQ
from spectraloom.operators import sampling as D
from spectraloom.plans.base import LONG_CTE, SAMPLES_CTE, R, events, query, r, samples, table

SIL_BODY = """u AS (SELECT sample_id, label AS c, {by} AS g, list_transform(embedding, lambda x: x / sqrt(list_dot_product(embedding, embedding))) AS v FROM samples WHERE {cond}),
pd AS (SELECT a.sample_id, a.g, a.c, b.c AS oc, sum(1 - list_dot_product(a.v, b.v)) AS s, count(*) AS n FROM u a JOIN u b ON a.sample_id <> b.sample_id AND a.g = b.g GROUP BY ALL),
ab AS (SELECT sample_id, g, max(CASE WHEN oc = c THEN s / n END) AS a, min(CASE WHEN oc <> c THEN s / n END) AS b FROM pd GROUP BY ALL)"""


@query(
    "H3",
    f"WITH {SAMPLES_CTE}, {SIL_BODY.format(by='0', cond='true')} SELECT {R('avg(coalesce((b - a) / greatest(a, b), 0))')} AS silhouette, count(*) AS n FROM ab",
)
def silhouette_cosine(spark, sf_dir):
    return Q.silhouette(samples(spark, sf_dir), "label").select(r("silhouette").alias("silhouette"), "n")


@query(
    "H4",
    f"WITH {SAMPLES_CTE}, {SIL_BODY.format(by='label % 3', cond='true')} SELECT CAST(g AS INTEGER) AS family, {R('avg(coalesce((b - a) / greatest(a, b), 0))')} AS silhouette, count(*) AS n FROM ab GROUP BY g",
)
def silhouette_within_family(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("family", (F.col("label") % 3).cast("int"))
    return Q.silhouette(rows, "label", by="family").select("family", r("silhouette").alias("silhouette"), "n")


@query(
    "H4",
    f"WITH {SAMPLES_CTE}, {SIL_BODY.format(by='0', cond='true').replace('label AS c', 'CAST(label >= 8 AS INT) AS c')} SELECT {R('avg((b - a) / greatest(a, b))')} AS silhouette, count(*) AS n FROM ab",
)
def silhouette_drone_or_background(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("is_bg", (F.col("label") >= 8).cast("int"))
    return Q.silhouette(rows, "is_bg").select(r("silhouette").alias("silhouette"), "n")


def _binary(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("y", (F.col("split") != "negatives").cast("int"))
    return rows.withColumn("held", (F.col("split") == "holdout") | ((F.col("split") == "negatives") & (F.col("recording_id") < 10)))


@query("H1")
def linear_probe_recalls(spark, sf_dir):
    """Fitted on train and half of the negatives' recordings, tested on holdout and the other half."""
    rows = _binary(spark, sf_dir)
    out = Q.linear_probe(rows.where("NOT held"), rows.where("held"), "y")
    return out.select("y", "n", r("recall", 4).alias("recall"), "is_total")


@query("H1 D13")
def linear_probe_cross_validated(spark, sf_dir):
    rows = _binary(spark, sf_dir).where("split <> 'holdout'")
    return Q.probe_cv(rows, "y", "sample_id", 3, 5).select("fold", "n", r("accuracy", 4).alias("accuracy"))


@query("H2 D10")
def intent_head_predictions(spark, sf_dir):
    """Three-way head over the vectors, weighted by inverse class frequency."""
    rows = samples(spark, sf_dir).withColumn("intent", F.when(F.col("label") < 2, 0).when(F.col("label") < 7, 1).otherwise(2))
    weights = D.class_weights(rows, "intent").select(F.col("intent").alias("_i"), "weight")
    weighted = rows.join(F.broadcast(weights), F.col("intent") == F.col("_i")).drop("_i")  # one row per class
    out = Q.intent_classifier(weighted.where("recording_id < 15"), rows.where("recording_id >= 15"), "intent", "embedding", "weight")
    return out.select(
        "sample_id", "intent", F.col("predicted").cast("int").alias("predicted"),
        r(V.vec_sum("probabilities"), 4).alias("probability_sum"),
    )


EUCLIDEAN_SIL = f"""{SAMPLES_CTE}, pd AS (SELECT a.sample_id, a.label AS c, b.label AS oc, sum(list_distance(a.embedding, b.embedding)) AS s, count(*) AS n
  FROM samples a JOIN samples b ON a.sample_id <> b.sample_id GROUP BY ALL),
ab AS (SELECT sample_id, c, max(CASE WHEN oc = c THEN s / n END) AS a, min(CASE WHEN oc <> c THEN s / n END) AS b FROM pd GROUP BY ALL),
sil AS (SELECT sample_id, c, a, b, CASE WHEN b IS NOT NULL THEN coalesce((b - a) / greatest(a, b), 0) END AS s FROM ab)"""


@query("H5 H3", f"WITH {EUCLIDEAN_SIL} SELECT sample_id, c AS label, {R('a')} AS a, {R('b')} AS b, {R('s')} AS silhouette FROM sil")
def silhouette_euclidean_of_rows(spark, sf_dir):
    """Unsquared distances between all rows, summed in pairs of blocks."""
    out = Q.euclidean_silhouette(samples(spark, sf_dir), "label", "sample_id")
    return out.select("sample_id", "label", r("a").alias("a"), r("b").alias("b"), r("silhouette").alias("silhouette"))


@query("H5", f"WITH {EUCLIDEAN_SIL} SELECT c AS label, count(s) AS n, {R('avg(s)')} AS silhouette, count(*) FILTER (s < 0) AS misplaced FROM sil GROUP BY c")
def silhouette_euclidean_by_type(spark, sf_dir):
    """Mean silhouette of each type and how many of its rows lie nearer to another type."""
    out = Q.euclidean_silhouette(samples(spark, sf_dir), "label", "sample_id")
    return out.groupBy("label").agg(
        F.count("silhouette").alias("n"), r(F.avg("silhouette")).alias("silhouette"), F.count(F.when(F.col("silhouette") < 0, 1)).alias("misplaced")
    )


@query("H5")
def kmeans_exact_silhouettes(spark, sf_dir):
    out = Q.kmeans_exact_silhouettes(samples(spark, sf_dir), [2, 3], 1, "sample_id")
    return out.select("k", "n", r("silhouette", 4).alias("silhouette"))


@query("H5")
def kmeans_silhouettes(spark, sf_dir):
    out = Q.kmeans_report(samples(spark, sf_dir), [2, 3], seed=1)
    return out.select("k", r("cost", 3).alias("cost"), r("sq_euclidean_silhouette", 4).alias("sq_euclidean_silhouette"))


@query("H6")
def gaussian_mixture_components(spark, sf_dir):
    out = Q.gmm_report(samples(spark, sf_dir), 3, 1, dims=8)
    return out.select("component", "n", r("mean_confidence", 3).alias("mean_confidence"))


@query(
    "H7",
    f"""WITH {LONG_CTE}, s AS (SELECT d, stddev_samp(x) AS sd FROM long GROUP BY d), n AS (SELECT count(*) AS n FROM samples),
u AS (SELECT d, x / sqrt(sum(x * x) OVER (PARTITION BY sample_id)) AS u FROM long), q AS (SELECT sum(t * t) AS sq FROM (SELECT d, sum(u) AS t FROM u GROUP BY d))
SELECT any_value(n) AS n, {R('avg(sd)')} AS mean_std, {R('min(sd)')} AS min_std, CAST(count(*) FILTER (sd > 0.01 * (SELECT max(sd) FROM s)) AS BIGINT) AS active_dims,
 {R('(any_value(sq) - any_value(n)) / (CAST(any_value(n) AS DOUBLE) * any_value(n) - any_value(n))')} AS mean_cosine FROM s CROSS JOIN n CROSS JOIN q""",
)
def collapse_statistics(spark, sf_dir):
    out = Q.collapse_stats(samples(spark, sf_dir))
    return out.select("n", r("mean_std").alias("mean_std"), r("min_std").alias("min_std"), "active_dims", r("mean_cosine").alias("mean_cosine"))


@query("H8")
def effective_rank_of_embeddings(spark, sf_dir):
    return Q.effective_rank(samples(spark, sf_dir)).select("n", "effective_rank", r("largest", 4).alias("largest"))


#: Every vector is its label's axis, so the columns are orthogonal and their lengths are the singular values.
AXES_SQL = "SELECT label, (label + 1) * sqrt(count(*)) AS value FROM embeddings GROUP BY label"


def label_axes(spark, sf_dir):
    axis = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.when(k == F.col("label"), F.col("label") + 1.0).otherwise(0.0))
    return samples(spark, sf_dir).select(axis.alias("embedding"))


@query("H8", f"WITH a AS ({AXES_SQL}) SELECT row_number() OVER (ORDER BY value DESC) AS place, {R('value', 6)} AS value FROM a")
def singular_values_of_label_axes(spark, sf_dir):
    return TQ.singular_values(label_axes(spark, sf_dir)).select("place", r("value", 6).alias("value"))


@query("H8", f"WITH a AS ({AXES_SQL}) SELECT count(*) FILTER (value > 0.2 * (SELECT max(value) FROM a)) AS effective_rank, {R('max(value)', 6)} AS largest FROM a")
def effective_rank_of_label_axes(spark, sf_dir):
    return TQ.effective_rank(label_axes(spark, sf_dir), share=0.2).select("effective_rank", r("largest", 6).alias("largest"))


@query(
    "H9 I",
    f"""WITH h AS (SELECT event_type, CAST(day(ts) AS BIGINT) AS step, round(avg(value), 2) AS loss FROM events GROUP BY ALL),
w AS (SELECT *, max(loss) OVER f - min(loss) OVER f AS rg, count(loss) OVER f AS c FROM h WINDOW f AS (PARTITION BY event_type ORDER BY step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT event_type, step, {R('CASE WHEN c = 5 THEN rg END')} AS range_last, c = 5 AND rg < 10 AS is_plateau FROM w""",
)
def loss_plateaus(spark, sf_dir):
    h = events(spark, sf_dir).groupBy("event_type", F.dayofmonth("ts").cast("long").alias("step")).agg(F.round(F.avg("value"), 2).alias("loss"))
    out = Q.plateau(h, ["event_type"], "step", "loss", 5, 10.0)
    return out.select("event_type", "step", r("range_last").alias("range_last"), "is_plateau")


POINTS = ", ".join(f"({-3 + 6 * i / 7!r})" for i in range(8))


@query(
    "H10",
    f"""WITH {LONG_CTE}, t(t) AS (VALUES {POINTS}), p AS (SELECT d, t, avg(cos(8 * x * t)) AS c, avg(sin(8 * x * t)) AS s FROM long CROSS JOIN t GROUP BY d, t)
SELECT (SELECT count(*) FROM samples) AS n, {R('avg(power(c - exp(-t * t / 2), 2) + s * s)')} AS statistic FROM p""",
)
def normality_along_axes(spark, sf_dir):
    """Characteristic-function gap along every axis (values scaled to unit variance)."""
    rows = samples(spark, sf_dir).select(F.transform("embedding", lambda x: x * 8).alias("embedding"))
    return Q.gaussianity(rows, np.eye(64)).select("n", r("statistic").alias("statistic"))


DIRECTIONS = Q.projections(64, 16, 0)
DIRECTION_ROWS = ", ".join(f"({d + 1}, {k}, CAST({DIRECTIONS[d, k]!r} AS DOUBLE))".replace("np.float64(", "").replace(") AS", " AS") for d in range(64) for k in range(16))


@query(
    "H10",
    f"""WITH {LONG_CTE}, w(d, k, w) AS (VALUES {DIRECTION_ROWS}), t(t) AS (VALUES {POINTS}),
pr AS (SELECT sample_id, k, sum(x * w) AS p FROM long JOIN w USING (d) GROUP BY ALL), e AS (SELECT k, t, avg(cos(p * t)) AS c, avg(sin(p * t)) AS s FROM pr CROSS JOIN t GROUP BY k, t)
SELECT (SELECT count(*) FROM samples) AS n, {R('avg(power(c - exp(-t * t / 2), 2) + s * s)')} AS statistic FROM e""",
)
def normality_along_random_directions(spark, sf_dir):
    return Q.gaussianity(samples(spark, sf_dir), DIRECTIONS).select("n", r("statistic").alias("statistic"))


@query(
    "H11",
    f"WITH {LONG_CTE}, p AS (SELECT d, var_pop(8 * x) AS v FROM long GROUP BY d) SELECT (SELECT count(*) FROM samples) AS n, {R('avg((v - 1) * (v - 1))')} AS statistic FROM p",
)
def projected_variance_along_axes(spark, sf_dir):
    rows = samples(spark, sf_dir).select(F.transform("embedding", lambda x: x * 8).alias("embedding"))
    return Q.gaussianity(rows, np.eye(64), mode="variance").select("n", r("statistic").alias("statistic"))


def _pairs(spark, sf_dir):
    rows = samples(spark, sf_dir)
    pairs = D.positive_pairs(rows, "label", "sample_id", 21)
    a = rows.select(F.col("sample_id").alias("_a"), F.col("embedding").alias("a"))
    b = rows.select(F.col("sample_id").alias("_b"), F.col("embedding").alias("b"))
    return pairs.join(a, F.col("sample_id") == F.col("_a")).join(b, F.col("partner_id") == F.col("_b"))


PAIRS_SQL = f"""{SAMPLES_CTE}, k AS (SELECT sample_id, label, embedding, row_number() OVER (PARTITION BY label ORDER BY md5(sample_id || ':21'), sample_id) AS rn,
  count(*) OVER (PARTITION BY label) AS n, CAST(CAST('0x' || substr(md5(sample_id || ':22'), 1, 8) AS UBIGINT) AS BIGINT) AS h FROM samples),
w AS (SELECT *, (rn - 1 + CASE WHEN n > 1 THEN 1 + h % greatest(n - 1, 1) ELSE 0 END) % n + 1 AS want FROM k),
pp AS (SELECT w.sample_id, w.embedding AS a, p.embedding AS b FROM w JOIN k p ON p.label = w.label AND p.rn = w.want)"""


@query(
    "H12 D11",
    f"WITH {PAIRS_SQL} SELECT {R('avg(power(list_distance(a, b), 2) / 64)')} AS alignment, count(*) AS n_pairs FROM pp",
)
def positive_pair_alignment(spark, sf_dir):
    return Q.alignment(_pairs(spark, sf_dir), "a", "b").select(r("alignment").alias("alignment"), "n_pairs")


@query(
    "H15",
    f"""WITH {PAIRS_SQL}, l AS (SELECT sample_id, unnest(a) AS x, unnest(range(1, 65)) AS d FROM pp),
c AS (SELECT p.d AS i, q.d AS j, covar_samp(p.x, q.x) AS v FROM l p JOIN l q ON p.sample_id = q.sample_id GROUP BY p.d, q.d),
e AS (SELECT sqrt(sum(power(v - CASE WHEN i = j THEN 1 ELSE 0 END, 2))) AS epsilon FROM c),
g AS (SELECT greatest(0, avg(power(list_distance(a, b), 2)) - 2 * 0.01 * 64) AS delta FROM pp), t AS (SELECT delta, epsilon, delta / (2 * 0.99 * 0.01) AS gap_term FROM e CROSS JOIN g)
SELECT {R('delta')} AS delta, {R('epsilon')} AS epsilon, {R('gap_term', 4)} AS gap_term, {R('gap_term + power(epsilon + gap_term, 2)', 2)} AS bound FROM t""",
)
def recovery_error_bound(spark, sf_dir):
    out = Q.recovery_bound(_pairs(spark, sf_dir), 0.99)
    return out.select(r("delta").alias("delta"), r("epsilon").alias("epsilon"), r("gap_term", 4).alias("gap_term"), r("bound", 2).alias("bound"))


def supcon_sql(label: str, name: str) -> str:
    """CTEs ending in one row ``name(statistic, n)`` (check SQL)."""
    return f"""{name}s AS (SELECT sample_id, {label} AS c, list_transform(embedding, lambda x: x / sqrt(list_dot_product(embedding, embedding))) AS u,
  CAST(CAST('0x' || substr(md5(sample_id || ':0'), 1, 8) AS UBIGINT) AS BIGINT) % (SELECT CAST(ceil(count(*) / 256) AS BIGINT) FROM samples) AS blk FROM samples),
{name}p AS (SELECT a.sample_id, a.c = b.c AS same, exp(greatest(-10, least(10, list_dot_product(a.u, b.u) / 0.07))) AS e FROM {name}s a JOIN {name}s b ON a.blk = b.blk AND a.sample_id <> b.sample_id),
{name}r AS (SELECT sample_id, ln(sum(e)) - ln(sum(e) FILTER (same)) AS v FROM {name}p GROUP BY sample_id HAVING count(*) FILTER (same) > 0),
{name} AS (SELECT avg(v) AS statistic, count(*) AS n FROM {name}r)"""


@query("H13", f"WITH {SAMPLES_CTE}, {supcon_sql('label', 'fine')} SELECT {R('statistic')} AS statistic, n FROM fine")
def contrastive_statistic(spark, sf_dir):
    return Q.supcon_stat(samples(spark, sf_dir), "label", "sample_id", 256).select(r("statistic").alias("statistic"), "n")


@query(
    "H14 C2",
    f"""WITH {SAMPLES_CTE}, {supcon_sql('label', 'fine')}, {supcon_sql('CAST(label >= 8 AS INT)', 'coarse')}
SELECT {R('fine.statistic')} AS fine, {R('coarse.statistic')} AS coarse, {R('0.7 * fine.statistic + 0.3 * coarse.statistic')} AS statistic FROM fine CROSS JOIN coarse""",
)
def hierarchical_contrastive_statistic(spark, sf_dir):
    out = Q.hier_supcon_stat(samples(spark, sf_dir), "label", 8, "sample_id", block=256)
    return out.select(r("fine").alias("fine"), r("coarse").alias("coarse"), r("statistic").alias("statistic"))


@query("H16")
def projection_to_two_dimensions(spark, sf_dir):
    out = Q.project_2d(samples(spark, sf_dir), "sample_id")
    return out.select("sample_id", r(F.abs("x"), 4).alias("abs_x"), r(F.abs("y"), 4).alias("abs_y"))


@query(
    "H17 I",
    f"""WITH RECURSIVE h AS (SELECT event_type, CAST(day(ts) AS BIGINT) AS step, round(avg(value) / 100, 4) AS a, round(min(value) / 100, 4) AS b, round(max(value) / 1000, 4) AS c FROM events GROUP BY ALL),
o AS (SELECT event_type, step, a + 2 * b + 0.5 * c AS cb, row_number() OVER (PARTITION BY event_type ORDER BY step) AS i FROM h),
run(event_type, i, best, best_step, waited, step) AS (SELECT event_type, i, cb, step, 0, step FROM o WHERE i = 1
 UNION ALL SELECT o.event_type, o.i, greatest(run.best, o.cb), CASE WHEN o.cb > run.best THEN o.step ELSE run.best_step END, CASE WHEN o.cb > run.best THEN 0 ELSE run.waited + 1 END, o.step
  FROM run JOIN o ON o.event_type = run.event_type AND o.i = run.i + 1 WHERE run.waited < 7),
l AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY i DESC) AS rn FROM run)
SELECT event_type, best_step, {R('best')} AS best_combined, step AS last_step, waited >= 7 AS stopped_early FROM l WHERE rn = 1""",
)
def best_run_with_early_stop(spark, sf_dir):
    h = events(spark, sf_dir).groupBy("event_type", F.dayofmonth("ts").cast("long").alias("step")).agg(
        F.round(F.avg("value") / 100, 4).alias("a"), F.round(F.min("value") / 100, 4).alias("b"), F.round(F.max("value") / 1000, 4).alias("c")
    )
    out = Q.select_best(h, ["event_type"], "step", "a", "b", "c", 7)
    return out.select("event_type", "best_step", r("best_combined").alias("best_combined"), "last_step", "stopped_early")
