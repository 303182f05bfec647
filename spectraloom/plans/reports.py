"""Moments, models, summaries and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectraloom.operators import gaussian as G
from spectraloom.operators import moment_store as MS
from spectraloom.operators import moments as M
from spectraloom.operators import reports as P
from spectraloom.operators import sketches as K
from spectraloom.operators import studies as U
from spectraloom.operators.prefix import exact_percentiles
from spectraloom.plans.base import LONG_CTE, SAMPLES_CTE, R, events, query, r, samples, table
from spectraloom.plans.detection import SCORES_CTE, TRAIN_DIST, cosine_scores, distance_sql, train_of
from spectraloom.plans.ranking import PRICED, priced
from spectraloom.session import materialize

# ---- moments and models -------------------------------------------------------------------------


@query("E1", f"WITH {LONG_CTE} SELECT d AS dim, {R('avg(x)')} AS mean FROM long WHERE split = 'train' GROUP BY d")
def centroid_of_train(spark, sf_dir):
    c = M.centroid(train_of(samples(spark, sf_dir)))
    return c.select(F.posexplode("centroid").alias("p", "m")).select((F.col("p") + 1).cast("long").alias("dim"), r("m").alias("mean"))


@query("E2", f"WITH {LONG_CTE} SELECT label, d AS dim, {R('avg(x)')} AS mean FROM long GROUP BY label, d")
def centroid_by_label(spark, sf_dir):
    c = M.centroid(samples(spark, sf_dir), by="label")
    return c.select("label", F.posexplode("centroid").alias("p", "m")).select("label", (F.col("p") + 1).cast("long").alias("dim"), r("m").alias("mean"))


COV_SQL = "SELECT {key}a.d AS i, b.d AS j, {cov} AS cov FROM long a JOIN long b ON a.sample_id = b.sample_id AND a.d <= b.d {where} GROUP BY {key}a.d, b.d"


@query("E3", f"WITH {LONG_CTE} " + COV_SQL.format(key="", cov=R("covar_samp(a.x, b.x)", 8), where="WHERE a.split = 'train'"))
def covariance_of_train(spark, sf_dir):
    return M.covariance_long(train_of(samples(spark, sf_dir))).select("i", "j", r("cov", 8).alias("cov"))


@query("E3 J7", f"WITH {LONG_CTE} " + COV_SQL.format(key="", cov=R("covar_samp(a.x, b.x)", 8), where="WHERE a.split = 'train'"))
def covariance_from_stored_moments(spark, sf_dir):
    """The training fit, merged from one stored row per type."""
    slices = materialize(MS.slice_moments(samples(spark, sf_dir), ["label"]), "moments")
    return MS.covariance_rows(MS.combine(slices.where("label <= 5"))).select("i", "j", r("cov", 8).alias("cov"))


@query("E3 J7", f"WITH {LONG_CTE} " + COV_SQL.format(key="", cov=R("covar_samp(a.x, b.x)", 8), where="WHERE a.split = 'train'"))
def covariance_after_types_leave(spark, sf_dir):
    """The fit of all types from which the stored rows of the others are taken out: again the training fit."""
    slices = materialize(MS.slice_moments(samples(spark, sf_dir), ["label"]), "moments")
    left = MS.combine(slices, slices.where("label > 5"))
    return MS.covariance_rows(left).select("i", "j", r("cov", 8).alias("cov"))


@query("E4", f"WITH {LONG_CTE} " + COV_SQL.format(key="a.label, ", cov=R("covar_samp(a.x, b.x)", 8), where=""))
def covariance_by_label(spark, sf_dir):
    return M.covariance_long(samples(spark, sf_dir), by=["label"]).select("label", "i", "j", r("cov", 8).alias("cov"))


PLAIN_DIST = distance_sql("split = 'train'", l2=False)
TYPE_DIST = distance_sql("split = 'train' AND label = ml", "ml", "(SELECT unnest(range(0, 6)) AS ml)")


@query("F1 E3", f"WITH RECURSIVE {PLAIN_DIST} SELECT sample_id, {R('dist')} AS dist FROM dist")
def mahalanobis_distances(spark, sf_dir):
    rows = samples(spark, sf_dir)
    out = G.mahalanobis(rows, G.fit_gaussian(train_of(rows), l2=False), l2=False)
    return out.select("sample_id", r("dist").alias("dist"))


@query("F2 E3", f"WITH RECURSIVE {TRAIN_DIST} SELECT sample_id, {R('dist')} AS dist FROM dist")
def mahalanobis_distances_normalized(spark, sf_dir):
    rows = samples(spark, sf_dir)
    out = G.mahalanobis(rows, G.fit_gaussian(train_of(rows)))
    return out.select("sample_id", r("dist").alias("dist"))


@query(
    "F3 E4",
    f"WITH RECURSIVE {TYPE_DIST} SELECT sample_id, {R('min(dist)')} AS dist, CAST(arg_min(ml, dist) AS INTEGER) AS nearest_type FROM dist GROUP BY sample_id",
)
def mahalanobis_to_nearest_type(spark, sf_dir):
    rows = samples(spark, sf_dir)
    out = G.mahalanobis_nearest(rows, G.fit_gaussian(train_of(rows), by=["label"]), "label")
    return out.select("sample_id", r("dist").alias("dist"), "nearest_type")


@query("F4", f"WITH {SCORES_CTE} SELECT sample_id, label, dist FROM scores")
def cosine_distance_to_centroid(spark, sf_dir):
    return cosine_scores(spark, sf_dir).select("sample_id", "label", "dist")


@query(
    "E5",
    f"""WITH {SCORES_CTE} SELECT count(*) AS n, {R('quantile_cont(dist, 0.5)')} AS p50, {R('quantile_cont(dist, 0.75)')} AS p75, {R('quantile_cont(dist, 0.9)')} AS p90,
 {R('quantile_cont(dist, 0.95)')} AS p95, {R('quantile_cont(dist, 0.99)')} AS p99, {R('quantile_cont(dist, 0.99)')} AS threshold FROM scores WHERE split = 'train'""",
)
def distance_percentiles_and_threshold(spark, sf_dir):
    out = G.fit_threshold(train_of(cosine_scores(spark, sf_dir)))
    names = ["p50", "p75", "p90", "p95", "p99"]
    return out.select("n", *[r(F.element_at("pct", i + 1)).alias(n) for i, n in enumerate(names)], r("threshold").alias("threshold"))


# ---- summaries ----------------------------------------------------------------------------------


def _q(col: str, p: float) -> str:
    return R(f"quantile_cont({col}, {p})")


@query(
    "E6",
    f"""SELECT l_returnflag, count(*) AS n, {R('avg(l_extendedprice)', 4)} AS "mean", {_q('l_extendedprice', 0.5)} AS median, {R('stddev_pop(l_extendedprice)', 4)} AS std,
 {R('min(l_extendedprice)')} AS "min", {R('max(l_extendedprice)')} AS "max", {_q('l_extendedprice', 0.05)} AS p5, {_q('l_extendedprice', 0.95)} AS p95 FROM lineitem GROUP BY 1""",
)
def score_summary_by_population(spark, sf_dir):
    out = P.score_summary(table(spark, sf_dir, "lineitem"), "l_extendedprice", by=["l_returnflag"])
    return out.select(
        "l_returnflag", "n", r("mean", 4).alias("mean"), r("median").alias("median"), r("std", 4).alias("std"),
        *[r(c).alias(c) for c in ("min", "max", "p5", "p95")],
    )


@query("E6", f"WITH {SCORES_CTE} SELECT {R('(SELECT avg(dist) FROM scores WHERE y = 0) / (SELECT avg(dist) FROM scores WHERE y = 1)')} AS ratio")
def background_to_drone_ratio(spark, sf_dir):
    return P.mean_ratio(cosine_scores(spark, sf_dir), "dist", "y").select(r("ratio").alias("ratio"))


@query(
    "E7",
    f"SELECT event_type, count(*) AS n, {_q('value', 0.1)} AS p10, {_q('value', 0.25)} AS p25, {_q('value', 0.5)} AS p50, {_q('value', 0.75)} AS p75, {_q('value', 0.9)} AS p90 FROM events GROUP BY 1",
)
def feature_profile_by_type(spark, sf_dir):
    out = P.profile(events(spark, sf_dir), "value", by=["event_type"])
    return out.select("event_type", "n", *[r(c).alias(c) for c in ("p10", "p25", "p50", "p75", "p90")])


@query("E8", f"WITH {PRICED} SELECT y, family, count(*) AS n, {R('avg(CASE WHEN qty <= 20 THEN 1.0 ELSE 0 END)')} AS detection_rate FROM priced GROUP BY ALL")
def detection_rate_by_group(spark, sf_dir):
    out = P.detection_rate(priced(spark, sf_dir), 20.0, by=["y", "family"], col="qty")
    return out.select("y", "family", "n", r("detection_rate").alias("detection_rate"))


@query(
    "E9 I",
    f"""WITH {SCORES_CTE}, t AS (SELECT quantile_cont(dist, 0.95) AS thr FROM scores WHERE split = 'train'), j AS (SELECT label, dist, CASE WHEN (dist <= thr) = (y = 1) THEN 1.0 ELSE 0 END AS ok FROM scores CROSS JOIN t)
SELECT label, count(*) AS n, {R('avg(ok)')} AS accuracy, {R('avg(dist)')} AS mean_dist, CAST(grouping(label) AS BIGINT) AS is_total FROM j GROUP BY ROLLUP (label)""",
)
def batch_report_by_type(spark, sf_dir):
    rows = cosine_scores(spark, sf_dir)
    thr = exact_percentiles(train_of(rows), "dist", [0.95]).select(F.element_at("pct", 1))
    out = P.batch_report(rows.withColumn("thr", thr.scalar()), F.col("thr"), "label", "y")
    return out.select("label", "n", r("accuracy").alias("accuracy"), r("mean_dist").alias("mean_dist"), "is_total")


GUESS_SQL = "SELECT event_type AS truth, CASE WHEN value < 10 THEN 'view' WHEN value < 25 THEN 'click' WHEN value < 60 THEN 'purchase' WHEN event_id % 3 = 0 THEN 'error' ELSE event_type END AS guess FROM events"


def guesses(spark, sf_dir):
    v = F.col("value")
    guess = F.when(v < 10, "view").when(v < 25, "click").when(v < 60, "purchase").when(F.col("event_id") % 3 == 0, "error").otherwise(F.col("event_type"))
    return events(spark, sf_dir).select(F.col("event_type").alias("truth"), guess.alias("guess"))


@query(
    "E10",
    f"""WITH g AS ({GUESS_SQL}), l(truth, ord) AS (VALUES ('click', 0), ('view', 1), ('error', 2), ('absent', 3))
SELECT l.truth, CAST(ord AS BIGINT) AS ord, count(*) FILTER (guess = 'click') AS as_click, count(*) FILTER (guess = 'view') AS as_view, count(*) FILTER (guess = 'error') AS as_error, count(*) FILTER (guess = 'absent') AS as_absent
FROM l LEFT JOIN g USING (truth) GROUP BY ALL""",
)
def confusion_with_fixed_labels(spark, sf_dir):
    return P.confusion(guesses(spark, sf_dir), "truth", "guess", ["click", "view", "error", "absent"])


@query("E10", "SELECT CAST(CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS VARCHAR) AS truth, CAST(CASE WHEN quality = 1 THEN 0 ELSE 1 END AS BIGINT) AS ord, count(*) FILTER (toxic = 0) AS as_good, count(*) FILTER (toxic = 1) AS as_bad FROM labels GROUP BY ALL")
def confusion_of_document_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(
        F.when(F.col("quality") == 1, "good").otherwise("bad").alias("truth"), F.when(F.col("toxic") == 0, "good").otherwise("bad").alias("guess")
    )
    return P.confusion(rows, "truth", "guess", ["good", "bad"])


@query(
    "E11",
    f"""WITH g AS ({GUESS_SQL}), t AS (SELECT truth AS label, count(*) AS support, count(*) FILTER (truth = guess) AS hit FROM g GROUP BY 1), p AS (SELECT guess AS label, count(*) AS guessed FROM g GROUP BY 1),
c AS (SELECT label, coalesce(support, 0) AS support, coalesce(guessed, 0) AS guessed, coalesce(hit, 0) AS hit FROM t FULL JOIN p USING (label)),
m AS (SELECT label, CASE WHEN guessed > 0 THEN hit / guessed ELSE 0 END AS precision, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS recall, 2.0 * hit / (support + guessed) AS f1, support FROM c)
SELECT label, {R('precision')} AS precision, {R('recall')} AS recall, {R('f1')} AS f1, CAST(support AS BIGINT) AS support FROM m
UNION ALL SELECT 'macro', {R('avg(precision)')}, {R('avg(recall)')}, {R('avg(f1)')}, CAST(sum(support) AS BIGINT) FROM m
UNION ALL SELECT 'accuracy', {R('sum(hit) / sum(support)')}, {R('sum(hit) / sum(support)')}, {R('sum(hit) / sum(support)')}, CAST(sum(support) AS BIGINT) FROM c""",
)
def classification_report(spark, sf_dir):
    out = P.class_report(guesses(spark, sf_dir), "truth", "guess")
    return out.select("label", *[r(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("E12", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def label_distribution(spark, sf_dir):
    return table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


HIST_SQL = "h AS (SELECT l_returnflag AS method, l_suppkey % 5 AS seed, CAST(l_linenumber AS BIGINT) AS step, avg(l_discount) AS acc FROM lineitem GROUP BY ALL)"


def runs(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_returnflag").alias("method"), (F.col("l_suppkey") % 5).alias("seed"), F.col("l_linenumber").cast("long").alias("step")
    ).agg(F.avg("l_discount").alias("acc"))


@query(
    "E13",
    f'WITH {HIST_SQL}, f AS (SELECT method, seed, arg_max(acc, step) AS acc FROM h GROUP BY ALL) SELECT method, {R("avg(acc)")} AS "mean", {R("stddev_pop(acc)")} AS std, {R("min(acc)")} AS "min", {R("max(acc)")} AS "max", count(*) AS seeds FROM f GROUP BY method',
)
def final_accuracy_over_seeds(spark, sf_dir):
    out = P.seed_summary(runs(spark, sf_dir), ["method"], "acc", "seed", "step")
    return out.select("method", *[r(c).alias(c) for c in ("mean", "std", "min", "max")], "seeds")


@query("E14", f'WITH {HIST_SQL} SELECT method, step, {R("avg(acc)")} AS "mean", {R("stddev_pop(acc)")} AS std, count(*) AS n FROM h GROUP BY ALL')
def accuracy_curve_over_seeds(spark, sf_dir):
    out = P.step_curve(runs(spark, sf_dir), ["method", "step"], "acc")
    return out.select("method", "step", r("mean").alias("mean"), r("std").alias("std"), "n")


@query(
    "E15",
    """WITH r AS (SELECT l_linestatus AS status, l_quantity AS v, 40.0 AS hi FROM lineitem), i AS (SELECT status, least(CAST(floor(v / (hi / 16)) AS BIGINT), 15) AS bin FROM r WHERE v >= 0 AND v <= hi),
c AS (SELECT status, bin, count(*) AS n FROM i GROUP BY ALL)
SELECT status, bin, """ + R("bin * 2.5") + " AS left_edge, n, " + R("n / (sum(n) OVER (PARTITION BY status) * 2.5)") + " AS density FROM c",
)
def density_histogram(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("status"), F.col("l_quantity").alias("v"))
    out = P.histogram(rows, "v", 16, 0, 40, by=["status"])
    return out.select("status", "bin", r("left_edge").alias("left_edge"), "n", r("density").alias("density"))


@query(
    "E15",
    f"""WITH {SCORES_CTE}, h AS (SELECT least(max(dist), 100) AS hi FROM scores), b AS (SELECT y, least(CAST(floor(dist / (hi / 20)) AS BIGINT), 19) AS bin FROM scores CROSS JOIN h WHERE dist >= 0 AND dist <= hi)
SELECT y, bin, count(*) AS n FROM b GROUP BY ALL""",
)
def distance_histograms_to_maximum(spark, sf_dir):
    """Bins over [0, min(max, 100)]; the upper edge is a one-row subquery."""
    rows = cosine_scores(spark, sf_dir)
    top = rows.agg(F.least(F.max("dist"), F.lit(100.0)))
    staged = rows.withColumn("hi", top.scalar())
    return P.histogram(staged, "dist", 20, 0, F.col("hi"), by=["y"]).select("y", "bin", "n")


@query(
    "E16",
    f"""WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
SELECT event_type, count(*) AS n, {R('min(CASE WHEN value >= q1 - 1.5 * (q3 - q1) THEN value END)')} AS whisker_low, {R('any_value(q1)')} AS q1, {R('any_value(med)')} AS median, {R('any_value(q3)')} AS q3,
 {R('max(CASE WHEN value <= q3 + 1.5 * (q3 - q1) THEN value END)')} AS whisker_high FROM events JOIN q USING (event_type) GROUP BY 1""",
)
def box_statistics_by_type(spark, sf_dir):
    out = P.box_stats(events(spark, sf_dir), "value", ["event_type"])
    return out.select("event_type", "n", *[r(c).alias(c) for c in ("whisker_low", "q1", "median", "q3", "whisker_high")])


@query("E17", f"WITH {LONG_CTE} SELECT d AS bin, {R('greatest(avg(x), 0)')} AS envelope FROM long WHERE split = 'train' GROUP BY d")
def spectral_envelope_of_train(spark, sf_dir):
    from spectraloom.operators.augment import envelope

    rows = train_of(samples(spark, sf_dir)).select(F.col("embedding").alias("spec"), F.lit(1).alias("c"), F.lit(64).alias("h"), F.lit(1).alias("w"))
    return envelope(rows).select(F.posexplode("envelope").alias("p", "e")).select((F.col("p") + 1).cast("long").alias("bin"), r("e").alias("envelope"))


@query(
    "E19",
    f"""WITH {LONG_CTE}, p AS (SELECT sample_id, sum(abs(x - CASE WHEN sample_id % 4 = 0 AND x > 0.1 THEN 0.1 ELSE x END)) AS d FROM long GROUP BY 1)
SELECT count(*) AS n_pairs, count(*) FILTER (d > 0) AS n_modified FROM p""",
)
def modified_pairs(spark, sf_dir):
    clipped = F.transform("embedding", lambda x: F.when((F.col("sample_id") % 4 == 0) & (x > 0.1), F.lit(0.1)).otherwise(x))
    return P.count_modified(samples(spark, sf_dir).withColumn("after", clipped), "embedding", "after")


@query(
    "E20",
    f"WITH t AS (SELECT p_brand, round(avg(p_retailprice) / 2000, 6) AS auc FROM part GROUP BY 1) SELECT arg_max(p_brand, (auc, p_brand)) AS best_type, {R('max(auc)')} AS best, arg_min(p_brand, (auc, p_brand)) AS worst_type, {R('min(auc)')} AS worst, count(*) FILTER (auc < 0.7) AS n_failing FROM t",
)
def best_and_worst_type(spark, sf_dir):
    per = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(F.avg("p_retailprice") / 2000, 6).alias("auc"))
    return P.extremes(per, "p_brand", "auc", 0.7).select("best_type", r("best").alias("best"), "worst_type", r("worst").alias("worst"), "n_failing")


@query(
    "E21",
    f"SELECT event_type, count(*) AS runs, {R('avg(value / 4)')} AS mean_ms, {R('min(value / 4)')} AS best_ms, {R('max(value / 4)')} AS worst_ms, {R('stddev_pop(value / 4)')} AS std_ms, {R('1000 / avg(value / 4)')} AS fps FROM events GROUP BY 1",
)
def latency_by_kind(spark, sf_dir):
    out = P.latency_report(events(spark, sf_dir), "value", ["event_type"], per_batch=4)
    return out.select("event_type", "runs", *[r(c).alias(c) for c in ("mean_ms", "best_ms", "worst_ms", "std_ms", "fps")])


@query("E22", f"WITH {SAMPLES_CTE} SELECT split, count(DISTINCT label) AS n_types FROM samples GROUP BY split")
def distinct_types_per_split(spark, sf_dir):
    return samples(spark, sf_dir).groupBy("split").agg(F.count_distinct("label").alias("n_types"))


# ---- studies ------------------------------------------------------------------------------------


FAMILY_DIST = distance_sql("split = 'train' AND label % 3 <> fam", "fam", "(SELECT unnest(range(0, 3)) AS fam)")


@query(
    "G15 C7",
    f"""WITH RECURSIVE {FAMILY_DIST} SELECT CAST(s.fam AS INTEGER) AS family, s.label, {R('avg(CASE WHEN s.dist < n.dist THEN 1.0 WHEN s.dist = n.dist THEN 0.5 ELSE 0 END)')} AS auc,
 count(DISTINCT s.sample_id) AS n_pos, count(DISTINCT n.sample_id) AS n_neg
FROM dist s JOIN dist n ON s.fam = n.fam AND n.split = 'negatives' AND s.split = 'train' AND s.label % 3 = s.fam GROUP BY s.fam, s.label""",
)
def leave_family_out_auc(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("family", (F.col("label") % 3).cast("int"))
    out = U.leave_family_out(rows.where("split = 'train'"), rows.where("split = 'negatives'"), "family", [0, 1, 2], "label")
    return out.select("family", "label", r("auc").alias("auc"), "n_pos", "n_neg")


@query(
    "G16",
    f"""WITH RECURSIVE {TRAIN_DIST}, t AS (SELECT quantile_cont(dist, 0.99) AS thr FROM dist WHERE split = 'train')
SELECT sample_id, label, {R('dist')} AS dist FROM dist CROSS JOIN t WHERE split = 'negatives' AND dist <= thr""",
)
def mislabelled_negatives(spark, sf_dir):
    rows = samples(spark, sf_dir)
    suspects, _ = U.mislabel_scan(train_of(rows), rows.where("split = 'negatives'"))
    return suspects.select("sample_id", "label", r("dist").alias("dist"))


RANKS = [0.05, 0.25, 0.5, 0.75, 0.95]


@query(
    "E5 E22",
    f"""SELECT event_type, rank, count(value) AS n, TRUE AS rank_within, TRUE AS keys_within
FROM events CROSS JOIN (SELECT unnest({RANKS}::DOUBLE[]) AS rank) GROUP BY event_type, rank""",
)
def merged_daily_sketches(spark, sf_dir):
    """Quantiles and distinct sensors per type from sketches stored per day: whether each lies within its bound of the exact figure (1 % of ranks, 4 % of keys)."""
    ev = events(spark, sf_dir)
    daily = materialize(K.sketch_slices(ev.withColumn("day", F.to_date("ts")), ["event_type", "day"], "value", "user_id"), "sketches")
    got = K.read_sketches(K.merge_slices(daily, ["event_type"]), ["event_type"], RANKS)
    exact = ev.groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("c")).join(got.select("event_type", "rank", "quantile"), "event_type")
    at = exact.groupBy("event_type", "rank").agg(
        (F.sum(F.when(F.col("value") < F.col("quantile"), F.col("c")).otherwise(0)) / F.sum(F.when(F.col("value").isNotNull(), F.col("c")))).alias("below"),
        (F.sum(F.when(F.col("value") <= F.col("quantile"), F.col("c")).otherwise(0)) / F.sum(F.when(F.col("value").isNotNull(), F.col("c")))).alias("upto"),
    )
    keys = ev.groupBy("event_type").agg(F.countDistinct("user_id").alias("true_keys"))
    return got.join(at, ["event_type", "rank"]).join(keys, "event_type").select(
        "event_type", "rank", "n", ((F.col("below") <= F.col("rank") + 0.01) & (F.col("upto") >= F.col("rank") - 0.01)).alias("rank_within"),
        (F.abs(F.col("n_keys") - F.col("true_keys")) <= 0.04 * F.col("true_keys")).alias("keys_within"),
    )
