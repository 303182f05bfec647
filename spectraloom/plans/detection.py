"""Gaussian and cosine detection: fit, score, threshold, verdict, report."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectraloom.functions.rows import attach_row
from spectraloom.functions import vectors as V
from spectraloom.operators import gaussian as G
from spectraloom.operators import moments as M
from spectraloom.operators import ranking as K
from spectraloom.operators.prefix import exact_percentiles
from spectraloom.session import materialize
from spectraloom.plans.base import LONG_CTE, SAMPLES_CTE, R, query, r, samples


def train_of(df):
    return df.where("split = 'train'")


def cosine_scores(spark, sf_dir):
    """Every sample with its cosine distance to the mean train vector, to six places.

    The narrow scores are written once, so reports over them do not read the vectors again.
    """
    all_rows = samples(spark, sf_dir)
    center = M.centroid(train_of(all_rows)).select("centroid")
    joined = attach_row(all_rows, center)
    scored = joined.select(
        "sample_id", "label", "split", "recording_id",
        r(F.lit(1.0) - V.cosine("embedding", "centroid")).alias("dist"),
        (F.col("split") != "negatives").cast("int").alias("y"),
    )
    return materialize(scored, "cosine-scores")


SCORES_CTE = LONG_CTE + f""",
center AS (SELECT d, avg(x) AS c FROM long WHERE split = 'train' GROUP BY d),
scores AS (SELECT sample_id, any_value(label) AS label, any_value(split) AS split,
                  any_value(recording_id) AS recording_id,
                  {R('1 - sum(x * c) / (sqrt(sum(x * x)) * sqrt(sum(c * c)))')} AS dist,
                  CAST(any_value(split) <> 'negatives' AS INT) AS y
           FROM long JOIN center USING (d) GROUP BY sample_id)"""


def inverse_sql(key: str = "") -> str:
    """Regularised covariance ``cv(key, i, j, v)`` to its inverse ``si`` by sweeping all 64 pivots (check SQL)."""
    k = f"{key}, " if key else ""
    return f"""gj(p, {k}i, j, v) AS (SELECT 0, {k}i, j, v FROM cv UNION ALL
  SELECT p + 1, {k}i, j, CASE WHEN i = p + 1 AND j = p + 1 THEN 1 / pv WHEN i = p + 1 THEN v / pv WHEN j = p + 1 THEN -v / pv ELSE v - cl * rw / pv END
  FROM (SELECT *, max(CASE WHEN i = p + 1 AND j = p + 1 THEN v END) OVER ({f'PARTITION BY {key}' if key else ''}) AS pv,
    max(CASE WHEN i = p + 1 THEN v END) OVER (PARTITION BY {k}j) AS rw, max(CASE WHEN j = p + 1 THEN v END) OVER (PARTITION BY {k}i) AS cl
    FROM gj WHERE p < 64)),
si AS (SELECT {k}i, j, v FROM gj WHERE p = 64)"""


def distance_sql(fit: str, key: str = "", keys: str = "", l2: bool = True) -> str:
    """CTEs ending in ``dist(sample_id, label, split, [key,] dist)`` for whole vectors (check SQL).

    ``fit`` selects the rows of each fit from ``nl``; ``keys`` is a table of model keys it may use.
    """
    k, scale = (f"{key}, " if key else ""), "x / (sqrt(sum(x * x) OVER (PARTITION BY sample_id)) + 1e-8)" if l2 else "x"
    source = f"nl CROSS JOIN {keys}" if keys else "nl"
    return f"""{LONG_CTE},
nl AS (SELECT sample_id, label, split, d, {scale} AS x FROM long),
ft AS (SELECT {k}sample_id, d, x FROM {source} WHERE {fit}),
mu AS (SELECT {k}d, avg(x) AS m FROM ft GROUP BY ALL),
cv AS (SELECT {'a.' + key + ', ' if key else ''}a.d AS i, b.d AS j, covar_samp(a.x, b.x) + CASE WHEN a.d = b.d THEN 0.001 ELSE 0 END AS v
  FROM ft a JOIN ft b ON a.sample_id = b.sample_id {f'AND a.{key} = b.{key}' if key else ''} GROUP BY {'a.' + key + ', ' if key else ''}a.d, b.d),
{inverse_sql(key)},
z AS (SELECT {k}sample_id, label, split, d, x - m AS z FROM nl JOIN mu USING (d)),
y AS (SELECT {'z.' + key + ', ' if key else ''}sample_id, j, sum(z * v) AS y FROM z JOIN si ON si.i = z.d {f'AND si.{key} = z.{key}' if key else ''} GROUP BY ALL),
dist AS (SELECT {'z.' + key + ', ' if key else ''}z.sample_id, any_value(label) AS label, any_value(split) AS split, sqrt(greatest(0, sum(y * z))) AS dist
  FROM z JOIN y ON y.sample_id = z.sample_id AND y.j = z.d {f'AND y.{key} = z.{key}' if key else ''} GROUP BY {'z.' + key + ', ' if key else ''}z.sample_id)"""


TRAIN_DIST = distance_sql("split = 'train'")


@query(
    "F2 E3 E5 C9 G2 E8",
    f"""WITH RECURSIVE {TRAIN_DIST}, t AS (SELECT quantile_cont(dist, 0.99) AS thr FROM dist WHERE split = 'train'),
au AS (SELECT s.label, avg(CASE WHEN s.dist < n.dist THEN 1.0 WHEN s.dist = n.dist THEN 0.5 ELSE 0 END) AS auc
  FROM dist s JOIN dist n ON n.split = 'negatives' AND s.split <> 'negatives' GROUP BY s.label)
SELECT s.label, s.split, count(*) AS n, {R('avg(CASE WHEN dist <= thr THEN 1.0 ELSE 0.0 END)')} AS detection_rate, {R('avg(dist)')} AS mean_dist, {R('any_value(au.auc)')} AS auc
FROM dist s CROSS JOIN t LEFT JOIN au ON au.label = s.label GROUP BY s.label, s.split""",
)
def detect_report(spark, sf_dir):
    """Fit on train types, threshold at the train p99, report each type against the negatives."""
    all_rows = samples(spark, sf_dir)
    models = G.fit_gaussian(train_of(all_rows))
    scored = materialize(G.mahalanobis(all_rows, models).drop("embedding"), "scores")
    threshold = exact_percentiles(train_of(scored), "dist", [0.99]).select(F.element_at("pct", 1))
    scored = scored.withColumn("detected", F.col("dist") <= threshold.scalar())
    rates = scored.groupBy("label", "split").agg(
        F.count(F.lit(1)).alias("n"),
        r(F.avg(F.col("detected").cast("double"))).alias("detection_rate"),
        r(F.avg("dist")).alias("mean_dist"),
    )
    ranked = scored.select("label", "split", (-F.col("dist")).alias("s"))
    aucs = K.auc_by_type(ranked.where("split <> 'negatives'"), ranked.where("split = 'negatives'"), "s", "label")
    return rates.join(aucs.select("label", r("auc").alias("auc")), "label", "left")


@query(
    "F4 G2 E8 A12",
    f"""WITH {SCORES_CTE},
t AS (SELECT quantile_cont(dist, 0.99) AS thr FROM scores WHERE split = 'train'),
neg AS (SELECT dist FROM scores WHERE split = 'negatives'),
au AS (SELECT label, sum(CASE WHEN s.dist < n.dist THEN 1.0 WHEN s.dist = n.dist THEN 0.5 ELSE 0 END)
         / count(*) AS auc FROM scores s, neg n WHERE s.split <> 'negatives' GROUP BY label)
SELECT s.label, s.split, count(*) AS n, {R('avg(CASE WHEN dist <= thr THEN 1.0 ELSE 0.0 END)')} AS detection_rate,
       {R('avg(dist)')} AS mean_dist, {R('any_value(au.auc)')} AS auc
FROM scores s CROSS JOIN t LEFT JOIN au ON s.label = au.label GROUP BY s.label, s.split""",
)
def detect_report_cosine(spark, sf_dir):
    scored = cosine_scores(spark, sf_dir)
    threshold = exact_percentiles(train_of(scored), "dist", [0.99]).select(F.element_at("pct", 1))
    scored = scored.withColumn("detected", F.col("dist") <= threshold.scalar())
    rates = scored.groupBy("label", "split").agg(
        F.count(F.lit(1)).alias("n"),
        r(F.avg(F.col("detected").cast("double"))).alias("detection_rate"),
        r(F.avg("dist")).alias("mean_dist"),
    )
    ranked = scored.select("label", "split", (-F.col("dist")).alias("s"))
    aucs = K.auc_by_type(ranked.where("split <> 'negatives'"), ranked.where("split = 'negatives'"), "s", "label")
    return rates.join(aucs.select("label", r("auc").alias("auc")), "label", "left")
