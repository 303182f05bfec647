"""Ranking metrics over line items (volume, tied scores) and over cosine detection scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectraloom.functions import labels as L
from spectraloom.operators import ranking as K
from spectraloom.operators import reports as P
from spectraloom.operators.prefix import exact_percentiles
from spectraloom.plans.base import R, query, r, samples, table
from spectraloom.plans.detection import SCORES_CTE, cosine_scores


def priced(spark, sf_dir):
    """Line items as scored rows: truth = returned, score = quantity (many ties) or price (few)."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("qty"),
        F.col("l_linenumber").cast("long").alias("line"),
        F.col("l_linestatus").alias("status"),
        (F.col("l_suppkey") % 7).alias("family"),
    )


PRICED = """priced AS (SELECT CAST(l_returnflag = 'R' AS INT) AS y, l_extendedprice AS price, l_quantity AS qty,
  CAST(l_linenumber AS BIGINT) AS line, l_linestatus AS status, l_suppkey % 7 AS family FROM lineitem)"""


def counts_sql(source: str, s: str, by: str = "") -> str:
    """Cumulative counts from the highest score down, with totals (check SQL)."""
    key = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""g AS (SELECT {key}{s} AS s, sum(y) AS p, sum(1 - y) AS n FROM {source} GROUP BY {key}{s}),
cur AS (SELECT *, sum(p) OVER ({part}ORDER BY s DESC) AS tp, sum(n) OVER ({part}ORDER BY s DESC) AS fp,
  sum(p) OVER ({part.strip()}) AS np, sum(n) OVER ({part.strip()}) AS nn FROM g),
roc AS (SELECT *, CAST(tp AS DOUBLE) / np AS tpr, CAST(fp AS DOUBLE) / nn AS fpr FROM cur)"""


AUC_SQL = "sum(CAST(p AS DOUBLE) * (nn - fp + n / 2.0)) / (any_value(np) * CAST(any_value(nn) AS DOUBLE))"


@query("G1", f"WITH {PRICED}, {counts_sql('priced', 'price')} SELECT {R(AUC_SQL)} AS auc, CAST(any_value(np) AS BIGINT) AS n_pos, CAST(any_value(nn) AS BIGINT) AS n_neg FROM roc")
def roc_auc_overall(spark, sf_dir):
    return K.auc(priced(spark, sf_dir), "y", "price").select(r("auc").alias("auc"), "n_pos", "n_neg")


@query("G1", f"WITH {PRICED}, {counts_sql('priced', 'qty', 'line')} SELECT line, {R(AUC_SQL)} AS auc, CAST(any_value(np) AS BIGINT) AS n_pos, CAST(any_value(nn) AS BIGINT) AS n_neg FROM roc GROUP BY line")
def roc_auc_by_group(spark, sf_dir):
    return K.auc(priced(spark, sf_dir), "y", "qty", by=["line"]).select("line", r("auc").alias("auc"), "n_pos", "n_neg")


@query(
    "G2",
    f"""WITH {PRICED}, neg AS (SELECT qty AS s, count(*) AS n FROM priced WHERE y = 0 GROUP BY qty),
pos AS (SELECT family, qty AS s, count(*) AS p FROM priced WHERE y = 1 GROUP BY ALL)
SELECT family, {R('sum(CASE WHEN pos.s > neg.s THEN p * n WHEN pos.s = neg.s THEN p * n / 2.0 ELSE 0 END) / CAST(sum(p * n) AS DOUBLE)')} AS auc
FROM pos CROSS JOIN neg GROUP BY family""",
)
def roc_auc_by_type_shared_negatives(spark, sf_dir):
    rows = priced(spark, sf_dir)
    out = K.auc_by_type(rows.where("y = 1"), rows.where("y = 0"), "qty", "family")
    return out.select("family", r("auc").alias("auc"))


@query("G3", f"WITH {PRICED}, {counts_sql('priced', 'qty')} SELECT s AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, {R('tpr')} AS tpr, {R('fpr')} AS fpr FROM roc")
def roc_curve_points(spark, sf_dir):
    return K.roc_curve(priced(spark, sf_dir), "y", "qty").select(
        "threshold", "tp", "fp", r("tpr").alias("tpr"), r("fpr").alias("fpr")
    )


@query(
    "G3",
    f"""WITH {SCORES_CTE}, sc AS (SELECT y, -dist AS sdist FROM scores), {counts_sql('sc', 'sdist')},
c AS (SELECT *, lead(p) OVER (ORDER BY s DESC) AS p2, lead(n) OVER (ORDER BY s DESC) AS n2 FROM roc)
SELECT {R('s')} AS threshold, {R('tpr')} AS tpr, {R('fpr')} AS fpr FROM c WHERE p2 IS NULL OR p2 <> p OR n2 <> n""",
)
def roc_curve_corners(spark, sf_dir):
    rows = cosine_scores(spark, sf_dir).select("y", (-F.col("dist")).alias("s"))
    return K.roc_curve(rows, "y", "s", drop_collinear=True).select(
        r("threshold").alias("threshold"), r("tpr").alias("tpr"), r("fpr").alias("fpr")
    )


@query("G4", f"WITH {PRICED}, {counts_sql('priced', 'price')} SELECT {R('sum(p * (CAST(tp AS DOUBLE) / (tp + fp))) / sum(p)')} AS average_precision FROM roc")
def average_precision_overall(spark, sf_dir):
    return K.average_precision(priced(spark, sf_dir), "y", "price").select(
        r("average_precision").alias("average_precision")
    )


TARGETS = [0.005, 0.01, 0.05, 0.10]
TARGET_VALUES = ", ".join(f"({t})" for t in TARGETS)


@query(
    "G5a",
    f"""WITH {PRICED}, {counts_sql('priced', 'price', 'status')}, t(target) AS (VALUES {TARGET_VALUES}),
k AS (SELECT DISTINCT status FROM g)
SELECT k.status, CAST(target AS DOUBLE) AS target, {R('coalesce(max(tpr), 0)')} AS tpr, {R('min(s)')} AS threshold
FROM k CROSS JOIN t LEFT JOIN roc ON roc.status = k.status AND fpr <= target GROUP BY k.status, target""",
)
def tpr_at_fpr_last_below(spark, sf_dir):
    out = K.tpr_at_fpr(priced(spark, sf_dir), "y", "price", TARGETS, by=["status"])
    return out.select("status", "target", r("tpr").alias("tpr"), r("threshold").alias("threshold"))


@query(
    "G5b",
    f"""WITH {PRICED}, {counts_sql('priced', 'price', 'status')}, t(target) AS (VALUES {TARGET_VALUES})
SELECT status, CAST(target AS DOUBLE) AS target, {R('min(tpr)')} AS tpr, {R('max(s)')} AS threshold
FROM roc JOIN t ON fpr >= target GROUP BY status, target""",
)
def tpr_at_fpr_first_above(spark, sf_dir):
    out = K.tpr_at_fpr(priced(spark, sf_dir), "y", "price", TARGETS, by=["status"], mode="ge")
    return out.select("status", "target", r("tpr").alias("tpr"), r("threshold").alias("threshold"))


@query(
    "G6",
    f"""WITH {PRICED}, {counts_sql('priced', 'price', 'line')}, k AS (SELECT DISTINCT line FROM g)
SELECT k.line, {R('coalesce(min(fpr), 1.0)')} AS fpr, {R('max(s)')} AS threshold
FROM k LEFT JOIN roc ON roc.line = k.line AND tpr >= 0.95 GROUP BY k.line""",
)
def fpr_at_tpr_first_point(spark, sf_dir):
    return K.fpr_at_tpr(priced(spark, sf_dir), "y", "price", 0.95, by=["line"]).select(
        "line", r("fpr").alias("fpr"), r("threshold").alias("threshold")
    )


@query(
    "G7",
    f"""WITH {PRICED}, o AS (SELECT price, row_number() OVER (ORDER BY price) - 1 AS i, count(*) OVER () AS n
  FROM priced WHERE y = 1), t AS (SELECT price AS thr FROM o WHERE i = floor(0.05 * n))
SELECT {R('avg(CASE WHEN price >= thr THEN 1.0 ELSE 0.0 END)')} AS fpr, count(*) AS n_neg, {R('any_value(thr)')} AS threshold
FROM priced CROSS JOIN t WHERE y = 0""",
)
def fpr_at_order_statistic(spark, sf_dir):
    return K.fpr_at_order_stat(priced(spark, sf_dir), "y", "price", 0.05).select(
        r("fpr").alias("fpr"), "n_neg", r("threshold").alias("threshold")
    )


@query(
    "G8",
    f"""WITH {PRICED}, {counts_sql('priced', 'price', 'line')},
j AS (SELECT line, s, tpr, fpr, round(tpr - fpr, 12) AS j FROM roc),
b AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY j DESC, s DESC) AS rn FROM j)
SELECT line, {R('j')} AS j, {R('s')} AS threshold, {R('tpr')} AS tpr, {R('fpr')} AS fpr FROM b WHERE rn = 1""",
)
def youden_threshold(spark, sf_dir):
    out = K.youden(priced(spark, sf_dir), "y", "price", by=["line"])
    return out.select("line", r("j").alias("j"), r("threshold").alias("threshold"), r("tpr").alias("tpr"), r("fpr").alias("fpr"))


@query(
    "G9",
    f"""WITH {SCORES_CTE}, sc AS (SELECT CAST(split = 'train' AS INT) AS y, -dist AS sdist FROM scores
  WHERE split <> 'holdout'), {counts_sql('sc', 'sdist')},
j AS (SELECT s, round(tpr - fpr, 12) AS j FROM roc)
SELECT 'youden' AS source, {R('-arg_max(s, (j, s))')} AS threshold FROM j
UNION ALL SELECT 'percentile', {R('quantile_cont(dist, 0.99)')} FROM scores WHERE split = 'train'""",
)
def calibrated_thresholds(spark, sf_dir):
    rows = cosine_scores(spark, sf_dir)
    train = rows.where("split = 'train'")
    with_bg = K.calibrate(train, rows.where("split = 'negatives'"))
    without = K.calibrate(train)
    return with_bg.unionByName(without).select("source", r("threshold").alias("threshold"))


@query("G10")
def bootstrap_auc_interval(spark, sf_dir):
    """Bootstrap interval of the AUC over all line items; checked by invariants in the tests."""
    reps = K.bootstrap_auc(priced(spark, sf_dir), "y", "qty", replicates=200, seed=7)
    return K.bootstrap_interval(reps)


@query("G10")
def bootstrap_auc_by_type_interval(spark, sf_dir):
    reps = K.bootstrap_auc_by_type(
        cosine_scores(spark, sf_dir).where("split <> 'train'").withColumn("s", -F.col("dist")),
        "y", "s", "label", replicates=100, seed=7,
    )
    return K.bootstrap_interval(reps, by=["label"])


@query("G10")
def bootstrap_closer_rate_interval(spark, sf_dir):
    reps = K.bootstrap_closer_rate(
        cosine_scores(spark, sf_dir).where("split <> 'train'"), "y", "dist", replicates=200, seed=7
    )
    return K.bootstrap_interval(reps, "rate")


def poisson_sql(source: str, key: str, s: str, replicates: int, seed: int, kind: str = "NULL") -> str:
    """Weighted counts per replicate, score and type (check SQL)."""
    weight = " + ".join(f"CAST(u >= {c} AS INT)" for c in K.poisson_cuts())
    return f"""hashed AS (SELECT y, {s} AS s, {kind} AS kind, b, md5({key} || ':' || b || ':{seed}') AS h FROM {source}, (SELECT unnest(range(0, {-(-replicates // 4)})) AS b)),
lanes AS (SELECT y, s, kind, b * 4 + l AS replicate, CAST(CAST('0x' || substr(h, 1 + 8 * CAST(l AS INT), 8) AS UBIGINT) AS BIGINT) AS u FROM hashed, (SELECT unnest(range(0, 4)) AS l)),
drawn AS (SELECT *, {weight} AS w FROM lanes WHERE replicate < {replicates}),
neg AS (SELECT replicate, s, CAST(sum(w) AS DOUBLE) AS n FROM drawn WHERE y = 0 GROUP BY ALL),
pos AS (SELECT replicate, kind, s, CAST(sum(w) AS DOUBLE) AS p FROM drawn WHERE y = 1 GROUP BY ALL),
spots AS (SELECT replicate, s, coalesce(n, 0) AS n FROM (SELECT replicate, s FROM pos UNION SELECT replicate, s FROM neg) LEFT JOIN neg USING (replicate, s)),
below AS (SELECT *, sum(n) OVER (PARTITION BY replicate ORDER BY s) - n / 2 AS b, sum(n) OVER (PARTITION BY replicate) AS nn FROM spots),
reps AS (SELECT replicate, kind, sum(p * b) / nullif(sum(p) * any_value(nn), 0) AS auc FROM pos JOIN below USING (replicate, s) GROUP BY ALL)"""


INTERVAL_SQL = f"{R('avg(auc)')} AS mean, {R('stddev_pop(auc)')} AS std, {R('quantile_cont(auc, 0.025)')} AS ci_low, {R('quantile_cont(auc, 0.975)')} AS ci_high, count(*) AS replicates"


def _interval(reps, by=None):
    out = K.bootstrap_interval(reps, by=by)
    return out.select(*(by or []), *[r(c).alias(c) for c in ("mean", "std", "ci_low", "ci_high")], "replicates")


@query(
    "G10",
    f"""WITH rows AS (SELECT CAST(l_returnflag = 'R' AS INT) AS y, CAST(l_quantity AS DOUBLE) AS qty, l_orderkey || '-' || l_linenumber AS id FROM lineitem),
{poisson_sql('rows', 'id', 'qty', 40, 11)} SELECT {INTERVAL_SQL} FROM reps""",
)
def bootstrap_auc_by_hashed_draws(spark, sf_dir):
    """Interval of the AUC over all line items from forty resamples whose draws hash the row's own key."""
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_quantity").alias("qty"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id")
    )
    return _interval(K.poisson_auc(rows, "y", "qty", "id", 40, 11))


@query("G10", f"WITH {SCORES_CTE}, {poisson_sql('scores', 'sample_id', 'dist', 100, 7, 'label')} SELECT kind AS label, {INTERVAL_SQL} FROM reps GROUP BY kind")
def bootstrap_auc_by_type_hashed_draws(spark, sf_dir):
    """Interval of each type's AUC against the negatives of the same resample, over all scored samples."""
    rows = cosine_scores(spark, sf_dir)
    return _interval(K.poisson_auc(rows, "y", "dist", "sample_id", 100, 7, "label"), ["label"])


@query(
    "G11",
    f"""WITH {PRICED}, lv AS (SELECT *, line AS ordinal, CAST(25 - 5 * line AS BIGINT) AS snr_db FROM priced),
{counts_sql('lv', 'qty', 'ordinal')}, a AS (SELECT ordinal, {AUC_SQL} AS auc FROM roc GROUP BY ordinal),
lim(lim) AS (VALUES (0.495), (0.5), (0.4))
SELECT CAST(lim AS DOUBLE) AS "limit", CAST(25 - 5 * coalesce(min(CASE WHEN auc < lim THEN ordinal END), max(ordinal)) AS BIGINT) AS floor_db
FROM a CROSS JOIN lim GROUP BY lim""",
)
def snr_floor_levels(spark, sf_dir):
    rows = priced(spark, sf_dir).withColumn("snr_db", (F.lit(25) - 5 * F.col("line")).cast("long"))
    curve = K.snr_curve(rows, "y", "qty", "snr_db").withColumn("ordinal", ((25 - F.col("snr_db")) / 5).cast("long"))
    return K.snr_floor(curve, [0.495, 0.5, 0.4])


@query(
    "G17",
    f"SELECT l_quantity AS qty, {R('cume')} AS cdf FROM (SELECT l_quantity, cume_dist() OVER (ORDER BY l_quantity) AS cume FROM lineitem) GROUP BY ALL",
)
def empirical_cdf(spark, sf_dir):
    return K.ecdf(priced(spark, sf_dir), "qty").select("qty", r("cdf").alias("cdf"))


@query(
    "G18",
    f"""WITH {SCORES_CTE}, k AS (SELECT split, sample_id, dist,
  row_number() OVER (PARTITION BY split ORDER BY dist, sample_id) AS rank FROM scores)
SELECT split, rank, sample_id, dist FROM k WHERE rank <= 5""",
)
def top_k_per_split(spark, sf_dir):
    return P.top_k(cosine_scores(spark, sf_dir), "dist", 5, by=["split"], tie="sample_id").select(
        "split", F.col("rank").cast("long").alias("rank"), "sample_id", "dist"
    )


@query(
    "F16",
    f"""WITH {SCORES_CTE}, t AS (SELECT dist AS td FROM scores WHERE split = 'train')
SELECT sample_id, {R("100.0 * sum(CASE WHEN td > dist THEN 1 ELSE 0 END) / count(*)")} AS pct_greater
FROM scores CROSS JOIN t WHERE split <> 'train' GROUP BY sample_id""",
)
def percentile_rank_against_train(spark, sf_dir):
    rows = cosine_scores(spark, sf_dir)
    out = K.pct_rank(rows.where("split <> 'train'"), rows.where("split = 'train'"))
    return out.select("sample_id", r("pct_greater").alias("pct_greater"))


@query(
    "G12 C13",
    f"""WITH {SCORES_CTE}, sc AS (SELECT CAST(label = 8 AS INT) AS y, -dist AS sdist FROM scores WHERE split = 'negatives'),
{counts_sql('sc', 'sdist')}, a AS (SELECT {AUC_SQL} AS auc FROM roc)
SELECT {R('auc')} AS auc, {R('greatest(auc, 1 - auc)')} AS separability,
  CASE WHEN greatest(auc, 1 - auc) > 0.7 THEN 'inflated' WHEN greatest(auc, 1 - auc) < 0.6 THEN 'clean' ELSE 'inconclusive' END AS verdict
FROM a""",
)
def artifact_check_auc(spark, sf_dir):
    rows = cosine_scores(spark, sf_dir).withColumn("s", -F.col("dist"))
    out = P.artifact_check(rows.where("label = 8"), rows.where("label = 9"), "s")
    return out.select(r("auc").alias("auc"), r("separability").alias("separability"), "verdict")


@query(
    "G12 C13 H1",
    f"""WITH {SCORES_CTE}, sc AS (SELECT CAST(label = 8 AS INT) AS y, -dist AS sdist FROM scores WHERE split = 'negatives'),
{counts_sql('sc', 'sdist')}, a AS (SELECT greatest({AUC_SQL}, 1 - {AUC_SQL}) AS sep FROM roc),
px AS (SELECT vec_id, label, unnest(range(0, 64)) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings WHERE label IN (8, 9)),
mu AS (SELECT label AS side, d, avg(x) AS m FROM px GROUP BY ALL), ds AS (SELECT vec_id, label, side, sum((x - m) * (x - m)) AS q FROM px JOIN mu USING (d) GROUP BY ALL),
pr AS (SELECT avg(CAST((max8 < max9) = (label = 8) AS INT)) AS probe FROM (SELECT vec_id, label, max(q) FILTER (side = 8) AS max8, max(q) FILTER (side = 9) AS max9 FROM ds GROUP BY ALL))
SELECT {R('sep')} AS separability, {R('probe')} AS probe,
  CASE WHEN sep > 0.7 OR probe > 0.8 THEN 'inflated' WHEN sep < 0.6 AND probe < 0.65 THEN 'clean' ELSE 'inconclusive' END AS verdict FROM a, pr""",
)
def artifact_check_with_probe(spark, sf_dir):
    """The same question asked of the score and of a linear probe on the vectors."""
    rows = cosine_scores(spark, sf_dir).withColumn("s", -F.col("dist"))
    vectors = samples(spark, sf_dir)
    probe = P.centroid_probe(vectors.where("label = 8"), vectors.where("label = 9"), "embedding")
    out = P.artifact_check(rows.where("label = 8"), rows.where("label = 9"), "s", probe)
    return out.select(r("separability").alias("separability"), r("probe").alias("probe"), "verdict")


@query(
    "C13",
    f"""WITH {SCORES_CTE}, t AS (SELECT quantile_cont(dist, 0.95) AS thr FROM scores WHERE split = 'train'),
g AS (SELECT n.label, avg(CASE WHEN p.dist < n.dist THEN 1.0 WHEN p.dist = n.dist THEN 0.5 ELSE 0 END) AS auc FROM scores n, scores p WHERE n.split <> 'train' AND p.split = 'train' GROUP BY n.label),
f AS (SELECT label, avg(CASE WHEN dist <= thr THEN 1.0 ELSE 0 END) AS fp FROM scores, t WHERE split <> 'train' GROUP BY label)
SELECT label, {R('auc')} AS auc, {R('fp')} AS false_positive, CASE WHEN auc > 0.95 AND fp < 0.1 THEN 'PASS' WHEN auc > 0.85 THEN 'PARTIAL' ELSE 'FAIL' END AS grade FROM g JOIN f USING (label)""",
)
def hard_negative_grades(spark, sf_dir):
    """Every type outside the fit as a hard negative: AUC of the train scores against it, and its false positives."""
    rows = cosine_scores(spark, sf_dir)
    train, rest = rows.where("split = 'train'"), rows.where("split <> 'train'")
    limit = exact_percentiles(train, "dist", [0.95]).select(F.element_at("pct", 1).alias("t"))
    # one shared positive set against every type's negatives: the types take the positive side of the mirrored score
    auc = K.auc_by_type(rest.select("label", F.col("dist").alias("s")), train.select(F.col("dist").alias("s")), "s", "label")
    fp = rest.groupBy("label").agg(F.avg((F.col("dist") <= limit.scalar()).cast("double")).alias("fp"))
    out = auc.join(fp, "label").withColumn("grade", L.hard_negative_grade("auc", "fp"))
    return out.select("label", r("auc").alias("auc"), r("fp").alias("false_positive"), "grade")


@query(
    "G13 C13",
    f"""WITH {SCORES_CTE}, sc AS (SELECT 'original_vs_modified' AS test, CAST(label = 8 AS INT) AS y, -dist AS s FROM scores WHERE label IN (8, 9)
 UNION ALL SELECT 'modified_vs_matched', CAST(label = 9 AS INT), -dist FROM scores WHERE label IN (7, 9)),
x AS (SELECT test, y, s FROM sc),
a AS (SELECT p.test, avg(CASE WHEN p.s > n.s THEN 1.0 WHEN p.s = n.s THEN 0.5 ELSE 0 END) AS auc
  FROM x p JOIN x n ON p.test = n.test AND p.y = 1 AND n.y = 0 GROUP BY p.test)
SELECT test, {R('auc')} AS auc, CASE WHEN auc < 0.55 THEN 'CLEAN' WHEN auc < 0.65 THEN 'MOSTLY_CLEAN'
  WHEN auc < 0.80 THEN 'PARTIALLY_CONTAMINATED' ELSE 'HEAVILY_CONTAMINATED' END AS verdict FROM a""",
)
def surgery_check(spark, sf_dir):
    rows = cosine_scores(spark, sf_dir).withColumn("s", -F.col("dist"))
    out = P.surgery_check(rows.where("label = 8"), rows.where("label = 9"), rows.where("label = 7"), "s")
    return out.select("test", r("auc").alias("auc"), "verdict")


@query(
    "G14 C13",
    f"""WITH {SCORES_CTE}, t AS (SELECT quantile_cont(dist, 0.99) AS thr FROM scores WHERE split = 'train'),
a AS (SELECT p.label, avg(CASE WHEN p.dist < n.dist THEN 1.0 WHEN p.dist = n.dist THEN 0.5 ELSE 0 END) AS auc
  FROM scores p JOIN scores n ON p.split = 'holdout' AND n.split = 'negatives' GROUP BY p.label)
SELECT s.label, {R('avg(dist)')} AS mean_dist, {R('avg(CASE WHEN dist <= thr THEN 1.0 ELSE 0.0 END)')} AS detection_rate,
  {R('any_value(a.auc)')} AS auc,
  CASE WHEN any_value(a.auc) > 0.9 THEN 'PASS' WHEN any_value(a.auc) > 0.7 THEN 'PARTIAL' ELSE 'FAIL' END AS status
FROM scores s CROSS JOIN t JOIN a ON a.label = s.label WHERE split = 'holdout' GROUP BY s.label""",
)
def transfer_report(spark, sf_dir):
    rows = cosine_scores(spark, sf_dir)
    threshold = exact_percentiles(rows.where("split = 'train'"), "dist", [0.99]).select(F.element_at("pct", 1))
    out = P.transfer_report(rows.where("split = 'holdout'"), rows.where("split = 'negatives'"), threshold, "label")
    return out.select("label", r("mean_dist").alias("mean_dist"), r("detection_rate").alias("detection_rate"), r("auc").alias("auc"), "status")
