"""Labels, categories, verdicts, confidences, grades."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectraloom.functions import labels as L
from spectraloom.operators.prefix import exact_percentiles
from spectraloom.plans.base import SAMPLES_CTE, R, query, r, samples, table
from spectraloom.plans.detection import SCORES_CTE, cosine_scores
from spectraloom.plans.sampling import CATEGORY_SQL, NOUN_WORDS


@query("C1 C2", f"WITH {SAMPLES_CTE} SELECT CAST(split <> 'negatives' AS INT) AS is_drone, CASE WHEN label >= 6 THEN 'background' ELSE 'drone' END AS superclass, count(*) AS n FROM samples GROUP BY ALL")
def binary_and_superclass_labels(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("name", F.when(F.col("split") == "negatives", "NEGATIVE").otherwise("type"))
    return rows.groupBy(
        L.binary_label("name").alias("is_drone"), L.superclass("label", 6).alias("superclass")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("C3", f"SELECT {CATEGORY_SQL} AS category, count(*) AS n FROM part GROUP BY 1")
def categories_of_part_names(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(L.categorize("p_name", NOUN_WORDS).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "C3",
    """WITH n AS (SELECT p_partkey, p_name || ' ' || CASE p_partkey % 5 WHEN 0 THEN 'Wingcopter' WHEN 1 THEN 'tilt-Quad' WHEN 2 THEN 'DJI Mavic' WHEN 3 THEN 'VTOL disco' ELSE 'radio' END AS nm FROM part)
SELECT CASE WHEN regexp_matches(lower(nm), 'plane|wing|glider|disco|surveillance') THEN 'fixed_wing' WHEN regexp_matches(lower(nm), 'vtol|hybrid|convertible|tilt') THEN 'hybrid'
 WHEN regexp_matches(lower(nm), 'quad|hex|octo|copter|phantom|mavic|bebop|parrot|dji|yuneec|syma|hubsan|walkera|blade|arris|holy') THEN 'multirotor' ELSE 'unknown' END AS category, count(*) AS n FROM n GROUP BY 1""",
)
def categories_in_precedence_order(spark, sf_dir):
    tail = F.element_at(F.array(*[F.lit(x) for x in ("Wingcopter", "tilt-Quad", "DJI Mavic", "VTOL disco", "radio")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    names = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", tail).alias("nm"))
    return names.groupBy(L.categorize("nm").alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "C4",
    """WITH n AS (SELECT CASE c_custkey % 3 WHEN 0 THEN 'dji-' || c_mktsegment || '_u1' WHEN 1 THEN c_name ELSE lower(c_mktsegment) || ' pro_' || c_custkey END AS nm FROM customer),
h AS (SELECT split_part(nm, '_', 1) AS h FROM n)
SELECT CASE WHEN upper(split_part(h, '-', 1)) IN ('DJI','FUTABA','FLYSKY','FRSKY','SIYI','HOBBYWING','RADIOMASTER','SPEKTRUM','TBS') THEN upper(split_part(h, '-', 1)) ELSE upper(split_part(h, ' ', 1)) END AS manufacturer, count(*) AS n FROM h GROUP BY 1""",
)
def manufacturers_of_names(spark, sf_dir):
    k = F.col("c_custkey") % 3
    nm = F.when(k == 0, F.concat(F.lit("dji-"), "c_mktsegment", F.lit("_u1"))).when(k == 1, F.col("c_name")).otherwise(
        F.concat(F.lower("c_mktsegment"), F.lit(" pro_"), F.col("c_custkey").cast("string"))
    )
    return table(spark, sf_dir, "customer").groupBy(L.manufacturer(nm).alias("manufacturer")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "C5",
    """WITH n AS (SELECT CASE WHEN s_suppkey % 4 = 0 THEN s_name ELSE replace(s_name, '#', '_') || '_u' || s_suppkey % 3 END AS nm FROM supplier)
SELECT nm, CASE WHEN contains(nm, '_') THEN regexp_extract(nm, '^(.*)_([^_]*)$', 1) END AS model, CASE WHEN contains(nm, '_') THEN regexp_extract(nm, '^(.*)_([^_]*)$', 2) END AS unit FROM n""",
)
def model_and_unit_of_names(spark, sf_dir):
    nm = F.when(F.col("s_suppkey") % 4 == 0, F.col("s_name")).otherwise(
        F.concat(F.replace("s_name", F.lit("#"), F.lit("_")), F.lit("_u"), (F.col("s_suppkey") % 3).cast("string"))
    )
    model, unit = L.split_unit("nm")
    return table(spark, sf_dir, "supplier").select(nm.alias("nm")).select("nm", model.alias("model"), unit.alias("unit"))


@query("C6", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_name), 'blue')")
def filter_types_by_substring(spark, sf_dir):
    return L.filter_types(table(spark, sf_dir, "part"), "p_name", ["RING", "blue"]).select("p_partkey", "p_name")


@query("C7", f"WITH {SAMPLES_CTE} SELECT label IN (1, 3, 7) AS in_family, split, count(*) AS n FROM samples GROUP BY ALL")
def family_membership(spark, sf_dir):
    return L.family_split(samples(spark, sf_dir), "label", [1, 3, 7]).groupBy("in_family", "split").agg(F.count(F.lit(1)).alias("n"))


@query("C8", "SELECT p_name, CAST(dense_rank() OVER (ORDER BY p_name) - 1 AS BIGINT) AS label_index, count(*) AS n FROM part GROUP BY p_name")
def label_index_of_names(spark, sf_dir):
    out = L.label_index(table(spark, sf_dir, "part"), "p_name")
    return out.groupBy("p_name", F.col("label_index").cast("long").alias("label_index")).agg(F.count(F.lit(1)).alias("n"))


STATS_CTE = SCORES_CTE + """,
st AS (SELECT quantile_cont(dist, 0.5) AS p50, quantile_cont(dist, 0.75) AS p75, quantile_cont(dist, 0.9) AS p90, quantile_cont(dist, 0.95) AS p95,
  quantile_cont(dist, 0.99) AS p99, stddev_pop(dist) AS sd FROM scores WHERE split = 'train')"""


def _with_stats(spark, sf_dir):
    rows = cosine_scores(spark, sf_dir)
    train = rows.where("split = 'train'")
    knots = exact_percentiles(train, "dist", [0.5, 0.75, 0.9, 0.95, 0.99]).select("pct")
    sd = train.agg(F.stddev_pop("dist"))
    return rows.withColumn("knots", knots.scalar()).withColumn("sd", sd.scalar())


BAND_SQL = """CASE WHEN dist <= p75 THEN CASE WHEN m > 3 THEN 'Very high confidence drone' WHEN m > 1.5 THEN 'High confidence drone' WHEN m > 0 THEN 'Moderate confidence drone' ELSE 'Low confidence drone' END
 ELSE CASE WHEN m < -3 THEN 'Very high confidence background' WHEN m < -1.5 THEN 'High confidence background' WHEN m < 0 THEN 'Moderate confidence background' ELSE 'Low confidence background' END END"""


@query(
    "C9 C10",
    f"""WITH {STATS_CTE}, m AS (SELECT *, (p75 - dist) / greatest(sd, 1e-6) AS m FROM scores CROSS JOIN st)
SELECT sample_id, CASE WHEN dist <= p75 THEN 'DRONE' ELSE 'BACKGROUND' END AS verdict, {BAND_SQL} AS band FROM m""",
)
def verdict_and_confidence_band(spark, sf_dir):
    rows = _with_stats(spark, sf_dir)
    thr = F.element_at("knots", 2)
    return rows.select("sample_id", L.verdict("dist", thr).alias("verdict"), L.confidence_band("dist", thr, F.col("sd")).alias("band"))


@query(
    "C11 C12",
    f"""WITH {STATS_CTE} SELECT sample_id, {R('greatest(0, least(1, 1 - dist / (p99 * 2)))')} AS ratio,
 {R('CASE WHEN dist < p50 THEN 50 - (p50 - dist) * 5 WHEN dist < p75 THEN 50 + (dist - p50) / (p75 - p50) * 25 WHEN dist < p90 THEN 75 + (dist - p75) / (p90 - p75) * 15 WHEN dist < p95 THEN 90 + (dist - p90) / (p95 - p90) * 5 WHEN dist < p99 THEN 95 + (dist - p95) / (p99 - p95) * 4 ELSE 99 END')} AS level
FROM scores CROSS JOIN st""",
)
def confidence_ratio_and_level(spark, sf_dir):
    rows = _with_stats(spark, sf_dir)
    return rows.select(
        "sample_id", r(L.confidence_ratio("dist", F.element_at("knots", 5))).alias("ratio"),
        r(L.interp_percentile("dist", F.col("knots"))).alias("level"),
    )


@query(
    "C13",
    """WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount * 10 AS v FROM lineitem)
SELECT CASE WHEN v > 0.9 THEN 'PASS' WHEN v > 0.7 THEN 'PARTIAL' ELSE 'FAIL' END AS transfer,
 CASE WHEN v >= 0.95 THEN 'AIRTIGHT' WHEN v >= 0.9 THEN 'STRONG' ELSE 'SHORTCUT_DETECTED' END AS matched,
 CASE WHEN v > 0.8 THEN 'VULNERABLE' WHEN v < 0.2 THEN 'ROBUST' ELSE 'PARTIAL' END AS replay,
 CASE WHEN v < 0.55 THEN 'CLEAN' WHEN v < 0.65 THEN 'MOSTLY_CLEAN' WHEN v < 0.8 THEN 'PARTIALLY_CONTAMINATED' ELSE 'HEAVILY_CONTAMINATED' END AS surgery,
 CASE WHEN v > 0.7 OR v > 0.8 THEN 'inflated' WHEN v < 0.6 AND v < 0.65 THEN 'clean' ELSE 'inconclusive' END AS artifact, count(*) AS n FROM v GROUP BY ALL""",
)
def metric_grades(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 10).alias("v"))
    kinds = [L.grade("v", k).alias(k) for k in ("transfer", "matched", "replay", "surgery")]
    return rows.groupBy(*kinds, L.artifact_grade("v", "v").alias("artifact")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "C14",
    f"""WITH m(metric, value) AS (SELECT 'knn_k1_accuracy', avg(CASE WHEN l_returnflag <> 'R' THEN 1.0 ELSE 0 END) + 0.1 FROM lineitem UNION ALL SELECT 'silhouette', avg(l_discount) FROM lineitem
 UNION ALL SELECT 'fpr_at_95_tpr', avg(l_tax) FROM lineitem),
g(gate_metric, op, limit_value, gate) AS (VALUES ('knn_k1_accuracy', '>', 0.7, 'success'), ('knn_k1_accuracy', '>', 0.85, 'stretch'), ('probe_accuracy', '>', 0.8, 'success'), ('probe_accuracy', '>', 0.9, 'stretch'),
 ('detection_rate', '>=', 5.0 / 7, 'success'), ('silhouette', '>', 0.0, 'success'), ('fpr_at_95_tpr', '<', 0.1, 'success'), ('fpr_at_95_tpr', '<', 0.05, 'stretch'))
SELECT gate_metric, gate, {R('limit_value')} AS limit_value, {R('value')} AS measured, CASE op WHEN '>' THEN value > limit_value WHEN '>=' THEN value >= limit_value ELSE value < limit_value END AS passed
FROM g LEFT JOIN m ON m.metric = g.gate_metric""",
)
def protocol_gates_on_metrics(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    wide = li.agg(
        (F.avg((F.col("l_returnflag") != "R").cast("double")) + F.lit(0.1)).alias("knn_k1_accuracy"),
        F.avg("l_discount").alias("silhouette"), F.avg("l_tax").alias("fpr_at_95_tpr"),
    )
    metrics = wide.unpivot([], wide.columns, "metric", "value")
    return L.protocol_gates(metrics).select(
        "gate_metric", "gate", r("limit_value").alias("limit_value"), r("measured").alias("measured"), "passed"
    )
