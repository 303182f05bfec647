"""The same operators called from SQL text."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectraloom.functions.sql import mahalanobis_function, register_sql
from spectraloom.operators import gaussian as G
from spectraloom.plans.base import SAMPLES_CTE, R, events, query, r, samples, table
from spectraloom.plans.detection import TRAIN_DIST, train_of
from spectraloom.plans.signal import seg_sql


@query(
    "K2",
    f"""WITH {SAMPLES_CTE}, s AS (SELECT sample_id, embedding AS a, list_reverse(embedding) AS b, label FROM samples)
SELECT sample_id, {R('list_cosine_similarity(a, b)')} AS cosine, {R('1 / (sqrt(list_dot_product(a, a)) + 1e-8) * list_sum(a)')} AS unit_sum,
 CASE WHEN label / 4.0 < 0.5 AND label / 2.0 < 1 THEN 'SURVEILLANCE' WHEN label / 4.0 > 2 OR label / 2.0 > 3 THEN 'ATTACK' ELSE 'TRANSIT' END AS intent FROM s""",
)
def sql_vector_functions(spark, sf_dir):
    register_sql(spark)
    rows = samples(spark, sf_dir)
    return spark.sql(
        """SELECT sample_id, round(cosine_sim(embedding, reverse(embedding)), 6) + 0.0D AS cosine,
                  round(aggregate(l2_normalize(embedding), 0.0D, (acc, x) -> acc + x), 6) + 0.0D AS unit_sum,
                  intent_rule(label / 4.0D, label / 2.0D) AS intent FROM {rows}""",
        rows=rows,
    )


@query("K2 F2", f"WITH RECURSIVE {TRAIN_DIST} SELECT sample_id, {R('dist')} AS dist FROM dist")
def sql_mahalanobis_function(spark, sf_dir):
    rows = samples(spark, sf_dir)
    model = G.fit_gaussian(train_of(rows)).first().asDict()
    mahalanobis_function(spark, model)
    return spark.sql("SELECT sample_id, round(mahalanobis(embedding), 6) + 0.0D AS dist FROM {rows}", rows=rows)


@query(
    "K3 B1",
    f"""WITH {SAMPLES_CTE}, s AS (SELECT sample_id, embedding, unnest(range(0, 7)) AS i FROM samples)
SELECT sample_id, CAST(i AS INTEGER) AS segment_idx, CAST(i * 8 AS INTEGER) AS start_sample, {R('list_sum(list_slice(embedding, i * 8 + 1, i * 8 + 16))')} AS total FROM s""",
)
def sql_segments_table_function(spark, sf_dir):
    register_sql(spark)
    return spark.sql(
        """SELECT sample_id, s.segment_idx, s.start_sample, round(aggregate(s.values, 0.0D, (acc, x) -> acc + x), 6) + 0.0D AS total
           FROM {rows} t, LATERAL segments(t.embedding, 16, 8) s""",
        rows=samples(spark, sf_dir),
    )


@query("K3 B1", f"WITH {seg_sql(32)} SELECT user_id, segment_idx, min(t) + segment_idx * 16 AS start_sample, count(*) AS n, {R('sum(v)')} AS total FROM seg GROUP BY user_id, segment_idx")
def sql_segments_of_series(spark, sf_dir):
    """The windows of ``segment_event_series`` from a table argument: each user's events in order of time."""
    register_sql(spark)
    rows = events(spark, sf_dir).select("user_id", "ts", "event_id", (F.col("value") / 100).alias("v"))
    return spark.sql(
        """SELECT user_id, segment_idx, start_sample, CAST(size(values) AS BIGINT) AS n, round(aggregate(values, 0.0D, (acc, x) -> acc + x), 6) + 0.0D AS total
           FROM series_segments(TABLE(SELECT * FROM {rows}) PARTITION BY user_id ORDER BY (ts, event_id), 'v', 32, 16, 'user_id')""",
        rows=rows,
    )


@query(
    "K3 B1 J3",
    f"""WITH {seg_sql(2, 5)}, e AS (SELECT user_id, event_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events)
SELECT a.user_id, a.event_id, w.segment_idx, w.segment_idx * 5 AS start_sample, a.event_type || '>' || b.event_type AS pair
FROM win w JOIN e a ON a.user_id = w.user_id AND a.idx = w.segment_idx * 5 JOIN e b ON b.user_id = w.user_id AND b.idx = w.segment_idx * 5 + 1""",
)
def sql_segments_with_gaps(spark, sf_dir):
    """Windows further apart than they are long, over a string column: two events out of every five."""
    register_sql(spark)
    return spark.sql(
        """SELECT user_id, event_id, segment_idx, start_sample, concat_ws('>', values) AS pair
           FROM series_segments(TABLE(SELECT user_id, event_id, ts, event_type FROM {rows}) PARTITION BY user_id ORDER BY (ts, event_id), 'event_type', 2, 5, 'user_id,event_id')""",
        rows=events(spark, sf_dir),
    )


@query(
    "K4 G1",
    f"""WITH c AS (SELECT p_brand AS brand, p_size AS s, CAST(p_type = 'ECONOMY' AS INT) AS y FROM part)
SELECT a.brand, {R('avg(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END)')} AS auc FROM c a JOIN c b ON a.brand = b.brand AND a.y = 1 AND b.y = 0 GROUP BY a.brand""",
)
def sql_auc_aggregate(spark, sf_dir):
    register_sql(spark)
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_size").cast("double").alias("s"), (F.col("p_type") == "ECONOMY").cast("int").alias("y"))
    out = spark.sql("SELECT brand, auc_agg(y, s) AS auc FROM {rows} GROUP BY brand", rows=rows)
    return out.where("auc IS NOT NULL").select("brand", r("auc").alias("auc"))
