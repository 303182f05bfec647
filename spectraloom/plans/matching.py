"""Registry, identification, authentication, neighbours, pairs and continual enrolment."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectraloom.functions.rows import attach_row
from spectraloom.functions import vectors as V
from spectraloom.operators import continual as C
from spectraloom.operators import matching as M
from spectraloom.operators import neighbours as N
from spectraloom.operators import registry as G
from spectraloom.plans.base import LONG_CTE, SAMPLES_CTE, R, events, query, r, samples, table
from spectraloom.plans.detection import SCORES_CTE, cosine_scores
from spectraloom.session import materialize

THR = 0.25  # the given vectors are nearly isotropic, so the default 0.85 would only ever say UNKNOWN
EPOCH = "2024-01-01 00:00:00"

# ---- registry of label means, and packets that claim a serial -----------------------------------


def label_registry(spark, sf_dir):
    """Labels 0-7 enrolled by their means; 8 and 9 stay unknown."""
    rows = samples(spark, sf_dir).where("label <= 7")
    return materialize(G.enroll_means(rows, "label", enrolled_at=EPOCH), "registry")


def packets(spark, sf_dir):
    """Every sample as a packet: some claim their own label, some another, some send no print."""
    claim = F.when(F.col("sample_id") % 3 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return samples(spark, sf_dir).select(
        F.col("sample_id").alias("packet_id"),
        claim.cast("string").alias("serial"),
        F.when(F.col("sample_id") % 11 != 0, F.col("embedding")).alias("fingerprint"),
        "label",
    )


REG_CTE = LONG_CTE + """,
reg AS (SELECT CAST(label AS VARCHAR) AS serial, d, avg(x) AS c FROM long WHERE label <= 7 GROUP BY label, d),
sims AS (SELECT sample_id, any_value(label) AS label, serial,
  sum(x * c) / (sqrt(sum(x * x)) * sqrt(sum(c * c))) AS sim FROM long JOIN reg USING (d) GROUP BY sample_id, serial),
near AS (SELECT sample_id, any_value(label) AS label, arg_max(serial, sim) AS closest, max(sim) AS closest_sim FROM sims GROUP BY sample_id)"""


@query(
    "F9",
    f"""WITH {REG_CTE} SELECT sample_id, CASE WHEN closest_sim >= {THR} THEN 'FRIENDLY' ELSE 'UNKNOWN' END AS verdict,
 CASE WHEN closest_sim >= {THR} THEN closest END AS matched, {R('closest_sim')} AS similarity FROM near""",
)
def identify_against_registry(spark, sf_dir):
    out = M.identify(samples(spark, sf_dir), label_registry(spark, sf_dir), "sample_id", "embedding", THR)
    return out.select("sample_id", "verdict", "matched", r("similarity").alias("similarity"))


@query("F9", f"WITH {REG_CTE} SELECT sample_id, serial, {R('sim')} AS similarity FROM sims")
def all_registry_similarities(spark, sf_dir):
    out = M.all_similarities(samples(spark, sf_dir), label_registry(spark, sf_dir), "sample_id", "embedding")
    return out.select("sample_id", "serial", r("similarity").alias("similarity"))


@query(
    "F10",
    f"WITH {REG_CTE} SELECT sample_id, CASE WHEN closest_sim >= {THR} THEN closest END AS found_serial FROM near",
)
def find_closest_enrolled(spark, sf_dir):
    out = M.find_by_fingerprint(samples(spark, sf_dir), label_registry(spark, sf_dir), "sample_id", "embedding", THR)
    return out.select("sample_id", "found_serial")


PACKET_CTE = REG_CTE + f""",
pk AS (SELECT sample_id AS packet_id, CAST(CASE WHEN sample_id % 3 = 0 THEN (label + 1) % 10 ELSE label END AS VARCHAR) AS serial,
  sample_id % 11 <> 0 AS has_print FROM samples),
j AS (SELECT pk.*, s.sim AS claimed_sim, n.closest, n.closest_sim, k.serial IS NOT NULL AS known FROM pk
  LEFT JOIN sims s ON s.sample_id = pk.packet_id AND s.serial = pk.serial
  LEFT JOIN near n ON n.sample_id = pk.packet_id
  LEFT JOIN (SELECT DISTINCT serial FROM reg) k ON k.serial = pk.serial)"""


@query(
    "F12 F13",
    f"""WITH {PACKET_CTE} SELECT packet_id,
 CASE WHEN NOT has_print THEN 'UNKNOWN' WHEN known AND claimed_sim >= {THR} THEN 'AUTHENTIC' WHEN known THEN 'SPOOFED'
   WHEN closest_sim >= {THR} THEN 'SPOOFED' ELSE 'NOT_ENROLLED' END AS verdict,
 {R(f"CASE WHEN NOT has_print THEN 0 WHEN known AND claimed_sim >= {THR} THEN (claimed_sim - {THR}) / (1 - {THR} + 1e-8) WHEN known THEN 1 - claimed_sim WHEN closest_sim >= {THR} THEN closest_sim ELSE 0.5 END")} AS confidence,
 CASE WHEN NOT has_print THEN NULL WHEN known AND claimed_sim >= {THR} THEN serial WHEN known THEN NULL
   WHEN closest_sim >= {THR} THEN closest END AS matched,
 {R("CASE WHEN NOT has_print THEN 0 WHEN known THEN claimed_sim ELSE closest_sim END")} AS similarity FROM j""",
)
def authenticate_packets(spark, sf_dir):
    out = M.authenticate(packets(spark, sf_dir), label_registry(spark, sf_dir), THR)
    return out.select("packet_id", "verdict", r("confidence").alias("confidence"), "matched", r("similarity").alias("similarity"))


@query(
    "F14",
    f"""WITH {PACKET_CTE} SELECT packet_id,
 CASE WHEN NOT has_print THEN 'UNKNOWN' WHEN known AND claimed_sim >= {THR} THEN 'AUTHENTIC' WHEN known THEN 'SPOOFED' ELSE 'NOT_ENROLLED' END AS verdict,
 {R(f"CASE WHEN NOT has_print THEN 0 WHEN known AND claimed_sim >= {THR} THEN claimed_sim WHEN known THEN 1 - claimed_sim ELSE 0.5 END")} AS confidence,
 CASE WHEN NOT has_print THEN NULL WHEN known AND claimed_sim >= {THR} THEN serial WHEN known THEN NULL ELSE closest END AS matched FROM j""",
)
def authenticate_packets_demo(spark, sf_dir):
    out = M.authenticate(packets(spark, sf_dir), label_registry(spark, sf_dir), THR, mode="demo")
    return out.select("packet_id", "verdict", r("confidence").alias("confidence"), "matched")


@query(
    "F12",
    """SELECT event_id, CAST(user_id AS VARCHAR) AS serial, user_id % 4 <> 0 AS is_enrolled,
 CASE WHEN user_id % 4 <> 0 THEN 'type' || (user_id % 5) END AS enrolled_type FROM events""",
)
def find_serial_of_events(spark, sf_dir):
    ev = events(spark, sf_dir).withColumn("serial", F.col("user_id").cast("string"))
    reg = ev.where("user_id % 4 <> 0").select(
        "serial", F.concat(F.lit("type"), (F.col("user_id") % 5).cast("string")).alias("drone_type"),
        F.array(F.lit(1.0)).alias("fingerprint"),
    ).distinct()
    return G.find_by_serial(ev, reg, "serial").select("event_id", "serial", "is_enrolled", "enrolled_type")


def _event_registry(ev):
    return ev.select(
        F.col("event_id"), F.col("user_id").cast("string").alias("serial"), F.col("event_type").alias("drone_type"),
        F.array(F.col("value"), F.lit(1.0)).alias("fingerprint"), "ts",
    )


@query(
    "A17",
    """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS serial, event_type AS drone_type, value, ts FROM events),
l AS (SELECT *, row_number() OVER (PARTITION BY serial ORDER BY ts DESC) AS rn FROM e)
SELECT serial, drone_type, value AS first_dim, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS enrolled_at FROM l WHERE rn = 1""",
)
def registry_upsert_latest(spark, sf_dir):
    rows = _event_registry(events(spark, sf_dir)).withColumn("enrolled_at", F.col("ts"))
    half = F.lit("2024-01-15").cast("timestamp")
    cols = ["serial", "drone_type", "fingerprint", "enrolled_at"]

    def newest(df):
        pick = F.max_by(F.struct("drone_type", "fingerprint", "enrolled_at"), "enrolled_at")
        return df.groupBy("serial").agg(pick.alias("_r")).select("serial", "_r.*").select(*cols)

    merged = G.upsert(newest(rows.where(F.col("ts") < half)), newest(rows.where(F.col("ts") >= half)))
    return merged.select(
        "serial", "drone_type", F.element_at("fingerprint", 1).alias("first_dim"),
        F.date_format("enrolled_at", G.UTC_FORMAT).alias("enrolled_at"),
    )


@query(
    "A18",
    f"""WITH e AS (SELECT CASE WHEN user_id % 7 <> 0 THEN CAST(user_id AS VARCHAR) END AS serial, value, event_type, ts,
  event_type <> 'error' AS has_print FROM events)
SELECT 'enrolled' AS outcome, count(DISTINCT serial) AS n FROM e WHERE has_print AND serial IS NOT NULL
UNION ALL SELECT 'no fingerprint', count(*) FROM e WHERE NOT has_print
UNION ALL SELECT 'no serial', count(*) FROM e WHERE has_print AND serial IS NULL""",
)
def enroll_from_event_packets(spark, sf_dir):
    pk = _event_registry(events(spark, sf_dir)).withColumn(
        "serial", F.when(F.col("serial").cast("long") % 7 != 0, F.col("serial"))
    ).withColumn("fingerprint", F.when(F.col("drone_type") != "error", F.col("fingerprint")))
    rows, rejected = G.enroll_from_packets(pk)
    return rows.select(F.lit("enrolled").alias("outcome")).unionByName(
        rejected.select(F.col("reason").alias("outcome"))
    ).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(
    "J12",
    """WITH reg AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click'),
d AS (SELECT user_id, max(ts) AS seen, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY user_id)
SELECT CAST(reg.user_id AS VARCHAR) AS serial, coalesce(n, 0) AS detection_count, strftime(seen, '%Y-%m-%dT%H:%M:%SZ') AS last_seen
FROM reg LEFT JOIN d USING (user_id)""",
)
def registry_touch(spark, sf_dir):
    ev = events(spark, sf_dir).withColumn("serial", F.col("user_id").cast("string"))
    reg = ev.where("event_type = 'click'").select("serial").distinct().select(
        "serial", F.lit(None).cast("timestamp").alias("last_seen"), F.lit(0).cast("long").alias("detection_count")
    )
    out = G.touch(reg, ev.where("event_type <> 'error'"))
    return out.select("serial", "detection_count", F.date_format("last_seen", G.UTC_FORMAT).alias("last_seen"))


@query(
    "J7 E2",
    f"""WITH {LONG_CTE}, m AS (SELECT label, d, avg(x) AS c FROM long WHERE split = 'train' GROUP BY label, d),
n AS (SELECT label, count(*) AS n FROM samples GROUP BY label)
SELECT CAST(m.label AS VARCHAR) AS serial, d AS dim, {R('c')} AS value, n.n AS detection_count FROM m JOIN n USING (label)""",
)
def enroll_type_means(spark, sf_dir):
    out = G.enroll_means(samples(spark, sf_dir).where("split = 'train'"), "label", enrolled_at=EPOCH)
    return out.select("serial", "detection_count", F.posexplode("fingerprint").alias("p", "v")).select(
        "serial", (F.col("p") + 1).cast("long").alias("dim"), r("v").alias("value"), "detection_count"
    )


# ---- neighbours ---------------------------------------------------------------------------------

KNN_SQL = LONG_CTE + f""",
b AS (SELECT sample_id, label, split, embedding FROM samples WHERE split IN ('train', 'negatives')),
q AS (SELECT sample_id, label, embedding FROM samples WHERE split = 'holdout'),
nn AS (SELECT q.sample_id, b.sample_id AS neighbour, b.split, 1 - list_cosine_similarity(q.embedding, b.embedding) AS dist,
  row_number() OVER (PARTITION BY q.sample_id ORDER BY round(1 - list_cosine_similarity(q.embedding, b.embedding), 9), b.sample_id) AS rank
  FROM q CROSS JOIN b)"""


def _knn_sides(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("is_drone", (F.col("split") != "negatives").cast("int"))
    return rows.where("split = 'holdout'"), rows.where("split <> 'holdout'")


@query("F7", f"WITH {KNN_SQL} SELECT sample_id, rank, neighbour, {R('dist')} AS dist FROM nn WHERE rank <= 5")
def knn_cosine_neighbours(spark, sf_dir):
    held, base = _knn_sides(spark, sf_dir)
    out = N.knn(held, base, 5)
    return out.select("sample_id", F.col("rank").cast("long").alias("rank"), "neighbour", r("dist").alias("dist"))


@query(
    "F7",
    f"""WITH {KNN_SQL}, ks(k) AS (VALUES (1), (5)),
v AS (SELECT k, sample_id, CAST(2 * sum(CASE WHEN split <> 'negatives' THEN 1 ELSE 0 END) > k AS INT) AS pred
  FROM nn JOIN ks ON rank <= k GROUP BY k, sample_id)
SELECT CAST(k AS BIGINT) AS k, label, count(*) AS n, {R('avg(pred)')} AS drone_recall FROM v JOIN q USING (sample_id) GROUP BY k, label""",
)
def knn_report_by_type(spark, sf_dir):
    """Majority vote of 1 and 5 neighbours among train and negatives, per k and held-out type."""
    held, base = _knn_sides(spark, sf_dir)
    hits = N.knn(held, base, 5, payload=["is_drone"], query_cols=["label"])
    votes = N.knn_vote(hits, "sample_id", "is_drone", [1, 5], keep=["label"])
    return votes.groupBy(F.col("k").cast("long").alias("k"), "label").agg(
        F.count(F.lit(1)).alias("n"), r(F.avg("predicted")).alias("drone_recall")
    )


@query("F7", f"WITH {KNN_SQL} SELECT sample_id, rank, neighbour, {R('dist')} AS dist FROM nn WHERE rank <= 3")
def knn_cosine_by_cells(spark, sf_dir):
    """The same search through pivot cells, the way it runs when neither side may be broadcast."""
    held, base = _knn_sides(spark, sf_dir)
    out = N.knn(held, base, 3, broadcast_bytes=0)
    return out.select("sample_id", F.col("rank").cast("long").alias("rank"), "neighbour", r("dist").alias("dist"))


@query("F7", f"WITH {KNN_SQL} SELECT sample_id, rank, neighbour, {R('dist')} AS dist FROM nn WHERE rank <= 5")
def knn_cosine_by_hashed_tables(spark, sf_dir):
    """Random-projection tables with a certificate per query; what they cannot prove goes through the exact cells."""
    held, base = _knn_sides(spark, sf_dir)
    out = N.knn_hashed(held, base, 5)
    return out.select("sample_id", F.col("rank").cast("long").alias("rank"), "neighbour", r("dist").alias("dist"))


@query("F7", f"WITH {KNN_SQL} SELECT CAST(label AS INTEGER) AS label, count(DISTINCT sample_id) AS n, true AS recall_reached, CAST(0 AS BIGINT) AS wrongly_certified FROM q GROUP BY label")
def hashed_tables_recall(spark, sf_dir):
    """Recall of the tables alone (8 bits) against the exact search, at least 0.9 for each held-out type; certified queries have no false neighbour."""
    held, base = _knn_sides(spark, sf_dir)
    exact = N.knn(held, base, 5, query_cols=["label"]).select("sample_id", "label", "neighbour", F.lit(1).alias("true_one"))
    near = N.knn_hashed(held, base, 5, tables=6, probes=96, bits=8, exact_rest=False).select("sample_id", "neighbour", "certified", F.lit(1).alias("hashed"))
    both = exact.join(near.select("sample_id", "neighbour", "hashed"), ["sample_id", "neighbour"], "left")
    both = both.join(near.select("sample_id", "certified").distinct(), "sample_id", "left")
    return both.groupBy(F.col("label").cast("int").alias("label")).agg(
        F.count_distinct("sample_id").alias("n"),
        (F.count("hashed") >= 0.9 * F.count("true_one")).alias("recall_reached"),
        F.count(F.when(F.col("certified") & F.col("hashed").isNull(), 1)).alias("wrongly_certified"),
    )


@query(
    "F8 D13",
    f"""WITH {SAMPLES_CTE}, f AS (SELECT *, ('0x' || substr(md5(sample_id || ':17'), 1, 8))::UBIGINT % 3 AS fold FROM samples),
nn AS (SELECT q.sample_id, q.label, q.fold, b.label AS bl,
  row_number() OVER (PARTITION BY q.sample_id ORDER BY round(1 - list_cosine_similarity(q.embedding, b.embedding), 9), b.sample_id) AS rank
  FROM f q JOIN f b ON q.fold <> b.fold),
c AS (SELECT sample_id, label, fold, bl, count(*) AS n FROM nn WHERE rank <= 10 GROUP BY ALL),
p AS (SELECT sample_id, label, fold, arg_max(bl, (n, -bl)) AS pred FROM c GROUP BY ALL)
SELECT CAST(fold AS BIGINT) AS fold, count(*) AS n, {R('avg(CASE WHEN pred = label THEN 1.0 ELSE 0 END)')} AS accuracy FROM p GROUP BY fold""",
)
def knn_cross_validated(spark, sf_dir):
    from spectraloom.operators.sampling import kfold

    rows = kfold(samples(spark, sf_dir), "sample_id", 3, seed=17)
    hits = N.knn(rows, rows.withColumn("bl", F.col("label")), 10, payload=["bl"], exclude_equal="fold", query_cols=["label", "fold"])
    votes = N.knn_vote(hits, "sample_id", "bl", [10], keep=["label", "fold"])
    return votes.groupBy(F.col("fold").cast("long").alias("fold")).agg(
        F.count(F.lit(1)).alias("n"), r(F.avg((F.col("predicted") == F.col("label")).cast("double"))).alias("accuracy")
    )


# ---- centroids ----------------------------------------------------------------------------------

CENT_SQL = LONG_CTE + """,
h AS (SELECT label, d, avg(x) AS c FROM long WHERE split = 'holdout' GROUP BY label, d),
t AS (SELECT label AS tl, d, avg(x) AS c FROM long WHERE split = 'train' GROUP BY label, d),
g AS (SELECT d, avg(x) AS c FROM long WHERE split = 'negatives' GROUP BY d)"""


def _cent_sql(dist: str) -> str:
    return f"""WITH {CENT_SQL}, dt AS (SELECT h.label, tl, {dist.replace('A', 'h.c').replace('B', 't.c')} AS dd FROM h JOIN t USING (d) GROUP BY h.label, tl),
dg AS (SELECT h.label, {dist.replace('A', 'h.c').replace('B', 'g.c')} AS db FROM h JOIN g USING (d) GROUP BY h.label)
SELECT label, {R('min(dd)')} AS d_drone, {R('any_value(db)')} AS d_background, any_value(db) > min(dd) AS detected FROM dt JOIN dg USING (label) GROUP BY label"""


def _cent(spark, sf_dir, metric):
    out = M.centroid_analysis(samples(spark, sf_dir), "label", metric=metric)
    return out.select("label", r("d_drone").alias("d_drone"), r("d_background").alias("d_background"), "detected")


@query("F5", _cent_sql("1 - sum(A * B) / (sqrt(sum(A * A)) * sqrt(sum(B * B)) + 1e-8)"))
def centroid_analysis_cosine(spark, sf_dir):
    return _cent(spark, sf_dir, "cosine")


@query("F6", _cent_sql("sqrt(sum((A - B) * (A - B)))"))
def centroid_analysis_euclidean(spark, sf_dir):
    return _cent(spark, sf_dir, "l2")


@query(
    "F18",
    f"""WITH {LONG_CTE}, a AS (SELECT d, avg(x) AS c FROM long WHERE label = 8 GROUP BY d), b AS (SELECT d, avg(x) AS c FROM long WHERE label = 9 GROUP BY d)
SELECT {R('sum(a.c * b.c) / (sqrt(sum(a.c * a.c)) * sqrt(sum(b.c * b.c)))')} AS cosine FROM a JOIN b USING (d)""",
)
def centroid_cosine_between_backgrounds(spark, sf_dir):
    rows = samples(spark, sf_dir)
    return M.centroid_cosine(rows.where("label = 8"), rows.where("label = 9")).select(r("cosine").alias("cosine"))


PAIR_SQL = LONG_CTE + """,
m AS (SELECT label % 3 AS model, label AS unit, d, avg(x) AS c FROM long GROUP BY label, d),
pr AS (SELECT a.model, a.unit, b.unit AS other_unit, sum(a.c * b.c) / (sqrt(sum(a.c * a.c)) * sqrt(sum(b.c * b.c))) AS cosine
  FROM m a JOIN m b ON a.model = b.model AND a.unit < b.unit AND a.d = b.d GROUP BY ALL)"""


def _units(spark, sf_dir):
    return samples(spark, sf_dir).select((F.col("label") % 3).alias("model"), F.col("label").alias("unit"), "embedding")


@query("F11", f"WITH {PAIR_SQL} SELECT model, unit, other_unit, {R('cosine')} AS cosine FROM pr")
def unit_pairs_within_model(spark, sf_dir):
    out = M.pairwise_within(_units(spark, sf_dir), "model", "unit")
    return out.select("model", "unit", "other_unit", r("cosine").alias("cosine"))


@query(
    "E18",
    f'WITH {PAIR_SQL} SELECT model, count(*) AS pairs, {R("avg(cosine)")} AS "mean", {R("min(cosine)")} AS "min", {R("max(cosine)")} AS "max" FROM pr GROUP BY model',
)
def unit_separation_by_model(spark, sf_dir):
    out = M.unit_separation(_units(spark, sf_dir), "model", "unit")
    return out.select("model", F.col("pairs").cast("long").alias("pairs"), r("mean").alias("mean"), r("min").alias("min"), r("max").alias("max"))


# ---- pairs --------------------------------------------------------------------------------------

PAIRED_SQL = SCORES_CTE + """,
dr AS (SELECT label, dist, row_number() OVER (ORDER BY sample_id) AS i FROM scores WHERE split = 'holdout'),
bg AS (SELECT dist AS bdist, row_number() OVER (ORDER BY sample_id) AS i FROM scores WHERE split = 'negatives'),
pr AS (SELECT * FROM dr JOIN bg USING (i))"""


def _paired(spark, sf_dir):
    from spectraloom.operators.sampling import pair_by_position

    rows = cosine_scores(spark, sf_dir)
    return pair_by_position(
        rows.where("split = 'holdout'").select("sample_id", "label", "dist"),
        rows.where("split = 'negatives'").select(F.col("sample_id").alias("bg_id"), F.col("dist").alias("bdist")),
        "sample_id", "bg_id",
    )


@query("D12", f"WITH {PAIRED_SQL} SELECT i AS position, label, dist, bdist FROM pr")
def pair_by_position_scores(spark, sf_dir):
    return _paired(spark, sf_dir).select("position", "label", "dist", "bdist")


@query(
    "F15",
    f"""WITH {PAIRED_SQL} SELECT label, count(*) AS pairs, CAST(sum(CAST(dist < bdist AS INT)) AS BIGINT) AS closer, CAST(sum(CAST(dist = bdist AS INT)) AS BIGINT) AS ties,
 {R('avg(CAST(dist < bdist AS INT))')} AS closer_rate, {R('avg(CASE WHEN dist > bdist THEN dist - bdist END)')} AS mean_failure_margin,
 {R('max(CASE WHEN dist > bdist THEN dist - bdist END)')} AS max_failure_margin, CAST(grouping(label) AS BIGINT) AS is_total FROM pr GROUP BY ROLLUP (label)""",
)
def drone_closer_than_own_background(spark, sf_dir):
    out = M.pairwise_closer(_paired(spark, sf_dir), "dist", "bdist", "label")
    return out.select(
        "label", "pairs", "closer", "ties", r("closer_rate").alias("closer_rate"),
        r("mean_failure_margin").alias("mean_failure_margin"), r("max_failure_margin").alias("max_failure_margin"), "is_total",
    )


@query(
    "F17",
    f"""WITH {SCORES_CTE}, r AS (SELECT sample_id, dist FROM scores WHERE split = 'negatives'), q AS (SELECT dist AS qd FROM scores WHERE split = 'holdout')
SELECT sample_id, {R('avg(CASE WHEN qd < dist THEN 1.0 ELSE 0 END)')} AS closer_fraction FROM r CROSS JOIN q GROUP BY sample_id""",
)
def closer_fraction_per_background(spark, sf_dir):
    rows = cosine_scores(spark, sf_dir)
    out = M.closer_fraction(
        rows.where("split = 'holdout'"), "dist", rows.where("split = 'negatives'").select("sample_id", "dist"), "dist"
    )
    return out.select("sample_id", r("closer_fraction").alias("closer_fraction"))


@query(
    "F17",
    """WITH a AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey, l_linenumber, l_discount AS sa, l_tax AS sb FROM lineitem),
g AS (SELECT id, min(sa) AS sa, max(sb) AS sb FROM a GROUP BY id)
SELECT arg_max(id, (round(sb - sa, 6), -id)) AS id, max(round(sb - sa, 6)) + 0.0 AS contrast FROM g""",
)
def largest_contrast_between_models(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")).agg(
        F.min("l_discount").alias("sa"), F.max("l_tax").alias("sb")
    )
    a, b = li.select("id", F.col("sa").alias("s")), li.select("id", F.col("sb").alias("s"))
    return _rounded_contrast(a, b)


def _rounded_contrast(a, b):
    other = b.select(F.col("id").alias("id"), F.col("s").alias("o"))
    rounded = a.join(other, "id").select("id", F.lit(0.0).alias("s"), F.round(F.col("o") - F.col("s"), 6).alias("t"))
    out = M.contrast_argmax(rounded.select("id", "s"), rounded.select("id", F.col("t").alias("s")), "id", "s")
    return out.select("id", r("contrast").alias("contrast"))


@query(
    "F19",
    f"""WITH {LONG_CTE}, c AS (SELECT d, avg(x) AS c FROM long WHERE split = 'train' GROUP BY d),
e AS (SELECT sample_id, d, x, c FROM long JOIN c USING (d)),
o AS (SELECT sample_id, sqrt(sum((x - c) * (x - c))) AS od FROM e WHERE sample_id % 5 = 0 GROUP BY sample_id),
rp AS (SELECT r.sample_id, r.sample_id - r.sample_id % 5 AS orig, sqrt(sum((r.x - r.c) * (r.x - r.c))) AS rd, sqrt(sum((r.x - o.x) * (r.x - o.x))) AS sp
  FROM e r JOIN e o ON o.sample_id = r.sample_id - r.sample_id % 5 AND o.d = r.d WHERE r.sample_id % 5 <> 0 GROUP BY r.sample_id)
SELECT orig AS original_id, count(*) AS replays, {R('avg(sp)')} AS spread, bool_and((rd <= 0.99) = (od <= 0.99)) AS consistent,
 {R('avg(abs(rd - od))')} AS dist_variation, {R('avg(CASE WHEN rd <= 0.99 THEN 1.0 ELSE 0 END)')} AS ghost_rate
FROM rp JOIN o ON o.sample_id = rp.orig GROUP BY orig""",
)
def replay_consistency(spark, sf_dir):
    from spectraloom.operators.moments import centroid

    rows = samples(spark, sf_dir)
    center = centroid(rows.where("split = 'train'")).select("centroid")
    scored = attach_row(rows, center).select(
        (F.col("sample_id") - F.col("sample_id") % 5).alias("original_id"), "sample_id", "embedding",
        F.sqrt(V.sq_dist("embedding", "centroid")).alias("dist"),
    )
    out = M.replay_report(scored.where("sample_id % 5 = 0"), scored.where("sample_id % 5 <> 0"), "original_id", 0.99)
    return out.select(
        "original_id", "replays", r("spread").alias("spread"), "consistent",
        r("dist_variation").alias("dist_variation"), r("ghost_rate").alias("ghost_rate"),
    )


@query("F20", f"WITH {SAMPLES_CTE} SELECT label <= 7 AS enrolled, label, count(*) AS n FROM samples GROUP BY label")
def restrict_to_enrolled_types(spark, sf_dir):
    rows, reg = samples(spark, sf_dir), label_registry(spark, sf_dir)
    inside = M.restrict_to_enrolled(rows, reg, "label").withColumn("enrolled", F.lit(True))
    outside = M.restrict_to_enrolled(rows, reg, "label", keep=False).withColumn("enrolled", F.lit(False))
    return inside.unionByName(outside).groupBy("enrolled", "label").agg(F.count(F.lit(1)).alias("n"))


@query("F21", f"WITH {SCORES_CTE} SELECT split AS population, y, count(*) AS n, {R('avg(dist)')} AS mean_dist FROM scores WHERE split <> 'train' GROUP BY split, y")
def union_of_populations(spark, sf_dir):
    rows = cosine_scores(spark, sf_dir)
    both = M.union_populations(
        {"holdout": (rows.where("split = 'holdout'"), 1), "negatives": (rows.where("split = 'negatives'"), 0)}, ["dist"]
    )
    return both.groupBy("population", "y").agg(F.count(F.lit(1)).alias("n"), r(F.avg("dist")).alias("mean_dist"))


@query("F22", "SELECT DISTINCT label FROM embeddings WHERE label <= 8 EXCEPT SELECT DISTINCT label FROM embeddings WHERE label >= 8 OR label <= 5")
def holdout_label_difference(spark, sf_dir):
    rows = samples(spark, sf_dir)
    return M.label_diff(rows.where("label <= 8"), rows.where("split <> 'holdout'"), "label")


# ---- continual enrolment ------------------------------------------------------------------------

HISTORY_SQL = "h AS (SELECT event_type, CAST(day(ts) AS BIGINT) AS step, round(avg(value) / 100, 6) AS accuracy FROM events GROUP BY ALL)"


def history(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type", F.dayofmonth("ts").cast("long").alias("step")).agg(
        F.round(F.avg("value") / 100, 6).alias("accuracy")
    )


@query(
    "J6",
    f"""WITH {HISTORY_SQL}, b AS (SELECT *, max(accuracy) OVER (PARTITION BY event_type ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM h)
SELECT event_type, step, {R('accuracy')} AS accuracy, {R('best')} AS best, {R('best - accuracy')} AS "drop" FROM b WHERE best - accuracy > 0.05""",
)
def drift_of_types(spark, sf_dir):
    out = C.drift(history(spark, sf_dir), "event_type", "step", "accuracy", 0.05)
    return out.select("event_type", "step", r("accuracy").alias("accuracy"), r("best").alias("best"), r("drop").alias("drop"))


@query(
    "J8",
    f"""WITH {REG_CTE} SELECT label, count(*) AS n, {R(f"avg(CASE WHEN closest = CAST(label AS VARCHAR) AND closest_sim >= {THR} THEN 1.0 ELSE 0 END)")} AS accuracy
FROM near WHERE label <= 7 GROUP BY label""",
)
def verify_enrolled_types(spark, sf_dir):
    out = C.verify(samples(spark, sf_dir), label_registry(spark, sf_dir), "label", "sample_id", thr=THR)
    return out.select("label", "n", r("accuracy").alias("accuracy"))


@query(
    "J9",
    f"""WITH {REG_CTE}, st AS (SELECT s.sample_id, s.label, t.step, arg_max(serial, sim) AS best, max(sim) AS bs
  FROM sims s JOIN (SELECT unnest(range(1, 9)) AS step) t ON CAST(s.serial AS INT) < t.step AND s.label < t.step GROUP BY ALL)
SELECT CAST(step AS BIGINT) AS step, CAST(label AS VARCHAR) AS type, count(*) AS n, {R(f"avg(CASE WHEN best = CAST(label AS VARCHAR) AND bs >= {THR} THEN 1.0 ELSE 0 END)")} AS accuracy
FROM st GROUP BY step, label""",
)
def enrollment_curve_by_step(spark, sf_dir):
    out = C.enrollment_curve(samples(spark, sf_dir), label_registry(spark, sf_dir), "label", "serial", thr=THR)
    return out.select("step", "type", "n", r("accuracy").alias("accuracy"))


@query(
    "J10",
    f"""WITH {LONG_CTE}, cur AS (SELECT label AS l, d, avg(x) AS c FROM long WHERE label <= 7 AND recording_id >= 10 GROUP BY label, d),
snap AS (SELECT label AS l, d, avg(x) AS s FROM long WHERE label <= 7 AND recording_id < 10 GROUP BY label, d),
bl AS (SELECT l, d, step, power(0.85, step) * c + (1 - power(0.85, step)) * s AS f FROM cur JOIN snap USING (l, d) CROSS JOIN (SELECT unnest(range(0, 6)) AS step)),
sm AS (SELECT sample_id, any_value(label) AS label, step, l, sum(x * f) / (sqrt(sum(x * x)) * sqrt(sum(f * f))) AS sim FROM long JOIN bl USING (d) WHERE label <= 7 GROUP BY sample_id, step, l),
be AS (SELECT sample_id, label, step, arg_max(l, sim) AS best, max(sim) AS bs FROM sm GROUP BY ALL)
SELECT CAST(step AS BIGINT) AS step, CAST(label AS VARCHAR) AS type, {R(f"avg(CASE WHEN best = label AND bs >= {THR} THEN 1.0 ELSE 0 END)")} AS accuracy FROM be GROUP BY step, label""",
)
def registry_repair_curve(spark, sf_dir):
    rows = samples(spark, sf_dir).where("label <= 7")
    cur = G.enroll_means(rows.where("recording_id >= 10"), "label", enrolled_at=EPOCH)
    snap = G.enroll_means(rows.where("recording_id < 10"), "label", enrolled_at=EPOCH)
    out = C.repair_curve(rows, cur, snap, "label", 0.15, 5, thr=THR)
    return out.select("step", "type", r("accuracy").alias("accuracy"))


@query(
    "J10",
    f"""WITH c(step, type, accuracy) AS (SELECT CAST(day(ts) AS BIGINT) - 1, event_type, avg(value) / 100 FROM events GROUP BY ALL),
b AS (SELECT event_type AS type, avg(value) / 100 + 0.1 AS best FROM events GROUP BY event_type),
s AS (SELECT step, max(best - accuracy) AS worst FROM c JOIN b USING (type) GROUP BY step)
SELECT CAST(coalesce(min(CASE WHEN worst <= 0.15 THEN step END), 30) AS BIGINT) AS steps, min(CASE WHEN worst <= 0.15 THEN step END) IS NOT NULL AS clean,
 {R('max(CASE WHEN step = 0 THEN worst END)')} AS drop_before, {R('min(worst)')} AS best_drop FROM s""",
)
def repair_stops_at_first_clean_step(spark, sf_dir):
    """A step per day of the month, over all events."""
    ev = events(spark, sf_dir)
    curve = ev.groupBy(
        (F.dayofmonth("ts").cast("long") - 1).alias("step"), F.col("event_type").alias("type")
    ).agg((F.avg("value") / 100).alias("accuracy"))
    best = ev.groupBy(F.col("event_type").alias("type")).agg((F.avg("value") / 100 + F.lit(0.1)).alias("best"))
    out = C.first_clean_step(curve, best, 0.15, 30)
    return out.select("steps", "clean", r("drop_before").alias("drop_before"), r("best_drop").alias("best_drop"))
