"""Seeded samples, splits, folds, weights and pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectraloom.functions import labels as L
from spectraloom.operators import sampling as S
from spectraloom.plans.base import SAMPLES_CTE, R, query, r, samples, table


def md5i(expr: str, seed: int) -> str:
    return f"CAST(CAST('0x' || substr(md5({expr} || ':{seed}'), 1, 8) AS UBIGINT) AS BIGINT)"


@query("D1", f"WITH {SAMPLES_CTE} SELECT sample_id, label FROM samples ORDER BY md5(sample_id || ':42'), sample_id LIMIT 100")
def sample_exact_n(spark, sf_dir):
    return S.sample_n(samples(spark, sf_dir), 100, "sample_id", 42).select("sample_id", "label")


@query("D1", "SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS id_sum FROM (SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey || ':5'), o_orderkey LIMIT 120000)")
def sample_exact_n_large(spark, sf_dir):
    """More rows than one task should sort: ranks come from hash ranges instead of a limit."""
    got = S.sample_n(table(spark, sf_dir, "orders"), 120_000, "o_orderkey", 5)
    return got.agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("id_sum"))


@query(
    "D2",
    """WITH k AS (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem)
SELECT l_suppkey, l_orderkey, CAST(l_linenumber AS BIGINT) AS line FROM k WHERE rn <= 5""",
)
def cap_rows_per_supplier(spark, sf_dir):
    got = S.cap_per_group(table(spark, sf_dir, "lineitem"), "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey"], 5)
    return got.select("l_suppkey", "l_orderkey", F.col("l_linenumber").cast("long").alias("line"))


@query(
    "D3",
    f"""WITH {SAMPLES_CTE}, k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(sample_id || ':9'), sample_id) AS rn FROM samples)
SELECT label, sample_id FROM k WHERE rn <= 20""",
)
def sample_per_type(spark, sf_dir):
    return S.sample_per_group(samples(spark, sf_dir), "label", "sample_id", 20, 9).select("label", "sample_id")


@query(
    "D4",
    f"""WITH {SAMPLES_CTE}, q AS (SELECT greatest(1, 64 // count(DISTINCT label)) AS q FROM samples),
k AS (SELECT sample_id, label, row_number() OVER (PARTITION BY label ORDER BY sample_id) AS rn FROM samples)
SELECT sample_id, label FROM k, q WHERE rn <= q ORDER BY md5(sample_id || ':3'), sample_id LIMIT 64""",
)
def balanced_sample_of_types(spark, sf_dir):
    return S.balanced_sample(samples(spark, sf_dir), "label", "sample_id", 64, 3).select("sample_id", "label")


NOUN_WORDS = {"fixed_wing": ["ring", "bolt"], "hybrid": ["gear"], "multirotor": ["widget", "gizmo"]}
CATEGORY_SQL = """CASE WHEN regexp_matches(lower(p_name), 'ring|bolt') THEN 'fixed_wing' WHEN regexp_matches(lower(p_name), 'gear') THEN 'hybrid'
 WHEN regexp_matches(lower(p_name), 'widget|gizmo') THEN 'multirotor' ELSE 'unknown' END"""


def part_types(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.groupBy(F.col("p_name").alias("type")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "category", L.categorize("type", NOUN_WORDS)
    )


ALLOC_SQL = f"""t AS (SELECT p_name AS type, {CATEGORY_SQL} AS category, count(*) AS n FROM part GROUP BY p_name),
e AS (SELECT * FROM t WHERE n >= 5), c AS (SELECT category, count(*) AS size FROM e GROUP BY category),
g AS (SELECT *, sum(size) OVER () AS total, least(7, sum(size) OVER ()) AS goal FROM c),
f AS (SELECT *, least(size, greatest(1, CAST(round_even(CAST(size AS DOUBLE) / total * goal, 0) AS BIGINT))) AS first FROM g),
d AS (SELECT *, goal - sum(first) OVER () AS left_over FROM f),
a AS (SELECT *, row_number() OVER (PARTITION BY first < size ORDER BY size DESC, category) AS grow,
  row_number() OVER (PARTITION BY first > 1 ORDER BY first DESC, category) AS shrink FROM d),
alloc AS (SELECT category, size, first + CASE WHEN left_over > 0 AND first < size AND grow <= left_over THEN 1
  WHEN left_over < 0 AND first > 1 AND shrink <= -left_over THEN -1 ELSE 0 END AS n_holdout FROM a)"""


@query("D5 C3", f"WITH {ALLOC_SQL} SELECT category, size, CAST(n_holdout AS BIGINT) AS n_holdout FROM alloc")
def holdout_allocation(spark, sf_dir):
    return S.allocate_holdout(part_types(spark, sf_dir), 7, 5).select("category", "size", F.col("n_holdout").cast("long").alias("n_holdout"))


@query(
    "D5",
    f"""WITH {ALLOC_SQL}, rk AS (SELECT t.*, row_number() OVER (PARTITION BY category, n >= 5 ORDER BY md5(type || ':42'), type) AS rn FROM t)
SELECT type, rk.category, n, CASE WHEN n >= 5 AND rn <= coalesce(n_holdout, 0) THEN 'holdout' ELSE 'train' END AS split
FROM rk LEFT JOIN alloc USING (category)""",
)
def select_holdout_types(spark, sf_dir):
    return S.select_holdout(part_types(spark, sf_dir), 7, 5, 42).select("type", "category", "n", "split")


@query(
    "D6 A8",
    f"WITH {SAMPLES_CTE} SELECT label, CASE WHEN label IN (2, 5) THEN 'holdout' ELSE split END AS split, count(*) AS n FROM samples GROUP BY ALL",
)
def apply_split_version(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumnRenamed("split", "source_split")
    moved = rows.where("label IN (2, 5)").select("label").distinct().withColumn("split", F.lit("holdout"))
    versions = rows.limit(0).select("label", F.col("source_split").alias("split"), F.lit("v0").alias("split_version"))
    versions = S.add_split_version(versions, moved, "v1")
    out = S.apply_split(rows, versions.where("split_version = 'v1'").drop("split_version"), "label", "source_split")
    return out.groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))


@query(
    "D7",
    f"""WITH {SAMPLES_CTE}, k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(sample_id || ':11'), sample_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM samples)
SELECT sample_id, label, CASE WHEN rn <= greatest(3, n // 2) THEN 'enroll' ELSE 'test' END AS half FROM k""",
)
def enroll_test_halves(spark, sf_dir):
    return S.enroll_test_split(samples(spark, sf_dir), "label", "sample_id", 11).select("sample_id", "label", "half")


@query(
    "D8",
    f"""SELECT CASE WHEN {md5i('o_custkey', 4)} % 10000 < 8000 THEN 'train' ELSE 'test' END AS side, count(*) AS n, count(DISTINCT o_custkey) AS groups, CAST(0 AS BIGINT) AS leaked FROM orders GROUP BY 1""",
)
def group_split_without_leak(spark, sf_dir):
    rows = S.group_split(table(spark, sf_dir, "orders").select("o_custkey"), "o_custkey", 0.8, 4)
    leaked = S.leaked_groups(rows, "o_custkey").agg(F.count(F.lit(1)))
    return rows.groupBy("side").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("groups")
    ).withColumn("leaked", leaked.scalar())


@query(
    "D9",
    f"WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality) SELECT quality, n, {R('CASE WHEN n = min(n) OVER () THEN CAST(max(n) OVER () AS DOUBLE) / min(n) OVER () ELSE 1 END')} AS weight FROM c",
)
def balance_weights_of_labels(spark, sf_dir):
    return S.balance_weights(table(spark, sf_dir, "labels"), "quality").select("quality", "n", r("weight").alias("weight"))


@query(
    "D9",
    f"""WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality),
  w AS (SELECT quality, CASE WHEN n = min(n) OVER () THEN CAST(max(n) OVER () AS DOUBLE) / min(n) OVER () ELSE 1.0 END AS lam FROM c),
  cdf AS (SELECT quality, sum(exp(k * ln(lam) - lam - lgamma(k + 1))) OVER (PARTITION BY quality ORDER BY k) AS p FROM w, range(0, 400) AS t(k)),
  u AS (SELECT doc_id, quality, ({md5i('doc_id', 8)} + 0.5) / 4294967296.0 AS u FROM labels)
SELECT quality, count(*) AS n FROM u JOIN cdf USING (quality) WHERE p < u GROUP BY quality""",
)
def weighted_resample_of_labels(spark, sf_dir):
    """Minority labels oversampled to parity: a row's copies are the Poisson count at its own hash."""
    rows = table(spark, sf_dir, "labels")
    weights = S.balance_weights(rows, "quality").select(F.col("quality").alias("_q"), "weight")
    weighted = rows.join(F.broadcast(weights), F.col("quality") == F.col("_q")).drop("_q")  # one row per class
    return S.weighted_resample(weighted, "doc_id", "weight", 8).groupBy("quality").agg(F.count(F.lit(1)).alias("n"))


@query(
    "D10",
    f"WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY toxic) SELECT toxic, n, {R('CAST(sum(n) OVER () AS DOUBLE) / (n * count(*) OVER ())')} AS weight FROM c",
)
def class_weights_of_labels(spark, sf_dir):
    return S.class_weights(table(spark, sf_dir, "labels"), "toxic").select("toxic", "n", r("weight").alias("weight"))


@query(
    "D11",
    f"""WITH {SAMPLES_CTE}, k AS (SELECT sample_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(sample_id || ':21'), sample_id) AS rn,
  count(*) OVER (PARTITION BY label) AS n, {md5i('sample_id', 22)} AS h FROM samples),
w AS (SELECT *, (rn - 1 + CASE WHEN n > 1 THEN 1 + h % greatest(n - 1, 1) ELSE 0 END) % n + 1 AS want FROM k)
SELECT w.sample_id, w.label, p.sample_id AS partner_id FROM w JOIN k p ON p.label = w.label AND p.rn = w.want""",
)
def positive_pairs_of_types(spark, sf_dir):
    return S.positive_pairs(samples(spark, sf_dir), "label", "sample_id", 21).select("sample_id", "label", "partner_id")


@query(
    "D13",
    f"""WITH {SAMPLES_CTE}, k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(sample_id || ':13'), sample_id) AS rn FROM samples)
SELECT CAST((rn - 1) % 3 AS BIGINT) AS fold, label, count(*) AS n FROM k GROUP BY ALL""",
)
def stratified_folds(spark, sf_dir):
    rows = S.kfold(samples(spark, sf_dir), "sample_id", 3, 13, stratify="label")
    return rows.groupBy(F.col("fold").cast("long").alias("fold"), "label").agg(F.count(F.lit(1)).alias("n"))
