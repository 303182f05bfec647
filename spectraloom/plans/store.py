"""Store and catalogue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectraloom.plans.base import SAMPLES_CTE, R, query, r, samples, table
from spectraloom.sources import catalog as C

URL_SQL = "replace(replace(url, '/en/', '/train/'), '/fr/', '/valid/')"


@query(
    "A7",
    f"""WITH p AS (SELECT {URL_SQL} AS u FROM pages), s AS (SELECT u, string_split(u, '/') AS parts FROM p)
SELECT CASE WHEN len(parts) >= 4 THEN parts[3] ELSE '' END AS kind, CASE WHEN list_contains(parts, 'train') THEN 'train' WHEN list_contains(parts, 'valid') THEN 'valid' ELSE '' END AS split, count(*) AS n FROM s GROUP BY ALL""",
)
def type_and_split_from_paths(spark, sf_dir):
    url = F.replace(F.replace("url", F.lit("/en/"), F.lit("/train/")), F.lit("/fr/"), F.lit("/valid/"))
    kind, split = C.parse_path(url)
    return table(spark, sf_dir, "pages").groupBy(kind.alias("kind"), split.alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "A10",
    f"""WITH {SAMPLES_CTE}, h AS (SELECT split, label, count(*) AS n FROM samples WHERE sample_id < 100 GROUP BY ALL)
SELECT s.sample_id, s.split, s.label, row_number() OVER (PARTITION BY s.split, s.label ORDER BY recording_id, sample_id) - 1 + coalesce(h.n, 0) AS sample_no
FROM samples s LEFT JOIN h ON h.split = s.split AND h.label = s.label WHERE sample_id >= 100""",
)
def number_appended_samples(spark, sf_dir):
    rows = samples(spark, sf_dir).select("sample_id", "split", "label", "recording_id", F.col("sample_id").alias("segment_idx"))
    have = C.list_types(rows.where("sample_id < 100"), "split", "label")
    out = C.number_samples(rows.where("sample_id >= 100"), have, "split", "label")
    return out.select("sample_id", "split", "label", "sample_no")


@query("A11", f"WITH {SAMPLES_CTE} SELECT split, label, count(*) AS n FROM samples GROUP BY ALL")
def list_types_of_store(spark, sf_dir):
    return C.list_types(samples(spark, sf_dir), "split", "label")


@query("A11", f"WITH {SAMPLES_CTE} SELECT split, count(*) AS n FROM samples GROUP BY ALL")
def count_samples_of_store(spark, sf_dir):
    return C.count_samples(samples(spark, sf_dir))


@query("A12 I", f"WITH {SAMPLES_CTE} SELECT split, label, count(*) AS n, CAST(grouping(split) * 2 + grouping(label) AS BIGINT) AS level FROM samples GROUP BY ROLLUP (split, label)")
def store_report(spark, sf_dir):
    return C.store_stats(samples(spark, sf_dir), "split", "label")


@query("A16", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) - 1 AS sample_no, word FROM (SELECT conv_id, turn, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM (SELECT conv_id, turn, string_split(role || ' ' || text, ' ') AS w FROM conversations))")
def explode_nested_samples(spark, sf_dir):
    """Nested samples under text keys: one row each, keys compared as numbers."""
    groups = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.col("turn").cast("string").alias("key"),
        F.split(F.concat_ws(" ", "role", "text"), " ").alias("items"),
    )
    out = C.explode_samples(groups.select("conv_id", "key", "items"), "conv_id", "key", "items")
    return out.select("conv_id", F.col("key").cast("long").alias("turn"), F.col("sample_no").cast("long").alias("sample_no"), F.col("sample").alias("word"))


@query(
    "A20",
    f"""WITH m AS (SELECT l_returnflag AS run_id, avg(l_discount) AS auc, avg(l_tax) AS fpr FROM lineitem GROUP BY 1)
SELECT run_id, 'auc' AS metric, {R('auc')} AS value FROM m UNION ALL SELECT run_id, 'fpr', {R('fpr')} FROM m""",
)
def long_form_metrics(spark, sf_dir):
    wide = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("run_id")).agg(
        F.avg("l_discount").alias("auc"), F.avg("l_tax").alias("fpr")
    )
    return C.long_metrics(wide, ["run_id"]).select("run_id", "metric", r("value").alias("value"))


@query("A22", f"WITH {SAMPLES_CTE} SELECT split, array_to_string(list_sort(list(DISTINCT label)), ',') AS types, count(DISTINCT label) AS n_types FROM samples GROUP BY split")
def dataset_manifest(spark, sf_dir):
    out = C.build_manifest(samples(spark, sf_dir), "split", "label")
    return out.select("split", F.array_join(F.transform("types", lambda x: x.cast("string")), ",").alias("types"), "n_types")
