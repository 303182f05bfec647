"""The registered corpus queries: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.llm import (
    centroid_clustering, chat_format, decontamination, exact_dedup, hard_negatives, html_extraction, jaccard_join, language_id, packing, sharding, simhash,
    suffix_dedup, url_filters,
)
from spectraloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


@query("""
WITH bytes AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS b FROM documents),
crc AS (
  SELECT list(list_reduce(list_prepend(n, range(0, 8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY n) AS t
  FROM range(0, 256) AS r(n)),
rows AS (
  SELECT doc_id, CAST(size AS BIGINT) AS size,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS text_crc32,
         coalesce(sum(size) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER () AS total
  FROM bytes, crc),
placed AS (
  SELECT *, CAST(least(39, ((2 * before + size) * 40) // (2 * total)) AS INTEGER) AS shard FROM rows)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM placed""")
def op5_prefix_sum_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty contiguous shards of near-equal bytes over all documents."""
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, regexp_replace(coalesce(text, ''), '<\\|(_*)im_', '<|_\\1im_', 'g') AS text FROM conversations),
t AS (SELECT *, CAST((row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1) // 256 AS BIGINT) AS piece FROM r),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t),
v AS (
  SELECT t.*, s.speaker, CASE WHEN role = speaker THEN '<|im_start|>assistant' || chr(10) ELSE '<|im_start|>user name=' || replace(regexp_replace(role, '<\\|(_*)im_', '<|_\\1im_', 'g'), chr(10), ' ') || chr(10) END AS head,
         '<|im_end|>' || chr(10) AS tail
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
p AS (
  SELECT *, sum(length(head) + length(text) + length(tail)) OVER (
    PARTITION BY conv_id, speaker, piece ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop FROM v)
SELECT conv_id, speaker, piece, count(*) AS n_turns, string_agg(head || text || tail, '' ORDER BY turn NULLS FIRST, role, text) AS text,
       coalesce(string_agg(CASE WHEN role = speaker THEN (stop - length(text) - length(tail)) || '-' || stop END, ',' ORDER BY turn NULLS FIRST, role, text), '') AS mask,
       CAST(coalesce(sum(CASE WHEN role = speaker THEN length(text) + length(tail) END), 0) AS BIGINT) AS n_masked
FROM p GROUP BY conv_id, speaker, piece""")
def op6_perspective_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every participant's view of every conversation, with the character ranges to learn."""
    views = chat_format.perspectives(table(spark, sf_dir, "conversations"))
    spans = F.transform("mask", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))
    return views.withColumn("mask", F.array_join(spans, ","))


@query("""
WITH d AS (SELECT doc_id, coalesce(text, '') AS raw, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents),
g AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(raw) DESC, doc_id) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g""")
def op7_streaming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all documents."""
    groups = exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


#: Fixed rules: verdict, host, path.
URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


@query()
def op8_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's URL."""
    return url_filters.judge(table(spark, sf_dir, "pages"), url_filters.fit(spark), URL_RULES)


@query()
def op2_gray_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_code(F.col("code")).alias("fingerprint"), "component_id")


@query()
def op3_conflict_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 8,192 bytes."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query()
def op4_viterbi_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs)
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "language.lang_pred", "language.score", "language.n_spans")


@query()
def op10_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages."""
    found = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.lit(True).alias("contaminated"), "n_items", F.array_join("item_ids", ",").alias("item_ids"), "edits")


@query()
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without byte strings of 200 that also start elsewhere."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=200)


@query()
def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    weights = html_extraction.fit(html_extraction.labelled_pages())
    return html_extraction.main_text(table(spark, sf_dir, "pages"), weights)


@query()
def op11_tiled_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose four-word shingle sets have a similarity of at least 0.85."""
    return jaccard_join.join_components(table(spark, sf_dir, "documents"), words=4, percent=85)


def _round(n: int, k: int = 40) -> str:
    """Check SQL of one assignment and of the centroids after it."""
    return f"""
a{n} AS MATERIALIZED (
  SELECT vec_id, arg_min(c, struct_pack(d := d, c := c)) AS c, min(d) AS d
  FROM (SELECT v.vec_id, m.c, CAST(sum((v.x - m.x) * (v.x - m.x)) AS BIGINT) AS d FROM long v JOIN c{n} m USING (i) GROUP BY v.vec_id, m.c) GROUP BY vec_id),
c{n + 1} AS MATERIALIZED (
  SELECT m.c, m.i, coalesce(s.x, m.x) AS x FROM c{n} m LEFT JOIN (
    SELECT a.c, v.i, CAST((sum(v.x) - ((sum(v.x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x FROM long v JOIN a{n} a USING (vec_id) GROUP BY a.c, v.i) s
  ON m.c = s.c AND m.i = s.i)"""


@query(f"""
WITH kept AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
long AS MATERIALIZED (
  SELECT vec_id, unnest(range(0, 64)) AS i, unnest(list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))) AS x FROM kept),
c0 AS MATERIALIZED (
  SELECT s.c, v.i, v.x FROM long v JOIN (
    SELECT vec_id, CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS INTEGER) AS c FROM kept QUALIFY c < 40) s USING (vec_id)),
{','.join(_round(n) for n in range(6))},
shas AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS sha FROM c5 GROUP BY c)
SELECT vec_id, c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha AS centroid_sha256
FROM a5 JOIN shas USING (c)""")
def op12_rotated_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty centroids over all vectors after five rounds."""
    return centroid_clustering.cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5, salt=2)


@query("""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda t: t[1] * t[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 80 * p.score <= 100 * s.score AND s.score <= p.score
QUALIFY rank <= 5""")
def op13_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector against all vectors."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), label, F.col("vec_id") % 100 == 0, positives=5, negatives=5, least_percent=80)
