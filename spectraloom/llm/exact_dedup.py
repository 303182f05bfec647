"""Exact de-duplication with keyed streaming state.

Every row is reduced to a digest of its normalised text, a stable identifier and a content locator (the
input file). These narrow rows are a file stream; a streaming aggregation without a watermark keeps, per
digest, the best row and the number of rows. The state lives in the RocksDB state store, so it is on disk,
is checkpointed to the shared folder, and never expires. Running the same operator again on the same
state folder with new rows continues where it stopped.

A digest hit is not trusted: every row that is not its group's keeper is compared with the keeper byte by byte,
and rows that differ are grouped by their full text instead.

Defined results. Null text counts as empty; empty texts are equal to each other. Null ids lose every tie
and stay null. Of repeated rows (same id, same text) one stays. An empty table gives an empty result. Other
columns, whatever their names, are neither read nor returned by ``duplicate_groups``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.llm.common import ASCII_SPACE, discard, fresh_dir, remove, shippable, stored, unused, whole

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    # without preallocation: each partition's store would else reserve some MB of disk whatever it holds
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(whole(text), ASCII_SPACE + "+", "")


def sha256(col: Column) -> Column:
    return F.sha2(col.cast("binary"), 256)


def _narrow(docs: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    norm = normalised(text_col)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        digest(norm).alias("digest"),
        F.char_length(whole(text_col)).cast("long").alias("n_points"),
        F.input_file_name().alias("locator"),
        F.monotonically_increasing_id().alias("row_no"),
    )


def fold_stream(rows_path: str, spark, state_dir: str) -> DataFrame:
    """Feed new files under ``rows_path`` to the keyed state; one row per digest seen so far.

    Columns: digest, group_size, best (n_points, inverted id, inverted row number, locator).
    """
    best = F.max(F.struct("n_points", F.bitwise_not("doc_id").alias("inv_id"), F.bitwise_not("row_no").alias("inv_row"), "locator"))
    schema = "doc_id long, digest string, n_points long, locator string, row_no long"
    groups = (
        spark.readStream.schema(schema).parquet(rows_path)
        .groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))
    )
    changed = f"{state_dir}/changed"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{changed}/batch={batch_id}")

    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        run = (
            groups.writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", f"{state_dir}/checkpoint").trigger(availableNow=True).start()
        )
        run.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = "digest string, group_size long, best struct<n_points:long,inv_id:long,inv_row:long,locator:string>, batch int"
    seen = spark.read.schema(out).option("basePath", changed).parquet(f"{changed}/batch=*")
    latest = F.max(F.struct("batch", "group_size", "best")).alias("s")
    return seen.groupBy("digest").agg(latest).select("digest", "s.group_size", "s.best")


def duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256, state_dir: str | None = None
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest, keep_file, row_no.

    The row with the most code points in the original text stays, then the smallest id.
    """
    spark = docs.sparkSession
    state_dir = state_dir or fresh_dir(spark, "dedup-state")
    rows_path = f"{state_dir}/rows"
    _narrow(docs, id_col, text_col, digest).write.mode("append").parquet(rows_path)
    rows = spark.read.parquet(rows_path)
    if rows.isEmpty():
        return _result(rows.withColumns({"group_size": F.lit(1), "keep_id": F.col("doc_id"), "keep_row": F.col("row_no"), "keep_file": F.col("locator")}))
    groups = fold_stream(rows_path, spark, state_dir).select(
        "digest", "group_size", F.bitwise_not("best.inv_id").alias("keep_id"),
        F.bitwise_not("best.inv_row").alias("keep_row"), F.col("best.locator").alias("keep_file"),
    )
    marked = stored(rows.join(groups, "digest"), "dedup-marked")
    differing = _differing(docs, marked, id_col, text_col, digest)
    if differing.isEmpty():
        return _result(marked)
    return _result(_regrouped(marked, differing))


def _differing(docs: DataFrame, marked: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    """Rows whose normalised bytes are not those of their group's keeper, with those bytes.

    Only the texts of rows that share a digest are read on; they are found by their ids before anything is shuffled.
    """
    hits = marked.where("group_size > 1").select("doc_id", "digest", "keep_id", "row_no", "keep_row")
    ids = shippable(hits.select(F.col("doc_id").alias("hit")).distinct())
    norm = normalised(text_col)
    texts = docs.join(ids, F.col(id_col).cast("long").eqNullSafe(F.col("hit")), "left_semi")
    texts = texts.select(F.col(id_col).cast("long").alias("id"), digest(norm).alias("own"), norm.alias("norm"))
    texts = texts.distinct() if _repeats(hits) else texts
    content = hits.join(texts, hits["doc_id"].eqNullSafe(texts["id"]) & (hits["digest"] == texts["own"])).drop("id", "own")
    content = stored(content, "dedup-content")
    keepers = content.where("row_no = keep_row").select(F.col("keep_row").alias("k"), F.col("norm").alias("keep_norm"))
    pairs = content.where("row_no <> keep_row").join(keepers, F.col("keep_row") == F.col("k"))
    out = stored(pairs.where(F.col("norm") != F.col("keep_norm")).select("row_no", "digest", "norm"), "dedup-differing")
    discard(content)
    return out


def _repeats(hits: DataFrame) -> bool:
    """Whether an id occurs on more than one row."""
    return not hits.groupBy("doc_id").count().where("count > 1").isEmpty()


def _regrouped(marked: DataFrame, differing: DataFrame) -> DataFrame:
    """Groups split where equal digests hide different texts: those rows go by full text."""
    apart = marked.join(differing.select("row_no", "norm").dropDuplicates(["row_no"]), "row_no", "left")
    own = Window.partitionBy("digest", "norm")
    order = own.orderBy(F.col("n_points").desc(), F.col("doc_id").asc_nulls_last(), "row_no")
    first = lambda c: F.first(c).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return apart.select(
        "doc_id", "digest", "locator", "row_no", "n_points", F.count(F.lit(1)).over(own).alias("group_size"),
        first("doc_id").alias("keep_id"), first("row_no").alias("keep_row"), first("locator").alias("keep_file"),
    )


def _result(marked: DataFrame) -> DataFrame:
    return marked.select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
        (F.col("row_no") == F.col("keep_row")).alias("kept"), "digest", "keep_file", "row_no",
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns."""
    spark = docs.sparkSession
    state_dir = fresh_dir(spark, "dedup-state")
    groups = stored(duplicate_groups(docs, id_col, text_col, state_dir=state_dir).select("doc_id", "digest", "kept"), "dedup-groups")
    remove(spark, state_dir)
    if not _repeats(groups):  # ids tell rows apart: only the ids that go are needed
        gone = groups.where("NOT kept").select(F.col("doc_id").alias(unused(docs, "gone_id")))
        return docs.join(shippable(gone), F.col(id_col).cast("long").eqNullSafe(F.col(gone.columns[0])), "left_anti")
    kept = groups.where("kept").select(F.col("doc_id").alias(unused(docs, "kept_id")), F.col("digest").alias(unused(docs, "kept_digest")))
    own, (kept_id, kept_digest) = sha256(normalised(text_col)), kept.columns
    out = docs.join(kept, (own == F.col(kept_digest)) & F.col(id_col).cast("long").eqNullSafe(F.col(kept_id)), "left_semi")
    repeats = not groups.groupBy("doc_id", "digest").count().where("count > 1").isEmpty()
    name = unused(docs, "own")
    return out.withColumn(name, own).dropDuplicates([id_col, name]).drop(name) if repeats else out
