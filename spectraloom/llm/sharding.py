"""Contiguous shards of near-equal size from global prefix sums.

Narrow rows (order key, size) are range-partitioned once and written with their range number. Range totals, a table with
one row per range, give each range its offset; a window inside each range gives the rest of the global prefix
sum. A row goes to the shard in whose equal slice of the total its middle byte falls, so shards are contiguous in the
order and differ from the target by at most half a row at each end. No sort of the whole in one task, and no text is shuffled.

Defined results. Null text has size ``overhead``; null keys come first; repeated rows are separate rows in a
fixed order; an empty table gives an empty result; with fewer rows than shards, some shards stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.llm.common import stored, whole

ROWS_PER_RANGE = 500_000


def assign_shards(sized: DataFrame, order_col: str, size_col: str, shards: int, ranges: int | None = None) -> DataFrame:
    """Adds ``shard`` (0 to shards - 1, in the order of ``order_col``) and ``slot`` (0, 1, ... inside the shard)."""
    spark = sized.sparkSession
    ranges = ranges or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tied = sized.withColumn("_tie", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(ranges, F.col(order_col).asc_nulls_first(), "_tie").withColumn("_range", F.spark_partition_id())
    fixed = stored(ranged, "shard-ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = fixed.groupBy("_range").agg(F.sum(size_col).alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    offsets = totals.select(
        F.col("_range").alias("_r"),
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_byte_off"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_row_off"),
    )  # one row per range
    inside = Window.partitionBy("_range").orderBy(F.col(order_col).asc_nulls_first(), "_tie")
    up_to = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = fixed.select(
        "*", F.coalesce(F.sum(size_col).over(up_to), F.lit(0)).alias("_local"), (F.row_number().over(inside) - 1).alias("_n"),
    )
    total = fixed.agg(F.sum(size_col).alias("t")).scalar()
    middle = ((F.col("_local") + F.col("_byte_off")) * 2 + F.col(size_col)).alias("_middle")  # in half bytes
    shard = F.expr(f"CAST(LEAST({shards - 1}, CAST(_middle AS DECIMAL(38, 0)) * {shards} DIV GREATEST(_total * 2, 1)) AS INT)")
    placed = local.join(F.broadcast(offsets), F.col("_range") == F.col("_r")).select(
        *sized.columns, middle, total.alias("_total"), (F.col("_n") + F.col("_row_off")).alias("_row"),
    ).withColumn("shard", shard).drop("_middle", "_total")
    placed = stored(placed, "shard-rows")
    firsts = placed.groupBy(F.col("shard").alias("_s")).agg(F.min("_row").alias("_first"))  # one row per shard
    joined = placed.join(F.broadcast(firsts), F.col("shard") == F.col("_s"))
    return joined.select(*sized.columns, "shard", (F.col("_row") - F.col("_first")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """Documents by id in ``shards`` contiguous shards of near-equal bytes: doc_id, size, text_crc32, shard, slot."""
    text = whole(text_col)
    sized = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return assign_shards(sized, "doc_id", "size", shards)
