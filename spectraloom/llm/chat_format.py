"""Multi-party chat rendering: every participant's view of a dialogue, with training masks.

For each speaker of a conversation the dialogue is rendered with that speaker as ``assistant`` and everybody else as a
named ``user``. The mask lists the character ranges (0-based start, exclusive end) that the model learns: the rotated
speaker's own turns with their closing mark. Conversations are rendered in pieces of ``turns_per_piece`` rows in order,
so a conversation of any length is many bounded rows; concatenating the pieces in order gives the whole dialogue.

Rows are numbered without a task that holds a conversation: they are range-partitioned by (conversation, turn, role, text)
and written with their range number; a window inside each range counts from 0, and what earlier ranges hold of the
conversation is added. A range goes on with at most one conversation, so those offsets are at most one row per range.

Defined results. A null text renders as empty, a null role as ``unknown``, also as a participant. Turns are ordered by turn number
(null first), then role and text; equal rows are all rendered. Null conversation ids are one conversation, null or
repeated turn numbers count like any others. Marks inside a text or a name are told apart from real ones: ``<|im_`` gets
an underscore before ``im_`` (one more if it has some, so it can be undone), a line break in a name becomes a space. Every role
has a view, ``system`` too. An empty table gives an empty result; other columns are not read. A participant silent in a
piece has an empty mask there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.llm.common import stored, whole

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def unmarked(text: Column) -> Column:
    """The text with its own marks changed, so that none can end a turn or begin one."""
    return F.regexp_replace(text, r"<\|(_*)im_", "<|_$1im_")


def _head(role: Column, speaker: Column) -> Column:
    """What stands before a turn's text."""
    named = F.concat(F.lit(OPEN + "user name="), F.translate(unmarked(role), "\n", " "), F.lit("\n"))
    return F.when(role == speaker, F.lit(OPEN + "assistant\n")).otherwise(named)


def numbered(turns: DataFrame, ranges: int | None = None) -> DataFrame:
    """conv_id, turn, role, text and ``row``, the place (from 0) in the conversation's order."""
    spark = turns.sparkSession
    ranges = ranges or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    clean = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), unmarked(whole("text")).alias("text"),
        F.monotonically_increasing_id().alias("_tie"),
    )
    ranged = clean.repartitionByRange(ranges, "conv_id", "turn", "role", "text", "_tie").withColumn("_range", F.spark_partition_id())
    fixed = stored(ranged, "chat-ranges")
    inside = Window.partitionBy("conv_id", "_range").orderBy("turn", "role", "text", "_tie")
    before = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = fixed.groupBy("conv_id", "_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = counts.select(F.col("conv_id").alias("_conv"), F.col("_range").alias("_r"), F.sum("_n").over(before).alias("_before")).where("_before > 0")
    local = fixed.withColumn("_local", F.row_number().over(inside) - 1)
    joined = local.join(F.broadcast(earlier), (F.col("_range") == F.col("_r")) & F.col("conv_id").eqNullSafe(F.col("_conv")), "left")  # one row per range
    return joined.select("conv_id", "turn", "role", "text", (F.col("_local") + F.coalesce("_before", F.lit(0))).alias("row"))


def perspectives(turns: DataFrame, turns_per_piece: int = 256, ranges: int | None = None) -> DataFrame:
    """conv_id, speaker, piece, n_turns, text, mask array<struct<start, end>>, n_masked."""
    clean = numbered(turns, ranges).withColumn("piece", F.floor(F.col("row") / turns_per_piece).cast("long"))
    pieces = clean.groupBy("conv_id", "piece").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("said"))
    speakers = clean.groupBy(F.col("conv_id").alias("_conv"), F.col("role").alias("speaker")).agg(F.count(F.lit(1)).alias("_n"))
    views = pieces.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv")))
    speaker = F.col("speaker")
    rendered = F.transform("said", lambda t: F.concat(_head(t["role"], speaker), t["text"], F.lit(CLOSE)))
    start = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["pos"] + F.char_length(_head(t["role"], speaker))
        end = begin + F.char_length(t["text"]) + len(CLOSE)
        span = F.array(F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end")))
        spans = F.when(t["role"] == speaker, F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct(end.cast("long").alias("pos"), spans.alias("spans"))

    mask = F.aggregate("said", start, step, lambda acc: acc["spans"])
    out = views.select("conv_id", "speaker", "piece", F.size("said").cast("long").alias("n_turns"), F.array_join(rendered, "").alias("text"), mask.alias("mask"))
    covered = F.aggregate("mask", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.withColumn("n_masked", covered)
