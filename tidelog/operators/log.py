"""The append-only log as tables: idempotent append, segments and offsets, cursors, replay, retention, checks.

A log row has ``sender_id``, ``seq``, ``message_id`` and ``encoded`` (canonical text), and once
placed ``segment_id``, ``start_offset`` and ``end_offset``. A cursor table has one row per sender
(``sender_id``, ``segment_id``, ``byte_offset``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.config import LogLimits
from tidelog.functions.codec import record_size
from tidelog.operators.folds import SEGMENT_HEADER, Rotation, ordered_fold


def dedup_batch(batch: DataFrame, order: str = "seq") -> DataFrame:
    """One row per message id, the first by ``order``, and ``conflict`` if another has other bytes."""
    first = F.min_by(F.struct(*(c for c in batch.columns if c != "message_id")), order)
    differs = F.min("encoded") != F.max("encoded")
    return batch.groupBy("message_id").agg(first.alias("r"), differs.alias("conflict"), F.count(F.lit(1)).alias("copies")).select("message_id", "r.*", "conflict", "copies")


def append_verdicts(pending: DataFrame, batch: DataFrame, on_conflict: str = "error") -> DataFrame:
    """``batch`` with ``verdict``: new, noop (same id and bytes pending) or conflict.

    With ``on_conflict`` ignore, other bytes under a pending id are a noop too.
    """
    if on_conflict not in ("error", "ignore"):
        raise ValueError("on_conflict must be error or ignore")
    known = pending.select("message_id", F.col("encoded").alias("_known"))
    same = (F.col("_known") == F.col("encoded")) if on_conflict == "error" else F.lit(True)
    verdict = F.when(F.col("_known").isNull(), "new").when(same, "noop").otherwise("conflict")
    return batch.join(known, "message_id", "left").withColumn("verdict", verdict).drop("_known")


def assign_segments(log: DataFrame, limits: LogLimits = LogLimits()) -> DataFrame:
    """Rows with ``frame_size`` and their segment and offsets, by greedy rotation per sender."""
    sized = log if "frame_size" in log.columns else log.withColumn("frame_size", record_size(F.col("encoded")))
    return ordered_fold(sized, ["sender_id"], ["seq"], lambda: Rotation(limits.segment_max_records, limits.segment_max_bytes))


def segment_stats(placed: DataFrame) -> DataFrame:
    """Records, bytes and first and last seq of each segment."""
    return placed.groupBy("sender_id", "segment_id").agg(F.count(F.lit(1)).alias("record_count"), F.max("end_offset").alias("byte_size"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def offsets_within(log: DataFrame, segment: str = "segment_id") -> DataFrame:
    """Start offset of each row where the segment of every row is known already."""
    before = Window.partitionBy("sender_id", segment).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return log.withColumn("start_offset", SEGMENT_HEADER + F.coalesce(F.sum("frame_size").over(before), F.lit(0)))


def at_or_after(segment: Column, offset: Column, cursor_segment: Column, cursor_offset: Column) -> Column:
    """Positions compare by segment, then by offset."""
    return (segment > cursor_segment) | ((segment == cursor_segment) & (offset >= cursor_offset))


def replay(placed: DataFrame, cursors: DataFrame) -> DataFrame:
    """Rows at or after their sender's cursor; a sender without one is replayed from its start."""
    c = cursors.select("sender_id", F.col("segment_id").alias("_segment"), F.col("byte_offset").alias("_offset"))
    rows = placed.join(c, "sender_id", "left")
    return rows.where(F.col("_segment").isNull() | at_or_after(F.col("segment_id"), F.col("start_offset"), F.col("_segment"), F.col("_offset"))).drop("_segment", "_offset")


def conservative_cursors(placed: DataFrame, cursors: DataFrame) -> DataFrame:
    """Cursors that lie on a record boundary as they are; any other is set to its sender's first position."""
    edges = placed.select("sender_id", "segment_id", F.explode(F.array("start_offset", "end_offset")).alias("byte_offset")).distinct()
    good = cursors.join(edges, ["sender_id", "segment_id", "byte_offset"], "left_semi").select("sender_id", "segment_id", "byte_offset", F.lit(True).alias("valid"))
    first = placed.groupBy("sender_id").agg(F.min(F.struct("segment_id", F.col("start_offset").alias("byte_offset"))).alias("p"))
    fallback = first.join(good, "sender_id", "left_anti").select("sender_id", "p.segment_id", "p.byte_offset", F.lit(False).alias("valid"))
    return good.unionByName(fallback)


def retention(segments: DataFrame, cursors: DataFrame) -> DataFrame:
    """Segments that may go: before their sender's cursor and not the active one."""
    active = segments.groupBy("sender_id").agg(F.max("segment_id").alias("_active"))
    c = cursors.select("sender_id", F.col("segment_id").alias("_cursor"))
    rows = segments.join(active, "sender_id").join(c, "sender_id")
    return rows.where((F.col("segment_id") < F.col("_cursor")) & (F.col("segment_id") < F.col("_active"))).drop("_active", "_cursor")


def next_cursors(placed: DataFrame) -> DataFrame:
    """Each row with the cursor that its completion as the head would leave: the next record's start, else the active end."""
    w = Window.partitionBy("sender_id").orderBy("segment_id", "start_offset")
    following = F.lead(F.struct("segment_id", F.col("start_offset").alias("byte_offset"))).over(w)
    end = F.struct("segment_id", F.col("end_offset").alias("byte_offset"))
    return placed.withColumn("_n", F.coalesce(following, end)).withColumns({"next_segment": F.col("_n.segment_id"), "next_offset": F.col("_n.byte_offset")}).drop("_n")


def segment_gaps(ids: DataFrame, column: str) -> DataFrame:
    """(first_missing, last_missing) between the distinct values of an integer column.

    Neighbours are compared within buckets of 2 ** 16 values, then buckets by their least and
    largest value within buckets of buckets, and so on: a window has at most 65,536 rows at every
    level, and no task sees more of the values than one bucket.
    """
    rows = ids.where(F.col(column).isNotNull()).select(F.col(column).cast("long").alias("key")).distinct()
    rows = rows.select("key", F.col("key").alias("low"), F.col("key").alias("high"))
    gaps = []
    for level in range(5):
        bucket = F.shiftright("key", 16) if level < 4 else F.lit(0).cast("long")
        if level:
            rows = rows.groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        rows = rows.select("key", "low", "high", bucket.alias("bucket"))
        before = F.lag("high").over(Window.partitionBy("bucket").orderBy("key"))
        gaps.append(rows.withColumn("before", before).where("low > before + 1").select((F.col("before") + 1).alias("first_missing"), (F.col("low") - 1).alias("last_missing")))
        rows = rows.select(F.col("bucket").alias("key"), "low", "high")
    return reduce(DataFrame.unionByName, gaps)


def duplicate_ids(pending: DataFrame) -> DataFrame:
    """Ids that are pending more than once, which a sound log never has."""
    return pending.groupBy("message_id").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def heads(pending: DataFrame) -> DataFrame:
    """The oldest pending row of each sender."""
    return pending.groupBy("sender_id").agg(F.min_by(F.struct(*(c for c in pending.columns if c != "sender_id")), "seq").alias("r")).select("sender_id", "r.*")


def remove_head(pending: DataFrame, expected: DataFrame) -> DataFrame:
    """``expected`` (sender_id, message_id, encoded) with ``removed``: true if id and bytes are the head's."""
    h = heads(pending).select("sender_id", F.col("message_id").alias("_id"), F.col("encoded").alias("_bytes"))
    matches = (F.col("_id") == F.col("message_id")) & (F.col("_bytes") == F.col("encoded"))
    return expected.join(h, "sender_id", "left").withColumn("removed", F.coalesce(matches, F.lit(False))).drop("_id", "_bytes")


def fifo_positions(pending: DataFrame) -> DataFrame:
    return pending.withColumn("fifo_pos", F.row_number().over(Window.partitionBy("sender_id").orderBy("seq")).cast("long"))


def recovered_then_new(disk: DataFrame, memory: DataFrame) -> DataFrame:
    """Rows found on disk, then those of memory, with their place in the joint queue."""
    both = disk.withColumn("tier", F.lit(0)).unionByName(memory.withColumn("tier", F.lit(1)))
    return both.withColumn("fifo_pos", F.row_number().over(Window.partitionBy("sender_id").orderBy("tier", "seq")).cast("long"))


def verify_written(written: DataFrame, expected: DataFrame) -> DataFrame:
    """Per sender: expected rows, those found, and those found with other bytes."""
    w = written.select("message_id", F.col("encoded").alias("_bytes"))
    rows = expected.join(w, "message_id", "left")
    return rows.groupBy("sender_id").agg(F.count(F.lit(1)).alias("expected"), F.count("_bytes").alias("found"), F.count_if(F.col("_bytes") != F.col("encoded")).alias("mismatched"))
