"""Acknowledgements: correlation, head-of-line completion, attempts and statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pending(log: DataFrame, acks: DataFrame) -> DataFrame:
    """Rows without an acknowledgement of their id."""
    return log.join(acks.select("message_id"), "message_id", "left_anti")


def acknowledged(log: DataFrame, acks: DataFrame) -> DataFrame:
    return log.join(acks.select("message_id"), "message_id", "left_semi")


def completed_prefix(log: DataFrame, done: Column) -> DataFrame:
    """Per sender the rows that are complete: all before the first that is not ``done``.

    Returns sender_id, rows, completed, blocked_by (seq of the first that is not done, or null)
    and held (rows that are done but behind it). Two aggregations and a join on the sender; rows
    are neither sorted nor gathered, so a sender of any size is added up where its rows lie.
    """
    flagged = log.select("sender_id", "seq", done.alias("_done"))
    first = flagged.groupBy(F.col("sender_id").alias("_sender")).agg(F.min(F.when(~F.col("_done"), F.col("seq"))).alias("_first"))
    rows = flagged.join(first, F.col("sender_id").eqNullSafe(F.col("_sender")))
    before = F.col("_first").isNull() | (F.col("seq") < F.col("_first"))
    return rows.groupBy("sender_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(before).alias("completed"), F.min("_first").alias("blocked_by"), F.count_if(~before & F.col("_done")).alias("held"))


def classify_acks(attempts: DataFrame, acks: DataFrame, timeout: Column) -> DataFrame:
    """Each acknowledgement as valid, early, late or unmatched for the attempt of its id.

    ``attempts`` has one row per id (message_id, started), ``acks`` (message_id, acked and any more).
    """
    rows = acks.join(attempts, "message_id", "left")
    kind = (
        F.when(F.col("started").isNull(), "unmatched")
        .when(F.col("acked") < F.col("started"), "early")
        .when(F.col("acked") < F.col("started") + timeout, "valid")
        .otherwise("late")
    )
    return rows.withColumn("kind", kind)


def attempt_numbers(attempts: DataFrame, order: list[str]) -> DataFrame:
    """Each attempt with its number per message and whether it is the last."""
    w = Window.partitionBy("message_id").orderBy(*order)
    return attempts.withColumn("attempt", F.row_number().over(w).cast("long")).withColumn("is_last", F.lead(F.lit(True)).over(w).isNull())


def attempt_summary(attempts: DataFrame, order: Column) -> DataFrame:
    """Attempts, duplicates and last status of each message."""
    return attempts.groupBy("message_id").agg(F.count(F.lit(1)).alias("attempts"), (F.count(F.lit(1)) - 1).alias("duplicates"), F.max_by("status", order).alias("last_status"))


def sync_numbers(log: DataFrame, every: int) -> DataFrame:
    """Sync points of a count trigger alone: row n of a sender is synced by point ceil(n / every)."""
    n = F.row_number().over(Window.partitionBy("sender_id").orderBy("seq"))
    return log.withColumn("sync_id", F.ceil(n / F.lit(every)).cast("long"))


def bounded_intake(batch: DataFrame, limit: int) -> DataFrame:
    """Rows of each (route, batch) beyond ``limit`` by seq are dropped unacknowledged: ``admitted`` is false."""
    n = F.row_number().over(Window.partitionBy("route", "batch_id").orderBy("seq"))
    return batch.withColumn("admitted", n <= limit)


def first_wins(deliveries: DataFrame, order: list[str]) -> DataFrame:
    """One row per message id, the least by ``order``, and how many there were; partial before the shuffle."""
    rank = F.struct(*order)
    rest = F.struct(*order, *(c for c in deliveries.columns if c not in ("message_id", *order)))
    return deliveries.groupBy("message_id").agg(F.min_by(rest, rank).alias("r"), F.count(F.lit(1)).alias("copies")).select("message_id", "r.*", "copies")


def window_summary(policy_rows: DataFrame) -> DataFrame:
    """At a crash behind the last row: rows of each sender that no sync or checkpoint covers.

    ``policy_rows`` are rows of a policy fold with ``open`` (rows not covered after the row).
    """
    return policy_rows.groupBy("sender_id").agg(F.count(F.lit(1)).alias("rows"), F.max_by("open", "seq").alias("open"))


def next_deadline(*deadlines: Column) -> Column:
    """The earliest of the deadlines that are set; null if none is."""
    return F.least(*deadlines)
