"""Intake of new messages: an id for those without one, validation, and the canonical text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.codec import encode_message, with_canonical
from tidelog.functions.validity import valid_id, valid_topic


def assigned_id(message_id: Column, *identity: Column) -> Column:
    """The id, or for null one made of a hash of ``identity``, so that a retried task assigns the same."""
    return F.coalesce(message_id, F.concat(F.lit("gen-"), F.md5(F.encode(F.concat_ws("/", *identity), "UTF-8"))))


def intake(rows: DataFrame, identity: list[str]) -> DataFrame:
    """Rows (message_id, topic, payload_json and any more) with ``error`` (id, topic, payload or null) and ``encoded`` (null with an error)."""
    named = rows.withColumn("message_id", assigned_id(F.col("message_id"), *map(F.col, identity)))
    error = F.when(~valid_id(F.col("message_id")), "id").when(~valid_topic(F.col("topic")), "topic").when(F.col("payload_json").isNull(), "payload")
    judged = with_canonical(named, "payload_json").withColumn("error", error)
    return judged.withColumn("encoded", F.when(F.col("error").isNull(), encode_message(F.col("message_id"), F.col("topic"), F.col("payload_json"))))
