"""The message log, deliveries and attempts as views of the input tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.codec import encode_message, record_size, with_canonical


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages: sender_id, seq, message_id, topic, payload_json (as it came), event_type, at (microseconds)."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("sender_id"), F.col("event_id").alias("seq"), F.concat(F.lit("evt-"), F.col("event_id")).alias("message_id"),
        F.concat(F.lit("events/"), F.col("event_type")).alias("topic"), F.col("props").alias("payload_json"), "event_type",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
    )


def encoded_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with a canonical payload, their canonical text and its size in the log."""
    m = with_canonical(messages(spark, sf_dir), "payload_json")
    e = m.withColumn("encoded", encode_message(F.col("message_id"), F.col("topic"), F.col("payload_json")))
    return e.withColumn("frame_size", record_size(F.col("encoded")))


MESSAGES_SQL = """m AS (
  SELECT user_id AS sender_id, event_id AS seq, 'evt-' || event_id AS message_id, 'events/' || event_type AS topic,
         CAST(json(props) AS VARCHAR) AS payload_json, event_type, epoch_us(ts) AS tick FROM events),
e AS (
  SELECT *, CAST(strlen(encoded) + 12 AS BIGINT) AS frame_size FROM (
    SELECT *, '{"event_id":"' || message_id || '","payload":' || payload_json || ',"topic":"' || topic || '","version":1}' AS encoded FROM m)),
o AS (SELECT *, row_number() OVER (PARTITION BY sender_id ORDER BY seq) AS rn FROM e)"""


def order_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as messages of their customer."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("sender_id"), F.col("o_orderkey").alias("seq"), F.concat(F.lit("ord-"), F.col("o_orderkey")).alias("message_id"), F.col("o_orderdate").alias("started"), "o_orderstatus")


def order_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as deliveries of their order, several per order and not unique."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.withColumn("message_id", F.concat(F.lit("ord-"), F.col("l_orderkey")))


ORDERS_SQL = """om AS (SELECT o_custkey AS sender_id, o_orderkey AS seq, 'ord-' || o_orderkey AS message_id, o_orderdate AS started, o_orderstatus FROM orders),
od AS (SELECT 'ord-' || l_orderkey AS message_id, * FROM lineitem)"""
