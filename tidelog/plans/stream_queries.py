"""Streaming twins of batch queries; all of them share their batch twin's oracle or one known by construction."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.codec import canonical_json, decode, encode_ack, encode_message, record_size
from tidelog.operators.folds import Delivery, GroupSync, Rotation, SeenSet
from tidelog.operators.relay import relay_batch
from tidelog.plans import log_queries, policy_queries
from tidelog.plans.log_queries import LIMITS
from tidelog.plans.message_queries import wire_texts
from tidelog.plans.policy_queries import GROUP, HOUR
from tidelog.session import save, shared_dir
from tidelog.streaming.runs import dedup_within_watermark, fold_to_table, run_each_batch, run_to_table, stream_table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stream_table(spark, sf_dir, "events")
    message_id, topic = F.concat(F.lit("evt-"), F.col("event_id")), F.concat(F.lit("events/"), F.col("event_type"))
    rows = e.select(F.col("user_id").alias("sender_id"), F.col("event_id").alias("seq"), message_id.alias("message_id"), topic.alias("topic"), "event_type", F.col("ts").cast("timestamp").alias("ts"), canonical_json(F.col("props")).alias("payload_json"))
    return rows.withColumn("at", F.unix_micros("ts")).withColumn("frame_size", record_size(encode_message(F.col("message_id"), F.col("topic"), F.col("payload_json"))))


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sender and topic, as repeats within the watermark of the whole month."""
    rows = _events(spark, sf_dir).select(F.concat_ws("/", "topic", "sender_id").alias("message_id"), "ts")
    return run_to_table(dedup_within_watermark(rows, "ts", "60 days").select("message_id"), "stream-dedup")


def stream_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("sender_id", "seq", "frame_size")
    make = lambda: Rotation(LIMITS.segment_max_records, LIMITS.segment_max_bytes)
    return fold_to_table(rows, ["sender_id"], ["seq"], make, ["sender_id", "seq", "segment_id", "start_offset", "end_offset"], "stream-segments")


def stream_group_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("sender_id", "seq", "at", "frame_size")
    return fold_to_table(rows, ["sender_id"], ["seq"], lambda: GroupSync(GROUP), ["sender_id", "seq", "syncs", "unsynced"], "stream-sync")


def stream_lru_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("topic", "seq", F.col("sender_id").alias("message_id"))
    return fold_to_table(rows, ["topic"], ["seq"], lambda: SeenSet(20), ["topic", "seq", "seen"], "stream-lru")


def stream_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delivery machine over micro-batches; equal to its batch twin in the tests."""
    kind = F.when(F.col("event_type").isin("error", "signup"), "ack").otherwise("publish")
    rows = _events(spark, sf_dir).select("sender_id", "seq", "at", kind.alias("kind"), F.concat(F.lit("m-"), F.floor(F.col("seq") / 500) % 3).alias("message_id"))
    make = lambda: Delivery(8 * HOUR * 1_000_000, 2 * HOUR * 1_000_000)
    return fold_to_table(rows, ["sender_id"], ["seq"], make, ["sender_id", "seq", "status", "attempts", "pending"], "stream-delivery")


def stream_pending_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running counts per sender; the last of each batch's updates counts."""
    counts = _events(spark, sf_dir).groupBy("sender_id").agg(F.count(F.lit(1)).alias("pending"))
    base = f"{shared_dir(spark)}/stream-counts-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(base)

    query = counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("sender_id long, pending long, batch_id int").parquet(base).groupBy("sender_id").agg(F.max_by("pending", "batch_id").alias("pending"))


def stream_relay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged and good wire texts forwarded batch by batch; a tenth of the publications is not confirmed."""
    base = f"{shared_dir(spark)}/relay-{uuid.uuid4().hex}"
    wire = save(wire_texts(spark, sf_dir).select("value"), "wire")
    stream = spark.readStream.schema(wire.schema).parquet(wire._tidelog_path)

    def publish(deliveries: DataFrame) -> DataFrame:
        out = deliveries.withColumn("confirmed", ~F.col("message_id").endswith("70"))
        out.write.mode("append").parquet(f"{base}/destination")
        return out

    def acknowledge(rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{base}/acks")

    run_each_batch(stream, relay_batch(publish, acknowledge), "relay-state")
    sent = spark.read.schema("topic string, message_id string, encoded string, confirmed boolean").parquet(f"{base}/destination")
    acked = spark.read.schema("message_id string, encoded string").parquet(f"{base}/acks").groupBy("message_id").agg(F.count(F.lit(1)).alias("acks"))
    return sent.groupBy("message_id").agg(F.count(F.lit(1)).alias("deliveries")).join(acked, "message_id", "left").select("message_id", "deliveries", F.coalesce("acks", F.lit(0)).alias("acks"))


def stream_ack_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wire acknowledgements of every third message as a stream of their own, decoded and joined with the messages they answer in time."""
    sent = _events(spark, sf_dir).select("message_id", "seq", "ts").withWatermark("ts", "60 days")
    e = stream_table(spark, sf_dir, "events").where("event_id % 3 = 0")
    wire = e.select(encode_ack(F.concat(F.lit("evt-"), F.col("event_id"))).alias("value"), (F.col("ts").cast("timestamp") + F.expr("make_interval(0, 0, 0, 0, event_id % 4)")).alias("acked"))
    acks = wire.select(decode(F.col("value"), "ack").alias("d"), "acked").where("d.ok").select(F.col("d.message_id").alias("ack_id"), "acked").withWatermark("acked", "60 days")
    in_time = (F.col("message_id") == F.col("ack_id")) & (F.col("acked") >= F.col("ts")) & (F.col("acked") < F.col("ts") + F.expr("INTERVAL 2 HOURS"))
    return run_to_table(sent.join(acks, in_time).select("seq", "message_id"), "stream-acks")


QUERIES = {
    "stream_dedup": (stream_dedup, "SELECT DISTINCT 'events/' || event_type || '/' || user_id AS message_id FROM events"),
    "stream_segment_assign": (stream_segments, log_queries.QUERIES["ref_segment_assign"][1]),
    "stream_group_sync": (stream_group_sync, policy_queries.QUERIES["ref_group_sync_full"][1]),
    "stream_lru_dedup": (stream_lru_dedup, policy_queries.QUERIES["ref_lru_dedup"][1]),
    "stream_pending_count": (stream_pending_count, "SELECT user_id AS sender_id, count(*) AS pending FROM events GROUP BY 1"),
    "stream_ack_join": (stream_ack_join, "SELECT event_id AS seq, 'evt-' || event_id AS message_id FROM events WHERE event_id % 3 = 0 AND event_id % 4 < 2"),
    "stream_delivery": (stream_delivery, None),
    "stream_relay": (
        stream_relay,
        "SELECT 'evt-' || event_id AS message_id, CAST(1 AS BIGINT) AS deliveries, CAST(CASE WHEN event_id % 100 = 70 THEN 0 ELSE 1 END AS BIGINT) AS acks FROM events WHERE event_id % 10 IN (0, 9)",
    ),
}
