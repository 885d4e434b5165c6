"""Queries of acknowledgements, attempts, statuses and dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.codec import decode_rows, encode_ack
from tidelog.operators import acks
from tidelog.plans.views import MESSAGES_SQL, ORDERS_SQL, encoded_messages, messages, order_deliveries, order_messages

#: Every column of a delivery, so that the order of attempts is total up to equal rows.
TOTAL = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
_TOTAL = ", ".join(TOTAL)


def pending_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that no delivery has acknowledged."""
    return acks.pending(order_messages(spark, sf_dir), order_deliveries(spark, sf_dir)).select("sender_id", "seq", "message_id")


def acked_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acks.acknowledged(order_messages(spark, sf_dir), order_deliveries(spark, sf_dir)).select("sender_id", "seq", "message_id")


def pending_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pending_anti(spark, sf_dir).groupBy("sender_id").agg(F.count(F.lit(1)).alias("pending"))


def hol_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors are never acknowledged and hold back what follows them."""
    return acks.completed_prefix(messages(spark, sf_dir), F.col("event_type") != "error")


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = order_messages(spark, sf_dir).where("seq % 20 <> 0").select("message_id", "started")
    return acks.classify_acks(attempts, order_deliveries(spark, sf_dir).withColumn("acked", F.col("l_shipdate")), F.expr("INTERVAL 60 DAYS"))


def ack_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).where("kind = 'valid'").groupBy("message_id").agg(F.count(F.lit(1)).alias("valid_acks"))


def ack_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).groupBy("l_returnflag", "kind").agg(F.count(F.lit(1)).alias("acks"))


def ack_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acknowledgements as wire texts, a seventh of them damaged; those that decode are classified against the attempts of their ids."""
    wire = order_deliveries(spark, sf_dir).select(
        F.when(F.col("l_partkey") % 7 == 0, F.concat(encode_ack(F.col("message_id")), F.lit("!"))).otherwise(encode_ack(F.col("message_id"))).alias("value"), F.col("l_shipdate").alias("acked")
    )
    decoded = decode_rows(wire, F.col("value"), "ack")
    attempts = order_messages(spark, sf_dir).where("seq % 20 <> 0").select("message_id", "started")
    sound = acks.classify_acks(attempts, decoded.where("d.ok").select("d.message_id", "acked"), F.expr("INTERVAL 60 DAYS")).select("kind")
    return sound.unionByName(decoded.where("NOT d.ok").select(F.col("d.error").alias("kind"))).groupBy("kind").agg(F.count(F.lit(1)).alias("acks"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = acks.attempt_numbers(order_deliveries(spark, sf_dir), TOTAL)
    return rows.select("message_id", "attempt", "is_last", F.col("l_linenumber").alias("line"), F.col("l_linestatus").alias("status"))


def attempt_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_deliveries(spark, sf_dir).withColumn("status", F.col("l_linestatus"))
    return acks.attempt_summary(rows, F.struct(*TOTAL))


def status_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "delivered").when(F.col("o_orderstatus") == "P", "not_ready").otherwise("retry")
    return order_messages(spark, sf_dir).groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("messages"))


def group_sync_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acks.sync_numbers(messages(spark, sf_dir), 20).groupBy("sender_id").agg(F.count(F.lit(1)).alias("messages"), F.count_distinct("sync_id").alias("syncs"))


def bounded_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages(spark, sf_dir).select(F.col("topic").alias("route"), F.floor(F.col("at") / F.lit(86_400_000_000)).alias("batch_id"), "seq")
    return acks.bounded_intake(rows, 40).select("seq", "admitted")


def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_deliveries(spark, sf_dir).select("message_id", *TOTAL)
    return acks.first_wins(rows, TOTAL).select("message_id", F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), "l_extendedprice", "copies")


def memory_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and bytes held per sender, and those of an age that a spill would take."""
    e = encoded_messages(spark, sf_dir)
    old = F.col("at") < F.lit(1_705_276_800_000_000)
    return e.groupBy("sender_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("frame_size").alias("bytes"), F.count_if(old).alias("eligible"))


def next_deadline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest of an age deadline, one while disconnected and a retry's, where they are set."""
    m = messages(spark, sf_dir)
    age = F.col("at") + 5_000_000
    disconnected = F.when(F.col("event_type") == "error", F.col("at") + 3_000_000)
    retry = F.when(F.col("seq") % 7 == 0, F.col("at") + 1_000_000)
    return m.select("message_id", acks.next_deadline(age, disconnected, retry).alias("deadline"))


QUERIES = {
    "ref_pending_anti": (pending_anti, f"WITH {ORDERS_SQL} SELECT sender_id, seq, message_id FROM om WHERE message_id NOT IN (SELECT message_id FROM od)"),
    "ref_acked_semi": (acked_semi, f"WITH {ORDERS_SQL} SELECT sender_id, seq, message_id FROM om WHERE message_id IN (SELECT message_id FROM od)"),
    "ref_pending_count": (pending_count, f"WITH {ORDERS_SQL} SELECT sender_id, count(*) AS pending FROM om WHERE message_id NOT IN (SELECT message_id FROM od) GROUP BY 1"),
    "ref_hol_prefix": (
        hol_prefix,
        """SELECT sender_id, count(*) AS rows, count(*) FILTER (first IS NULL OR seq < first) AS completed, min(first) AS blocked_by, count(*) FILTER (seq >= first AND event_type <> 'error') AS held
        FROM (SELECT user_id AS sender_id, event_id AS seq, event_type, min(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id) AS first FROM events) GROUP BY 1""",
    ),
    "ref_ack_interval": (ack_interval, f"WITH {ORDERS_SQL} SELECT od.message_id, count(*) AS valid_acks FROM od JOIN om USING (message_id) WHERE seq % 20 <> 0 AND l_shipdate >= started AND l_shipdate < started + INTERVAL 60 DAY GROUP BY 1"),
    "ref_ack_late": (
        ack_late,
        f"""WITH {ORDERS_SQL} SELECT l_returnflag, CASE WHEN started IS NULL THEN 'unmatched' WHEN l_shipdate < started THEN 'early' WHEN l_shipdate < started + INTERVAL 60 DAY THEN 'valid' ELSE 'late' END AS kind, count(*) AS acks
        FROM od LEFT JOIN (SELECT * FROM om WHERE seq % 20 <> 0) USING (message_id) GROUP BY 1, 2""",
    ),
    "ref_ack_intake": (
        ack_intake,
        f"""WITH {ORDERS_SQL} SELECT CASE WHEN l_partkey % 7 = 0 THEN 'not_json' WHEN started IS NULL THEN 'unmatched' WHEN l_shipdate < started THEN 'early' WHEN l_shipdate < started + INTERVAL 60 DAY THEN 'valid' ELSE 'late' END AS kind, count(*) AS acks
        FROM od LEFT JOIN (SELECT * FROM om WHERE seq % 20 <> 0) USING (message_id) GROUP BY 1""",
    ),
    "ref_attempts": (attempts, f"WITH {ORDERS_SQL} SELECT message_id, row_number() OVER w AS attempt, lead(true) OVER w IS NULL AS is_last, l_linenumber AS line, l_linestatus AS status FROM od WINDOW w AS (PARTITION BY message_id ORDER BY {_TOTAL})"),
    "ref_attempt_summary": (attempt_summary, f"WITH {ORDERS_SQL} SELECT message_id, count(*) AS attempts, count(*) - 1 AS duplicates, arg_max(l_linestatus, ({_TOTAL})) AS last_status FROM od GROUP BY 1"),
    "ref_status_mix": (status_mix, "SELECT CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'P' THEN 'not_ready' ELSE 'retry' END AS status, count(*) AS messages FROM orders GROUP BY 1"),
    "ref_group_sync_count": (group_sync_count, "SELECT user_id AS sender_id, count(*) AS messages, CAST(ceil(count(*) / 20) AS BIGINT) AS syncs FROM events GROUP BY 1"),
    "ref_bounded_queue": (bounded_queue, "SELECT event_id AS seq, row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY event_id) <= 40 AS admitted FROM events"),
    "ref_dedup_first_wins": (
        dedup_first_wins,
        f"WITH {ORDERS_SQL} SELECT message_id, l_linenumber AS line, l_partkey AS part, l_extendedprice, count(*) OVER (PARTITION BY message_id) AS copies FROM od QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY {_TOTAL}) = 1",
    ),
    "ref_memory_bytes": (memory_bytes, f"WITH {MESSAGES_SQL} SELECT sender_id, count(*) AS rows, CAST(sum(frame_size) AS BIGINT) AS bytes, count(*) FILTER (tick < 1705276800000000) AS eligible FROM e GROUP BY 1"),
    "ref_next_deadline": (
        next_deadline,
        f"WITH {MESSAGES_SQL} SELECT message_id, least(tick + 5000000, CASE WHEN event_type = 'error' THEN tick + 3000000 END, CASE WHEN seq % 7 = 0 THEN tick + 1000000 END) AS deadline FROM m",
    ),
}
