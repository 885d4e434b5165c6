"""Queries of encoding, decoding and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.codec import decode_rows, encode_ack, encode_delivery
from tidelog.functions.validity import missing_keys, suback_granted, valid_id, valid_topic
from tidelog.operators.intake import intake
from tidelog.operators.relay import forward
from tidelog.plans.views import MESSAGES_SQL, encoded_messages, messages, table
from tidelog.sources.segments import frame, segment_name


def encode_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = encoded_messages(spark, sf_dir)
    return e.select("sender_id", "seq", "message_id", "encoded", F.octet_length("encoded").cast("long").alias("encoded_size"), "frame_size")


def intake_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as they are handed in: a quarter without an id, some with a bad id, topic or payload."""
    m = messages(spark, sf_dir).select(
        "sender_id", "seq",
        F.when(F.col("seq") % 4 == 0, F.lit(None)).when(F.col("seq") % 10 == 3, F.concat(F.col("message_id"), F.lit(" "))).otherwise(F.col("message_id")).alias("message_id"),
        F.when(F.col("seq") % 10 == 5, F.concat("topic", F.lit("/#"))).otherwise(F.col("topic")).alias("topic"),
        F.when(F.col("seq") % 10 == 7, F.concat("payload_json", F.lit("}"))).otherwise(F.col("payload_json")).alias("payload_json"),
    )
    return intake(m, ["sender_id", "seq"]).select("seq", "message_id", "error", "encoded")


def encode_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_messages(spark, sf_dir).select("message_id", encode_delivery(F.col("message_id"), F.col("payload_json")).alias("encoded"))


def encode_acks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("message_id", encode_ack(F.col("message_id")).alias("encoded"))


def relay_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message as wire text, decoded, and projected to its destination topic."""
    wire = encoded_messages(spark, sf_dir).select(F.col("encoded").alias("value"))
    return forward(wire).deliveries


def wire_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded messages damaged in one of nine ways, or reordered, by the event's number."""
    e, text = encoded_messages(spark, sf_dir), F.col("encoded")
    ways = [
        text,
        F.regexp_replace(text, ',"topic":"[^"]*"', ""),
        F.replace(text, F.lit(',"version":1}'), F.lit(',"version":1,"ok":true}')),
        F.replace(text, F.lit('{"event_id":'), F.lit('{"event_id":"a","event_id":')),
        F.replace(text, F.lit('"version":1'), F.lit('"version":2')),
        F.replace(text, F.lit('"version":1'), F.lit('"version":true')),
        F.replace(text, F.lit('"evt-'), F.lit('"evt ')),
        F.concat(text, F.lit(" x")),
        F.regexp_replace(text, '"k":[0-9]+', '"k":NaN'),
        F.regexp_replace(text, r'^\{(.*),"version":1\}$', r'{ "version": 1, $1 }'),
    ]
    way = F.coalesce(*(F.when(F.col("seq") % 10 == i, w) for i, w in enumerate(ways)))
    return e.select("seq", way.alias("value"))


def decode_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_rows(wire_texts(spark, sf_dir), F.col("value")).select("seq", "d.*")


def decode_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries as wire bytes: sound, with a key too many, without one, not UTF-8, not JSON."""
    e = encoded_messages(spark, sf_dir).select("seq", F.encode(encode_delivery(F.col("message_id"), F.col("payload_json")), "UTF-8").alias("value"), "encoded")
    bad = [F.encode("encoded", "UTF-8"), F.lit(bytearray(b'{"event_id":"a","version":1}')), F.concat("value", F.lit(bytearray(b"\xff"))), F.concat("value", F.lit(bytearray(b"}")))]
    way = F.coalesce(*(F.when(F.col("seq") % 6 == i + 1, w) for i, w in enumerate(bad)), F.col("value"))
    return decode_rows(e.select("seq", way.alias("value")), F.col("value"), "delivery").select("seq", "d.ok", "d.message_id", "d.payload_json", "d.error")


def decode_acks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acknowledgements as wire text: sound, in another order, of a number, of version 0, of nothing."""
    m = messages(spark, sf_dir).select("seq", encode_ack(F.col("message_id")).alias("value"), "message_id")
    ways = [F.concat(F.lit('{"version": 1, "event_id": "'), "message_id", F.lit('"}')), F.concat(F.lit('{"event_id":'), F.col("seq").cast("string"), F.lit(',"version":1}')), F.replace(F.col("value"), F.lit('"version":1'), F.lit('"version":0')), F.lit("[]")]
    way = F.coalesce(*(F.when(F.col("seq") % 6 == i + 1, w) for i, w in enumerate(ways)), F.col("value"))
    return decode_rows(m.select("seq", way.alias("value")), F.col("value"), "ack").select("seq", "d.ok", "d.message_id", "d.error")


def id_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "customer").select(F.col("c_name").alias("value")).unionByName(messages(spark, sf_dir).select(F.col("message_id").alias("value")))
    return ids.select("value", valid_id(F.col("value")).alias("valid"))


def topic_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", valid_topic(F.col("url")).alias("valid"))


def key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing and extra keys of each payload against the keys k and v."""
    want = F.array(F.lit("k"), F.lit("v"))
    have = F.json_object_keys("payload_json")
    return messages(spark, sf_dir).select("message_id", missing_keys(have, want).alias("missing"), missing_keys(want, have).alias("extra"))


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.when(F.col("o_orderkey") % 13 == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.col("o_orderkey") % 4, F.floor(F.col("o_orderkey") / 4) % 3))
    return table(spark, sf_dir, "orders").select("o_orderkey", suback_granted(codes).alias("granted"))


def segment_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("seq", segment_name(F.col("seq")).alias("name"))


def record_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as they are written; SQL here has no CRC-32, so the tests compare with zlib."""
    e = encoded_messages(spark, sf_dir)
    return e.select("message_id", F.crc32(F.encode("encoded", "UTF-8")).alias("crc32"), F.hex(frame(F.col("encoded"))).alias("frame"))


QUERIES = {
    "ref_intake": (
        intake_messages,
        f"""WITH {MESSAGES_SQL}, i AS (
          SELECT seq, CASE WHEN seq % 4 = 0 THEN 'gen-' || md5(sender_id || '/' || seq) WHEN seq % 10 = 3 THEN message_id || ' ' ELSE message_id END AS message_id, topic, payload_json,
            CASE WHEN seq % 10 = 3 AND seq % 4 <> 0 THEN 'id' WHEN seq % 10 = 5 THEN 'topic' WHEN seq % 10 = 7 THEN 'payload' END AS error FROM e)
        SELECT seq, message_id, error, CASE WHEN error IS NULL THEN '{{"event_id":"' || message_id || '","payload":' || payload_json || ',"topic":"' || topic || '","version":1}}' END AS encoded FROM i""",
    ),
    "ref_encode_message": (encode_messages, f"WITH {MESSAGES_SQL} SELECT sender_id, seq, message_id, encoded, CAST(strlen(encoded) AS BIGINT) AS encoded_size, frame_size FROM e"),
    "ref_encode_delivery": (encode_deliveries, f"""WITH {MESSAGES_SQL} SELECT message_id, '{{"event_id":"' || message_id || '","payload":' || payload_json || ',"version":1}}' AS encoded FROM e"""),
    "ref_encode_ack": (encode_acks, """SELECT 'evt-' || event_id AS message_id, '{"event_id":"evt-' || event_id || '","version":1}' AS encoded FROM events"""),
    "ref_relay_project": (relay_projection, f"""WITH {MESSAGES_SQL} SELECT topic, message_id, '{{"event_id":"' || message_id || '","payload":' || payload_json || ',"version":1}}' AS encoded FROM e"""),
    "ref_decode_strict": (
        decode_strict,
        f"""WITH {MESSAGES_SQL} SELECT seq, good AS ok, CASE WHEN good THEN message_id END AS message_id, CASE WHEN good THEN topic END AS topic, CASE WHEN good THEN payload_json END AS payload_json,
        CASE seq % 10 WHEN 1 THEN 'missing_key' WHEN 2 THEN 'extra_key' WHEN 3 THEN 'duplicate_key' WHEN 4 THEN 'version' WHEN 5 THEN 'version' WHEN 6 THEN 'id' WHEN 7 THEN 'not_json' WHEN 8 THEN 'not_finite' END AS error
        FROM (SELECT *, seq % 10 IN (0, 9) AS good FROM e)""",
    ),
    "ref_decode_delivery": (
        decode_deliveries,
        f"""WITH {MESSAGES_SQL} SELECT seq, good AS ok, CASE WHEN good THEN message_id END AS message_id, CASE WHEN good THEN payload_json END AS payload_json,
        CASE seq % 6 WHEN 1 THEN 'extra_key' WHEN 2 THEN 'missing_key' WHEN 3 THEN 'not_utf8' WHEN 4 THEN 'not_json' END AS error FROM (SELECT *, seq % 6 IN (0, 5) AS good FROM e)""",
    ),
    "ref_decode_ack": (
        decode_acks,
        """SELECT event_id AS seq, event_id % 6 IN (0, 1, 5) AS ok, CASE WHEN event_id % 6 IN (0, 1, 5) THEN 'evt-' || event_id END AS message_id,
        CASE event_id % 6 WHEN 2 THEN 'id' WHEN 3 THEN 'version' WHEN 4 THEN 'not_object' END AS error FROM events""",
    ),
    "ref_valid_id": (id_validity, "SELECT value, regexp_full_match(value, '[A-Za-z0-9_-]{1,128}') AS valid FROM (SELECT c_name AS value FROM customer UNION ALL SELECT 'evt-' || event_id FROM events)"),
    "ref_valid_topic": (topic_validity, "SELECT page_id, strlen(url) BETWEEN 1 AND 65535 AND NOT contains(url, '+') AND NOT contains(url, '#') AND NOT contains(url, chr(0)) AS valid FROM pages"),
    "ref_key_sets": (key_sets, "SELECT 'evt-' || event_id AS message_id, array_to_string(list_sort(list_filter(['k', 'v'], lambda x: NOT list_contains(json_keys(props), x))), ',') AS missing, array_to_string(list_sort(list_filter(json_keys(props), lambda x: x NOT IN ('k', 'v'))), ',') AS extra FROM events"),
    "ref_suback": (subscriptions, "SELECT o_orderkey, o_orderkey % 13 <> 0 AND o_orderkey % 4 IN (0, 1, 2) AND (o_orderkey // 4) % 3 IN (0, 1, 2) AS granted FROM orders"),
    "ref_segment_name": (segment_names, "SELECT event_id AS seq, 'segment-' || lpad(CAST(event_id AS VARCHAR), 20, '0') || '.dat' AS name FROM events"),
    "ref_crc32": (record_frames, None),
}
