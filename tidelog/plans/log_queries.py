"""Queries of the log: append, segments, cursors, retention and checks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.config import LogLimits
from tidelog.operators import log, store
from tidelog.plans.views import MESSAGES_SQL, encoded_messages, messages, table
from tidelog.session import shared_dir
from tidelog.sources import segments

#: Small limits, so that the test tables rotate often.
LIMITS = LogLimits(segment_max_bytes=900, segment_max_records=10)


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.assign_segments(encoded_messages(spark, sf_dir), LIMITS)


def segment_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(spark, sf_dir).select("sender_id", "seq", "segment_id", "start_offset", "end_offset")


def segment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.segment_stats(placed(spark, sf_dir))


def cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cursor for every second sender, half of them on no boundary."""
    ids = messages(spark, sf_dir).select("sender_id").distinct().where("sender_id % 2 = 0")
    return ids.select("sender_id", F.lit(3).cast("long").alias("segment_id"), F.when(F.col("sender_id") % 4 == 0, 16).otherwise(17).cast("long").alias("byte_offset"))


def replay_from_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.replay(placed(spark, sf_dir), cursors(spark, sf_dir)).select("sender_id", "seq", "message_id")


def conservative_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.conservative_cursors(placed(spark, sf_dir), cursors(spark, sf_dir))


def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.retention(log.segment_stats(placed(spark, sf_dir)), cursors(spark, sf_dir)).select("sender_id", "segment_id")


def next_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.next_cursors(placed(spark, sf_dir)).select("sender_id", "seq", "next_segment", "next_offset")


def segment_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.segment_gaps(table(spark, sf_dir, "lineitem"), "l_orderkey")


def append_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = encoded_messages(spark, sf_dir)
    batch = e.withColumn("encoded", F.when(F.col("seq") % 30 == 0, F.concat("encoded", F.lit(" "))).otherwise(F.col("encoded")))
    return log.append_verdicts(e.where("seq % 3 = 0"), batch).select("message_id", "verdict")


def batch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = encoded_messages(spark, sf_dir).select("message_id", "sender_id", "seq", "encoded")
    again = e.select("message_id", "sender_id", (F.col("seq") + 1_000_000_000).alias("seq"), F.when(F.col("seq") % 25 == 0, F.concat("encoded", F.lit(" "))).otherwise(F.col("encoded")).alias("encoded"))
    return log.dedup_batch(e.unionByName(again)).select("message_id", "seq", "conflict", "copies")


def peek_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.heads(encoded_messages(spark, sf_dir)).select("sender_id", "seq", "message_id", "encoded")


def fifo_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.fifo_positions(messages(spark, sf_dir)).select("sender_id", "seq", "fifo_pos")


def remove_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message offered as the head to be removed, some with other bytes."""
    e = encoded_messages(spark, sf_dir).select("sender_id", "seq", "message_id", "encoded")
    asked = e.withColumn("encoded", F.when(F.col("sender_id") % 5 == 0, F.concat("encoded", F.lit(" "))).otherwise(F.col("encoded")))
    return log.remove_head(e, asked).select("sender_id", "seq", "removed")


def union_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of later numbers lie on disk, earlier ones in memory: the disk tier goes first."""
    m = messages(spark, sf_dir).select("sender_id", "seq")
    return log.recovered_then_new(m.where("seq % 4 = 3"), m.where("seq % 4 <> 3"))


def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.duplicate_ids(table(spark, sf_dir, "lineitem").select(F.concat_ws("-", F.lit("ord"), "l_orderkey", "l_linenumber").alias("message_id")))


def verify_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = encoded_messages(spark, sf_dir).select("sender_id", "seq", "message_id", "encoded")
    written = e.where("seq % 9 <> 4").withColumn("encoded", F.when(F.col("seq") % 50 == 0, F.concat("encoded", F.lit(" "))).otherwise(F.col("encoded")))
    return log.verify_written(written, e)


def get_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup of one message id."""
    return store.lookup(encoded_messages(spark, sf_dir), "evt-42").select("message_id", "encoded")


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The placed log with the checksums that were written."""
    return placed(spark, sf_dir).withColumn("crc32", store.checksum(F.col("encoded")))


def _appended(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """A log of every third message, to which all messages are then appended; its folder and the second result."""
    folder = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    e = encoded_messages(spark, sf_dir).select("sender_id", "seq", "message_id", "encoded")
    store.append(spark, folder, e.where("seq % 3 = 0"), LIMITS)
    return folder, store.append(spark, folder, e, LIMITS)


def append_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.read_log(spark, _appended(spark, sf_dir)[0]).select("sender_id", "seq", "message_id", "segment_id", "start_offset", "end_offset")


def append_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _appended(spark, sf_dir)[1]


def lookup_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that are there, some of them with a text that was changed since, and ids that are not."""
    ids = messages(spark, sf_dir).where("seq % 50 = 0").select(F.when(F.col("seq") % 100 == 0, F.col("message_id")).otherwise(F.concat(F.lit("gone-"), "seq")).alias("message_id"))
    damaged = stored(spark, sf_dir).withColumn("encoded", F.when(F.col("seq") % 200 == 0, F.concat("encoded", F.lit(" "))).otherwise(F.col("encoded")))
    return store.lookup_all(damaged, ids)


def _still_pending(rows: DataFrame) -> DataFrame:
    """Few rows of each sender, and none of some."""
    return rows.where("seq % 37 = 3")


def live_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = placed(spark, sf_dir)
    return store.live_cursors(p, _still_pending(p))


def closed_behind(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = placed(spark, sf_dir)
    return store.closed_behind(p, store.live_cursors(p, _still_pending(p)))


def compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next cursor of each sender and the rows that stay; every second sender had a cursor, some of them where it still is."""
    p = placed(spark, sf_dir)
    now = store.live_cursors(p, _still_pending(p))
    old = now.where("sender_id % 2 = 0").withColumn("generation", F.lit(4)).withColumn("byte_offset", F.when(F.col("sender_id") % 4 == 0, F.col("byte_offset")).otherwise(F.lit(16).cast("long")))
    texts, rows = store.compact(p, _still_pending(p), old)
    return texts.join(rows.groupBy("sender_id").agg(F.count(F.lit(1)).alias("kept")), "sender_id").select("sender_id", "text", "kept")


def cursor_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cursors as texts, sound in two ways and damaged in six."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    texts = [
        store.encode_cursor(F.col("k"), F.col("k") + 1, F.col("k") + 2),
        F.format_string('{ "version": 1, "segment_id": %d, "generation":%d, "byte_offset" : %d }\n', F.col("k") + 1, F.col("k"), F.col("k") + 2),
        F.format_string('{"byte_offset":%d,"generation":%d,"version":1}', F.col("k"), F.col("k")),
        F.format_string('{"byte_offset":%d,"generation":%d,"generation":1,"version":1}', F.col("k"), F.col("k")),
        F.format_string('{"byte_offset":-%d,"generation":%d,"segment_id":1,"version":1}', F.col("k") + 1, F.col("k")),
        F.format_string('{"byte_offset":%d,"generation":%d,"segment_id":1,"version":2}', F.col("k"), F.col("k")),
        F.format_string('{"byte_offset":%d.0,"generation":%d,"segment_id":1,"version":1}', F.col("k"), F.col("k")),
        F.format_string('{"byte_offset":%d,"generation":true,"segment_id":1,"version":1}', F.col("k")),
    ]
    text = F.coalesce(*(F.when(F.col("k") % 8 == i, t) for i, t in enumerate(texts)))
    return o.withColumn("c", store.decode_cursor(text)).select("k", F.col("c").isNotNull().alias("sound"), "c.generation", "c.segment_id", "c.byte_offset")


def format_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format metadata as texts: in two spellings, of another version, with a key too many, cut off."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    texts = ['{"format":"log","version":1}', '{ "version": 1,\n "format": "log" }', '{"format":"log","version":2}', '{"format":"log","version":1,"x":0}', '{"format":"log","version":1', '{"format":"log","version":1.0}']
    text = F.element_at(F.array(*map(F.lit, texts)), (F.col("k") % len(texts) + 1).cast("int"))
    return o.select("k", store.valid_format(text, "log").alias("valid"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = segments.segment_files(placed(spark, sf_dir)).withColumnRenamed("segment_id", "number")
    return files.withColumn("newest", F.col("number") == F.max("number").over(Window.partitionBy("sender_id")))


def segment_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.frames_of(_files(spark, sf_dir), ("sender_id",)).select("sender_id", "segment_id", "start_offset", "end_offset", "encoded", "error")


def recovery_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a recovery: by sender an unfinished last write, a changed byte, or a segment that is gone."""
    size = F.octet_length("content")
    content = (
        F.when((F.col("sender_id") % 10 == 1) & F.col("newest"), F.expr("substring(content, 1, octet_length(content) - 5)"))
        .when((F.col("sender_id") % 10 == 2) & (F.col("number") == 1), F.concat(F.expr("substring(content, 1, octet_length(content) - 1)"), F.lit(bytearray(b"\0"))))
        .otherwise(F.col("content"))
    )
    files = _files(spark, sf_dir).where((size > 0) & ~((F.col("sender_id") % 10 == 3) & (F.col("number") == 2))).withColumn("content", content)
    newest = F.col("number") == F.max("number").over(Window.partitionBy("sender_id"))
    return segments.recovered(segments.frames_of(files.withColumn("newest", newest), ("sender_id",)), cursors(spark, sf_dir))[1]


def _placed_sql(ordered: str) -> str:
    return f"""WITH RECURSIVE {MESSAGES_SQL},
q AS ({ordered}),
p AS (
  SELECT sender_id, seq, message_id, encoded, rn, CAST(1 AS BIGINT) AS segment_id, CAST(16 AS BIGINT) AS start_offset, 16 + frame_size AS end_offset, 1 AS records FROM q WHERE rn = 1
  UNION ALL
  SELECT o.sender_id, o.seq, o.message_id, o.encoded, o.rn,
    CASE WHEN p.records >= 10 OR p.end_offset + o.frame_size > 900 THEN p.segment_id + 1 ELSE p.segment_id END,
    CASE WHEN p.records >= 10 OR p.end_offset + o.frame_size > 900 THEN 16 ELSE p.end_offset END,
    CASE WHEN p.records >= 10 OR p.end_offset + o.frame_size > 900 THEN 16 ELSE p.end_offset END + o.frame_size,
    CASE WHEN p.records >= 10 OR p.end_offset + o.frame_size > 900 THEN 1 ELSE p.records + 1 END
  FROM p JOIN q o ON o.sender_id = p.sender_id AND o.rn = p.rn + 1),
s AS (SELECT sender_id, segment_id, count(*) AS record_count, max(end_offset) AS byte_size, min(seq) AS first_seq, max(seq) AS last_seq FROM p GROUP BY ALL),
c AS (SELECT DISTINCT sender_id, CAST(3 AS BIGINT) AS segment_id, CAST(CASE WHEN sender_id % 4 = 0 THEN 16 ELSE 17 END AS BIGINT) AS byte_offset FROM m WHERE sender_id % 2 = 0)"""


PLACED_SQL = _placed_sql("SELECT * FROM o")
#: The log of ``_appended``: every third message first.
APPENDED_SQL = _placed_sql("SELECT *, row_number() OVER (PARTITION BY sender_id ORDER BY seq % 3 <> 0, seq) AS rn FROM e")
LIVE_SQL = f"""{PLACED_SQL},
l AS (
  SELECT sender_id, coalesce(any_value(h.pos), max({{'segment_id': p.segment_id, 'byte_offset': p.end_offset}})) AS pos, max(p.segment_id) AS active
  FROM p LEFT JOIN (SELECT sender_id, arg_min({{'segment_id': segment_id, 'byte_offset': start_offset}}, seq) AS pos FROM p WHERE seq % 37 = 3 GROUP BY 1) h USING (sender_id) GROUP BY 1)"""

QUERIES = {
    "ref_segment_assign": (segment_assign, f"{PLACED_SQL} SELECT sender_id, seq, segment_id, start_offset, end_offset FROM p"),
    "ref_segment_stats": (segment_stats, f"{PLACED_SQL} SELECT * FROM s"),
    "ref_replay_from_cursor": (replay_from_cursor, f"{PLACED_SQL} SELECT p.sender_id, seq, message_id FROM p LEFT JOIN c USING (sender_id) WHERE c.segment_id IS NULL OR (p.segment_id, start_offset) >= (c.segment_id, byte_offset)"),
    "ref_conservative_cursor": (
        conservative_cursor,
        f"""{PLACED_SQL}, g AS (SELECT * FROM c WHERE EXISTS (SELECT 1 FROM p WHERE p.sender_id = c.sender_id AND p.segment_id = c.segment_id AND byte_offset IN (start_offset, end_offset)))
        SELECT sender_id, segment_id, byte_offset, true AS valid FROM g
        UNION ALL SELECT sender_id, segment_id, start_offset AS byte_offset, false AS valid FROM p WHERE rn = 1 AND sender_id NOT IN (SELECT sender_id FROM g)""",
    ),
    "ref_retention": (retention, f"{PLACED_SQL} SELECT s.sender_id, s.segment_id FROM s JOIN c USING (sender_id) WHERE s.segment_id < c.segment_id AND s.segment_id < (SELECT max(segment_id) FROM s t WHERE t.sender_id = s.sender_id)"),
    "ref_next_cursor": (
        next_cursor,
        f"{PLACED_SQL} SELECT sender_id, seq, coalesce(lead(segment_id) OVER w, segment_id) AS next_segment, coalesce(lead(start_offset) OVER w, end_offset) AS next_offset FROM p WINDOW w AS (PARTITION BY sender_id ORDER BY segment_id, start_offset)",
    ),
    "ref_segment_gaps": (segment_gaps, "SELECT v + 1 AS first_missing, n - 1 AS last_missing FROM (SELECT v, lead(v) OVER (ORDER BY v) AS n FROM (SELECT DISTINCT l_orderkey AS v FROM lineitem)) WHERE n > v + 1"),
    "ref_append_idempotent": (append_idempotent, "SELECT 'evt-' || event_id AS message_id, CASE WHEN event_id % 3 <> 0 THEN 'new' WHEN event_id % 30 = 0 THEN 'conflict' ELSE 'noop' END AS verdict FROM events"),
    "ref_batch_dedup": (batch_dedup, "SELECT 'evt-' || event_id AS message_id, event_id AS seq, event_id % 25 = 0 AS conflict, CAST(2 AS BIGINT) AS copies FROM events"),
    "ref_peek_oldest": (peek_oldest, f"WITH {MESSAGES_SQL} SELECT sender_id, seq, message_id, encoded FROM o WHERE rn = 1"),
    "ref_fifo_pos": (fifo_pos, f"WITH {MESSAGES_SQL} SELECT sender_id, seq, rn AS fifo_pos FROM o"),
    "ref_remove_head": (remove_head, f"WITH {MESSAGES_SQL} SELECT sender_id, seq, rn = 1 AND sender_id % 5 <> 0 AS removed FROM o"),
    "ref_union_recovered": (
        union_recovered,
        "SELECT user_id AS sender_id, event_id AS seq, CAST(CASE WHEN event_id % 4 = 3 THEN 0 ELSE 1 END AS INTEGER) AS tier, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 4 <> 3, event_id) AS fifo_pos FROM events",
    ),
    "ref_duplicate_ids": (duplicate_ids, "SELECT 'ord-' || l_orderkey || '-' || l_linenumber AS message_id, count(*) AS copies FROM lineitem GROUP BY 1 HAVING count(*) > 1"),
    "ref_verify_written": (verify_written, "SELECT user_id AS sender_id, count(*) AS expected, count(*) FILTER (event_id % 9 <> 4) AS found, count(*) FILTER (event_id % 9 <> 4 AND event_id % 50 = 0) AS mismatched FROM events GROUP BY 1"),
    "ref_get_message": (get_message, f"WITH {MESSAGES_SQL} SELECT message_id, encoded FROM e WHERE message_id = 'evt-42'"),
    "ref_append_log": (append_log, f"{APPENDED_SQL} SELECT sender_id, seq, message_id, segment_id, start_offset, end_offset FROM p"),
    "ref_append_result": (
        append_result,
        f"""{APPENDED_SQL} SELECT sender_id, count(*) FILTER (seq % 3 <> 0) AS appended_count, CAST(coalesce(sum(strlen(encoded) + 12) FILTER (seq % 3 <> 0), 0) AS BIGINT) AS bytes_written,
        coalesce(max(segment_id) FILTER (seq % 3 <> 0) > coalesce(max(segment_id) FILTER (seq % 3 = 0), min(segment_id) FILTER (seq % 3 <> 0)), false) AS rotated, count(*) FILTER (seq % 3 = 0) AS skipped FROM p GROUP BY 1""",
    ),
    "ref_lookup_verified": (
        lookup_verified,
        f"""WITH {MESSAGES_SQL} SELECT CASE WHEN seq % 100 = 0 THEN message_id ELSE 'gone-' || seq END AS message_id, seq % 100 = 0 AS found,
        CASE WHEN seq % 200 = 0 THEN encoded || ' ' WHEN seq % 100 = 0 THEN encoded END AS encoded, CASE WHEN seq % 200 = 0 THEN 'checksum' END AS error FROM e WHERE seq % 50 = 0""",
    ),
    "ref_live_cursor": (live_cursor, f"{LIVE_SQL} SELECT sender_id, pos.segment_id AS segment_id, pos.byte_offset AS byte_offset FROM l"),
    "ref_closed_behind": (closed_behind, f"{LIVE_SQL} SELECT sender_id, pos.segment_id > 1 AS behind FROM l"),
    "ref_compact": (
        compact,
        f"""{LIVE_SQL} SELECT l.sender_id, '{{"byte_offset":' || pos.byte_offset || ',"generation":' || (CASE WHEN l.sender_id % 2 <> 0 THEN 1 WHEN l.sender_id % 4 = 0 OR pos.byte_offset = 16 THEN 4 ELSE 5 END) || ',"segment_id":' || pos.segment_id || ',"version":1}}' AS text,
        count(*) AS kept FROM l JOIN p ON p.sender_id = l.sender_id AND (p.segment_id >= pos.segment_id OR p.segment_id >= active) GROUP BY 1, 2""",
    ),
    "ref_cursor_text": (
        cursor_text,
        "SELECT o_orderkey AS k, k % 8 < 2 AS sound, CASE WHEN k % 8 < 2 THEN k END AS generation, CASE WHEN k % 8 < 2 THEN k + 1 END AS segment_id, CASE WHEN k % 8 < 2 THEN k + 2 END AS byte_offset FROM orders",
    ),
    "ref_format_check": (format_check, "SELECT o_orderkey AS k, o_orderkey % 6 < 2 AS valid FROM orders"),
    "ref_segment_scan": (segment_scan, f"{PLACED_SQL} SELECT sender_id, segment_id, start_offset, end_offset, encoded, CAST(NULL AS VARCHAR) AS error FROM p"),
    "ref_recovery_scan": (
        recovery_scan,
        f"""{PLACED_SQL}, x AS (
          SELECT p.*, c.segment_id AS at_segment, c.byte_offset AS at_offset, max(p.segment_id) OVER (PARTITION BY p.sender_id) AS newest,
            row_number() OVER (PARTITION BY p.sender_id, p.segment_id ORDER BY seq DESC) = 1 AS last_of
          FROM p LEFT JOIN c ON c.sender_id = p.sender_id),
        y AS (
          SELECT *, NOT (sender_id % 10 = 1 AND segment_id = newest AND last_of) AND NOT (sender_id % 10 = 2 AND segment_id = 1 AND last_of) AND NOT (sender_id % 10 = 3 AND segment_id = 2) AS sound,
            at_segment IS NULL OR (segment_id, start_offset) >= (at_segment, at_offset) AS after FROM x)
        SELECT sender_id, CAST(count(*) FILTER (sound) AS BIGINT) AS records, CAST(count(*) FILTER (sound AND after) AS BIGINT) AS replayed, CASE WHEN sender_id % 10 = 2 THEN 'checksum' END AS error,
          sender_id % 10 = 1 AS torn, CAST(0 AS BIGINT) AS duplicates, CAST(CASE WHEN sender_id % 10 = 3 AND any_value(newest) > 2 THEN 1 ELSE 0 END AS BIGINT) AS missing FROM y GROUP BY 1""",
    ),
}
