"""Queries of the durability policies, spills, exact caches and replays: ordered folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.config import DurableMode, FastMode, GroupMode
from tidelog.operators.acks import window_summary
from tidelog.operators.folds import AckCheckpoint, Batches, Delivery, FastSpill, GroupSync, SeenSet, flush, ordered_fold, policy_fold
from tidelog.plans.views import MESSAGES_SQL, encoded_messages, messages
from tidelog.sources.journal import journal_lines, journal_pending, migrated, parse_journal, replay_journal

HOUR = 3600
GROUP = GroupMode(sync_messages=5, sync_bytes=300, sync_interval=6.0 * HOUR, ack_checkpoint_messages=4, ack_checkpoint_interval=12.0 * HOUR)
FAST = FastMode(ram_max_messages=8, high_watermark=0.75, spill_batch_messages=3)


def _synced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered_fold(encoded_messages(spark, sf_dir).select("sender_id", "seq", "at", "frame_size"), ["sender_id"], ["seq"], lambda: GroupSync(GROUP))


def group_sync_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _synced(spark, sf_dir).select("sender_id", "seq", "syncs", "unsynced")


def _checkpointed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages(spark, sf_dir).select("sender_id", "seq", "at", (F.col("seq") % 17 == 0).alias("leaves_segment"))
    return ordered_fold(rows, ["sender_id"], ["seq"], lambda: AckCheckpoint(GROUP))


def ack_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checkpointed(spark, sf_dir).select("sender_id", "seq", "checkpoints", "uncheckpointed")


def loss_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At a crash at the end of the log: the rows of each sender that no sync covers."""
    return window_summary(_synced(spark, sf_dir).withColumnRenamed("unsynced", "open"))


def replay_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At the same crash: acknowledged rows that no checkpoint covers and that are replayed."""
    return window_summary(_checkpointed(spark, sf_dir).withColumnRenamed("uncheckpointed", "open"))


def _policy(spark: SparkSession, sf_dir: str, mode: DurableMode | GroupMode) -> DataFrame:
    kind = F.when(F.col("event_type").isin("click", "view", "signup"), "append").otherwise("ack")
    rows = encoded_messages(spark, sf_dir).select("sender_id", "seq", "at", "frame_size", kind.alias("kind"), (F.col("seq") % 19 == 0).alias("rotates"), (F.col("seq") % 17 == 0).alias("leaves_segment"))
    return ordered_fold(rows, ["sender_id"], ["seq"], lambda: policy_fold(mode)).select("sender_id", "seq", "syncs", "unsynced", "checkpoints", "uncheckpointed")


def group_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appends and acknowledgements of one log together."""
    return _policy(spark, sf_dir, GROUP)


def durable_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _policy(spark, sf_dir, DurableMode())


def policy_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What closing each log syncs and checkpoints at last."""
    return flush(group_policy(spark, sf_dir), ["sender_id"], "seq")


def fast_spill(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ordered_fold(encoded_messages(spark, sf_dir).select("sender_id", "seq", "frame_size"), ["sender_id"], ["seq"], lambda: FastSpill(FAST))
    return out.select("sender_id", "seq", "accepted", "spilled", "in_memory", "spill_batches")


def spill_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ordered_fold(encoded_messages(spark, sf_dir).select("sender_id", "seq", "frame_size"), ["sender_id"], ["seq"], lambda: Batches(7, 600))
    return out.select("sender_id", "seq", "batch_id")


def lru_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each route remembers the last 20 users exactly."""
    rows = messages(spark, sf_dir).select("topic", "seq", F.col("sender_id").alias("message_id"))
    return ordered_fold(rows, ["topic"], ["seq"], lambda: SeenSet(20)).select("topic", "seq", "seen")


def _journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type").isin("error", "signup"), "ack").otherwise("enqueue")
    return messages(spark, sf_dir).select("sender_id", "seq", op.alias("op"), F.concat(F.lit("m-"), F.floor(F.col("seq") / 3) % 4).alias("message_id"))


def legacy_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A journal per sender; what is pending at its end."""
    return journal_pending(replay_journal(_journal(spark, sf_dir), ["sender_id"]), ["sender_id"]).select("sender_id", "seq", "message_id")


def _journal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message as a line of its sender's journal, some lines damaged; then acknowledgements of each sender's first three that are sound."""
    e = encoded_messages(spark, sf_dir).select("sender_id", "seq", "message_id", "encoded")
    line = F.concat(F.lit('{"envelope":'), "encoded", F.lit(',"journal_version":1,"op":"enqueue"}'))
    damaged = (
        F.when(F.col("seq") % 13 == 5, F.expr("substring(line, 1, length(line) - 3)"))
        .when(F.col("seq") % 13 == 6, F.replace(F.col("line"), F.lit('"enqueue"'), F.lit('"other"')))
        .when(F.col("seq") % 13 == 7, F.replace(F.col("line"), F.lit('"journal_version":1'), F.lit('"journal_version":2')))
        .when(F.col("seq") % 13 == 8, F.col("encoded"))
        .otherwise(F.col("line"))
    )
    lines = e.withColumn("line", line).withColumn("line", damaged)
    place = F.row_number().over(Window.partitionBy("sender_id").orderBy("seq"))
    done = e.where("seq % 13 NOT IN (5, 6, 7)").withColumn("place", place).where("place <= 3").withColumn("seq", F.col("seq") + 1_000_000_000_000)
    return lines.select("sender_id", "seq", "line").unionByName(journal_lines(done, "ack", ["sender_id"]))


def journal_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_journal(_journal_texts(spark, sf_dir), ["sender_id"])


def journal_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each journal is still pending, as rows for a log."""
    return migrated(_journal_texts(spark, sf_dir), ["sender_id"])


def delivery_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type").isin("error", "signup"), "ack").otherwise("publish")
    return messages(spark, sf_dir).select("sender_id", "seq", "at", kind.alias("kind"), F.concat(F.lit("m-"), F.floor(F.col("seq") / 500) % 3).alias("message_id"))


def delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head-of-line delivery with timeouts and retries; the tests compare it with a step-by-step model."""
    return ordered_fold(delivery_rows(spark, sf_dir), ["sender_id"], ["seq"], lambda: Delivery(8 * HOUR * 1_000_000, 2 * HOUR * 1_000_000)).select("sender_id", "seq", "status", "attempts", "pending")


def _timed(n: int, size: str, every: int, extra: str) -> str:
    """A fold that resets by count, size, extra condition or time; the timer fires before the row."""
    reset = f"(n0 + 1 >= {n} OR {size} OR {extra} OR tick - last0 >= {every})"
    return f"""
    SELECT sender_id, seq, rn, CASE WHEN {reset} THEN tick ELSE last0 END AS last, CASE WHEN {reset} THEN 0 ELSE n0 + 1 END AS n,
           CASE WHEN {reset} THEN 0 ELSE b0 + frame_size END AS b, k0 + CASE WHEN {reset} THEN 1 ELSE 0 END AS k"""


def _recursive(n: int, size: str, every: int, extra: str) -> str:
    step = _timed(n, size, every, extra)
    zero = "CAST(0 AS BIGINT)"
    return f"""WITH RECURSIVE {MESSAGES_SQL},
f AS ({step} FROM (SELECT *, tick AS last0, {zero} AS n0, {zero} AS b0, {zero} AS k0 FROM o WHERE rn = 1)
  UNION ALL {step} FROM (
    SELECT o.*, CASE WHEN f.n > 0 AND f.last + {every} <= o.tick THEN f.last + {every} ELSE f.last END AS last0,
           CASE WHEN f.n > 0 AND f.last + {every} <= o.tick THEN 0 ELSE f.n END AS n0,
           CASE WHEN f.n > 0 AND f.last + {every} <= o.tick THEN 0 ELSE f.b END AS b0,
           f.k + CASE WHEN f.n > 0 AND f.last + {every} <= o.tick THEN 1 ELSE 0 END AS k0
    FROM f JOIN o ON o.sender_id = f.sender_id AND o.rn = f.rn + 1))"""


SYNC_SQL = _recursive(5, "b0 + frame_size >= 300", 6 * HOUR * 1_000_000, "false")
CHECKPOINT_SQL = _recursive(4, "false", 12 * HOUR * 1_000_000, "seq % 17 = 0")
_WINDOW = f"SELECT sender_id, count(*) AS rows, CAST(arg_max(n, seq) AS BIGINT) AS open FROM f GROUP BY 1"

_DATA, _ACKS = 6 * HOUR * 1_000_000, 12 * HOUR * 1_000_000
#: One row of appends and acknowledgements together: data sync state (last, n, b, k) and checkpoint state (la, m, c).
_POLICY_STEP = f"""
    SELECT sender_id, seq, rn, CASE WHEN ack THEN CASE WHEN c2 > c AND n > 0 THEN tick ELSE last END ELSE CASE WHEN d THEN tick ELSE last2 END END AS last,
      CASE WHEN ack THEN CASE WHEN c2 > c THEN 0 ELSE n END ELSE CASE WHEN d THEN 0 ELSE n2 + 1 END END AS n,
      CASE WHEN ack THEN CASE WHEN c2 > c THEN 0 ELSE b END ELSE CASE WHEN d THEN 0 ELSE b2 + frame_size END END AS b,
      CASE WHEN ack THEN k + CASE WHEN c2 > c AND n > 0 THEN 1 ELSE 0 END ELSE k2 + CASE WHEN d THEN 1 ELSE 0 END END AS k,
      CASE WHEN ack THEN la3 ELSE la END AS la, CASE WHEN ack THEN m3 ELSE m END AS m, CASE WHEN ack THEN c2 ELSE c END AS c
    FROM (
      SELECT *, n2 + 1 >= 5 OR b2 + frame_size >= 300 OR tick - last2 >= {_DATA} AS d, CASE WHEN e THEN tick ELSE la2 END AS la3, CASE WHEN e THEN 0 ELSE m2 + 1 END AS m3, c1 + CASE WHEN e THEN 1 ELSE 0 END AS c2
      FROM (
        SELECT *, CASE WHEN t THEN 0 ELSE n1 END AS n2, CASE WHEN t THEN 0 ELSE b1 END AS b2, CASE WHEN t THEN last1 + {_DATA} ELSE last1 END AS last2, k1 + CASE WHEN t THEN 1 ELSE 0 END AS k2,
          CASE WHEN u THEN 0 ELSE m END AS m2, CASE WHEN u THEN la1 + {_ACKS} ELSE la1 END AS la2, c + CASE WHEN u THEN 1 ELSE 0 END AS c1,
          leaves OR (CASE WHEN u THEN 0 ELSE m END) + 1 >= 4 OR tick - (CASE WHEN u THEN la1 + {_ACKS} ELSE la1 END) >= {_ACKS} AS e
        FROM (
          SELECT *, n1 > 0 AND last1 + {_DATA} <= tick AS t, m > 0 AND la1 + {_ACKS} <= tick AS u
          FROM (
            SELECT *, CASE WHEN rotates AND n > 0 THEN 0 ELSE n END AS n1, CASE WHEN rotates AND n > 0 THEN 0 ELSE b END AS b1, CASE WHEN rotates AND n > 0 THEN tick ELSE coalesce(last, tick) END AS last1,
              k + CASE WHEN rotates AND n > 0 THEN 1 ELSE 0 END AS k1, coalesce(la, tick) AS la1
            FROM source))))"""
POLICY_SQL = f"""WITH RECURSIVE {MESSAGES_SQL},
w AS (SELECT sender_id, seq, rn, tick, frame_size, event_type NOT IN ('click', 'view', 'signup') AS ack, seq % 19 = 0 AS rotates, seq % 17 = 0 AS leaves FROM o),
f AS (
  SELECT sender_id, CAST(NULL AS BIGINT) AS seq, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS last, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS la, CAST(0 AS BIGINT) AS m, CAST(0 AS BIGINT) AS c
  FROM (SELECT DISTINCT sender_id FROM w)
  UNION ALL {_POLICY_STEP.replace("FROM source", "FROM (SELECT w.*, f.last, f.n, f.b, f.k, f.la, f.m, f.c FROM f JOIN w ON w.sender_id = f.sender_id AND w.rn = f.rn + 1)")}),
g AS (SELECT sender_id, seq, k AS syncs, n AS unsynced, c AS checkpoints, m AS uncheckpointed FROM f WHERE rn > 0)"""

QUERIES = {
    "ref_group_sync_full": (group_sync_full, f"{SYNC_SQL} SELECT sender_id, seq, CAST(k AS BIGINT) AS syncs, CAST(n AS BIGINT) AS unsynced FROM f"),
    "ref_ack_checkpoint": (ack_checkpoint, f"{CHECKPOINT_SQL} SELECT sender_id, seq, CAST(k AS BIGINT) AS checkpoints, CAST(n AS BIGINT) AS uncheckpointed FROM f"),
    "ref_loss_window": (loss_window, f"{SYNC_SQL} {_WINDOW}"),
    "ref_replay_window": (replay_window, f"{CHECKPOINT_SQL} {_WINDOW}"),
    "ref_group_policy": (group_policy, f"{POLICY_SQL} SELECT * FROM g"),
    "ref_durable_policy": (
        durable_policy,
        """SELECT user_id AS sender_id, event_id AS seq, count(*) FILTER (event_type IN ('click', 'view', 'signup')) OVER w AS syncs, CAST(0 AS BIGINT) AS unsynced,
        count(*) FILTER (event_type NOT IN ('click', 'view', 'signup')) OVER w AS checkpoints, CAST(0 AS BIGINT) AS uncheckpointed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
    ),
    "ref_policy_flush": (
        policy_flush,
        f"{POLICY_SQL} SELECT sender_id, syncs + CASE WHEN unsynced > 0 THEN 1 ELSE 0 END AS syncs, checkpoints + CASE WHEN uncheckpointed > 0 THEN 1 ELSE 0 END AS checkpoints, unsynced AS synced_last, uncheckpointed AS checkpointed_last FROM g QUALIFY row_number() OVER (PARTITION BY sender_id ORDER BY seq DESC) = 1",
    ),
    "ref_fast_spill": (
        fast_spill,
        f"""WITH RECURSIVE {MESSAGES_SQL},
        f AS (SELECT sender_id, seq, rn, CAST(1 AS BIGINT) AS q, CAST(0 AS BIGINT) AS spills FROM o WHERE rn = 1
          UNION ALL SELECT o.sender_id, o.seq, o.rn, CASE WHEN q + 1 >= 6 THEN q + 1 - 3 ELSE q + 1 END, spills + CASE WHEN q + 1 >= 6 THEN 1 ELSE 0 END
          FROM f JOIN o ON o.sender_id = f.sender_id AND o.rn = f.rn + 1)
        SELECT sender_id, seq, true AS accepted, spills * 3 AS spilled, q AS in_memory, spills AS spill_batches FROM f""",
    ),
    "ref_spill_batches": (
        spill_batches,
        f"""WITH RECURSIVE {MESSAGES_SQL},
        f AS (SELECT sender_id, seq, rn, CAST(1 AS BIGINT) AS batch_id, 1 AS n, frame_size AS b FROM o WHERE rn = 1
          UNION ALL SELECT o.sender_id, o.seq, o.rn, CASE WHEN n >= 7 OR b + frame_size > 600 THEN batch_id + 1 ELSE batch_id END,
            CASE WHEN n >= 7 OR b + frame_size > 600 THEN 1 ELSE n + 1 END, CASE WHEN n >= 7 OR b + frame_size > 600 THEN frame_size ELSE b + frame_size END
          FROM f JOIN o ON o.sender_id = f.sender_id AND o.rn = f.rn + 1)
        SELECT sender_id, seq, batch_id FROM f""",
    ),
    "ref_lru_dedup": (
        lru_dedup,
        """WITH r AS (SELECT 'events/' || event_type AS topic, event_id AS seq, user_id, lag(event_id) OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS before FROM events),
        d AS (SELECT a.topic, a.seq, count(DISTINCT b.user_id) AS others FROM r a JOIN r b ON a.topic = b.topic AND b.seq > a.before AND b.seq < a.seq AND b.user_id <> a.user_id GROUP BY ALL)
        SELECT r.topic, r.seq, before IS NOT NULL AND coalesce(others, 0) < 20 AS seen FROM r LEFT JOIN d ON d.topic = r.topic AND d.seq = r.seq""",
    ),
    "ref_legacy_replay": (
        legacy_replay,
        """WITH RECURSIVE j AS (SELECT user_id AS sender_id, event_id AS seq, event_type IN ('error', 'signup') AS ack, 'm-' || ((event_id // 3) % 4) AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
        f AS (SELECT sender_id, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(id VARCHAR, seq BIGINT)[]) AS q FROM (SELECT DISTINCT sender_id FROM j)
          UNION ALL SELECT f.sender_id, j.rn, CASE
            WHEN NOT j.ack AND NOT list_contains(list_transform(q, lambda x: x.id), j.id) THEN list_append(q, {'id': j.id, 'seq': j.seq})
            WHEN j.ack AND len(q) > 0 AND q[1].id = j.id THEN q[2:] ELSE q END
          FROM f JOIN j ON j.sender_id = f.sender_id AND j.rn = f.rn + 1)
        SELECT sender_id, x.seq AS seq, x.id AS message_id FROM (SELECT sender_id, unnest(q) AS x FROM (SELECT sender_id, arg_max(q, rn) AS q FROM f GROUP BY 1))""",
    ),
    "ref_journal_text": (
        journal_text,
        f"""WITH {MESSAGES_SQL}, j AS (SELECT *, seq % 13 IN (5, 6, 7) AS bad FROM e)
        SELECT sender_id, seq, CASE WHEN bad THEN 'corrupt' ELSE 'enqueue' END AS op, CASE WHEN NOT bad THEN message_id END AS message_id, CASE WHEN NOT bad THEN encoded END AS encoded FROM j
        UNION ALL SELECT sender_id, seq + 1000000000000, 'ack', message_id, NULL FROM j WHERE NOT bad QUALIFY row_number() OVER (PARTITION BY sender_id ORDER BY seq) <= 3""",
    ),
    "ref_journal_migration": (
        journal_migration,
        f"WITH {MESSAGES_SQL} SELECT sender_id, seq, message_id, encoded FROM e WHERE seq % 13 NOT IN (5, 6, 7) QUALIFY row_number() OVER (PARTITION BY sender_id ORDER BY seq) > 3",
    ),
    "ref_delivery": (delivery, None),
}
