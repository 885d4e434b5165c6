import pytest
from pyspark.sql import functions as F

from tidelog.config import DurableMode, FastMode, GroupMode, LogLimits
from tidelog.errors import ConfigError, LogError
from tidelog.functions.codec import encode_message
from tidelog.operators import log, store
from tidelog.operators.folds import flush, ordered_fold, policy_fold
from tidelog.operators.intake import intake
from tidelog.session import saved_tables
from tidelog.sources.journal import migrated, read_journal
from tidelog.sources.segments import frames_of, recovered, segment_files


def batch(spark, *ns, sender=1, payload="1"):
    rows = spark.createDataFrame([(sender, n) for n in ns], "sender_id long, seq long")
    named = rows.withColumn("message_id", F.concat(F.lit("m-"), "sender_id", F.lit("-"), "seq"))
    return named.withColumn("encoded", encode_message(F.col("message_id"), F.lit("t"), F.lit(payload)))


def test_appends_are_idempotent_go_on_behind_the_last_segment_and_refuse_conflicts(spark, tmp_path):
    folder, limits = f"{tmp_path}/log", LogLimits(segment_max_records=2)
    before = saved_tables()
    one = store.append(spark, folder, batch(spark, 1, 1, 2, 3), limits).first()
    assert (one["appended_count"], one["rotated"], one["skipped"]) == (3, True, 0)
    two = store.append(spark, folder, batch(spark, 3, 4, 5).unionByName(batch(spark, 9, sender=2)), limits).orderBy("sender_id").collect()
    assert [(r["sender_id"], r["appended_count"], r["rotated"], r["skipped"]) for r in two] == [(1, 2, True, 1), (2, 1, False, 0)]
    with pytest.raises(LogError):
        store.append(spark, folder, batch(spark, 5, 6, payload="2"), limits)
    with pytest.raises(LogError):
        store.append(spark, folder, batch(spark, 7).unionByName(batch(spark, 7, payload="2")), limits)
    assert store.append(spark, folder, batch(spark, 5, 6, payload="2"), limits, on_conflict="ignore").first()["appended_count"] == 1
    rows = store.read_log(spark, folder).where("sender_id = 1").orderBy("segment_id", "start_offset").collect()
    assert [r["seq"] for r in rows] == [1, 2, 3, 4, 5, 6] and [r["segment_id"] for r in rows] == [1, 1, 2, 2, 3, 3]
    assert all(b["start_offset"] == (a["end_offset"] if a["segment_id"] == b["segment_id"] else 16) for a, b in zip(rows, rows[1:]))
    placed = log.assign_segments(batch(spark, 1, 2, 3, 4, 5, 6), limits)  # the same text sizes in one go
    assert {(r["seq"], r["end_offset"]) for r in rows} == {(r["seq"], r["end_offset"]) for r in placed.collect()}
    assert store.verified(store.read_log(spark, folder)).where("error IS NOT NULL").count() == 0
    assert [r["seq"] for r in store.lookup(store.read_log(spark, folder), "m-2-9").collect()] == [9]
    assert len(saved_tables()) == len(before) + 3  # the results that were handed out
    assert store.read_log(spark, f"{tmp_path}/none").count() == 0


def test_rows_are_placed_in_order_where_the_join_before_turns_into_a_broadcast(spark, tmp_path):
    limits, n = LogLimits(segment_max_records=7), 400
    rows = batch(spark, *range(n)).unionByName(batch(spark, *range(n), sender=2))
    # a threshold less than the log as a table, but more than the ends of two senders
    settings = {"spark.sql.autoBroadcastJoinThreshold": "1000", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        store.append(spark, f"{tmp_path}/log", rows.where("seq < 50"), limits)
        new = rows.where("seq >= 50").repartition(8)
        got = store.placed_after(store.read_log(spark, f"{tmp_path}/log"), new, limits).select("sender_id", "seq", "segment_id", "end_offset").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = log.assign_segments(rows, limits).where("seq >= 50").select("sender_id", "seq", "segment_id", "end_offset").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_cursors_move_once_and_leave_closed_segments(spark, tmp_path):
    placed = log.assign_segments(batch(spark, *range(6)), LogLimits(segment_max_records=2))
    none = spark.createDataFrame([], "sender_id long, generation long, segment_id long, byte_offset long")
    texts, rows = store.compact(placed, placed.where("seq >= 3"), none)
    assert rows.count() == 4
    read = store.read_cursors(placed, texts)
    got = read.first()
    assert (got["segment_id"], got["generation"], got["valid"]) == (2, 1, True) and got["byte_offset"] == placed.where("seq = 3").first()["start_offset"]
    again, _ = store.compact(placed, placed.where("seq >= 3"), read.drop("valid"))
    assert again.first()["text"] == texts.first()["text"]
    end, rest = store.compact(placed, placed.where("false"), read.drop("valid"))
    assert store.read_cursors(placed, end).first()["generation"] == 2 and {r["segment_id"] for r in rest.collect()} == {3}
    bad = spark.createDataFrame([(1, "{}")], "sender_id long, text string")
    got = store.read_cursors(placed, bad).first()
    assert (got["segment_id"], got["byte_offset"], got["generation"], got["valid"]) == (1, 16, 0, False)


def test_recovery_reports_damage_and_gaps(spark):
    placed = log.assign_segments(batch(spark, *range(8)), LogLimits(segment_max_records=2))
    files = segment_files(placed).withColumnRenamed("segment_id", "number").withColumn("newest", F.col("number") == 4)
    none = spark.createDataFrame([], "sender_id long, segment_id long, byte_offset long")
    rows, report = recovered(frames_of(files, ("sender_id",)), none)
    assert rows.count() == 8 and tuple(report.first())[1:] == (8, 8, None, False, 0, 0)
    cursor = spark.createDataFrame([(1, 2, 16)], "sender_id long, segment_id long, byte_offset long")
    rows, report = recovered(frames_of(files.where("number <> 3"), ("sender_id",)), cursor)
    assert rows.count() == 4 and tuple(report.first())[1:] == (6, 4, None, False, 0, 1)
    twice = files.unionByName(files.where("number = 2").withColumn("number", F.lit(2).cast("long")))
    assert recovered(frames_of(twice, ("sender_id",)), none)[1].first()["duplicates"] == 2
    cut = files.withColumn("content", F.when(F.col("newest"), F.expr("substring(content, 1, octet_length(content) - 3)")).otherwise(F.expr("substring(content, 1, octet_length(content) - (number % 2))")))
    report = recovered(frames_of(cut, ("sender_id",)), none)[1].first()
    assert report["torn"] and report["error"] == "incomplete" and report["records"] == 8 - 3


def test_recovery_runs_its_frames_once(spark):
    files = segment_files(log.assign_segments(batch(spark, *range(8)), LogLimits(segment_max_records=2))).withColumnRenamed("segment_id", "number")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    frames = frames_of(files.withColumn("newest", F.col("number") == 4), ("sender_id",))
    none = spark.createDataFrame([], "sender_id long, segment_id long, byte_offset long")
    rows, report = recovered(frames.mapInArrow(counted, frames.schema), none)
    assert rows.count() == 8 and report.first()["records"] == 8
    assert seen.value == 8


def test_journals_are_read_in_splits_and_migrated(spark, tmp_path):
    lines = [f'{{"envelope":{{"event_id":"m{i}","payload":{i},"topic":"t","version":1}},"journal_version":1,"op":"enqueue"}}' for i in range(400)]
    lines[3], lines[7] = "", lines[7][:-4]
    lines += ['{"journal_version":1,"message_id":"m0","op":"ack"}', '{"journal_version":1,"message_id":"m5","op":"ack"}']
    (tmp_path / "journal.txt").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = read_journal(spark, f"{tmp_path}/journal.txt").orderBy("seq").collect()
        assert [r["line"] for r in got] == [x for x in lines if x] and [r["seq"] for r in got] == list(range(401))
        rows = migrated(read_journal(spark, f"{tmp_path}/journal.txt").withColumn("sender_id", F.lit(1).cast("long")), ["sender_id"]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r["message_id"] for r in rows} == {f"m{i}" for i in range(400)} - {"m0", "m3", "m7"}


def test_gaps_over_the_whole_range_of_integers(spark):
    values = [-(2**62), -65537, -65536, -3, -1, 0, 1, 5, 65535, 65536, 2**40, 2**40 + 1, 2**62]
    ids = spark.createDataFrame([(v,) for v in [*values, *values, None]], "v long")
    got = sorted(map(tuple, log.segment_gaps(ids, "v").collect()))
    assert got == [(a + 1, b - 1) for a, b in zip(values, values[1:]) if b > a + 1]
    assert log.segment_gaps(ids.where("false"), "v").count() == 0


def test_policies_by_mode_and_what_closing_adds(spark):
    kinds = ["append", "append", "ack", "append", "ack"]
    rows = spark.createDataFrame([(1, i, k, i * 1_000_000, 40, False, False) for i, k in enumerate(kinds)], "k int, seq long, kind string, at long, frame_size long, rotates boolean, leaves_segment boolean")
    group = GroupMode(sync_messages=2, sync_interval=None, sync_bytes=None, ack_checkpoint_messages=5, ack_checkpoint_interval=None)
    last = lambda mode: ordered_fold(rows, ["k"], ["seq"], lambda: policy_fold(mode)).orderBy("seq").collect()[-1]
    assert (last(DurableMode())["syncs"], last(DurableMode())["checkpoints"]) == (3, 2)
    assert (last(group)["syncs"], last(group)["unsynced"], last(group)["uncheckpointed"]) == (1, 1, 2)
    closed = flush(ordered_fold(rows, ["k"], ["seq"], lambda: policy_fold(group)), ["k"], "seq").first()
    assert (closed["syncs"], closed["checkpoints"], closed["synced_last"], closed["checkpointed_last"]) == (2, 1, 1, 2)
    with pytest.raises(ConfigError):
        policy_fold(FastMode())


def test_intake_assigns_the_same_id_again(spark):
    rows = spark.createDataFrame([(1, None, "t", "1"), (1, None, "t", "1"), (2, None, "t", "1"), (3, "a", "", "1"), (4, "a", "t", "{")], "n int, message_id string, topic string, payload_json string")
    got = [sorted(map(tuple, intake(rows, ["n"]).collect()), key=repr) for _ in range(2)]
    assert got[0] == got[1]
    assert len({r[1] for r in got[0] if r[0] < 3}) == 2 and [r[4] for r in got[0]] == [None, None, None, "topic", "payload"]
