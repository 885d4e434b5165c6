import pytest
from pyspark.sql import functions as F

from tidelog.config import LogLimits
from tidelog.functions.codec import encode_message
from tidelog.operators import acks, log


def events(spark, *ns, sender=1):
    """``event-n`` with payload n, in the order given."""
    rows = spark.createDataFrame([(sender, i, n) for i, n in enumerate(ns)], "sender_id long, seq long, n long")
    text = encode_message(F.concat(F.lit("event-"), "n"), F.lit("factory/data"), F.concat(F.lit('{"sequence":'), "n", F.lit("}")))
    return rows.select("sender_id", "seq", F.concat(F.lit("event-"), "n").alias("message_id"), text.alias("encoded"))


def test_append_is_idempotent_and_conflicts_show(spark):
    batch = events(spark, 1, 1, 2)
    once = log.dedup_batch(batch)
    assert sorted((r["message_id"], r["conflict"], r["copies"]) for r in once.collect()) == [("event-1", False, 2), ("event-2", False, 1)]
    pending = once.select("message_id", "encoded")
    other = batch.withColumn("encoded", F.when(F.col("message_id") == "event-1", "other").otherwise(F.col("encoded")))
    verdict = lambda rows, **k: {r["message_id"]: r["verdict"] for r in log.append_verdicts(pending, rows, **k).collect()}
    assert verdict(events(spark, 1, 3)) == {"event-1": "noop", "event-3": "new"}
    assert verdict(other) == {"event-1": "conflict", "event-2": "noop"}
    assert verdict(other, on_conflict="ignore") == {"event-1": "noop", "event-2": "noop"}
    with pytest.raises(ValueError):
        log.append_verdicts(pending, batch, on_conflict="replace")


def test_segments_cursors_and_retention(spark):
    placed = log.assign_segments(events(spark, 1, 2, 3, 4, 5), LogLimits(segment_max_records=2))
    assert [r["segment_id"] for r in placed.orderBy("seq").collect()] == [1, 1, 2, 2, 3]
    stats = log.segment_stats(placed)
    at = lambda s, o: spark.createDataFrame([(1, s, o)], "sender_id long, segment_id long, byte_offset long")
    gone = lambda c: [r["segment_id"] for r in log.retention(stats, c).collect()]
    after = {r["seq"]: (r["next_segment"], r["next_offset"]) for r in log.next_cursors(placed).collect()}
    assert gone(at(*after[0])) == [] and gone(at(*after[1])) == [1]
    assert after[1] == (2, 16) and after[4][0] == 3
    live = lambda c: sorted(r["seq"] for r in log.replay(placed, c).collect())
    assert live(at(*after[0])) == [1, 2, 3, 4] and live(at(*after[4])) == []
    assert live(at(1, 16).where("false")) == [0, 1, 2, 3, 4]


def test_a_bad_checkpoint_replays_from_the_earliest_position(spark):
    placed = log.assign_segments(events(spark, 1, 2), LogLimits())
    at = lambda o: spark.createDataFrame([(1, 1, o)], "sender_id long, segment_id long, byte_offset long")
    edge = placed.where("seq = 0").first()["end_offset"]
    assert tuple(log.conservative_cursors(placed, at(edge)).first()) == (1, 1, edge, True)
    assert tuple(log.conservative_cursors(placed, at(edge + 1)).first()) == (1, 1, 16, False)
    assert tuple(log.conservative_cursors(placed, at(edge).where("false")).first()) == (1, 1, 16, False)


def test_offsets_are_running_sums(spark):
    placed = log.assign_segments(events(spark, *range(30)), LogLimits(segment_max_records=4))
    again = log.offsets_within(placed.drop("start_offset"))
    assert placed.join(again.select("seq", F.col("start_offset").alias("o")), "seq").where("o <> start_offset").count() == 0


def test_gaps(spark):
    ids = spark.createDataFrame([(i,) for i in (3, 3, 4, 8, 9, 12)], "s long")
    assert sorted(map(tuple, log.segment_gaps(ids, "s").collect())) == [(5, 7), (10, 11)]
    assert log.segment_gaps(ids.where("s < 5"), "s").count() == 0 and log.segment_gaps(ids.where("false"), "s").count() == 0


def test_only_the_head_with_its_bytes_is_removed(spark):
    pending = events(spark, 7, 8)
    asked = pending.withColumn("encoded", F.when(F.col("seq") == 9, "x").otherwise(F.col("encoded")))
    assert [r["removed"] for r in log.remove_head(pending, asked).orderBy("seq").collect()] == [True, False]
    assert not log.remove_head(pending, asked.withColumn("encoded", F.lit("x"))).where("removed").count()
    assert log.heads(pending).first()["message_id"] == "event-7"


def test_recovered_rows_go_first(spark):
    out = log.recovered_then_new(events(spark, 5, 6).withColumn("seq", F.col("seq") + 10), events(spark, 7, 8))
    assert [r["message_id"] for r in out.orderBy("fifo_pos").collect()] == ["event-5", "event-6", "event-7", "event-8"]


def test_verification_counts_lost_and_changed_rows(spark):
    e = events(spark, 1, 2, 3)
    w = e.where("seq > 0").withColumn("encoded", F.when(F.col("seq") == 2, "x").otherwise(F.col("encoded")))
    assert tuple(log.verify_written(w, e).first()) == (1, 3, 2, 1)
    assert log.duplicate_ids(events(spark, 1, 1, 2)).first()["message_id"] == "event-1"


def test_head_of_line_blocks(spark):
    e = events(spark, 1, 2, 3, 4)
    got = acks.completed_prefix(e, F.col("message_id").isin("event-1", "event-3")).first()
    assert tuple(got) == (1, 4, 1, 1, 1)
    assert tuple(acks.completed_prefix(e, F.lit(True)).first()) == (1, 4, 4, None, 0)


def test_acks_count_within_their_attempt_only(spark):
    a = spark.createDataFrame([("a", 10)], "message_id string, started int")
    k = spark.createDataFrame([("a", 9), ("a", 10), ("a", 12), ("a", 13), ("b", 10)], "message_id string, acked int")
    assert [r["kind"] for r in acks.classify_acks(a, k, F.lit(3)).orderBy("message_id", "acked").collect()] == ["early", "valid", "valid", "late", "unmatched"]


def test_bounded_intake_drops_the_newest(spark):
    rows = spark.createDataFrame([("t", 0, 1), ("t", 0, 2), ("t", 1, 3), ("u", 0, 4)], "route string, batch_id int, seq long")
    assert {r["seq"]: r["admitted"] for r in acks.bounded_intake(rows, 1).collect()} == {1: True, 2: False, 3: True, 4: True}
