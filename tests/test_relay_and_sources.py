import json
import struct
from pathlib import Path
from zlib import crc32

from pyspark.sql import functions as F

from tidelog.config import LogLimits
from tidelog.operators.log import assign_segments
from tidelog.operators.relay import acks_of, forward, relay_batch
from tidelog.session import get_spark
from tidelog.sources.journal import journal_lines, journal_pending, parse_journal, read_journal, replay_journal
from tidelog.sources.mqtt import confirmed_publish, mqtt_source
from tidelog.sources.segments import missing_segments, read_segments, segment_files
from tests.test_log import events


def wire(spark, *texts, topic="relay"):
    return spark.createDataFrame([(topic, t) for t in texts], "topic string, value string")


def message(name, topic="factory/data", payload=1):
    return json.dumps({"event_id": name, "payload": payload, "topic": topic, "version": 1}, separators=(",", ":"))


def test_forward_projects_and_rejects(spark):
    out = forward(wire(spark, message("a"), "junk", message("a")), "relay")
    assert [tuple(r) for r in out.deliveries.collect()] == [("factory/data", "a", '{"event_id":"a","payload":1,"version":1}')] * 2
    assert out.rejects.first()["error"] == "not_json"
    assert forward(wire(spark, message("a"), topic="other"), "relay").deliveries.count() == 0
    assert acks_of(out.deliveries).count() == 2


def run_relay(spark, rows, confirm):
    log = []

    def publish(deliveries):
        out = deliveries.withColumn("confirmed", confirm)
        log.append(("destination", sorted(r["message_id"] for r in out.collect())))
        return out

    relay_batch(publish, lambda a: log.append(("ack", sorted(r["message_id"] for r in a.collect()))), lambda r: log.append(("reject", r.count())))(rows, 0)
    return log


def test_acknowledgements_follow_confirmed_deliveries_only(spark):
    rows = wire(spark, message("a"), message("b"), "junk")
    assert run_relay(spark, rows, F.lit(True)) == [("destination", ["a", "b"]), ("ack", ["a", "b"]), ("reject", 1)]
    assert run_relay(spark, rows, F.col("message_id") == "b")[1] == ("ack", ["b"])
    assert run_relay(spark, rows, F.lit(False))[1] == ("ack", [])


def test_a_crash_between_the_writes_replays_under_the_same_id(spark):
    sent, acked, broken = [], [], [True]

    def acknowledge(a):
        if broken.pop() if broken else False:
            raise RuntimeError("crash")
        acked.extend(r["message_id"] for r in a.collect())

    each = relay_batch(lambda d: (sent.extend(r["message_id"] for r in d.collect()), d.withColumn("confirmed", F.lit(True)))[1], acknowledge)
    for _ in range(2):
        try:
            each(wire(spark, message("a")), 0)
        except RuntimeError:
            pass
    assert sent == ["a", "a"] and acked == ["a"]


def written(spark, folder, ns=(1, 2, 3, 4, 5), records=2):
    placed = assign_segments(events(spark, *ns), LogLimits(segment_max_records=records))
    for r in segment_files(placed).collect():
        (Path(folder) / r["name"]).write_bytes(bytes(r["content"]))
    return placed


def read(spark, folder):
    return [(r["segment_id"], r["start_offset"], r["encoded"], r["error"]) for r in read_segments(spark, f"file://{folder}").orderBy("segment_id", "start_offset").collect()]


def test_segments_round_trip_byte_exact(spark, tmp_path):
    placed = written(spark, tmp_path)
    want = [(r["segment_id"], r["start_offset"], r["encoded"], None) for r in placed.orderBy("seq").collect()]
    assert read(spark, tmp_path) == want
    data = (tmp_path / "segment-00000000000000000001.dat").read_bytes()
    text = want[0][2].encode()
    assert data.startswith(struct.pack(">8sQ", b"RLMQSEG1", 1) + struct.pack(">4sII", b"MSG1", len(text), crc32(text)) + text)


def test_damage_is_told_apart(spark, tmp_path):
    written(spark, tmp_path)
    newest, first = (tmp_path / f"segment-{n:020d}.dat" for n in (3, 1))
    whole = newest.read_bytes()
    newest.write_bytes(whole[:-5])
    assert [e for *_, e in read(spark, tmp_path)] == [None] * 4 + ["torn"]
    newest.write_bytes(whole[:-1] + bytes([whole[-1] ^ 1]))
    assert [e for *_, e in read(spark, tmp_path)][-1] == "checksum"
    newest.write_bytes(whole)
    closed = first.read_bytes()
    first.write_bytes(closed[:-5])
    assert [e for n, *_, e in read(spark, tmp_path) if n == 1] == [None, "incomplete"]
    first.write_bytes(b"XX" + closed[2:])
    assert [e for n, *_, e in read(spark, tmp_path) if n == 1] == ["header"]
    (tmp_path / "segment-00000000000000000002.dat").unlink()
    assert [r[0] for r in missing_segments(read_segments(spark, f"file://{tmp_path}"), 1).collect()] == [2]


def test_journals(spark, tmp_path):
    rows = events(spark, 1, 2, 3)
    lines = [r["line"] for r in journal_lines(rows).orderBy("seq").collect()]
    acks = [r["line"] for r in journal_lines(rows, "ack").orderBy("seq").collect()]
    bare = [r["encoded"] for r in rows.orderBy("seq").collect()]

    def pending(*texts):
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.jsonl"
        path.write_text("\n".join(texts))
        records = parse_journal(read_journal(spark, f"file://{path}")).withColumn("journal", F.lit(1))
        return [r["message_id"] for r in journal_pending(replay_journal(records, ["journal"]), ["journal"]).orderBy("seq").collect()]

    assert pending(bare[0], bare[1]) == ["event-1", "event-2"]
    assert pending(lines[0], lines[1], acks[0], lines[2]) == ["event-2", "event-3"]
    assert pending(lines[0], lines[0].replace("enqueue", "other"), lines[1], lines[2][:-9]) == ["event-1", "event-2"]
    assert pending(lines[0], lines[1], acks[1]) == ["event-1", "event-2"]


class Broker:
    """Messages and publications in files, so that every process sees them."""

    def __init__(self, folder):
        self.folder = Path(folder)

    def poll(self, after):
        rows = [line.split("\t", 1) for line in (self.folder / "in").read_text().splitlines()]
        return [(i, t, v) for i, (t, v) in enumerate(rows, 1) if i > after]

    def publish(self, topic, value):
        if topic == "broken":
            raise OSError
        with (self.folder / "out").open("a") as f:
            f.write(f"{topic}\t{value}\n")
        return topic != "refused"


def test_broker_source_and_confirmed_publication(spark, tmp_path):
    folder = str(tmp_path)
    (tmp_path / "in").write_text(f"relay\t{message('a')}\nother\tx\nrelay\t{message('b', 'refused')}\nrelay\t{message('c', 'broken')}\n")
    spark.dataSource.register(mqtt_source("test_broker", lambda: Broker(folder), "relay"))
    acked = []
    each = relay_batch(lambda d: confirmed_publish(d, lambda: Broker(folder)), lambda a: acked.extend(r["message_id"] for r in a.collect()))
    stream = spark.readStream.format("test_broker").load()
    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/state").start()
    q.processAllAvailable()
    q.stop()
    assert acked == ["a"] and (tmp_path / "out").read_text().startswith("factory/data\t")


def test_session_is_shared():
    assert get_spark() is get_spark()
