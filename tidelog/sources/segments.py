"""The segmented binary log as a source and a sink.

A segment file is a header (magic and number) and records of magic, length, CRC-32 and text.
Reading lists the folder with Spark's ``binaryFile`` source, so any file system that Spark reads
will do, and takes frames apart in Arrow batches; a segment is bounded by the log's limits.
Nothing is dropped: damage is a row with ``error``. In the last segment an incomplete record at
the end is ``torn``, which a recovery may cut off; anywhere else it is an error.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.codec import decode_rows
from tidelog.operators.log import at_or_after
from tidelog.session import save

#: Fixed by the file format.
SEGMENT_MAGIC, RECORD_MAGIC = b"RLMQSEG1", b"MSG1"
SEGMENT_FORMAT, RECORD_FORMAT = struct.Struct(">8sQ"), struct.Struct(">4sII")
FILE_NAME = r"segment-(\d{20})\.dat$"
FRAMES = "segment_id long, start_offset long, end_offset long, crc32 long, encoded string, error string"


def segment_name(segment_id: Column) -> Column:
    return F.concat(F.lit("segment-"), F.lpad(segment_id.cast("string"), 20, "0"), F.lit(".dat"))


def frame(encoded: Column) -> Column:
    """The bytes of a record: magic, length and checksum as big-endian words, then the text."""
    body = F.encode(encoded, "UTF-8")
    word = lambda n: F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0"))
    return F.concat(F.lit(bytearray(RECORD_MAGIC)), word(F.octet_length(encoded)), word(F.crc32(body)), body)


def segment_header(segment_id: Column) -> Column:
    return F.concat(F.lit(bytearray(SEGMENT_MAGIC)), F.unhex(F.lpad(F.hex(segment_id.cast("long")), 16, "0")))


def walk(number: int, data: bytes, last: bool) -> Iterator[tuple]:
    """Rows of ``FRAMES`` for one segment; stops at the first damage."""
    bad = lambda at, error: (number, at, len(data), None, None, error)
    at = SEGMENT_FORMAT.size
    if len(data) < at or SEGMENT_FORMAT.unpack_from(data) != (SEGMENT_MAGIC, number):
        yield bad(0, "torn" if last and len(data) < at else "header")
        return
    while at < len(data):
        if len(data) - at < RECORD_FORMAT.size:
            yield bad(at, "torn" if last else "incomplete")
            return
        magic, size, check = RECORD_FORMAT.unpack_from(data, at)
        if magic != RECORD_MAGIC:
            yield bad(at, "magic")
            return
        end = at + RECORD_FORMAT.size + size
        if end > len(data):
            yield bad(at, "torn" if last else "incomplete")
            return
        body = data[at + RECORD_FORMAT.size : end]
        if crc32(body) != check:
            yield bad(at, "checksum")
            return
        try:
            text, error = body.decode("utf-8"), None
        except UnicodeDecodeError:
            text, error = None, "not_utf8"
        yield number, at, end, check, text, error
        at = end


def frames_of(files: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Every record of the segments ``files`` (keys, number, content, newest), and a row for each damage."""
    names, kinds = [x.split()[0] for x in FRAMES.split(", ")], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    own = "".join(f"`{k}` {dict(files.dtypes)[k]}, " for k in keys)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (number, newest) in enumerate(zip(batch.column("number").to_pylist(), batch.column("newest").to_pylist())):
                rows = list(walk(number, batch.column("content")[i].as_py(), newest))
                if rows:
                    at = pa.array([i] * len(rows), pa.int64())
                    yield pa.RecordBatch.from_pydict({k: batch.column(k).take(at) for k in keys} | {n: pa.array(c, k) for n, k, c in zip(names, kinds, zip(*rows))})

    return files.select(*keys, "number", "content", "newest").mapInArrow(frames, own + FRAMES)


def read_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of every segment of ``folder``, and a row for each damage."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "segment-*.dat").load(folder)
    number = F.regexp_extract("path", FILE_NAME, 1)
    files = files.select(F.when(number != "", number).cast("long").alias("number"), "content").where("number IS NOT NULL")
    newest = files.agg(F.max("number")).first()[0]
    return frames_of(files.withColumn("newest", F.col("number") == F.lit(newest).cast("long")))


def recovered(frames: DataFrame, cursors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a scan of segments brings back: the sound rows at or after their sender's cursor, and a report per sender.

    ``frames`` as ``frames_of`` by ``sender_id``, ``cursors`` (sender_id, segment_id,
    byte_offset). The report has records, replayed, error (the first damage that is none of an
    unfinished write), torn, duplicates (ids found more than once) and missing (closed segments
    that are not there, from the cursor's or the first on); a log is sound if error is null and
    duplicates and missing are 0. The frames run once: what they hold is written to a table that
    the rows and both counts of the report read.
    """
    found = decode_rows(frames, F.col("encoded")).select(*frames.columns, "d.message_id", "d.ok")
    marks = cursors.select("sender_id", F.col("segment_id").alias("at_segment"), F.col("byte_offset").alias("at_offset"))
    rows = save(found.join(marks, "sender_id", "left"), "recovered-frames")
    after = F.col("at_segment").isNull() | at_or_after(F.col("segment_id"), F.col("start_offset"), F.col("at_segment"), F.col("at_offset"))
    sound = F.col("error").isNull() & F.col("ok")
    bad = F.when(F.col("error") != "torn", F.col("error")).when(F.col("error").isNull() & ~F.col("ok"), F.lit("envelope"))
    first_bad = F.min(F.when(bad.isNotNull(), F.struct("segment_id", "start_offset", bad.alias("error"))))
    each = rows.groupBy("sender_id", "segment_id").agg(
        F.count_if(sound).alias("records"), F.count_if(sound & after).alias("replayed"), first_bad.alias("bad"), F.max(F.coalesce(F.col("error") == "torn", F.lit(False))).alias("torn"), F.min("at_segment").alias("at_segment"),
    )
    inner = F.col("segment_id") >= F.coalesce("at_segment", F.lit(0))
    report = each.groupBy("sender_id").agg(
        F.sum("records").alias("records"), F.sum("replayed").alias("replayed"), F.min("bad").alias("bad"), F.max("torn").alias("torn"),
        F.greatest(F.max("segment_id") - F.coalesce(F.min("at_segment"), F.min("segment_id")) + 1 - F.count_if(inner), F.lit(0)).alias("missing"),
    )
    copies = rows.where(sound & after).groupBy("sender_id", "message_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").groupBy("sender_id").agg(F.count(F.lit(1)).alias("duplicates"))
    report = report.join(copies, "sender_id", "left").select("sender_id", "records", "replayed", F.col("bad.error").alias("error"), "torn", F.coalesce("duplicates", F.lit(0)).alias("duplicates"), "missing")
    return rows.where(sound & after).select("sender_id", "segment_id", "start_offset", "end_offset", "message_id", "encoded"), report


def missing_segments(frames: DataFrame, first: int) -> DataFrame:
    """Segment numbers from ``first`` to the newest that have no file; closed segments must not be missing."""
    have = frames.select("segment_id").distinct()
    want = have.agg(F.max("segment_id").alias("m")).where(F.col("m") >= first).select(F.explode(F.sequence(F.lit(first), "m")).alias("segment_id"))
    return want.join(have, "segment_id", "left_anti")


def segment_files(placed: DataFrame) -> DataFrame:
    """(sender_id, segment_id, name, content) of placed rows; a segment's size is bounded by the limits."""
    records = F.transform(F.array_sort(F.collect_list(F.struct("start_offset", frame(F.col("encoded")).alias("bytes")))), lambda r: r["bytes"])
    bodies = placed.groupBy("sender_id", "segment_id").agg(records.alias("records"))
    content = F.aggregate("records", segment_header(F.col("segment_id")), lambda a, b: F.concat(a, b))
    return bodies.select("sender_id", "segment_id", segment_name(F.col("segment_id")).alias("name"), content.alias("content"))
