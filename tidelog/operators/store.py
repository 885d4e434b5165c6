"""The log as a Parquet table: durable append, lookup, verified reads, cursors and compaction.

A stored row has ``sender_id``, ``seq``, ``message_id``, ``encoded``, its place (``segment_id``,
``start_offset``, ``end_offset``) and ``crc32`` of its text. One append is one commit: readers see
all of its rows or none. Appends to one folder must not run at the same time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.config import LogLimits
from tidelog.errors import LogError
from tidelog.functions.codec import canonical_json, canonical_text, record_size
from tidelog.operators.folds import RotationOn, ordered_fold
from tidelog.operators.log import append_verdicts, conservative_cursors, dedup_batch, heads, retention, segment_stats
from tidelog.session import drop, save

STORED = "sender_id long, seq long, message_id string, encoded string, segment_id long, start_offset long, end_offset long, crc32 long"
#: Fixed by the file format of a cursor: its keys, in order of canonical JSON, and its version.
CURSOR_KEYS = ("byte_offset", "generation", "segment_id", "version")
CURSOR_VERSION = 1
_CURSOR = r'\A\s*\{\s*' + r"\s*,\s*".join([r'"(\w+)"\s*:\s*(0|[1-9][0-9]{0,17})'] * 4) + r"\s*\}\s*\z"


def checksum(encoded: Column) -> Column:
    return F.crc32(F.encode(encoded, "UTF-8"))


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """The stored rows; none if nothing was appended yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(STORED).parquet(folder) if there else spark.createDataFrame([], STORED)


def placed_after(stored: DataFrame, new: DataFrame, limits: LogLimits) -> DataFrame:
    """``new`` with the place of each row behind the last of its sender in ``stored``."""
    last = stored.groupBy("sender_id", "segment_id").agg(F.max("end_offset").alias("end"), F.count(F.lit(1)).alias("records")).groupBy("sender_id").agg(F.max(F.struct("segment_id", "end", "records")).alias("l"))
    base = last.select("sender_id", F.col("l.segment_id").alias("on_segment"), F.col("l.end").alias("on_end"), F.col("l.records").alias("on_records"))
    sized = new.withColumn("frame_size", record_size(F.col("encoded"))).join(base, "sender_id", "left")
    out = ordered_fold(sized, ["sender_id"], ["seq"], lambda: RotationOn(limits.segment_max_records, limits.segment_max_bytes))
    return out.drop("on_segment", "on_end", "on_records")


def append(spark: SparkSession, folder: str, batch: DataFrame, limits: LogLimits = LogLimits(), on_conflict: str = "error") -> DataFrame:
    """Append rows (sender_id, seq, message_id, encoded) that are not there yet, as one commit.

    An id that is there with the same bytes is passed over, one with other bytes is an error, as
    are two rows of the batch with one id and different bytes (with ``on_conflict`` ignore both
    are passed over, and the first of the batch counts). Returns a row per sender with
    appended_count, bytes_written, rotated (a segment was begun behind another) and skipped.
    """
    stored = read_log(spark, folder)
    judged = save(append_verdicts(stored, dedup_batch(batch.select("sender_id", "seq", "message_id", "encoded")), on_conflict), "append-verdicts")
    if on_conflict == "error":
        bad = judged.where(F.col("conflict") | (F.col("verdict") == "conflict")).select("message_id").limit(1).collect()
        if bad:
            drop(judged)
            raise LogError(f"conflicting content for {bad[0][0]}")
    new = judged.where("verdict = 'new'").select("sender_id", "seq", "message_id", "encoded")
    placed = save(placed_after(stored, new, limits).withColumn("crc32", checksum(F.col("encoded"))), "append-rows")
    before = stored.groupBy("sender_id").agg(F.max("segment_id").alias("was"))
    written = placed.groupBy("sender_id").agg(F.count(F.lit(1)).alias("appended_count"), F.sum("frame_size").alias("bytes_written"), F.max("segment_id").alias("now"), F.min("segment_id").alias("low"))
    skipped = judged.groupBy("sender_id").agg(F.count_if(F.col("verdict") != "new").alias("skipped"))
    result = save(
        skipped.join(written, "sender_id", "left").join(before, "sender_id", "left")
        .select("sender_id", F.coalesce("appended_count", F.lit(0)).alias("appended_count"), F.coalesce("bytes_written", F.lit(0)).alias("bytes_written"), F.coalesce(F.col("now") > F.coalesce("was", "low"), F.lit(False)).alias("rotated"), "skipped"),
        "append-result",
    )
    placed.select(*(c.split()[0] for c in STORED.split(", "))).write.mode("append").parquet(folder)
    drop(judged, placed)
    return result


def lookup(stored: DataFrame, message_id: str) -> DataFrame:
    """The rows of one id; the filter reaches the scan."""
    return stored.where(F.col("message_id") == message_id)


def lookup_all(stored: DataFrame, ids: DataFrame) -> DataFrame:
    """Each id of ``ids`` (message_id) with ``found`` and its text, verified."""
    rows = verified(stored).select("message_id", "encoded", "error")
    return ids.select("message_id").distinct().join(rows, "message_id", "left").select("message_id", F.col("encoded").isNotNull().alias("found"), "encoded", "error")


def verified(stored: DataFrame) -> DataFrame:
    """Rows with ``error``: null, ``checksum`` if the text is not what was written, ``size`` or ``id`` if it does not fit its place or its id."""
    fits = F.col("end_offset") - F.col("start_offset") == record_size(F.col("encoded"))
    own = F.col("encoded").startswith(F.concat(F.lit('{"event_id":"'), F.col("message_id"), F.lit('"')))
    error = F.when(checksum(F.col("encoded")) != F.col("crc32"), "checksum").when(~fits, "size").when(~own, "id")
    return stored.withColumn("error", error)


def encode_cursor(generation: Column, segment_id: Column, byte_offset: Column) -> Column:
    """The canonical text of a cursor."""
    return F.format_string('{"byte_offset":%d,"generation":%d,"segment_id":%d,"version":1}', byte_offset.cast("long"), generation.cast("long"), segment_id.cast("long"))


def decode_cursor(text: Column) -> Column:
    """(generation, segment_id, byte_offset) of a cursor's text in any order of keys; null unless it has exactly these keys, whole numbers that are not negative, and version 1."""
    names, values = (F.array(*(F.regexp_extract(text, _CURSOR, 2 * i + k) for i in range(4))) for k in (1, 2))
    found = F.map_from_arrays(names, values)
    sound = F.array_sort(names) == F.array(*map(F.lit, CURSOR_KEYS))
    of = lambda key: F.when(sound, found[key]).cast("long")
    parts = F.struct(of("generation").alias("generation"), of("segment_id").alias("segment_id"), of("byte_offset").alias("byte_offset"))
    return F.when(text.rlike(_CURSOR) & sound & (of("version") == CURSOR_VERSION), parts)


def read_cursors(placed: DataFrame, texts: DataFrame) -> DataFrame:
    """Each sender's cursor from rows (sender_id, text): as written if it is sound and on a record's edge, else the first position, generation 0 and ``valid`` false."""
    parsed = texts.withColumn("c", decode_cursor(F.col("text"))).where("c IS NOT NULL").select("sender_id", "c.*")
    out = conservative_cursors(placed, parsed.drop("generation")).join(parsed.select("sender_id", "generation"), "sender_id", "left")
    return out.withColumn("generation", F.when(F.col("valid"), F.col("generation")).otherwise(F.lit(0)).cast("long"))


def live_cursors(placed: DataFrame, pending: DataFrame) -> DataFrame:
    """Each sender's position: the start of its oldest pending row, else the end of its active segment."""
    head = heads(pending.select("sender_id", "seq", "segment_id", "start_offset")).select("sender_id", F.struct("segment_id", F.col("start_offset").alias("byte_offset")).alias("head"))
    end = placed.groupBy("sender_id").agg(F.max(F.struct("segment_id", F.col("end_offset").alias("byte_offset"))).alias("end"))
    return end.join(head, "sender_id", "left").select("sender_id", F.coalesce("head", "end").alias("p")).select("sender_id", "p.*")


def closed_behind(placed: DataFrame, cursors: DataFrame) -> DataFrame:
    """Per sender whether a closed segment lies wholly behind the cursor, which calls for a checkpoint."""
    gone = retention(segment_stats(placed), cursors).select("sender_id").distinct().withColumn("behind", F.lit(True))
    return cursors.select("sender_id").join(gone, "sender_id", "left").select("sender_id", F.coalesce("behind", F.lit(False)).alias("behind"))


def compact(placed: DataFrame, pending: DataFrame, cursors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cursor texts of the next generation, and the stored rows without the segments they leave behind.

    ``cursors`` are those that stand (sender_id, generation, segment_id, byte_offset); one that
    does not move keeps its generation. Rows of a segment that stays are not rewritten.
    """
    old = cursors.select("sender_id", F.struct("segment_id", "byte_offset").alias("old"), "generation")
    rows = live_cursors(placed, pending).join(old, "sender_id", "left")
    moved = F.coalesce(F.struct("segment_id", "byte_offset") != F.col("old"), F.lit(True))
    generation = F.coalesce("generation", F.lit(0)) + moved.cast("int")
    now = rows.select("sender_id", "segment_id", "byte_offset", generation.cast("long").alias("generation"))
    gone = retention(segment_stats(placed), now).select("sender_id", "segment_id")
    texts = now.select("sender_id", encode_cursor(F.col("generation"), F.col("segment_id"), F.col("byte_offset")).alias("text"))
    return texts, placed.join(gone, ["sender_id", "segment_id"], "left_anti")


def valid_format(text: Column, name: str, version: int = 1) -> Column:
    """True for the metadata of a log of this format: exactly ``format`` and ``version``, in any order and spacing."""
    return F.coalesce(canonical_json(text) == F.lit(canonical_text({"format": name, "version": version})), F.lit(False))
