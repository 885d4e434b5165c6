"""The old line journal: bare envelopes, or enqueue and ack records of version 1.

Lines that do not decode are kept as ``corrupt`` and change nothing. The replay is an ordered
fold of one file, the size of a migration.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.errors import ProtocolError
from tidelog.functions.codec import canonical_text, decode_one, parse_strict
from tidelog.operators.folds import JournalReplay, ordered_fold
from tidelog.session import save

RECORD = "seq long, op string, message_id string, encoded string"


def parse_line(line: str) -> tuple[str, str | None, str | None]:
    """(op, message id, canonical envelope) of a line; op is ``corrupt`` for what is none."""
    corrupt = ("corrupt", None, None)
    try:
        value = parse_strict(line)
    except ProtocolError:
        return corrupt
    if type(value) is dict and ("journal_version" in value or "op" in value):
        version, op = value.get("journal_version"), value.get("op")
        if version != 1 or type(version) is not int:
            return corrupt
        if op == "ack" and set(value) == {"journal_version", "op", "message_id"}:
            ok, found, *_ = decode_one(canonical_text({"version": 1, "event_id": value["message_id"]}), "ack")
            return ("ack", found, None) if ok else corrupt
        if op != "enqueue" or set(value) != {"journal_version", "op", "envelope"}:
            return corrupt
        value = value["envelope"]
    try:
        text = canonical_text(value)
    except ProtocolError:
        return corrupt
    ok, found, *_ = decode_one(text, "message")
    return ("enqueue", found, text) if ok else corrupt


def parse_journal(lines: DataFrame, keys: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``keys`` and ``RECORD`` from (keys, seq, line)."""
    own = "".join(f"`{k}` {dict(lines.dtypes)[k]}, " for k in keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            parsed = [parse_line(x) for x in f["line"]]
            yield pd.DataFrame({k: f[k] for k in keys} | {"seq": f["seq"], "op": [p[0] for p in parsed], "message_id": [p[1] for p in parsed], "encoded": [p[2] for p in parsed]})

    return lines.select(*keys, "seq", "line").mapInPandas(run, own + RECORD)


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """(seq, line) of a journal file; lines that are not empty are numbered as they stand.

    Spark splits the file. A line's number is its place in its split and the lines of the splits
    before, of which there is one number each.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    kept = save(rows.where("value <> ''"), "journal-lines")
    blocks = kept.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per split
    place = F.row_number().over(Window.partitionBy("block").orderBy("at"))
    return kept.withColumn("place", place).join(F.broadcast(blocks.select("block", before.alias("before"))), "block").select((F.col("before") + F.col("place") - 1).cast("long").alias("seq"), F.col("value").alias("line"))


def replay_journal(records: DataFrame, keys: list[str]) -> DataFrame:
    """Records with the replay's verdict, per journal."""
    return ordered_fold(records, keys, ["seq"], JournalReplay)


def journal_pending(replayed: DataFrame, keys: list[str]) -> DataFrame:
    """What is pending after the replay: enqueued and never completed."""
    done = replayed.where("completes IS NOT NULL").select(*keys, F.col("completes").alias("seq"))
    return replayed.where("verdict = 'enqueued'").join(done, [*keys, "seq"], "left_anti").drop("verdict", "completes")


def journal_lines(log: DataFrame, op: str = "enqueue", keys: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """(keys, seq, line) that an enqueue or ack journal would have for rows of (keys, seq, message_id, encoded)."""
    line = F.concat(F.lit('{"envelope":'), F.col("encoded"), F.lit(',"journal_version":1,"op":"enqueue"}'))
    if op == "ack":
        line = F.concat(F.lit('{"journal_version":1,"message_id":"'), F.col("message_id"), F.lit('","op":"ack"}'))
    return log.select(*keys, "seq", line.alias("line"))


def migrated(lines: DataFrame, keys: list[str]) -> DataFrame:
    """The pending rows (keys, seq, message_id, encoded) of journals given as (keys, seq, line), ready to be appended to a log."""
    parsed = parse_journal(lines, keys)
    return journal_pending(replay_journal(parsed, keys), keys).select(*keys, "seq", "message_id", "encoded")
