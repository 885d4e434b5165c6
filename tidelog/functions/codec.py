"""Canonical JSON, and encoding and strict decoding of the three envelopes.

Canonical text has sorted keys, no spaces, characters as they are and finite numbers. Spark's
VARIANT writes exactly that for text with whole numbers, booleans, nulls and plain strings; any
other text (fractions, exponents, long integers, escapes, characters beyond the basic plane,
deep nesting) takes an Arrow-batched function, so that bytes are exact. Rows of the first kind
are null in the batches of the second.

Decoding works alike: a wire text that is already canonical is taken apart by one pattern and
checked by re-encoding its payload; any other is decoded strictly in Arrow batches, which gives
the error class of what is rejected. A null id is rejected.
"""

from __future__ import annotations

import json
import re
from math import isfinite

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from tidelog.config import valid_topic as topic_ok
from tidelog.errors import ProtocolError

#: Fixed by the protocol: the key sets of the envelopes and the one version.
KEYS = {"message": {"version", "event_id", "topic", "payload"}, "delivery": {"version", "event_id", "payload"}, "ack": {"version", "event_id"}}
VERSION = 1
#: Bytes of the header that a log record has before its text.
RECORD_HEADER = 12
DECODED = StructType([StructField("ok", BooleanType()), *(StructField(c, StringType()) for c in ("message_id", "topic", "payload_json", "error"))])

_ID = re.compile(r"[A-Za-z0-9_-]{1,128}")
#: Text that VARIANT may write in other bytes; it may also match inside strings, which then take the exact way.
_INEXACT = r"[0-9][.eE]|[0-9]{18}|-0|\\|[\x{10000}-\x{10FFFF}]|[\x00-\x09\x0B\x0C\x0E-\x1F\x7F]|\[\s*\[\s*\[\s*\[\s*\[|(?:\{[^{}]*){9}"


def canonical_text(value: object) -> str:
    """The canonical JSON of a Python value."""
    try:
        out = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
        out.encode("utf-8")
    except (ValueError, TypeError, RecursionError, UnicodeEncodeError) as error:
        raise ProtocolError(f"not a JSON value: {error}") from None
    return out


def _unique(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ProtocolError("duplicate key")
    return out


def _no_constant(name: str) -> object:
    raise ProtocolError(f"constant {name}")


def _finite(text: str) -> float:
    value = float(text)
    if not isfinite(value):
        raise ProtocolError("number out of range")
    return value


def parse_strict(text: str) -> object:
    """JSON without duplicate keys, constants that are no numbers, overflow or trailing text."""
    try:
        return json.loads(text, object_pairs_hook=_unique, parse_constant=_no_constant, parse_float=_finite)
    except RecursionError:
        raise ProtocolError("nested too deep") from None
    except json.JSONDecodeError as error:
        raise ProtocolError(f"not JSON: {error.msg}") from None


def decode_one(raw: str | None, kind: str) -> tuple[bool, str | None, str | None, str | None, str | None]:
    """(ok, id, topic, canonical payload, error class) of one wire text."""
    bad = lambda error: (False, None, None, None, error)
    if raw is None:
        return bad("null")
    try:
        value = parse_strict(raw)
    except ProtocolError as error:
        return bad("duplicate_key" if "duplicate" in str(error) else "not_finite" if "constant" in str(error) or "range" in str(error) else "not_json")
    if type(value) is not dict:
        return bad("not_object")
    if set(value) != KEYS[kind]:
        return bad("missing_key" if KEYS[kind] - set(value) else "extra_key")
    if type(value["version"]) is not int or value["version"] != VERSION:
        return bad("version")
    if type(value["event_id"]) is not str or not _ID.fullmatch(value["event_id"]):
        return bad("id")
    if kind == "message" and not topic_ok(value["topic"]):
        return bad("topic")
    try:
        payload = canonical_text(value["payload"]) if "payload" in value else None
    except ProtocolError:
        return bad("payload")
    return True, value["event_id"], value.get("topic"), payload, None


@F.pandas_udf(StringType())
def _exact(texts: pd.Series) -> pd.Series:
    def one(text: str | None) -> str | None:
        try:
            return None if text is None else canonical_text(parse_strict(text))
        except ProtocolError:
            return None

    return texts.map(one)


def _decoder(kind: str):
    @F.pandas_udf(DECODED)
    def decode(raw: pd.Series) -> pd.DataFrame:
        rows = [decode_one(x, kind) for x in raw]
        return pd.DataFrame(rows, columns=["ok", "message_id", "topic", "payload_json", "error"])

    return decode


_decoders = {kind: _decoder(kind) for kind in KEYS}


def plain(text: Column) -> Column:
    """True if VARIANT writes ``text`` in canonical bytes."""
    return F.coalesce(~text.rlike(_INEXACT), F.lit(False))


def variant_json(text: Column) -> Column:
    """Canonical JSON of plain text; null if it does not parse. Trailing text is not noticed."""
    return F.to_json(F.try_parse_json(text))


def is_easy(text: Column) -> Column:
    """True if ``variant_json`` gives the canonical JSON of ``text``."""
    # what VARIANT accepts beyond strict JSON (trailing text, single quotes) ends otherwise than it began, or holds a quote
    closed = ~text.contains("'") & (F.length(F.regexp_replace(text, r'"[^"]*"|[\s]', "")) <= F.length(F.regexp_replace(variant_json(text), r'"[^"]*"', "")))
    return plain(text) & F.coalesce(closed, F.lit(False))


def canonical_json(text: Column) -> Column:
    """Canonical JSON of any JSON text; null for what is not strict JSON."""
    easy = is_easy(text)
    return F.coalesce(F.when(easy, variant_json(text)), _exact(F.when(~easy, text)))


def with_canonical(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with the JSON text of ``column`` made canonical; only rows that need the exact way go to Python."""
    easy = F.coalesce(is_easy(F.col(column)), F.lit(False))
    return rows.where(easy).withColumn(column, variant_json(F.col(column))).unionByName(rows.where(~easy).withColumn(column, _exact(F.col(column))))


def quoted(text: Column) -> Column:
    """A JSON string of text without control characters, quotes and backslashes (ids and valid topics often are)."""
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def encode_message(message_id: Column, topic: Column, payload_json: Column) -> Column:
    """Canonical text of a message; ``payload_json`` must be canonical."""
    return F.concat(F.lit('{"event_id":'), quoted(message_id), F.lit(',"payload":'), payload_json, F.lit(',"topic":'), quoted(topic), F.lit(',"version":1}'))


def encode_delivery(message_id: Column, payload_json: Column) -> Column:
    """Canonical text of a delivery, which has no topic."""
    return F.concat(F.lit('{"event_id":'), quoted(message_id), F.lit(',"payload":'), payload_json, F.lit(',"version":1}'))


def encode_ack(message_id: Column) -> Column:
    return F.concat(F.lit('{"event_id":'), quoted(message_id), F.lit(',"version":1}'))


def record_size(encoded: Column) -> Column:
    """Bytes that a record takes in the log."""
    return (F.octet_length(encoded) + RECORD_HEADER).cast("long")


#: Taken apart by these when the text is canonical; a topic with a quote or a backslash takes the exact way.
_CANONICAL = {
    "message": r'(?s)\A\{"event_id":"([A-Za-z0-9_-]{1,128})","payload":(.*),"topic":"([^"\\]+)","version":1\}\z',
    "delivery": r'(?s)\A\{"event_id":"([A-Za-z0-9_-]{1,128})","payload":(.*),"version":1\}\z',
    "ack": r'\A\{"event_id":"([A-Za-z0-9_-]{1,128})","version":1\}\z',
}


def _parts(text: Column, kind: str) -> dict[str, Column]:
    """What the pattern of canonical text takes apart; empty strings where it does not fit."""
    null = F.lit(None).cast("string")
    take = lambda group: F.regexp_extract(text, _CANONICAL[kind], group)
    return {"message_id": take(1), "payload": take(2) if kind != "ack" else null, "topic": take(3) if kind == "message" else null}


def _fits(text: Column, parts: dict[str, Column], kind: str) -> Column:
    """True for text that is canonical already and valid."""
    from tidelog.functions.validity import valid_topic

    fits = F.is_valid_utf8(text) & (parts["message_id"] != "")  # the pattern's id is never empty
    if kind != "ack":
        fits = fits & plain(parts["payload"]) & (variant_json(parts["payload"]) == parts["payload"])
    if kind == "message":
        fits = fits & plain(parts["topic"]) & valid_topic(parts["topic"])
    return F.coalesce(fits, F.lit(False))


def _good(parts: dict[str, Column]) -> Column:
    return F.struct(F.lit(True).alias("ok"), parts["message_id"].alias("message_id"), parts["topic"].alias("topic"), parts["payload"].alias("payload_json"), F.lit(None).cast("string").alias("error"))


def _other(text: Column, kind: str) -> Column:
    """The struct of a text that is not canonical and valid."""
    null = F.lit(None).cast("string")
    utf8 = F.coalesce(F.is_valid_utf8(text), F.lit(True))
    broken = F.struct(F.lit(False).alias("ok"), null.alias("message_id"), null.alias("topic"), null.alias("payload_json"), F.lit("not_utf8").alias("error"))
    return F.when(~utf8, broken).otherwise(_decoders[kind](F.when(utf8, text)))


def decode(raw: Column, kind: str = "message") -> Column:
    """A struct of ``DECODED`` for each wire text (string, or binary taken as UTF-8)."""
    text = raw.cast("string")
    parts = _parts(text, kind)
    fits = _fits(text, parts, kind)
    return F.when(fits, _good(parts)).otherwise(_other(F.when(~fits, text), kind))


def decode_rows(rows: DataFrame, raw: Column, kind: str = "message", name: str = "d") -> DataFrame:
    """``rows`` with the struct of ``decode``, computed step by step so that no pattern is matched more than once.

    Rows are not split as in ``with_canonical``: both parts would match the patterns again, which
    costs more than the nulls that canonical rows send to Python.
    """
    text, fits = F.col("_text"), F.col("_fits")
    staged = rows.withColumn("_text", raw.cast("string"))
    staged = staged.withColumns({f"_{k}": c for k, c in _parts(text, kind).items()})
    parts = {k: F.col(f"_{k}") for k in ("message_id", "payload", "topic")}
    staged = staged.withColumn("_fits", _fits(text, parts, kind))
    return staged.withColumn(name, F.when(fits, _good(parts)).otherwise(_other(F.when(~fits, text), kind))).select(*rows.columns, name)
