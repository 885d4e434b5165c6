"""Predicates over ids, topics, versions and reason codes. Null is never valid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed by the protocol: what a message id may be.
ID_PATTERN = r"\A[A-Za-z0-9_-]{1,128}\z"
MAX_TOPIC_BYTES = 65535


def valid_id(value: Column) -> Column:
    return F.coalesce(value.rlike(ID_PATTERN), F.lit(False))


def valid_topic(value: Column) -> Column:
    """Not empty, at most ``MAX_TOPIC_BYTES`` bytes, without wildcards and NUL, and valid UTF-8."""
    clean = ~value.contains("+") & ~value.contains("#") & ~value.contains("\0")
    size = F.octet_length(value)
    return F.coalesce((size > 0) & (size <= MAX_TOPIC_BYTES) & clean & F.is_valid_utf8(value), F.lit(False))


def suback_granted(codes: Column) -> Column:
    """True if every reason code of a subscription grants a quality of service; empty and null are not granted."""
    return F.coalesce((F.size(codes) > 0) & F.forall(codes, lambda c: F.coalesce(c.isin(0, 1, 2), F.lit(False))), F.lit(False))


def reason_ok(code: Column) -> Column:
    """True for the reason code of success."""
    return F.coalesce(code == 0, F.lit(False))


def missing_keys(have: Column, want: Column) -> Column:
    """Keys of ``want`` that ``have`` lacks, sorted and joined; swap the arguments for keys that are too many."""
    return F.array_join(F.array_sort(F.array_except(want, have)), ",")
