"""Query and oracle registrations of the event-log operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelog.plans import ack_queries, log_queries, message_queries, policy_queries, stream_queries

REGISTERED = message_queries.QUERIES | log_queries.QUERIES | ack_queries.QUERIES | policy_queries.QUERIES | stream_queries.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTERED.items() if sql}
