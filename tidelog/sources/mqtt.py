"""A broker subscription as a streaming source and a confirmed publication as a sink.

The transport is injected: an object with ``poll(after) -> list[(offset, topic, value)]`` and
``publish(topic, value) -> bool``, made by a factory that every task can call. No client library
is imported here. Offsets are the transport's own and must not decrease; what a restart asks for
again must be there until ``release`` is called for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "topic string, value string"


def mqtt_source(name: str, connect: Callable[[], Any], topic: str) -> type[DataSource]:
    """A data source class of that name; register it with ``spark.dataSource.register``."""

    class Reader(SimpleDataSourceStreamReader):
        def __init__(self) -> None:
            self.transport = connect()

        def initialOffset(self) -> dict:
            return {"offset": 0}

        def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
            rows = [r for r in self.transport.poll(start["offset"]) if r[1] == topic]
            end = max((r[0] for r in rows), default=start["offset"])
            return iter([(t, v) for _, t, v in rows]), {"offset": end}

        def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
            return iter([(t, v) for o, t, v in self.transport.poll(start["offset"]) if o <= end["offset"] and t == topic])

        def commit(self, end: dict) -> None:
            release = getattr(self.transport, "release", None)
            if release is not None:
                release(end["offset"])

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def simpleStreamReader(self, schema: Any) -> SimpleDataSourceStreamReader:
            return Reader()

    return Source


def confirmed_publish(deliveries: DataFrame, connect: Callable[[], Any]) -> DataFrame:
    """``deliveries`` with ``confirmed``: whether the transport confirmed the publication. It never raises for a row."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in deliveries.schema) + ", confirmed boolean"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        transport = connect()

        def one(topic: str, value: str) -> bool:
            try:
                return bool(transport.publish(topic, value))
            except Exception:  # noqa: BLE001  a failed publication is an unconfirmed one
                return False

        for f in frames:
            yield f.assign(confirmed=[one(t, v) for t, v in zip(f["topic"], f["encoded"])])

    return deliveries.mapInPandas(run, schema)
