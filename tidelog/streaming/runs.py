"""Structured Streaming twins of the batch operators.

A stream is read, run with ``availableNow`` into a table of the shared folder, and read back. A
stream takes ``FILES`` files at a time.

An ordered fold of a stream is ``fold_to_table``: Spark sorts each micro-batch by key and order, a
task streams it with one state at a time, and the states go from a micro-batch to the next as rows.
No key's rows are gathered, so neither few long keys nor many short ones need memory or calls of
their own. ``stream_fold`` is the same fold as a stateful processor, for streams that their caller
writes: there the rows of a key in one micro-batch are put in order in memory, so its caller must
keep micro-batches small.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidelog.operators.folds import Fold, resumed_fold
from tidelog.session import shared_dir

FILES = 64
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stream of one of the Parquet tables, be it a file or a folder of files."""
    batch = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", FILES)
    return reader.parquet(f"{sf_dir}/{name}.parquet") if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def run_to_table(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """All that is available now, written to a table of the shared folder and read back."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)  # read when a query starts; stateful processors need it
    try:
        query = writer.start(f"{base}/rows")
    finally:
        spark.conf.set(PROVIDER, before)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def run_each_batch(stream: DataFrame, each: Callable[[DataFrame, int], None], label: str) -> None:
    base = f"{shared_dir(stream.sparkSession)}/{label}-{uuid.uuid4().hex}"
    stream.writeStream.foreachBatch(each).option("checkpointLocation", base).trigger(availableNow=True).start().awaitTermination()


def fold_to_table(stream: DataFrame, keys: list[str], order: list[str], make: Callable[[], Fold], columns: list[str], label: str) -> DataFrame:
    """``columns`` of all rows that are available now and of what the fold adds, as a table; rows of a key must arrive in order over micro-batches.

    A micro-batch writes its rows and the states of all keys as one table and reads the states of
    the table before, so that one that is run again writes the same.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    kept = list(dict.fromkeys([*keys, *columns]))
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema} | make().adds | {"_state": "binary"}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*kept, "_state"])

    done: list[str] = []

    def each(batch: DataFrame, batch_id: int) -> None:
        done.append(f"{base}/rows/{batch_id}")
        read = batch.sparkSession.read.schema(schema)
        entries = read.parquet(f"{base}/rows/{batch_id - 1}").where("_state IS NOT NULL") if batch_id else None
        resumed_fold(batch, keys, order, make, entries).select(*kept, "_state").write.mode("overwrite").parquet(done[-1])

    stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)
    return rows.where("_state IS NULL").select(*columns)


class _FoldProcessor(StatefulProcessor):
    """One fold per key; a key's rows of a micro-batch are stepped in order."""

    def __init__(self, make: Callable[[], Fold], columns: list[str], order: list[str]):
        self.make, self.columns, self.order = make, columns, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("fold", "value binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        fold = pickle.loads(self.state.get()[0]) if self.state.exists() else self.make()
        frame = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        out = [fold.step(*v) for v in zip(*(frame[c].tolist() for c in fold.reads))]
        self.state.update((pickle.dumps(fold),))
        added = {c: [o[i] for o in out] for i, c in enumerate(fold.adds)}
        yield frame[self.columns].assign(**added)

    def close(self) -> None:
        pass


def stream_fold(stream: DataFrame, keys: list[str], order: list[str], make: Callable[[], Fold]) -> DataFrame:
    """The streaming form of ``ordered_fold``; rows of a key must arrive in order over micro-batches."""
    added = ", ".join(f"{c} {t}" for c, t in make().adds.items())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema) + ", " + added
    return stream.groupBy(*keys).transformWithStateInPandas(_FoldProcessor(make, stream.columns, order), outputStructType=schema, outputMode="Append", timeMode="None")


def dedup_within_watermark(stream: DataFrame, event_time: str, delay: str, key: str = "message_id") -> DataFrame:
    """One row per id as long as repeats come within ``delay``; state is bounded by the watermark."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])
