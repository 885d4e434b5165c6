"""The session for tests and benchmarks, and the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: dict[str, str] = {}
#: Paths of tables that ``save`` wrote and nobody has dropped, oldest first.
_saved: list[str] = []


def get_spark(cpus: int | None = None, partitions: int = 8) -> SparkSession:
    """A local session; on a cluster the submitter's session is used instead."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidelog")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TIDELOG_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as the cluster names it; where it is unset, a folder of our own if the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="tidelog-")
    return _own_dir[app]


def save(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage: an executor that is lost costs the tasks it ran, not the plan
    above them, and every reader sees the same rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _saved.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidelog_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    if path in _saved:
        _saved.remove(path)


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``save`` wrote; a table that is not ours is left alone."""
    for df in tables:
        path = getattr(df, "_tidelog_path", None)
        if path:
            _delete(df.sparkSession, path)


def saved_tables() -> list[str]:
    """Paths of the tables that ``save`` wrote and that still stand, oldest first."""
    return list(_saved)


def drop_since(spark: SparkSession, before: list[str], *keep: DataFrame) -> None:
    """Delete what was saved since ``saved_tables`` gave ``before``, but for the tables ``keep``.

    For callers that have written a result whose plan read intermediate tables.
    """
    stay = {*before, *(getattr(df, "_tidelog_path", None) for df in keep)}
    for path in [p for p in _saved if p not in stay]:
        _delete(spark, path)
