"""What several of these operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Each of ``names``, with underscores added until ``df`` has no such column in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def held_out(doc_id: Column) -> Column:
    """True for the rows no model may learn labels from: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def text_pieces(batches: Iterator[pa.RecordBatch], column: str = "text", max_bytes: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut Arrow batches so that a piece holds about ``max_bytes`` of text, or one longer text.

    Yields the piece and its texts as UTF-8 bytes; a null text is empty.
    """
    for batch in batches:
        texts = batch.column(column)
        if not len(texts):
            continue
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(sizes) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                piece = batch.slice(a, b - a)
                yield piece, [x or b"" for x in piece.column(column).cast(pa.binary()).to_pylist()]


def bounded_labels(labels: DataFrame, label: str, max_rows: int) -> tuple[DataFrame, int]:
    """(doc_id, label 0/1) of labelled rows that are not held out, at most about ``max_rows``.

    Rows with a null id or label are left out; an id with several labels takes their majority
    (a tie counts as 1). Where there are more than ``max_rows``, rows are kept by a hash of the
    id, so the choice is the same on every run. The count returned is exact.
    """
    rows = (
        labels.select(F.col("doc_id"), F.col(label).cast("double").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    )
    n = rows.count()
    if n > max_rows:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
        n = rows.count()
    return rows, n


def isotonic(x: np.ndarray, good: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins ``x`` in ascending order; returns block ends and their rates."""
    ends, rate, weight = [], [], []
    for xi, g, n in zip(x, good, total):
        ends.append(float(xi)), rate.append(g / n), weight.append(float(n))
        while len(rate) > 1 and rate[-2] >= rate[-1]:
            w = weight[-2] + weight[-1]
            rate[-2:], weight[-2:], ends[-2:] = [(rate[-2] * weight[-2] + rate[-1] * weight[-1]) / w], [w], [ends[-1]]
    return np.array(ends), np.array(rate)
