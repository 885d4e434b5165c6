"""Quality classifier: random Fourier features, ridge regression and isotonic calibration.

A document is a vector of statistics of its whole text. Random Fourier features approximate a
Gaussian kernel over the standardised statistics. The normal equations of a ridge regression
are summed by partition, so a fit costs one pass and the driver gets one matrix of fixed size.
Ridge scores are then calibrated by isotonic regression over a fixed number of score bins.

Labels are learned from at most about ``max_rows`` labelled rows that are not held out (see
``bounded_labels``); every document is scored. Null and empty texts have the statistics of no
words and are scored like any other. Repeated rows are each scored. Null ids are scored and
never learned from. Without any label, or with one label value only, every score is that value's
share (0.5 without labels). A text of any length is one row of ``N_STATS`` numbers. An empty table
gives an empty table. Extra input columns are not carried by the query; the stage carries them
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import bounded_labels, held_out, isotonic, table, text_pieces
from tidelog.session import drop, save

FEATURES = 256
_CLASSES = {
    "space": b" \t\n\r\x0b\x0c", "upper": bytes(range(65, 91)), "digit": b"0123456789", "bang": b"!?",
    "symbol": b"#*$%&<>@^~=+", "bar": b"|", "comma": b",;:", "stop": b".", "quote": b"\"'()[]{}", "high": bytes(range(0x80, 0xC0)),
}
N_STATS = 18


def statistics(text: bytes) -> list[float]:
    """``N_STATS`` statistics of a text; all rates are finite for empty texts."""
    n = len(text)
    counts = {k: n - len(text.translate(None, v)) for k, v in _CLASSES.items()}
    words = text.split()
    n_words = max(1, len(words))
    chars = max(1, n - counts["space"] - counts["high"])
    rate = lambda k: counts[k] / chars
    distinct = set(words)
    again = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in text.split(b"\n") if x.strip()]
    log = lambda x: float(np.log(x))
    return [
        log(1 + len(words)), chars / n_words, log(0.003 + rate("upper")), log(0.003 + rate("digit")),
        log(0.003 + rate("bang")), log(0.003 + rate("symbol")), log(0.003 + rate("bar")), log(0.003 + rate("comma")),
        log(0.003 + rate("stop")), log(0.003 + rate("quote")), counts["high"] / chars,
        len(distinct) / n_words, log(len(distinct) + 1) / log(n_words + 2), log(0.01 + again / n_words),
        log(0.02 + 1 - len(set(lines)) / max(1, len(lines))), log(1 + len(lines)), log(1 + n_words / max(1, len(lines))),
        log(1 + max(map(len, words), default=0)),
    ]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece, texts in text_pieces(batches):
        flat = pa.array(np.array([statistics(t) for t in texts], np.float64).ravel())
        stats = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, N_STATS), pa.int32()), flat)
        yield pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id"), "stats": stats})


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) of every document."""
    ids = docs.select("doc_id", F.col("text").cast("string"))
    return ids.mapInArrow(_features, f"doc_id {dict(ids.dtypes)['doc_id']}, stats array<double>")


@dataclass(frozen=True)
class KernelRidge:
    """A fitted model; ``score`` maps statistics to calibrated scores."""

    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    ends: np.ndarray
    rates: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = np.sqrt(2.0 / len(self.phase)) * np.cos(x @ self.omega + self.phase)
        return np.hstack([z, np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = self.raw(stats)
        if not len(self.rates):
            return np.clip(raw, 0, 1)
        level = self.rates[np.minimum(np.searchsorted(self.ends, raw), len(self.rates) - 1)]
        # within a level of the calibration the ridge score orders documents
        return np.clip(0.98 * level + 0.02 * np.clip(raw, 0, 1), 0, 1)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("stats").flatten().to_numpy().reshape(batch.num_rows, N_STATS)


def fit(rows: DataFrame, n_rows: int, ridge: float = 1.0, gamma: float = 0.03, bins: int = 400, seed: int = 5) -> KernelRidge:
    """Fit on rows of (stats, y); each pass sends the driver sums of a fixed size."""
    if not n_rows:
        flat = np.zeros(N_STATS)
        return KernelRidge(flat, flat + 1, np.zeros((N_STATS, 1)), np.zeros(1), np.array([0.0, 0.5]), np.zeros(0), np.zeros(0))
    s = rows.agg(*(f(F.col("stats")[i]).alias(f"{f.__name__}{i}") for i in range(N_STATS) for f in (F.avg, F.stddev_pop))).first()
    mean = np.array([s[f"avg{i}"] for i in range(N_STATS)])
    scale = np.maximum(np.array([s[f"stddev_pop{i}"] for i in range(N_STATS)]), 0.05)
    draw = np.random.default_rng(seed)
    omega, phase = draw.normal(0, np.sqrt(2 * gamma), (N_STATS, FEATURES)), draw.uniform(0, 2 * np.pi, FEATURES)
    size = FEATURES + 1
    blank = KernelRidge(mean, scale, omega, phase, np.zeros(size), np.zeros(0), np.zeros(0))

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for b in batches:
            z, y = blank.features(_matrix(b)), b.column("y").to_numpy().astype(float)
            total += z.T @ np.column_stack([z, y])
        yield pa.RecordBatch.from_pydict({"i": np.arange(size, dtype=np.int32), "row": pa.array(list(total))})

    parts = rows.select("stats", "y").mapInArrow(normal, "i int, row array<double>")
    summed = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    system = np.zeros((size, size + 1))
    got = summed.toPandas()
    system[got["i"], got["j"]] = got["v"]
    weights = np.linalg.solve(system[:, :-1] + ridge * np.eye(size), system[:, -1])
    model = KernelRidge(mean, scale, omega, phase, weights, np.zeros(0), np.zeros(0))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.floor(np.clip(model.raw(_matrix(b)), -0.5, 1.5) * bins / 2).astype(int)
            yield pa.RecordBatch.from_pydict({"bin": at, "y": b.column("y").to_numpy().astype(np.int64)})

    hist = rows.select("stats", "y").mapInArrow(binned, "bin long, y long").groupBy("bin").agg(F.sum("y").alias("good"), F.count(F.lit(1)).alias("n")).toPandas().sort_values("bin")
    ends, rates = isotonic((hist["bin"].to_numpy() + 1) * 2 / bins, hist["good"].to_numpy(), hist["n"].to_numpy())
    return KernelRidge(mean, scale, omega, phase, weights, ends, rates)


def train(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> tuple[DataFrame, KernelRidge]:
    """The statistics of every document and the model learned from about ``max_rows`` labelled ones."""
    stats = save(document_statistics(docs), "document-statistics")
    known, n = bounded_labels(labels, label, max_rows)
    known = save(known, "labels")
    # an id and a label for each of about max_rows rows: broadcast, so that no statistics move
    rows = save(stats.join(F.broadcast(known), "doc_id"), "training")
    model = fit(rows, rows.count() if n else 0)
    drop(known, rows)
    return stats, model


def score_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 40_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    stats, model = train(docs, labels, label, max_rows)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "score": model.score(_matrix(b))})

    out = stats.mapInArrow(scored, f"doc_id {dict(stats.dtypes)['doc_id']}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_fourier_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows whose text scores 0.5 or more.

    A row is judged where it lies, by its own text, so texts are not shuffled; the statistics
    are cheap enough to be computed once for the fit and once here.
    """
    stats, model = train(docs, table(spark, sf_dir, "labels"), "quality", 40_000)
    drop(stats)

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in text_pieces(batches):
            score = model.score(np.array([statistics(t) for t in texts]))
            yield piece.filter(pa.array(score >= 0.5))

    return docs.mapInArrow(good, docs.schema)
