"""Quality rules: base statistics of whole texts, then robust multivariate outliers.

A minimum covariance determinant estimate is fitted for each language and source over all
documents by distributed concentration steps: distances to the current centre, the quantile of
them that keeps ``support`` of the rows, then means and covariances of the kept rows, each one
partial aggregation. A step never makes the determinant larger, but may end in a local minimum, so
``STARTS`` begin from different rows, and after two steps the one of the smallest determinant goes
on. Documents far from their group's estimate by Mahalanobis distance are
rejected. Groups of fewer than ``min_group`` rows (null language or source is a value of its
own) are pooled; a pool that is still smaller rejects nothing.

Null and empty texts have no words and fail the base rule. A text of any length is one row of a
few numbers once it is counted. Repeated rows are each judged. An empty table gives an empty
table. Extra input columns are not carried. Ties at the quantile are kept together. A statistic that is
constant in a group has its variance floored, so no covariance is singular.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import table, text_pieces
from tidelog.session import drop, save

#: Fixed by the contract of op7.
SYMBOLS = b"#*$%&|<>"
WINDOW = 8

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Least standard deviation of each transformed statistic, in its own units.
FLOORS = [0.12, 0.6, 0.5, 0.6, 0.5]
#: Squared distance beyond which a document is an outlier: about one in 400,000 rows of a normal group lies further out.
CUTOFF = 34.0

_NOT_WORD_CHARS = bytes(range(0x80, 0xC0)) + b"\t\n\x0b\x0c\r "
_MIX = np.random.default_rng(11).integers(1, 2**63, WINDOW, dtype=np.uint64) | np.uint64(1)


def repeated_words(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per text, the words that lie in a window of ``WINDOW`` words found twice or more in it.

    ``hashes`` are word hashes of all texts in a row, ``sizes`` the words of each text. Windows
    are compared by a 64-bit hash.
    """
    out = np.zeros(len(sizes), np.int64)
    n = len(hashes) - WINDOW + 1
    if n < 2:
        return out
    doc = np.repeat(np.arange(len(sizes)), sizes)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for k in range(WINDOW):
            h += hashes[k : k + n] * _MIX[k]
            h ^= h >> np.uint64(29)
        h ^= doc[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    whole = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
    ordered = np.sort(h[whole])
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return out
    starts = whole[np.isin(h[whole], np.unique(twice))]
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    covered = np.cumsum(edge[:-1]) > 0
    np.add.at(out, doc[covered], 1)
    return out


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece, texts in text_pieces(batches):
        words = [t.split() for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        hashes = np.fromiter((hash(w) for ws in words for w in ws), np.int64, int(sizes.sum())).view(np.uint64)
        dup = []
        for t in texts:
            lines = [x for x in t.split(b"\n") if x.strip()]
            dup.append(len(lines) - len(set(lines)))
        columns = {
            "doc_id": piece.column("doc_id"), "lang": piece.column("lang"), "source": piece.column("source"),
            "n_words": sizes,
            "word_chars": np.array([len(t.translate(None, _NOT_WORD_CHARS)) for t in texts], np.int64),
            "n_symbols": np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], np.int64),
            "n_dup_lines": np.array(dup, np.int64),
            "n_repeat_words": repeated_words(hashes, sizes),
        }
        yield pa.RecordBatch.from_pydict(columns)


def text_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source and ``BASE``) of every document, over its whole text."""
    ids = docs.select("doc_id", F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string"))
    kind = dict(ids.dtypes)["doc_id"]
    return ids.mapInArrow(_statistics, f"doc_id {kind}, lang string, source string, " + ", ".join(f"{c} long" for c in BASE))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def vector() -> list[Column]:
    """The transformed statistic vector: logarithms of rates per word, floored so zero is finite."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        F.log(0.01 + F.col("n_symbols") / n),
        F.log(0.01 + F.col("n_dup_lines") / n),
        F.log(0.02 + F.col("n_repeat_words") / n),
        F.log(20.0 + n) / 2,
    ]


P = len(FLOORS)
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


#: The rows that a start begins from: those within two quantiles of each statistic, or a third of them by hash.
STARTS = ((0.1, 0.9), (0.25, 0.75), None)


def _estimate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Centre, whitening matrix and logarithm of the determinant of each group from its sums; a group is one row."""
    for f in frames:
        rows = []
        for r in f.itertuples(index=False):
            s = np.array([getattr(r, f"s{i}") for i in range(P)]) / r.n
            cov = np.zeros((P, P))
            for i, j in _PAIRS:
                cov[i, j] = cov[j, i] = getattr(r, f"q{i}_{j}") / r.n - s[i] * s[j]
            cov *= r.widen**2
            floor = np.square(FLOORS)
            cov[np.diag_indices(P)] += np.maximum(0, floor - np.diag(cov)) + 0.01 * floor
            w = np.linalg.inv(np.linalg.cholesky(cov))
            rows.append((r.key, r.start, s.tolist(), w.ravel().tolist(), -2 * np.log(np.diag(w)).sum()))
        yield pd.DataFrame(rows, columns=["key", "start", "centre", "white", "log_det"])


def distance() -> Column:
    """Squared Mahalanobis distance of ``x0..`` from the joined ``centre`` by the joined ``white``."""
    total = F.lit(0.0)
    for i in range(P):
        y = F.lit(0.0)
        for j in range(i + 1):
            y = y + F.col("white")[i * P + j] * (F.col(f"x{j}") - F.col("centre")[j])
        total = total + y * y
    return total


def fit_mcd(rows: DataFrame, support: float = 0.75, steps: int = 6, widen: float = 1.3, max_broadcast: int = 20_000) -> DataFrame:
    """(key, centre, white, log_det) of every ``key`` of ``rows`` (key, x0..), by concentration steps.

    ``widen`` scales the deviations of the kept rows up to those of all rows. The estimates, a row
    per group, are broadcast while they are ``max_broadcast`` at most and joined by a shuffle
    otherwise.
    """
    groups = rows.select("key").distinct().count()
    small = (lambda d: F.broadcast(d)) if groups <= max_broadcast else (lambda d: d)
    sums = [F.count(F.lit(1)).alias("n"), F.lit(widen).alias("widen"), *(F.sum(f"x{i}").alias(f"s{i}") for i in range(P)), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}_{j}") for i, j in _PAIRS)]
    schema = "key string, start int, centre array<double>, white array<double>, log_det double"
    estimated = lambda kept: save(kept.groupBy("key", "start").agg(*sums).mapInPandas(_estimate, schema), "mcd")

    edges = sorted({q for s in STARTS if s for q in s})
    middle = save(rows.groupBy("key").agg(*(F.percentile_approx(f"x{i}", edges, 200).alias(f"m{i}") for i in range(P))), "mcd-start")
    within = lambda s: reduce(lambda a, b: a & b, [F.col(f"x{i}").between(*(F.col(f"m{i}")[edges.index(q)] for q in s)) for i in range(P)])
    third = F.pmod(F.xxhash64(*(f"x{i}" for i in range(P))), F.lit(3)) == 0
    begins = F.array_compact(F.array(*(F.when(within(s) if s else third, F.lit(k)) for k, s in enumerate(STARTS))))
    x = [f"x{i}" for i in range(P)]
    estimate = estimated(rows.join(small(middle), "key").select("key", *x, F.explode(begins).alias("start")))
    drop(middle)
    for step in range(steps):
        far = rows.select("key", *x).join(small(estimate), "key").withColumn("d2", distance())
        limit = save(far.groupBy("key", "start").agg(F.percentile_approx("d2", support, 1000).alias("limit")), "mcd-limit")
        now = estimated(far.join(small(limit), ["key", "start"]).where(F.col("d2") <= F.col("limit")).select("key", "start", *x))
        drop(estimate, limit)
        estimate = now
        if step == 1:
            best = save(now.groupBy("key").agg(F.min_by(F.struct("start", "centre", "white", "log_det"), F.struct("log_det", "start")).alias("e")).select("key", "e.*"), "mcd")
            drop(now)
            estimate = best
    return estimate


def quality_rules(docs: DataFrame, min_group: int = 200, cutoff: float = CUTOFF) -> DataFrame:
    """(doc_id, ``BASE``, base_failed, kept, distance) of every document.

    The estimates are fitted on documents that pass the base rule. ``distance`` is the squared
    Mahalanobis distance, null where nothing was fitted.
    """
    stats = save(text_statistics(docs).withColumn("base_failed", base_failed()).select("*", *(x.alias(f"x{i}") for i, x in enumerate(vector()))), "text-statistics")
    sized = lambda c: F.coalesce(F.concat(F.length(c), F.lit(":"), c), F.lit("-"))  # noqa: E731  # no two pairs have one name
    name = F.concat(sized("lang"), F.lit("|"), sized("source"))
    large = stats.where(~F.col("base_failed")).groupBy(name.alias("key")).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= min_group)
    large = save(large, "mcd-groups")
    n_large = large.count()
    keyed = stats.withColumn("key", name).join(F.broadcast(large) if n_large <= 20_000 else large, "key", "left").withColumn("key", F.when(F.col("rows").isNull(), F.lit("")).otherwise(F.col("key"))).drop("rows")
    passed = keyed.where(~F.col("base_failed"))
    pool = passed.where("key = ''").count()
    estimate = fit_mcd(passed if pool >= min_group else passed.where("key <> ''"))
    judged = keyed.join(F.broadcast(estimate) if n_large < 20_000 else estimate, "key", "left").withColumn("distance", distance())
    return judged.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))).alias("kept"), "distance")


def op7_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
