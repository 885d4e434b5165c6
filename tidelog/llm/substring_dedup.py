"""Substring dedup by sliding sentence spans.

A text is cut into sentences: a sentence ends with a line, with a full stop, question or
exclamation mark once it has ``MIN_WORDS`` words. One of more than ``MAX_WORDS`` words is cut
where the hash of two neighbouring words is the least of ``WINDOW`` in a row, so the cuts follow
the words alone and two copies are cut alike whatever stands before them; pieces have ``WINDOW``
words at most. At every sentence a run begins, of ``RUN`` sentences or as many more as it takes
to come to ``RUN_WORDS`` words. It is hashed, case and the kind of white space aside. A run's first occurrence is in the document of the smallest id that holds
it, there the first in the text; sentences covered by any other occurrence are removed with the
white space behind them.

The first document of a run is a minimum, pre-aggregated where the runs are read, so a passage
that a third of all documents share is one row of each task. Runs are then joined with the
repeated ones by hash; a hot hash only lengthens the side that adaptive execution can split. No
pairs of documents are made. What is found for each document is joined with its text by id, and
only texts that have something to lose are cut and hashed a second time. Run hashes have 96 bits.

Null and empty texts have no sentences and are returned as they are. Texts of fewer than ``RUN``
sentences or ``RUN_WORDS`` words have no run. Rows of one id are one document for this, whether
their texts are equal or not; a null id is never first unless all holders of the run have null
ids, and loses only what its own text repeats. A text of any length is one row of its runs. An
empty table gives an empty table. Other columns are carried through whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import free_names, table, text_pieces
from tidelog.session import save

RUN, RUN_WORDS, MIN_WORDS, MAX_WORDS, WINDOW = 3, 15, 5, 20, 8
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_powers: dict[str, np.ndarray] = {}
_STOPS = np.zeros(256, bool)
_STOPS[list(b".!?")] = True
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(29))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the two hash bases and of their inverses, modulo 2 ** 64."""
    if len(_powers.get("up", ((),))[0]) < n:
        size = max(2 * n, 1 << 14)
        grow = lambda bases: np.cumprod(np.array([[1] + [b] * (size - 1) for b in bases], np.uint64), axis=1)
        _powers["up"], _powers["down"] = grow(_BASES), grow([pow(b, -1, 1 << 64) for b in _BASES])
    return _powers["up"][:, :n], _powers["down"][:, :n]


def _cut(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and end byte and hash of each word, and the index of the word after each sentence."""
    raw = np.frombuffer(text, np.uint8)
    none = np.zeros(0, np.int64)
    words = text.lower().split()
    n = len(words)
    if not n:
        return none, none, none.view(np.uint64), none
    edge = np.diff(_SPACE[raw].view(np.int8), prepend=1, append=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    lines = np.flatnonzero(raw == 10)
    last = np.zeros(n, bool)
    last[np.searchsorted(starts, lines) - 1] = True  # a break before the first word marks the last, which ends a line anyway
    last[-1] = True
    may_end = np.flatnonzero(last | _STOPS[raw[ends - 1]])
    cuts, at = [], 0
    for w, line_ends in zip(may_end.tolist(), last[may_end].tolist()):
        if line_ends or w + 1 - at >= MIN_WORDS:
            at = w + 1
            cuts.append(at)
    cut = np.array(cuts)
    first = np.concatenate([[0], cut[:-1]])
    long = np.flatnonzero(cut - first > MAX_WORDS)
    if len(long):
        # a cut is the least pair of some WINDOW neighbouring pairs of a long sentence
        pair = _mixed(one[:-1] * np.uint64(_BASES[0]) ^ one[1:])
        inside = np.zeros(n + 1, np.int8)
        inside[first[long]] += 1
        inside[cut[long] - WINDOW] -= 1
        window = np.flatnonzero(np.cumsum(inside))
        least = np.lib.stride_tricks.sliding_window_view(pair, WINDOW)[window].argmin(axis=1)
        cut = np.unique(np.concatenate([cut, window + least + 1]))
    return starts, ends, one, cut


def sentences(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end byte and words of each sentence."""
    starts, ends, _, cut = _cut(text)
    first = np.concatenate([np.zeros(1, np.int64), cut])[: len(cut)]
    return starts[first], ends[cut - 1], cut - first


def runs(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sentence starts and ends; index of the first sentence, number of sentences, hash and check of each run."""
    starts, ends, one, cut = _cut(text)
    total = np.concatenate([np.zeros(1, np.int64), cut])
    starts, ends = starts[total[:-1]], ends[cut - 1]
    at = np.arange(len(cut))
    size = np.maximum(np.searchsorted(total, total[:-1] + RUN_WORDS) - at, RUN)
    at = np.flatnonzero(at + size <= len(cut))
    size = size[at]
    if not len(at):
        return starts, ends, at, size, at, at
    # a run's hash is the difference of two prefix sums over its words, moved to the same origin
    up, down = _power(len(one))
    a, b = total[at], total[at + size]
    h, c = (
        _mixed((before[b - 1] - np.where(a > 0, before[a - 1], np.uint64(0))) * down[k][a])
        for k, before in enumerate(np.cumsum(one * up, axis=1))
    )
    return starts, ends, at, size, h.view(np.int64), (c >> np.uint64(33)).astype(np.int32)


def _document_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash and check of each distinct run of a text; a row without a hash where a run occurs twice in it."""
    for piece, texts in text_pieces(batches):
        hs, cs, sizes, again = [], [], [], []
        for i, t in enumerate(texts):
            _, _, _, _, h, c = runs(t)
            _, first = np.unique(h, return_index=True)
            hs.append(h[first]), cs.append(c[first]), sizes.append(len(first))
            if len(first) < len(h):
                again.append(i)
        at = np.concatenate([np.repeat(np.arange(len(texts)), sizes), np.array(again, np.int64)])
        none = np.arange(len(at)) >= len(at) - len(again)
        values = {"h": (hs, np.int64), "c": (cs, np.int32)}
        columns = {k: pa.array(np.concatenate([*v, np.zeros(len(again), kind)]).astype(kind), mask=none) for k, (v, kind) in values.items()}
        yield pa.RecordBatch.from_pydict(columns | {"doc_id": piece.column("doc_id").take(pa.array(at))})


def without_repeats(text: bytes, repeated: set[int]) -> tuple[bytes, list[tuple[int, int]]]:
    """The text without covered sentences, and the removed byte spans.

    ``repeated`` has the hashes of runs whose first occurrence is elsewhere; later occurrences
    of a run within the text are covered as well.
    """
    starts, _, at, size, h, _ = runs(text)
    if not len(at):
        return text, []
    gone = np.ones(len(at), bool)
    gone[np.unique(h, return_index=True)[1]] = False
    if repeated:
        gone |= np.isin(h, np.fromiter(repeated, np.int64, len(repeated)))
    edge = np.zeros(len(starts) + 1, np.int64)
    np.add.at(edge, at[gone], 1)
    np.add.at(edge, at[gone] + size[gone], -1)
    change = np.diff((np.cumsum(edge[:-1]) > 0).astype(np.int8), prepend=0, append=0)
    after = np.append(starts, len(text))
    spans = [(int(after[a]), int(after[b])) for a, b in zip(np.flatnonzero(change == 1), np.flatnonzero(change == -1))]
    kept, place = [], 0
    for a, b in spans:
        kept.append(text[place:a])
        place = b
    kept.append(text[place:])
    return b"".join(kept), spans


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, repeated) of the documents that lose something: hashes of their runs that a smaller id has as well, none if a run is only repeated within."""
    ids = docs.select("doc_id", F.col("text").cast("string"))
    spans = save(ids.mapInArrow(_document_runs, f"h long, c int, doc_id {dict(ids.dtypes)['doc_id']}"), "sentence-runs")
    each = spans.where("h IS NOT NULL AND doc_id IS NOT NULL")
    first = each.groupBy("h", "c").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where(F.col("first") < F.col("last")).select("h", "c", "first")
    first = save(first, "repeated-runs")  # a table of its own, so that the join reads shuffles only and a hot hash can be split
    later = each.join(first, ["h", "c"]).where(F.col("doc_id") > F.col("first")).select("doc_id", "h")
    within = spans.where("h IS NULL AND doc_id IS NOT NULL").select("doc_id", "h")
    return later.unionByName(within).groupBy("doc_id").agg(F.collect_set("h").alias("repeated"))


def remove_repeats(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with its texts cleaned and two more columns, whose names are returned: number of removed spans and the removed character spans."""
    mine, repeated, *added = free_names(docs, "mine", "repeated", "n_removed_spans", "removed")
    found = repeated_runs(docs.select("doc_id", "text")).select(F.col("doc_id").alias(mine), F.col("repeated").alias(repeated))
    # rows without an id are looked through where they lie
    known, nameless = docs.where("doc_id IS NOT NULL"), docs.where("doc_id IS NULL")
    marked = known.join(found, known["doc_id"] == found[mine], "left").select(*docs.columns, repeated).unionByName(nameless.withColumn(repeated, F.array().cast("array<long>")))
    kinds = [(f.name, f.dataType.simpleString()) for f in docs.schema]
    schema = ", ".join(f"`{n}` {k}" for n, k in [*kinds, (added[0], "int"), (added[1], "array<struct<start:int,end:int>>")])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        char = lambda x, b: len(x[:b].decode("utf-8", "replace"))
        for piece, texts in text_pieces(batches):
            done = [(None, []) if r is None else without_repeats(t, set(r)) for t, r in zip(texts, piece.column(repeated).to_pylist())]
            if any(spans for _, spans in done):
                was = piece.column("text").to_pylist()
                new = pa.array([x.decode("utf-8", "replace") if spans else w for (x, spans), w in zip(done, was)], pa.string())
            else:
                new = piece.column("text")
            columns = {n: new if n == "text" else piece.column(n) for n, _ in kinds}
            columns[added[0]] = pa.array([len(spans) for _, spans in done], pa.int32())
            columns[added[1]] = pa.array([[{"start": char(t, a), "end": char(t, b)} for a, b in spans] for t, (_, spans) in zip(texts, done)], kind)
            yield pa.RecordBatch.from_pydict(columns)

    return marked.mapInArrow(clean, schema), added


def op2_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, added = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *added, "text")


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without repeated spans; n_chars follows the text.

    A document that had words and keeps none is dropped; one that had none stays.
    """
    out, (n_removed, _) = remove_repeats(docs)
    out = out.where((F.col(n_removed) == 0) | F.col("text").rlike(r"[^ \t\n\x0B\f\r]"))
    return out.select(*[F.length("text").cast(dict(docs.dtypes)["n_chars"]).alias("n_chars") if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])
