"""Token counts by offset-mapped attribution.

A document is encoded once, as a whole. The byte lengths of its tokens give the span of each
token, and sections are given as character spans of the same text. Spans are joined by binary
search; a token that crosses from one section into another is allocated by the rule ``start``
(the section of its first character), ``largest`` (the section with most of its bytes, of equal
ones the earlier) or ``share`` (to each its share of the token's bytes). Tokens outside all
sections are counted in a section of null, so the counts of a document always add up to the
tokens of its whole text.

Null and empty texts have one empty section with no tokens. Repeated rows and null ids are each
counted. A text of any length is encoded whole, in one piece. An empty table gives an empty table.
Extra input columns are not carried.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import table, text_pieces

#: Where the public vocabularies are installed; a parameter of every function here.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Words with a leading space, letters, digits and other signs apart, as byte-level BPE is commonly split.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

Sections = Callable[[str], list[tuple[int, int]]]


class Vocabulary:
    """An encoder and the byte length of each of its tokens."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)

    def ends(self, text: str) -> np.ndarray:
        """The end byte of each token of the whole text."""
        return np.cumsum(self.sizes[np.asarray(self.encoding.encode_ordinary(text), np.int64)])


def line_sections(text: str) -> list[tuple[int, int]]:
    """The character span of each line, its line break included."""
    spans, at = [], 0
    for line in text.split("\n"):
        spans.append((at, at + len(line) + 1))
        at += len(line) + 1
    spans[-1] = (spans[-1][0], len(text))
    if len(spans) > 1 and spans[-1][0] == spans[-1][1]:
        spans.pop()
    return spans


def allocate(ends: np.ndarray, low: np.ndarray, high: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section and, last, of none; sections are ascending and do not overlap (all in bytes)."""
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    k = len(low)

    def section(byte: np.ndarray) -> np.ndarray:
        at = np.searchsorted(low, byte, side="right") - 1
        return np.where((at >= 0) & (byte < high[np.maximum(at, 0)]), at, k) if k else np.full(len(byte), 0)

    first, last = section(starts), section(np.maximum(ends - 1, starts))
    if rule == "start":
        return np.bincount(first, minlength=k + 1).astype(float)
    crossing = (first != last) | ((first == k) & (np.searchsorted(low, starts) != np.searchsorted(low, ends)))
    counts = np.bincount(first[~crossing], minlength=k + 1).astype(float)
    for i in np.flatnonzero(crossing):
        a, b = starts[i], ends[i]
        near = range(max(0, int(np.searchsorted(high, a, side="right"))), int(np.searchsorted(low, b)))
        parts = [(min(b, high[s]) - max(a, low[s]), -s, s) for s in near if min(b, high[s]) > max(a, low[s])]
        outside = (b - a) - sum(p[0] for p in parts)
        if outside:
            parts.append((outside, -k, k))
        if rule == "share":
            for size, _, s in parts:
                counts[s] += size / (b - a)
        else:
            counts[max(parts)[2]] += 1
    return counts


def count_tokens(docs: DataFrame, sections: Sections = line_sections, rule: str = "largest", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, section, start, end, n_tokens) of every section of every document."""
    if rule not in ("start", "largest", "share"):
        raise ValueError(f"unknown rule {rule!r}")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary(vocabulary, pattern)
        for piece, texts in text_pieces(batches):
            row, number, low, high, n = [], [], [], [], []
            for i, raw in enumerate(texts):
                text = raw.decode("utf-8", "replace")
                spans = sections(text)
                a, b = np.array([s[0] for s in spans], np.int64), np.array([s[1] for s in spans], np.int64)
                if len(text) == len(raw):
                    counts = allocate(words.ends(text), a, b, rule)
                else:
                    byte = np.append(np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80), len(raw))
                    counts = allocate(words.ends(text), byte[a], byte[b], rule)
                some = len(spans) + (counts[-1] > 0)
                row += [i] * some
                number += [*range(len(spans)), None][:some]
                low += [*a.tolist(), None][:some]
                high += [*b.tolist(), None][:some]
                n += counts[:some].tolist()
            ids = piece.column("doc_id").take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "section": pa.array(number, pa.int32()), "start": pa.array(low, pa.int64()), "end": pa.array(high, pa.int64()), "n_tokens": pa.array(n, pa.float64())})

    ids = docs.select("doc_id", F.col("text").cast("string"))
    return ids.mapInArrow(counted, f"doc_id {dict(ids.dtypes)['doc_id']}, section int, start long, end long, n_tokens double")


def op1_offset_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return count_tokens(table(spark, sf_dir, "documents"))
