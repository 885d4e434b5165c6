"""Toxicity: a linear-chain conditional random field tags toxic spans.

Documents carry labels, tokens do not, so token labels come first. Over a bounded sample of
labelled documents that are not held out, the words and word beginnings that toxic documents have
far more often than others (a lower confidence bound of their toxic share is over ``LIFT`` times
the share of toxic documents, or over one half) are candidates; those are kept that toxic
documents have between different neighbours, so words that merely come with copies of one document
are not. A beginning counts where no whole word is a candidate. A token is labelled toxic if its
document is and a kept word or beginning matches it.

A two-state chain is then trained on the labelled tokens, by gradients of the regularised
likelihood summed by partition. Its features do not depend on the labelling: of every token the
word, beginnings, endings, triples of bytes and shape, and the beginnings of both neighbours, all
hashed into ``SLOTS``, as far as ``LEAST`` labelled tokens have them. So a word that was never labelled is tagged by what it
shares with those that were, and a labelled one is not if its like are found elsewhere.

Every document is tagged by forward-backward over its whole text; adjoining tokens with a marginal
of one half or more form a span. A document's evidence, the sum of -log(1 - marginal) over its
tokens, is compared with what toxic and what other documents of its length come to (the log ratio
of two Poisson likelihoods), and calibrated by isotonic regression on the sample.

Null and empty texts have no tokens and no evidence. Texts of any length are tagged in whole;
their marginals are worked out in segments that are put together. Repeated rows are each scored.
Null ids are scored and never learned from. Without toxic labels every score is 0. An empty table
gives an empty table. Extra input columns are not carried.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import bounded_labels, held_out, isotonic, table, text_pieces
from tidelog.session import drop, save

#: Lengths of beginnings; a beginning stands for longer words only, as a stem alone may be harmless.
PREFIXES = (3, 4, 5, 6, 7)
#: How far the toxic share of a labelling word is over that of all documents; labelled tokens that have a feature of the chain.
LIFT, LEAST = 3.0, 3
#: Tokens of a segment of forward-backward.
SEGMENT = 64
BINS = 200
#: Signs around a word that are none of it: ASCII punctuation and common quotes and dashes.
_AROUND = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„’‘‚…–—¿¡·•"
SLOTS = 1 << 20
#: Kinds of features of a token, salts of their hashes; beginnings and endings by bytes.
WORD, BEGIN, END, TRIPLE, SHAPE, LEFT, RIGHT = range(1, 8)
BEGINS, ENDS = (3, 4, 5, 6, 7, 8), (3, 4, 5)
_VALUE = np.random.default_rng(41).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_powers: dict[str, np.ndarray] = {}


def plain(token: str) -> str:
    """The lower-case word without punctuation around it."""
    return token.strip(_AROUND).lower()


def labelling_features(token: str) -> list[str]:
    """The word, then its beginnings."""
    word = plain(token)
    return [f"w:{word}", *(f"p:{word[:n]}" for n in PREFIXES if len(word) > n)] if word else []


def _slot(h: np.ndarray, kind: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ np.uint64(kind * 0x9E3779B1)) * _ODD
        h = (h ^ (h >> np.uint64(29))) * _BASE
    return (h >> np.uint64(44)).astype(np.int64)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the hash base and of its inverse, modulo 2 ** 64."""
    if len(_powers.get("up", ())) < n:
        size = max(n + n // 4, 1 << 14)
        for name, base in (("up", _BASE), ("down", np.uint64(pow(int(_BASE), -1, 1 << 64)))):
            _powers[name] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, base))])
    return _powers["up"], _powers["down"]


def chain_features(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token, slot) of what the chain sees of each token itself, and each token's slot as a left and as a right neighbour.

    All tokens are hashed at once: the hash of a piece of a word is the difference of two prefix
    sums over all bytes, moved to the same origin.
    """
    words = [plain(t).encode() for t in tokens]
    size = np.fromiter(map(len, words), np.int64, len(words))
    raw = np.frombuffer(b"".join(words), np.uint8)
    start = np.cumsum(size) - size
    up, down = _power(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[raw] * up[: len(raw)])])
    piece = lambda a, b: (total[b] - total[a]) * down[a]
    every = np.arange(len(words))
    which, slots = [], []

    def add(token: np.ndarray, h: np.ndarray, kind: int) -> None:
        which.append(token), slots.append(_slot(h, kind))

    some = np.flatnonzero(size)
    add(some, piece(start[some], start[some] + size[some]), WORD)
    for n in BEGINS:
        long = np.flatnonzero(size > n)
        add(long, piece(start[long], start[long] + n) + np.uint64(n), BEGIN)
    for n in ENDS:
        long = np.flatnonzero(size > n)
        add(long, piece(start[long] + size[long] - n, start[long] + size[long]) + np.uint64(n), END)
    inside = np.maximum(size - 2, 0)
    of = np.repeat(every, inside)
    at = np.arange(len(of)) - np.repeat(np.cumsum(inside) - inside, inside) + start[of]
    add(of, piece(at, at + 3), TRIPLE)
    upper = np.fromiter((t[:1].isupper() for t in tokens), bool, len(tokens))
    digits = np.concatenate([[0], np.cumsum((raw >= 48) & (raw <= 57))])
    shape = np.minimum(size, 12) * 4 + upper * 2 + (digits[start + size] > digits[start])
    add(every, shape.astype(np.uint64), SHAPE)
    near = piece(start, start + np.minimum(size, 3))
    return np.concatenate(which), np.concatenate(slots), _slot(near, LEFT), _slot(near, RIGHT)


def forward_backward(unary: np.ndarray, sizes: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of state 1, summed expected transitions and the log partition function.

    ``unary`` holds all sequences in a row. Messages are odds of state 1, and a step maps the odds
    before it by a ratio of two linear functions, a matrix of two by two. All segments of
    ``SEGMENT`` tokens advance together: first their matrices are multiplied, which gives the odds
    at their ends (segments of segments, in turn), then the odds within. A sequence begins with a
    matrix that forgets what was before.
    """
    n = len(unary)
    pairs = np.zeros((2, 2))
    if not n:
        return np.zeros(0), pairs, 0.0
    e = np.exp(transition)
    odds = np.exp(np.clip(unary, -40, 40))
    begins = np.zeros(n + 1, bool)
    ends = np.cumsum(sizes)
    begins[(ends - sizes)[sizes > 0]] = True
    begins[n] = True
    first, last = begins[:-1], begins[1:]
    # forward odds r' = odds (e01 + e11 r) / (e00 + e10 r); backward b' = (e10 + e11 x b) / (e00 + e01 x b), x the next odds
    a = np.stack([np.where(first, 0.0, odds * e[1, 1]), np.where(first, odds, odds * e[0, 1]), np.where(first, 0.0, e[1, 0]), np.where(first, 1.0, e[0, 0])])
    fwd = _chained(a)
    x = np.append(odds[1:], 1.0)
    a = np.stack([np.where(last, 0.0, e[1, 1] * x), np.where(last, 1.0, e[1, 0]), np.where(last, 0.0, e[0, 1] * x), np.where(last, 1.0, e[0, 0])])
    bwd = _chained(a[:, ::-1])[::-1]
    inner = np.flatnonzero(~last)
    f, y = fwd[inner], odds[inner + 1] * bwd[inner + 1]
    cells = np.stack([np.full(len(inner), e[0, 0]), e[0, 1] * y, e[1, 0] * f, e[1, 1] * f * y])
    pairs += (cells / cells.sum(axis=0)).sum(axis=1).reshape(2, 2)
    log_z = float(np.log(e[0, 0] + f * e[1, 0]).sum() + np.log1p(fwd[last]).sum())
    both = fwd * bwd
    return both / (1 + both), pairs, log_z


def _chained(maps: np.ndarray) -> np.ndarray:
    """The values after each of the maps v -> (m0 v + m1) / (m2 v + m3), the first of which ignores what is before."""
    n = maps.shape[1]
    rows = -(-n // SEGMENT)
    if rows == 1:
        out, v = np.empty(n), 0.0
        for t in range(n):
            m = maps[:, t]
            out[t] = v = (m[0] * v + m[1]) / (m[2] * v + m[3])
        return out
    fill = np.zeros((4, rows * SEGMENT - n))
    fill[[0, 3]] = 1.0
    m = np.concatenate([maps, fill], axis=1).reshape(4, rows, SEGMENT).transpose(2, 0, 1).copy()
    whole = m[0]
    for t in range(1, SEGMENT):
        p, q = m[t], whole
        whole = np.stack([p[0] * q[0] + p[1] * q[2], p[0] * q[1] + p[1] * q[3], p[2] * q[0] + p[3] * q[2], p[2] * q[1] + p[3] * q[3]])
        whole /= np.abs(whole).max(axis=0)
    v = np.concatenate([[0.0], _chained(whole)[:-1]])
    out = np.empty((SEGMENT, rows))
    for t in range(SEGMENT):
        p = m[t]
        out[t] = v = (p[0] * v + p[1]) / (p[2] * v + p[3])
    return out.T.ravel()[:n]


@dataclass(frozen=True)
class ChainCRF:
    """Weights by slot, and the calibration."""

    features: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -20.0
    transition: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    #: Evidence per token of toxic and of other documents.
    rates: tuple[float, float] = (1.0, 0.0)
    ends: np.ndarray = field(default_factory=lambda: np.zeros(0))
    levels: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def emissions(self) -> Emissions:
        table = np.zeros(SLOTS)
        table[self.features] = self.weights
        return Emissions(table, self.bias)

    def tag(self, texts: list[str], emissions: Emissions) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, int, float]]]]:
        """The evidence, the tokens and the spans (first and last token, largest marginal) of each text."""
        tokens = [t.split() for t in texts]
        sizes = np.array([len(t) for t in tokens], np.int64)
        flat = [x for t in tokens for x in t]
        unary = emissions.of(flat, sizes)
        p, _, _ = forward_backward(unary, sizes, self.transition)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        told = np.zeros(len(texts))
        have = np.flatnonzero(sizes)
        if len(have):
            told[have] = np.add.reduceat(-np.log1p(-np.minimum(p, 0.999)), starts[have])
        spans: list[list[tuple[int, int, float]]] = [[] for _ in texts]
        hot = np.flatnonzero(p >= 0.5)
        if len(hot):
            doc = np.searchsorted(ends, hot, side="right")
            new = np.flatnonzero(np.concatenate([[True], (np.diff(hot) > 1) | (np.diff(doc) > 0)]))
            for a, b in zip(new, [*new[1:], len(hot)]):
                d = int(doc[a])
                spans[d].append((int(hot[a] - starts[d]), int(hot[b - 1] - starts[d]), float(p[hot[a:b]].max())))
        return told, sizes, spans

    def raw(self, told: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The log ratio of the likelihoods of the evidence, squeezed to 0..1; 0 without tokens."""
        toxic, other = self.rates
        ratio = (told * np.log(toxic / max(other, 1e-6)) - sizes * (toxic - other)) / 4
        return np.where(sizes > 0, 1 / (1 + np.exp(-np.clip(ratio, -30, 30))), 0.0)

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        if not len(self.levels):
            return np.zeros(len(raw))
        at = np.minimum(np.searchsorted(self.ends, raw), len(self.levels) - 1)
        return np.clip(0.98 * self.levels[at] + 0.02 * raw, 0, 1)


class Emissions:
    """Scores of tokens for the toxic state less those for the clean one; what a word brings is worked out once."""

    def __init__(self, table: np.ndarray, bias: float, most: int = 400_000):
        self.table, self.bias, self.most = table, bias, most
        self.known: dict[str, int] = {}
        self.scores = np.zeros((3, 1 << 16))  # of a word itself, as a left and as a right neighbour

    def of(self, tokens: list[str], sizes: np.ndarray) -> np.ndarray:
        """The score of each of the tokens of all sequences in a row."""
        if len(self.known) > self.most:  # a cache, so that it may be emptied
            self.known.clear()
        new = list(set(tokens).difference(self.known))
        if new:
            at = len(self.known)
            if self.scores.shape[1] < at + len(new):
                self.scores = np.concatenate([self.scores, np.zeros((3, at + len(new)))], axis=1)
            self.known.update(zip(new, range(at, at + len(new))))
            token, slot, left, right = chain_features(new)
            self.scores[:, at : at + len(new)] = np.bincount(token, self.table[slot], len(new)), self.table[left], self.table[right]
        which = np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))
        own, left, right = self.scores
        score = own[which] + self.bias
        inner = np.flatnonzero(~first_tokens(sizes))
        score[inner] += left[which[inner - 1]]
        score[inner - 1] += right[which[inner]]
        return score


def first_tokens(sizes: np.ndarray) -> np.ndarray:
    """Which of the tokens of all sequences in a row begin one."""
    out = np.zeros(int(sizes.sum()), bool)
    out[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    return out


def offsets(text: str, spans: list[tuple[int, int, float]]) -> list[dict]:
    """Character offsets of token spans."""
    if not spans:
        return []
    places = [m.span() for m in re.finditer(r"\S+", text)]
    return [{"start": places[a][0], "end": places[b][1], "marginal": p} for a, b, p in spans]


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a partition, and toxic ones, that have each labelling feature."""
    total, toxic = Counter(), Counter()
    for piece, texts in text_pieces(batches):
        for text, y in zip(texts, piece.column("y").to_pylist()):
            found = {f for w in set(text.decode("utf-8", "replace").split()) for f in labelling_features(w)}
            total.update(found)
            if y:
                toxic.update(found)
        if len(total) > 500_000:  # what is summed later may be sent in parts
            yield _counts(total, toxic)
            total, toxic = Counter(), Counter()
    yield _counts(total, toxic)


def _counts(total: Counter, toxic: Counter) -> pa.RecordBatch:
    names = list(total)
    return pa.RecordBatch.from_pydict({"feature": pa.array(names, pa.string()), "n": pa.array([total[f] for f in names], pa.int64()), "toxic": pa.array([toxic[f] for f in names], pa.int64())})


def toxic_features(sample: DataFrame, share: float, z: float = 2.2, least: int = 3) -> frozenset[str]:
    """The words and beginnings that label tokens, from rows of (text, y) of which ``share`` are toxic.

    One is kept if toxic documents have it between ``least`` different pairs of neighbours.
    """
    counts = sample.mapInArrow(_count_features, "feature string, n long, toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    part, zz = F.col("toxic") / F.col("n"), z * z
    lower = (part + zz / (2 * F.col("n")) - z * F.sqrt((part * (1 - part) + zz / (4 * F.col("n"))) / F.col("n"))) / (1 + zz / F.col("n"))
    candidates = {r["feature"] for r in counts.where((F.col("toxic") >= least) & (lower > min(0.5, LIFT * share))).select("feature").collect()}
    if not candidates:
        return frozenset()

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_pieces(batches):
            found, known = set(), {}
            for t in texts:
                tokens = ["", *t.decode("utf-8", "replace").split(), ""]
                for k, w in enumerate(tokens[1:-1], 1):
                    if (own := known.get(w)) is None:
                        own = known[w] = matched(w, candidates)
                    for f in own:
                        found.add((f, f"{tokens[k - 1]} {tokens[k + 1]}"))
            rows = sorted(found)
            yield pa.RecordBatch.from_pydict({"feature": pa.array([f for f, _ in rows], pa.string()), "beside": pa.array([x for _, x in rows], pa.string())})

    places_of = sample.where("y = 1").mapInArrow(places, "feature string, beside string").groupBy("feature").agg(F.count_distinct("beside").alias("places"))
    return frozenset(r["feature"] for r in places_of.where(F.col("places") >= least).select("feature").collect())


def matched(token: str, candidates: set[str] | frozenset[str]) -> list[str]:
    """The candidates that match: the whole word, or else its beginnings."""
    own = [f for f in labelling_features(token) if f in candidates]
    return own[:1] if own and own[0][0] == "w" else own


def chain_vocabulary(sample: DataFrame, labelling: frozenset[str]) -> np.ndarray:
    """The slots that ``LEAST`` labelled tokens of toxic documents have, in order."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(SLOTS, np.int64)
        for _, texts in text_pieces(batches):
            tokens, which, sizes = _numbered(texts)
            if not tokens:
                continue
            hit = np.array([bool(matched(w, labelling)) for w in tokens])
            token, slot, left, right = chain_features(tokens)
            times = np.bincount(which, hit[which], len(tokens)).astype(np.int64)
            count += np.bincount(slot, times[token], SLOTS).astype(np.int64)
            inner = np.flatnonzero(~first_tokens(sizes))
            count += np.bincount(left[which[inner - 1]], hit[which[inner]], SLOTS).astype(np.int64)
            count += np.bincount(right[which[inner]], hit[which[inner - 1]], SLOTS).astype(np.int64)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"slot": some, "n": count[some]})

    got = sample.where("y = 1").mapInArrow(seen, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    return np.array(sorted(r["slot"] for r in got.where(F.col("n") >= LEAST).select("slot").collect()), np.int64)


def _numbered(texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct tokens of a piece, the number of each of its tokens, and the tokens of each text."""
    split = [t.decode("utf-8", "replace").split() for t in texts]
    words: dict[str, int] = {}
    which = np.array([words.setdefault(w, len(words)) for t in split for w in t], np.int64)
    return list(words), which, np.array([len(t) for t in split], np.int64)


_PIECE = "sizes array<int>, tokens array<int>, truth array<byte>, word array<int>, own array<int>, before array<int>, after array<int>"


def _encoded(features: np.ndarray, labelling: frozenset[str]):
    """A row per piece of the sample: its sequences as numbers of the piece's words, the labels of tokens, and (word, feature) for the words' features; of neighbours -1 for none."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.full(SLOTS, -1, np.int32)
        number[features] = np.arange(len(features))
        for piece, texts in text_pieces(batches):
            words, which, sizes = _numbered(texts)
            if not words:
                continue
            hit = np.array([bool(matched(w, labelling)) for w in words])
            word, slot, left, right = chain_features(words)
            own = number[slot]
            row = {
                "sizes": sizes, "tokens": which, "truth": (hit[which] & np.repeat(piece.column("y").to_numpy() > 0, sizes)).astype(np.int8),
                "word": word[own >= 0], "own": own[own >= 0], "before": number[left], "after": number[right],
            }
            yield pa.RecordBatch.from_pydict({k: pa.array([v], pa.list_(pa.int8() if k == "truth" else pa.int32())) for k, v in row.items()})

    return encode


def train_crf(sample: DataFrame, labelling: frozenset[str], features: np.ndarray, rounds: int = 20, l2: float = 0.5) -> ChainCRF:
    """Gradient ascent on the regularised likelihood; each round is one pass summed by partition."""
    pieces = save(sample.mapInArrow(_encoded(features, labelling), _PIECE), "crf-sequences")
    k = len(features)
    theta = np.concatenate([np.zeros(k), [-3.0], [-0.5, -0.5, 0.0]])  # weights, bias, transitions 01, 10, 11

    def gradient(theta: np.ndarray) -> np.ndarray:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k + 4)
            padded = np.append(theta[:k], 0.0)  # the last for a neighbour without a feature
            trans = np.array([[0.0, theta[k + 1]], [theta[k + 2], theta[k + 3]]])
            for b in batches:
                for i in range(b.num_rows):
                    sizes, tokens, truth, word, own, before, after = (b.column(c)[i].values.to_numpy() for c in ("sizes", "tokens", "truth", "word", "own", "before", "after"))
                    n_words = len(before)
                    inner = np.flatnonzero(~first_tokens(sizes))
                    unary = np.bincount(word, theta[own], n_words)[tokens] + theta[k]
                    unary[inner] += padded[before][tokens[inner - 1]]
                    unary[inner - 1] += padded[after][tokens[inner]]
                    p, pairs, _ = forward_backward(unary, sizes, trans)
                    miss = truth - p
                    total[:k] += np.bincount(own, np.bincount(tokens, miss, n_words)[word], k)
                    for side, near, at in ((before, inner - 1, inner), (after, inner, inner - 1)):
                        of = np.bincount(tokens[near], miss[at], n_words)
                        total[:k] += np.bincount(side[side >= 0], of[side >= 0], k)
                    total[k] += miss.sum()
                    now, was = truth[inner], truth[inner - 1]
                    total[k + 1 :] += np.array([((1 - was) * now).sum(), (was * (1 - now)).sum(), (was * now).sum()]) - [pairs[0, 1], pairs[1, 0], pairs[1, 1]]
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"i": some, "v": total[some]})

        got = pieces.mapInArrow(part, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        total = np.zeros(k + 4)
        for r in got:
            total[r["i"]] = r["v"]
        return total - l2 * theta

    # steps are of one size for the features of most tokens and smaller for rare ones, so that what words share learns first
    memory, rare = np.full(len(theta), 1e-8), 0.0
    for _ in range(rounds):
        slope = gradient(theta)
        memory = 0.7 * memory + 0.3 * slope**2
        rare = rare or 0.3 * float(np.sqrt(memory[:k]).max()) + 1.0
        theta = theta + 0.5 * slope / (np.sqrt(memory) + np.append(np.full(k, rare), [1.0] * 4))
    drop(pieces)
    return ChainCRF(features, theta[:k], float(theta[k]), np.array([[0.0, theta[k + 1]], [theta[k + 2], theta[k + 3]]]))


def calibrate(model: ChainCRF, sample: DataFrame) -> ChainCRF:
    """The model with the evidence per token of toxic and of other documents, and the isotonic levels."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emissions = model.emissions()
        for piece, texts in text_pieces(batches):
            evidence, sizes, _ = model.tag([t.decode("utf-8", "replace") for t in texts], emissions)
            yield pa.RecordBatch.from_pydict({"told": evidence, "size": sizes, "y": piece.column("y").cast(pa.int64())})

    rows = save(sample.mapInArrow(told, "told double, size long, y long"), "crf-evidence")
    s = {r["y"]: (r["told"], r["size"]) for r in rows.groupBy("y").agg(F.sum("told").alias("told"), F.sum("size").alias("size")).collect()}
    per = {y: (s[y][0] or 0.0) / max(1, s[y][1] or 0) for y in s}
    other = max(per.get(0, 0.0), 1e-6)
    rated = ChainCRF(model.features, model.weights, model.bias, model.transition, (max(per.get(1, 0.0), 2 * other), other))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = rated.raw(b.column("told").to_numpy(), b.column("size").to_numpy())
            yield pa.RecordBatch.from_pydict({"bin": np.floor(raw * BINS).astype(np.int64), "y": b.column("y")})

    hist = rows.mapInArrow(binned, "bin long, y long").groupBy("bin").agg(F.sum("y").alias("good"), F.count(F.lit(1)).alias("n")).collect()
    drop(rows)
    # a bin without documents has the ratio itself as its level, where its neighbours leave room for that
    middle = (np.arange(BINS + 1) + 0.5) / BINS
    good, n = 0.02 * np.minimum(middle, 1.0), np.full(BINS + 1, 0.02)
    for r in hist:
        good[r["bin"]] += r["good"]
        n[r["bin"]] += r["n"]
    ends, levels = isotonic((np.arange(BINS + 1) + 1) / BINS, good, n)
    return ChainCRF(model.features, model.weights, model.bias, model.transition, rated.rates, ends, levels)


def train(docs: DataFrame, labels: DataFrame, max_rows: int) -> ChainCRF:
    known, n = bounded_labels(labels, "toxic", max_rows)
    if not n:
        return ChainCRF()
    # an id and a label for each of about max_rows rows: broadcast, so that no texts move
    known = save(known, "labels")
    sample = save(docs.join(F.broadcast(known), "doc_id").select(F.col("text").cast("string"), "y"), "toxicity-sample")
    labelling = toxic_features(sample, sample.agg(F.coalesce(F.avg("y"), F.lit(0.0))).first()[0])
    features = chain_vocabulary(sample, labelling) if labelling else np.zeros(0, np.int64)
    model = calibrate(train_crf(sample, labelling, features), sample) if len(features) else ChainCRF()
    drop(known, sample)
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) of every document; spans hold character offsets."""
    rows = docs.select("doc_id", F.col("text"))
    model = train(rows, labels, max_rows)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emissions = model.emissions()
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))
        for piece, texts in text_pieces(batches):
            strings = [t.decode("utf-8", "replace") for t in texts]
            told, sizes, spans = model.tag(strings, emissions)
            yield pa.RecordBatch.from_pydict({
                "doc_id": piece.column("doc_id"), "score": model.calibrated(model.raw(told, sizes)),
                "spans": pa.array([offsets(t, s) for t, s in zip(strings, spans)], kind),
            })

    ids = rows.select("doc_id", F.col("text").cast("string"))
    out = ids.mapInArrow(scored, f"doc_id {dict(ids.dtypes)['doc_id']}, score double, spans array<struct<start:long,end:long,marginal:double>>")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "spans")


def op10_chain_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
