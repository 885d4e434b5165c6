"""Mixing sources to target weights by soft membership.

DataFrame functions only. A document's domain is not read off a tag: a classifier learned from
the labelled table gives every document a posterior over the domains. Words are hashed into
``BUCKETS``; on one half of the labelled sample each bucket gets its smoothed log odds for each
domain, on the other half a softmax regression over summaries of those odds (mean and largest of
the document's distinct words), its share of distinct words and its length is fitted by Newton
steps, each one aggregation.

Rates of documents are then fitted: nonnegative and as near to one as can be (distances weighted
by a document's tokens), so that the expected tokens of each domain, the sum over documents of
rate, tokens and posterior, come to the domain's share of the token budget. In these units the
gradient of a document's rate is its posterior times a vector of the domains, so all steps taken
so far add up to one such vector; the rate is one less its product with the posterior, projected
on what is not negative. A step needs one aggregation of a few numbers per domain and is scaled by
the curvature of the documents whose rate is not zero. A rate is a function of the posterior and
of that vector, so no state is joined, and a document leaves only if its own posterior says so.

Null and empty texts have no tokens and a posterior like any other. Repeated rows each get the
same rate. Ids without a label, with a null one, or held out, teach nothing; an id with several
labels teaches the first domain of them in the order of the targets. Without any labels all
posteriors are equal. A domain that no document belongs to cannot reach its target; rates then
stay near one. An empty table gives an empty table. A text of any length is one row of a few
numbers once its words are counted. Extra input columns are not carried by the query; the stage
carries them whatever their names and replaces ``rate`` and ``copies``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import log

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import held_out, table
from tidelog.session import drop, save

BUCKETS = 16384
#: Log odds of a word beyond which it speaks for a domain by itself.
STRONG = 0.8
#: Domains of the labelled table with the share of tokens that each is to have.
TARGETS = {"good": 0.9, "poor": 0.08, "toxic": 0.02}
#: Between words: every ASCII character but letters, digits and the bar.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B\x7D-\x7F]+"


def label_domain() -> Column:
    """The domain of a row of ``labels``; null where its labels are."""
    return F.when(F.col("toxic") == 1, F.lit("toxic")).when(F.col("quality") == 0, F.lit("poor")).when(F.col("quality") == 1, F.lit("good"))


def array_of(values: Sequence[float]) -> Column:
    """A constant array; the optimizer folds it into one literal, so that the generated code is the same for all values."""
    return F.split(F.lit(",".join(f"{v:.12g}" for v in values)), ",").cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def with_words(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, the number of words and the distinct buckets of the whole text."""
    words = docs.select(*keep, F.array_remove(F.split(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), BETWEEN), "").alias("_words"))
    return words.select(*keep, F.size("_words").cast("long").alias("_n"), F.array_distinct(F.transform("_words", lambda w: F.pmod(F.hash(w), F.lit(BUCKETS)))).alias("_buckets"))


def odds_summaries(got: Column) -> list[Column]:
    """Mean and largest of the odds ``got`` of a document's distinct buckets, and how far in sum they go beyond ``STRONG``."""
    mean = F.aggregate(got, F.lit(0.0), lambda s, v: s + v) / F.greatest(F.size(got), F.lit(1))
    strong = F.aggregate(got, F.lit(0.0), lambda s, v: s + F.greatest(v - STRONG, F.lit(0.0)))
    return [mean, F.coalesce(F.array_max(got), F.lit(0.0)), F.log1p(strong)]


def with_features(docs: DataFrame, keep: list[str], odds: list[list[float]]) -> DataFrame:
    """``keep``, ``_n`` and the features ``_x`` of the whole text."""
    odds_of = lambda values: F.transform("_buckets", lambda b: values[b])
    rows = with_words(docs, keep).select(*keep, "_n", "_buckets", *(odds_of(array_of(v)).alias(f"_o{i}") for i, v in enumerate(odds)))
    x = [F.size("_buckets") / F.greatest(F.col("_n"), F.lit(1)), F.log1p(F.col("_n").cast("double"))]
    for i in range(len(odds)):
        x += odds_summaries(F.col(f"_o{i}"))
    return rows.select(*keep, "_n", F.array(*x).alias("_x"))


def bucket_odds(rows: DataFrame, domains: list[str], prior_rows: float = 8.0) -> list[list[float]]:
    """Log odds of each bucket for each domain but the first, from rows of (_buckets, domain)."""
    is_domain = [F.count_if(F.col("domain") == k) for k in domains]
    base = rows.agg(*(c.alias(f"k{i}") for i, c in enumerate(is_domain))).first()
    n = max(1, sum(base))
    share = [(base[i] + 1) / (n + len(domains)) for i in range(len(domains))]
    counts = rows.select("domain", F.explode("_buckets").alias("b")).groupBy("b").agg(*(c.alias(f"k{i}") for i, c in enumerate(is_domain))).collect()
    out = [[0.0] * BUCKETS for _ in domains[1:]]
    for r in counts:
        have = sum(r[1:])
        for i in range(1, len(domains)):
            out[i - 1][r["b"]] = round(log((r[i + 1] + prior_rows * share[i]) / (have + prior_rows) / share[i]), 3)
    return out


@dataclass(frozen=True)
class Membership:
    """A fitted classifier: bucket odds, the features' centres and scales, and a weight row for each domain but the first."""

    domains: list[str]
    odds: list[list[float]]
    centre: list[float]
    scale: list[float]
    weights: list[list[float]]

    def inputs(self) -> Column:
        """The standardised features and the constant one."""
        apart = F.zip_with(F.col("_x"), array_of(self.centre), lambda x, c: x - c)
        return F.concat(F.zip_with(apart, array_of(self.scale), lambda x, s: x / s), F.array(F.lit(1.0)))

    def posterior(self, z: Column) -> Column:
        """The posterior of each domain as an array, from standardised features."""
        k = len(self.domains) - 1
        flat = array_of([w for row in self.weights for w in row]) if k else F.array().cast("array<double>")
        d = len(self.centre) + 1
        rows = F.transform(F.sequence(F.lit(1), F.lit(k * d), F.lit(d)), lambda a: F.slice(flat, a, d)) if k else F.array().cast("array<array<double>>")
        score = F.transform(rows, lambda w: F.exp(F.least(F.greatest(dot(w, z), F.lit(-30.0)), F.lit(30.0))))
        every = F.concat(F.array(F.lit(1.0)), score)
        sum_of = F.aggregate(every, F.lit(0.0), lambda s, v: s + v)
        return F.transform(every, lambda v: v / sum_of)

    def posteriors(self, docs: DataFrame, keep: list[str]) -> DataFrame:
        """``keep``, ``_n`` and the posteriors ``_p`` of each document."""
        rows = with_features(docs, keep, self.odds).select(*keep, "_n", self.inputs().alias("_z"))
        return rows.select(*keep, "_n", self.posterior(F.col("_z")).alias("_p"))


def sums_of(rows: DataFrame, values: Column) -> np.ndarray:
    """The element-wise sum of an array column, all of one length, added up before the shuffle."""
    got = rows.select(F.posexplode(values).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(max((r["i"] for r in got), default=-1) + 1)
    for r in got:
        out[r["i"]] = r["v"] or 0.0
    return out


def fit_membership(docs: DataFrame, labels: DataFrame, domain: Column, domains: list[str], max_labels: int = 20_000, ridge: float = 1.0, steps: int = 7) -> Membership:
    """Learn from about ``max_labels`` labelled rows at most, chosen by a hash of the id."""
    rank = F.array_position(F.array(*map(F.lit, domains)), domain)
    known = labels.select("doc_id", rank.alias("rank")).where(F.col("doc_id").isNotNull() & (F.col("rank") > 0) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("rank").alias("rank"))
    n = known.count()
    if n > max_labels:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < int(1_000_000 * max_labels / n))
    # an id and a number for each of about max_labels rows: broadcast, so that no texts move
    chosen = save(known.select("doc_id", F.element_at(F.array(*map(F.lit, domains)), F.col("rank").cast("int")).alias("domain"), (F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(2)) == 0).alias("first")), "mixing-labels")
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = save(sample.select("domain", "first", "text"), "mixing-sample")
    odds = bucket_odds(with_words(rows.where("first"), ["domain"]), domains)
    second = save(with_features(rows.where(~F.col("first")), ["domain"], odds), "mixing-features")
    d = 2 + 3 * len(odds)
    s = sums_of(second, F.concat(F.array(F.lit(1.0)), F.col("_x"), F.transform("_x", lambda x: x * x)))
    if len(s):
        centre = s[1 : d + 1] / s[0]
        scale = np.sqrt(np.maximum(s[d + 1 :] / s[0] - centre**2, 1e-6))
    else:
        centre, scale = np.zeros(d), np.ones(d)
    model = Membership(domains, odds, centre.tolist(), scale.tolist(), [[0.0] * (d + 1) for _ in odds])
    for _ in range(steps if len(s) else 0):
        model = newton_step(model, second, ridge)
    drop(chosen, rows, second)
    return model


def newton_step(model: Membership, rows: DataFrame, ridge: float) -> Membership:
    """One Newton step of the ridge softmax regression; the sums are of a fixed size."""
    d, k = len(model.centre) + 1, len(model.domains) - 1
    if not k:
        return model
    p = rows.select("domain", model.inputs().alias("_z")).select("_z", F.slice(model.posterior(F.col("_z")), 2, k).alias("_p"), F.array(*((F.col("domain") == x).cast("double") for x in model.domains[1:])).alias("_y"))
    times = lambda a, b: F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x * y)))
    miss = F.zip_with("_p", "_y", lambda a, b: a - b)
    # p_a ([a = b] - p_b) for each pair of domains
    spread = F.flatten(F.transform("_p", lambda a, i: F.transform("_p", lambda b, j: F.when(i == j, a * (1 - b)).otherwise(-a * b))))
    got = sums_of(p, F.concat(times(miss, F.col("_z")), times(spread, times(F.col("_z"), F.col("_z")))))
    flat = np.array(model.weights).ravel()
    penalty = np.tile(np.append(np.full(d - 1, ridge), 1e-3), k)
    g = got[: k * d] + penalty * flat
    h = got[k * d :].reshape(k, k, d, d).transpose(0, 2, 1, 3).reshape(k * d, k * d) + np.diag(penalty)
    step = np.clip(np.linalg.solve(h, g), -4, 4)
    return Membership(model.domains, model.odds, model.centre, model.scale, (flat - step).reshape(k, d).tolist())


def rate_after(steps: Sequence[float]) -> Column:
    """The rate of ``_p`` after steps that add up to ``steps``."""
    return F.greatest(F.lit(1.0) - dot(F.col("_p"), array_of(steps)), F.lit(0.0))


def fit_rates(rows: DataFrame, targets: list[float], budget: float | None = None, max_steps: int = 8, tolerance: float = 0.002) -> list[float]:
    """The sum of the projected gradient steps, a number per domain, for rows of (_n, _p).

    The fit minimises the squared errors of the domains' shares of the budget plus ``ridge`` times
    the weighted squared distances of rates from one, for ridges ten times smaller from one to the
    next. It ends when every domain is within ``tolerance`` of its target, or when a smaller ridge
    does not halve the error: the targets are then out of reach, and rates are not torn further
    apart for them.
    """
    k = len(targets)

    def sums(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rated = rows.select("_n", "_p", rate_after(at.tolist()).alias("_rate"))
        live = F.when(F.col("_rate") > 0, F.col("_n")).otherwise(F.lit(0)).cast("double")
        values = F.concat(F.transform("_p", lambda p: p * F.col("_rate") * F.col("_n")), F.flatten(F.transform("_p", lambda p: F.transform("_p", lambda q: p * q * live))))
        got = sums_of(rated, values)
        got = got if len(got) else np.zeros(k + k * k)
        return got[:k], got[k:].reshape(k, k)

    at = np.zeros(k)
    now, bend = sums(at)
    whole = (float(now.sum()) if budget is None else budget) or 1.0
    goal = np.array(targets) / sum(targets)
    best, error = at, now / whole - goal
    for ridge in (1e-2, 1e-3, 1e-4):
        if not now.sum() or (np.abs(error) <= tolerance * goal).all():
            break
        miss = lambda t, x: t / whole - goal - ridge * x
        for _ in range(max_steps):
            left, size = miss(now, at), 1.0
            if np.abs(left).max() < 0.1 * tolerance * goal.min():
                break
            step = np.linalg.solve(bend / whole + ridge * np.eye(k), left)
            while True:
                then, curve = sums(at + size * step)
                if size < 0.1 or np.linalg.norm(miss(then, at + size * step)) < np.linalg.norm(left):
                    break
                size /= 2
            at, now, bend = at + size * step, then, curve
        if np.linalg.norm(now / whole - goal) > 0.5 * np.linalg.norm(error) and ridge < 1e-2:
            break
        best, error = at, now / whole - goal
    return best.tolist()


def draw(rate: Column, *by: Column) -> Column:
    """Whole copies whose mean is the rate: the draw is a hash of ``by``, the same on every run."""
    u = F.pmod(F.xxhash64(*by, F.lit(29)), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate + u).cast("int")


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, domain: Column | None = None, budget: float | None = None) -> DataFrame:
    """(doc_id, n_tokens, a posterior p_<domain> for each domain, rate) of every document."""
    names = list(targets)
    model = fit_membership(docs, labels, label_domain() if domain is None else domain, names)
    rows = save(model.posteriors(docs, ["doc_id"]), "memberships")
    steps = fit_rates(rows, list(targets.values()), budget)
    return rows.select("doc_id", F.col("_n").alias("n_tokens"), *(F.col("_p")[i].alias(f"p_{k}") for i, k in enumerate(names)), rate_after(steps).alias("rate"))


def op6_soft_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def apply_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each row with its rate and the copies drawn for it; rows of no copies leave.

    A row's rate follows from its own text and the fitted steps, so no texts are shuffled. The
    rated rows are written before rows leave: a filter on the copies would otherwise be pushed to
    the scan with the whole computation of rates written out in it. Without labels, and for
    targets that hold already, every rate is one.
    """
    names = list(TARGETS)
    model = fit_membership(docs, table(spark, sf_dir, "labels"), label_domain(), names)
    rows = save(model.posteriors(docs, []), "memberships")
    steps = fit_rates(rows, list(TARGETS.values()))
    drop(rows)
    keep = [c for c in docs.columns if c.lower() not in ("rate", "copies")]
    # the row's own columns travel in a struct, where no name clashes
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), "text")
    rated = model.posteriors(packed, ["row"]).select("row", rate_after(steps).alias("rate"))
    drawn = rated.select("row.*", "rate", draw(F.col("rate"), F.col("row.doc_id"), F.col("row.text")).alias("copies"))
    return save(drawn, "rated").where("copies > 0")
