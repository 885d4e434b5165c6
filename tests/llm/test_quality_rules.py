import random
import re
from collections import Counter

import numpy as np

from tidelog.llm.quality_rules import FLOORS, SYMBOLS, WINDOW, fit_mcd, quality_rules

WORDS = [f"w{i}x" for i in range(400)]


def brute(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    runs = [tuple(words[i : i + WINDOW]) for i in range(len(words) - WINDOW + 1)]
    count = Counter(runs)
    covered = {i + k for i, r in enumerate(runs) if count[r] > 1 for k in range(WINDOW)}
    n, rep = len(words), len(covered)
    return n, sum(map(len, words)), sum(text.count(chr(c)) for c in SYMBOLS), dup, rep, n < 20 or 100 * rep > 30 * n


EDGES = [None, "", " ", "one", "é ü " * 30, "a b c d e f g h " * 20, "same line\nsame line\n\n \nsame line", "# * $ % & | < >" * 9, "x" * 50_000, "w " * 40_000, "tab\tvt\x0bff\x0ccr\rnbsp\u00a0one\u2028two " * 5]


def test_base_statistics_match_the_rules(spark):
    pick = random.Random(1)
    texts = EDGES + [" ".join(pick.choices(WORDS[: pick.choice([3, 30, 400])], k=pick.randrange(80))) for _ in range(200)]
    docs = spark.createDataFrame([(i if i % 9 else None, "en", None if i % 4 else "s", t, "clash") for i, t in enumerate(texts)], "doc_id long, lang string, source string, text string, kept string")
    out = quality_rules(docs).collect()
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in out)
    assert got == Counter((i if i % 9 else None, *brute(t)) for i, t in enumerate(texts))
    assert not any(r["kept"] and r["base_failed"] for r in out)


def test_outliers_are_rejected_and_clean_documents_kept(spark):
    pick = random.Random(2)
    rows = [(i, "en", "s", " ".join(pick.choices(WORDS, k=pick.randrange(60, 300)))) for i in range(600)]
    rows += [(1000 + i, "en", "s", " | ".join(pick.choices(WORDS, k=80)) + " #" * 60) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    out = {r["doc_id"]: r["kept"] for r in quality_rules(docs).collect()}
    assert not any(out[1000 + i] for i in range(12))
    assert np.mean([out[i] for i in range(600)]) > 0.99


def test_estimate_ignores_a_fifth_of_outliers(spark):
    draw = np.random.default_rng(4)
    x = np.vstack([draw.normal(0, 1, (2000, 5)), draw.normal(12, 1, (400, 5))])
    rows = spark.createDataFrame([("g", *map(float, r)) for r in x], "key string, x0 double, x1 double, x2 double, x3 double, x4 double")
    centre = fit_mcd(rows).first()["centre"]
    assert np.abs(centre).max() < 0.2


def brute_mcd(x, support=0.75, widen=1.3, starts=400, seed=1):
    """Least log determinant over many random starts of six rows, each concentrated until it stands still."""
    draw, best, floor = np.random.default_rng(seed), np.inf, np.square(FLOORS)
    for _ in range(starts):
        kept = x[draw.choice(len(x), 6, replace=False)]
        for _ in range(30):
            c, cov = kept.mean(axis=0), np.cov(kept.T, bias=True) * widen**2
            cov[np.diag_indices(5)] += np.maximum(0, floor - np.diag(cov)) + 0.01 * floor
            d2 = np.einsum("ij,jk,ik->i", x - c, np.linalg.inv(cov), x - c)
            now = x[d2 <= np.sort(d2)[int(np.ceil(support * len(x))) - 1]]
            if len(now) == len(kept) and (now == kept).all():
                break
            kept = now
        best = min(best, np.linalg.slogdet(cov)[1])
    return best


def test_estimates_are_as_good_as_brute_force(spark):
    draw = np.random.default_rng(6)
    parts, want = [], {}
    for g in range(4):
        shape = draw.normal(0, 2, (5, 5))
        x = draw.normal(0, 1, (240, 5)) @ shape
        x[: 40 + 10 * g] = draw.normal(0, 1, (40 + 10 * g, 5)) * 0.7 + draw.normal(0, 12, 5)  # a tight group of outliers
        parts += [(f"g{g}", *map(float, r)) for r in x]
        want[f"g{g}"] = brute_mcd(x)
    rows = spark.createDataFrame(parts, "key string, x0 double, x1 double, x2 double, x3 double, x4 double")
    got = {r["key"]: r["log_det"] for r in fit_mcd(rows).collect()}
    assert got.keys() == want.keys() and all(got[k] <= want[k] + 0.1 for k in want), (got, want)


def test_names_with_bars_are_groups_of_their_own_and_long_texts_fit(spark):
    pick = random.Random(3)
    text = lambda k: " ".join(pick.choices(WORDS, k=k))
    rows = [(i, "a|b", "c", text(pick.randrange(60, 120))) for i in range(250)] + [(1000 + i, "a", "b|c", text(pick.randrange(2000, 4000))) for i in range(250)]
    rows.append((5000, "a", "b|c", text(200_000)))
    out = {r["doc_id"]: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")).collect()}
    assert out[5000]["n_words"] == 200_000
    assert np.mean([out[i]["kept"] for i, *_ in rows[:-1]]) > 0.97


def test_empty_table(spark):
    assert quality_rules(spark.createDataFrame([], "doc_id long, lang string, source string, text string")).count() == 0
