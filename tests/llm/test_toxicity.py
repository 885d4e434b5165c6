import itertools
import random
import zlib
from collections import Counter

import numpy as np

from tidelog.llm.toxicity import BEGINS, ENDS, SLOTS, ChainCRF, Emissions, chain_features, forward_backward, plain, score_toxicity
from pyspark.sql import functions as F

WORDS = [f"word{i}" for i in range(300)]
BAD = ["vileness", "scumbag", "hateful"]


def corpus(n=900, seed=1):
    pick = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words, toxic = pick.choices(WORDS, k=pick.randrange(10, 120)), pick.random() < 0.25
        for _ in range(pick.randrange(1, 4) if toxic else 0):
            words.insert(pick.randrange(len(words)), pick.choice(BAD) + pick.choice(["", ",", "."]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy_spans_and_edges(spark):
    docs, labels = corpus()
    edges = [(9000, None), (9001, ""), (9002, " \n"), (9003, "word1 " * 60_000 + "Scumbag!"), (None, "you scumbag"), (5, "again")]
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs + edges], "doc_id long, text string, y string")
    out = score_toxicity(d, spark.createDataFrame(labels + [(1, None), (None, 0)], "doc_id long, toxic int")).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, _ in docs + edges)
    truth = dict(labels)
    known = [r for r in out if r["doc_id"] in truth and r["doc_id"] != 5]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in known if r["held_out"]]) > 0.95
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    texts = dict(docs)
    found = [texts[r["doc_id"]][s["start"] : s["end"]] for r in known for s in r["spans"]]
    assert len(found) > 100 and all(any(b in f for b in BAD) for f in found)
    by = {r["doc_id"]: r for r in out}
    assert by[9000]["predicted"] == by[9001]["predicted"] == by[9002]["predicted"] == 0
    assert by[9003]["spans"][0]["start"] == 360_000 and by[None]["predicted"] == 1


def test_forward_backward_is_exact_by_enumeration():
    draw = np.random.default_rng(2)
    sizes = np.array([3, 0, 1, 6, 4])
    unary, trans = draw.normal(0, 2, sizes.sum()), draw.normal(0, 1, (2, 2))
    trans[0, 0] = 0.0
    p, pairs, log_z = forward_backward(unary, sizes, trans)
    want, want_pairs, z, at = [], np.zeros((2, 2)), 0.0, 0
    for n in sizes:
        u = unary[at : at + n]
        at += n
        if not n:
            continue
        weight, ones, two = 0.0, np.zeros(n), np.zeros((2, 2))
        for path in itertools.product([0, 1], repeat=int(n)):
            w = np.exp(sum(u[i] * path[i] for i in range(n)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
            weight += w
            ones += w * np.array(path)
            for a, b in zip(path, path[1:]):
                two[a, b] += w
        want += (ones / weight).tolist()
        want_pairs += two / weight
        z += np.log(weight)
    assert np.allclose(p, want) and np.allclose(pairs, want_pairs) and np.isclose(log_z, z)


def test_long_sequences_are_exact_by_a_plain_recursion():
    draw = np.random.default_rng(5)
    sizes = np.array([1, 64, 65, 0, 5000, 63, 129, 1, 1])
    unary, trans = draw.normal(-1, 3, sizes.sum()), np.array([[0.0, -0.7], [0.4, 1.1]])
    p, pairs, log_z = forward_backward(unary, sizes, trans)
    want, z, two, at = [], 0.0, 0.0, 0
    for n in sizes[sizes > 0]:
        u = unary[at : at + n]
        at += n
        f, b = np.zeros((n, 2)), np.zeros((n, 2))
        f[0, 1] = u[0]
        for t in range(1, n):
            f[t] = [np.logaddexp(f[t - 1, 0] + trans[0, k], f[t - 1, 1] + trans[1, k]) + k * u[t] for k in (0, 1)]
        for t in range(n - 2, -1, -1):
            b[t] = [np.logaddexp(b[t + 1, 0] + trans[k, 0], b[t + 1, 1] + trans[k, 1] + u[t + 1]) for k in (0, 1)]
        total = np.logaddexp(*f[-1])
        z += total
        want += np.exp(f[:, 1] + b[:, 1] - total).tolist()
        two += sum(np.exp(f[t, 1] + trans[1, 1] + u[t + 1] + b[t + 1, 1] - total) for t in range(n - 1))
    assert np.allclose(p, want) and np.isclose(log_z, z) and np.isclose(pairs[1, 1], two)


def test_emissions_are_sums_over_own_and_neighbouring_features():
    tokens, sizes = "Vile words, here Vile ß2 -- été".split(), np.array([2, 0, 5])
    table = np.random.default_rng(1).normal(size=SLOTS)
    e = Emissions(table, -2.0)
    want = []
    for a, n in ((0, 2), (2, 5)):
        for i in range(a, a + n):
            _, own, _, _ = chain_features([tokens[i]])
            size = len(plain(tokens[i]).encode())
            assert len(own) == (size > 0) + sum(size > k for k in (*BEGINS, *ENDS)) + max(0, size - 2) + 1
            score = -2.0 + table[own].sum()
            score += table[chain_features([tokens[i - 1]])[2][0]] if i > a else 0
            want.append(score + (table[chain_features([tokens[i + 1]])[3][0]] if i < a + n - 1 else 0))
    for _ in range(2):  # the second time from the cache
        assert np.allclose(e.of(tokens, sizes), want)
    assert len(e.of([], np.array([0]))) == 0


def test_pieces_of_words_have_one_slot_wherever_they_stand():
    token, slot, left, _ = chain_features(["abcdefgh", "Abcdef", "xxabc", "abc"])
    at = lambda i: set(slot[token == i].tolist())
    assert len(at(0) & at(1)) >= 4 + 3 and at(2) & at(3) and left[0] == left[1] == left[3] != left[2]


def test_a_word_that_was_never_labelled_is_found_by_what_it_shares(spark):
    """Toxic words are made of two stems and ever other endings; those of the held-out rows are not in the others."""
    pick = random.Random(7)
    ends = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe") for b in "bcdfghjkmnprst"]
    docs, labels, fresh = [], [], {}
    for i in range(1200):
        held = zlib.crc32(str(i).encode()) % 3 == 1
        words, toxic = pick.choices(WORDS, k=pick.randrange(20, 90)), pick.random() < 0.3
        for _ in range(3 if toxic else 0):
            words.insert(pick.randrange(len(words)), pick.choice(["vrogg", "zlimp"]) + (pick.choice(ends[35:]) if held else pick.choice(ends[:35])))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
        fresh[i] = held
    out = score_toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    truth = dict(labels)
    assert np.mean([r["predicted"] for r in out if fresh[r["doc_id"]] and truth[r["doc_id"]]]) > 0.9
    assert np.mean([r["predicted"] for r in out if fresh[r["doc_id"]] and not truth[r["doc_id"]]]) < 0.02


def test_held_out_labels_teach_nothing(spark):
    docs, labels = corpus(400)
    d, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    turned = marks.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = lambda m: {r["doc_id"]: round(r["score"], 9) for r in score_toxicity(d, m).collect()}
    assert scores(marks) == scores(turned)


def test_without_labels_nothing_is_toxic_and_empty_tables_are_fine(spark):
    d = spark.createDataFrame(corpus(30)[0], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["predicted"] for r in score_toxicity(d, none).collect()} == {0}
    assert score_toxicity(d.where("false"), none).count() == 0
    clean = spark.createDataFrame([(i, 0) for i in range(30)], "doc_id long, toxic int")
    assert {r["predicted"] for r in score_toxicity(d, clean).collect()} == {0}
    assert ChainCRF().tag(["", "a b"], ChainCRF().emissions())[2] == [[], []]
