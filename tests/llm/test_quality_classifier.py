import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tidelog.llm.common import isotonic
from tidelog.llm.quality_classifier import N_STATS, fit, keep_good, op8_fourier_ridge, score_documents, statistics


def corpus(n=800, seed=1):
    pick = random.Random(seed)
    words = [f"word{i}" for i in range(500)]
    docs, labels = [], []
    for i in range(n):
        good = pick.random() < 0.7
        text = " ".join(pick.choices(words, k=pick.randrange(30, 200))) if good else " | ".join(pick.choices(words[:9], k=60)) + "!!! $$"
        docs.append((i, text))
        labels.append((i, int(good)))
    return docs, labels


def held(d):
    return zlib.crc32(str(d).encode()) % 3 == 1


def test_held_out_accuracy_and_edges(spark):
    docs, labels = corpus()
    edges = [(9000, None), (9001, ""), (9002, " \n"), (9003, "x" * 200_000), (None, "some text"), (5, "again")]
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs + edges], "doc_id long, text string, score string")
    out = score_documents(d, spark.createDataFrame(labels + [(1, None), (None, 0)], "doc_id long, quality int")).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, _ in docs + edges)
    truth = dict(labels)
    hits = [r["predicted"] == truth[r["doc_id"]] for r in out if r["held_out"] and r["doc_id"] in truth and r["doc_id"] != 5]
    assert np.mean(hits) > 0.95
    assert all(r["held_out"] == (r["doc_id"] is not None and held(r["doc_id"])) for r in out)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs, labels = corpus(300)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    flipped = [(i, 1 - y if held(i) else y) for i, y in labels]
    a, b = ({r["doc_id"]: r["score"] for r in score_documents(d, spark.createDataFrame(x, "doc_id long, quality int")).collect()} for x in (labels, flipped))
    assert a == pytest.approx(b)


def test_fit_equals_the_closed_form(spark):
    docs, labels = corpus(200)
    x, y = np.array([statistics(t.encode()) for _, t in docs]), np.array([y for _, y in labels])
    model = fit(spark.createDataFrame([(r.tolist(), int(v)) for r, v in zip(x, y)], "stats array<double>, y int").repartition(5), len(y))
    z = model.features(x)
    want = np.linalg.solve(z.T @ z + np.eye(z.shape[1]), z.T @ y)
    assert np.allclose(model.weights, want, atol=1e-6)


def test_fourier_features_approximate_the_kernel(spark):
    docs, labels = corpus(200)
    x = np.array([statistics(t.encode()) for _, t in docs])
    model = fit(spark.createDataFrame([(r.tolist(), y) for r, (_, y) in zip(x, labels)], "stats array<double>, y int"), 200)
    u = np.clip((x - model.mean) / model.scale, -6, 6)[:40]
    exact = np.exp(-0.03 * ((u[:, None] - u[None]) ** 2).sum(-1))
    z = model.features(x)[:40, :-1]
    assert np.abs(z @ z.T - exact).mean() < 0.06


def test_isotonic_is_the_best_monotone_fit():
    draw = np.random.default_rng(3)
    good, n = draw.integers(0, 5, 12), np.full(12, 5)
    ends, rates = isotonic(np.arange(12.0), good, n)
    assert (np.diff(rates) > 0).all() and ends[-1] == 11
    level = rates[np.searchsorted(ends, np.arange(12.0))]
    best = min((5 * (good / 5 - np.sort(draw.random(12))) ** 2).sum() for _ in range(3000))
    assert (5 * (good / 5 - level) ** 2).sum() <= best + 1e-9


def test_without_labels_and_without_documents(spark):
    d = spark.createDataFrame(corpus(20)[0], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in score_documents(d, none).collect()} == {0.5}
    assert score_documents(d.where("false"), none).count() == 0
    assert len(statistics(b"")) == N_STATS and np.isfinite(statistics(b"")).all()


def test_stage_keeps_exactly_what_the_query_predicts(spark, tmp_path):
    docs, labels = corpus(300)
    d = spark.createDataFrame([(*x, "en") for x in docs] + [(9001, "", "fr"), (9002, None, "fr")], "doc_id long, text string, lang string")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = keep_good(spark, d, str(tmp_path))
    want = {r["doc_id"] for r in op8_fourier_ridge(spark, str(tmp_path)).where("predicted = 1").collect()}
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == want
