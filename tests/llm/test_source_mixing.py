import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm.source_mixing import BUCKETS, apply_mixture, draw, fit_rates, mixing_rates, rate_after, with_words

TARGETS = {"good": 0.6, "poor": 0.3, "toxic": 0.1}


def corpus(n=900, seed=1):
    pick = random.Random(seed)
    common, own = [f"w{i}" for i in range(400)], {"poor": ["spam", "buy", "now"], "toxic": ["awful", "vile"], "good": []}
    docs, labels = [], []
    for i in range(n):
        kind = pick.choices(["good", "poor", "toxic"], [0.7, 0.2, 0.1])[0]
        words = pick.choices(common, k=pick.randrange(5, 80))
        for w in own[kind]:
            words.insert(pick.randrange(len(words)), w)
        docs.append((i, " ".join(words), kind))
        if i % 2 == 0:
            labels.append((i, int(kind != "poor"), int(kind == "toxic")))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    edges = [(5000, None, "good"), (5001, "", "good"), (5002, " \n", "good"), (None, "w1 w2", "good"), (3, "w1 again", "good"), (5003, "w5 " * 50000, "good")]
    d = spark.createDataFrame(docs + edges, "doc_id long, text string, rate string").withColumnRenamed("rate", "rate")
    return d, spark.createDataFrame(labels + [(7, None, None), (None, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int"), docs


def test_classifier_is_right_on_unseen_rows_and_totals_meet_the_targets(tables):
    docs, labels, plain = tables
    out = mixing_rates(docs, labels, TARGETS).collect()
    assert len(out) == docs.count()
    kinds = {d: k for d, _, k in plain}
    best = {r["doc_id"]: max(TARGETS, key=lambda k: r[f"p_{k}"]) for r in out if r["doc_id"] in kinds and r["doc_id"] % 2}
    assert np.mean([best[d] == kinds[d] for d in best]) > 0.9
    assert all(abs(sum(r[f"p_{k}"] for k in TARGETS) - 1) < 1e-9 and r["rate"] >= 0 for r in out)
    whole = sum(r["n_tokens"] for r in out)
    for k, t in TARGETS.items():
        assert sum(r["rate"] * r["n_tokens"] * r[f"p_{k}"] for r in out) == pytest.approx(t * whole, rel=0.01)
    assert {r["n_tokens"] for r in out if r["doc_id"] in (5000, 5001, 5002)} == {0}


def nearest_rates(n, p, goal):
    """Brute force: the rates nearest to one with the given totals, by Dykstra's projections in the norm weighted by ``n``."""
    r, above = np.ones(len(n)), np.zeros(len(n))
    q = p * n[:, None]
    inverse = np.linalg.inv(q.T @ p)
    for _ in range(20_000):
        y = r - p @ (inverse @ (q.T @ r - goal))
        r = np.maximum(y + above, 0)
        above = y + above - r
    return r


def test_rates_are_the_nearest_to_one_that_meet_the_targets(spark):
    draws = np.random.default_rng(2)
    n, p = draws.integers(1, 300, 200).astype(float), draws.dirichlet([0.4, 0.4, 0.4], 200)
    rows = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "_n long, _p array<double>")
    goal = np.array([0.2, 0.2, 0.6])
    steps = fit_rates(rows, goal.tolist(), tolerance=1e-4)
    got = np.array([x[0] for x in rows.select(rate_after(steps)).collect()])
    assert np.allclose(got, np.maximum(1 - p @ np.array(steps), 0), atol=1e-8)
    assert np.allclose((got * n) @ p, goal * n.sum(), rtol=1e-3)
    assert np.allclose(got, nearest_rates(n, p, goal * n.sum()), atol=0.01)


def test_out_of_reach_targets_leave_rates_near_one(spark):
    draws = np.random.default_rng(3)
    p = draws.dirichlet([30, 0.3, 0.1], 300)
    p[:, 1] = np.minimum(p[:, 1], 0.03)
    p[:, 0] = 1 - p[:, 1] - p[:, 2]
    rows = spark.createDataFrame([(100, b.tolist()) for b in p], "_n long, _p array<double>")
    rates = np.array([x[0] for x in rows.select(rate_after(fit_rates(rows, [0.9, 0.08, 0.02]))).collect()])
    assert (rates > 0.5).mean() > 0.95 and abs(rates.mean() - 1) < 0.2
    total = lambda r: np.abs(r @ p / 300 - [0.9, 0.08, 0.02]).sum()
    assert total(rates) < total(np.ones(300))


def test_without_labels_all_posteriors_are_equal_and_empty_tables_are_fine(spark, tables):
    docs, labels, _ = tables
    got = mixing_rates(docs, labels.where("false"), TARGETS).select("p_good", "p_toxic").distinct().collect()
    assert len(got) == 1 and got[0][0] == pytest.approx(1 / 3)
    assert mixing_rates(docs.where("false"), labels, TARGETS).count() == 0


def test_words_and_buckets(spark):
    rows = spark.createDataFrame([(1, "The cat, the CAT | sat."), (2, None), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: (r["_n"], r["_buckets"]) for r in with_words(rows, ["doc_id"]).collect()}
    assert got[1][0] == 6 and len(got[1][1]) == 4 and all(0 <= b < BUCKETS for b in got[1][1])
    assert got[2] == (0, []) == got[3]


def test_draws_have_the_rate_as_their_mean(spark):
    got = spark.range(20000).select(draw(F.lit(1.3), F.col("id")).alias("c")).agg(F.avg("c"), F.min("c"), F.max("c")).first()
    assert got[0] == pytest.approx(1.3, abs=0.02) and (got[1], got[2]) == (1, 2)


def test_held_out_labels_teach_nothing(spark, tables):
    docs, labels, _ = tables
    turned = labels.withColumns({c: F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    key = lambda df: sorted(map(tuple, mixing_rates(docs, df, TARGETS).collect()), key=str)
    assert key(labels) == key(turned) != key(labels.where("doc_id > 300"))


def test_stage_keeps_rows_it_has_no_ground_to_drop_and_replaces_clashing_columns(spark, tables, tmp_path):
    docs, labels, plain = tables
    docs = docs.select("*", F.lit("mine").alias("_n"), F.lit("mine").alias("_P"), F.lit("mine").alias("row"), F.lit("mine").alias("_buckets"))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = apply_mixture(spark, docs, str(tmp_path))
    assert out.columns == ["doc_id", "text", "_n", "_P", "row", "_buckets", "rate", "copies"]
    got = out.collect()
    assert all(r["copies"] >= 1 and abs(r["copies"] - r["rate"]) < 1 and {r["_n"], r["_P"], r["row"], r["_buckets"]} == {"mine"} for r in got)
    good = {d for d, _, k in plain if k == "good"}
    assert len(good & {r["doc_id"] for r in got}) > 0.9 * len(good)
    labels.where("false").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert apply_mixture(spark, docs, f"{tmp_path}/none").count() == docs.count()
    assert apply_mixture(spark, docs.where("false"), str(tmp_path)).count() == 0


def test_main_path_has_no_python(spark, tables):
    docs, labels, _ = tables
    plan = mixing_rates(docs, labels, TARGETS)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
