import random
from collections import Counter

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.llm.simhash import COORDINATES, MASKS, RADIUS, SHINGLE, SKETCH_MASKS, SIMILAR, near_duplicates, one_of_each, similar_texts, sketch

WORDS = [f"w{i}" for i in range(300)]


def brute_print(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lowered) if w]
    if not words:
        return 0
    runs = [words] if len(words) < SHINGLE else [words[i : i + SHINGLE] for i in range(len(words) - SHINGLE + 1)]
    hashes = [xxhash.xxh64_intdigest(" ".join(r).encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= RADIUS:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, f"{p:016x}", least.get(find(i))) for i, ((d, _), p) in enumerate(zip(rows, prints)))


def corpus(n=120, seed=3):
    pick = random.Random(seed)
    rows = []
    for i in range(n):
        if rows and i % 3 == 0:
            words = rows[pick.randrange(len(rows))][1].split()
            for _ in range(pick.randrange(3)):
                words[pick.randrange(len(words))] = pick.choice(WORDS)
            text = " ".join(words)
        else:
            text = " ".join(pick.choices(WORDS, k=pick.choice([1, 2, 3, 40, 400])))
        rows.append((i, text))
    return rows


EDGES = [(500, None), (501, ""), (502, " \n\t"), (503, "One"), (503, "one"), (504, "É É É é"), (None, "lost text of nobody"), (None, "lost text of nobody"), (505, "a " * 30000), (506, "a " * 30000)]


def test_matches_all_pairs(spark):
    rows = corpus() + EDGES
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, component_id int, fp string")
    got = Counter(map(tuple, near_duplicates(docs).collect()))
    assert got == brute(rows)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@given(st.sets(st.integers(0, 63), max_size=RADIUS), st.integers(0, 2**64 - 1))
@settings(max_examples=300, deadline=None)
def test_every_pair_within_the_radius_collides_in_some_table(bits, a):
    b = a
    for i in bits:
        b ^= 1 << i
    assert any(a & m == b & m for m in MASKS)


def shingles(text, width=5):
    words = text.lower().split()
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def near_corpus(n=160, seed=5):
    """Copies with up to four words of 40 to 900 changed: similarities on both sides of 0.8."""
    pick = random.Random(seed)
    rows = []
    for i in range(n):
        if rows and i % 2:
            words = rows[pick.randrange(len(rows))][1].split()
            for _ in range(pick.randrange(5)):
                words[pick.randrange(len(words))] = pick.choice(WORDS)
        else:
            words = pick.choices(WORDS, k=pick.choice([40, 120, 900]))
        rows.append((i, " ".join(words)))
    return rows


def groups(keys, linked):
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in keys:
        for j in keys:
            if i < j and linked(i, j):
                root[find(j)] = find(i)
    return {k: find(k) for k in keys}


@given(st.sets(st.integers(0, COORDINATES - 1), max_size=RADIUS))
@settings(max_examples=100, deadline=None)
def test_every_sketch_that_differs_in_three_coordinates_collides_in_some_table(differ):
    assert any(not differ & set(kept) for kept in SKETCH_MASKS) and min(map(len, SKETCH_MASKS)) == 4


def test_the_stage_links_what_all_pairs_of_sketches_link_and_true_similarity_agrees(spark):
    rows = near_corpus()
    texts, made = dict(rows), {i: sketch(t.encode()) for i, t in rows}

    def linked(i, j):
        (a, x), (b, y) = made[i], made[j]
        filled = [(p, q) for p, q in zip(x, y) if p or q]
        return any(all(a[k] == b[k] for k in kept) for kept in SKETCH_MASKS) and sum(p == q for p, q in filled) >= SIMILAR * len(filled)

    root = groups(list(texts), linked)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"] for r in one_of_each(spark, docs, "").collect()}
    least = {}
    for i in texts:
        least[root[i]] = min(i, least.get(root[i], i))
    assert out == set(least.values())
    close = lambda i, j, s: len(a := shingles(texts[i]) & shingles(texts[j])) >= s * len(shingles(texts[i]) | shingles(texts[j])) and bool(a)
    pairs = [(i, j) for i in texts for j in texts if i < j and close(i, j, 0.8)]
    assert len(pairs) > 60 and sum(root[i] == root[j] for i, j in pairs) >= 0.95 * len(pairs)
    apart = groups(list(texts), lambda i, j: close(i, j, 0.7))
    assert all(apart[i] == apart[root[i]] for i in texts)


def test_one_of_each_group_stays(spark):
    edges = [(500, None), (501, ""), (502, " \n\t"), (503, "One"), (503, "one"), (504, "É É É é"), (None, "lost text of nobody"), (None, "lost text of nobody"), (505, "a " * 30000), (506, "a " * 30000)]
    rows = near_corpus(60) + edges
    docs = spark.createDataFrame([(d, t, "en", "mine", 7, f"row {k}") for k, (d, t) in enumerate(rows)], "doc_id long, text string, _node string, _Name string, _none int, fp string")
    kept = one_of_each(spark, docs, "")
    assert kept.columns == docs.columns
    out = kept.collect()
    assert {(r["_node"], r["_Name"], r["_none"]) for r in out} == {("en", "mine", 7)} and len({r["fp"] for r in out}) == len(out)
    assert sorted((r["doc_id"] for r in out if r["doc_id"] is None or r["doc_id"] >= 500), key=str) == [500, 503, 504, 505, None]


def test_hot_buckets_are_dealt_in_blocks(spark, monkeypatch):
    import tidelog.llm.simhash as module

    monkeypatch.setattr(module, "SKETCHES", 8)
    pick = random.Random(9)
    base = pick.choices(WORDS, k=400)
    rows = []
    for i in range(90):
        words = list(base)
        words[pick.randrange(400)] = f"odd{i}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["doc_id"] for r in one_of_each(spark, docs, "").collect()] == [0]


def test_stage_on_an_empty_table(spark):
    assert one_of_each(spark, spark.createDataFrame([], "doc_id long, text string, _node int"), "").count() == 0
    assert similar_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_of_one_id_with_different_texts_both_stay(spark):
    docs = spark.createDataFrame([(1, "one two three four five"), (1, "six seven eight nine ten")], "doc_id long, text string")
    assert one_of_each(spark, docs, "").count() == 2
