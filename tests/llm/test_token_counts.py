from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.llm.token_counts import Vocabulary, allocate, count_tokens, line_sections


def brute(ends, spans, rule):
    """Each token byte by byte."""
    counts = [0.0] * (len(spans) + 1)
    start = 0
    for end in ends:
        owner = [next((s for s, (a, b) in enumerate(spans) if a <= x < b), len(spans)) for x in range(start, end)]
        share = Counter(owner)
        if rule == "start":
            counts[owner[0]] += 1
        elif rule == "share":
            for s, n in share.items():
                counts[s] += n / (end - start)
        else:
            most = max(share.values())
            counts[min(s for s, n in share.items() if n == most)] += 1
        start = end
    return counts


@given(st.lists(st.integers(1, 6), max_size=15), st.lists(st.tuples(st.integers(0, 4), st.integers(0, 9)), max_size=6), st.sampled_from(["start", "largest", "share"]))
@settings(max_examples=400, deadline=None)
def test_allocation_matches_byte_by_byte(sizes, gaps, rule):
    ends = np.cumsum(np.array(sizes, np.int64)) if sizes else np.zeros(0, np.int64)
    spans, at = [], 0
    for gap, size in gaps:
        spans.append((at + gap, at + gap + size))
        at += gap + size
    spans = [s for s in spans if s[1] > s[0]]
    low, high = np.array([s[0] for s in spans], np.int64), np.array([s[1] for s in spans], np.int64)
    assert allocate(ends, low, high, rule) == pytest.approx(brute(ends.tolist(), spans, rule))


TEXTS = [(1, "One line\nand another, longer line\n"), (2, None), (3, ""), (4, "é à ü\nΩmega 🙂🙂\n\n"), (None, "no id"), (5, "same"), (5, "same"), (6, "long words " * 40_000), (7, "\n\n\n")]


@pytest.mark.parametrize("rule", ["start", "largest", "share"])
def test_counts_add_up_to_the_whole_encoding(spark, rule):
    docs = spark.createDataFrame([(i, t, 0) for i, t in TEXTS], "doc_id long, text string, section int")
    out = count_tokens(docs, rule=rule).collect()
    words, got, want = Vocabulary(), Counter(), Counter()
    for r in out:
        got[r["doc_id"]] += r["n_tokens"]
    for i, t in TEXTS:
        want[i] += len(words.encoding.encode_ordinary(t or ""))
    assert {k: pytest.approx(v) for k, v in got.items()} == {k: want[k] for k in got} and set(got) == set(want)
    lines = {r["section"]: (r["start"], r["end"]) for r in out if r["doc_id"] == 1}
    assert lines == dict(enumerate(line_sections(TEXTS[0][1])))


def test_sections_of_ones_own_and_the_rest(spark):
    docs = spark.createDataFrame([(1, "title body words and a tail")], "doc_id long, text string")
    out = {r["section"]: r["n_tokens"] for r in count_tokens(docs, sections=lambda t: [(0, 5), (5, 16)], rule="start").collect()}
    assert set(out) == {0, 1, None} and sum(out.values()) == len(Vocabulary().encoding.encode_ordinary("title body words and a tail"))
    with pytest.raises(ValueError):
        count_tokens(docs, rule="other")


def test_empty_table_and_round_trip(spark):
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    words = Vocabulary()
    for _, t in TEXTS:
        ids = words.encoding.encode_ordinary(t or "")
        assert words.encoding.decode(ids) == (t or "") and words.ends(t or "")[-1:].tolist() == ([len((t or "").encode())] if ids else [])
