import random

from pyspark.sql import functions as F

from tidelog.llm.substring_dedup import RUN, drop_repeats, remove_repeats, sentences

WORDS = [f"w{i}" for i in range(500)]


def parts(text):
    raw = (text or "").encode()
    starts, ends, _ = sentences(raw)
    return [raw[a:b].decode() for a, b in zip(starts, ends)]


def brute(rows):
    """Sentences that remain of each row, by the definition: a run's first place is in the smallest id, there the first."""
    def runs(text):
        s = [" ".join(p.lower().split()) for p in parts(text)]
        return [(i, tuple(s[i : i + RUN])) for i in range(len(s) - RUN + 1) if sum(len(x.split()) for x in s[i : i + RUN]) >= 15]

    first = {}
    for d, t in rows:
        for _, r in runs(t):
            if d is not None:
                first[r] = min(d, first.get(r, d))
    out = []
    for d, t in rows:
        gone, seen = set(), set()
        for i, r in runs(t):
            if r in seen or (d is not None and first[r] < d):
                gone |= set(range(i, i + RUN))
            seen.add(r)
        out.append((d, [p for i, p in enumerate(parts(t)) if i not in gone]))
    return out


def corpus(seed=5):
    pick = random.Random(seed)
    sentence = lambda: " ".join(pick.choices(WORDS, k=pick.randrange(5, 15))) + "."
    shared = [[sentence() for _ in range(6)] for _ in range(8)]
    rows = []
    for i in range(60):
        body = [sentence() for _ in range(pick.randrange(8))]
        for _ in range(pick.randrange(3)):
            at = pick.randrange(len(body) + 1)
            body[at:at] = pick.choice(shared)
        rows.append((i, pick.choice([" ", "\n"]).join(body)))
    return rows


def test_matches_the_definition(spark):
    rows = corpus() + [(70, None), (71, ""), (72, "  \n "), (None, corpus()[3][1]), (3, corpus()[4][1]), (73, "X y z. " * 20000)]
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, c string")
    got = sorted(((r["doc_id"], parts(r["text"])) for r in remove_repeats(docs)[0].collect()), key=repr)
    assert got == sorted(brute(rows), key=repr)


def test_spans_are_what_was_removed(spark):
    rows = corpus()
    for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))[0].collect():
        text, out, at = dict(rows)[r["doc_id"]], "", 0
        for s in r["removed"]:
            out, at = out + text[at : s["start"]], s["end"]
        assert out + text[at:] == r["text"]


def test_stage_keeps_first_holders_and_clean_rows(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, len(t)) for d, t in rows] + [(99, None, 0)], "doc_id long, text string, n_chars int")
    out = {r["doc_id"]: r for r in drop_repeats(spark, docs, "").collect()}
    want = dict(brute(rows))
    assert {d for d, p in want.items() if p or not parts(dict(rows)[d])} | {99} == set(out)
    assert all(r["n_chars"] == len(r["text"]) for d, r in out.items() if d != 99)
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string"))[0].count() == 0


def test_stage_carries_clashing_names_and_drops_texts_of_white_space_only(spark):
    body = " ".join(WORDS[:40]) + "."
    rows = [(1, body, 5, "k"), (2, "\n\t" + body, 5, "k"), (3, " \n", 5, "k"), (None, body, 5, "k"), (None, body + "\n" + body, 5, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, cuts string").withColumns({c: F.lit("mine") for c in ("t", "Mine", "its", "n_sentences", "n_removed_spans", "removed", "h")})
    out = drop_repeats(spark, docs, "")
    assert out.columns == docs.columns
    got = out.collect()
    assert sorted(((r["doc_id"], len(r["text"].split())) for r in got), key=str) == [(1, 40), (3, 0), (None, 40), (None, 40)]
    assert all(r["Mine"] == r["its"] == "mine" and r["cuts"] == "k" for r in got)


def windows(text, n=50):
    words = (text or "").lower().split()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def test_repeated_windows_of_50_words_are_found_whatever_the_shape(spark):
    pick = random.Random(9)
    words = lambda n: pick.choices([f"v{i}" for i in range(5000)], k=n)
    rows = []
    for k in range(20):  # short lines, and passages without a full stop behind different words
        menu = "\n".join(" ".join(words(pick.randrange(1, 5))) for _ in range(40))
        flow = " ".join(words(70))
        for copy in range(2):
            i = 4 * k + 2 * copy
            rows.append((i, " ".join(words(12)) + ".\n" + menu + "\n" + " ".join(words(9)) + "."))
            rows.append((i + 1, " ".join(words(pick.randrange(1, 40))) + " " + flow + " " + " ".join(words(pick.randrange(1, 40))) + "."))
    rows.append((500, "Enststung ench.\n" * 60))
    assert {d for d, t in rows if any(windows(t) & windows(u) for e, u in rows if e < d)} == {d for d, _ in rows if d % 4 > 1}
    out = {r["doc_id"]: r["text"] for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))[0].collect()}
    seen = set()
    for d, _ in sorted(rows):
        assert not windows(out[d]) & seen, d
        seen |= windows(out[d])
    assert all(out[d] == t for d, t in rows if d % 4 < 2 and d != 500)
    assert len(out[500].split()) < 50


def test_a_piece_of_a_long_sentence_is_short():
    for text in ("a " * 300, " ".join(WORDS), "x y " * 40):
        assert max(sentences(text.encode())[2]) <= 8 and sum(sentences(text.encode())[2]) == len(text.split())
