import duckdb

from tidelog.llm.preference_format import END, ORACLE, format_preferences, neighbour_preferences, op9_preference_pairs

ROWS = [
    (0, 0, "user", "hi"), (0, 1, "assistant", "hello there"), (0, 2, "user", "ok"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (1, 3, "user", "late"),
    (2, 0, "user", "same"), (3, 0, "user", "same"), (4, 0, "user", "alone"), (6, 0, None, None), (7, 0, "assistant", ""), (7, 0, "assistant", "a"),
    (None, 0, "user", "x"), (8, None, "user", "x"), (10, 0, "user", "é" * 50_000), (11, 0, "user", "é" * 50_000), (11, 1, "assistant", "z"),
    (2**60, 0, "user", "big"), (2**60 + 1, 0, "user", "big"), (2**60 + 1, 1, "assistant", "yes"), (2**60 + 2, 0, "user", "big"), (2**60 + 3, 0, "user", "other"),
    (-4, 0, "user", "minus"), (-3, 0, "user", "minus"), (-1, 0, "user", "odd alone"), (13, 4, "user", "odd alone"), (6, 0, None, None), (-3, -7, "assistant", "early"),
]
SCHEMA = "conv_id long, turn long, role string, text string, prompt string"


def plain(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None and t is not None:
            value = (r if r is not None else "unknown", x if x is not None else "")
            convs.setdefault(c, {})[t] = min(value, convs.get(c, {}).get(t, value))
    out = {}
    for k in {c // 2 for c in convs}:
        if 2 * k in convs or 2 * k + 1 in convs:
            size = lambda c: sum(len(x) for r, x in convs[c].values() if r == "assistant")
            a, b, *_ = [*sorted({2 * k, 2 * k + 1} & set(convs), key=lambda c: (-size(c), c)), None]
            convs[None] = {}
            cut = min((t for t in {*convs[a], *convs[b]} if convs[a].get(t) != convs[b].get(t)), default=None)
            common = [t for t in sorted(convs[a]) if cut is None or t < cut]

            def render(c, turns):
                text, spans = "", []
                for t in turns:
                    r, x = convs[c][t]
                    head = f"<|{r}|>\n"
                    if r == "assistant":
                        spans.append(f"{len(text) + len(head)}-{len(text) + len(head) + len(x) + len(END)}")
                    text += head + x + END
                return text, ",".join(spans)

            rest = [render(c, [t for t in sorted(convs[c]) if t not in common]) for c in (a, b)]
            out[k] = (a, b, len(common), render(a, common)[0], *rest[0], *rest[1])
    return out


def test_matches_a_plain_rendering(spark):
    c = spark.createDataFrame([(*r, "clash") for r in ROWS], SCHEMA)
    got = {r["pair_id"]: tuple(r)[1:] for r in neighbour_preferences(c).collect()}
    assert got == plain(ROWS)


def test_loss_spans_cover_the_assistant_text(spark):
    c = spark.createDataFrame([(*r, "clash") for r in ROWS], SCHEMA)
    r = neighbour_preferences(c).where("pair_id = 0").first()
    a, b = map(int, r["chosen_loss"].split("-"))
    assert r["chosen"][a:b] == "hello there" + END and r["prompt"] == "<|user|>\nhi" + END


def test_matches_sql_on_the_table(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    want = con.execute(ORACLE).fetchall()
    got = [tuple(r) for r in op9_preference_pairs(spark, "/root/testdata/sf0.001").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and got


def test_pairs_given_as_a_table_share_a_prefix(spark):
    convs = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "more"), (1, 3, "assistant", "good"), (2, 0, "user", "q"), (2, 1, "assistant", "a"), (2, 2, "user", "more"), (2, 3, "assistant", "bad")]
    pairs = spark.createDataFrame([(10, 1, 2), (11, 2, 1), (12, 1, 1), (13, 1, 99), (14, 98, 99)], "pair_id long, chosen_id long, rejected_id long")
    got = {r["pair_id"]: r for r in format_preferences(spark.createDataFrame([(*r, "x") for r in convs], SCHEMA), pairs).collect()}
    assert got[10]["prompt_turns"] == got[11]["prompt_turns"] == 3 and got[10]["prompt"] == got[11]["prompt"]
    assert got[10]["chosen"] == got[11]["rejected"] == "<|assistant|>\ngood" + END and got[10]["chosen_loss"] == f"14-{18 + len(END)}"
    assert got[12]["prompt_turns"] == 4 and got[12]["chosen"] == got[12]["rejected"] == ""
    assert got[13]["prompt_turns"] == 0 and got[13]["rejected"] == "" and got[13]["chosen"].count(END) == 4
    assert got[14]["chosen"] == got[14]["prompt"] == "" and got[14]["prompt_turns"] == 0


def test_sql_pairs_ids_as_the_plan_does(spark):
    con = duckdb.connect()
    rows = [r[:4] for r in ROWS]
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    got = [tuple(r) for r in neighbour_preferences(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, con.execute(ORACLE).fetchall()))


def test_texts_are_dealt_once(spark):
    plan = op9_preference_pairs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan


def test_empty_table(spark):
    c = spark.createDataFrame([], SCHEMA)
    assert neighbour_preferences(c).count() == 0
