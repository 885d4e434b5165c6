import random
import re
from collections import Counter

from tidelog.llm.url_filter import RULES, filter_urls, op5_url_template_tree

URLS = [
    (1, "http://a.Example.com/en/7/x"), (2, "https://example.com/en/8?q=1"), (3, "http://foo.net/de/8#t"), (4, "http://m.example.net/de/88"),
    (5, "http://b.org/es/"), (6, "http://b.org/es"), (7, None), (8, "no scheme"), (9, "http://com/en/1"), (10, "http://notcom/en/1"),
    (11, "http://x.com"), (12, ""), (13, "a://b://c/d"), (13, "a://b://c/d"), (None, "http://x.com/en/"), (14, "http://x.com/en/\nline?z"), (15, "http://É.com/en/é"),
]


def brute(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.pattern), default=None)
    return host, path, best and best.pattern, best and best.action


def frame(spark, rows):
    return spark.createDataFrame([(i, u, "clash") for i, u in rows], "page_id long, url string, host string")


def test_hosts_paths_and_rules(spark):
    out = filter_urls(frame(spark, URLS), spark.createDataFrame([], "page_id long, good int")).collect()
    got = Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in out)
    want = Counter((i, *b[:3], b[3] or "allow") for i, u in URLS for b in [brute(u)])
    assert got == want


def test_templates_are_rejected_by_labelled_purity(spark):
    rows = [(i, f"http://h.io/{'spam' if i % 2 else 'news'}/{i}") for i in range(400)]
    rows += [(1000 + i, f"http://other.io/{w}") for i, w in enumerate(["a", "b"])]
    labels = [(i, 1 - i % 2) for i in range(0, 200)] + [(1, None), (None, 0)]
    out = {r["page_id"]: r for r in filter_urls(frame(spark, rows), spark.createDataFrame(labels, "page_id long, good int")).collect()}
    assert {out[i]["template"] for i in range(400)} == {"/spam/{n}", "/news/{n}"} and {out[i]["branch"] for i in range(400)} == {"/spam", "/news"}
    assert all(out[i]["verdict"] == ("block" if i % 2 else "allow") for i in range(400))
    assert out[1000]["verdict"] == "allow"


def plain_tree(rows, labels, min_rows=20, min_labelled=5, z=2.58, strength=5.0, floor=0.75, z_block=3.0, depth=8):
    """The operator's definition without Spark: (branch, blocked) of each url."""
    known = {}
    for i, y in labels:
        if i is not None and y is not None:
            known.setdefault(i, []).append(y)
    known = {i: int(sum(y) / len(y) >= 0.5) for i, y in known.items()}
    prior = sum(known.values()) / len(known) if known else 1.0

    def shape(s):
        stem = re.sub(r"\.(html?|php|aspx?|jsp)$", "", s)
        if re.fullmatch(r"\d{4}-\d\d(-\d\d)?", stem, re.A):
            return "{date}"
        if re.fullmatch(r"[0-9]+", stem):
            return "{n}"
        return "{hex}" if re.fullmatch(r"[0-9a-fA-F-]{8,}", stem) and re.search("[0-9]", stem) else s

    pages = []
    for i, u in rows:
        host, path, *_ = brute(u)
        parts = [p for p in path.split("/") if p]
        segs = [shape(p) for p in parts[:depth]] + ([shape("/".join(parts[depth:]))] if len(parts) > depth else [])
        pages.append([i, host, tuple(segs), ()])
    for level in range(max((len(p[2]) for p in pages), default=0)):
        n, m = Counter(), Counter()
        for i, host, segs, t in pages:
            if len(segs) > level:
                n[host, t, segs[level]] += 1
                m[host, t, segs[level]] += i in known
        for p in pages:
            if len(p[2]) > level:
                k = (p[1], p[3], p[2][level])
                p[3] += ("*",) if not p[2][level].startswith("{") and (n[k] < min_rows or m[k] < min_labelled) else (p[2][level],)
    good, labelled = Counter(), Counter()
    for i, host, _, t in pages:
        good[host, t] += known.get(i, 0)
        labelled[host, t] += i in known
    final = set()
    for level in range(max((len(t) for *_, t in pages), default=0), 0, -1):
        nodes = [k for k in {(h, t[:level]) for _, h, _, t in pages if len(t) >= level}]
        for h, parent in {(h, t[:-1]) for h, t in nodes}:
            kids = [k for k in nodes if k[0] == h and k[1][:-1] == parent]
            g, n = sum(good[k] for k in kids), sum(labelled[k] for k in kids)
            merged = []
            for k in kids:
                rest = n - labelled[k]
                p = g / n if n else 0
                apart = bool(labelled[k] and rest) and abs(good[k] / labelled[k] - (g - good[k]) / rest) > z * (p * (1 - p) * (1 / labelled[k] + 1 / rest)) ** 0.5
                final.add(k) if apart else merged.append(k)
            for k in merged:
                good[h, parent] += good[k]
                labelled[h, parent] += labelled[k]
    out = {}
    for i, h, _, t in pages:
        k = next((h, t[:a]) for a in range(len(t), -1, -1) if a == 0 or (h, t[:a]) in final)
        bad = (good[k] + strength * prior) / (labelled[k] + strength) < floor * prior and prior * labelled[k] - good[k] > z_block * (prior * (1 - prior) * labelled[k]) ** 0.5
        out[i] = ("/" + "/".join(k[1]), "block" if bad else "allow")
    return out


def planted(seed=3):
    """Hosts with sections of two levels; some sections, one deep branch and one host are bad."""
    pick = random.Random(seed)
    rows, labels, bad = [], [], set()
    for h in range(6):
        for s in range(7):
            for sub in range(3):
                for _ in range(pick.randrange(30, 60)):
                    i = len(rows)
                    tail = pick.choice([str(i), f"{i}.html", f"2020-01-{i % 28:02d}", f"word{i}", "a/b/c/d/e/f/g/h"])
                    rows.append((i, f"https://h{h}.test/sec{s}/sub{sub}x/{tail}"))
                    is_bad = h == 5 or (s == 2 and h % 2 == 0) or (h == 1 and s == 4 and sub == 1)
                    if is_bad:
                        bad.add(i)
                    if pick.random() < 0.5:
                        labels.append((i, int(pick.random() < (0.15 if is_bad else 0.9))))
    return rows, labels, bad


def test_the_tree_matches_a_plain_one_and_rejects_planted_branches(spark):
    rows, labels, bad = planted()
    out = {r["page_id"]: r for r in filter_urls(frame(spark, rows), spark.createDataFrame(labels, "page_id long, good int")).collect()}
    want = plain_tree(rows, labels)
    assert {i: (r["branch"], r["verdict"]) for i, r in out.items()} == want
    blocked = {i for i, r in out.items() if r["verdict"] == "block"}
    assert len(blocked & bad) >= 0.9 * len(bad) and len(blocked - bad) <= 0.02 * (len(rows) - len(bad))
    assert sum(out[i]["branch"] == "/" for i, u in rows if "h3.test" in u) > 0.8 * sum("h3.test" in u for _, u in rows)


def test_children_of_few_rows_become_a_wildcard(spark):
    rows = [(i, f"http://h.io/user/name{chr(97 + i % 26)}{chr(97 + i // 26)}z/post") for i in range(200)]
    out = filter_urls(frame(spark, rows), spark.createDataFrame([(i, 1) for i in range(200)], "page_id long, good int"))
    assert {r["template"] for r in out.select("template").distinct().collect()} == {"/user/*/post"}


def test_a_section_with_labels_is_judged_by_itself_among_many(spark):
    names = [f"{a}y{b}z" for a in "ghijklmn" for b in "opqrstuvw"]
    rows, labels = [], []
    for host, odd in (("good.io", 0), ("bad.io", 1)):
        for k, name in enumerate(names):
            for _ in range(30):
                rows.append((len(rows), f"http://{host}/{name}/{len(rows)}"))
                labels.append((len(rows) - 1, odd if k == 7 else 1 - odd))
        rows += [(len(rows) + i, f"http://{host}/{name}q/x") for i, name in enumerate(names)]
    out = {r["page_id"]: r for r in filter_urls(frame(spark, rows), spark.createDataFrame(labels, "page_id long, good int")).collect()}
    assert all(out[i]["verdict"] == ("allow" if good else "block") for i, good in labels)
    assert {out[i]["template"] for i, u in rows if u.endswith("q/x")} == {"/*/*"}


def test_empty_table_and_no_python(spark):
    none = frame(spark, URLS).where("false")
    assert filter_urls(none, spark.createDataFrame([], "page_id long, good int")).count() == 0
    plan = op5_url_template_tree(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
