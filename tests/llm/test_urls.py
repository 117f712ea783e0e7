import random
from itertools import combinations

from quillspan.llm.urls import BAD, GOOD, RuleIndex, judge, listed_rule, mine, parts, prune, tokens

SCHEMA = "page_id long, url string, verdict string"


def test_parts_and_listed_rules():
    assert parts(None) == parts("no scheme/x") == ("", "")
    assert parts("HTTP://WwW.Ä.Net?x#y") == ("www.Ä.net", "")
    assert parts("a://b://c/d") == ("b:", "//c/d")
    assert parts("x://h/P/q.html#f?z") == ("h", "/P/q.html")
    assert listed_rule("a.example.net", "/en/1") == ("example.net/en/", "allow")
    assert listed_rule("example.net", "/fr/") == ("net/", "block") == listed_rule("net", "/")
    assert listed_rule("fake-net", "/") is None and listed_rule("a.net", "") is None
    assert listed_rule("x.org", "/fr/a") == ("org/fr/", "allow") and listed_rule("notexample.com", "/de/") is None


def labelled(n):
    rnd = random.Random(4)
    rows = []
    for i in range(n):
        host, lang, tail = rnd.choice("abc"), rnd.choice(["en", "de"]), rnd.choice(["", "?ref=1", "#top"])
        bad = int(rnd.random() < (0.9 if (host, lang) == ("a", "de") else 0.1))
        rows.append((i, f"https://{host}.test.io/{lang}/{rnd.randint(1, 999)}{tail}", bad))
    return rows


def test_rules_against_brute_force(spark):
    rows = labelled(400)
    pages = spark.createDataFrame([(i, u, "z") for i, u, _ in rows], SCHEMA)
    labels = spark.createDataFrame([(i, b) for i, _, b in rows] + [(None, 1), (5000, 1), (3, None)], "doc_id long, bad int")
    sets = [({*tokens(u)}, b) for _, u, b in rows]
    n, rate = len(sets), sum(b for _, b in sets) / len(sets)
    want, seen = [], set()
    for s, _ in sets:
        for k in range(1, len(s) + 1):
            for c in combinations(sorted(s), k):
                if c not in seen:
                    seen.add(c)
                    hits = [b for t, b in sets if t.issuperset(c)]
                    if sum(hits) / n >= 0.05 and sum(hits) / len(hits) >= 0.5 and sum(hits) / len(hits) / rate >= 1.2:
                        want.append((frozenset(c), sum(hits) / len(hits)))
    rules = mine(pages, labels, support=0.05)
    assert [(sorted(i), round(c, 9)) for i, c in rules] == [(sorted(i), round(c, 9)) for i, c in prune(sorted(want, key=lambda r: (len(r[0]), sorted(r[0]))))] and rules
    assert not any({BAD, GOOD} & i for i, _ in rules)
    got = {r.page_id: r for r in judge(pages, rules).collect()}
    for i, u, _ in rows:
        fired = [c for items, c in rules if items <= {*tokens(u)}]
        assert got[i].n_fired == len(fired) and got[i].verdict == ("block" if fired else "allow") and got[i].confidence == max(fired, default=None)


def test_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, "v"), (2, "", None), (None, "http://x.net/a", None), (3, "http://x.net/a", None), (3, "http://x.net/a", None), (4, "h://" + "a/" * 50_000, None)], SCHEMA)
    got = sorted(((r.page_id or 0, r.host, r.path[:4], r.rule, r.verdict) for r in judge(pages, []).collect()), key=str)
    assert got == [(0, "x.net", "/a", "net/", "block"), (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "x.net", "/a", "net/", "block"), (3, "x.net", "/a", "net/", "block"), (4, "a", "/a/a", None, "allow")]
    assert mine(pages, spark.createDataFrame([], "doc_id long, bad int")) == []
    assert judge(pages.limit(0), []).collect() == []
    assert RuleIndex([(frozenset({"a", "b"}), 1.0)]).fired(["a"]) == []


def test_whole_urls_are_matched(spark):
    deep = "https://a.org/" + "/".join(f"w{i}" for i in range(40)) + "/evil"
    keys = "https://a.org/x?" + "&".join(f"k{i}=1" for i in range(40)) + "&evil=1"
    long = ["https://a.org/" + "x" * 100 + end for end in "ab"]
    assert "p:evil" in tokens(deep) and "q:evil" in tokens(keys)
    assert tokens(long[0]) != tokens(long[1]) and max(map(len, tokens("https://a.org/" + "x" * 10_000))) < 100
    assert len({*map(str, map(tokens, ("https://a.org/#" + "f" * 50 + e for e in "ab")))}) == 2
    rules = [(frozenset({"p:evil"}), 0.9), (frozenset({"q:evil"}), 0.8)]
    pages = spark.createDataFrame([(1, deep, "z"), (2, keys, "z"), (3, long[0], "z")], SCHEMA)
    assert sorted((r.page_id, r.verdict, r.confidence) for r in judge(pages, rules, ()).collect()) == [(1, "block", 0.9), (2, "block", 0.8), (3, "allow", None)]
    rows = [(i, "https://a.org/" + "/".join(f"w{i}x{k}" for k in range(14)) + ("/evil" if i % 2 else "/good"), i % 2) for i in range(20)]
    pages = spark.createDataFrame([(i, u, "z") for i, u, _ in rows], SCHEMA)
    assert frozenset({"p:evil"}) in dict(mine(pages, spark.createDataFrame([(i, b) for i, _, b in rows], "doc_id long, bad int"), support=0.3))


def test_prune_against_all_subsets():
    rnd = random.Random(9)
    sets = {frozenset(rnd.sample("abcdef", rnd.randint(1, 5))): rnd.choice([0.5, 0.6, 0.7, 0.8]) for _ in range(60)}
    want = {items for items, c in sets.items() if not any(other < items and d >= c for other, d in sets.items())}
    assert {items for items, _ in prune(sorted(sets.items(), key=lambda r: len(r[0])))} == want


def test_too_many_rules_raise_the_support(spark, monkeypatch):
    from quillspan.llm import urls

    rows = [(i, f"https://a.org/{'x' if i % 2 else 'y'}/{'r' if i % 8 == 1 else 's'}", i % 2) for i in range(80)]
    pages, labels = spark.createDataFrame([(i, u, "z") for i, u, _ in rows], SCHEMA), spark.createDataFrame([(i, b) for i, _, b in rows], "doc_id long, bad int")
    assert {frozenset({"p:x"}), frozenset({"p:r"})} <= {items for items, _ in mine(pages, labels, support=0.1)}
    monkeypatch.setattr(urls, "MAX_RULES", 1)
    assert {items for items, _ in mine(pages, labels, support=0.1)} == {frozenset({"p:x"})}
