"""URL rules: the list, and mined rules against all combinations of tokens."""

from __future__ import annotations

import random
import time
from itertools import chain, combinations

from quirefold.llm import url_rules

URLS = [
    (None, "", "", None), ("no scheme", "", "", None), ("http://A.EXAMPLE.org/es/x?q", "a.example.org", "/es/x", "example.org/es/"), ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1"), ("http://x.org", "x.org", "", None),
    ("http://x.org?a=/", "x.org", "", None), ("https://q.com/fr/", "q.com", "/fr/", "com/fr/"), ("https://q.com/de/#x", "q.com", "/de/", "com/de/"), ("ftp://notorg/", "notorg", "/", None), ("x://É.ORG/p\nq", "É.org", "/p\nq", "org/"),
]


def test_listed_rules(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, (u, *_) in enumerate(URLS)] + [(0, None, "h")], "page_id long, url string, host string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages).collect()}
    verdict = {"example.org/es/": "block", "example.org/en/1": "block", "com/de/": "block"}
    assert got == {(i, h, p, r, verdict.get(r, "allow")) for i, (_, h, p, r) in enumerate(URLS)}
    assert url_rules.judge(pages.limit(0)).collect() == []


def test_mined_rules_block_what_labels_say(spark):
    rows = [(i, f"http://{'spam' if i % 4 == 0 else 'fine'}.net/{'en' if i % 2 else 'fr'}/{i}") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(u, i % 4 == 0) for i, u in rows[:200]] + [(None, True), ("http://spam.net/x", None)], "url string, blocked boolean")
    got = {r.page_id: r.verdict for r in url_rules.judge(pages, labels).collect()}
    assert got == {i: "block" if i % 4 == 0 else "allow" for i in range(400)}
    rules, _ = url_rules.mine(labels)
    found = rules.collect()
    assert [r.antecedent for r in found] == [[".spam"]] and found[0].confidence == 1
    assert {r.verdict for r in url_rules.judge(pages, labels.limit(0)).collect()} == {"allow"}


def test_mined_verdicts_against_all_combinations(spark):
    rng = random.Random(3)
    some = lambda: "http://" + rng.choice("ab") + ".net/" + "/".join(rng.choice("pqrstuv") for _ in range(rng.randrange(1, 5))) + rng.choice(["", "?x=1", "?x=2&y=3"])
    urls = [some() for _ in range(300)]
    known = [(u, ("/p" in u and "/q" in u) or "y=" in u or rng.random() < 0.03) for u in urls[:200]]
    labels = spark.createDataFrame(known, "url string, blocked boolean")
    tokens = {r.url: frozenset(r.t) for r in spark.createDataFrame([(u,) for u in urls], "url string").select("url", url_rules.tokens_of("url").alias("t")).collect()}
    sets = lambda t: map(frozenset, chain.from_iterable(combinations(sorted(t), k) for k in range(1, len(t) + 1)))
    bad, seen = {}, {}
    for u, blocked in known:
        for x in sets(tokens[u]):
            seen[x] = seen.get(x, 0) + 1
            bad[x] = bad.get(x, 0) + blocked
    sure = {x for x, n in seen.items() if bad[x] >= url_rules.LEAST_ROWS and bad[x] >= 0.9 * n}
    pages = spark.createDataFrame([*enumerate(urls)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_rules.judge(pages, labels).collect()}
    assert got == {i: "block" if any(x in sure for x in sets(tokens[u])) else "allow" for i, u in enumerate(urls)}
    assert {"block", "allow"} <= {*got.values()}


def test_tokens_that_are_sure_only_together(spark):
    parts = ["pa", "pb", "pc", "pd", "pe"]
    urls = [("http://site.net/" + "/".join(parts), True)] * 40
    for k in range(5):
        urls += [("http://site.net/" + "/".join(parts[:k] + parts[k + 1 :]), False)] * 40
    labels = spark.createDataFrame(urls, "url string, blocked boolean")
    rules, _ = url_rules.mine(labels)
    found = rules.collect()
    assert [r.antecedent for r in found] == [[f"/{p}" for p in parts]] and found[0].confidence == 1
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_rules.judge(pages, labels).collect()}
    assert got == {i: "block" if b else "allow" for i, (_, b) in enumerate(urls)}


def test_a_url_of_many_folders_takes_no_time(spark):
    folders = "/".join(f"f{chr(97 + i)}" for i in range(26))
    labels = spark.createDataFrame([(f"http://{h}.net/x", False) for h in "abcdef" * 5] + [(f"http://z.net/{folders}", True)] * 8, "url string, blocked boolean")
    pages = spark.createDataFrame([(1, "http://q.net/fc/1"), (2, "http://q.net/1"), (3, f"http://z.net/{folders}")], "page_id long, url string")
    began = time.time()
    assert {r.page_id: r.verdict for r in url_rules.judge(pages, labels).collect()} == {1: "block", 2: "allow", 3: "block"}
    assert time.time() - began < 60
