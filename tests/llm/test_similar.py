"""Near copies by five-word shingles against brute force."""

from __future__ import annotations

import random

import brute
import numpy as np
import pytest

import corpus_pipeline
from quirefold.llm import similar


def shingles(text):
    w = brute.words((text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def kept_ids(docs):
    """The least id of each component."""
    sets, left, out = {i: shingles(t) for i, t in docs}, {i for i, _ in docs}, []
    while left:
        todo = [min(left)]
        out += todo
        left -= set(todo)
        while todo:
            x = todo.pop()
            found = {y for y in left if near(sets[x], sets[y])}
            left -= found
            todo += found
    return sorted(out)


def edited(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def corpus():
    rng = random.Random(3)
    new = lambda n: " ".join(f"W{rng.randrange(10**5)}" for _ in range(n))
    texts = [None, "", " \n", "one two", "One  two", "one two three", "a b c d e", "a b c d e f"]
    passage = new(60)
    for n in (9, 10, 11, 40, 100, 300):
        for _ in range(6):
            base = new(n)
            texts += [base, base.lower(), base + " tail", edited(rng, base, max(1, n // 60)), edited(rng, base, max(1, n // 35)), base + " " + passage, passage + " " + base]
    group = new(120)
    texts += [edited(rng, group, rng.randrange(1, 4)) for _ in range(80)]
    chain = new(200)
    for _ in range(12):
        texts.append(chain)
        chain = edited(rng, chain, 3)
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("common", [0, 8000])
def test_stage_against_brute_force(spark, monkeypatch, common):
    monkeypatch.setattr(similar, "LISTED", max(1, common))
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == kept_ids(rows)
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").collect() == []


def test_rows_without_own_keys(spark):
    rng = random.Random(4)
    base = " ".join(f"w{rng.randrange(10**5)}" for _ in range(60))
    rows = [(1, base), (1, base), (1, "other words are here"), (2, base + " x"), (None, base + " y"), (None, "alone")]
    got = similar.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(0, "alone"), (1, base), (1, "other words are here")])


@pytest.mark.parametrize("tile", [4, 40])
def test_hot_items_are_cut_into_parts(spark, tile):
    rng = random.Random(6)
    base = " ".join(f"w{rng.randrange(10**5)}" for _ in range(150))
    texts = [edited(rng, base, rng.randrange(1, 12)) + " x" * rng.randrange(30) for _ in range(150)] + [f"unlike {i} in every word {i}" for i in range(5)]
    rows = list(enumerate(texts))
    got = similar.keep_first(spark.createDataFrame(rows, "doc_id long, text string"), tile=tile)
    assert sorted(r.doc_id for r in got.collect()) == kept_ids(rows)


def test_nearest_pairs_connect_what_all_pairs_do():
    rng = np.random.default_rng(5)
    x = {"class": rng.integers(0, 40, 200)}
    p, q = rng.integers(0, 200, 300), rng.integers(0, 200, 300)
    apart = x["class"][p] != x["class"][q]
    p, q = p[apart], q[apart]
    a, b = similar._nearest(x, p, q, rng.random(len(p)))

    def groups(p, q):
        of = {c: c for c in range(40)}
        for i, j in zip(x["class"][p], x["class"][q], strict=True):
            old, new = of[i], of[j]
            of = {c: new if r == old else r for c, r in of.items()}
        return {frozenset(c for c in of if of[c] == r) for r in of.values()}

    assert groups(a, b) == groups(p, q)
    assert len(a) == 40 - len(groups(p, q))


def test_large_sets_that_are_alike_but_not_similar_are_told_apart_where_they_meet(spark, monkeypatch):
    rng = random.Random(8)
    base = " ".join(f"w{rng.randrange(10**5)}" for _ in range(1500))
    rows = list(enumerate(edited(rng, base, 45) for _ in range(30)))
    compared, verified = [], similar._verified
    monkeypatch.setattr(similar, "_verified", lambda pairs, *rest: compared.append(pairs.count()) or verified(pairs, *rest))
    got = similar.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == kept_ids(rows) == [i for i, _ in rows]
    assert sum(compared) <= 30  # of 435 pairs


def test_similar_sets_share_an_item_of_a_part():
    rng = np.random.default_rng(9)
    for n in [4, 9, 100, *(x for step in (512, 1024, 4096) for x in (step - 40, step, step + 1, step * 5 // 4, step * 5 // 4 + 1))]:
        for less in (0, n // 18, n // 5):  # the smaller set lacks so many, and as many are others as leave 0.8
            both = rng.integers(-(2**63), 2**63 - 1, n - less)
            extra = max(0, len(both) * 5 // 4 - len(both) - less)
            a = np.sort(np.concatenate([both, rng.integers(-(2**63), 2**63 - 1, less)]))
            b = np.sort(np.concatenate([both, rng.integers(-(2**63), 2**63 - 1, extra)]))
            assert similar.similar(a, b)
            one, two = ({x[0]: x for x in similar._parts(v)} for v in (a, b))
            fits = []
            for k in one.keys() & two.keys():
                x, y = one[k], two[k]
                pos = {int(i): p for p, i in enumerate(y[4])}
                found = next(((p, pos[int(i)]) for p, i in enumerate(x[4]) if int(i) in pos), None)
                differ = np.bitwise_count(np.frombuffer(x[2], np.uint8) ^ np.frombuffer(y[2], np.uint8)).sum(dtype=int)
                fits.append(found is not None and min(x[1] - found[0], y[1] - found[1]) * 9 >= (x[1] + y[1]) * 4 and differ * 9 <= x[1] + y[1])
            assert any(fits), (n, less)
