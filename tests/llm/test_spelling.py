"""Spelling variants against all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from quirefold.llm import spelling

SCHEMA = "doc_id long, text string, word string, n string, tile int, key string, hot int"


def near(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k:] == b[k + 1 :] if len(a) < len(b) else a[k + 1 :] == b[k + 1 :]


def brute(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += len(w) >= 7
    n = {w: k for w, k in counts.items() if k >= 2}
    close = {w: [v for v in n if near(w, v)] for w in n}
    form = {w: min(close[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: f if f is not None and n[f] >= 10 * n[w] else None for w, f in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), n[w], len(close[w]), n[form[w]] if form[w] else None) for w in n}


def rows_of(seed: int):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcdeoé×") for _ in range(rng.randrange(7, 11))) for _ in range(25)]

    def noisy(w):
        k = rng.randrange(len(w))
        return rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abxÉ") + w[k:], w[:k] + rng.choice("abx") + w[k + 1 :], w.upper()])

    rows = [(i, " ".join(rng.choice(stems) if rng.random() < 0.9 else noisy(rng.choice(stems)) for _ in range(rng.randrange(5, 400)))) for i in range(30)]
    step = ["abcdefg " * 4000, "abcdefgh " * 300, "abcdefgxh " * 20, "abcdefgxyh " * 2]  # forms in a chain
    return [*rows, *enumerate(step), (None, None), (None, stems[0] + "." + stems[0]), (3, ""), (3, rows[3][1]), (7, "z" * 5000 + " " + "z" * 5000 + " " + "z" * 4999 + "y " + "z" * 4999 + "y")]


def forms(spark, rows, **more):
    listed = spelling.words(spark.createDataFrame([(i, t, "clash", "n", 1, "k", 2) for i, t in rows], SCHEMA).repartition(4))
    got = spelling.forms(listed, **more).collect()
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got}
    assert len(found) == len(got)
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    want = brute(rows_of(seed))
    assert any(v[1] != v[0] for v in want.values() if v[0])  # a chain of forms
    assert forms(spark, rows_of(seed)) == want


def test_large_tiles_are_compared_in_parts(spark):
    rng = random.Random(4)
    rows = [(1, " ".join(w for w in {"aeiou" + "".join(rng.choice("abcd") for _ in range(4)) for _ in range(400)} for _ in range(2)))]
    assert forms(spark, rows, tile=16) == brute(rows)


def test_no_words(spark):
    assert forms(spark, []) == {} and forms(spark, [(1, None), (2, "short words 12345678")]) == {}
