"""Test items dealt to several indexes, of several lengths, and the whole query against plain BM25."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from quirefold.llm import decontaminate


def test_scores_do_not_depend_on_the_number_of_indexes(spark, monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["the", "of", "and", f"k{rng.randrange(300)}"]) for _ in range(rng.randrange(12, 90))) + f". The answer is k{i}." for i in range(40)]
    items = spark.createDataFrame([*enumerate(texts), (900, None), (901, "")], "item_id long, text string")
    filler = lambda: " ".join(f"k{rng.randrange(300)}" for _ in range(rng.randrange(150)))
    docs = spark.createDataFrame([(i, f"{filler()} {texts[i % 40]} {filler()}") for i in range(80)], "doc_id long, text string")
    found = lambda: sorted((r.doc_id, r.item_id, round(r.score, 9), r.question_overlap, r.answer_overlap) for r in decontaminate.contaminated(docs, items).collect())
    partly = spark.createDataFrame([(i, " ".join(w for w in texts[i % 40].split() if rng.random() < 0.9)) for i in range(80)], "doc_id long, text string")
    docs = docs.union(partly.withColumn("doc_id", partly["doc_id"] + 100))
    want = found()
    monkeypatch.setattr(decontaminate, "INDEX_ITEMS", 7)
    assert len(decontaminate.indexes(items)) == 6
    assert len(want) >= 80 and found() == want


def plain_hits(docs, items, score=0.6, overlap=0.8):
    """Every passage of every document against every item, word by word."""
    split = lambda t: re.findall(r"\w+", (t or "").lower())
    bench = [(i, t, split(t)) for i, t in items if split(t)]
    df = Counter(w for _, _, words in bench for w in set(words))
    mean = sum(len(w) for *_, w in bench) / max(1, len(bench))

    def weight(w, n, size):
        return math.log(1 + (len(bench) - df[w] + 0.5) / (df[w] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * size / mean))

    out = {}
    for d, text in docs:
        words = split(text)
        for i, t, own in bench:
            stride = 64
            while stride < len(own):
                stride *= 2
            whole = sum(weight(w, n, len(own)) for w, n in Counter(own).items())
            question, answer = decontaminate.question_answer(t)
            k = min(5, len(question))
            grams = {tuple(question[a : a + k]) for a in range(len(question) - k + 1)}
            for at in range(0, len(words), stride):
                part = words[at : at + 2 * stride]
                share = sum(weight(w, n, len(own)) for w, n in Counter(own).items() if w in part) / whole
                q = len(grams & {tuple(part[a : a + k]) for a in range(len(part) - k + 1)}) / len(grams)
                a = len(set(answer) & set(part)) / len(set(answer))
                if share >= score and q >= overlap and a >= overlap:
                    out[d, i] = max(share, out.get((d, i), 0))
    return out


@pytest.mark.parametrize("limit", [5, 20_000])
def test_hits_are_those_of_plain_bm25(spark, monkeypatch, limit):
    rng = random.Random(limit)
    some = lambda n: " ".join(rng.choice(["the", "of", "and", *(f"k{rng.randrange(400)}" for _ in range(4))]) for _ in range(n))
    items = [(i, f"{some(rng.choice([8, 30, 70, 150, 400]))}. The answer is k{i} {some(2)}.") for i in range(24)] + [(90, None), (91, " "), (92, "one"), (3, "a repeated id of other words. It is so.")]
    docs = []
    for i in range(60):
        text = rng.choice(items[:24])[1].split()
        worn = [w for w in text if rng.random() < rng.choice([1, 0.97, 0.9])]
        docs.append((i, f"{some(rng.randrange(300))} {' '.join(worn)} {some(rng.randrange(900))}"))
    docs += [(100, None), (101, ""), (102, "one"), (103, "One!")]
    monkeypatch.setattr(decontaminate, "INDEX_ITEMS", limit)
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = plain_hits(docs, items)
    assert len(got) == len(want) > 20
    assert {(r.doc_id, r.item_id): pytest.approx(r.score) for r in got} == want


def test_a_long_item_changes_no_verdict_on_others(spark):
    rng = random.Random(8)
    words = lambda n, k: " ".join(f"{k}{rng.randrange(5000)}" for _ in range(n))
    question, answer = words(20, "q"), words(4, "a")
    short, long = (1, f"{question}. {answer}."), (2, f"{words(6000, 'l')}. {words(5, 'l')}.")
    docs = spark.createDataFrame([(1, f"{question} {words(4500, 'f')} {answer}"), (2, f"{words(900, 'f')} {question}. {answer}"), (3, f"x {long[1]} y")], "doc_id long, text string")
    found = lambda *items: sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, spark.createDataFrame([*items], "item_id long, text string")).collect())
    assert found(short) == [(2, 1)] and found(short, long) == [(2, 1), (3, 2)]
