"""Roles of chats: against all sequences one by one, against given roles that the operator doesn't see, and odd rows."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from itertools import product
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirefold.llm import chat
from quirefold.llm.common import cut

SF = "/root/testdata/sf0.01"


def best_sequences(model, places):
    """All role sequences of the best score; places is a list of lists of symbols."""
    table = model.emission()
    score = {}
    for roles in product(range(3), repeat=len(places)):
        x = model.first[roles[0]] + sum(model.after[a, b] for a, b in zip(roles, roles[1:]))
        score[roles] = x + sum(table[s, r] for r, seen in zip(roles, places, strict=True) for s in seen)
    top = max(score.values())
    return {r for r, x in score.items() if x > top - 1e-9}


def fitted(rows):
    seen = rows.select("conv_id", "turn", chat.symbol_of(F.coalesce("text", F.lit(""))).alias("symbol"))
    blocks = cut(chat.blocks_of(seen))
    least = blocks.groupBy("conv_id").agg(F.min("block").alias("b0"))
    return chat.fit(blocks.join(least, "conv_id").withColumn("opens", F.col("block") == F.col("b0"))), seen


def chats(rng, n=40, turns=8):
    rows = []
    for c in range(n):
        begin = rng.random() < 0.3
        for t in range(rng.randrange(1, turns)):
            role = "system" if begin and t == 0 else ("user", "assistant")[(t - begin) % 2]
            text = " ".join("w" for _ in range(rng.randrange(1, 6 if role == "user" else 60))) + "?" * (role == "user")
            mark = {"user": "Human: ", "assistant": "### Assistant:\n", "system": "[system] "}[role] if rng.random() < 0.2 else ""
            rows.append((c, 3 * t - 4, mark + text))
    return rows


@pytest.mark.parametrize("block", [512, 5, 1])
def test_roles_are_the_likeliest_of_all_sequences(spark, monkeypatch, block):
    rows = [*chats(random.Random(12)), (5, -4, "a second row of one place"), (5, -4, "tie"), (5, -4, "tie"), (41, 10**12, None), (41, 5, "")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    monkeypatch.setattr(chat, "BLOCK", block)
    model, seen = fitted(table)
    places = defaultdict(lambda: defaultdict(list))
    for r in seen.collect():
        places[r.conv_id][r.turn].append(r.symbol)
    got = chat.recover(table).collect()
    assert Counter((r.conv_id, r.turn) for r in got) == Counter((c, t) for c, t, _ in rows)
    found = {}
    for r in got:
        assert found.setdefault((r.conv_id, r.turn), r.role) == r.role  # one role for a place
    for c, mine in places.items():
        order = sorted(mine)
        assert tuple(chat.ROLES.index(found[c, t]) for t in order) in best_sequences(model, [mine[t] for t in order])


def test_chances_are_those_of_all_sequences():
    rng = np.random.default_rng(3)
    model = chat.model_of(rng.random(3), rng.random((3, 3)), rng.random((chat.SYMBOLS, 3)))
    symbols = [rng.integers(chat.SYMBOLS, size=n) for n in (4, 1, 6)]
    table = model.emission()
    emit = table[np.concatenate(symbols)]
    count = np.array([4, 1, 6])
    begin = np.cumsum(count) - count
    roles, pairs = chat.expected(model, emit, begin, count, np.array([True, True, False]))
    for b, mine, opens in zip(begin, symbols, (True, True, False), strict=True):
        chance, total = np.zeros((len(mine), 3)), 0.0
        for seq in product(range(3), repeat=len(mine)):
            p = np.exp((model.first if opens else model.anywhere)[seq[0]] + sum(model.after[x, y] for x, y in zip(seq, seq[1:])) + sum(table[s, r] for s, r in zip(mine, seq, strict=True)))
            total += p
            chance[np.arange(len(mine)), seq] += p
        assert np.allclose(chance / total, roles[b : b + len(mine)])
    assert np.allclose(pairs[1].sum(axis=0), roles[1]) and not pairs[begin].any()
    out = chat.likeliest(np.broadcast_to(model.first, (3, 3)), model.after, emit, begin, count, np.array([-1, -1, 1]))
    for b, n, last in zip(begin, count, (None, None, 1), strict=True):
        assert [*out[b : b + n]] == [*chat.viterbi(model.first, np.broadcast_to(model.after, (n, 3, 3)), emit[b : b + n], last)]


def test_roles_are_recovered_without_markers(spark):
    rows = [(f"c{c}", t, "no role here", "why?" if t % 2 == 0 else "because " * 30) for c in range(50) for t in range(6)]
    table = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    got = chat.recover(table).collect()
    assert all(r.role == ("user", "assistant")[r.turn % 2] for r in got) and len(got) == 300
    assert all(r.rendered == chat.render(r.role, "why?" if r.turn % 2 == 0 else "because " * 30) for r in got)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data here")
def test_accuracy_against_given_roles(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    given = {(r.conv_id, r.turn): r.role for r in table.collect()}
    got = chat.recover(table.drop("role")).collect()
    hits = [r.role == given[r.conv_id, r.turn] for r in got]
    assert len(hits) == len(given) and sum(hits) >= 0.95 * len(hits)
    assert Counter((r.conv_id, r.turn, r.role, r.rendered) for r in got) == Counter((r.conv_id, r.turn, r.role, r.rendered) for r in chat.recover(table).collect())


def test_markers_and_speakers(spark):
    rows = [(c, t, "x", ("bot", "prompter")[t % 2], "it is so " * 3) for c in range(30) for t in range(4)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, symbol string, who string, text string").withColumn("said", F.lit(1)).withColumn("_r", F.lit(9))
    got = chat.recover(table, speaker="who").collect()
    assert {(r.turn % 2, r.role) for r in got} == {(0, "assistant"), (1, "user")}
    marked = spark.createDataFrame([(c, t, ("GPT: ", "User> ")[t % 2] + "it is so") for c in range(30) for t in range(4)], "conv_id long, turn long, text string")
    got = chat.recover(marked).collect()
    assert {(r.turn % 2, r.role, r.rendered) for r in got} == {(0, "assistant", "<|assistant|>\nit is so\n<|end|>\n"), (1, "user", "<|user|>\nit is so\n<|end|>\n")}


def test_odd_rows(spark):
    rows = [*chats(random.Random(1), 20), (None, 1, "User: x"), (None, 1, "User: x"), (6, None, None), (None, None, "AI: y " + "z" * 50_000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    got = chat.recover(table).collect()
    assert len(got) == len(rows)
    assert sorted(r.role for r in got if r.conv_id is None) == ["assistant", "user", "user"]
    assert [r.rendered for r in got if r.conv_id == 6 and r.turn is None][0].endswith("|>\n\n<|end|>\n")
    assert chat.recover(table.limit(0)).collect() == []
    assert len(chat.recover(table.where("conv_id IS NULL")).collect()) == 3


def test_transcripts(spark):
    rows = [(c, t, "why?" if t % 2 == 0 else "because " * 30) for c in range(50) for t in range(6)]
    model, _ = fitted(spark.createDataFrame(rows, "conv_id long, turn long, text string"))
    text = "User: how?\nand why?\n\nAI: so and so.\nMore of it.\nHuman: ok\n### Response:\nbye"
    assert chat.parse_transcript(text, model) == [("user", "how?\nand why?"), ("assistant", "so and so.\nMore of it."), ("user", "ok"), ("assistant", "bye")]
    got = chat.parse_transcripts(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"), model).collect()
    assert [(r.doc_id, r.turn, r.role) for r in got] == [(1, 0, "user"), (1, 1, "assistant"), (1, 2, "user"), (1, 3, "assistant")]
