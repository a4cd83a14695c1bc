"""Streams of pages with documents that end, fall silent or are cancelled."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from quirefold.functions.patterns import RegexPatterns
from quirefold.operators import extraction as ex
from quirefold.streaming import timed
from quirefold.streaming.events import run_once
from quirefold.streaming.problems import block_problems

GRAMMAR = ex.general_grammar(RegexPatterns(r"^(?P<number>\d+)\. (?P<question>.*)$", r"^(?P<label>[A-D])\) (?P<text>.*)$", r"^Key (?P<answer>\w)", ("noise",), (), True))
EVENTS = "doc_id string, page_index int, elements array<struct<bbox: array<struct<x: double, y: double>>, label: string, content: string>>, at timestamp, cancel boolean"
NOON = datetime(2024, 1, 1, 12)


def page(doc, index, minute, *lines):
    return doc, index, None if lines == (None,) else [([], "text", x) for x in lines], NOON + timedelta(minutes=minute), False


def cancel(doc, minute):
    return doc, None, None, NOON + timedelta(minutes=minute), True


@pytest.fixture()
def blocks(spark, tmp_path):
    timed.with_store(spark)
    yield lambda *batches: run(spark, tmp_path, batches)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(spark, tmp_path, batches):
    """Each batch is a file, and the stream is stopped and started again between them."""
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, EVENTS).coalesce(1).write.parquet(str(tmp_path / "in" / f"b={n}"))
        stream = spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        run_once(timed.timed_blocks(stream, GRAMMAR, "60 minutes", "0 minutes"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    return spark.read.schema(timed.TIMED_BLOCK).parquet(str(tmp_path / "out"))


def test_ended_silent_and_cancelled_documents(spark, blocks):
    out = blocks(
        [page("ends", 0, 0, "1. a", "A) x", "noise"), page("silent", 0, 0, "1. s", "A) y"), page("gone", 0, 1, "1. g", "2. h"), page("other", 0, 2, "no header")],
        [page("ends", 1, 5, "B) z", "2. b", "Key A"), cancel("gone", 6), page("gone", 1, 7, "3. not read any more"), cancel("never heard of", 6)],
        [page("ends", 2, 10, None), page("gone", 2, 10, "4. nor this"), page("silent", 1, 20, "going on")],
        [page("late", 0, 200, "1. l")],
        [page("silent", 0, 201, "1. anew"), page("gone", 0, 202, "1. again")],
    )
    got = sorted((r.doc_id, r.problem_seq, r.outcome, r.completed_page, [x.line for x in r.lines]) for r in out.collect())
    assert got == [
        ("ends", 1, "next", 1, ["1. a", "A) x", "B) z"]), ("ends", 2, "ended", 1, ["2. b", "Key A"]),
        ("gone", 1, "next", 0, ["1. g"]), ("gone", 2, "cancelled", 0, []), ("never heard of", 0, "cancelled", -1, []),
        ("silent", 1, "silent", 1, ["1. s", "A) y", "going on"]),
    ]
    found = block_problems(out.where("outcome <> 'cancelled'").drop("outcome"), GRAMMAR).collect()
    assert sorted((r.doc_id, r.number, r.question) for r in found) == [("ends", "1", "a"), ("ends", "2", "b"), ("gone", "1", "g"), ("silent", "1", "s")]


def test_controls_join_the_pages(spark):
    pages = spark.createDataFrame([page("a", 0, 0, "1. q")], EVENTS).drop("cancel")
    controls = spark.createDataFrame([("a", NOON)], "doc_id string, at timestamp")
    got = sorted((r.cancel, r.page_index) for r in timed.with_controls(pages, controls).collect())
    assert got == [(False, 0), (True, None)]
