"""Grammars as data, and whole documents from ranges to problems."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quirefold.functions.patterns import RegexPatterns
from quirefold.operators import evaluation as ev
from quirefold.operators import extraction as ex
from quirefold.operators import grammars as gr
from quirefold.operators import process as pr
from quirefold.sources.schemas import PAGES

DOT = RegexPatterns(r"^(?P<number>\d+)\.\s*(?P<question>.*)$", r"(?P<label>[A-D])\)\s*(?P<text>.*?)(?=\s+[A-D]\)|$)", r"^Key (?P<answer>\w+)", ("noise",), ("--",), True)
HASH = RegexPatterns(r"^#(?P<x>\w)?(?P<number>\d+) (?P<question>.*)$", r"^(?P<text>.*) \((?P<label>[A-D])\)$", None, (), (), False)
SHOWN = ("doc_id", "problem_seq", "number", "question", "answer", "options", "analysis", "header_page", "completed_page")


def dotted(n, first=1):
    return [x for i in range(first, first + n) for x in (f"{i}. What is asked in item {i}?", "A) yes B) no", "going on", f"Key {'AB'[i % 2]}", "noise", "-- x", "12")]


def hashed(n):
    return [x for i in range(1, n + 1) for x in (f"#q{i} What is asked in item {i}?", "yes (A)", "no (B)", "not an option", "12")]


def frame(spark, books, per_page=5):
    rows = [(d, p // per_page, [([], "text", x) for x in lines[p : p + per_page]]) for d, lines in books.items() for p in range(0, max(len(lines), 1), per_page)]
    return spark.createDataFrame(rows, PAGES)


def found(problems):
    return sorted(tuple(map(str, r)) for r in problems.select(*SHOWN).collect())


def raw(spark, texts):
    return spark.createDataFrame([*texts.items()], "doc_id string, raw_json string")


def test_documents_are_read_by_their_own_patterns(spark):
    books = {f"d{i}": dotted(4) if i % 2 else hashed(4) for i in range(6)} | {"none": dotted(2), "bad": dotted(2), "empty": []}
    pages = frame(spark, books)
    grammars = gr.parsed(raw(spark, {d: (DOT if int(d[1]) % 2 else HASH).to_json() for d in books if d[1:].isdigit()} | {"bad": '{"question": "("}', "empty": DOT.to_json(), "gone": HASH.to_json()}))
    got = found(gr.extract(pages, grammars.where("error IS NULL")))
    want = [x for i in range(6) for x in found(ex.extract(pages.where(F.col("doc_id") == f"d{i}"), ex.general_grammar(DOT if i % 2 else HASH)))]
    assert got == sorted(want) and len(got) == 24
    errors = {r.doc_id: r.error for r in grammars.collect()}
    assert errors["d0"] is None and "lacks" in errors["bad"] or "compile" in errors["bad"]


def test_a_document_with_several_configurations_takes_a_usable_one(spark):
    rows = spark.createDataFrame([("d", "{}"), ("d", DOT.to_json()), ("d", None), ("e", None), ("e", "[]"), (None, DOT.to_json())], "doc_id string, raw_json string")
    got = {r.doc_id: r for r in gr.parsed(rows).collect()}
    assert got["d"].error is None and got["d"].g.question.number == 1 and got[None].error is None
    assert got["e"].g is None and got["e"].error


def test_an_analyzer_is_asked_again_and_fails_alone(spark):
    good, tries = DOT.to_json(), 3

    def analyzer(sample, error):
        if "item 9" in sample:
            raise RuntimeError("the service is down")
        if "Key" not in sample:
            return "no JSON"
        return good if error else "{}"  # usable at the second attempt

    pages = frame(spark, {"ok": dotted(3), "raises": dotted(3, 8), "never": hashed(3), "blank": ["  "] * 6, "short": dotted(1)})
    ranges = spark.createDataFrame([("ok", 0, 2), ("raises", 0, 3), ("never", 0, 2), ("blank", 0, 1), ("short", 0, 9), ("unknown", 0, 1), ("ok2", 2, 2)], "doc_id string, start int, stop int")
    got = {r.doc_id: r for r in gr.infer(pages, ranges, analyzer, tries).collect()}
    assert got["ok"].g is not None and got["ok"].error is None
    assert got["raises"].error == "RuntimeError: the service is down" and "JSON" in got["never"].error
    assert got["blank"].error == "the sample is blank" and got["short"].error == "samples exceed the page count" and got["unknown"].error == "samples exceed the page count"
    assert "not empty" in got["ok2"].error and len(got) == 7
    assert found(gr.extract(pages, gr.infer(pages, ranges, analyzer).where("g IS NOT NULL"))) == found(ex.extract(pages.where("doc_id = 'ok'"), ex.general_grammar(DOT)))


FIXED = {"book_b": lambda p: ex.extract(p, ex.book_b_grammar()), "dots": lambda p: ex.extract(p, ex.general_grammar(DOT))}


def process(spark, books, ranges, patterns=None, fixed=FIXED, **policy):
    rows = spark.createDataFrame([(d, i, n, a, b, 1) for d, named in ranges.items() for i, (n, a, b) in enumerate(named)], "doc_id string, ordinal int, name string, start int, stop int, step int")
    done = pr.process(frame(spark, books), rows, fixed, patterns, pr.Policy(**policy))
    return {r.doc_id: r for r in done.decisions.collect()}, done.pages


def test_each_document_goes_its_own_way(spark):
    books = {"dots": dotted(8), "hash": hashed(8), "junk": ["nothing here"] * 30, "lost": hashed(8), "no range": dotted(3), "beyond": dotted(3)}
    ranges = {d: [("questions", 1, 5)] for d in ("dots", "hash", "junk", "lost")} | {"no range": [("contents", 0, 1)], "beyond": [("questions", 0, 99)], "ghost": [("questions", 0, 1)]}
    patterns = raw(spark, {"hash": HASH.to_json(), "junk": DOT.to_json(), "dots": "looked at where no fixed extractor is good enough"})
    got, pages = process(spark, books, ranges, patterns, minimum=0.5)
    assert {d: (r.extractor, r.error) for d, r in got.items()} == {
        "dots": ("dots", None), "hash": ("general", None), "junk": ("book_b", "confidence is low"), "lost": ("book_b", "fallback failed: no patterns"), "no range": (None, "questions is required"), "beyond": (None, "questions is out of bounds"),
        "ghost": (None, "questions is out of bounds"),
    }
    listed = pages.collect()
    assert {(r.doc_id, r.page_index) for r in listed} == {(d, p) for d in ("dots", "hash") for p in range(1, 5)}
    for d, grammar in (("dots", DOT), ("hash", HASH)):
        part = frame(spark, books).where(F.col("doc_id") == d).where("page_index >= 1 AND page_index < 5")
        want = {r.page_index: r.problems for r in ex.page_problems(part, ex.extract(part, ex.general_grammar(grammar))).collect()}
        assert {r.page_index: r.problems for r in listed if r.doc_id == d} == want and any(want.values())


def test_only_the_sample_decides(spark):
    """Three pages of one layout and then another: the extractor that the sample chose goes on over the whole range."""
    books = {"turns": dotted(4)[:25] + hashed(20)}
    got, pages = process(spark, books, {"turns": [("questions", 0, 9)]}, sample_pages=3, fallback=0.4, minimum=0.4)
    assert got["turns"].extractor == "dots"
    sample = frame(spark, books).where("page_index < 3")
    assert got["turns"].score == pytest.approx(ev.evaluate(sample, FIXED["dots"](sample)).first().score)
    assert sorted(got["turns"].metrics) == sorted(ev.METRICS) and pages.count() == 9


def test_without_fallback(spark):
    got, pages = process(spark, {"d": hashed(3)}, {"d": [("questions", 0, 2)]})
    assert got["d"].error == "fallback is not available" and pages.collect() == []


def test_patterns_are_made_of_the_sample(spark):
    seen = lambda sample: sample.groupBy("doc_id").agg(F.max("page_index").alias("m")).select("doc_id", F.when(F.col("m") == 2, HASH.to_json()).alias("raw_json"))
    got, _ = process(spark, {"d": hashed(9)}, {"d": [("questions", 1, 8)]}, seen, sample_pages=2, minimum=0.1)
    assert got["d"].extractor == "general" and got["d"].error is None


def test_bad_settings():
    for bad in ({"sample_pages": 0}, {"minimum": 0.95}, {"fallback": 1.5}):
        with pytest.raises(ValueError):
            pr.Policy(**bad)
    assert json.loads(DOT.to_json())["multiline_options"] is True


def test_each_extraction_runs_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def noted(number):
        seen.add(1)
        return number

    def extractor(pages):
        return ex.extract(pages, ex.general_grammar(DOT)).withColumn("number", F.udf(noted, "string")("number"))

    chosen, _ = pr.choose(frame(spark, {"a": dotted(3), "b": dotted(4)}), {"dot": extractor})
    assert chosen.count() == 2 and seen.value == 7
