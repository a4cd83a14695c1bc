from __future__ import annotations

from pyspark.sql import functions as F
from test_extraction import GENERAL, line, pages, problems

from quirefold.operators import evaluation as ev
from quirefold.operators import extraction as ex
from quirefold.operators import failures as fl
from quirefold.operators import transforms as tr

MARK = "花生批注 note"


def bare(text):
    return ([], "text", text)


def errors(tried):
    return sorted((r.doc_id, r.page_index, r.stage, r.type, r.message) for r in tried.errors.collect())


def books(spark):
    head = line("1.（2024年北京）", 400, 100)
    good = pages(spark, [head, line("A. one", 400, 130), line("【实战解析】x", 400, 150), line(MARK, 1000, 120)], doc="good")
    no_box = pages(spark, [head], [line("more", 400, 10), bare("beside"), line(MARK, 1000, 120)], doc="no_box")
    no_note = pages(spark, [line("1.（2024年北京）", 400, 100), bare("stem")], doc="no_note")  # without a note nothing but headers needs a box
    no_head = pages(spark, [line("a", 1, 1)], [bare("2.（2024年北京）")], doc="no_head")
    nulls = spark.createDataFrame([("nulls", 0, [([], "text", None), line("1.（2024年北京）")]), ("nulls", 1, [])], good.schema)
    return good.unionByName(no_box).unionByName(no_note).unionByName(no_head).unionByName(nulls)


def test_missing_boxes_fail_their_document_alone(spark):
    every = books(spark)
    tried = fl.attempt(every, ex.extract_book_a, *fl.BOOK_A_STAGES)
    assert errors(tried) == [("no_box", 1, "columns", "ValueError", "element 1 has no box"), ("no_head", 1, "headers", "ValueError", "a header has no box")]
    want = problems(ex.extract_book_a(every.where(F.col("doc_id").isin("good", "no_note", "nulls"))))
    assert problems(tried.problems) == want and len(want) == 3
    reports = {r.doc_id: r for r in fl.evaluate(every, tried).collect()}
    assert reports["no_box"].warnings == ["extractor failed: ValueError: element 1 has no box"]
    assert reports["no_box"].score == 0.0 == max(reports["no_box"][m] for m in ev.METRICS)
    alone = {r.doc_id: r for r in ev.evaluate(every, tried.problems).collect()}
    assert all(reports[d] == alone[d] for d in ("good", "no_note", "nulls")) and len(reports) == 5


def test_an_operators_own_fault(spark):
    def operator(elements):
        if elements[0]["content"] == "bad":
            raise KeyError("boom")
        if elements[0]["content"] == "odd":
            return [{"content": 7}]
        return [e | {"content": e["content"].upper()} for e in elements]

    every = pages(spark, ["q1. why", "bad"], ["a) x"], doc="a").unionByName(pages(spark, ["q1. why"], ["bad"], doc="b")).unionByName(pages(spark, ["odd"], doc="c"))
    tried = fl.attempt(every, lambda p: ex.extract(p, ex.general_grammar(GENERAL)), fl.tried("upper", operator), fl.check("size", lambda e: F.when(F.size(e) > 5, "too many")))
    found = errors(tried)
    assert [x[:4] for x in found[:1]] == [("b", 1, "upper", "KeyError")] and "boom" in found[0][4]
    assert [x[:3] for x in found[1:]] == [("c", 0, "upper")]
    assert problems(tried.problems) == [("1", "WHYBAD", "", {"A": "X"}, "")]


def test_a_failing_extractor_leaves_the_others_in_the_ranking(spark):
    """Both extractors are tried on all documents; where one fails, the other is taken."""
    every = books(spark)
    strict = fl.attempt(every, ex.extract_book_a, *fl.BOOK_A_STAGES)
    other = fl.attempt(every, lambda p: ex.extract(p, ex.book_a_grammar()))
    best = {r.doc_id: r.candidate for r in ev.best({"strict": fl.evaluate(every, strict), "other": fl.evaluate(every, other)}).collect()}
    assert (best["no_box"], best["no_head"], best["good"]) == ("other", "other", "strict")
    assert other.errors.count() == 0


def test_numbers_that_are_no_decimals(spark):
    """Superscripts are digits and no decimals: such a number can't be compared, which fails the evaluation of its document alone."""
    grammar = ex.general_grammar(ex.RegexPatterns(r"^Q(?P<number>\S+)[.]\s*(?P<question>.*)$", GENERAL.options, None, (), ()))
    every = pages(spark, ["Q². why"], doc="a").unionByName(pages(spark, ["Q2. why not, then"], doc="b"))
    got = {r.doc_id: r for r in fl.evaluate(every, fl.attempt(every, lambda p: ex.extract(p, grammar))).collect()}
    assert got["a"].score == 0.0 < got["b"].score and got["a"].warnings[0].startswith("extractor failed")


def test_stages_go_by_their_order_and_pass_failed_pages_by(spark):
    every = pages(spark, ["x"], ["y", "z"], doc="a")
    stages = (fl.check("late", lambda e: F.when(F.size(e) == 2, "two")), fl.check("early", lambda e: F.lit("any"), "KindError"), fl.column("twice", tr.replace_text({"x": "xx"})))
    assert errors(fl.attempt(every, lambda p: p, *stages)) == [("a", 1, "late", "ValueError", "two")]
    assert fl.attempt(every, lambda p: p, stages[2]).problems.orderBy("page_index").first().elements[0].content == "xx"


def test_nothing(spark):
    none = pages(spark, ["x"]).limit(0)
    tried = fl.attempt(none, ex.extract_book_a, *fl.BOOK_A_STAGES, fl.tried("t", lambda e: e))
    assert errors(tried) == [] and fl.evaluate(none, tried).count() == 0
