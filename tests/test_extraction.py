from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from quirefold.operators import evaluation as ev
from quirefold.operators import extraction as ex
from quirefold.operators import ranges as rg
from quirefold.sources.adapters import BOOK_PATTERNS, contents
from quirefold.sources.schemas import PAGES
from quirefold.streaming.events import run_once
from quirefold.streaming.problems import block_problems, stream_blocks, with_document_ends


def line(text, x=200.0, y=10.0, width=600.0):
    x, y = float(x), float(y)
    return ([(x, y), (x + width, y), (x + width, y + 20), (x, y + 20)], "text", text)


def pages(spark, *texts, doc="d"):
    return spark.createDataFrame([(doc, i, [e if isinstance(e, tuple) else ([], "text", e) for e in page]) for i, page in enumerate(texts)], PAGES)


def problems(df):
    return [(r.number, r.question, r.answer, {o.label: o.text for o in r.options}, r.analysis) for r in df.orderBy("doc_id", "problem_seq").collect()]


def test_book_a(spark):
    got = ex.extract_book_a(pages(spark, [line(t, y=10.0 + 30 * i) for i, t in enumerate(["四海公考", "1.（2024年 北京 75%）", "stem one", "stem two", "A. first", "more", "B.second", "【参考答案】AB", "ignored", "【题型分类】 kind", "dropped", "【实战解析】because", "of this", "12", "2.(2023广东)", "next"])]))
    assert problems(got) == [("1", "stem onestem two", "AB", {"A": "firstmore", "B": "second"}, "becauseof this"), ("2", "next", "", {}, "")]


@pytest.mark.parametrize("side", [1000.0, 0.0])
def test_annotations_join_the_problem_beside(spark, side):
    page = [line("1.（2024年北京）", 400, 100), line("【实战解析】x", 400, 150), line("2.（2024年北京）", 400, 300), line("【实战解析】y", 400, 350), line("花生批注 b", side, 320), line("tail", side, 340), line("花生批注 a", side, 120)]
    assert [p[4] for p in problems(ex.extract_book_a(pages(spark, page)))] == ["x花生批注 a", "y花生批注 btail"]


def test_annotations_across_pages(spark):
    one = [line("1.（2024年北京）", 400, 100), line("花生批注 early", 1000, 10), line("花生批注 a", 1000, 120)]
    two = [line("【实战解析】x", 400, 50), line("花生批注 b", 1000, 60), line("2.（2024年北京）", 400, 200)]
    assert [p[4] for p in problems(ex.extract_book_a(pages(spark, one, two)))] == ["x花生批注 a花生批注 b", ""]


def test_book_b(spark):
    got = ex.extract(pages(spark, ["例题12（国考）stem", "goes on"], ["自测用，禁止商用", "3", "A. one  B．two", "C．three", "lost"], ["例题13(x)"]), ex.book_b_grammar())
    assert problems(got) == [("12", "stemgoes on", "", {"A": "one", "B": "two", "C": "three"}, ""), ("13", "", "", {}, "")]


GENERAL = ex.RegexPatterns(r"^Q(?P<number>\d+)[.]\s*(?P<question>.*)$", r"(?P<label>[A-D])\)\s*(?P<text>.*?)(?=\s+[A-D]\)|$)", r"^Answer:\s*(?P<answer>.*)$", ("noise",), ("--",))


def test_general(spark):
    got = ex.extract(pages(spark, ["before", "Q1. why ", "noise", "-- cut", "more", "A) x  B) y", "goes on", "Answer: A ", "lost", "A) again"], [], ["tail", "７", "Q2. not"]), ex.general_grammar(GENERAL))
    assert problems(got) == [("1", "whymore", "A", {"A": "againtail", "B": "ygoes on"}, ""), ("2", "not", "", {}, "")]
    assert [(r.header_page, r.completed_page) for r in got.orderBy("problem_seq").collect()] == [(0, 2), (2, 2)]


def plain_problems(book):
    """Problems of one document's pages (contents), block by block: a block is a header's line and the lines to the next header."""
    q, o, a = (re.compile(x) for x in (GENERAL.question, GENERAL.options, GENERAL.answer))
    lines = [(p, t.strip()) for p, contents in enumerate(book) for t in contents]
    lines = [(p, t) for p, t in lines if t and not t.isdigit() and t not in GENERAL.noise_lines and not t.startswith(GENERAL.noise_prefixes)]
    heads = [i for i, (_, t) in enumerate(lines) if q.match(t)]
    for n, (i, stop) in enumerate(zip(heads, [*heads[1:], len(lines)]), 1):
        head, texts, into = q.match(lines[i][1]), {"question": "", "answer": ""}, ("question", None)
        texts["question"] = head["question"].strip()
        options = {}
        for _, t in lines[i + 1 : stop]:
            if found := o.findall(t):
                options |= {label: x.strip() for label, x in found}
                into = ("option", found[-1][0])
            elif m := a.match(t):
                texts["answer"], into = m["answer"].strip(), ("answer", None)
            elif into[0] == "option":
                options[into[1]] += t
            elif into[0] == "question":
                texts["question"] += t
        yield n, head["number"], texts["question"], texts["answer"], [*options.items()], lines[i][0], lines[stop][0] if stop < len(lines) else len(book) - 1


def test_random_books_against_plain_blocks(spark):
    rng = random.Random(0)
    rows, want = [], []
    for d in range(12):
        book = [[rng.choice(["Q%d. q" % rng.randrange(9), "A) a%d" % rng.randrange(9), "B) b C) c", "Answer: z", "text", " noise ", "5", "", "D)", "-- x", "Q3. r A) s", "\u2003A) wide\u3000"]) for _ in range(rng.randrange(0, 9))] for _ in range(rng.randrange(1, 5))]
        rows += [(f"d{d}", p, [([], "text", c) for c in contents]) for p, contents in enumerate(book)]
        want += [(f"d{d}", *x) for x in plain_problems(book)]
    got = ex.extract(spark.createDataFrame(rows, PAGES), ex.general_grammar(GENERAL))
    key = lambda r: (*r[:5], [(o["label"], o["text"]) for o in r[5]], r[6], r[7])
    assert sorted(key(r) for r in got.select("doc_id", "problem_seq", "number", "question", "answer", "options", "header_page", "completed_page").collect()) == sorted(want)


def test_stream_gives_what_the_batch_does(spark, tmp_path):
    book = pages(spark, ["Q1. a", "A) x"], ["goes on", "Q2. b"], []).unionByName(pages(spark, ["Q7. c"], doc="e")).unionByName(pages(spark, ["none"], doc="f"))
    whole = with_document_ends(book)
    for batch in (whole.where("page_index = 0"), whole.where("page_index > 0")):
        batch.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run_once(stream_blocks(stream, ex.general_grammar(GENERAL)), str(tmp_path / "out"), str(tmp_path / "cp"))
    columns = ["doc_id", "problem_seq", "number", "question", "answer", "options", "header_page", "completed_page"]
    got = block_problems(spark.read.parquet(str(tmp_path / "out")), ex.general_grammar(GENERAL))
    assert sorted(got.select(columns).collect()) == sorted(ex.extract(book, ex.general_grammar(GENERAL)).select(columns).collect())


def test_pages_without_problems_stay(spark):
    book = pages(spark, ["Q1. a"], [], ["Q2. b"], ["x"])
    got = ex.page_problems(book, ex.extract(book, ex.general_grammar(GENERAL)), 10).orderBy("page_index").collect()
    assert [(r.page_index, [p.number for p in r.problems]) for r in got] == [(10, []), (11, []), (12, ["1"]), (13, ["2"])]
    with pytest.raises(ValueError):
        ex.page_problems(book, book, -1)


def test_inferred_patterns(spark):
    book, asked = pages(spark, ["Q1. a"], ["Q2. b"]), []

    def analyzer(sample, error):
        asked.append((sample, error))
        return "{}" if error is None else GENERAL.to_json()

    assert [p[0] for p in problems(ex.extract_inferred(book, 0, 1, analyzer))] == ["1", "2"]
    assert asked[0] == ("Q1. a", None) and "question should be a string" in asked[1][1]
    with pytest.raises(ValueError, match="exceed"):
        ex.infer_patterns(book, 0, 3, analyzer)
    with pytest.raises(ex.PatternError, match="3 attempts"):
        ex.infer_patterns(book, 0, 1, lambda s, e: "{}")


def evaluated(spark, book):
    return ev.evaluate(book, ex.extract(book, ex.general_grammar(GENERAL))).first()


def test_evaluation(spark):
    good = evaluated(spark, pages(spark, ["Q1. what is all this", "A) one", "B) two", "Q2. and what is that", "A) x", "B) y"]))
    assert good.question_completeness == good.option_completeness == good.structural_consistency == good.extraction_validity == 1 and good.warnings == []
    assert good.text_coverage == pytest.approx(40 / 42) and good.score == pytest.approx((40 / 42) ** 0.2)
    bad = evaluated(spark, pages(spark, ["Q1. a", "Q1. b", "C) c"]))
    assert bad.score < good.score and "duplicate problem numbers detected" in bad.warnings and bad.structural_consistency == pytest.approx((1 + 0.5 + 0) / 3)
    none = evaluated(spark, pages(spark, ["nothing"], []))
    assert (none.score, none.warnings) == (0, ["extractor produced no problems"])


def test_config():
    for bad in ({"weights": {"a": 1.0}}, {"weights": dict.fromkeys(ev.METRICS, 0.3)}, {"min_options": 7}):
        with pytest.raises(ValueError):
            ev.Config(**bad)


def scores(spark, **by_doc):
    return spark.createDataFrame([*by_doc.items()], "doc_id string, score double")


def test_ranking_and_fallback(spark):
    a, b, general = scores(spark, x=0.95, y=0.8, z=0.5, w=0.8), scores(spark, x=0.95, y=0.7, z=0.6, w=0.8), scores(spark, x=1.0, y=0.9, z=0.65, w=0.8)
    assert {(r.doc_id, r.candidate) for r in ev.best({"a": a, "b": b}).collect()} == {("x", "a"), ("y", "a"), ("z", "b"), ("w", "a")}
    got = {r.doc_id: (r.candidate, r.outcome) for r in ev.select_with_fallback({"a": a, "b": b}, general).collect()}
    assert got == {"x": ("a", "selected"), "y": ("general", "selected"), "z": ("general", "low_confidence"), "w": ("a", "selected")}
    assert {r.outcome for r in ev.select_with_fallback({"a": a}, None).where("doc_id <> 'x'").collect()} == {"fallback_unavailable"}
    with pytest.raises(ValueError):
        ev.rank({})


def test_ranges(spark):
    schema = "doc_id string, ordinal int, name string, start int, stop int, step int, page_count int"
    ok = [("questions", 2, 5, 1), ("answers", 5, 9, 1)]
    cases = {
        "fine": (ok, None), "none": ([("answers", 0, 1, 1)], "questions is required"), "step": ([("questions", 0, 4, 2)], "questions must be a non-empty range with step 1"),
        "empty": ([("questions", 3, 3, 1)], "questions must be a non-empty range with step 1"), "out": ([("questions", 0, 11, 1)], "questions is out of bounds"), "over": ([*ok, ("contents", 4, 5, 1)], "questions overlaps contents"),
    }
    rows = [(d, i, n, a, b, s, 10) for d, (rs, _) in cases.items() for i, (n, a, b, s) in enumerate(rs)]
    assert {r.doc_id: r.error for r in rg.validate_ranges(spark.createDataFrame(rows, schema)).collect()} == {d: e for d, (_, e) in cases.items()}


def test_scan_is_bounded(spark):
    texts = rg.scan_texts(pages(spark, *[["x" * 30]] * 25), 20, 10).first()
    assert texts.page_count == 25 and texts.prompt.count("<page") == 20 and "x" * 11 not in texts.prompt


def test_asking_again():
    answers = iter(["bad", "good"])
    assert rg.ask("p", 3, lambda p, e: next(answers), lambda a, n: None if a == "good" else "no") == "good"
    with pytest.raises(ValueError, match="2 attempts"):
        rg.ask("p", 3, lambda p, e: "bad", lambda a, n: "no", 2)


def test_first_range_wins(spark):
    points = spark.createDataFrame([("k", 1.0), ("k", 5.0), ("k", 9.0), ("m", 1.0)], "k string, y double")
    ranges = spark.createDataFrame([("k", float("-inf"), 4.0, 2), ("k", 0.0, 6.0, 1), ("k", 5.0, float("inf"), 3)], "k string, a double, b double, n int")
    assert sorted((r.k, r.y, r.n) for r in ex.first_range_join(points, ranges, ["k"], "y", "a", "b", "n").collect()) == [("k", 1.0, 1), ("k", 5.0, 1), ("k", 9.0, 3)]


def test_lines_of_keeps_empty_pages(spark):
    assert ex.lines_of(pages(spark, ["a"], [])).where(F.col("element").isNull()).count() == 1


def test_segments_are_sorted_and_not_lines(spark):
    book = pages(spark, ["lost", "Q1. a", *["more"] * 50, "Q2. b"], [], ["tail"] * 50)
    parts = ex.segments(book.select("doc_id", "page_index", ex.told_lines(F.col("elements"), ex.general_grammar(GENERAL)).alias("told")))
    rows = parts.orderBy("page_index", "nth").select("page_index", F.size(F.coalesce("lines", F.array())).alias("n"), "head", "problem_seq", "last_page").collect()
    assert [tuple(r) for r in rows] == [(0, 1, False, 0, 2), (0, 51, True, 1, 2), (0, 1, True, 2, 2), (1, 0, False, 2, 2), (2, 50, False, 2, 2)]


def test_tails_sections_and_repeated_labels(spark):
    book = pages(spark, ["第1题 q", "more", "A. x B. y", "tail", "答案：C", "after", "A. z", "end", "答案：D"])
    (got,) = ex.extract(book, ex.general_grammar(BOOK_PATTERNS)).collect()
    assert (got.question, got.answer, [(o.label, o.text) for o in got.options]) == ("qmore", "D", [("A", "zend"), ("B", "ytail")])


def test_contents_extract_as_whole_elements_do(spark):
    book = pages(spark, ["第1题 q", "A. x", "tail"], ["答案：C"])
    found = [ex.extract(p, ex.general_grammar(BOOK_PATTERNS)).collect() for p in (book, contents(book))]
    assert found[0] == found[1] and found[0] and contents(book).schema["elements"].dataType.elementType.names == ["content"]


def test_grammars_that_cut_alike_share_their_blocks(spark, monkeypatch):
    from dataclasses import replace

    general = ex.general_grammar(BOOK_PATTERNS)
    grammars = {"b": ex.book_b_grammar(), "single": replace(general, goes_on=frozenset({"question"})), "general": general}
    lines = ["第1题 what", "　A. yes ", "go on", "答案：A", "7", "第2题 x", "B. no"]
    pages = spark.createDataFrame([("d", 0, [([], "t", x) for x in lines[:3]]), ("d", 1, [([], "t", x) for x in lines[3:]]), ("d", 2, [])], PAGES)
    alone = {name: sorted(map(str, ex.extract(pages, g).collect())) for name, g in grammars.items()}
    cuts = []
    cut = ex.text_segments
    monkeypatch.setattr(ex, "text_segments", lambda p, g: cuts.append(g) or cut(p, g))
    each = {name: sorted(map(str, found.collect())) for name, found in ex.extract_each(pages, grammars).items()}
    assert each == alone and len(cuts) == 2 and alone["single"] != alone["general"] and "A. yes" not in str(alone)


def test_slim_segments_are_those_of_told_lines(spark):
    g = ex.general_grammar(BOOK_PATTERNS)
    pages = spark.createDataFrame([("d", 0, [([], "t", x) for x in ["before", "第1题 a", " x "]]), ("d", 1, []), ("d", 2, [([], "t", x) for x in ["y", "第2题 b", None, "", "12"]])], PAGES)
    columns = ["page_index", "nth", "head", "problem_seq", "last_page"]
    told = ex.segments(pages.select("doc_id", "page_index", ex.told_lines(F.col("elements"), g).alias("told")))
    one, two = (sorted(map(str, x.collect())) for x in (told.select(*columns, F.col("lines")["line"].alias("lines")), ex.text_segments(pages, g).select(*columns, "lines")))
    assert one == two and len(one) == 5
