"""Plans of the queries over books, and what they do on odd books."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quirefold.functions import text as tx
from quirefold.operators import evaluation as ev
from quirefold.operators import extraction as ex
from quirefold.operators import failures as fl
from quirefold.operators import transforms as tr
from quirefold.plans import book_queries as bq
from quirefold.sources.schemas import PAGES
from quirefold.streaming.problems import lines_of_parts, next_parts, page_parts

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data here")
def test_options_are_worked_out_once(spark):
    """No filter beneath the explode repeats what makes the options."""
    filters = [x for x in plan(bq.extract_general_options(spark, SF)).splitlines() if "Filter" in x]
    assert filters and not any("regexp" in x or "size(" in x for x in filters)


def test_parts_of_a_page_keep_every_line_as_it_is(spark):
    """What the streams hand on as text comes back unchanged, however odd a line is."""
    odd = ['"quoted", {braces} and [more]', "back\\slash", "tab\tand separator", "\u0001 control", "𠮷 beyond", "null", "x" * 70_000]
    rows = [("d", 3, [([], "text", x) for x in ("before", "第1题 a", *odd, "第2题 b", "end")]), ("d", 4, []), ("d", 5, None)]
    pages = spark.createDataFrame(rows, PAGES)
    found = page_parts(pages, bq.GENERAL).orderBy("page_index")
    got = found.select("page_index", "opens", F.transform("parts", lines_of_parts).alias("parts")).collect()
    told = [(r.page_index, r.opens, r.parts and [[(x.page_index, x.element_index, x.line) for x in p] for p in r.parts]) for r in got]
    lines = [(3, i, x) for i, x in enumerate(("before", "第1题 a", *odd, "第2题 b", "end"))]
    assert told == [(3, False, [lines[:1], lines[1:-2], lines[-2:]]), (4, False, []), (5, False, None)]


def test_a_page_is_few_values_for_the_stream(spark):
    """A state is text, and a page's parts are as many as its headers, not its lines."""
    pages = spark.createDataFrame([("d", 0, [([], "text", x) for x in ("第1题 a", *["line"] * 500, "第2题 b")])], PAGES)
    (row,) = page_parts(pages, bq.GENERAL).collect()
    assert len(row.parts) == 2 and next_parts(0, "", 0, row.parts, row.opens)[0] == 2


def test_rows_of_columns_are_those_of_scalars():
    """An operator gets what to_pylist() gives, nulls at every level included."""
    listed = pa.list_(pa.struct([("bbox", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))), ("label", pa.string()), ("content", pa.string())]))
    pages = [None, [], [{"bbox": [{"x": 1.5, "y": 2.0}] * 4, "label": "t", "content": "a"}], [None, {"bbox": None, "label": None, "content": "b"}, {"bbox": [None, {"x": None, "y": 1.0}, {"x": float("inf"), "y": -0.0}], "label": "c", "content": None}]]
    whole = pa.array(pages * 3, listed)
    for at in range(len(whole) + 1):
        assert fl._rows(whole[at:]) == whole[at:].to_pylist()


def test_only_elements_without_a_box_are_tried_as_headers(spark):
    """The pattern is not looked for in an element that has a box."""
    text = str(fl.book_a_headers(F.col("elements"))._jc)
    assert "exists" in text.lower() and "filter" not in text.lower()


@pytest.mark.parametrize("xs", [[0.0, 500.0, 0.0], [5.0, 5.0], [], [1.0], [0.1] * 7 + [0.1 + 2e-16] * 5, [1.0, 2.0, 3.0], [1.0, float("nan")], [float("nan")] * 2, [-1e300, 1e300], [float("-inf"), 0.0], [-0.0, 0.0, 3.0]])
def test_two_left_edges_are_told_apart_as_by_rounds(spark, xs):
    """Two values far apart need no round of 2-means; the sides are those that the rounds give."""
    left, right = (min(xs, key=lambda x: (x != x, x)), max(xs, key=lambda x: (x != x, x))) if xs else (0, 0)
    if left == right:
        want = [0] * len(xs)
    else:
        for _ in range(tr.FOLD_ROUNDS):
            sides = [int(not abs(x - left) <= abs(x - right)) for x in xs]
            means = [([x for x, s in zip(xs, sides, strict=True) if s == k]) for k in (0, 1)]
            left, right = (sum(m) / len(m) if m else old for m, old in zip(means, (left, right), strict=True))
        want = [int(abs(x - left) > abs(x - right)) for x in xs]
    df = spark.createDataFrame([(xs,)], "xs array<double>")
    if not any(x != x for x in xs):
        assert df.select(tr.column_of(F.col("xs"))).first()[0] == want


def test_two_values_take_no_round(spark):
    assert "forall" in str(tr.column_of(F.col("xs"))._jc).lower()


def test_watermarks_and_spaces_go_as_before(spark):
    texts = [["公考最新资料、更新进度微信abc123 x", None, " 　y "], ["z"], [" w\x1c"], []]
    df = spark.createDataFrame([(t,) for t in texts], "t array<string>")
    got = [r[0] for r in df.select(ex.clean_each(F.col("t"), ex.book_a_grammar())).collect()]
    assert got == [["x", None, "y"], ["z"], ["w"], []]


def test_characters_are_counted_by_key_as_in_normalised_texts(spark, monkeypatch):
    texts = ["ΑΣ", "Σ ΣΑΣ", "straße ŉ ﬃ ß", "İıI i̇", "第7题 答案", "", None, "-- \U0001F600 𐐀𠮷²Ⅷ", "ᏸᎠꭰ", "é é", "a" * 40]
    rows = spark.createDataFrame([(None if i % 5 == 4 else f"k{i % 3}", t) for i, t in enumerate(texts)], "k string, t string").coalesce(1)
    each = rows.select("k", F.inline_outer(tx.char_counts(tx.normalized(F.col("t"))))).where("n > 0").groupBy("k", "c").agg(F.sum("n").alias("n"))
    want = {(r.k, r.c): r.n for r in each.collect()} | {(k, ""): 0 for k in (None, "k0", "k1", "k2")}
    got = {(r.k, r.c): r.n for r in tx.normal_counts(rows, "k", F.col("t")).groupBy("k", "c").agg(F.sum("n").alias("n")).collect()}
    assert got == want
    arrow = pa.RecordBatch.from_arrays([pa.array([None if i % 5 == 4 else f"k{i % 3}" for i in range(len(texts))]), pa.array(texts)], names=["key", "text"])
    summed = lambda found: Counter({(r["key"], r["c"]): r["n"] for b in found for r in b.to_pylist() if r["n"]}) if len(found) == 1 else sum((summed([b]) for b in found), Counter())
    whole = summed([*tx._counted_by_key(iter([arrow]))])
    monkeypatch.setattr(tx, "_COUNTED", 3)
    assert summed([*tx._counted_by_key(iter([arrow]))]) == whole and whole[(None, "第")] == 1


def test_a_table_and_a_sort_count_alike():
    texts = pa.array(["".join(chr(0x4E00 + (i * 37 + j * 11) % 9000) for j in range(5)) for i in range(400)])
    row, letter, times, alphabet = tx._cells(texts, np.arange(400), 400)  # many characters, each rare: too large for a table
    assert [sorted(t) for t in texts.to_pylist()] == [[chr(alphabet[x]) for x, n in zip(letter[row == i], times[row == i], strict=True) for _ in range(n)] for i in range(400)]
    assert len(tx._cells(pa.array(["", None]), np.arange(2), 2)[0]) == 0


def odd_books(spark):
    books = [("a", 0, ["第1题 why is it so", "A. x", "from y", "B. z", "答案：A"]), ("a", 1, ["第2题 q", "第2题 again", "tail"]), ("b", 0, ["no header"]), ("c", 0, []), ("d", 0, ["第²题 no decimal"])]
    return spark.createDataFrame([(d, i, [([], "text", x) for x in lines]) for d, i, lines in books], PAGES)


def test_candidates_evaluated_together_are_each_as_alone(spark):
    pages = odd_books(spark)
    grammars = {"book_b": ex.book_b_grammar(), "single": bq.SINGLE, "general": bq.GENERAL, "book_a": ex.book_a_grammar()}
    found = ex.extract_each(pages, grammars)
    alone = {name: ex.extract(pages, g) for name, g in grammars.items()}
    for name in grammars:
        assert found[name].columns == alone[name].columns
        assert sorted(map(str, found[name].collect())) == sorted(map(str, alone[name].collect()))
    together = ev.evaluate_each(pages, found)
    for name in grammars:
        got = together.where(F.col("candidate") == name).drop("candidate")
        assert sorted(map(str, got.collect())) == sorted(map(str, ev.evaluate(pages, alone[name]).collect()))


def test_grammars_that_go_on_differently_share_the_work_on_lines(spark):
    """single and general are columns of one table, so a line is told apart once for both."""
    found = ex.extract_each(odd_books(spark), {"single": bq.SINGLE, "general": bq.GENERAL})
    assert {*found["single"].inputFiles()} == {*found["general"].inputFiles()} != set()


def test_candidates_meet_in_one_grouping(spark):
    """Characters of the documents and of all candidates are shuffled once, not once for each candidate."""
    pages = odd_books(spark)
    one = {"x": ex.extract(pages, bq.GENERAL)}
    groupings = lambda c: sum("Aggregate [doc_id" in x and ", c#" in x for x in plan(ev.evaluate_each(pages, c)).splitlines())
    assert groupings(one | {"y": one["x"], "z": one["x"]}) == groupings(one) > 0


def test_an_operator_is_called_on_some_pages_at_a_time(spark, monkeypatch):
    """Results of all calls come back in order, a fault in one included."""
    monkeypatch.setattr(fl, "_CALLED", 2)

    def operator(elements):
        if elements and elements[0]["content"] == "x3":
            raise KeyError("boom")
        return [e | {"content": e["content"] + "!"} for e in elements]

    pages = spark.createDataFrame([(f"d{i}", 0, [([(1.0, float(i))], "text", f"x{i}")] * (i % 3)) for i in range(7)], PAGES).coalesce(1)
    tried = fl.attempt(pages, lambda p: p, fl.tried("t", operator))
    assert [(r.doc_id, r.type) for r in tried.errors.collect()] == []
    assert sorted((r.doc_id, [(e.content, e.bbox[0].y) for e in r.elements]) for r in tried.problems.collect()) == [(f"d{i}", [(f"x{i}!", float(i))] * (i % 3)) for i in range(7)]
    bad = spark.createDataFrame([(f"d{i}", 0, [([], "text", f"x{i}")]) for i in range(7)], PAGES).coalesce(1)
    assert [(r.doc_id, r.type) for r in fl.attempt(bad, lambda p: p, fl.tried("t", operator)).errors.collect()] == [("d3", "KeyError")]
