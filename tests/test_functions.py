from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quirefold.functions import patterns as pt
from quirefold.functions import text as tx


def column(spark, values, f):
    return [r.v for r in spark.createDataFrame([(v,) for v in values], "s string").select(f(F.col("s")).alias("v")).collect()]


SAMPLES = ["", " ", "a b", "　x　", "\x1cq\x1f", "Straße ẞ ŉ ΣΑΣ ς ﬁ İ", "Ａ１！", "①²３", "é́", "中文 12", "ǅ", "ͅ"]


def test_strip(spark):
    assert column(spark, SAMPLES, tx.strip) == [s.strip() for s in SAMPLES]
    assert column(spark, SAMPLES, tx.is_blank) == [not s.strip() for s in SAMPLES]


def test_normalized(spark):
    assert column(spark, SAMPLES, tx.normalized) == ["".join(c.casefold() for c in s if c.isalnum()) for s in SAMPLES]


def test_digits(spark):
    numbers = ["1", "１２", "①", "1a", "", "²3", "٣"]
    assert column(spark, numbers, tx.is_digits) == [s.isdigit() for s in numbers]
    assert column(spark, numbers, tx.is_decimals) == [s.isdecimal() for s in numbers]


def test_fullwidth(spark):
    every = "　" + "".join(map(chr, range(0xFF01, 0xFF5F)))
    assert column(spark, [every, "～｟"], tx.fullwidth_to_halfwidth) == [" " + "".join(map(chr, range(0x21, 0x7F))), "~｟"]


@pytest.mark.parametrize(("n", "want"), [("1", "①"), ("10", "⑩"), ("20", "⑳"), ("007", "⑦"), ("0", None), ("21", None)])
def test_circled(spark, n, want):
    s = f"a $ \\textcircled{{{n}}} $b"
    assert column(spark, [s], tx.circled_numbers) == [f"a {want}b" if want else s]


def test_char_counts(spark):
    (got,) = column(spark, ["abca"], tx.char_counts)
    assert {(r.c, r.n) for r in got} == {("a", 2), ("b", 1), ("c", 1)} and column(spark, [""], tx.char_counts) == [[]]


def test_formatted_pages(spark):
    rows = spark.createDataFrame([([(1, "b"), (0, "a")],)], "p array<struct<i: int, text: string>>")
    assert rows.select(tx.formatted_pages(F.col("p"))).first()[0] == '<page index="0">\na\n</page>\n<page index="1">\nb\n</page>'


def test_job_ids(spark):
    assert column(spark, ["0" * 32, "0" * 31, "G" * 32, "a" * 32 + "\n"], tx.has_job_id_form) == [True, False, False, False]


def test_translated_patterns(spark):
    p = pt.translate(r"^(?P<number>\d+)[.．]\s*(?P<text>.*?)(?P<tail>x)?$")
    assert column(spark, ["１２．　ab", "3.x", "n"], lambda c: F.concat_ws("/", p.matches(c), p.first(c, "number"), p.first(c, "text"))) == ["true/１２/ab", "true/3/", "false//"]
    q = pt.translate(r"(?P<label>[A-D])[.．]\s*(?P<text>.*?)(?=\s+[A-D][.．]|$)")
    assert column(spark, ["A. x  B．y z"], lambda c: F.to_json(q.every(c, "label", "text"))) == ['[{"label":"A","text":"x"},{"label":"B","text":"y z"}]']


@pytest.mark.parametrize(
    ("bad", "why"),
    [
        ('{"question": 1, "options": "x"}', "question should be a string"), ("[1]", "not a JSON object"), ("{", "not JSON"), ("{}", "question should be a string; options should be a string"), ('{"question": "(", "options": "x"}', "question does not compile"),
        ('{"question": "(?P<number>a)", "options": "b"}', "options lacks the group <label>; options lacks the group <text>"), ('{"question": "(?P<number>a)", "options": "(?P<label>a)(?P<text>b)", "answer": "c"}', "answer lacks the group <answer>"),
        ('{"question": "(?P<number>a)", "options": "(?P<label>a)(?P<text>b)(?P<text_2>c)"}', "options counts its groups"), ('{"question": "(?P<number>a)", "options": "(?P<label>a)(?P<text>b)(?P<label1>c)"}', "<label1>"), ('{"question": "(?P<number>a)", "options": "(?P<label>a)(?P<text>b)", "multiline_options": 1}', "multiline_options should be true or false"),
        ('{"question": "(?P<number>a)", "options": "(?P<label>a)(?P<text>b)", "noise_lines": "x"}', "noise_lines should be a list"), ('{"question": "(?P<number>a)", "options": "(?P<label>a)(?P<text>b)", "noise_prefixes": ["x", 1]}', "noise_prefixes should be a list"),
        ('{"question": "(?P<number>a)", "options": "(?P<label>a)(?P<text>b)", "answer": true}', "answer should be a string"),
    ],
)
def test_bad_patterns(bad, why):
    with pytest.raises(pt.PatternError, match=why):
        pt.parse_patterns(bad)


def test_patterns_round_trip():
    p = pt.RegexPatterns("(?P<number>a)", "(?P<label>a)(?P<text>b)", None, ("x",), ("y",), False)
    assert pt.parse_patterns(p.to_json()) == p
    assert pt.parse_patterns('{"question": "(?P<number>a)", "options": "(?P<label>a)(?P<text>b)(?P<texts>c)", "answer": "", "more": 1}').noise_lines == ()
    with pytest.raises(pt.PatternError, match="2013 characters"):
        pt.RegexPatterns("(?P<number>a)" + "b" * 2000, "(?P<label>a)(?P<text>b)")


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('{"start_page_index": 2, "confidence": 0.8}', (2, 0.8, None)), ('{"start_page_index": 2, "confidence": 1}', (2, 1.0, None)), ('{"start_page_index": true, "confidence": 1}', "start_page_index must be an integer"), ('{"start_page_index": 1.5, "confidence": 1}', "start_page_index must be an integer"),
        ('{"start_page_index": 1, "confidence": "1"}', "confidence must be a number"), ('{"start_page_index": 1, "confidence": 1.5}', "confidence out of range"), ('{"start_page_index": 5, "confidence": 1}', "start_page_index out of range"), ("[]", "not an object"), ("{", "not an object"), ('{"confidence": 1}', "start_page_index must be an integer"),
    ],
)
def test_decisions(spark, raw, want):
    got = spark.createDataFrame([(raw, 5)], "r string, n int").select(pt.start_decision(F.col("r"), F.col("n")).alias("d")).first().d
    assert tuple(got) == (want if isinstance(want, tuple) else (None, None, want))


def test_folding_of_sigma_and_of_scripts_without_folds(spark):
    texts = ["ΑΣ", "ΑΣ Β", "第7题 答案", "ŉﬀẞΐ", "ſa"]
    assert column(spark, texts, tx.normalized) == ["".join(c.casefold() for c in s if c.isalnum()) for s in texts]
    assert column(spark, texts, lambda c: c.rlike(tx._may_have([*tx._folds()[0], *tx._folds()[1]]))) == [True, True, False, True, True]
    assert column(spark, ["", "-。", "a", None], tx.has_text) == [False, False, True, False]


def test_char_counts_of_batches_cut_in_parts(spark, monkeypatch):
    texts = pa.array(["", None, "aba", "第x第", "", "\U0001F600" * 3, None])
    whole = tx._counted_in_parts(texts)
    monkeypatch.setattr(tx, "_COUNTED", 2)
    want = [{}, None, {"a": 2, "b": 1}, {"第": 2, "x": 1}, {}, {"\U0001F600": 3}, None]
    for got in (whole, tx._counted_in_parts(texts), tx._counted_in_parts(texts[:0])):
        found = [None if x is None else {r["c"]: r["n"] for r in x} for x in got.to_pylist()]
        assert found == want[: len(found)]


def test_strip_each(spark):
    texts = [[x] for x in SAMPLES] + [["a", "b c"], ["a", "　b", None], ["a\n", ""], [""], [], ["", "\x85a"], ["a\nb", "c "]]
    got = [r.v for r in spark.createDataFrame([(t,) for t in texts], "s array<string>").select(tx.strip_each(F.col("s")).alias("v")).collect()]
    assert got == [[None if x is None else x.strip() for x in t] for t in texts]
