"""Grammars as data: a table of patterns by document, joined to lines and applied as columns, so that any number of documents is read by patterns of their own in one plan."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions.patterns import PatternError, RegexPatterns, parse_patterns, translate
from quirefold.functions.text import is_blank, is_digits
from quirefold.operators.extraction import ATTEMPTS, SAMPLE_CHARS, Grammar, blocks, page_texts, problems_of_blocks, text_segments

_GROUPS = ("number", "question", "label", "text", "answer")
_PART = "struct<java: string, number: int, question: int, label: int, text: int, answer: int>"
#: A document's grammar: its patterns in Java's syntax with the numbers of their groups (-1: none), and what is noise.
GRAMMAR = f"struct<question: {_PART}, options: {_PART}, answer: {_PART}, noise_lines: array<string>, noise_prefixes: array<string>, goes_on: array<string>>"


def grammar_row(patterns: RegexPatterns) -> dict:
    """The grammar of patterns as a value of GRAMMAR."""

    def part(pattern: str | None) -> dict | None:
        if not pattern:
            return None
        found = translate(pattern)
        return {"java": found.java} | {n: -1 if found.group(n) is None else found.group(n) for n in _GROUPS}

    return {
        "question": part(patterns.question), "options": part(patterns.options), "answer": part(patterns.answer), "noise_lines": list(patterns.noise_lines), "noise_prefixes": list(patterns.noise_prefixes),
        "goes_on": ["question", "option"] if patterns.multiline_options else ["question"],
    }


def _result_type() -> pa.DataType:
    part = pa.struct([("java", pa.string()), *[(n, pa.int32()) for n in _GROUPS]])
    listed = pa.list_(pa.string())
    return pa.struct([("g", pa.struct([("question", part), ("options", part), ("answer", part), ("noise_lines", listed), ("noise_prefixes", listed), ("goes_on", listed)])), ("error", pa.string())])


def parsed(raw: DataFrame) -> DataFrame:
    """(doc_id, g, error) for raw (doc_id, raw_json): the grammar that a document's JSON gives, or why it can't be used. A document takes the first of its usable configurations by their text.

    Configurations are checked once for each distinct text, in tasks; nothing is collected.
    """

    def check(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            try:
                if text is None:
                    raise PatternError("no configuration")
                out.append({"g": grammar_row(parse_patterns(text)), "error": None})
            except (PatternError, re.error, RecursionError) as e:
                out.append({"g": None, "error": str(e)})
        return pa.array(out, _result_type())

    distinct = raw.select("raw_json").distinct().withColumn("r", F.arrow_udf(check, f"struct<g: {GRAMMAR}, error: string>")(F.col("raw_json"))).withColumnRenamed("raw_json", "_raw")
    rows = raw.join(distinct, raw["raw_json"].eqNullSafe(distinct["_raw"]))
    first = F.min_by(F.struct("r.g", "r.error"), F.struct(F.col("r.error").isNotNull(), "raw_json"))
    return rows.groupBy("doc_id").agg(first.alias("r")).select("doc_id", "r.g", "r.error")


@dataclass(frozen=True)
class PatternColumn:
    """A pattern that each row brings along; it has the methods of functions.patterns.Pattern. Rows of a document follow each other, so Spark compiles its pattern once."""

    part: Column

    def _at_start(self) -> Column:
        return F.concat(F.lit("^(?:"), self.part["java"], F.lit(")"))

    def group(self, name: str) -> int | None:
        return 0 if name in _GROUPS else None

    def matches(self, c: Column) -> Column:
        return F.coalesce(F.call_function("regexp_instr", c, self._at_start()) > 0, F.lit(False))

    def first(self, c: Column, name: str) -> Column:
        found = F.call_function("regexp_extract", c, self._at_start(), F.greatest(self.part[name], F.lit(0)))
        return F.when(self.part[name] < 0, "").otherwise(found)

    def within(self, c: Column) -> Column:
        return F.coalesce(F.call_function("regexp_instr", c, self.part["java"]) > 0, F.lit(False))

    def each(self, c: Column, name: str) -> Column:
        return F.regexp_extract_all(c, self.part["java"], self.part[name])


def column_grammar(g: Column) -> Grammar:
    """The grammar in a column of type GRAMMAR."""

    def noise(line: Column) -> Column:
        return is_digits(line) | F.array_contains(g["noise_lines"], line) | F.exists(g["noise_prefixes"], lambda p: line.startswith(p))

    return Grammar(PatternColumn(g["question"]), PatternColumn(g["options"]), noise, PatternColumn(g["answer"]), follows=lambda kind: F.array_contains(g["goes_on"], kind))


def extract(pages: DataFrame, grammars: DataFrame) -> DataFrame:
    """Problems of pages by the grammar of each document, of grammars (doc_id, g), a row a document; documents without one give none.

    A document's grammar is joined to its pages, whose lines are told apart there, and to its blocks; pages and blocks of a document stay where they are.
    """
    own = grammars.select(F.col("doc_id").alias("_doc"), "g")
    grammar = column_grammar(F.col("g"))
    rows = pages.select("doc_id", "page_index", F.transform("elements", lambda e: F.struct(e["content"].alias("content"))).alias("elements"))
    found = blocks(text_segments(rows.join(own, rows["doc_id"] == own["_doc"]), grammar))
    return problems_of_blocks(found.join(own, found["doc_id"] == own["_doc"]).drop("_doc"), grammar)


def samples(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """(doc_id, sample, error) for ranges (doc_id, start, stop) of sample pages: their texts a line each, cut to the first characters; error where there is no such range or it is blank."""
    counts = pages.groupBy("doc_id").agg(F.count("*").alias("n"))
    asked = ranges.select("doc_id", F.col("start").alias("_start"), F.col("stop").alias("_stop"))
    inside = asked.join(page_texts(pages), "doc_id").where("page_index >= _start AND page_index < _stop")
    texts = inside.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_index", "text"))).alias("ts"))
    sample = F.substring(F.array_join(F.transform("ts", lambda t: t["text"]), "\n"), 1, SAMPLE_CHARS)
    rows = asked.join(counts, "doc_id", "left").join(texts, "doc_id", "left").withColumn("sample", sample)
    error = (
        F.when((F.col("_start") < 0) | (F.col("_stop") <= F.col("_start")), "samples must be a range of page indexes that is not empty")
        .when(F.coalesce("n", F.lit(0)) < F.col("_stop"), "samples exceed the page count").when(is_blank(F.coalesce("sample", F.lit(""))), "the sample is blank")
    )
    return rows.select("doc_id", F.when(error.isNull(), F.col("sample")).alias("sample"), error.alias("error"))


def analyzed(sampled: DataFrame, analyzer: Callable[[str, str | None], str], attempts: int = ATTEMPTS) -> DataFrame:
    """(doc_id, raw_json, error) from an analyzer (sample, error of the last try) -> JSON, called in tasks, a document at a time.

    It is asked again with the fault that its answer has, up to attempts times; what it raises itself isn't tried again, and is the error of that document alone.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                raw, error = None, r["error"]
                for _ in range(attempts if r["sample"] is not None else 0):
                    try:
                        raw = analyzer(r["sample"], error)
                        parse_patterns(raw)
                        error = None
                        break
                    except PatternError as e:
                        raw, error = None, str(e)
                    except Exception as e:  # whatever a caller's analyzer raises
                        raw, error = None, f"{type(e).__name__}: {e}"
                        break
                rows.append((r["doc_id"], raw, error))
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["doc_id", "raw_json", "error"])

    return sampled.select("doc_id", "sample", "error").mapInArrow(ask, "doc_id string, raw_json string, error string")


def infer(pages: DataFrame, ranges: DataFrame, analyzer: Callable[[str, str | None], str], attempts: int = ATTEMPTS) -> DataFrame:
    """(doc_id, g, error): a grammar for each document of ranges (doc_id, start, stop), from an analyzer that sees its sample. The analyzer is called once for a document, so write the result where it is read more than once."""
    asked = analyzed(samples(pages, ranges), analyzer, attempts)
    return parsed(asked).join(asked.select("doc_id", F.col("error").alias("why")), "doc_id").select("doc_id", "g", F.coalesce("why", "error").alias("error"))
