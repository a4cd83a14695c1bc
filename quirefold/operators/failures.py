"""Errors as values: a stage that fails on a page marks it, later stages pass it by, and its document alone has no problems and a warning that says why."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from quirefold.operators import evaluation as ev
from quirefold.operators.extraction import BOOK_A_ANNOTATION, book_a_clean, book_a_grammar
from quirefold.sources.schemas import ELEMENT
from quirefold.sources.scratch import written

#: What went wrong: the number and name of the stage, the kind of error, and its message.
ERROR = "struct<ordinal: int, stage: string, type: string, message: string>"
Stage = Callable[[DataFrame, int], DataFrame]
#: So many pages become Python objects at once.
_CALLED = 64


@dataclass(frozen=True)
class Attempt:
    """problems of the documents that no stage failed on, and errors (doc_id, page_index, stage, type, message), a row for each other document."""

    problems: DataFrame
    errors: DataFrame


def check(stage: str, message: Callable[[Column], Column], type_: str = "ValueError") -> Stage:
    """A stage that looks at a page's elements as a column and gives a message where they are unfit, else null."""

    def run(pages: DataFrame, ordinal: int) -> DataFrame:
        said = F.when(F.col("error").isNull(), message(F.col("elements")))
        found = F.struct(F.lit(ordinal).alias("ordinal"), F.lit(stage).alias("stage"), F.lit(type_).alias("type"), said.alias("message"))
        return pages.withColumn("error", F.when(said.isNotNull(), found.cast(ERROR)).otherwise(F.col("error")))

    return run


def _rows(array: pa.Array) -> list:
    """array.to_pylist(), but by columns: a nested array's values are made together, and not a scalar for each, which takes several times as long."""
    if pa.types.is_struct(array.type):
        names, columns = [f.name for f in array.type], [_rows(c) for c in array.flatten()]
        if len(names) == 2:
            (a, b), (first, second) = names, columns
            rows = [{a: x, b: y} for x, y in zip(first, second, strict=True)]
        elif len(names) == 3:
            (a, b, c), (first, second, third) = names, columns
            rows = [{a: x, b: y, c: z} for x, y, z in zip(first, second, third, strict=True)]
        else:
            rows = [dict(zip(names, x, strict=True)) for x in zip(*columns, strict=True)]
    elif pa.types.is_list(array.type):
        ends = np.cumsum(pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False), dtype=np.int64).tolist()
        inner = _rows(array.flatten())
        rows = [inner[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)] if ends else []
    elif pa.types.is_string(array.type) or pa.types.is_floating(array.type) and not array.null_count:
        return array.to_numpy(zero_copy_only=False).tolist()
    else:
        return array.to_pylist()
    return [r if ok else None for r, ok in zip(rows, array.is_valid().to_pylist(), strict=True)] if array.null_count else rows


def tried(stage: str, operator: Callable[[list[dict]], list[dict]]) -> Stage:
    """A stage that gives a page's elements, as dicts, to a Python operator and goes on with what it returns; whatever it raises, or returns that are no elements, is that page's error."""

    def run(pages: DataFrame, ordinal: int) -> DataFrame:
        listed = to_arrow_type(_parse_datatype_string(f"array<{ELEMENT}>"))
        result = pa.struct([("elements", listed), ("type", pa.string()), ("message", pa.string())])

        def one(elements: list[dict] | None) -> tuple[list[dict] | None, Exception | None]:
            try:
                return None if elements is None else operator(elements), None
            except Exception as e:  # whatever a caller's operator raises
                return None, e

        def fit(elements: list[dict] | None) -> tuple[list[dict] | None, Exception | None]:
            try:
                pa.scalar(elements, listed)
                return elements, None
            except (pa.ArrowException, TypeError) as e:
                return None, e

        def call(pages: pa.Array) -> pa.Array:
            return pa.concat_arrays([call_some(pages[i : i + _CALLED]) for i in range(0, max(1, len(pages)), _CALLED)])

        def call_some(pages: pa.Array) -> pa.Array:
            done = [one(x) for x in _rows(pages)]
            try:
                made = pa.array([x for x, _ in done], listed)
            except (pa.ArrowException, TypeError):  # some page's result is no list of elements; which, is told one by one
                done = [(x, e) if e else fit(x) for x, e in done]
                made = pa.array([x for x, _ in done], listed)
            types, messages = ([None if e is None else f(e) for _, e in done] for f in (lambda e: type(e).__name__, str))
            return pa.StructArray.from_arrays([made, pa.array(types, pa.string()), pa.array(messages, pa.string())], fields=list(result))

        called = F.arrow_udf(call, f"struct<elements: array<{ELEMENT}>, type: string, message: string>")
        rows = pages.withColumn("_r", called(F.when(F.col("error").isNull(), F.col("elements"))))
        found = F.struct(F.lit(ordinal).alias("ordinal"), F.lit(stage).alias("stage"), F.col("_r.type").alias("type"), F.col("_r.message").alias("message"))
        failed = F.col("_r.type").isNotNull()
        error = F.when(failed, found.cast(ERROR)).otherwise(F.col("error"))
        return rows.withColumns({"error": error, "elements": F.when(F.col("error").isNotNull() | failed, F.col("elements")).otherwise(F.col("_r.elements"))}).drop("_r")

    return run


def column(stage: str, transform: Callable[[Column], Column]) -> Stage:
    """A transform that can't fail, on the pages without an error."""
    return lambda pages, ordinal: pages.withColumn("elements", F.when(F.col("error").isNull(), transform(F.col("elements"))).otherwise(F.col("elements")))


def attempt(pages: DataFrame, extract: Callable[[DataFrame], DataFrame], *stages: Stage) -> Attempt:
    """Problems of pages (doc_id, page_index, elements) that have gone through the stages in their order.

    A document's error is that of its first failing stage, there of the first page. Its other pages are not extracted either, as a document is read
    as a whole. Stages run page by page without a shuffle; what they leave is written, so each is run once.
    """
    rows = pages.withColumn("error", F.lit(None).cast(ERROR))
    for i, stage in enumerate(stages):
        rows = stage(rows, i)
    rows = written(rows)
    first = F.min(F.struct("error.ordinal", "page_index", "error.stage", "error.type", "error.message")).alias("e")
    errors = rows.where("error IS NOT NULL").groupBy("doc_id").agg(first).select("doc_id", "e.page_index", "e.stage", "e.type", "e.message")
    good = rows.join(errors.select("doc_id"), "doc_id", "left_anti").drop("error")
    return Attempt(extract(good), errors)


def evaluate(pages: DataFrame, tried: Attempt, config: ev.Config = ev.Config(), source: DataFrame | None = None) -> DataFrame:
    """As evaluation.evaluate() of what was extracted, but documents with an error have it as their only warning, and score 0."""
    said = tried.errors.select("doc_id", F.array(F.concat_ws(": ", F.lit("extractor failed"), "type", "message")).alias("_said"))
    rows = ev.evaluate(pages, tried.problems, config, source).join(said, "doc_id", "left")
    failed = F.col("_said").isNotNull()
    return rows.withColumns({c: F.when(failed, 0.0).otherwise(F.col(c)) for c in ("score", *ev.METRICS)} | {"warnings": F.when(failed, F.col("_said")).otherwise(F.col("warnings"))}).drop("_said")


def is_bare(element: Column) -> Column:
    return F.coalesce(F.size(element["bbox"]), F.lit(0)) <= 0


def needs_boxes(elements: Column) -> Column:
    """A message for the first element of a page that has no points."""
    bare = F.filter(F.transform(elements, lambda e, i: F.when(is_bare(e), i)), lambda i: i.isNotNull())
    return F.when(F.size(bare) > 0, F.concat(F.lit("element "), F.get(bare, F.lit(0)).cast("string"), F.lit(" has no box")))


def book_a_columns(elements: Column) -> Column:
    """The first book parts a page with an annotation into columns, for which each of its elements needs a box."""
    return F.when(F.exists(elements, lambda e: F.coalesce(e["content"].contains(BOOK_A_ANNOTATION), F.lit(False))), needs_boxes(elements))


def book_a_headers(elements: Column) -> Column:
    """In the first book every header needs a box, as notes beside it are its own. Only elements without one are tried as headers."""
    grammar = book_a_grammar()

    def is_head(e: Column) -> Column:
        line = book_a_clean(e["content"])
        return F.coalesce(grammar.question.matches(line) & ~grammar.noise(line), F.lit(False))

    return F.when(F.exists(elements, lambda e: is_bare(e) & is_head(e)), "a header has no box")


#: The stages that the first book's pages must pass before extraction.
BOOK_A_STAGES = (check("columns", book_a_columns), check("headers", book_a_headers))
