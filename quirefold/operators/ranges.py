"""Page ranges: checks of named ranges, and where a book's questions begin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.functions.patterns import start_decision
from quirefold.functions.text import formatted_pages, raw_text, truncated

SCAN_PAGES, PAGE_CHARS, CONFIDENCE = 20, 2000, 0.70


def validate_ranges(ranges: DataFrame) -> DataFrame:
    """(doc_id, error) for ranges (doc_id, ordinal, name, start, stop, step, page_count); error is null if all is well.

    First that there are questions; then, in the order of ordinals, that a range has step 1 and isn't empty, and is within the pages; last that none overlaps another.
    """
    alone = F.when((F.col("step") != 1) | (F.col("start") >= F.col("stop")), F.concat("name", F.lit(" must be a non-empty range with step 1"))).when((F.col("start") < 0) | (F.col("stop") > F.col("page_count")), F.concat("name", F.lit(" is out of bounds")))
    rows = ranges.withColumn("bad", alone)
    first = rows.groupBy("doc_id").agg(F.max((F.col("name") == "questions").cast("int")).alias("has"), F.min(F.when(F.col("bad").isNotNull(), F.struct("ordinal", "bad")))["bad"].alias("bad"))
    b = rows.select("doc_id", *[F.col(c).alias(f"_{c}") for c in ("ordinal", "name", "start", "stop")])
    over = rows.join(b, "doc_id").where((F.col("ordinal") < F.col("_ordinal")) & (F.col("start") < F.col("_stop")) & (F.col("_start") < F.col("stop")))
    over = over.groupBy("doc_id").agg(F.min(F.struct("ordinal", "_ordinal", F.concat("name", F.lit(" overlaps "), "_name").alias("e")))["e"].alias("overlap"))
    error = F.when(F.col("has") == 0, "questions is required").otherwise(F.coalesce("bad", "overlap"))
    return first.join(over, "doc_id", "left").select("doc_id", error.alias("error"))


def scan_texts(pages: DataFrame, scan_pages: int = SCAN_PAGES, chars: int = PAGE_CHARS) -> DataFrame:
    """(doc_id, page_count, prompt): the first pages' texts, each cut to its first characters, as an analyzer gets them."""
    counts = pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("page_count"))
    first = pages.where(F.col("page_index") < scan_pages).select("doc_id", F.struct(F.col("page_index").alias("i"), truncated(raw_text(F.col("elements")), chars).alias("text")).alias("p"))
    return first.groupBy("doc_id").agg(formatted_pages(F.collect_list("p")).alias("prompt")).join(counts, "doc_id")


def resolve(decisions: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    """(doc_id, start, stop, error) from an analyzer's JSON decisions (doc_id, page_count, raw_json): from the page it names to the last."""
    rows = decisions.withColumn("d", start_decision(F.col("raw_json"), F.col("page_count")))
    error = F.coalesce(F.col("d.error"), F.when(F.col("d.confidence") < confidence, "low confidence"))
    return rows.select("doc_id", F.when(error.isNull(), F.col("d.start")).alias("start"), F.when(error.isNull(), F.col("page_count")).alias("stop"), error.alias("error"))


def question_pages(pages: DataFrame, resolved: DataFrame) -> DataFrame:
    """The pages of each document within its range."""
    return pages.join(resolved.where("error IS NULL").select("doc_id", "start", "stop"), "doc_id").where("page_index >= start AND page_index < stop").drop("start", "stop")


def ask(prompt: str, page_count: int, analyzer: Callable[[str, str | None], str], check: Callable[[str, int], str | None], attempts: int = 3) -> str:
    """An analyzer's answer that check finds no fault with; it is asked again with the fault, up to attempts times. What the analyzer itself raises isn't tried again."""
    error: str | None = None
    for _ in range(attempts):
        answer = analyzer(prompt, error)
        error = check(answer, page_count)
        if error is None:
            return answer
    raise ValueError(f"no usable decision after {attempts} attempts: {error}")


def lookup_patterns(wanted: DataFrame, saved: DataFrame) -> DataFrame:
    """Patterns for wanted (path, source, start, stop): of saved (ord, path, source, start, stop, patterns), the latest of the same path, else the first of the same source and range."""
    by_path = saved.where("path IS NOT NULL").groupBy("path").agg(F.max_by("patterns", "ord").alias("by_path"))
    by_key = saved.groupBy("source", "start", "stop").agg(F.min_by("patterns", "ord").alias("by_key"))
    return wanted.join(by_path, "path", "left").join(by_key, ["source", "start", "stop"], "left").select(*wanted.columns, F.coalesce("by_path", "by_key").alias("patterns"))
