"""Whole documents from ranges to problems: a sample chooses each document's extractor, and each document takes its own way through one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.operators import evaluation as ev
from quirefold.operators import extraction as ex
from quirefold.operators import grammars as gr
from quirefold.operators.ranges import validate_ranges
from quirefold.sources.scratch import written

Extractor = Callable[[DataFrame], DataFrame]
Patterns = DataFrame | Callable[[DataFrame], DataFrame] | None
#: The name of the extractor whose patterns an analyzer gives.
GENERAL = "general"
#: Why a document has no problems.
UNAVAILABLE, NO_PATTERNS, LOW = "fallback is not available", "fallback failed: ", "confidence is low"


@dataclass(frozen=True)
class Policy:
    """How many pages are looked at, below which score other patterns are asked for, and below which a document is given up."""

    sample_pages: int = 3
    fallback: float = ev.FALLBACK
    minimum: float = ev.MINIMUM

    def __post_init__(self) -> None:
        if self.sample_pages < 1:
            raise ValueError("at least one page must be looked at")
        if not 0 <= self.minimum <= self.fallback <= 1:
            raise ValueError("0 <= minimum <= fallback <= 1 must hold")


@dataclass(frozen=True)
class Processed:
    """decisions: (doc_id, extractor, score, metrics, warnings, error), a row for each document of ranges or pages; pages: (doc_id, page_index, problems), a row for each page in the range of a document that has no error."""

    decisions: DataFrame
    pages: DataFrame


def in_range(pages: DataFrame, ranges: DataFrame, name: str = "questions") -> DataFrame:
    """The pages of each document's range of that name, with their position in it from 0."""
    wanted = ranges.where(F.col("name") == name).select(F.col("doc_id").alias("_doc"), "start", "stop")
    inside = (F.col("page_index") >= F.col("start")) & (F.col("page_index") < F.col("stop"))
    rows = pages.join(wanted, (pages["doc_id"] == wanted["_doc"]) & inside)
    return rows.select(*[pages[c] for c in pages.columns], (F.col("page_index") - F.col("start")).alias("position"))


def sampled(pages: DataFrame, first: int) -> DataFrame:
    """The first pages of each document's range, of pages (position, ...)."""
    return pages.where(F.col("position") < first).drop("position")


def choose(sample: DataFrame, fixed: dict[str, Extractor], patterns: Patterns = None, policy: Policy = Policy()) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, extractor, score, metrics, warnings, error) for each document of a sample of pages, and the grammars (doc_id, g) that were asked for.

    The best of the fixed extractors is taken if it scores well enough; else it competes with the document's own patterns, and stays on a tie. Only
    documents that need them are asked about and extracted by patterns; the source's characters are counted once for all extractions, and each extraction is
    written, as its problems are read for their metrics and again for their characters.
    """
    if not fixed:
        raise ValueError("at least one fixed extractor is required")
    sample = written(sample)
    source = written(ev.source_counts(sample))
    reports = written(_stacked({name: ev.evaluate(sample, written(extract(sample)), source=source) for name, extract in fixed.items()}))
    top = reports.groupBy("doc_id").agg(F.min_by(F.struct(*_REPORT), F.struct(-F.col("score"), "ordinal")).alias("r")).select("doc_id", "r.*")
    top = written(top)
    fine = F.col("score") >= policy.fallback
    if patterns is None:
        return _judged(top.withColumn("error", F.when(~fine, UNAVAILABLE)), policy), None
    weak = top.where(~fine)
    raw = patterns(sample.join(weak.select("doc_id"), "doc_id", "left_semi")) if callable(patterns) else patterns.join(weak.select("doc_id"), "doc_id", "left_semi")
    own = weak.select("doc_id").join(gr.parsed(raw), "doc_id", "left").select("doc_id", "g", F.when(F.col("g").isNull(), F.concat(F.lit(NO_PATTERNS), F.coalesce("error", F.lit("no patterns")))).alias("failure"))
    own = written(own)
    usable = own.where("failure IS NULL").select("doc_id", "g")
    looked_at, counted = (x.join(usable.select("doc_id"), "doc_id", "left_semi") for x in (sample, source))
    general = ev.evaluate(looked_at, written(gr.extract(looked_at, usable)), source=counted).select("doc_id", F.lit(GENERAL).alias("extractor"), *[c for c in _REPORT if c != "extractor"])
    general = general.select("doc_id", F.struct(*_REPORT).alias("other"))
    both = weak.select("doc_id", F.struct(*_REPORT).alias("r")).join(own, "doc_id").join(general, "doc_id", "left")
    better = F.coalesce(F.col("other.score") > F.col("r.score"), F.lit(False))
    chosen = both.select("doc_id", F.when(better, F.col("other")).otherwise(F.col("r")).alias("r"), F.col("failure").alias("error")).select("doc_id", "r.*", "error")
    return _judged(top.where(fine).withColumn("error", F.lit(None).cast("string")).unionByName(chosen), policy), usable


_REPORT = ("extractor", "score", *ev.METRICS, "warnings")


def _stacked(reports: dict[str, DataFrame]) -> DataFrame:
    each = [report.select("doc_id", F.lit(name).alias("extractor"), F.lit(i).alias("ordinal"), "score", *ev.METRICS, "warnings") for i, (name, report) in enumerate(reports.items())]
    return reduce(DataFrame.unionByName, each)


def _judged(rows: DataFrame, policy: Policy) -> DataFrame:
    error = F.coalesce("error", F.when(F.col("score") < policy.minimum, LOW))
    metrics = F.create_map(*[x for m in ev.METRICS for x in (F.lit(m), F.col(m))])
    return rows.select("doc_id", "extractor", "score", metrics.alias("metrics"), "warnings", error.alias("error"))


def process(pages: DataFrame, ranges: DataFrame, fixed: dict[str, Extractor], patterns: Patterns = None, policy: Policy = Policy()) -> Processed:
    """Problems of the question ranges of all documents.

    ranges (doc_id, ordinal, name, start, stop, step) are checked against each document's pages first. The first pages of a range choose its document's extractor (choose());
    patterns are a table of raw JSON by document (doc_id, raw_json), or make one of the samples of documents that no fixed extractor suits, as an analyzer does.
    Then every document is extracted once, by its extractor, over its whole range. Documents that fail in any step have an error and no pages, and trouble none of the others.
    """
    counts = pages.groupBy("doc_id").agg(F.max("page_index").alias("last")).select("doc_id", (F.col("last") + 1).alias("page_count"))
    every = counts.select("doc_id").union(ranges.select("doc_id")).distinct()
    known = ranges.join(counts, "doc_id", "left").withColumn("page_count", F.coalesce("page_count", F.lit(0)))
    checked = written(every.join(validate_ranges(known), "doc_id", "left").join(ranges.select("doc_id").distinct().withColumn("listed", F.lit(True)), "doc_id", "left").select("doc_id", F.when(F.col("listed").isNull(), "questions is required").otherwise(F.col("error")).alias("error")))
    good = checked.where("error IS NULL").select("doc_id")
    mine = written(in_range(pages, ranges.join(good, "doc_id", "left_semi")))
    sample = sampled(mine, policy.sample_pages)
    chosen, own = choose(sample, fixed, patterns, policy)
    chosen = written(chosen)
    whole = mine.drop("position").join(chosen.where("error IS NULL").select("doc_id", "extractor"), "doc_id")
    of = lambda name: whole.where(F.col("extractor") == name).drop("extractor")
    found = [ex.page_problems(of(name), extract(of(name))) for name, extract in fixed.items()]
    if own is not None:
        found.append(ex.page_problems(of(GENERAL), gr.extract(of(GENERAL), own)))
    faulty = checked.where("error IS NOT NULL")
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in chosen.schema if f.name not in ("doc_id", "error")]
    decisions = chosen.unionByName(faulty.select("doc_id", *none, "error"))
    return Processed(decisions, reduce(DataFrame.unionByName, found))
