"""Quality of an extraction without ground truth, ranking of candidates and fallback."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions.text import bind, has_text, is_decimals, is_digits, normal_counts, normalized, strip

METRICS = ("question_completeness", "option_completeness", "text_coverage", "structural_consistency", "extraction_validity")
FALLBACK, MINIMUM = 0.90, 0.70
#: Digits that means are rounded to before the warnings compare them with their bounds.
BOUND_DIGITS = 9


@dataclass(frozen=True)
class Config:
    """Weights by metric, and what a complete question and set of options are."""

    weights: dict[str, float] = field(default_factory=lambda: dict(zip(METRICS, (0.30, 0.30, 0.20, 0.15, 0.05), strict=True)))
    min_question_chars: int = 8
    min_options: int = 2
    max_options: int = 6

    def __post_init__(self) -> None:
        if set(self.weights) != set(METRICS):
            raise ValueError("weights must name every metric and no other")
        if any(w < 0 for w in self.weights.values()) or abs(sum(self.weights.values()) - 1) > 1e-9:
            raise ValueError("weights must not be negative and must sum to 1")
        if self.min_question_chars < 1 or not 1 <= self.min_options <= self.max_options:
            raise ValueError("bounds are out of order")


def _score(c: Column) -> Column:
    return c.cast("double")


def question_completeness(question: Column, config: Config = Config()) -> Column:
    """Of one problem."""
    full = F.least(F.length(normalized(question)) / F.lit(config.min_question_chars), F.lit(1.0))
    return full * F.when(question.rlike(r"(?iu)(?:^|(?U:\s))[A-Z][.．、:]"), 0.5).otherwise(1.0)


def option_completeness(options: Column, config: Config = Config()) -> Column:
    n = F.size(options)
    labels = F.transform(options, lambda o: F.upper(strip(o["label"])))
    due = F.transform(F.sequence(F.lit(65), F.lit(64) + n), lambda i: F.char(i))
    count = F.least(n / F.lit(config.min_options), F.lit(1.0)) * F.when(n > config.max_options, F.lit(float(config.max_options)) / n).otherwise(1.0)
    texts = F.size(F.filter(options, lambda o: has_text(o["text"]))) / n
    return F.when(n == 0, 0.0).otherwise((count + F.when(labels == due, 1.0).otherwise(0.5) + texts) / 3)


def validity(question: Column, options: Column) -> Column:
    return _score(has_text(question) | F.exists(options, lambda o: has_text(o["text"])))


def source_counts(pages: DataFrame) -> DataFrame:
    """(doc_id, c, have): how often each document of pages has a character, and a row of none for each document."""
    counted = normal_counts(pages, "doc_id", F.array_join(F.col("elements")["content"], ""))
    return counted.groupBy("doc_id", "c").agg(F.sum("n").alias("have"))


def coverage_each(pages: DataFrame, problems: list[DataFrame], source: DataFrame | None = None) -> DataFrame:
    """(doc_id, shares) of every document of pages: for each extraction in turn the share of the document's characters, as a multiset, that its problems hold; 0 without characters.

    source may hold the pages' source_counts(), which are the same for all extractions. All sides meet in one grouping.
    """
    zero, each = F.lit(0).cast("long"), range(len(problems))
    sides = (source_counts(pages) if source is None else source).select("doc_id", "c", "have", *[zero.alias(f"got{i}") for i in each])
    parts = F.concat(F.array("number", "question", "answer", "analysis"), F.col("options")["label"], F.col("options")["text"])
    for k, found in enumerate(problems):
        mine = normal_counts(found, "doc_id", F.array_join(parts, "")).where("n > 0")
        sides = sides.unionAll(mine.select("doc_id", "c", zero.alias("have"), *[(F.col("n") if i == k else zero).alias(f"got{i}") for i in each]))
    both = sides.groupBy("doc_id", "c").agg(F.sum("have").alias("have"), *[F.sum(f"got{i}").alias(f"got{i}") for i in each])
    share = lambda i: F.coalesce(F.sum(F.least("have", f"got{i}")) / F.nullif(F.sum("have"), F.lit(0)), F.lit(0.0))
    return both.groupBy("doc_id").agg(F.array(*[share(i) for i in each]).alias("shares"))


def text_coverage(pages: DataFrame, problems: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """(doc_id, text_coverage) of every document of pages, as coverage_each()."""
    return coverage_each(pages, [problems], source).select("doc_id", F.col("shares")[0].alias("text_coverage"))


def structural_consistency(numbers: Column) -> Column:
    """Mean of presence, uniqueness and ascent, of an array of normalised numbers in order. Arrays are bound, as each is named several times."""

    def ordering(numeric: Column) -> Column:
        pairs = F.zip_with(F.slice(numeric, 1, F.greatest(F.size(numeric) - 1, F.lit(0))), F.slice(numeric, 2, F.greatest(F.size(numeric) - 1, F.lit(0))), lambda a, b: b > a)
        rising = bind(pairs, lambda pairs: F.size(F.filter(pairs, lambda p: p)) / F.nullif(F.size(pairs), F.lit(0)))
        return F.when(F.size(numeric) == 0, 0.0).when(F.size(numeric) == 1, 1.0).otherwise(rising)

    def mean(filled: Column) -> Column:
        numeric = F.transform(F.filter(filled, is_decimals), lambda x: F.translate(x, "０１２３４５６７８９", "0123456789").try_cast("decimal(38,0)"))
        unique = F.coalesce(F.size(F.array_distinct(filled)) / F.nullif(F.size(filled), F.lit(0)), F.lit(0.0))
        return (F.size(filled) / F.nullif(F.size(numbers), F.lit(0)) + unique + bind(numeric, ordering)) / 3

    return bind(F.filter(numbers, lambda x: x != ""), mean)


def evaluate_metric(name: str, pages: DataFrame, problems: DataFrame, config: Config = Config()) -> DataFrame:
    """(doc_id, name) of every document of pages: one metric as evaluate() gives it, and nothing else computed; texts are only read for text_coverage."""
    raw = normalized(F.col("number"))
    measures = {
        "question_completeness": lambda: F.avg(question_completeness(F.col("question"), config)), "option_completeness": lambda: F.avg(option_completeness(F.col("options"), config)),
        "extraction_validity": lambda: F.avg(validity(F.col("question"), F.col("options"))), "text_coverage": lambda: F.lit(None).cast("double"),
        "structural_consistency": lambda: bind(F.transform(F.array_sort(F.collect_list(F.struct("problem_seq", raw.alias("n")))), lambda x: x["n"]), structural_consistency),
    }
    each = problems.groupBy("doc_id").agg(measures[name]().alias("m"), F.max(is_digits(raw) & ~is_decimals(raw)).alias("failed"))
    every = text_coverage(pages, problems).withColumnRenamed("text_coverage", "c") if name == "text_coverage" else pages.select("doc_id").distinct().withColumn("c", F.lit(0.0))
    fine = F.coalesce(~F.col("failed"), F.lit(False))
    return every.join(each, "doc_id", "left").select("doc_id", F.when(fine, F.coalesce("m", "c")).otherwise(0.0).alias(name))


def evaluate(pages: DataFrame, problems: DataFrame, config: Config = Config(), source: DataFrame | None = None) -> DataFrame:
    """One row for each document of pages: doc_id, score, the metrics and warnings. Documents without problems score 0.

    A number of digits that are no decimals can't be compared; such a document counts as failed.
    """
    return evaluate_each(pages, {"": problems}, config, source).drop("candidate")


def evaluate_each(pages: DataFrame, candidates: dict[str, DataFrame], config: Config = Config(), source: DataFrame | None = None) -> DataFrame:
    """evaluate() of each candidate's problems, with the candidate in a column: all are grouped together, and the documents' characters are read once."""
    if not candidates:
        raise ValueError("no extractors")
    found = reduce(DataFrame.unionByName, [p.select(F.lit(i).alias("_i"), "doc_id", "problem_seq", "number", "question", "options") for i, p in enumerate(candidates.values())])
    each = found.groupBy("doc_id", "_i").agg(
        F.avg(question_completeness(F.col("question"), config)).alias("question_completeness"), F.avg(option_completeness(F.col("options"), config)).alias("option_completeness"),
        F.avg(validity(F.col("question"), F.col("options"))).alias("extraction_validity"), F.array_sort(F.collect_list(F.struct("problem_seq", normalized(F.col("number")).alias("n"), F.col("number").alias("raw")))).alias("ns"),
    )
    raw = F.filter(F.transform("ns", lambda x: x["raw"]), lambda x: x != "")
    each = each.select(
        "*", bind(F.transform("ns", lambda x: x["n"]), structural_consistency).alias("structural_consistency"), (F.size(F.array_distinct(raw)) < F.size(raw)).alias("repeated"),
        F.exists("ns", lambda x: is_digits(x["n"]) & ~is_decimals(x["n"])).alias("failed"), F.lit(True).alias("some"),
    ).drop("ns")
    covered = coverage_each(pages, [*candidates.values()], source).select("doc_id", F.posexplode_outer("shares").alias("_i", "text_coverage"))
    rows = covered.join(each, ["doc_id", "_i"], "left").withColumn("candidate", F.get(F.array(*map(F.lit, candidates)), F.col("_i")))
    rows = rows.withColumns({"some": F.coalesce("some", F.lit(False)), "failed": F.coalesce("failed", F.lit(False))})
    fine = F.col("some") & ~F.col("failed")
    rows = rows.withColumns({m: F.when(fine, F.coalesce(m, F.lit(0.0))).otherwise(F.lit(0.0)) for m in METRICS})
    product = reduce(lambda a, b: a * b, [F.pow(F.greatest(F.col(m), F.lit(1e-6)), F.lit(config.weights[m])) for m in METRICS])
    # The bounds and texts of the warnings. Sums of doubles depend on their order, so means are rounded before they are compared: a mean that is the bound isn't below it.
    means = {m: F.round(m, BOUND_DIGITS) for m in METRICS}
    low = F.array(
        F.when(means["question_completeness"] < 0.6, "many questions appear incomplete"), F.when(means["option_completeness"] < 0.6, "many option sets appear incomplete"),
        F.when(means["text_coverage"] < 0.5, "extracted problems cover little OCR text"), F.when(F.col("repeated"), "duplicate problem numbers detected"),
    )
    failed, empty = (F.array(F.lit(x)) for x in ("extractor failed: a problem number is no decimal number", "extractor produced no problems"))
    warnings = F.when(F.col("failed"), failed).when(~F.col("some"), empty).otherwise(F.filter(low, lambda w: w.isNotNull()))
    return rows.select("candidate", "doc_id", F.when(fine, F.greatest(F.lit(0.0), F.least(F.lit(1.0), product))).otherwise(0.0).alias("score"), *METRICS, warnings.alias("warnings"))


def rank(candidates: dict[str, DataFrame]) -> DataFrame:
    """(doc_id, candidate, ordinal, score, place) of evaluations by candidate, in the order given; equal scores keep that order."""
    if not candidates:
        raise ValueError("no extractors")
    rows = None
    for i, (name, report) in enumerate(candidates.items()):
        own = report.select("doc_id", F.lit(name).alias("candidate"), F.lit(i).alias("ordinal"), "score")
        rows = own if rows is None else rows.unionByName(own)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "ordinal")))


def best(candidates: dict[str, DataFrame]) -> DataFrame:
    return rank(candidates).where("place = 1").drop("place")


def select_with_fallback(fixed: dict[str, DataFrame], general: DataFrame | None, fallback: float = FALLBACK, minimum: float = MINIMUM) -> DataFrame:
    """(doc_id, candidate, score, outcome): the best fixed candidate if good enough, else the better of it and the general one (the fixed one on a tie).

    outcome is `selected`, `low_confidence` below the minimum, or `fallback_unavailable`. Only documents below the threshold look at general.
    """
    top = best(fixed).select("doc_id", "candidate", "score")
    if general is None:
        outcome = F.when(F.col("score") < fallback, "fallback_unavailable").otherwise("selected")
        return top.withColumn("outcome", outcome)
    good, rest = top.where(F.col("score") >= fallback), top.where(F.col("score") < fallback)
    other = rest.join(general.select("doc_id", F.col("score").alias("other")), "doc_id", "left")
    better = F.coalesce(F.col("other") > F.col("score"), F.lit(False))
    other = other.select("doc_id", F.when(better, "general").otherwise(F.col("candidate")).alias("candidate"), F.when(better, F.col("other")).otherwise(F.col("score")).alias("score"))
    return good.unionByName(other).withColumn("outcome", F.when(F.col("score") < minimum, "low_confidence").otherwise("selected"))


def is_valid_report(score: Column, metrics: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, [c.between(0.0, 1.0) for c in [score, *metrics]])


