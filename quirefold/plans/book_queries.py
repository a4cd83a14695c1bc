"""Queries over books of orders, whose problems follow from the base tables."""

from __future__ import annotations

from dataclasses import replace
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirefold.operators import evaluation as ev
from quirefold.operators import extraction as ex
from quirefold.operators import failures as fl
from quirefold.operators import grammars as gr
from quirefold.operators import intervals as iv
from quirefold.operators import process as pr
from quirefold.operators import ranges as rg
from quirefold.sources import adapters as ad
from quirefold.sources.scratch import scratch_path, written
from quirefold.streaming.events import run_once
from quirefold.streaming import timed
from quirefold.streaming.problems import block_problems, stream_blocks, with_document_ends

GENERAL = ex.general_grammar(ad.BOOK_PATTERNS)
SINGLE = replace(GENERAL, goes_on=frozenset({"question"}))  # as without multiline_options


def options_text(options: Column) -> Column:
    return F.array_join(F.transform(options, lambda o: F.concat(o["label"], F.lit("="), o["text"])), "|")


def _shown(problems: DataFrame) -> DataFrame:
    return problems.select("doc_id", "problem_seq", "number", "question", "answer", F.size("options").alias("n_options"), options_text(F.col("options")).alias("options_text"), "header_page", "completed_page")


def extract_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(ex.extract(ad.book_pages(spark, sf_dir, boxes=False), GENERAL))


def extract_single_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(ex.extract(ad.book_pages(spark, sf_dir, boxes=False), SINGLE))


def extract_general_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ex.extract(ad.book_pages(spark, sf_dir, boxes=False), GENERAL)
    # An outer explode: for a plain one Spark filters by the size of options beneath it, where options are worked out once more for each time that they are named.
    rows = found.select("number", F.posexplode_outer("options").alias("i", "o")).where("i IS NOT NULL")
    return rows.select("number", "i", F.col("o.label").alias("label"), F.col("o.text").alias("text"))


def problem_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = written(ad.book_pages(spark, sf_dir, boxes=False))
    rows = ex.page_problems(pages, ex.extract(pages, GENERAL), 10)
    return rows.select("doc_id", "page_index", F.size("problems").alias("n"), F.array_join(F.transform("problems", lambda p: p["number"]), ",").alias("numbers"))


def extract_book_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ex.extract_book_a(ad.book_a_pages(spark, sf_dir))
    return found.select("number", "question", "answer", options_text(F.col("options")).alias("options_text"), "analysis")


def annotation_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's clicks as points, and a span about each of the user's events as ranges, numbered in the order of events."""
    events = ad.table(spark, sf_dir, "events").select("user_id", "event_id", F.col("value").alias("y"))
    w = Window.partitionBy("user_id").orderBy("event_id")
    spans = events.select("user_id", F.row_number().over(w).alias("n"), (F.col("y") - 1).alias("lo"), (F.col("y") + F.col("event_id") % 5).alias("hi"))
    points = events.where("event_type = 'click'")
    return iv.first_range(points, spans, ["user_id"], "y", "lo", "hi", "n").select("user_id", "event_id", "n")


def extract_book_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ex.extract(ad.book_b_pages(spark, sf_dir, boxes=False), ex.book_b_grammar())
    return found.select("number", "question", "answer", options_text(F.col("options")).alias("options_text"))


def chat_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's turn begins a segment."""
    rows = ad.chat_pages(spark, sf_dir).select("doc_id", F.posexplode("elements").alias("n", "e"))
    order = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("segment", F.sum((F.col("e.label") == "user").cast("int")).over(order)).where("segment > 0")
    return rows.groupBy("doc_id", "segment").agg(F.count("*").alias("n"), F.sum(F.length("e.content")).alias("chars"))


def carry_forward_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last line before each line of a document that ends in a full stop, by length."""
    rows = ad.doc_pages(spark, sf_dir).select("doc_id", "page_index", F.posexplode("elements").alias("nth", "e"))
    order = Window.partitionBy("doc_id").orderBy("page_index", "nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.when(F.col("e.content").endswith("the."), F.length("e.content"))
    return rows.select("doc_id", "page_index", "nth", F.last(mark, ignorenulls=True).over(order).alias("section"))


def _evaluated(spark: SparkSession, sf_dir: str, grammar: ex.Grammar = GENERAL) -> DataFrame:
    return _reports(spark, sf_dir, {"": grammar})[""]


def _reports(spark: SparkSession, sf_dir: str, grammars: dict[str, ex.Grammar]) -> dict[str, DataFrame]:
    """An evaluation for each grammar; pages and the problems are read more than once, so they are written, and so are the evaluations, which are made together."""
    pages = written(ad.book_pages(spark, sf_dir, boxes=False))
    found = ev.evaluate_each(pages, ex.extract_each(pages, grammars))
    found = written(found) if len(grammars) > 1 else found
    return {name: found.where(F.col("candidate") == name).drop("candidate") for name in grammars}


def metric(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    if name == "score":
        return _evaluated(spark, sf_dir).select("doc_id", F.round(name, 6).alias(name))
    pages = written(ad.book_pages(spark, sf_dir, boxes=False))
    problems = ex.extract(pages, GENERAL)
    return ev.evaluate_metric(name, pages, problems).select("doc_id", F.round(name, 6).alias(name))


def warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir).select("doc_id", F.array_join("warnings", "; ").alias("warnings"))


def _candidates(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return _reports(spark, sf_dir, {"book_b": ex.book_b_grammar(), "single": SINGLE, "general": GENERAL})


def rank_extractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.rank(_candidates(spark, sf_dir)).select("doc_id", "candidate", F.round("score", 6).alias("score"), "place")


def select_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.best(_candidates(spark, sf_dir)).select("doc_id", "candidate", F.round("score", 6).alias("score"))


def fallback_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _candidates(spark, sf_dir)
    found = ev.select_with_fallback({k: c[k] for k in ("book_b", "single")}, c["general"])
    return found.select("doc_id", "candidate", F.round("score", 6).alias("score"), "outcome")


def resolve_question_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of a stand-in for an analyzer, good and bad ones, by the document's number."""
    texts = rg.scan_texts(ad.doc_pages(spark, sf_dir))
    n = F.col("doc_id").cast("long") % 7
    raw = (
        F.when(n == 0, '{"start_page_index": 0, "confidence": 0.9}').when(n == 1, '{"start_page_index": 1, "confidence": 0.8}').when(n == 2, '{"start_page_index": true, "confidence": 0.8}')
        .when(n == 3, '{"start_page_index": 0, "confidence": 0.5}').when(n == 4, "[1]").when(n == 5, '{"start_page_index": 0, "confidence": 2}').otherwise('{"start_page_index": 0, "confidence": "1"}')
    )
    found = rg.resolve(texts.withColumn("raw_json", raw))
    return found.join(texts.select("doc_id", F.length("prompt").alias("prompt_chars")), "doc_id")


def validate_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as named ranges: every four orders of a customer in a row are those of a document."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    rows = ad.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", place.alias("place"))
    rows = rows.select(F.concat_ws("-", "o_custkey", F.floor(F.col("place") / 4)).alias("doc_id"), "o_orderkey", (F.col("place") % 4 + 1).alias("ordinal"))
    names = F.array(*[F.lit(x) for x in ("contents", "questions", "answers", "front_matter")])
    rows = rows.select("doc_id", "ordinal", F.element_at(names, F.col("ordinal")).alias("name"), (F.col("ordinal") * 10 - F.col("o_orderkey") % 3 * 2).cast("int").alias("start"), (F.col("ordinal") * 10 + 9 - F.col("o_orderkey") % 23).cast("int").alias("stop"), F.lit(1).alias("step"), F.lit(48).alias("page_count"))
    return rg.validate_ranges(rows)


def pattern_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as saved patterns, suppliers as sources that look for theirs."""
    saved = ad.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ord"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("p"), F.col("c_custkey") % 50)).alias("path"), (F.col("c_nationkey") % 5).alias("source"), F.lit(0).alias("start"), (F.col("c_custkey") % 4).cast("int").alias("stop"), F.col("c_name").alias("patterns"))
    wanted = ad.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("p"), F.col("s_suppkey")).alias("path"), (F.col("s_nationkey") % 5).alias("source"), F.lit(0).alias("start"), (F.col("s_suppkey") % 4).cast("int").alias("stop"))
    return rg.lookup_patterns(wanted, saved).select("id", "patterns")


def streaming_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = with_document_ends(written(ad.book_pages(spark, sf_dir, boxes=False)))  # read for the pages and for the documents' ends
    at = scratch_path(spark, "stream")
    pages.write.parquet(f"{at}/in")
    stream = spark.readStream.schema(pages.schema).parquet(f"{at}/in")
    grammar = ex.general_grammar(ad.BOOK_PATTERNS)
    run_once(stream_blocks(stream, grammar), f"{at}/out", f"{at}/checkpoint")
    return _shown(block_problems(spark.read.parquet(f"{at}/out"), grammar))


def streaming_timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order books as a stream in three batches: all pages; the ends of a third of the books, and orders to cancel a tenth; a page ten days later, after which the other books have been silent for long."""
    pages = written(ad.book_pages(spark, sf_dir, boxes=False)).withColumns({"at": F.timestamp_seconds(F.lit(1_704_067_200)), "cancel": F.lit(False)})  # read for the pages, their ends and the clock
    later = F.timestamp_seconds(F.lit(1_704_067_260))
    n = F.col("doc_id").cast("long")
    books = pages.groupBy("doc_id").agg((F.max("page_index") + 1).alias("page_index"))
    ends = books.where((n % 3 == 0) & (n % 10 != 0)).withColumns({"at": later, "cancel": F.lit(False)})
    controls = books.where(n % 10 == 0).select("doc_id", later.alias("at"), F.lit(True).alias("cancel"))
    clock = pages.limit(1).withColumns({"doc_id": F.lit("clock"), "at": F.timestamp_seconds(F.lit(1_704_931_200)), "elements": F.slice("elements", 1, 0)})
    at = scratch_path(spark, "timed")
    for i, batch in enumerate((pages, ends.unionByName(controls, allowMissingColumns=True), clock)):
        pages.limit(0).unionByName(batch, allowMissingColumns=True).write.parquet(f"{at}/in/b={i}")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    timed.with_store(spark)
    try:
        for i in range(3):
            stream = spark.readStream.schema(pages.schema).parquet(f"{at}/in/b={{{','.join(map(str, range(i + 1)))}}}" if i else f"{at}/in/b=0")
            run_once(timed.timed_blocks(stream, GENERAL, "1 day", "0 seconds"), f"{at}/out", f"{at}/checkpoint")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.parquet(f"{at}/out").select("doc_id", "problem_seq", F.size("lines").alias("n_lines"), "completed_page", "outcome")


def _fifty(n: int) -> ex.RegexPatterns:
    """One of fifty configurations of the order book, which differ in how they are written; every third has no answers, and of the others every second takes options of one line."""
    b = ad.BOOK_PATTERNS
    question = b.question.replace("第", f"(?:第){{1,{n + 1}}}") if n % 4 else b.question.replace("^第", "^(?P<mark>第)")
    return ex.RegexPatterns(question, b.options.replace("A-G", "A-GZ" if n % 5 else "A-G"), None if n % 3 == 0 else b.answer, (*b.noise_lines, f"noise {n}"), b.noise_prefixes, n % 3 != 0 and n % 2 == 1)


def extract_own_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's book by patterns of its own, of fifty configurations that are data."""
    pages = ad.book_pages(spark, sf_dir, boxes=False)
    texts = F.array(*[F.lit(_fifty(n).to_json()) for n in range(50)])
    raw = ad.table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("doc_id")).distinct().withColumn("raw_json", F.get(texts, (F.col("doc_id").cast("long") % 50).cast("int")))
    return gr.extract(pages, gr.parsed(raw)).select("doc_id", "problem_seq", "number", "question", "answer", options_text(F.col("options")).alias("options_text"))


def _processed(spark: SparkSession, sf_dir: str, first: int, looked_at: int) -> pr.Processed:
    """Books whose questions begin at a page: some have a range of no pages or none of questions, two fixed extractors see the first pages, and a third of the books have patterns of their own, half of them faulty."""
    pages = written(ad.book_pages(spark, sf_dir, boxes=False))  # read for the ranges, the patterns, the checks and the documents' pages
    n = F.col("doc_id").cast("long")
    counts = written(pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("stop")))
    start = F.when(n % 7 == 0, F.col("stop")).when(F.col("stop") > first, first).otherwise(0)
    ranges = counts.select("doc_id", F.lit(1).alias("ordinal"), F.when(n % 11 == 0, "contents").otherwise("questions").alias("name"), start.alias("start"), "stop", F.lit(1).alias("step"))
    raw = F.when(n % 3 == 0, F.when(n % 2 == 0, ad.BOOK_PATTERNS.to_json()).otherwise("{}"))
    patterns = counts.select("doc_id", raw.alias("raw_json")).where("raw_json IS NOT NULL")
    fixed = {"book_b": lambda p: ex.extract(p, ex.book_b_grammar()), "single": lambda p: ex.extract(p, SINGLE)}
    return pr.process(pages, ranges, fixed, patterns, pr.Policy(looked_at, 0.9, 0.5))


def process_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages are looked at."""
    return _processed(spark, sf_dir, 0, 1_000_000).decisions.select("doc_id", "extractor", F.round("score", 6).alias("score"), "error")


def process_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pages are looked at, from the second on."""
    rows = _processed(spark, sf_dir, 1, 3).pages
    shown = F.transform("problems", lambda p: F.concat(p["number"], F.lit(":"), options_text(p["options"])))
    return rows.select("doc_id", "page_index", F.size("problems").alias("n"), F.array_join(shown, ";").alias("problems"))


def isolated_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first book's layout by customer: a fifth of the books lack a box on each page with a note, and an operator of Python fails on the header of every 97th order; each fails its own book alone."""
    pages = ad.book_a_pages(spark, sf_dir)
    first = F.get("elements", F.lit(0))
    noted = F.exists("elements", lambda e: e["content"].contains(ex.BOOK_A_ANNOTATION))
    bare = F.concat(F.array(first.withField("bbox", F.slice(first["bbox"], 1, 0))), F.slice("elements", 2, F.size("elements")))
    pages = pages.withColumn("elements", F.when(noted & (F.col("doc_id").cast("long") % 5 == 0), bare).otherwise(F.col("elements")))

    def fussy(elements: list[dict]) -> list[dict]:
        for e in elements:
            number, dot, _ = e["content"].partition(".（")
            if dot and int(number) % 97 == 0:
                raise LookupError("unlucky order")
        return elements

    pages = written(pages)
    tried = fl.attempt(pages, ex.extract_book_a, fl.tried("fussy", fussy), *fl.BOOK_A_STAGES)
    problems = tried.problems.repartition("doc_id").sortWithinPartitions("doc_id")  # so that a book's characters are counted together
    tried = fl.Attempt(written(problems), written(tried.errors))
    reports = fl.evaluate(pages, tried).select("doc_id", (F.col("score") > 0).alias("scored"), F.array_join(F.filter("warnings", lambda w: w.startswith("extractor failed")), "; ").alias("warning"))
    found = tried.problems.groupBy("doc_id").agg(F.count("*").alias("n"))
    return reports.join(found, "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


_ORDERS = "o AS (SELECT CAST(o_custkey AS VARCHAR) AS doc_id, o_orderkey AS k, o_orderpriority AS pr, o_orderstatus AS st FROM orders), c AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1)"
_ITEMS = "i AS (SELECT l_orderkey AS k, l_linenumber AS ln, l_partkey AS p, l_suppkey AS s, l_extendedprice AS x, count(*) AS m FROM lineitem JOIN o ON k = l_orderkey GROUP BY ALL)"


def _pages_cte(lines: str) -> str:
    return f"""b AS (SELECT o.*, coalesce(n, 0) AS n, {lines} AS lines FROM o LEFT JOIN c USING (k)),
s AS (SELECT *, sum(lines) OVER w - lines AS before, sum(lines) OVER (PARTITION BY doc_id) AS total, row_number() OVER w AS problem_seq FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
h AS (SELECT *, CAST(before // 20 AS INT) AS header_page, CAST((total - 1) // 20 AS INT) AS last_page FROM s)"""


def _general(follow: bool = True) -> str:
    text = "'part ' || p || repeat('from ' || s, CAST(m AS BIGINT))" if follow else "'part ' || p"
    return f"""{_ORDERS}, {_ITEMS}, {_pages_cte("5 + 2 * coalesce(n, 0)")},
t AS (SELECT k, ln, chr(CAST(64 + ln AS INT)) AS label, arg_max({text}, (p, s, x)) AS text FROM i GROUP BY k, ln),
ot AS (SELECT k, CAST(count(*) AS INT) AS n_options, string_agg(label || '=' || text, '|' ORDER BY ln) AS options_text, max(ln) AS top FROM t GROUP BY k),
g AS (SELECT doc_id, CAST(problem_seq AS INT) AS problem_seq, CAST(k AS VARCHAR) AS number, pr AS question, st AS answer, coalesce(n_options, 0) AS n_options, coalesce(options_text, '') AS options_text, coalesce(top, 0) AS top, header_page, CAST(coalesce(lead(header_page) OVER (PARTITION BY doc_id ORDER BY k), last_page) AS INT) AS completed_page, last_page FROM h LEFT JOIN ot USING (k))"""


_SHOWN = "SELECT doc_id, problem_seq, number, question, answer, n_options, options_text, header_page, completed_page FROM g"


def _scores(follow: bool = True) -> str:
    norm = r"unnest(string_split(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]', '', 'g'), ''))"
    return rf"""{_general(follow)},
src AS (SELECT doc_id, {norm.format("'第' || k || '题' || pr || '答案' || st || doc_id || 'endorders'")} AS ch FROM o
UNION ALL SELECT doc_id, {norm.format("chr(CAST(64 + ln AS INT)) || 'part' || p || 'from' || s")} FROM o JOIN (SELECT k, ln, p, s, unnest(range(CAST(m AS BIGINT))) FROM i) USING (k)),
mine AS (SELECT doc_id, {norm.format("number || question || answer || options_text")} AS ch FROM g),
sc AS (SELECT doc_id, ch, count(*) AS have FROM src WHERE ch <> '' GROUP BY ALL), mc AS (SELECT doc_id, ch, count(*) AS got FROM mine WHERE ch <> '' GROUP BY ALL),
cov AS (SELECT doc_id, sum(least(have, coalesce(got, 0)))::DOUBLE / sum(have) AS text_coverage FROM sc LEFT JOIN mc USING (doc_id, ch) GROUP BY doc_id),
met AS (SELECT doc_id, avg(least(length(regexp_replace(question, '[^\p{{L}}\p{{N}}]', '', 'g')) / 8.0::DOUBLE, 1)) AS question_completeness,
avg(CASE WHEN n_options = 0 THEN 0 ELSE (least(n_options / 2.0::DOUBLE, 1) * CASE WHEN n_options > 6 THEN 6.0::DOUBLE / n_options ELSE 1 END + CASE WHEN top = n_options THEN 1 ELSE 0.5 END + 1) / 3 END) AS option_completeness, 1.0::DOUBLE AS structural_consistency, 1.0::DOUBLE AS extraction_validity FROM g GROUP BY doc_id),
e AS (SELECT met.*, text_coverage, pow(greatest(question_completeness, 1e-6), 0.3) * pow(greatest(option_completeness, 1e-6), 0.3) * pow(greatest(text_coverage, 1e-6), 0.2) AS score FROM met JOIN cov USING (doc_id))"""


_RANKED = f"""WITH a AS (WITH {_scores(True)} SELECT doc_id, score FROM e), z AS (WITH {_scores(False)} SELECT doc_id, score FROM e),
u AS (SELECT doc_id, 'general' AS candidate, 2 AS ord, score FROM a UNION ALL SELECT doc_id, 'single', 1, score FROM z UNION ALL SELECT doc_id, 'book_b', 0, 0.0 FROM z),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS INT) AS place FROM u)"""

_BOOK_A_SQL = f"""WITH {_ORDERS}, {_ITEMS},
q AS (SELECT k, chr(CAST(65 + ln % 4 AS INT)) AS label, arg_max('part ' || p, (ln, p, s, x)) AS text, min((ln, p, s, x)) AS first FROM i GROUP BY k, ln % 4),
t AS (SELECT k, string_agg(label || '=' || text, '|' ORDER BY first) AS options_text FROM q GROUP BY k)
SELECT CAST(k AS VARCHAR) AS number, '' AS question, CASE WHEN st = 'O' THEN 'A' ELSE 'BC' END AS answer, coalesce(options_text, '') AS options_text, 'status ' || st || '花生批注' || k AS analysis FROM o LEFT JOIN t USING (k)"""

_BOOK_B_SQL = f"""WITH {_ORDERS}, {_ITEMS},
y AS (SELECT k, ln, p, s, x, 0 AS ord, chr(CAST(65 + ln % 4 AS INT)) AS label, 'part ' || p AS text FROM i UNION ALL SELECT k, ln, p, s, x, 1, 'D', 'supp ' || s FROM i),
q AS (SELECT k, label, arg_max(text, (ln, p, s, x, ord)) AS text, min((ln, p, s, x, ord)) AS first FROM y GROUP BY k, label),
t AS (SELECT k, string_agg(label || '=' || text, '|' ORDER BY first) AS options_text FROM q GROUP BY k)
SELECT CAST(k AS VARCHAR) AS number, pr || CASE WHEN options_text IS NULL THEN 'after' ELSE '' END AS question, '' AS answer, coalesce(options_text, '') AS options_text FROM o LEFT JOIN t USING (k)"""

_FAILURES_SQL = """WITH b AS (SELECT CAST(o_custkey AS VARCHAR) AS doc_id, count(*) AS m, CASE WHEN bool_or(o_orderkey % 97 = 0) THEN 'extractor failed: LookupError: unlucky order' WHEN o_custkey % 5 = 0 THEN 'extractor failed: ValueError: element 0 has no box' ELSE '' END AS warning FROM orders GROUP BY o_custkey)
SELECT doc_id, warning = '' AS scored, warning, CASE WHEN warning = '' THEN m ELSE 0 END AS n FROM b"""

_RANGES_SQL = """
WITH q AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place FROM orders),
r AS (SELECT o_custkey || '-' || place // 4 AS doc_id, o_orderkey, place % 4 + 1 AS ordinal FROM q),
n AS (SELECT doc_id, ordinal, ['contents', 'questions', 'answers', 'front_matter'][ordinal] AS name, ordinal * 10 - o_orderkey % 3 * 2 AS start, ordinal * 10 + 9 - o_orderkey % 23 AS stop FROM r),
b AS (SELECT *, CASE WHEN start >= stop THEN name || ' must be a non-empty range with step 1' WHEN start < 0 OR stop > 48 THEN name || ' is out of bounds' END AS bad FROM n),
f AS (SELECT doc_id, bool_or(name = 'questions') AS has, arg_min(bad, ordinal) FILTER (bad IS NOT NULL) AS bad FROM b GROUP BY doc_id),
v AS (SELECT x.doc_id, arg_min(x.name || ' overlaps ' || y.name, (x.ordinal, y.ordinal)) AS e FROM n x JOIN n y ON x.doc_id = y.doc_id AND x.ordinal < y.ordinal AND x.start < y.stop AND y.start < x.stop GROUP BY x.doc_id)
SELECT doc_id, CASE WHEN NOT has THEN 'questions is required' ELSE coalesce(bad, e) END AS error FROM f LEFT JOIN v USING (doc_id)
"""

_LINES = "l AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, pos - 1 AS pos, line, CAST((pos - 1) // 20 AS INT) AS page_index, CAST((pos - 1) % 20 AS INT) AS nth FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents))"

_RESOLVE_SQL = f"""
WITH {_LINES}, p AS (SELECT doc_id, page_index, substr(string_agg(line, chr(10) ORDER BY pos), 1, 2000) AS text FROM l GROUP BY ALL),
c AS (SELECT doc_id, CAST(count(*) AS INT) AS page_count, CAST(sum(length('<page index="' || page_index || '">' || chr(10) || text || chr(10) || '</page>')) FILTER (page_index < 20) + least(count(*), 20) - 1 AS INT) AS prompt_chars, CAST(doc_id AS BIGINT) % 7 AS n FROM p GROUP BY doc_id),
e AS (SELECT *, CASE n WHEN 0 THEN NULL WHEN 1 THEN CASE WHEN page_count < 2 THEN 'start_page_index out of range' END WHEN 2 THEN 'start_page_index must be an integer' WHEN 3 THEN 'low confidence' WHEN 4 THEN 'not an object' WHEN 5 THEN 'confidence out of range' ELSE 'confidence must be a number' END AS error FROM c)
SELECT doc_id, CASE WHEN error IS NULL THEN CAST(n AS INT) END AS start, CASE WHEN error IS NULL THEN page_count END AS stop, error, prompt_chars FROM e
"""

_LOOKUP_SQL = """
WITH s AS (SELECT c_custkey AS ord, CASE WHEN c_custkey % 3 = 0 THEN 'p' || (c_custkey % 50) END AS path, c_nationkey % 5 AS source, c_custkey % 4 AS stop, c_name AS patterns FROM customer),
a AS (SELECT path, arg_max(patterns, ord) AS p FROM s WHERE path IS NOT NULL GROUP BY path), b AS (SELECT source, stop, arg_min(patterns, ord) AS q FROM s GROUP BY ALL)
SELECT s_suppkey AS id, coalesce(p, q) AS patterns FROM supplier LEFT JOIN a ON path = 'p' || s_suppkey LEFT JOIN b ON source = s_nationkey % 5 AND stop = s_suppkey % 4
"""

QUERIES = {
    "extract_general": extract_general,
    "extract_single_line": extract_single_line,
    "extract_general_options": extract_general_options,
    "problem_pages": problem_pages,
    "extract_book_a": extract_book_a,
    "extract_book_b": extract_book_b,
    "annotation_interval_join": annotation_interval_join,
    "isolated_failures": isolated_failures,
    "chat_segments": chat_segments,
    "carry_forward_section": carry_forward_section,
    **{m: partial(metric, m) for m in ev.METRICS},
    "structural_score": partial(metric, "score"),
    "warnings": warnings,
    "rank_extractors": rank_extractors,
    "select_best": select_best,
    "fallback_select": fallback_select,
    "resolve_question_range": resolve_question_range,
    "validate_ranges": validate_ranges,
    "pattern_lookup": pattern_lookup,
    "streaming_problems": streaming_problems,
    "streaming_timed": streaming_timed,
    "extract_own_patterns": extract_own_patterns,
    "process_decisions": process_decisions,
    "process_pages": process_pages,
}

ORACLES = {
    "extract_general": f"WITH {_general()} {_SHOWN}",
    "extract_single_line": f"WITH {_general(False)} {_SHOWN}",
    "extract_general_options": f"WITH {_general()} SELECT CAST(k AS VARCHAR) AS number, CAST(row_number() OVER (PARTITION BY k ORDER BY ln) - 1 AS INT) AS i, label, text FROM t",
    "problem_pages": f"WITH {_general()}, p AS (SELECT doc_id, CAST(unnest(range(last_page + 1)) AS INT) AS page_index FROM (SELECT DISTINCT doc_id, last_page FROM g)) SELECT p.doc_id, p.page_index + 10 AS page_index, CAST(count(number) AS INT) AS n, coalesce(string_agg(number, ',' ORDER BY problem_seq), '') AS numbers FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.page_index = g.completed_page GROUP BY p.doc_id, p.page_index",
    "extract_book_a": _BOOK_A_SQL,
    "extract_book_b": _BOOK_B_SQL,
    "isolated_failures": _FAILURES_SQL,
    "annotation_interval_join": "WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, value - 1 AS lo, value + event_id % 5 AS hi FROM events) SELECT e.user_id, event_id, CAST(min(n) AS INT) AS n FROM events e JOIN s ON e.user_id = s.user_id AND value >= lo AND value < hi WHERE event_type = 'click' GROUP BY e.user_id, event_id",
    "chat_segments": "WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS doc_id, text, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS segment FROM conversations) SELECT doc_id, CAST(segment AS BIGINT) AS segment, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM t WHERE segment > 0 GROUP BY ALL",
    "carry_forward_section": f"WITH {_LINES} SELECT doc_id, page_index, nth, CAST(last_value(CASE WHEN line LIKE '%the.' THEN length(line) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS INT) AS section FROM l",
    **{m: f"WITH {_scores()} SELECT doc_id, round({m}, 6) AS {m} FROM e" for m in (*ev.METRICS,)},
    "structural_score": f"WITH {_scores()} SELECT doc_id, round(score, 6) AS score FROM e",
    "warnings": f"WITH {_scores()} SELECT doc_id, concat_ws('; ', CASE WHEN round(question_completeness, 9) < 0.6 THEN 'many questions appear incomplete' END, CASE WHEN round(option_completeness, 9) < 0.6 THEN 'many option sets appear incomplete' END, CASE WHEN round(text_coverage, 9) < 0.5 THEN 'extracted problems cover little OCR text' END) AS warnings FROM e",
    "rank_extractors": f"{_RANKED} SELECT doc_id, candidate, round(score, 6) AS score, place FROM k",
    "select_best": f"{_RANKED} SELECT doc_id, candidate, round(score, 6) AS score FROM k WHERE place = 1",
    "fallback_select": f"{_RANKED} SELECT z.doc_id, CASE WHEN z.score < 0.9 AND a.score > z.score THEN 'general' WHEN z.score > 0 THEN 'single' ELSE 'book_b' END AS candidate, round(CASE WHEN z.score < 0.9 AND a.score > z.score THEN a.score ELSE z.score END, 6) AS score, CASE WHEN CASE WHEN z.score < 0.9 AND a.score > z.score THEN a.score ELSE z.score END < 0.7 THEN 'low_confidence' ELSE 'selected' END AS outcome FROM z JOIN a USING (doc_id)",
    "resolve_question_range": _RESOLVE_SQL,
    "validate_ranges": _RANGES_SQL,
    "pattern_lookup": _LOOKUP_SQL,
    "streaming_problems": f"WITH {_general()} {_SHOWN}",
    "streaming_timed": f"WITH {_general()}, v AS (SELECT g.*, c.n, lead(problem_seq) OVER (PARTITION BY doc_id ORDER BY problem_seq) IS NULL AS last, CAST(doc_id AS BIGINT) AS d FROM g LEFT JOIN c ON c.k = CAST(g.number AS BIGINT)) SELECT doc_id, problem_seq, CAST(CASE WHEN last AND d % 10 = 0 THEN 0 ELSE 2 + 2 * coalesce(n, 0) END AS INT) AS n_lines, completed_page, CASE WHEN NOT last THEN 'next' WHEN d % 10 = 0 THEN 'cancelled' WHEN d % 3 = 0 THEN 'ended' ELSE 'silent' END AS outcome FROM v",
    "process_decisions": f"""WITH a AS (WITH {_scores(True)} SELECT doc_id, score FROM e), z AS (WITH {_scores(False)} SELECT doc_id, score FROM e),
k AS (SELECT doc_id, CAST(doc_id AS BIGINT) AS n, z.score AS s, a.score AS o FROM z JOIN a USING (doc_id)),
f AS (SELECT *, CASE WHEN n % 11 = 0 THEN 'questions is required' WHEN n % 7 = 0 THEN 'questions must be a non-empty range with step 1' END AS bad, CASE WHEN s >= 0.9 OR n % 6 = 0 THEN NULL WHEN n % 3 = 0 THEN 'fallback failed: question should be a string; options should be a string' ELSE 'fallback failed: no patterns' END AS failure, s < 0.9 AND n % 6 = 0 AND o > s AS better FROM k),
g AS (SELECT *, CASE WHEN better THEN o ELSE s END AS score FROM f)
SELECT doc_id, CASE WHEN bad IS NULL THEN CASE WHEN better THEN 'general' WHEN s > 0 THEN 'single' ELSE 'book_b' END END AS extractor, CASE WHEN bad IS NULL THEN round(score, 6) END AS score, coalesce(bad, failure, CASE WHEN score < 0.5 THEN 'confidence is low' END) AS error FROM g""",
    "extract_own_patterns": f"WITH a AS (WITH {_general()} SELECT * FROM g), z AS (WITH {_general(False)} SELECT * FROM g), c AS (SELECT *, CAST(doc_id AS BIGINT) % 50 AS v FROM a UNION ALL SELECT *, CAST(doc_id AS BIGINT) % 50 + 100 FROM z) SELECT doc_id, problem_seq, number, question || CASE WHEN v % 100 % 3 = 0 AND n_options = 0 THEN '答案：' || answer ELSE '' END AS question, CASE WHEN v % 100 % 3 = 0 THEN '' ELSE answer END AS answer, options_text FROM c WHERE (v < 100) = (v % 100 % 3 <> 0 AND v % 2 = 1)",
}
