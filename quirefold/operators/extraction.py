"""Problems out of lines: a line-by-line state machine as running windows and one grouping, on one shuffle by document."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions.patterns import Pattern, PatternError, RegexPatterns, parse_patterns, translate
from quirefold.functions.text import bind, is_decimals, is_digits, raw_text, strip, strip_each
from quirefold.operators.transforms import column_of
from quirefold.sources.schemas import OPTION
from quirefold.sources.scratch import written

#: The first book's patterns, its watermark, its noise lines and what marks an annotation.
BOOK_A = {
    "question": r"^(?P<number>\d+)\.\s*[（(](?P<year>\d{4})年?\s*(?P<region>.*?)(?:\s+(?P<accuracy>\d+[%％]))?[）)]$",
    "option": r"^(?P<label>[A-D])\.\s*(?P<text>.*)$",
    "answer": r"^【参考答案】\s*(?P<answer>[A-D]+)",
    "type": r"^【题型分类】\s*(?P<question_type>.*)$",
    "analysis": r"^【实战解析】\s*(?P<analysis>.*)$",
}
BOOK_A_WATERMARK = r"公考最新资料、更新进度微信[A-Za-z0-9]+"
BOOK_A_NOISE = ("四海公考", "SIHAIGONGKAO", "逻辑判断600", "花生十三", "练习题01", "题目整体评价", "平均正确率", "平均错题数", "测试结果", "时间", "正确数", "错误数")
BOOK_A_ANNOTATION = "花生批注"
#: The second book's patterns and noise lines.
BOOK_B = {
    "question": r"^例题(?P<number>\d+)[（(][^）)]*[）)]\s*(?P<question>.*)$",
    "option": r"(?P<label>[A-D])[.．]\s*(?P<text>.*?)(?=\s+[A-D][.．]|$)",
}
BOOK_B_NOISE = ("题源：25 花生十三言语系统班700 词讲义", "自测用，禁止商用", "25 花生言语系统班700词例题·题本", "题本整理：Yummy", "流水不争先，争的是滔滔不绝~")


@dataclass(frozen=True)
class Grammar:
    """What lines mean. A line is tried as question, option, answer, and then the other sections; any other line goes on with the section it is in, if that is in goes_on."""

    question: Pattern
    options: Pattern
    noise: Callable[[Column], Column]
    answer: Pattern | None = None
    sections: tuple[tuple[str, Pattern], ...] = ()
    goes_on: frozenset[str] = field(default_factory=lambda: frozenset({"question", "option"}))
    clean: Callable[[Column], Column] = strip
    strip_parts: bool = True
    one_option: bool = False
    follows: Callable[[Column], Column] | None = None  # instead of goes_on, where that is a column

    def goes_on_with(self, kind: Column) -> Column:
        return self.follows(kind) if self.follows else kind.isin(*sorted(self.goes_on))


def general_grammar(patterns: RegexPatterns) -> Grammar:
    def noise(line: Column) -> Column:
        out = is_digits(line) | line.isin(*patterns.noise_lines) if patterns.noise_lines else is_digits(line)
        for prefix in patterns.noise_prefixes:
            out = out | line.startswith(prefix)
        return out

    return Grammar(
        translate(patterns.question), translate(patterns.options), noise, translate(patterns.answer) if patterns.answer else None,
        goes_on=frozenset({"question", "option"} if patterns.multiline_options else {"question"}),
    )


def book_a_clean(c: Column) -> Column:
    return strip(F.regexp_replace(c, BOOK_A_WATERMARK, ""))


def book_a_noise(line: Column) -> Column:
    return line.isin(*BOOK_A_NOISE) | is_decimals(line)


def book_a_grammar() -> Grammar:
    return Grammar(
        translate(BOOK_A["question"]), translate(BOOK_A["option"]), book_a_noise, translate(BOOK_A["answer"]),
        (("type", translate(BOOK_A["type"])), ("analysis", translate(BOOK_A["analysis"]))),
        frozenset({"question", "option", "analysis"}), book_a_clean, strip_parts=False, one_option=True,
    )


def book_b_grammar() -> Grammar:
    return Grammar(translate(BOOK_B["question"]), translate(BOOK_B["option"]), lambda c: c.isin(*BOOK_B_NOISE) | is_digits(c), goes_on=frozenset({"question"}), strip_parts=False)


def lines_of(pages: DataFrame) -> DataFrame:
    """(doc_id, page_index, element_index, element, last_page): a row per element, and one for a page without, so that no page is lost."""
    elements = F.arrays_zip(F.col("elements").alias("element"), F.col("sides").alias("annotation")) if "sides" in pages.columns else F.transform("elements", lambda e: F.struct(e.alias("element")))
    rows = pages.select("doc_id", "page_index", F.posexplode_outer(elements).alias("element_index", "z")).select("doc_id", "page_index", "element_index", "z.*")
    return rows.withColumn("last_page", F.max("page_index").over(Window.partitionBy("doc_id")))


def clean_each(contents: Column, grammar: Grammar) -> Column:
    """An array of texts, each as the grammar cleans it; one look at all of them tells whether any needs it, where that is known."""
    if grammar.clean is strip:
        return strip_each(contents)
    if grammar.clean is book_a_clean:
        marked = F.array_join(contents, "\n").contains(BOOK_A_WATERMARK.partition("[")[0])
        return F.when(marked, F.transform(contents, book_a_clean)).otherwise(strip_each(contents))
    return F.transform(contents, grammar.clean)


def told_lines(elements: Column, grammar: Grammar) -> Column:
    """The lines of a page's elements that are no noise, as structs (element_index, line, head)."""
    cleaned = F.transform(clean_each(elements["content"], grammar), lambda c, i: F.struct(i.alias("element_index"), c.alias("line")))
    told = F.filter(cleaned, lambda x: x["line"].isNotNull() & (x["line"] != "") & ~grammar.noise(x["line"]))
    return F.transform(told, lambda x: F.struct(x["element_index"], x["line"], grammar.question.matches(x["line"]).alias("head")))


def segments(pages: DataFrame, *carried: str) -> DataFrame:
    """(doc_id, page_index, nth, lines, head, problem_seq, last_page, ...) for pages with a column of told_lines(): each page is cut at its headers.

    A page without lines gives a segment without any, so that no page is lost. Lines before a document's first header have the problem_seq 0. Whole
    segments are sorted by document, which are far fewer than lines.
    """
    starts = F.transform("told", lambda x, i: F.when(x["head"] | (i == 0), i))
    return _cut(pages, starts, F.get("lines", F.lit(0))["head"], *carried)


def text_segments(pages: DataFrame, grammar: Grammar) -> DataFrame:
    """segments() of pages whose lines are strings alone, which is all that extract() asks for: a line's text is neither wrapped nor copied before pages are cut. A grammar may be in columns of pages."""
    told = F.filter(clean_each(F.col("elements")["content"], grammar), lambda line: line.isNotNull() & (line != "") & ~grammar.noise(line))
    rows = pages.withColumn("told", told)
    starts = F.transform("told", lambda line, i: F.when((i == 0) | grammar.question.matches(line), i))
    rows = rows.select("doc_id", "page_index", "told", starts.alias("starts"), grammar.question.matches(F.get("told", F.lit(0))).alias("opens"))
    return _cut(rows, F.col("starts"), (F.col("nth") > 0) | F.col("opens"), "opens").drop("opens")


def _cut(pages: DataFrame, starts: Column, head: Column, *carried: str) -> DataFrame:
    """pages cut where starts, an array beside told, isn't null; head tells of a segment (nth, lines) whether its first line is a header."""
    parts = bind(F.filter(starts, lambda i: i.isNotNull()), lambda at: F.transform(at, lambda s, j: F.slice("told", s + 1, F.coalesce(F.get(at, j + 1), F.size("told")) - s)))
    rows = pages.select("doc_id", "page_index", *carried, F.posexplode_outer(parts).alias("nth", "lines"))
    order = Window.partitionBy("doc_id").orderBy("page_index", "nth")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("head", F.coalesce(head, F.lit(False))).withColumns({
        "problem_seq": F.coalesce(F.sum(F.col("head").cast("int")).over(running), F.lit(0)),
        "last_page": F.max("page_index").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    })


def extract(pages: DataFrame, grammar: Grammar) -> DataFrame:
    """Problems (doc_id, problem_seq, number, question, answer, options, analysis, header_page, completed_page) of pages.

    An option given again takes the later text and stays in its first place. completed_page is that of the next
    header, or the document's last. Documents without a header give no rows. A document's segments come together once, in order.
    """
    return problems_of_blocks(blocks(text_segments(pages, grammar)), grammar)


def extract_each(pages: DataFrame, grammars: dict[str, Grammar]) -> dict[str, DataFrame]:
    """extract() by each grammar, written. Grammars with the same headers, noise and cleaning cut pages alike, so they share their blocks; of those, grammars that differ in what goes on alone also share the work on lines, and one table."""
    alike = lambda g: (g.question, g.noise, g.clean)
    same_lines = lambda g: replace(g, goes_on=frozenset(), follows=None)
    uses = Counter(map(alike, grammars.values()))
    made, shared = {}, {}
    for name, g in grammars.items():
        if name in made:
            continue
        if uses[alike(g)] > 1 and alike(g) not in shared:
            shared[alike(g)] = written(blocks(text_segments(pages, g)))
        found = shared[alike(g)] if alike(g) in shared else blocks(text_segments(pages, g))
        together = [n for n, other in grammars.items() if same_lines(other) == same_lines(g)]
        table = written(_problems_each(found, [grammars[n] for n in together]))
        made |= {n: table.select("doc_id", "problem_seq", f"p{i}.*", "header_page", "completed_page") for i, n in enumerate(together)}
    return {name: made[name] for name in grammars}


def blocks(parts: DataFrame) -> DataFrame:
    """(doc_id, problem_seq, lines, header_page, completed_page) of segments() or text_segments(): a header's line and the lines up to the next, as an array of strings."""
    texts = F.col("lines") if parts.schema["lines"].dataType.simpleString() == "array<string>" else F.col("lines")["line"]
    listed = F.sort_array(F.collect_list(F.struct("page_index", "nth", texts.alias("lines"))))
    whole = parts.where("problem_seq > 0 AND lines IS NOT NULL").groupBy("doc_id", "problem_seq").agg(listed.alias("parts"), F.max("last_page").alias("last_page"))
    whole = whole.select("doc_id", "problem_seq", F.flatten(F.col("parts")["lines"]).alias("lines"), F.col("parts")[0]["page_index"].alias("header_page"), "last_page")
    seq = Window.partitionBy("doc_id").orderBy("problem_seq")
    return whole.withColumn("completed_page", F.coalesce(F.lead("header_page").over(seq), "last_page")).drop("last_page")


def problems_of_blocks(found: DataFrame, grammar: Grammar) -> DataFrame:
    """The problems of blocks(), each from its own lines.

    A line that opens an option, an answer or another section begins a run, which the lines up to the next such line go on with, if the grammar lets them.
    """
    return _problems_each(found, [grammar]).select("doc_id", "problem_seq", "p0.*", "header_page", "completed_page")


def _problems_each(found: DataFrame, grammars: list[Grammar]) -> DataFrame:
    """(doc_id, problem_seq, p0, p1, ..., header_page, completed_page): problems_of_blocks() by each of some grammars that differ in goes_on and follows alone, as structs; lines are told apart once."""
    grammar = grammars[0]
    none = F.array().cast("array<string>")
    if grammar.one_option:
        every = lambda line, name: F.when(grammar.options.matches(line), F.array(grammar.options.first(line, name))).otherwise(none)
        option_text = lambda c: c
    else:
        every, option_text = grammar.options.each, strip
    tidy = strip if grammar.strip_parts else (lambda c: c)
    opening = {} if grammar.answer is None else {"answer": (grammar.answer, tidy)}
    opening |= {name: (pattern, lambda c: c) for name, pattern in grammar.sections}

    def kind_of(line: Column, labels: Column) -> Column:
        kind = F.when(F.size(labels) > 0, "option")
        for name, (pattern, _) in opening.items():
            kind = kind.when(pattern.matches(line), name)
        return kind

    # A line's labels, texts and kind are arrays beside its problem's lines after the header, and each is a column that is read more than once, so none is worked out again for each line.
    rows = found.select("*", F.col("lines")[0].alias("head"), F.slice("lines", 2, F.size("lines")).alias("rest"))
    rows = rows.select("*", F.transform("rest", lambda line: every(line, "label")).alias("labels"))
    rows = rows.select("*", F.zip_with("rest", "labels", lambda line, labels: F.when(F.size(labels) > 0, every(line, "text"))).alias("texts"), F.zip_with("rest", "labels", kind_of).alias("kinds"))
    rows = rows.select("*", F.filter(F.transform("kinds", lambda k, i: F.when(k.isNotNull(), i)), lambda i: i.isNotNull()).alias("at"))

    def tail(g: Grammar, kind: str, begin: Column, stop: Column) -> Column:
        """The lines of a run of that kind after its first, which are those from begin on and before stop, if they go on with it."""
        return F.when(g.goes_on_with(F.lit(kind)), F.array_join(F.slice("rest", begin + 1, F.coalesce(stop, F.size("rest")) - begin), "")).otherwise("")

    def latest(g: Grammar, kind: str) -> Column:
        pattern, tidied = opening[kind]
        last = F.array_max(F.filter("at", lambda i: F.get("kinds", i) == kind))
        text = tidied(pattern.first(F.get("rest", last), kind)) if pattern.group(kind) is not None else F.lit("")
        following = F.array_min(F.filter("at", lambda i: i > last))
        return F.when(last.isNotNull(), F.concat(text, tail(g, kind, last + 1, following))).otherwise("")

    def options_at(g: Grammar, i: Column, j: Column) -> Column:
        labels = F.get("labels", i)
        text = lambda k: F.when(k == F.size(labels) - 1, F.concat(option_text(F.get(F.get("texts", i), k)), tail(g, "option", i + 1, F.get("at", j + 1)))).otherwise(option_text(F.get(F.get("texts", i), k)))
        return F.transform(labels, lambda label, k: F.struct(label.alias("label"), text(k).alias("text")))

    def given(g: Grammar) -> Column:
        return F.flatten(F.filter(F.transform("at", lambda i, j: F.when(F.get("kinds", i) == "option", options_at(g, i, j))), lambda o: o.isNotNull()))

    def question(g: Grammar) -> Column:
        return F.concat(strip(first) if g.strip_parts else first, tail(g, "question", F.lit(0), F.get("at", F.lit(0))))

    first = grammar.question.first(F.col("head"), "question")
    rows = rows.select(
        "doc_id", "problem_seq", grammar.question.first(F.col("head"), "number").alias("number"), *[question(g).alias(f"question{i}") for i, g in enumerate(grammars)],
        *[(latest(g, kind) if kind in opening else F.lit("")).alias(f"{kind}{i}") for i, g in enumerate(grammars) for kind in ("answer", "analysis")], *[given(g).alias(f"given{i}") for i, g in enumerate(grammars)], "header_page", "completed_page",
    )

    def options(given: str) -> Column:
        labels = F.col(given)["label"]
        again = F.transform(F.array_distinct(labels), lambda k: F.struct(k.alias("label"), F.element_at(F.filter(given, lambda o: o["label"] == k), -1)["text"].alias("text")))
        return F.when(F.size(F.array_distinct(labels)) == F.size(given), F.col(given)).otherwise(again).cast(f"array<{OPTION}>")

    fields = lambda i: F.struct("number", F.col(f"question{i}").alias("question"), F.col(f"answer{i}").alias("answer"), options(f"given{i}").alias("options"), F.col(f"analysis{i}").alias("analysis"))
    return rows.select("doc_id", "problem_seq", *[fields(i).alias(f"p{i}") for i in range(len(grammars))], "header_page", "completed_page")


def top_y(e: Column) -> Column:
    return F.array_min(F.transform(e["bbox"], lambda p: p["y"]))


def annotation_sides(elements: Column) -> Column:
    """For each element of a page whether it stands in the page's annotation column, as an array.

    Only pages with an annotation marker have one: of the two columns by x the one with more markers, the left one if as many.
    """
    marked = F.transform(elements, lambda e: F.coalesce(e["content"].contains(BOOK_A_ANNOTATION), F.lit(False)))
    first_x = F.transform(elements, lambda e: F.coalesce(F.get(e["bbox"], F.lit(0))["x"], F.lit(float("nan"))))

    def flags(sides: Column) -> Column:
        on = lambda k: F.size(F.filter(F.zip_with(sides, marked, lambda s, m: (s == k) & m), lambda x: x))
        return bind(F.when(on(0) >= on(1), 0).otherwise(1), lambda column: F.transform(sides, lambda s: s == column))

    return F.when(F.exists(marked, lambda m: m), bind(bind(first_x, column_of), flags)).otherwise(F.transform(elements, lambda e: F.lit(False)))


def annotations(lines: DataFrame) -> DataFrame:
    """(doc_id, page_index, note, start_y, text) of the annotation columns' lines: by top y, each marker line begins a note and the lines after it go on with it; lines before the first are dropped."""
    rows = lines.withColumn("line", book_a_clean(F.col("element")["content"]))
    rows = rows.where((F.col("line") != "") & ~book_a_noise(F.col("line"))).select("doc_id", "page_index", "element_index", "line", top_y(F.col("element")).alias("y"))
    order = Window.partitionBy("doc_id", "page_index").orderBy("y", "element_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("note", F.sum(F.col("line").contains(BOOK_A_ANNOTATION).cast("int")).over(order)).where("note > 0")
    pieces = F.sort_array(F.collect_list(F.struct("y", "element_index", "line")))
    return rows.groupBy("doc_id", "page_index", "note").agg(pieces.alias("p")).select("doc_id", "page_index", "note", F.col("p")[0]["y"].alias("start_y"), F.array_join(F.transform("p", lambda x: x["line"]), "").alias("text"))


def first_range_join(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, start: str, stop: str, rank: str) -> DataFrame:
    """Each point with the first range, by rank, of its keys such that start <= at < stop; points in no range are dropped.

    For keys with few ranges, as a page has: every range of a key is tried for each place (operators/intervals.py has no such bound). Places are looked up once however
    many points share them, and only the least rank so far is held of the ranges that a place is in, so pairs are never written. Points that are equal in all columns stay apart. Of ranges of the same keys and rank, their other columns are of any.
    """
    mine = ranges.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(start).alias("_start"), F.col(stop).alias("_stop"), F.col(rank).alias("_rank"))
    places = points.select(*[F.col(k).alias(f"_p_{k}") for k in keys], F.col(at).alias("_at")).distinct()
    inside = [places[f"_p_{k}"] == mine[f"_{k}"] for k in keys] + [places["_at"] >= mine["_start"], places["_at"] < mine["_stop"]]
    first = places.join(mine, inside).groupBy(*places.columns).agg(F.min("_rank").alias(rank))
    found = points.join(first, [points[k] == first[f"_p_{k}"] for k in keys] + [points[at] == first["_at"]]).select(points["*"], first[rank])
    extra = [c for c in ranges.columns if c not in (*keys, start, stop, rank, *points.columns)]
    return found.join(ranges.select(*keys, rank, *extra).dropDuplicates([*keys, rank]), [*keys, rank]).select(*found.columns, *extra) if extra else found


def extract_book_a(pages: DataFrame) -> DataFrame:
    """Problems of the first book's layout: body lines by the grammar, and notes of the annotation column added to the problem beside which they begin."""
    grammar = book_a_grammar()
    sided = pages.select("doc_id", "page_index", "elements", annotation_sides(F.col("elements")).alias("sides"))
    zipped = F.transform(F.arrays_zip(F.col("elements").alias("element"), F.col("sides").alias("annotation")), lambda z, i: F.struct(i.alias("element_index"), z["element"].alias("element"), z["annotation"].alias("annotation")))
    sided = sided.select("doc_id", "page_index", zipped.alias("z"))
    side = lambda on: F.filter("z", lambda x: x["annotation"] if on else ~x["annotation"])
    body = sided.select("doc_id", "page_index", F.transform(side(False), lambda x: x["element"]).alias("body"), F.transform(side(True), lambda x: F.struct(x["element_index"], x["element"])).alias("notes"))
    body = body.select("doc_id", "page_index", "body", "notes", told_lines(F.col("body"), grammar).alias("told"))
    told = F.transform("told", lambda x: x.withField("y", F.when(x["head"], top_y(F.get("body", x["element_index"])))))
    parts = segments(body.select("doc_id", "page_index", "notes", told.alias("told")), "notes")
    parts = written(parts.withColumn("notes", F.when(F.col("nth").isNull() | (F.col("nth") == 0), F.col("notes"))))  # read for the problems, their headers and the notes
    problems = problems_of_blocks(blocks(parts), grammar)
    heads = parts.where("head").select("doc_id", "page_index", F.col("lines")[0]["y"].alias("start"), "problem_seq")
    notes = annotations(parts.select("doc_id", "page_index", F.inline("notes")))
    page = Window.partitionBy("doc_id", "page_index").orderBy("problem_seq")
    here = heads.withColumn("stop", F.coalesce(F.lead("start").over(page), F.lit(float("inf"))))
    noted = notes.select("doc_id", "page_index").distinct()
    per_page = heads.groupBy("doc_id", "page_index").agg(F.min("problem_seq").alias("first"), F.min_by("start", "problem_seq").alias("y"))
    last_before = Window.partitionBy("doc_id").orderBy("page_index").rowsBetween(Window.unboundedPreceding, -1)
    carried = noted.select("doc_id", "page_index").join(per_page, ["doc_id", "page_index"], "full").join(heads.groupBy("doc_id", "page_index").agg(F.max("problem_seq").alias("latest")), ["doc_id", "page_index"], "left")
    carried = carried.withColumn("problem_seq", F.last("latest", ignorenulls=True).over(last_before)).where("problem_seq IS NOT NULL")
    carried = carried.select("doc_id", "page_index", F.lit(float("-inf")).alias("start"), "problem_seq", F.coalesce("y", F.lit(float("inf"))).alias("stop"))
    joined = first_range_join(notes, here.unionByName(carried), ["doc_id", "page_index"], "start_y", "start", "stop", "problem_seq")
    added = joined.groupBy("doc_id", "problem_seq").agg(F.array_sort(F.collect_list(F.struct("page_index", "note", "text"))).alias("n"))
    added = added.select("doc_id", "problem_seq", F.array_join(F.transform("n", lambda x: x["text"]), "").alias("added"))
    return problems.join(added, ["doc_id", "problem_seq"], "left").withColumn("analysis", F.concat("analysis", F.coalesce("added", F.lit("")))).drop("added")


def page_problems(pages: DataFrame, problems: DataFrame, page_offset: int = 0) -> DataFrame:
    """Every page (doc_id, page_index, problems), those without problems included, with the problems that were complete there."""
    if page_offset < 0:
        raise ValueError("page_offset must not be negative")
    listed = problems.groupBy("doc_id", F.col("completed_page").alias("page_index")).agg(F.array_sort(F.collect_list(F.struct("problem_seq", "number", "question", "answer", "options", "analysis"))).alias("problems"))
    rows = pages.select("doc_id", "page_index").join(listed, ["doc_id", "page_index"], "left")
    return rows.select("doc_id", (F.col("page_index") + page_offset).alias("page_index"), F.coalesce("problems", F.array().cast(listed.schema["problems"].dataType)).alias("problems"))


def page_texts(pages: DataFrame) -> DataFrame:
    return pages.select("doc_id", "page_index", raw_text(F.col("elements")).alias("text"))


SAMPLE_CHARS, ATTEMPTS = 30_000, 3


def infer_patterns(pages: DataFrame, start: int, stop: int, analyzer: Callable[[str, str | None], str], attempts: int = ATTEMPTS) -> RegexPatterns:
    """Patterns for one document's pages from an analyzer (sample, error of the last try) -> JSON, which is asked again with the error up to attempts times."""
    if start < 0 or stop <= start:
        raise ValueError("samples must be a range of page indexes that is not empty")
    texts = page_texts(pages.where(F.col("page_index") < stop)).orderBy("page_index").collect()  # stop pages
    if len(texts) < stop:
        raise ValueError(f"samples exceed the page count: {stop} > {len(texts)}")
    sample = "\n".join(r["text"] for r in texts[start:stop])[:SAMPLE_CHARS]
    if not sample.strip():
        raise ValueError("the sample is blank")
    error: str | None = None
    for _ in range(attempts):
        try:
            return parse_patterns(analyzer(sample, error))
        except PatternError as e:
            error = str(e)
    raise PatternError(f"no usable patterns after {attempts} attempts: {error}")


def extract_inferred(pages: DataFrame, start: int, stop: int, analyzer: Callable[[str, str | None], str]) -> DataFrame:
    return extract(pages, general_grammar(infer_patterns(pages, start, stop, analyzer)))
