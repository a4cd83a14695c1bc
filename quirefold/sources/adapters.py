"""Pages, job events and points made from relational tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirefold.functions.patterns import RegexPatterns
from quirefold.functions.text import split_lines
from quirefold.sources.schemas import ELEMENT

PAGE_LINES = 20
#: Where lines of the right column begin.
ASIDE = 500
BOOK_PATTERNS = RegexPatterns(
    question=r"^第(?P<number>\d+)题\s*(?P<question>.*)$",
    options=r"(?P<label>[A-G])[.．]\s*(?P<text>.*?)(?=\s+[A-G][.．]|$)",
    answer=r"^答案[:：]\s*(?P<answer>\w+)",
    noise_lines=("orders",),
    noise_prefixes=("--",),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))


def paged(lines: DataFrame, order: list[str]) -> DataFrame:
    """Pages of PAGE_LINES lines each from (doc_id, content) in the given order; lines are boxes of height 8, ten apart."""
    rows = lines.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1)
    rows = rows.withColumn("page_index", F.floor(F.col("n") / PAGE_LINES).cast("int")).withColumn("at", F.col("n") % PAGE_LINES)
    element = F.struct(box(F.lit(0), F.col("at") * 10, F.lit(100), F.col("at") * 10 + 8).alias("bbox"), F.lit("text").alias("label"), F.col("content"))
    listed = rows.groupBy("doc_id", "page_index").agg(F.array_sort(F.collect_list(F.struct("at", element.alias("e")))).alias("es"))
    return listed.select("doc_id", "page_index", F.transform("es", lambda e: e["e"]).cast(f"array<{ELEMENT}>").alias("elements"))


def book_pages_of(spark: SparkSession, sf_dir: str, header: Column, option: Callable[[Column], Column], answer: Column | None, tail: list[Column], follow: Callable[[Column], Column] | None = None, aside: Callable[[Column], Column] | None = None, boxes: bool = True) -> DataFrame:
    """Pages of a book of orders for each customer: a header, an option for each line item, an answer and more lines. Without boxes, elements have their content alone.

    Line items are told apart by all that orders them, so the order is fixed; order keys are unique. An order's lines stay in one row until pages are cut, so
    what is shuffled and sorted is a row an order, and not one a line. The boxes of a page's lines are constants, as lines are boxes of one size, ten apart;
    lines that are aside stand in a right column.
    """
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("doc_id"), F.col("o_orderkey").alias("k"), "o_orderpriority", "o_orderstatus")
    def line(d: int, content: Column) -> Column:
        a = F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey")
        return F.struct(a.alias("a"), F.col("l_suppkey").cast("long").alias("b"), F.col("l_extendedprice").cast("double").alias("c"), F.lit(d).alias("d"), content.alias("content"))

    item = {c: F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")}
    items = table(spark, sf_dir, "lineitem").where("l_orderkey IS NOT NULL").select(F.col("l_orderkey").alias("_k"), F.array(line(0, option(item)), *([line(1, follow(item))] if follow is not None else [])).alias("lines"))
    items = items.groupBy("_k").agg(F.sort_array(F.flatten(F.collect_list("lines"))).alias("items"))
    middle = F.coalesce(F.col("items")["content"], F.array().cast("array<string>"))
    rows = orders.join(items, F.col("k") == F.col("_k"), "left")
    rows = rows.select("doc_id", "k", F.concat(F.array(header), middle, F.array(*([answer] if answer is not None else []), *tail)).alias("lines"))
    before = Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.size("lines")).over(before), F.lit(0)))
    first, last = (F.floor(n / PAGE_LINES) for n in (F.col("start"), F.col("start") + F.size("lines") - 1))

    def cut(page: Column) -> Column:
        at = F.greatest(page * PAGE_LINES - F.col("start"), F.lit(0)).cast("int")
        stop = F.least((page + 1) * PAGE_LINES - F.col("start"), F.size("lines")).cast("int")
        return F.struct(page.cast("int").alias("page_index"), F.slice("lines", at + 1, stop - at).alias("lines"))

    rows = rows.select("doc_id", "start", F.inline(F.transform(F.sequence(first, last), cut)))
    listed = rows.groupBy("doc_id", "page_index").agg(F.sort_array(F.collect_list(F.struct("start", "lines"))).alias("ls"))
    rows = listed.select("doc_id", "page_index", F.flatten(F.col("ls")["lines"]).alias("lines"))
    if not boxes:
        return rows.select("doc_id", "page_index", F.arrays_zip(F.col("lines").alias("content")).alias("elements"))
    boxes_at = lambda left: F.array(*[box(F.lit(left), F.lit(i * 10), F.lit(left + 100), F.lit(i * 10 + 8)) for i in range(PAGE_LINES)]).cast("array<array<struct<x: double, y: double>>>")
    at = F.slice(boxes_at(0), F.lit(1), F.size("lines"))
    if aside is not None:
        at = F.when(F.exists("lines", aside), F.transform("lines", lambda c, i: F.when(aside(c), F.get(boxes_at(ASIDE), i)).otherwise(F.get(boxes_at(0), i)))).otherwise(at)
    element = F.arrays_zip(at.alias("bbox"), F.array_repeat(F.lit("text"), F.size("lines")).alias("label"), F.col("lines").alias("content"))
    return rows.select("doc_id", "page_index", element.cast(f"array<{ELEMENT}>").alias("elements"))


def contents(pages: DataFrame) -> DataFrame:
    """Pages whose elements have their content alone, for what is written and asks for no boxes."""
    return pages.select("doc_id", "page_index", F.arrays_zip(F.col("elements")["content"].alias("content")).alias("elements"))


def _label(i: Column) -> Column:
    return F.char(F.lit(64) + i["l_linenumber"])


def book_pages(spark: SparkSession, sf_dir: str, boxes: bool = True) -> DataFrame:
    """The order book in the layout of BOOK_PATTERNS, with page numbers and other noise between."""
    header = F.concat(F.lit("第"), F.col("k"), F.lit("题 "), F.col("o_orderpriority"))
    option = lambda i: F.concat(_label(i), F.lit(". part "), i["l_partkey"])
    follow = lambda i: F.concat(F.lit("from "), i["l_suppkey"])
    answer = F.concat(F.lit("答案："), F.col("o_orderstatus"))
    tail = [F.col("doc_id"), F.lit("-- end"), F.lit("orders")]
    return book_pages_of(spark, sf_dir, header, option, answer, tail, follow, boxes=boxes)


def book_a_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order book in the first book's layout, with an annotation in the right column beside each header."""
    header = F.concat(F.col("k"), F.lit(".（2024年 "), F.col("o_orderpriority"), F.lit(" 75%）"))
    option = lambda i: F.concat(F.char(F.lit(65) + i["l_linenumber"] % 4), F.lit(". part "), i["l_partkey"])
    answer = F.concat(F.lit("【参考答案】"), F.when(F.col("o_orderstatus") == "O", "A").otherwise("BC"))
    tail = [F.lit("【题型分类】 kind"), F.concat(F.lit("【实战解析】status "), F.col("o_orderstatus")), F.lit("时间"), F.concat(F.lit("花生批注"), F.col("k"))]
    return book_pages_of(spark, sf_dir, header, option, answer, tail, aside=lambda c: c.startswith("花生批注"))


def book_b_pages(spark: SparkSession, sf_dir: str, boxes: bool = True) -> DataFrame:
    """The order book in the second book's layout: two options on a line, which end it."""
    header = F.concat(F.lit("例题"), F.col("k"), F.lit("（2024）"), F.col("o_orderpriority"))
    option = lambda i: F.concat(F.char(F.lit(65) + i["l_linenumber"] % 4), F.lit(". part "), i["l_partkey"], F.lit(" D．supp "), i["l_suppkey"])
    return book_pages_of(spark, sf_dir, header, option, None, [F.lit("自测用，禁止商用"), F.lit("after")], boxes=boxes)


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, a line an element."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(split_lines(F.col("text"))).alias("pos", "content"))
    return paged(rows, ["pos"])


def chat_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations, a page each, a turn an element with its role as label."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), "turn", "role", "text")
    listed = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("ts"))
    return listed.select("doc_id", F.lit(0).alias("page_index"), F.transform("ts", lambda t: F.struct(F.array().cast("array<struct<x: double, y: double>>").alias("bbox"), t["role"].alias("label"), t["text"].alias("content"))).alias("elements"))


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as job logs: (job_id, sequence, type, created_at, value); a job is a user, and its events are numbered from 1 in the order of time."""
    rows = table(spark, sf_dir, "events")
    return rows.select(F.col("user_id").cast("string").alias("job_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("sequence"), F.col("event_type").alias("type"), F.col("ts").cast("timestamp").alias("created_at"), "value")


def point_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as pages of points: (doc_id, xs) of the first coordinates by label, in the order of vec_id."""
    rows = table(spark, sf_dir, "embeddings").groupBy(F.col("label").cast("string").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("vec_id", F.col("embedding")[0].cast("double").alias("x")))).alias("ps"))
    return rows.select("doc_id", F.transform("ps", lambda p: p["vec_id"]).alias("vec_ids"), F.transform("ps", lambda p: p["x"]).alias("xs"))
