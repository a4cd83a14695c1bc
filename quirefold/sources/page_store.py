"""Persisted pages: JSON lines with a header, a record for each page, and a last record that says the file is whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirefold.sources.schemas import ELEMENT, STORED_PAGE

VERSION = 1


def read_pages(spark: SparkSession, path: str, on_invalid: str = "fail") -> DataFrame:
    """Pages (doc_id: the file, page_index, elements) of all files at path.

    A file is taken whole or not at all: its first record must be the header of this version, its last the end record, and all
    between pages with elements. on_invalid is `fail`, or `drop` to leave such files out. Lines end with \\n alone.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), "value")
    lines = F.split(F.regexp_replace("value", "\n\\z", ""), "\n", -1)
    records = F.transform(lines, lambda x: F.from_json(x, STORED_PAGE))
    rows = files.select("doc_id", records.alias("r"))
    inner = lambda r: F.slice(r, 2, F.greatest(F.size(r) - 2, F.lit(0)))
    ok = (F.size("r") >= 2) & (F.col("r")[0]["type"] == "header") & (F.col("r")[0]["version"] == VERSION) & (F.element_at("r", -1)["type"] == "complete")
    ok = F.coalesce(ok & F.forall(inner(F.col("r")), lambda x: (x["type"] == "page") & x["elements"].isNotNull()), F.lit(False))
    if on_invalid == "fail":
        rows = rows.where(F.when(ok, True).otherwise(F.raise_error(F.concat(F.lit("incomplete or invalid: "), "doc_id")).cast("boolean")))
    else:
        rows = rows.where(ok)
    return rows.select("doc_id", F.posexplode(inner(F.col("r"))).alias("page_index", "p")).select("doc_id", "page_index", F.col("p.elements").cast(f"array<{ELEMENT}>").alias("elements"))


def write_pages(pages: DataFrame, path: str) -> None:
    """Pages as the files that read_pages() takes, one text file for each document, in a folder doc_id=... each.

    Records of a document are brought together and sorted by page; Spark's committer shows a file only when it is whole.
    """
    page = F.to_json(F.struct(F.lit("page").alias("type"), "elements"))
    docs = pages.select("doc_id").distinct()
    records = pages.select("doc_id", F.lit(1).alias("part"), "page_index", page.alias("value"))
    ends = docs.select("doc_id", F.explode(F.array(F.struct(F.lit(0).alias("part"), F.lit(f'{{"type":"header","version":{VERSION}}}').alias("value")), F.struct(F.lit(2).alias("part"), F.lit('{"type":"complete"}').alias("value")))).alias("x"))
    records = records.unionByName(ends.select("doc_id", "x.part", F.lit(0).alias("page_index"), "x.value"))
    records.repartition("doc_id").sortWithinPartitions("doc_id", "part", "page_index").select("doc_id", "value").write.partitionBy("doc_id").mode("overwrite").text(path)


def select_pages(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """(doc_id, request_id, position, page_index, elements) for requests (doc_id, request_id, page_indexes): in the order asked for, repeats kept.

    An empty request, or an index that the document hasn't, raises.
    """
    checked = requests.withColumn("page_indexes", F.when(F.size("page_indexes") > 0, F.col("page_indexes")).otherwise(F.raise_error(F.lit("page indexes must not be empty")).cast("array<int>")))
    rows = checked.select("doc_id", "request_id", F.posexplode("page_indexes").alias("position", "page_index"))
    found = rows.join(pages.withColumn("there", F.lit(True)), ["doc_id", "page_index"], "left")
    found = found.withColumn("elements", F.when(F.col("there"), F.col("elements")).otherwise(F.raise_error(F.concat(F.lit("no such page: "), "page_index")).cast(f"array<{ELEMENT}>")))
    return found.select("doc_id", "request_id", "position", "page_index", "elements")


def cache_misses(requests: DataFrame, cached: DataFrame) -> DataFrame:
    """(doc_id, request_id, page_index, position) of the distinct pages asked for that aren't in cached (doc_id, page_index), in the order first asked."""
    rows = requests.select("doc_id", "request_id", F.posexplode("page_indexes").alias("position", "page_index"))
    first = rows.groupBy("doc_id", "request_id", "page_index").agg(F.min("position").alias("position"))
    return first.join(cached, ["doc_id", "page_index"], "left_anti").select("doc_id", "request_id", "page_index", "position")


def lru_kept(accesses: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, page_index) that a cache of so many pages holds after accesses (doc_id, at, page_index): those last used."""
    last = accesses.groupBy("doc_id", "page_index").agg(F.max("at").alias("at"))
    return last.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("at")))).where(F.col("n") <= capacity).select("doc_id", "page_index")


def page_count_errors(requested: DataFrame, received: DataFrame) -> DataFrame:
    """(doc_id, expected, actual) where a backend gave another number of pages than asked for."""
    a, b = (x.groupBy("doc_id").agg(F.count("*").alias(n)) for x, n in ((requested, "expected"), (received, "actual")))
    both = a.join(b, "doc_id", "left").withColumn("actual", F.coalesce("actual", F.lit(0).cast("long")))
    return both.where("expected <> actual")
