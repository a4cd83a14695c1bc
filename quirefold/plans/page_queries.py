"""Queries over pages of documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions.text import circled_numbers, fullwidth_to_halfwidth, normalized, raw_text
from quirefold.operators import transforms as tr
from quirefold.sources import inputs, page_store, shapes
from quirefold.sources.adapters import box, doc_pages, point_pages, table
from quirefold.sources.schemas import ELEMENT
from quirefold.sources.scratch import scratch_path

_LINES = "l AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, pos - 1 AS pos, line, CAST((pos - 1) // 20 AS INT) AS page_index, (pos - 1) % 20 AS nth FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents))"


def _page_text(transform: tr.Transform):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return doc_pages(spark, sf_dir).select("doc_id", "page_index", raw_text(transform(F.col("elements"))).alias("text"))

    return query


def _page_text_sql(line: str, where: str = "true") -> str:
    return f"WITH {_LINES} SELECT doc_id, page_index, coalesce(string_agg({line}, chr(10) ORDER BY pos) FILTER ({where}), '') AS text FROM l GROUP BY doc_id, page_index"


def _content(f):
    return tr.map_elements(lambda e: F.struct(e["bbox"].alias("bbox"), e["label"].alias("label"), f(e["content"]).alias("content")))


def split_multiline(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.lit(0)
    element = F.struct(box(zero, zero, F.lit(100), F.lit(300)).alias("bbox"), F.lit("text").alias("label"), F.col("text").alias("content"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array(element).cast(f"array<{ELEMENT}>").alias("elements"))
    rows = docs.select("doc_id", F.posexplode(tr.split_multiline()(F.col("elements"))).alias("i", "e"))
    b = tr.bounds(F.col("e"))
    return rows.select("doc_id", "i", F.round(b["y0"], 6).alias("y0"), F.round(b["y1"], 6).alias("y1"), F.col("e.content").alias("content"))


_SPLIT_SQL = r"""
WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS pos, len(string_split(text, chr(10))) AS n FROM documents),
k AS (SELECT * FROM s WHERE n = 1 OR regexp_matches(content, '[^\s]'))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INT) AS i, CASE WHEN n = 1 THEN 0 ELSE round(300.0::DOUBLE / n * (pos - 1), 6) END::DOUBLE AS y0, CASE WHEN n = 1 THEN 300 ELSE round(300.0::DOUBLE / n * pos, 6) END::DOUBLE AS y1, content FROM k
"""

_REGIONS = [(0.0, 0.0, 100.0, 15.0), (20.0, 92.0, 80.0, 105.0), (0.0, 170.0, 100.0, 200.0)]


def _regions(match: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        kept = tr.remove_in_regions(_REGIONS, match, 0.4)(F.col("elements"))
        return doc_pages(spark, sf_dir).select("doc_id", "page_index", F.size(kept).alias("kept"), raw_text(kept).alias("text"))

    return query


def _regions_sql(match: str) -> str:
    def hit(r: tuple) -> str:
        x0, y0, x1, y1 = r
        if match == "center":
            return f"(50 BETWEEN {x0} AND {x1} AND nth * 10 + 4 BETWEEN {y0} AND {y1})"
        if match == "contained":
            return f"(0 >= {x0} AND nth * 10 >= {y0} AND 100 <= {x1} AND nth * 10 + 8 <= {y1})"
        return f"(greatest(0, least(100, {x1}) - greatest(0, {x0})) * greatest(0, least(nth * 10 + 8, {y1}) - greatest(nth * 10, {y0})) / 800.0 >= 0.4)"

    out = " OR ".join(hit(r) for r in _REGIONS)
    return f"WITH {_LINES} SELECT doc_id, page_index, CAST(count(*) FILTER (NOT ({out})) AS INT) AS kept, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT ({out})), '') AS text FROM l GROUP BY doc_id, page_index"


def merge_collinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of an order as elements on one line, whose gaps depend on quantities."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").cast("int").alias("q"))
    listed = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "q"))).alias("xs"))

    def element(x, i):
        left = i * 100 + x["q"] % 10
        return F.struct(box(left, F.lit(0), left + 60 + x["q"] % 40, F.lit(10)).alias("bbox"), F.lit("text").alias("label"), x["l_partkey"].cast("string").alias("content"))

    elements = F.transform("xs", element).cast(f"array<{ELEMENT}>")
    rows = listed.select("l_orderkey", F.posexplode(tr.merge_collinear()(elements)).alias("i", "e"))
    b = tr.bounds(F.col("e"))
    return rows.select("l_orderkey", "i", b["x0"].alias("x0"), b["x1"].alias("x1"), F.col("e.content").alias("content"))


_MERGE_SQL = """
WITH o AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, CAST(l_quantity AS INT)) - 1 AS n, l_partkey, CAST(l_quantity AS INT) AS q FROM lineitem),
b AS (SELECT *, n * 100 + q % 10 AS x0, n * 100 + q % 10 + 60 + q % 40 AS x1 FROM o),
g AS (SELECT *, CASE WHEN x0 >= lag(x1) OVER w AND x0 - lag(x1) OVER w <= 20 THEN 0 ELSE 1 END AS fresh FROM b WINDOW w AS (PARTITION BY l_orderkey ORDER BY n)),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY l_orderkey ORDER BY n) AS run FROM g)
SELECT l_orderkey, CAST(run - 1 AS INT) AS i, CAST(min(x0) AS DOUBLE) AS x0, CAST(max(x1) AS DOUBLE) AS x1, string_agg(CAST(l_partkey AS VARCHAR), '' ORDER BY n) AS content FROM k GROUP BY l_orderkey, run
"""


def two_column_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = point_pages(spark, sf_dir).withColumn("side", tr.column_of(F.col("xs")))
    return pages.select("doc_id", F.inline(F.arrays_zip("vec_ids", "side"))).select("doc_id", F.col("vec_ids").alias("vec_id"), "side")


_CLUSTER_SQL = """
WITH RECURSIVE p AS (SELECT CAST(label AS VARCHAR) AS doc_id, list(embedding[1]::DOUBLE ORDER BY vec_id) AS xs FROM embeddings GROUP BY label),
r AS (SELECT doc_id, xs, 0 AS it, list_min(xs) AS l, list_max(xs) AS h FROM p
UNION ALL SELECT doc_id, xs, it + 1, coalesce(list_avg(list_filter(xs, lambda x: abs(x - l) <= abs(x - h))), l), coalesce(list_avg(list_filter(xs, lambda x: abs(x - l) > abs(x - h))), h) FROM r WHERE it < 100),
c AS (SELECT doc_id, l, h FROM r WHERE it = 100)
SELECT c.doc_id, vec_id, CASE WHEN abs(embedding[1]::DOUBLE - l) > abs(embedding[1]::DOUBLE - h) THEN 1 ELSE 0 END AS side FROM c JOIN embeddings e ON CAST(e.label AS VARCHAR) = c.doc_id
"""

_WIDE = "　" + "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = " " + "".join(map(chr, range(0x21, 0x7F)))


def fullwidth(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    wide = F.concat(F.lit("Ｎｏ．１　（！）"), F.translate("text", "abc .", "ａｂｃ　．"))
    return docs.select("doc_id", fullwidth_to_halfwidth(wide).alias("text"))


def circled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    marked = F.concat(F.lit("$\\textcircled{"), F.col("doc_id") % 23, F.lit("}$ "), F.col("text"), F.lit(" $ \\textcircled{07} $"))
    return docs.select("doc_id", circled_numbers(marked).alias("text"))


def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", normalized(F.col("text")).alias("text"))


def select_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = doc_pages(spark, sf_dir)
    requests = pages.groupBy("doc_id").agg(F.max("page_index").alias("m")).select("doc_id", F.lit(0).alias("request_id"), F.array(F.col("m"), F.lit(0), F.col("m")).alias("page_indexes"))
    found = page_store.select_pages(pages, requests)
    return found.select("doc_id", "position", "page_index", F.size("elements").alias("n"), raw_text(F.col("elements")).alias("text"))


def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = doc_pages(spark, sf_dir).select("doc_id", "page_index")
    requests = pages.groupBy("doc_id").agg(F.max("page_index").alias("m")).select("doc_id", F.lit(0).alias("request_id"), F.array(F.lit(2), F.lit(0), F.lit(2), F.col("m")).alias("page_indexes"))
    cached = pages.where("page_index = 2")
    return page_store.cache_misses(requests, cached).drop("request_id")


def noise_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lines that are no line of a benchmark item."""
    noise = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "\n")).alias("line")).distinct()
    lines = doc_pages(spark, sf_dir).select("doc_id", "page_index", F.explode("elements").alias("e")).select("doc_id", "page_index", F.col("e.content").alias("line"))
    return lines.join(noise, "line", "left_anti").groupBy("doc_id", "page_index").agg(F.count("*").alias("n"))


def multiset_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters that a conversation's users and its assistant share, as multisets."""
    from quirefold.functions.text import char_counts

    rows = table(spark, sf_dir, "conversations").select("conv_id", F.when(F.col("role") == "assistant", "a").otherwise("u").alias("side"), F.inline(char_counts(normalized(F.col("text")))))
    counts = rows.groupBy("conv_id", "c").agg(F.sum(F.when(F.col("side") == "u", F.col("n"))).alias("u"), F.sum(F.when(F.col("side") == "a", F.col("n"))).alias("a"))
    return counts.groupBy("conv_id").agg(F.sum(F.least(F.coalesce("u", F.lit(0)), F.coalesce("a", F.lit(0)))).alias("shared"))


def pdf_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of an order as pages, of 60 pages' size limit in all."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").cast("long").alias("q")))).alias("xs"))
    return items.select("l_orderkey", F.array_join(shapes.chunks(F.transform("xs", lambda x: x["q"]), 3, 60), ",").alias("chunks"))


_CHUNKS_SQL = """
WITH RECURSIVE o AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, CAST(l_quantity AS BIGINT)) AS n, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
r AS (SELECT l_orderkey, n, 1 AS k, q AS b, 1 AS chunk FROM o WHERE n = 1
UNION ALL SELECT o.l_orderkey, o.n, CASE WHEN r.k < 3 AND r.b + o.q <= 60 THEN r.k + 1 ELSE 1 END, CASE WHEN r.k < 3 AND r.b + o.q <= 60 THEN r.b + o.q ELSE o.q END, CASE WHEN r.k < 3 AND r.b + o.q <= 60 THEN r.chunk ELSE r.chunk + 1 END FROM r JOIN o ON o.l_orderkey = r.l_orderkey AND o.n = r.n + 1),
c AS (SELECT l_orderkey, chunk, count(*) AS n FROM r GROUP BY l_orderkey, chunk)
SELECT l_orderkey, string_agg(CAST(n AS VARCHAR), ',' ORDER BY chunk) AS chunks FROM c GROUP BY l_orderkey
"""


def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = doc_pages(spark, sf_dir).groupBy("doc_id").agg((F.max("page_index") + 1).alias("n"))
    wide = pages.withColumn("n", F.col("n") * 3 + F.length("doc_id"))
    return wide.select("doc_id", "n", F.array_join(shapes.even_sample(F.col("n")), ",").alias("sample"))


def text_layer_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = doc_pages(spark, sf_dir).select("doc_id", "page_index", raw_text(F.col("elements")).alias("text"))
    found = shapes.has_text_layer(pages, 400)
    return found.select("doc_id", F.round("text_ratio", 6).alias("text_ratio"), "text_layer")


_SAMPLE = "s AS (SELECT DISTINCT doc_id, n, CASE WHEN n = 1 THEN 0 ELSE CAST(round_even(i * (n - 1) / (least(n, 5) - 1.0::DOUBLE), 0) AS INT) END AS page_index FROM (SELECT doc_id, n, unnest(range(CAST(least(n, 5) AS BIGINT))) AS i FROM c))"


def media_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pages with the heads of files before them."""
    pages = table(spark, sf_dir, "pages")
    head = F.element_at(F.array(F.lit("  %PDF-1.7"), F.lit("<html>"), F.lit("GIF"), F.lit("\n%PDF-")), (F.col("page_id") % 4 + 1).cast("int"))
    name = F.concat("page_id", F.element_at(F.array(F.lit(".bin"), F.lit(".PDF"), F.lit(".jpeg"), F.lit(".png")), (F.col("page_id") % 4 + 1).cast("int")))
    content = F.concat(head, "html").cast("binary")
    kind = shapes.media_type(name, content)
    return pages.select("page_id", kind.alias("media_type"), F.md5(shapes.data_uri(kind, content).cast("binary")).alias("uri_md5"))


def layout_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a layout backend's response for one page each."""
    item = F.concat(F.lit('{"layout_details": [[{"label": "'), F.col("event_type"), F.lit('", "content": "'), F.col("event_id"), F.lit('", "bbox_2d": [0.25, 0.5, 0.75, 1], "width": '), F.col("user_id"), F.lit(', "height": 200}, {"bbox_2d": [1, 2]}], null]}'))
    rows = table(spark, sf_dir, "events").select("event_id", F.posexplode(shapes.layout_elements(item)).alias("page", "es"))
    rows = rows.select("event_id", "page", F.posexplode_outer("es").alias("i", "e"))
    b = tr.bounds(F.col("e"))
    return rows.select("event_id", "page", "i", F.col("e.label").alias("label"), F.col("e.content").alias("content"), b["x0"].alias("x0"), b["y1"].alias("y1"))


_LAYOUT_SQL = """
SELECT event_id, 0 AS page, 0 AS i, event_type AS label, CAST(event_id AS VARCHAR) AS content, user_id * 0.25::DOUBLE AS x0, 200.0::DOUBLE AS y1 FROM events
UNION ALL SELECT event_id, 0, 1, 'text', '', NULL, NULL FROM events UNION ALL SELECT event_id, 1, NULL, NULL, NULL, NULL, NULL FROM events
"""


def raster_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a raster backend's result: three texts, two polygons, one of them with a bad point; detections stand in for every third."""
    key = F.when(F.col("event_id") % 3 == 0, "dt_polys").otherwise("rec_polys")
    item = F.concat(F.lit('{"rec_texts": ["'), F.col("event_type"), F.lit('", "b", "c"], "'), key, F.lit('": [[['), F.col("user_id"), F.lit(", 2], [3], [4, 5]], [[6, 7]]]}"))
    rows = table(spark, sf_dir, "events").select("event_id", F.posexplode(shapes.raster_elements(item)).alias("i", "e"))
    return rows.select("event_id", "i", F.col("e.content").alias("content"), F.size("e.bbox").alias("points"), F.col("e.bbox")[0]["x"].alias("x"))


_RASTER_SQL = "SELECT event_id, 0 AS i, event_type AS content, 2 AS points, user_id::DOUBLE AS x FROM events UNION ALL SELECT event_id, 1, 'b', 1, 6 FROM events"


def text_layer_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as blocks of a text layer: a text block of a line without a box and a blank one, and a picture."""
    item = F.concat(
        F.lit('[{"type": 0, "lines": [{"spans": [{"text": "'), F.col("event_type"), F.lit('", "bbox": [1, 2, 3, 4]}, {"text": "!", "bbox": ['), F.col("user_id"), F.lit(', 0, 9, 5]}]}, {"bbox": [0, 0, 1, 1], "spans": [{"text": "  "}]}]}, {"type": 1}]')
    )
    rows = table(spark, sf_dir, "events").select("event_id", F.posexplode(shapes.text_layer_elements(item)).alias("i", "e"))
    b = tr.bounds(F.col("e"))
    return rows.select("event_id", "i", F.col("e.content").alias("content"), b["x0"].alias("x0"), b["y0"].alias("y0"), b["y1"].alias("y1"))


def input_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten web pages a file, as a folder of files: a third are recognised by a stand-in that makes pages of four lines, one that fails on some; the others are of no known kind."""
    n = F.floor(F.col("page_id") / 10)
    urls = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", F.coalesce("url", F.lit("")).alias("url")))), lambda x: x["url"]), "\n")
    head = F.when(F.col("file") % 3 > 0, "plain").when(F.col("file") % 5 == 0, "%PDF-boom").otherwise("%PDF-1")
    files = table(spark, sf_dir, "pages").groupBy(n.alias("file")).agg(urls.alias("urls")).select("file", F.concat(head, F.lit("\n"), "urls").alias("value"))
    at = scratch_path(spark, "files")
    files.write.partitionBy("file").text(at)

    def stand_in():
        def predict(content: bytes) -> list[list[dict]]:
            lines = content.decode().removesuffix("\n").split("\n")
            if lines[0] == "%PDF-boom":
                raise ValueError("can't be read")
            return [[{"content": x} for x in lines[i : i + 4]] for i in range(0, len(lines), 4)]

        return predict

    found = inputs.recognise(inputs.documents(spark, at, "part-*"), {inputs.PDF: ("raster", stand_in)})
    file = F.regexp_extract("doc_id", r"/file=(\d+)/", 1).cast("long")
    return found.select(file.alias("file"), "page_index", F.coalesce(F.size("elements"), F.lit(-1)).alias("n"), F.when(F.col("elements").isNotNull(), F.length(raw_text(F.col("elements")))).alias("chars"), "error")


_CIRCLED = "".join(chr(0x2460 + i) for i in range(20))

QUERIES = {
    "input_files": input_files,
    "map_lower": _page_text(_content(F.lower)),
    "replace_text": _page_text(tr.replace_text({"the": "THE", "THE ": "<a> "})),
    "remove_text": _page_text(tr.remove_text(["th", "er"])),
    "filter_elements": _page_text(tr.filter_elements(lambda e: F.length(e["content"]) > 40)),
    "transform_pipeline": _page_text(tr.pipeline(tr.filter_elements(lambda e: F.length(e["content"]) > 40), tr.remove_text(["th"]), _content(F.lower))),
    "raw_text": _page_text(lambda e: e),
    "split_multiline": split_multiline,
    "remove_in_regions_center": _regions("center"),
    "remove_in_regions_contained": _regions("contained"),
    "remove_in_regions_overlap": _regions("overlap"),
    "merge_collinear": merge_collinear,
    "two_column_cluster": two_column_cluster,
    "fullwidth": fullwidth,
    "circled": circled,
    "normalized_text": normalized_text,
    "select_pages": select_pages,
    "cache_misses": cache_misses,
    "noise_anti_join": noise_anti_join,
    "multiset_intersection": multiset_intersection,
    "pdf_chunks": pdf_chunks,
    "even_sample": even_sample,
    "text_layer_select": text_layer_select,
    "media_type": media_type,
    "layout_shape": layout_shape,
    "raster_shape": raster_shape,
    "text_layer_shape": text_layer_shape,
}

ORACLES = {
    "input_files": """WITH f AS (SELECT page_id // 10 AS file, ['%PDF-1'] || list(coalesce(url, '') ORDER BY page_id) AS ls FROM pages GROUP BY ALL),
g AS (SELECT file, unnest(range((len(ls) + 3) // 4)) AS page_index, ls FROM f WHERE file % 3 = 0 AND file % 5 <> 0)
SELECT CAST(file AS BIGINT) AS file, CAST(page_index AS INT) AS page_index, CAST(len(ls[page_index * 4 + 1:page_index * 4 + 4]) AS INT) AS n, CAST(length(list_aggregate(ls[page_index * 4 + 1:page_index * 4 + 4], 'string_agg', chr(10))) AS INT) AS chars, NULL AS error FROM g
UNION ALL SELECT CAST(file AS BIGINT), NULL, -1, NULL, CASE WHEN file % 3 > 0 THEN 'unsupported input' ELSE 'ValueError: can''t be read' END FROM f WHERE file % 3 > 0 OR file % 5 = 0""",
    "map_lower": _page_text_sql("lower(line)"),
    "replace_text": _page_text_sql("replace(replace(line, 'the', 'THE'), 'THE ', '<a> ')"),
    "remove_text": _page_text_sql("replace(replace(line, 'th', ''), 'er', '')"),
    "filter_elements": _page_text_sql("line", "length(line) > 40"),
    "transform_pipeline": _page_text_sql("lower(replace(line, 'th', ''))", "length(line) > 40"),
    "raw_text": _page_text_sql("line"),
    "split_multiline": _SPLIT_SQL,
    "remove_in_regions_center": _regions_sql("center"),
    "remove_in_regions_contained": _regions_sql("contained"),
    "remove_in_regions_overlap": _regions_sql("overlap"),
    "merge_collinear": _MERGE_SQL,
    "two_column_cluster": _CLUSTER_SQL,
    "fullwidth": f"SELECT doc_id, translate('Ｎｏ．１　（！）' || translate(text, 'abc .', 'ａｂｃ　．'), '{_WIDE}', '{_NARROW.replace(chr(39), chr(39) * 2)}') AS text FROM documents",
    "circled": f"SELECT doc_id, CASE WHEN doc_id % 23 BETWEEN 1 AND 20 THEN substr('{_CIRCLED}', CAST(doc_id % 23 AS INT), 1) ELSE '$\\textcircled{{' || doc_id % 23 || '}}$' END || ' ' || text || ' ' || '{_CIRCLED[6]}' AS text FROM documents",
    "normalized_text": r"SELECT doc_id, replace(lower(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')), 'ß', 'ss') AS text FROM documents",
    "select_pages": f"WITH {_LINES}, p AS (SELECT doc_id, page_index, CAST(count(*) AS INT) AS n, string_agg(line, chr(10) ORDER BY pos) AS text FROM l GROUP BY doc_id, page_index), m AS (SELECT doc_id, max(page_index) AS m FROM p GROUP BY doc_id), r AS (SELECT doc_id, 0 AS position, m AS page_index FROM m UNION ALL SELECT doc_id, 1, 0 FROM m UNION ALL SELECT doc_id, 2, m FROM m) SELECT doc_id, position, page_index, n, text FROM r JOIN p USING (doc_id, page_index)",
    "cache_misses": f"WITH {_LINES}, m AS (SELECT doc_id, max(page_index) AS m FROM l GROUP BY doc_id), r AS (SELECT doc_id, 0 AS position, 2 AS page_index FROM m UNION ALL SELECT doc_id, 1, 0 FROM m UNION ALL SELECT doc_id, 3, m FROM m), f AS (SELECT doc_id, page_index, min(position) AS position FROM r GROUP BY doc_id, page_index) SELECT f.* FROM f JOIN m USING (doc_id) WHERE NOT (page_index = 2 AND m >= 2)",
    "noise_anti_join": f"WITH {_LINES}, b AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS line FROM benchmark) SELECT doc_id, page_index, count(*) AS n FROM l WHERE line NOT IN (SELECT line FROM b) GROUP BY doc_id, page_index",
    "multiset_intersection": r"WITH c AS (SELECT conv_id, role = 'assistant' AS a, unnest(string_split(replace(lower(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')), 'ß', 'ss'), '')) AS c FROM conversations), n AS (SELECT conv_id, c, count(*) FILTER (a) AS x, count(*) FILTER (NOT a) AS y FROM c WHERE c <> '' GROUP BY conv_id, c) SELECT conv_id, CAST(sum(least(x, y)) AS BIGINT) AS shared FROM n GROUP BY conv_id",
    "pdf_chunks": _CHUNKS_SQL,
    "even_sample": f"WITH {_LINES}, c AS (SELECT doc_id, (max(page_index) + 1) * 3 + length(doc_id) AS n FROM l GROUP BY doc_id), {_SAMPLE} SELECT doc_id, CAST(n AS INT) AS n, string_agg(CAST(page_index AS VARCHAR), ',' ORDER BY page_index) AS sample FROM s GROUP BY doc_id, n",
    "text_layer_select": rf"WITH {_LINES}, p AS (SELECT doc_id, page_index, string_agg(line, chr(10) ORDER BY pos) AS text FROM l GROUP BY doc_id, page_index), c AS (SELECT doc_id, max(page_index) + 1 AS n FROM p GROUP BY doc_id), {_SAMPLE}, r AS (SELECT doc_id, avg(CASE WHEN length(regexp_replace(text, '\s', '', 'g')) >= 400 THEN 1.0::DOUBLE ELSE 0 END) AS text_ratio FROM s JOIN p USING (doc_id, page_index) GROUP BY doc_id) SELECT doc_id, round(text_ratio, 6) AS text_ratio, text_ratio >= 0.5 AS text_layer FROM r",
    "media_type": "WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'image/jpeg' ELSE 'application/pdf' END AS media_type, CASE page_id % 4 WHEN 0 THEN '  %PDF-1.7' WHEN 1 THEN '<html>' WHEN 2 THEN 'GIF' ELSE chr(10) || '%PDF-' END || html AS c FROM pages) SELECT page_id, media_type, md5('data:' || media_type || ';base64,' || to_base64(encode(c))) AS uri_md5 FROM p",
    "layout_shape": _LAYOUT_SQL,
    "raster_shape": _RASTER_SQL,
    "text_layer_shape": "SELECT event_id, 0 AS i, event_type || '!' AS content, least(1, user_id)::DOUBLE AS x0, 0.0::DOUBLE AS y0, 5.0::DOUBLE AS y1 FROM events",
}
