"""What recognition backends give and take: response shapes, media types, chunks and the choice of a backend. The backends themselves are plugged in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions.text import is_blank
from quirefold.operators.transforms import Transform, layout_chain, raster_chain, rectangle, text_layer_chain
from quirefold.sources.schemas import ELEMENT, PAGES

#: What one request may hold.
CHUNK_PAGES, PDF_BYTES, IMAGE_BYTES = 20, 50 * 1024 * 1024, 10 * 1024 * 1024
SAMPLE_PAGES, LEAST_CHARS, LEAST_RATIO = 5, 20, 0.5
LAYOUT = "array<array<struct<label: string, content: string, bbox_2d: array<double>, width: double, height: double>>>"
TEXT_LAYER = "array<struct<type: int, lines: array<struct<bbox: array<double>, spans: array<struct<text: string, bbox: array<double>>>>>>>"
RASTER = "struct<rec_texts: array<string>, rec_polys: array<array<array<double>>>, dt_polys: array<array<array<double>>>>"

_empty_box = lambda: F.array().cast("array<struct<x: double, y: double>>")


def layout_elements(response: Column) -> Column:
    """Pages of elements from a layout response's JSON: boxes are shares of width and height; a bad box gives no points, a missing page no elements."""
    pages = F.from_json(response, f"struct<layout_details: {LAYOUT}>")["layout_details"]

    def element(i: Column) -> Column:
        b = i["bbox_2d"]
        good = (F.size(b) == 4) & F.forall(b, lambda v: v.isNotNull()) & i["width"].isNotNull() & i["height"].isNotNull()
        box = rectangle(F.get(b, F.lit(0)) * i["width"], F.get(b, F.lit(1)) * i["height"], F.get(b, F.lit(2)) * i["width"], F.get(b, F.lit(3)) * i["height"])
        return F.struct(F.when(F.coalesce(good, F.lit(False)), box).otherwise(_empty_box()).alias("bbox"), F.coalesce(i["label"], F.lit("text")).alias("label"), F.coalesce(i["content"], F.lit("")).alias("content"))

    return F.transform(pages, lambda p: F.transform(F.coalesce(p, F.array().cast(LAYOUT[6:-1])), element))


def raster_elements(response: Column) -> Column:
    """Elements of a raster result's JSON: texts with polygons, as many as the shorter has; dt_polys stand in only where rec_polys is missing; points of other than two numbers go."""
    r = F.from_json(response, RASTER)
    polys = F.when(F.get_json_object(response, "$.rec_polys").isNotNull(), r["rec_polys"]).otherwise(r["dt_polys"])
    polys = F.coalesce(polys, F.array().cast("array<array<array<double>>>"))
    n = F.least(F.size(r["rec_texts"]), F.size(polys))
    pairs = F.slice(F.arrays_zip(r["rec_texts"].alias("t"), polys.alias("p")), F.lit(1), F.greatest(n, F.lit(0)))
    points = lambda p: F.transform(F.filter(p, lambda v: (F.size(v) >= 2) & v[0].isNotNull() & v[1].isNotNull()), lambda v: F.struct(v[0].alias("x"), v[1].alias("y")))
    return F.transform(pairs, lambda z: F.struct(F.coalesce(points(z["p"]), _empty_box()).alias("bbox"), F.lit("text").alias("label"), z["t"].alias("content")))


def text_layer_elements(blocks: Column) -> Column:
    """Elements of a text layer's blocks, a line each: spans joined, blank lines left out, the line's box or else that around its spans' boxes."""
    b = F.from_json(blocks, TEXT_LAYER)
    lines = F.flatten(F.transform(F.filter(b, lambda x: x["type"] == 0), lambda x: F.coalesce(x["lines"], F.array().cast(TEXT_LAYER.split("lines: ")[1][:-2]))))
    good = lambda v: F.coalesce((F.size(v) == 4) & F.forall(v, lambda n: n.isNotNull()), F.lit(False))

    def element(line: Column) -> Column:
        own = line["bbox"]
        spans = F.filter(F.transform(line["spans"], lambda s: s["bbox"]), good)
        edge = lambda f, i: f(F.transform(spans, lambda s: s[i]))
        around = rectangle(edge(F.array_min, 0), edge(F.array_min, 1), edge(F.array_max, 2), edge(F.array_max, 3))
        box = F.when(good(own), rectangle(F.get(own, F.lit(0)), F.get(own, F.lit(1)), F.get(own, F.lit(2)), F.get(own, F.lit(3)))).when(F.size(spans) > 0, around).otherwise(_empty_box())
        return F.struct(box.alias("bbox"), F.lit("text").alias("label"), F.array_join(F.transform(line["spans"], lambda s: s["text"]), "").alias("content"))

    return F.filter(F.transform(lines, element), lambda e: ~is_blank(e["content"]))


def media_type(name: Column, content: Column) -> Column:
    """By the first bytes (white space before %PDF- aside), then by the name's ending; else it raises."""
    head = F.hex(F.substring(content, 1, 64))
    pdf = head.rlike("^(?:20|09|0A|0B|0C|0D)*255044462D")
    suffix = F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1))
    return (
        F.when(pdf, "application/pdf").when(head.startswith("89504E470D0A1A0A"), "image/png").when(head.startswith("FFD8FF"), "image/jpeg")
        .when(suffix == ".pdf", "application/pdf").when(suffix == ".png", "image/png").when(suffix.isin(".jpg", ".jpeg"), "image/jpeg")
        .otherwise(F.raise_error(F.concat(F.lit("unsupported input: "), name)))
    )


def data_uri(kind: Column, content: Column) -> Column:
    limit = F.when(kind == "application/pdf", PDF_BYTES).otherwise(IMAGE_BYTES)
    uri = F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.regexp_replace(F.base64(content), "\r\n", ""))
    return F.when(F.octet_length(content) <= limit, uri).otherwise(F.raise_error(F.lit("input is too large")))


def chunks(sizes: Column, pages: int = CHUNK_PAGES, limit: int = PDF_BYTES) -> Column:
    """Numbers of pages of the chunks that an array of page sizes is sent in: each takes as many as fit. A page that alone is too large raises."""
    start = F.struct(F.array().cast("array<int>").alias("done"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("b"))

    def step(a: Column, s: Column) -> Column:
        s = F.when(s <= limit, s).otherwise(F.raise_error(F.lit("a page is too large")).cast("long")).cast("long")
        fits = (a["n"] < pages) & (a["b"] + s <= limit)
        return F.struct(F.when(fits, a["done"]).otherwise(F.array_append(a["done"], a["n"])).alias("done"), F.when(fits, a["n"] + 1).otherwise(1).alias("n"), F.when(fits, a["b"] + s).otherwise(s).alias("b"))

    return F.aggregate(sizes, start, step, lambda a: F.when(a["n"] > 0, F.array_append(a["done"], a["n"])).otherwise(a["done"]))


def even_sample(page_count: Column, most: int = SAMPLE_PAGES) -> Column:
    """At most so many page indexes, evenly spaced from the first to the last; halves are rounded to even."""
    k = F.least(page_count, F.lit(most))
    spread = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.bround(i * (page_count - 1) / (k - 1)).cast("int"))
    return F.when(page_count <= 0, F.array().cast("array<int>")).when(k == 1, F.array(F.lit(0))).otherwise(F.array_sort(F.array_distinct(spread)))


def has_text_layer(pages: DataFrame, least_chars: int = LEAST_CHARS, least_ratio: float = LEAST_RATIO) -> DataFrame:
    """(doc_id, text_ratio, text_layer) by the sampled pages (doc_id, page_index, text): the share with enough characters besides white space."""
    counts = pages.groupBy("doc_id").agg((F.max("page_index") + 1).alias("n"))
    wanted = counts.select("doc_id", F.explode(even_sample(F.col("n"))).alias("page_index"))
    rows = wanted.join(pages, ["doc_id", "page_index"], "left")
    enough = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s", "")) >= least_chars
    return rows.groupBy("doc_id").agg(F.avg(enough.cast("double")).alias("text_ratio")).withColumn("text_layer", F.col("text_ratio") >= least_ratio)


CHAINS: dict[str, Callable[[], Transform]] = {"text_layer": text_layer_chain, "layout": layout_chain}


def chain_for(kind: str) -> Transform:
    """What normalises a backend's elements; backends that aren't named get half-width forms."""
    return CHAINS.get(kind, raster_chain)()


def recognised(documents: DataFrame, backend: Callable[[], Callable[[bytes], list[list[dict]]]], kind: str = "raster") -> DataFrame:
    """Pages of documents (doc_id, content) by a backend, which is made once in each task and gives pages of elements (bbox, label, content)."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        predict = backend()
        for frame in frames:
            rows = [(d, i, [(e.get("bbox", []), e.get("label", "text"), e.get("content", "")) for e in page]) for d, c in zip(frame["doc_id"], frame["content"], strict=True) for i, page in enumerate(predict(c))]
            yield pd.DataFrame({"doc_id": [r[0] for r in rows], "page_index": [r[1] for r in rows], "elements": [[{"bbox": [{"x": float(x), "y": float(y)} for x, y in b], "label": k, "content": t} for b, k, t in r[2]] for r in rows]})

    found = documents.select("doc_id", "content").mapInPandas(run, PAGES)
    return found.select("doc_id", "page_index", chain_for(kind)(F.col("elements")).cast(f"array<{ELEMENT}>").alias("elements"))
