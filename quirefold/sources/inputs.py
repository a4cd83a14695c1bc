"""Folders of input files as documents, and their pages by backends: each file is read by Spark alone, and one that can't be used troubles no other."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.sources.schemas import ELEMENT
from quirefold.sources.shapes import IMAGE_BYTES, PDF_BYTES, chain_for

FILES = "path string, modificationTime timestamp, length long, content binary"
PDF, PNG, JPEG = "application/pdf", "image/png", "image/jpeg"
_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_ELEMENTS = pa.list_(pa.struct([("bbox", pa.list_(_POINT)), ("label", pa.string()), ("content", pa.string())]))
Backend = Callable[[], Callable[[bytes], list[list[dict]]]]


def kind_of(path: Column, content: Column) -> Column:
    """The media type by the first bytes, however much white space stands before a PDF's; then by the name's ending; null for others."""
    start = F.substring(content, 1, 8)
    pdf = F.decode(F.substring(content, 1, 65_536), "ISO-8859-1").rlike(r"\A[ \t-\r]*%PDF-")
    ending = F.lower(F.regexp_extract(path, r"(\.[^./]*)\z", 1))
    return (
        F.when(pdf, PDF).when(F.hex(start) == "89504E470D0A1A0A", PNG).when(F.hex(F.substring(start, 1, 3)) == "FFD8FF", JPEG)
        .when(ending == ".pdf", PDF).when(ending == ".png", PNG).when(ending.isin(".jpg", ".jpeg"), JPEG)
    )


def documents(spark: SparkSession, path: str, glob: str = "*", stream: bool = False) -> DataFrame:
    """(doc_id, size, media_type, content, error) for each file below path, as a table or as a stream of files that arrive.

    doc_id is the file's path; error tells of unsupported and too large files, whose content is null. Files of no bytes are not seen, as Spark passes over them.
    """
    reader = (spark.readStream.schema(FILES) if stream else spark.read).format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    rows = reader.load(path).select(F.col("path").alias("doc_id"), F.col("length").alias("size"), kind_of(F.col("path"), F.col("content")).alias("media_type"), "content")
    most = F.when(F.col("media_type") == PDF, PDF_BYTES).otherwise(IMAGE_BYTES)
    error = F.when(F.col("media_type").isNull(), "unsupported input").when(F.col("size") > most, "the input is too large")
    return rows.withColumn("error", error).withColumn("content", F.when(F.col("error").isNull(), F.col("content")))


def recognise(docs: DataFrame, backends: dict[str, tuple[str, Backend]]) -> DataFrame:
    """(doc_id, page_index, elements, error) of documents() by backends {media type: (kind, factory)}.

    A factory is called once in each task that needs it. A document that can't be read, that no backend takes, that has no pages or whose backend raises gives one row with
    the error and no page; so does one of whose pages any is not as it should be. Elements are normalised by the chain of their backend's kind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str, Callable[[bytes], list[list[dict]]]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                doc, media, content, error = (batch.column(k)[i].as_py() for k in range(4))
                pages: pa.Array = pa.array([None], _ELEMENTS)
                if error is None and media not in backends:
                    error = f"no backend for {media}"
                if error is None:
                    try:
                        if media not in made:
                            made[media] = backends[media][1]()
                        found = [[{"bbox": [{"x": x, "y": y} for x, y in e.get("bbox", [])], "label": e.get("label", "text"), "content": e.get("content", "")} for e in page] for page in made[media](content)]
                        pages = pa.array(found, _ELEMENTS) if found else pages
                        error = None if found else "the backend found no pages"
                    except Exception as e:  # whatever a caller's backend raises
                        pages, error = pa.array([None], _ELEMENTS), f"{type(e).__name__}: {e}"
                n = len(pages)
                index = pa.array([None] if error else range(n), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([doc] * n, pa.string()), pa.array([media] * n, pa.string()), index, pages, pa.array([error] * n, pa.string())], ["doc_id", "media_type", "page_index", "elements", "error"])

    rows = docs.select("doc_id", "media_type", "content", "error").mapInArrow(run, f"doc_id string, media_type string, page_index int, elements array<{ELEMENT}>, error string")
    elements = F.col("elements")
    for media, (kind, _) in backends.items():
        elements = F.when(F.col("media_type") == media, chain_for(kind)(F.col("elements")).cast(f"array<{ELEMENT}>")).otherwise(elements)
    return rows.select("doc_id", "page_index", elements.alias("elements"), "error")
