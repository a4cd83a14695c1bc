"""Problems from a stream of pages: the lines of each document's open problem are kept between batches, and a block of lines is given out when the next begins or the document ends."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quirefold.operators.extraction import Grammar, problems_of_blocks, told_lines

_LINE = "struct<page_index: int, element_index: int, line: string>"
BLOCK = f"doc_id string, problem_seq int, lines array<{_LINE}>, completed_page int"
_HELD = "doc_id string, problem_seq int, lines string, completed_page int"
_STATE = "seq int, lines string, page int"


def page_parts(pages: DataFrame, grammar: Grammar, *carried: str) -> DataFrame:
    """(doc_id, page_index, ..., parts, opens): each page's lines cut at its headers, each part as text (JSON objects, joined by commas), and whether the first begins with a header. Pages with null elements have null parts.

    A state that holds text is handed on as it is: Python looks at parts, which are far fewer than lines, and at no line.
    """
    rows = pages.select("doc_id", "page_index", *carried, told_lines(F.col("elements"), grammar).alias("told"))
    starts = F.filter(F.transform("told", lambda x, i: F.when(x["head"] | (i == 0), i)), lambda i: i.isNotNull())
    lines = F.transform("told", lambda x: F.struct(F.col("page_index").cast("int").alias("page_index"), x["element_index"].alias("element_index"), x["line"].alias("line")))
    rows = rows.select("doc_id", "page_index", *carried, lines.alias("lines"), starts.alias("starts"), F.coalesce(F.get("told", F.lit(0))["head"], F.lit(False)).alias("opens"))

    def text(start: Column, j: Column) -> Column:
        written = F.to_json(F.slice("lines", start + 1, F.coalesce(F.get("starts", j + 1), F.size("lines")) - start))
        return F.substr(written, F.lit(2), F.length(written) - 2)

    return rows.select("doc_id", "page_index", *carried, F.transform("starts", text).alias("parts"), "opens")


def lines_of_parts(parts: Column) -> Column:
    """The lines that page_parts() made text of."""
    return F.from_json(F.concat(F.lit("["), parts, F.lit("]")), f"array<{_LINE}>", {"maxStringLen": str(2**31 - 1)})


def next_parts(seq: int, held: str, page: int, parts: list[str], opens: bool) -> tuple[int, str, list[tuple[int, str, int]]]:
    """The open problem (seq, held) after a page's parts, and the blocks (seq, text, page) that ended there. Lines before the first header are dropped."""
    done = []
    for i, part in enumerate(parts):
        if i or opens:
            if held:
                done.append((seq, held, page))
            seq, held = seq + 1, part
        elif seq:
            held = f"{held},{part}"
    return seq, held, done


def stream_blocks(pages: DataFrame, grammar: Grammar) -> DataFrame:
    """The blocks of a stream of pages (doc_id, page_index, elements): a problem's header and the lines up to the next. A page with null elements ends its document.

    Pages of a document must come in order from batch to batch; within a batch they are sorted. Lines are cleaned and told apart
    before they reach the state, which holds the lines of one open problem as text.
    """

    def split(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        seq, held, last = state.get if state.exists else (0, "", -1)
        rows = [json.loads(x) for frame in frames for x in frame["page"].tolist()]
        done, over = [], False
        for row in sorted(rows, key=lambda r: (r.get("page_index") is None, r.get("page_index"))):
            page, parts = row.get("page_index"), row.get("parts")
            if parts is None:
                over = True
            else:
                seq, held, ended = next_parts(seq, held, page, parts, row["opens"])
                done += ended
                last = page
        if over and held:
            done.append((seq, held, last))
        if over:
            state.remove()
        else:
            state.update((seq, held, last))
        if done:
            yield pd.DataFrame([(key[0], *x) for x in done], columns=["doc_id", "problem_seq", "lines", "completed_page"])

    page = F.to_json(F.struct("page_index", "parts", "opens")).alias("page")
    held = page_parts(pages, grammar).select("doc_id", page).groupBy("doc_id").applyInPandasWithState(split, _HELD, _STATE, "append", GroupStateTimeout.NoTimeout)
    return held.withColumn("lines", lines_of_parts(F.col("lines")))


def block_problems(blocks: DataFrame, grammar: Grammar) -> DataFrame:
    """The problems of blocks, by the same grammar as whole documents: each block is a problem's lines."""
    lines = F.sort_array("lines")["line"]
    return problems_of_blocks(blocks.select("doc_id", "problem_seq", lines.alias("lines"), F.array_min("lines")["page_index"].alias("header_page"), "completed_page"), grammar)


def with_document_ends(pages: DataFrame) -> DataFrame:
    """Pages, and after the last of each document the record that ends it."""
    ends = pages.groupBy("doc_id").agg((F.max("page_index") + 1).alias("page_index"))
    return pages.unionByName(ends, allowMissingColumns=True)
