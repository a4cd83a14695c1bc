"""Problems from a stream of pages that may never end: documents that fall silent are given out, and cancelled ones are dropped, by timers and a control stream."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quirefold.operators.extraction import Grammar
from quirefold.streaming.problems import BLOCK, lines_of_parts, next_parts, page_parts

#: What became of a block: the next one began, its document ended, fell silent, or was cancelled.
NEXT, ENDED, SILENT, CANCELLED = "next", "ended", "silent", "cancelled"
TIMED_BLOCK = f"{BLOCK}, outcome string"
_HELD = "doc_id string, problem_seq int, lines string, completed_page int, outcome string"
_STATE = "seq int, page int, cancelled boolean, lines string, until long"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_store(spark: SparkSession) -> SparkSession:
    """The session with the state store that timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


def with_controls(pages: DataFrame, controls: DataFrame) -> DataFrame:
    """One stream of pages (doc_id, page_index, elements, at) and controls (doc_id, at), each of which cancels a document."""
    cancel = controls.select("doc_id", "at", F.lit(True).alias("cancel"))
    return pages.withColumn("cancel", F.lit(False)).unionByName(cancel, allowMissingColumns=True)


class _Documents(StatefulProcessor):
    """One document's open block. What is kept is the lines of one block, or for a cancelled document that it was, and when its only timer runs out; all go when it does.

    Each call of the state or the timers is a message to the JVM and back, so none is sent for what is known here.
    """

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _STATE)

    def _rows(self, key: tuple, done: list[tuple]) -> Iterator[Row]:
        return (Row(doc_id=key[0], problem_seq=n, lines=lines, completed_page=page, outcome=what) for n, lines, page, what in done)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        known = self.open.get()
        seq, last, cancelled, held, until = known or (0, -1, False, "", None)
        new = sorted(rows, key=lambda r: (r.page_index is None, r.page_index))
        done, over, latest = [], False, max(r.ms for r in new) + self.idle_ms
        if not cancelled and any(r.cancel for r in new):
            done.append((seq, "", last, CANCELLED))
            cancelled, held = True, ""
        for r in new:
            if cancelled or r.cancel:
                continue
            if r.parts is None:
                over = True
            else:
                seq, held, ended = next_parts(seq, held, r.page_index, r.parts, r.opens)
                done += [(*x, NEXT) for x in ended]
                last = r.page_index
        if over and held:
            done.append((seq, held, last, ENDED))
        if until is not None and (over or until != latest):
            self.handle.deleteTimer(until)
        if over and known:
            self.open.clear()
        elif not over:
            self.open.update((seq, last, cancelled, held, latest))
            if until != latest:
                self.handle.registerTimer(latest)
        return self._rows(key, done)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        seq, last, cancelled, held, _ = self.open.get() or (0, -1, True, "", None)
        self.open.clear()
        return self._rows(key, [(seq, held, last, SILENT)] if held and not cancelled else [])

    def close(self) -> None:
        pass


def timed_blocks(events: DataFrame, grammar: Grammar, idle: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """The blocks of a stream of with_controls(), with what became of each (TIMED_BLOCK).

    A document of which nothing came for the time idle, by the watermark of `at`, is given out as far as it came, and what comes later begins anew. A cancelled
    document gives one row without lines, and nothing more until it has been idle as long. So the state holds one block of each document that was heard of within that time, and no more.
    Pages of a document come in order from batch to batch; a page with null elements ends it. The session needs with_store().
    """
    idle_ms = int(_seconds(events.sparkSession, idle) * 1000)
    rows = page_parts(events.withWatermark("at", delay), grammar, "at", "cancel").withColumn("ms", F.unix_millis("at"))
    held = rows.groupBy("doc_id").transformWithState(_Documents(idle_ms), _HELD, "append", "eventTime")
    return held.withColumn("lines", lines_of_parts(F.col("lines")))


def _seconds(spark: SparkSession, interval: str) -> float:
    return float(spark.range(1).select(F.unix_timestamp(F.expr(f"timestamp '1970-01-01 00:00:00' + interval {interval}")) - F.unix_timestamp(F.expr("timestamp '1970-01-01 00:00:00'"))).first()[0])
