"""What the corpus operators share: words, working tables and literals of a bounded size."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.sources.scratch import discard, scratch_path, shared_dir
from quirefold.sources.scratch import written as cut

__all__ = ["bind", "cut", "discard", "fresh", "n_words_of", "scratch_path", "shared_dir", "small", "words_of"]

#: What separates words.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A side of a join is broadcast up to so many rows and bytes; above, Spark shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 8_000_000


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SPACE_CLASS}+"))


def n_words_of(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def bind(value: Column, body) -> Column:
    """body(value), with value computed once a row however often body names it."""
    return F.transform(F.array(value), body)[0]


def fresh(*names: str) -> list[str]:
    """Column names that no table has, for columns beside those of a caller's table."""
    mark = uuid.uuid4().hex
    return [f"{n}_{mark}" for n in names]


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has few rows by count, and few bytes as JSON; otherwise as it is, for a shuffle join. df should be cheap to count."""
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("size")).first()
    return F.broadcast(df) if found["n"] <= rows and (found["size"] or 0) <= size else df
