"""Every query of the library, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quirefold.plans import book_queries, job_queries, page_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = page_queries.QUERIES | book_queries.QUERIES | job_queries.QUERIES
ORACLES: dict[str, str] = page_queries.ORACLES | book_queries.ORACLES | job_queries.ORACLES
