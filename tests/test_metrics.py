"""One metric alone is what the whole evaluation says of it."""

from __future__ import annotations

import random

import pytest

from quirefold.operators import evaluation as ev
from quirefold.sources.schemas import PAGES, PROBLEMS


def test_single_metrics(spark):
    text = [([], "text", "1. What is asked here? A. yes B. no 答案 A")]
    pages = spark.createDataFrame([(d, i, text) for d in ("good", "failed", "none", "odd") for i in range(2)] + [("blank", 0, [])], PAGES)
    options = [("A", "yes"), ("B", "no")]
    problems = spark.createDataFrame(
        [("good", 1, "1", "What is asked here?", "A", options, "", 0, 0), ("good", 2, "3", "short", "A", options[:1], "x", 1, 1), ("failed", 1, "①", "What is asked here?", "", options, "", 0, 0), ("odd", 1, "", "", "", [], "", 0, 0), ("odd", 2, "2", None, None, None, None, 0, 1)],
        PROBLEMS,
    )
    whole = {r.doc_id: r for r in ev.evaluate(pages, problems).collect()}
    assert any(whole["good"][m] not in (0.0, 1.0) for m in ev.METRICS) and all(whole["failed"][m] == 0.0 for m in ev.METRICS)
    for m in ev.METRICS:
        got = {r.doc_id: r[m] for r in ev.evaluate_metric(m, pages, problems).collect()}
        assert got == pytest.approx({d: r[m] for d, r in whole.items()}), m


def test_a_mean_at_its_bound_is_not_below_it(spark):
    """Ten problems whose option scores sum to 6 in any order of adding, though not in doubles."""
    off, full = [("B", "x"), ("C", "y")], [("A", "x"), ("B", "y")]
    rng, rows = random.Random(0), []
    for d in range(60):
        given = [off] * 6 + [full] + [[]] * 3
        rng.shuffle(given)
        rows += [(f"d{d}", i, str(i), "What is asked here?", "", o, "", 0, 0) for i, o in enumerate(given)]
    pages = spark.createDataFrame([(f"d{d}", 0, [([], "text", "what is asked here")]) for d in range(60)], PAGES)
    found = ev.evaluate(pages, spark.createDataFrame(rows, PROBLEMS)).collect()
    assert {w for r in found for w in r.warnings} == set()
