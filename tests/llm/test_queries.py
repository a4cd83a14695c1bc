"""The registered queries over a small data set, against DuckDB and straight-line versions."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest
from test_similar import kept_ids

import corpus_pipeline
from quirefold.llm import decontaminate
from quirefold.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data here")


def rows(columns, found):
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in found), sorted(columns)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    for t in ("documents", "labels", "pages"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    want = duckdb.sql(ORACLES[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    assert rows(order, got.select(*order).collect()) == rows(order, want.select(*order).fetchall())


def test_all_operators_are_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = {(r.doc_id, r.text) for r in kept.collect()} if name != "shard" else None
        out = stage(spark, kept, SF)
        if name == "shard":
            assert out.count() == kept.count()
            break
        assert out.columns == docs.columns
        after = [(r.doc_id, r.text) for r in out.collect()]
        assert set(after) <= before
        gone = before - set(after)
        if name == "near_dedup":
            assert sorted(i for i, _ in after) == kept_ids(sorted(before))  # five-word shingles, similarity of 0.8
        if name == "decontamination":
            items = [(r.item_id, decontaminate._grams(decontaminate.tokens(r.text.lower()))) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            for _, text in gone:
                own = decontaminate._grams(decontaminate.tokens(text.lower()))
                assert any(len(g & own) >= 0.8 * len(g) for _, g in items)
        kept = out
        sizes.append(len(after))
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3]
    assert corpus_pipeline.run(spark, SF).count() == sizes[-1]
