from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quirefold.operators import joblog as jl
from quirefold.operators import ranges as rg
from quirefold.sources import page_store as ps
from quirefold.sources import shapes
from quirefold.sources.schemas import PAGES
from quirefold.streaming import events as se


def store(path, *records):
    path.write_text("".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) + "\n" for r in records), encoding="utf-8")


HEADER, END = {"type": "header", "version": 1}, {"type": "complete"}


def page(*texts):
    return {"type": "page", "elements": [{"bbox": [{"x": 1, "y": 2}], "label": "text", "content": t} for t in texts]}


def test_stored_pages(spark, tmp_path):
    store(tmp_path / "a.jsonl", HEADER, page("x", "ü  y"), page(), END)
    got = ps.read_pages(spark, str(tmp_path)).orderBy("page_index").collect()
    assert [[e.content for e in r.elements] for r in got] == [["x", "ü  y"], []] and got[0].elements[0].bbox[0].x == 1


@pytest.mark.parametrize("records", [[HEADER], [HEADER, page("x")], [{"type": "header", "version": 2}, END], [HEADER, "{bad\n", END], [HEADER, {"type": "page"}, END], [page("x"), END], [HEADER, END, END]])
def test_files_are_whole_or_nothing(spark, tmp_path, records):
    store(tmp_path / "bad.jsonl", *records)
    store(tmp_path / "good.jsonl", HEADER, page("x"), END)
    with pytest.raises(Exception, match="incomplete or invalid"):
        ps.read_pages(spark, str(tmp_path)).collect()
    assert [r.doc_id.rsplit("/", 1)[1] for r in ps.read_pages(spark, str(tmp_path), "drop").collect()] == ["good.jsonl"]


def test_pages_round_trip(spark, tmp_path):
    rows = [("d", 1, [([(1.0, 2.0)], "text", "ü\nz")]), ("d", 0, []), ("e", 0, [([], "table", "")])]
    ps.write_pages(spark.createDataFrame(rows, PAGES), str(tmp_path / "out"))
    got = ps.read_pages(spark, str(tmp_path / "out" / "*")).collect()
    assert sorted((r.doc_id.split("doc_id=")[1][0], r.page_index, [(e.label, e.content) for e in r.elements]) for r in got) == [("d", 0, []), ("d", 1, [("text", "ü\nz")]), ("e", 0, [("table", "")])]


def requests(spark, *lists):
    return spark.createDataFrame([("d", i, x) for i, x in enumerate(lists)], "doc_id string, request_id int, page_indexes array<int>")


def book(spark, n=3):
    return spark.createDataFrame([("d", i, [([], "text", str(i))]) for i in range(n)], PAGES)


def test_selection_keeps_order_and_repeats(spark):
    got = ps.select_pages(book(spark), requests(spark, [2, 0, 2])).orderBy("position").collect()
    assert [r.elements[0].content for r in got] == ["2", "0", "2"]


@pytest.mark.parametrize("bad", [[], [-1], [3]])
def test_bad_selections(spark, bad):
    with pytest.raises(Exception, match="must not be empty|no such page"):
        ps.select_pages(book(spark), requests(spark, bad)).collect()


def test_misses_and_lru(spark):
    cached = spark.createDataFrame([("d", 1)], "doc_id string, page_index int")
    got = ps.cache_misses(requests(spark, [2, 0, 2, 1]), cached).orderBy("position").collect()
    assert [r.page_index for r in got] == [2, 0]
    accesses = spark.createDataFrame([("d", i, p) for i, p in enumerate([0, 1, 0, 2])], "doc_id string, at int, page_index int")
    assert {r.page_index for r in ps.lru_kept(accesses, 2).collect()} == {0, 2}


def test_page_counts(spark):
    assert [tuple(r) for r in ps.page_count_errors(book(spark, 3), book(spark, 2)).collect()] == [("d", 3, 2)] and ps.page_count_errors(book(spark), book(spark)).count() == 0




def test_layout_response(spark):
    raw = json.dumps({"layout_details": [[{"label": "text", "content": "a", "bbox_2d": [0.1, 0.2, 0.5, 0.4], "width": 100, "height": 200}, {"bbox_2d": [1], "width": 1, "height": 1}], None]})
    got = spark.createDataFrame([(raw,)], "s string").select(shapes.layout_elements(F.col("s")).alias("v")).first().v
    assert [(p.x, p.y) for p in got[0][0].bbox] == [(10, 40), (50, 40), (50, 80), (10, 80)]
    assert (got[0][1].label, got[0][1].content, got[0][1].bbox) == ("text", "", []) and got[1] == []


@pytest.mark.parametrize(("raw", "want"), [({"rec_texts": ["a", "b"], "rec_polys": [[[1, 2], [3]]], "dt_polys": [[], []]}, [("a", [(1, 2)])]), ({"rec_texts": ["a"], "dt_polys": [[[5, 6]], [[1, 1]]]}, [("a", [(5, 6)])]), ({"rec_texts": []}, [])])
def test_raster_result(spark, raw, want):
    got = spark.createDataFrame([(json.dumps(raw),)], "s string").select(shapes.raster_elements(F.col("s")).alias("v")).first().v
    assert [(e.content, [(p.x, p.y) for p in e.bbox]) for e in got] == want


def test_text_layer(spark):
    raw = json.dumps([{"type": 1}, {"type": 0, "lines": [{"bbox": [0, 0, 9, 9], "spans": [{"text": "a"}, {"text": "b"}]}, {"spans": [{"text": "c", "bbox": [1, 2, 3, 4]}, {"text": "", "bbox": [0, 3, 2, 9]}]}, {"spans": [{"text": " "}]}]}])
    got = spark.createDataFrame([(raw,)], "s string").select(shapes.text_layer_elements(F.col("s")).alias("v")).first().v
    assert [(e.content, (e.bbox[0].x, e.bbox[0].y), (e.bbox[2].x, e.bbox[2].y)) for e in got] == [("ab", (0, 0), (9, 9)), ("c", (0, 2), (3, 9))]


def test_media_types(spark):
    rows = [("x.bin", b" %PDF-1", "application/pdf"), ("x.pdf", b"\x89PNG\r\n\x1a\n", "image/png"), ("x", b"\xff\xd8\xff", "image/jpeg"), ("x.JPG", b"?", "image/jpeg")]
    got = spark.createDataFrame(rows, "n string, c binary, want string").select(shapes.media_type(F.col("n"), F.col("c")).alias("v"), "want").collect()
    assert all(r.v == r.want for r in got)
    with pytest.raises(Exception, match="unsupported input: x.txt"):
        spark.createDataFrame([("x.txt", b"?")], "n string, c binary").select(shapes.media_type(F.col("n"), F.col("c"))).collect()


def test_chunks(spark):
    got = spark.createDataFrame([([1] * 45,), ([],), ([30, 30, 30],)], "s array<int>").select(shapes.chunks(F.col("s")).alias("v"), shapes.chunks(F.col("s"), 20, 60).alias("w")).collect()
    assert [r.v for r in got] == [[20, 20, 5], [], [3]] and got[2].w == [2, 1]
    with pytest.raises(Exception, match="too large"):
        spark.createDataFrame([([61],)], "s array<int>").select(shapes.chunks(F.col("s"), 20, 60)).collect()


def test_even_sample(spark):
    want = [[] if not n else sorted({round(i * (n - 1) / (k - 1)) for i in range(k)}) if (k := min(n, 5)) > 1 else [0] for n in range(40)]
    got = spark.range(40).orderBy("id").select(shapes.even_sample(F.col("id").cast("int")).alias("v")).collect()
    assert [r.v for r in got] == want


def test_recognition_is_plugged_in(spark):
    backend = lambda: lambda content: [[{"content": c.decode()}] for c in bytes(content).split(b"|")]
    got = shapes.recognised(spark.createDataFrame([("d", "Ａ|b".encode())], "doc_id string, content binary"), backend).orderBy("page_index").collect()
    assert [r.elements[0].content for r in got] == ["A", "b"]


LOG = "job_id string, sequence int, type string, created_at timestamp"


def log(spark, *types, job="j"):
    return spark.createDataFrame([(job, i + 1, t, dt.datetime(2026, 1, 1, 0, i)) for i, t in enumerate(types)], LOG)


def test_cursor(spark):
    events = log(spark, "queued", "started", "page", "completed")
    first = jl.updates(events, 0, 2).orderBy("sequence").collect()
    assert [r.sequence for r in first] == [1, 2] and {(r.next_cursor, r.has_more) for r in first} == {(2, True)}
    rest = jl.updates(events, 2, 2).collect()
    assert {r.sequence for r in rest} == {3, 4} and not any(r.has_more for r in rest)
    for bad in ((-1, 5), (0, 0), (0, 501)):
        with pytest.raises(ValueError):
            jl.updates(events, *bad)


def test_states(spark):
    events = log(spark, "queued", "running").unionByName(log(spark, "queued", "completed", job="k"))
    states = jl.status(events)
    assert {(r.job_id, r.status) for r in jl.recovered(states).collect()} == {("j", "interrupted"), ("k", "completed")}
    assert {r.job_id: r.error for r in jl.results(states.select("job_id", "status"), states.select("job_id", "events")).collect()} == {"j": "job is not complete: running", "k": None}
    new = spark.createDataFrame([("j", "a"), ("j", "b"), ("n", "c")], "job_id string, type string")
    assert {(r.job_id, r.type, r.sequence) for r in jl.appended(events, new, "type").collect()} == {("j", "a", 3), ("j", "b", 4), ("n", "c", 1)}


def test_admission(spark):
    jobs = spark.createDataFrame([("q", i) for i in range(5)], "queue string, job_id int")
    assert {r.job_id for r in jl.admitted(jobs, 3).where("admitted").collect()} == {0, 1, 2}


def test_events_are_seen_once(spark, tmp_path):
    events = log(spark, "queued", "started")
    for _ in range(2):
        se.append_events(events, str(tmp_path / "in"))
        se.run_once(se.follow_events(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r.sequence for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]
    table = se.follow_status(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True).start()
    table.awaitTermination()
    assert [r.status for r in spark.sql("SELECT * FROM latest").collect()] == ["started"]


def test_saved_patterns(spark):
    saved = spark.createDataFrame([(1, "p", "s", 0, 3, "first"), (2, "p", "s", 0, 3, "later"), (3, None, "t", 0, 3, "x"), (4, None, "t", 0, 3, "y")], "ord int, path string, source string, start int, stop int, patterns string")
    wanted = spark.createDataFrame([("p", "q", 0, 1), ("r", "t", 0, 3), ("r", "s", 0, 3), ("r", "u", 0, 1)], "path string, source string, start int, stop int")
    assert {(r.path, r.source): r.patterns for r in rg.lookup_patterns(wanted, saved).collect()} == {("p", "q"): "later", ("r", "t"): "x", ("r", "s"): "first", ("r", "u"): None}
