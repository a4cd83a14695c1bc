"""Result records: staging, commits, replays, and what asking for a record tells."""

from __future__ import annotations

import json
import threading

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quirefold.sources import result_store as rs

PROBLEMS = "job_id string, problem_seq int, number string, question string, answer string, options array<struct<label: string, text: string>>, analysis string"


def problems(spark, jobs):
    rows = [(j, i if q is not None else None, str(i), q, "A", [("A", "x")], "") for j, qs in jobs.items() for i, q in enumerate(qs or [None])]
    return rs.records(spark.createDataFrame(rows, PROBLEMS))


def store(spark, tmp_path):
    return rs.ResultStore(spark, str(tmp_path / "results"))


def shown(found):
    return {r.job_id: [p.question for p in r.problems] for r in found.collect()}


def test_records_and_their_json(spark):
    rows = problems(spark, {"a": ["q0", "q1"], "b": []}).withColumn("json", rs.as_json()).collect()
    by = {r.job_id: json.loads(r.json) for r in rows}
    assert by["a"]["problem_count"] == 2 and [p["question"] for p in by["a"]["problems"]] == ["q0", "q1"]
    assert by["b"] == {"job_id": "b", "status": "completed", "problem_count": 0, "problems": []}


def test_staged_records_are_not_seen_until_committed(spark, tmp_path):
    s = store(spark, tmp_path)
    assert s.read().collect() == [] and s.batches() == []
    folder = s.stage(problems(spark, {"a": ["q"]}))
    assert s.read().collect() == []
    assert s.commit("first", folder) and shown(s.read()) == {"a": ["q"]}


def test_a_replay_changes_nothing(spark, tmp_path):
    s = store(spark, tmp_path)
    assert s.write(problems(spark, {"a": ["q"], "b": ["r"]}), "0")
    assert not s.write(problems(spark, {"a": ["other"]}), "0")
    assert not s.commit("0", s.stage(problems(spark, {"a": ["other"]})))  # staged before the failure, committed again after it
    assert shown(s.read()) == {"a": ["q"], "b": ["r"]} and s.batches() == ["0"]
    assert len([*(tmp_path / "results" / "batches").iterdir()]) == 1


def test_the_last_commit_of_a_job_holds(spark, tmp_path):
    s = store(spark, tmp_path)
    for n, jobs in enumerate([{"a": ["1"], "b": ["1"]}, {"a": ["2", "3"]}, {"c": []}]):
        s.write(problems(spark, jobs), str(n))
    assert shown(s.read()) == {"a": ["2", "3"], "b": ["1"], "c": []}


def test_writers_at_the_same_time_lose_nothing(spark, tmp_path):
    s = store(spark, tmp_path)
    folders = {str(n): s.stage(problems(spark, {f"j{n}": ["q"]})) for n in range(6)}
    threads = [threading.Thread(target=s.commit, args=x) for x in folders.items()]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(s.batches()) == sorted(folders) and len(shown(s.read())) == 6


def test_what_asking_tells(spark, tmp_path):
    s = store(spark, tmp_path)
    s.write(problems(spark, {"done": ["q"], "early": ["q"]}), "0")
    states = spark.createDataFrame([("done", "completed"), ("early", "running"), ("lost", "completed"), (None, "completed")], "job_id string, status string")
    jobs = spark.createDataFrame([("done", 1), ("done", 1), ("early", 2), ("lost", 3), ("never", 4), (None, 5)], "job_id string, error int").withColumnRenamed("error", "n")
    got = sorted((r.n, r.job_id, r.problem_count, r.error) for r in s.ask(jobs, states).collect())
    assert got[:2] == [(1, "done", 1, None)] * 2
    assert [x[3] for x in got[2:]] == ["job is not complete: running", "the job's result is missing", "no such job", "no such job"]
    assert all(x[2] is None for x in got[2:])
    with pytest.raises(PySparkException, match="never: no such job"):
        s.ask(jobs.where("n = 4"), states, on_error="fail").collect()
    assert s.ask(jobs.where("n = 1"), states, on_error="fail").count() == 2


def test_a_stream_run_again_is_shown_once(spark, tmp_path):
    s = store(spark, tmp_path)
    rows = problems(spark, {"a": ["q"]}).select("job_id", F.explode("problems").alias("p")).select("job_id", F.lit(0).alias("problem_seq"), "p.*")
    rows.write.parquet(str(tmp_path / "in"))
    for checkpoint in ("c1", "c1", "c2"):  # the second finds nothing new, the third has lost its checkpoint
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        s.follow(stream, str(tmp_path / checkpoint), "stream", rs.records).awaitTermination()
    assert s.batches() == ["stream-0"] and shown(s.read()) == {"a": ["q"]}
