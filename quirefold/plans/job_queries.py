"""Queries over job logs, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.operators import joblog as jl
from quirefold.sources.adapters import job_events, table
from quirefold.sources.result_store import ResultStore, records
from quirefold.sources.scratch import scratch_path
from quirefold.streaming import events as se

_EVENTS = "e AS (SELECT CAST(user_id AS VARCHAR) AS job_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS sequence, event_type AS type, ts AS created_at, value FROM events)"
_LAST = "s AS (SELECT job_id, arg_max(type, sequence) AS status, max(sequence) AS last_sequence, count(*) AS events FROM e GROUP BY job_id)"


def event_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_events(spark, sf_dir).select("job_id", "sequence", "type")


def updates_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jl.updates(job_events(spark, sf_dir), 2, 5).select("job_id", "sequence", "type", "next_cursor", "has_more")


def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jl.status(job_events(spark, sf_dir)).select("job_id", "status", "last_sequence", "events")


def recovery_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jl.recovered(jl.status(job_events(spark, sf_dir)), ("view", "click")).select("job_id", "status", "last_sequence")


def result_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = jl.status(job_events(spark, sf_dir))
    states = states.withColumn("status", F.when(F.col("status") == "purchase", "completed").otherwise(F.col("status")))
    return jl.results(states.select("job_id", "status"), states.select("job_id", "events")).select("job_id", F.when(F.col("error").isNull(), F.col("events")).alias("events"), "error")


def job_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jl.counters(job_events(spark, sf_dir), F.col("type") == "view", F.floor("value"))
    return rows.select("job_id", "sequence", "processed_pages", "problem_count")


def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("queue"), F.col("o_orderkey").alias("job_id"))
    return jl.admitted(jobs, 3, "job_id")


def append_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = job_events(spark, sf_dir)
    new = log.where("type = 'click'").select("job_id", F.col("created_at").alias("at"))
    return jl.appended(log, new, "at").select("job_id", "sequence")


def streaming_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that was written twice, followed as a stream: each event once."""
    at = scratch_path(spark, "log")
    log = job_events(spark, sf_dir)
    for _ in range(2):
        se.append_events(log, f"{at}/in")
    se.run_once(se.follow_events(spark, f"{at}/in", "10000 days"), f"{at}/out", f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/out").select("job_id", "sequence", "type")


def _lifecycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as the lives of jobs: the first two put it in the queue and start it, and the others are of all kinds."""
    kinds = F.array(*[F.lit(x) for x in ("page", "page", "cancellation_requested", "page", "completed", "error", "cancelled", "started")])
    kind = F.when(F.col("sequence") == 1, "queued").when(F.col("sequence") == 2, "started").otherwise(F.get(kinds, (F.floor(F.col("value")) % 8).cast("int")))
    return job_events(spark, sf_dir).select("job_id", "sequence", kind.alias("type"), "created_at")


def job_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jl.transitions(_lifecycles(spark, sf_dir)).select("job_id", "sequence", "type", "status_before", "status", "error")


def job_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log after a sweep that was written twice, and a second sweep."""
    log = _lifecycles(spark, sf_dir)
    at = F.timestamp_seconds(F.lit(1_704_067_200))
    first = jl.recovery_events(log, at)
    once = jl.upserted(jl.upserted(log, first), first)
    return jl.upserted(once, jl.recovery_events(once, at)).select("job_id", "sequence", "type", "message")


def _stored(spark: SparkSession, sf_dir: str) -> ResultStore:
    """The records of all customers as jobs, an order a problem, written twice under one name; then those of some jobs again, without their later half."""
    store = ResultStore(spark, scratch_path(spark, "results"))
    orders = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    none = F.lit("")
    rows = orders.select(
        F.col("c_custkey").cast("string").alias("job_id"), F.col("o_orderkey").alias("problem_seq"), F.col("o_orderkey").cast("string").alias("number"), F.col("o_orderpriority").alias("question"),
        F.col("o_orderstatus").alias("answer"), F.array(F.struct(F.lit("A").alias("label"), F.col("o_orderpriority").alias("text"))).alias("options"), none.alias("analysis"),
    )
    for _ in range(2):
        store.write(records(rows), "all")
    again = F.col("job_id").cast("long") % 5 == 0
    store.write(records(rows.where(again & ((F.col("problem_seq") % 2 == 0) | F.col("problem_seq").isNull()))), "again")
    return store


def result_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _stored(spark, sf_dir).read()
    return found.select("job_id", "status", "problem_count", F.array_join(F.transform("problems", lambda p: F.concat(p["number"], F.lit("="), p["question"], p["answer"])), ",").alias("problems"))


def result_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that ask for the record of their customer's neighbours, some of whom no state is known of."""
    states = jl.status(job_events(spark, sf_dir)).select("job_id", F.when(F.col("status") == "purchase", "completed").otherwise(F.col("status")).alias("status"))
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("asked_by"), (F.col("o_custkey") * 3 % 2000).cast("string").alias("job_id"))
    return _stored(spark, sf_dir).ask(asked, states).select("asked_by", "job_id", "problem_count", "error")


QUERIES = {
    "event_sequence": event_sequence,
    "updates_cursor": updates_cursor,
    "job_status": job_status,
    "recovery_sweep": recovery_sweep,
    "result_gate": result_gate,
    "job_counters": job_counters,
    "admission": admission,
    "append_sequence": append_sequence,
    "streaming_events": streaming_events,
    "job_transitions": job_transitions,
    "job_recovery": job_recovery,
    "result_records": result_records,
    "result_lookup": result_lookup,
}

_LIVES = f"""{_EVENTS},
l AS (SELECT job_id, sequence, CASE sequence WHEN 1 THEN 'queued' WHEN 2 THEN 'started' ELSE ['page', 'page', 'cancellation_requested', 'page', 'completed', 'error', 'cancelled', 'started'][CAST(floor(value) AS BIGINT) % 8 + 1] END AS type FROM e),
m AS (SELECT *, CASE type WHEN 'queued' THEN 'queued' WHEN 'started' THEN 'running' WHEN 'cancellation_requested' THEN 'cancelling' WHEN 'completed' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'cancelled' THEN 'cancelled' END AS to_status FROM l),
t AS (SELECT *, coalesce(last_value(to_status IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS status_before FROM m)"""

_RECORDS = """o AS (SELECT c_custkey, o_orderkey AS k, o_orderkey || '=' || o_orderpriority || o_orderstatus AS p FROM customer LEFT JOIN orders ON c_custkey = o_custkey),
again AS (SELECT DISTINCT c_custkey FROM o WHERE c_custkey % 5 = 0 AND (k IS NULL OR k % 2 = 0)),
r AS (SELECT CAST(o.c_custkey AS VARCHAR) AS job_id, 'completed' AS status, CAST(count(k) AS INT) AS problem_count, coalesce(string_agg(p, ',' ORDER BY k), '') AS problems FROM o LEFT JOIN again USING (c_custkey) WHERE again.c_custkey IS NULL OR k IS NULL OR k % 2 = 0 GROUP BY o.c_custkey)"""

ORACLES = {
    "event_sequence": f"WITH {_EVENTS} SELECT job_id, sequence, type FROM e",
    "updates_cursor": f"WITH {_EVENTS}, c AS (SELECT job_id, count(*) > 5 AS has_more, min(7) AS cap, max(sequence) AS last FROM e WHERE sequence > 2 GROUP BY job_id) SELECT job_id, sequence, type, CAST(least(cap, last) AS INT) AS next_cursor, has_more FROM e JOIN c USING (job_id) WHERE sequence > 2 AND sequence <= 7",
    "job_status": f"WITH {_EVENTS}, {_LAST} SELECT * FROM s",
    "recovery_sweep": f"WITH {_EVENTS}, {_LAST} SELECT job_id, CASE WHEN status IN ('view', 'click') THEN 'interrupted' ELSE status END AS status, CAST(last_sequence + (status IN ('view', 'click'))::INT AS INT) AS last_sequence FROM s",
    "result_gate": f"WITH {_EVENTS}, {_LAST} SELECT job_id, CASE WHEN status = 'purchase' THEN events END AS events, CASE WHEN status <> 'purchase' THEN 'job is not complete: ' || status END AS error FROM s",
    "job_counters": f"WITH {_EVENTS} SELECT job_id, sequence, CAST(sum((type = 'view')::INT) OVER w AS BIGINT) AS processed_pages, CAST(sum(CAST(floor(value) AS BIGINT)) OVER w AS BIGINT) AS problem_count FROM e WINDOW w AS (PARTITION BY job_id ORDER BY sequence)",
    "admission": "SELECT o_custkey AS queue, o_orderkey AS job_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 3 AS admitted FROM orders",
    "append_sequence": f"WITH {_EVENTS}, m AS (SELECT job_id, max(sequence) AS last FROM e GROUP BY job_id) SELECT job_id, CAST(last + row_number() OVER (PARTITION BY job_id ORDER BY created_at) AS INT) AS sequence FROM e JOIN m USING (job_id) WHERE type = 'click'",
    "streaming_events": f"WITH {_EVENTS} SELECT job_id, sequence, type FROM e",
    "result_records": f"WITH {_RECORDS} SELECT * FROM r",
    "result_lookup": f"WITH {_EVENTS}, {_LAST}, {_RECORDS}, q AS (SELECT o_orderkey AS asked_by, CAST(o_custkey * 3 % 2000 AS VARCHAR) AS job_id FROM orders), a AS (SELECT q.*, r.problem_count, CASE WHEN s.job_id IS NULL THEN 'no such job' WHEN s.status <> 'purchase' THEN 'job is not complete: ' || s.status WHEN r.job_id IS NULL THEN 'the job''s result is missing' END AS error FROM q LEFT JOIN s USING (job_id) LEFT JOIN r USING (job_id)) SELECT asked_by, job_id, CASE WHEN error IS NULL THEN problem_count END AS problem_count, error FROM a",
    "job_transitions": f"WITH {_LIVES} SELECT job_id, sequence, type, status_before, coalesce(to_status, status_before) AS status, CASE WHEN status_before = '' AND type = 'queued' OR status_before = 'queued' AND type IN ('started', 'error', 'cancelled') OR status_before IN ('running', 'cancelling') AND type IN ('page', 'completed', 'error', 'cancelled') OR status_before = 'running' AND type = 'cancellation_requested' THEN NULL ELSE type || ' is not allowed when ' || status_before END AS error FROM t",
    "job_recovery": f"WITH {_LIVES}, z AS (SELECT job_id, max(sequence) AS n, arg_max(coalesce(to_status, status_before), sequence) AS status FROM t GROUP BY job_id) SELECT job_id, sequence, type, NULL AS message FROM l UNION ALL SELECT job_id, n + 1, 'interrupted', 'service stopped before the job completed' FROM z WHERE status IN ('queued', 'running', 'cancelling')",
}
