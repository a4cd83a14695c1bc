"""Job logs: cursors, states, recovery and admission over an append-only event table (job_id, sequence, type, created_at, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN = ("queued", "running", "cancelling")
MAX_LIMIT, CAPACITY = 500, 32


def updates(events: DataFrame, after: int = 0, limit: int = 100) -> DataFrame:
    """Each job's events beyond a cursor: job_id, sequence, type, next_cursor, has_more. One event more than limit is looked at."""
    if after < 0 or not 1 <= limit <= MAX_LIMIT:
        raise ValueError("after must be 0 or more, and limit from 1 to 500")
    order = Window.partitionBy("job_id").orderBy("sequence")
    rows = events.where(F.col("sequence") > after).withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit + 1)
    job = Window.partitionBy("job_id")
    rows = rows.withColumn("has_more", F.max("n").over(job) > limit).where(F.col("n") <= limit)
    return rows.withColumn("next_cursor", F.max("sequence").over(job)).drop("n")


def numbered(events: DataFrame, *order: str) -> DataFrame:
    """Events with their sequence in their job, from 1."""
    return events.withColumn("sequence", F.row_number().over(Window.partitionBy("job_id").orderBy(*order)))


def appended(log: DataFrame, new: DataFrame, *order: str) -> DataFrame:
    """new (job_id, ...) numbered on from the log's last sequence in each job."""
    last = log.groupBy("job_id").agg(F.max("sequence").alias("_last"))
    return numbered(new, *order).join(last, "job_id", "left").withColumn("sequence", F.col("sequence") + F.coalesce("_last", F.lit(0))).drop("_last")


def status(events: DataFrame, state: Column | None = None) -> DataFrame:
    """job_id, status (that of the last event), last_sequence, events, created_at, updated_at."""
    state = F.col("type") if state is None else state
    return events.groupBy("job_id").agg(F.max_by(state, "sequence").alias("status"), F.max("sequence").alias("last_sequence"), F.count("*").alias("events"), F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"))


def counters(events: DataFrame, processed: Column, problems: Column) -> DataFrame:
    """Running totals by job: processed_pages and problem_count at each event."""
    running = Window.partitionBy("job_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumns({"processed_pages": F.sum(processed.cast("long")).over(running), "problem_count": F.sum(problems.cast("long")).over(running)})


def recovered(states: DataFrame, open_states: tuple[str, ...] = OPEN) -> DataFrame:
    """States (job_id, status, last_sequence, ...) after a restart: jobs that were under way are interrupted, by an event of their own."""
    lost = F.col("status").isin(*open_states)
    return states.withColumns({"status": F.when(lost, "interrupted").otherwise(F.col("status")), "last_sequence": F.col("last_sequence") + lost.cast("int")})


def results(states: DataFrame, results: DataFrame) -> DataFrame:
    """The results of completed jobs, and for others the error that asking gives."""
    rows = states.join(results, "job_id", "left")
    return rows.withColumn("error", F.when(F.col("status") != "completed", F.concat(F.lit("job is not complete: "), "status")))


def admitted(jobs: DataFrame, capacity: int = CAPACITY, *order: str) -> DataFrame:
    """jobs (queue, job_id, ...) with admitted: the first so many of each queue; the others find it full."""
    place = F.row_number().over(Window.partitionBy("queue").orderBy(*(order or ("job_id",))))
    return jobs.withColumn("admitted", place <= capacity)


#: The status that an event leaves a job in (pages leave it as it was), and the events that a status allows.
STATUS_OF = {"queued": "queued", "started": "running", "cancellation_requested": "cancelling", "completed": "completed", "error": "failed", "cancelled": "cancelled", "interrupted": "interrupted"}
ALLOWED = {
    "": ("queued",),
    "queued": ("started", "error", "cancelled", "interrupted"),
    "running": ("page", "cancellation_requested", "completed", "error", "cancelled", "interrupted"),
    "cancelling": ("page", "completed", "error", "cancelled", "interrupted"),
}
STOPPED = "service stopped before the job completed"


def status_after(type_: Column) -> Column:
    """The status that an event of this type leaves; null for pages and events of other kinds."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in STATUS_OF.items() for x in kv]), type_)


def transitions(events: DataFrame) -> DataFrame:
    """Events (job_id, sequence, type, ...) with status_before (empty at first), status, and error for an event that status_before doesn't allow, or that repeats or skips a sequence number.

    Each event is judged by what the events before it left, whether they were allowed or not. One window by job and sequence.
    """
    order = Window.partitionBy("job_id").orderBy("sequence", "type")
    before = F.coalesce(F.last(status_after(F.col("type")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(""))
    rows = events.withColumns({"status_before": before, "_due": F.coalesce(F.lag("sequence").over(order) + 1, F.lit(1))})
    allowed = F.lit(False)
    for status_, types in ALLOWED.items():
        allowed = allowed | ((F.col("status_before") == status_) & F.col("type").isin(*types))
    out_of_turn = F.concat(F.lit("sequence "), "sequence", F.lit(" where "), "_due", F.lit(" is due"))
    forbidden = F.concat(F.coalesce("type", F.lit("an event without type")), F.lit(" is not allowed "), F.when(F.col("status_before") == "", "at first").otherwise(F.concat(F.lit("when "), "status_before")))
    error = F.when(~F.col("sequence").eqNullSafe(F.col("_due")), out_of_turn).when(~F.coalesce(allowed, F.lit(False)), forbidden)
    return rows.withColumns({"status": F.coalesce(status_after(F.col("type")), "status_before"), "error": error}).drop("_due")


def recovery_events(log: DataFrame, at: Column) -> DataFrame:
    """(job_id, sequence, type, created_at, message): an interruption for each job of the log that was under way, numbered on from its last event. created_at is of the type of at."""
    last = log.groupBy("job_id").agg(F.max_by(status_after(F.col("type")), F.when(status_after(F.col("type")).isNotNull(), F.col("sequence"))).alias("status"), F.max("sequence").alias("sequence"))
    lost = last.where(F.col("status").isin(*OPEN))
    return lost.select("job_id", (F.col("sequence") + 1).alias("sequence"), F.lit("interrupted").alias("type"), at.alias("created_at"), F.lit(STOPPED).alias("message"))


def upserted(log: DataFrame, new: DataFrame) -> DataFrame:
    """The log and those of the new events whose job and sequence it hasn't yet: adding events again, or a second sweep that raced the first, changes nothing."""
    fresh = new.dropDuplicates(["job_id", "sequence"]).join(log.select("job_id", "sequence"), ["job_id", "sequence"], "left_anti")
    return log.unionByName(fresh, allowMissingColumns=True)
