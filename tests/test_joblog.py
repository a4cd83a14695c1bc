"""What may happen to a job, and sweeps after a restart."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirefold.operators import joblog as jl


def log(spark, lives):
    return spark.createDataFrame([(j, n, t) for j, types in lives.items() for n, t in types], "job_id string, sequence int, type string")


def life(*types):
    return [*enumerate(types, 1)]


def test_forbidden_transitions_are_told(spark):
    lives = {
        "good": life("queued", "started", "page", "cancellation_requested", "page", "cancelled"),
        "late": life("queued", "started", "completed", "page", "started"),
        "early": life("started", "page"),
        "twice": life("queued", "queued", "cancellation_requested"),
        "gap": [(1, "queued"), (3, "started"), (3, "page")],
        "odd": life("queued", None, "dance"),
    }
    errors = {(r.job_id, r.sequence, r.type): r.error for r in jl.transitions(log(spark, lives)).collect() if r.error}
    assert errors == {
        ("late", 4, "page"): "page is not allowed when completed", ("late", 5, "started"): "started is not allowed when completed", ("early", 1, "started"): "started is not allowed at first",
        ("twice", 2, "queued"): "queued is not allowed when queued", ("twice", 3, "cancellation_requested"): "cancellation_requested is not allowed when queued",
        ("gap", 3, "page"): "sequence 3 where 2 is due", ("gap", 3, "started"): "sequence 3 where 4 is due",
        ("odd", 2, None): "an event without type is not allowed when queued", ("odd", 3, "dance"): "dance is not allowed when queued",
    }


def test_a_second_sweep_adds_nothing(spark):
    at = F.timestamp_seconds(F.lit(0))
    before = log(spark, {"q": life("queued"), "r": life("queued", "started", "page"), "c": life("queued", "started", "cancellation_requested"), "done": life("queued", "started", "completed"), "x": life("page")})
    swept = jl.recovery_events(before, at)
    assert {(r.job_id, r.sequence, r.type) for r in swept.collect()} == {("q", 2, "interrupted"), ("r", 4, "interrupted"), ("c", 4, "interrupted")}
    once = jl.upserted(before, swept)
    assert once.count() == before.count() + 3
    assert jl.upserted(once, swept).count() == jl.upserted(once, jl.recovery_events(once, at)).count() == once.count()
    assert not jl.transitions(once).where("error IS NOT NULL AND job_id <> 'x'").collect()


def test_empty_logs(spark):
    none = log(spark, {"a": life("queued")}).limit(0)
    assert jl.transitions(none).collect() == [] and jl.recovery_events(none, F.current_timestamp()).collect() == []
