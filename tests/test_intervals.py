from __future__ import annotations

import heapq
import random

import pytest
from pyspark.sql import functions as F

from quirefold.operators import intervals as iv

POINTS, RANGES = "k string, y double", "k string, a double, b double, n int, name string"
INF, NAN = float("inf"), float("nan")


def brute(points, ranges):
    above = lambda y: (y != y, y)
    out = []
    for k, y in points:
        inside = [r for r in ranges if None not in (k, y, *r[:4]) and r[0] == k and above(r[1]) <= above(y) < above(r[2])]
        if inside:
            least = min(inside, key=lambda r: r[3])
            out.append((k, y, least[3], least[4]))
    return sorted(out, key=str)


def run(spark, points, ranges):
    got = iv.first_range(spark.createDataFrame(points, POINTS), spark.createDataFrame(ranges, RANGES), ["k"], "y", "a", "b", "n")
    assert got.columns == ["k", "y", "n", "name"]
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_as_brute_force(spark, seed):
    rng = random.Random(seed)
    value = lambda: rng.choice([rng.randint(0, 60), rng.randint(0, 600) / 10, -0.0])
    points = [(rng.choice("ab"), float(value())) for _ in range(300)] + [("a", 7.0)] * 3
    ranges = [(rng.choice("abc"), float(value()), float(value()), i, f"r{i}") for i in rng.sample(range(200), 80)]
    assert run(spark, points, ranges) == brute(points, ranges)


def test_odd_values(spark):
    points = [("a", 1.0), ("a", NAN), ("a", INF), ("a", -INF), ("a", None), (None, 1.0), ("b", 1.0), ("a", 0.0)]
    ranges = [("a", -INF, 1.0, 5, "low"), ("a", 1.0, INF, 4, "high"), ("a", INF, NAN, 3, "end"), ("a", 2.0, 1.0, 1, "backwards"), ("a", 1.0, 1.0, 0, "empty"), ("a", None, 9.0, 0, "null"), (None, 0.0, 9.0, 0, "null"), ("b", 0.0, 9.0, None, "unranked")]
    assert run(spark, points, ranges) == sorted([("a", 1.0, 4, "high"), ("a", INF, 3, "end"), ("a", -INF, 5, "low"), ("a", 0.0, 5, "low")], key=str)


def test_nothing(spark):
    assert run(spark, [], [("a", 0.0, 1.0, 1, "x")]) == [] == run(spark, [("a", 0.0)], [])


def test_several_keys_and_no_other_columns(spark):
    points = spark.createDataFrame([("a", 1, 5), ("a", 2, 5)], "k string, j int, y int")
    ranges = spark.createDataFrame([("a", 1, 5, 6, 2), ("a", 1, 0, 9, 1), ("a", 2, 6, 9, 1)], "k string, j int, a int, b int, n int")
    assert [tuple(r) for r in iv.first_range(points, ranges, ["k", "j"], "y", "a", "b", "n").collect()] == [("a", 1, 5, 1)]


def test_one_key_of_many_long_ranges(spark, monkeypatch):
    """Tens of thousands of points, each in thousands of ranges, told by a sweep; larger nodes are brought down."""
    monkeypatch.setattr(iv, "LOW", 3)
    n = 30_000
    at = F.pmod(F.xxhash64("id"), F.lit(n)).cast("double")
    points = spark.range(n).select(F.lit("k").alias("k"), F.col("id"), at.alias("y"))
    long = F.pmod(F.xxhash64("id", F.lit(2)), F.when(F.col("id") % 7 == 0, F.lit(n)).otherwise(F.lit(40))).cast("double")
    ranges = spark.range(n).select(F.lit("k").alias("k"), at.alias("a"), (at + long).alias("b"), F.pmod(F.xxhash64("id", F.lit(3)), F.lit(10**9)).alias("n"))
    got = {r.id: r.n for r in iv.first_range(points, ranges, ["k"], "y", "a", "b", "n").collect()}
    todo, heap, want = sorted((r.a, r.b, r.n) for r in ranges.collect()), [], {}
    i = 0
    for p in sorted(points.collect(), key=lambda r: r.y):
        while i < len(todo) and todo[i][0] <= p.y:
            heapq.heappush(heap, (todo[i][2], todo[i][1]))
            i += 1
        while heap and heap[0][1] <= p.y:
            heapq.heappop(heap)
        if heap:
            want[p.id] = heap[0][0]
    assert got == want
