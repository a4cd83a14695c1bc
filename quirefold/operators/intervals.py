"""Points in ranges: an interval index as rows, so that a join of any number of ranges with any number of points of one key is one of equal values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.sources.scratch import written

#: Nodes of a level hold four of the level below. Points look up nodes of up to 4^LOW places; what larger ones say is first brought down to those.
LOW = 8
_ROW_BITS = 33  # of monotonically_increasing_id(), below the number of the partition


def _numbered(ends: DataFrame, order: list[str]) -> DataFrame:
    """ends with _id, their place in the order from 0. Sorted by ranges of values, so one key is spread over tasks; only a row a partition is brought together."""
    rows = written(ends.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", _ROW_BITS).alias("_part")
    sizes = rows.groupBy(part).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))  # a row a partition
    return rows.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn("_id", F.col("_offset") + F.col("_id").bitwiseAND((1 << _ROW_BITS) - 1)).drop("_part", "_offset")


def _filled(*names: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])


def _span(a: Column, b: Column) -> Column:
    """The whole numbers from a up to b, without b."""
    return F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))


def _nodes(spans: DataFrame) -> DataFrame:
    """(level, node, rank): each span (lo, hi, rank) of ids as the largest nodes that lie in it, at most six a level, and of spans with the same node the least rank."""
    levels = spans.where("lo < hi").withColumn("level", F.explode(F.sequence(F.lit(0), F.expr("(length(bin(hi - lo)) - 1) div 2").cast("int"))))

    def inner(level: str) -> tuple[Column, Column]:
        return F.expr(f"shiftright(lo + shiftleft(1L, 2 * ({level})) - 1, 2 * ({level}))"), F.expr(f"shiftright(hi, 2 * ({level}))")

    (a, b), (up_a, up_b) = inner("level"), inner("level + 1")
    sides = F.when(up_a < up_b, F.concat(_span(a, up_a * 4), _span(up_b * 4, b))).otherwise(_span(a, b))
    return levels.select("level", F.explode(sides).alias("node"), "rank").groupBy("level", "node").agg(F.min("rank").alias("rank"))


def first_range(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, start: str, stop: str, rank: str) -> DataFrame:
    """Each point with the first range, by rank, of its keys such that start <= at < stop, and that range's other columns; points in no range are dropped.

    All places of points and ends of ranges are numbered in one order. A range is then a span of numbers, which is laid out in nodes of 1, 4, 16 and so on numbers; of a
    node only the least rank is kept, and a place has one node on each level. Work grows with (points + ranges) times the levels, however many ranges hold a point and
    however many of the rows one key has. Points that are equal in all columns stay apart. Nulls in keys, places, ends or ranks match nothing, as does a range that is
    empty; NaN is above all numbers. Of ranges of the same keys and rank, their other columns are of any.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    mine = [F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]
    spans = ranges.select(*mine, F.col(start).alias("_start"), F.col(stop).alias("_stop"), F.col(rank).alias("rank")).where(_filled(*names, "_start", "_stop", "rank")).groupBy(*names, "_start", "_stop").agg(F.min("rank").alias("rank"))
    places = points.select(*mine, F.col(at).alias("_at"), F.lit(True).alias("_point"))
    ends = [spans.select(*names, F.col(end).alias("_at"), F.lit(False).alias("_point")) for end in ("_start", "_stop")]
    every = places.unionAll(ends[0]).unionAll(ends[1]).where(_filled(*names, "_at")).groupBy(*names, "_at").agg(F.max("_point").alias("_point"))
    numbered = written(_numbered(every, [*names, "_at"]))

    def place(of: str, as_: str) -> DataFrame:
        return numbered.select(*names, F.col("_at").alias(of), F.col("_id").alias(as_))

    nodes = written(_nodes(spans.join(place("_start", "lo"), [*names, "_start"]).join(place("_stop", "hi"), [*names, "_stop"]).select("lo", "hi", "rank")))
    top = nodes.agg(F.max("level")).first()[0] or 0
    ids = numbered.where("_point").select("_id")
    found = nodes.where(F.col("level") <= LOW)
    if top > LOW:
        wide = ids.select(F.shiftright("_id", 2 * LOW).alias("chunk")).distinct().withColumn("level", F.explode(F.sequence(F.lit(LOW + 1), F.lit(top))))
        wide = wide.withColumn("node", F.expr(f"shiftright(chunk, 2 * (level - {LOW}))")).join(nodes, ["level", "node"])
        found = found.unionByName(wide.select(F.lit(LOW).alias("level"), F.col("chunk").alias("node"), "rank")).groupBy("level", "node").agg(F.min("rank").alias("rank"))
    looked_up = ids.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(min(top, LOW))))).withColumn("node", F.expr("shiftright(_id, 2 * level)"))
    first = looked_up.join(found, ["level", "node"]).groupBy("_id").agg(F.min("rank").alias("_rank"))
    first = numbered.join(first, "_id").select(*names, "_at", "_rank")
    out = points.join(first, [points[k] == first[n] for k, n in zip(keys, names, strict=True)] + [points[at] == first["_at"]]).select(points["*"], F.col("_rank").alias(rank))
    extra = [c for c in ranges.columns if c not in (*keys, start, stop, rank, *points.columns)]
    return out.join(ranges.select(*keys, rank, *extra).dropDuplicates([*keys, rank]), [*keys, rank]).select(*out.columns, *extra) if extra else out
