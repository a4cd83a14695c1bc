"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.common import cut, fresh, n_words_of, small

WEIGHTS = (5, 2, 1)
SHARE, CAP, SEEDS = 1.5, 2.0, 16


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sizes (source, source_size) with target: share times all sizes, split by the weights dealt in the sources' order, none above cap times its size.

    The excess over a cap goes to the others by weight until none is above: with sources by their cap per weight,
    the first k are capped, where k is the least for which what is left, per weight, is within the next one's cap.
    One row per source is sorted here; the documents are summed before.
    """
    order = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(order, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(cap)).withColumn("r", F.col("most") / F.col("w"))
    whole, before = Window.partitionBy(), Window.orderBy("r", F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    level = F.min(F.when(F.col("level") <= F.col("r"), F.struct("r", F.col("level").alias("level")))).over(whole)["level"]
    return rows.withColumn("all_level", level).select("source", "source_size", F.when(F.col("all_level").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("w") * F.col("all_level"))).alias("target"))


def draw(seed: Column, key: Column, size: Column) -> Column:
    """A number from 0 to 1 that depends on nothing but the seed, the document's key and its size."""
    digest = F.md5(F.concat_ws(":", seed.cast("string"), F.coalesce(key.cast("string"), F.lit("")), size.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def copies(rate: Column, seed: Column, key: Column, size: Column) -> Column:
    """floor(rate), and one more with probability equal to the fraction."""
    return F.floor(rate).cast("long") + (draw(seed, key, size) < rate - F.floor(rate)).cast("long")


def plan_rates(sizes: DataFrame, seeds: int = SEEDS) -> DataFrame:
    """source, source_size, target, rate and seed, from sizes (doc_id, source, size).

    The copies drawn with each of a few seeds are summed over all documents, and a source takes the seed whose sum is nearest
    its target (then the lowest), so that sources of few long documents come near it too.
    """
    goal = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    goal = cut(goal.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))))
    drawn = _with_source(sizes, small(goal.select("source", "rate")))
    drawn = drawn.groupBy("source").agg(*[F.sum(F.col("size") * copies(F.col("rate"), F.lit(k), F.col("doc_id"), F.col("size"))).alias(f"t{k}") for k in range(seeds)])
    drawn = drawn.select(F.col("source").alias("_s"), F.array(*[f"t{k}" for k in range(seeds)]).alias("sums"))
    both = goal.join(drawn, goal["source"].eqNullSafe(drawn["_s"]), "left")
    best = F.array_min(F.transform("sums", lambda x, k: F.struct(F.abs(x - F.col("target")).alias("off"), k.alias("k"))))["k"]
    return cut(both.select("source", "source_size", "target", "rate", F.coalesce(best, F.lit(0)).alias("seed")))


def _with_source(rows: DataFrame, goal: DataFrame) -> DataFrame:
    goal = goal.withColumnRenamed("source", "_source")
    return rows.join(goal, rows["source"].eqNullSafe(goal["_source"]), "left").drop("_source")


def sizes_of(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    return cut(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), n_words_of(F.col(text)).alias("size")))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate, copies, taken.

    A null source is a source, sorted last; a null text has no words. Rows repeated in key and size are drawn alike.
    Sources whose texts are all empty have the target 0. Sums are taken map-side; rates are broadcast if few, else
    joined with hot sources split.
    """
    sizes = sizes_of(docs, key, source, text)
    rows = _with_source(sizes, small(plan_rates(sizes)))
    rows = rows.withColumn("copies", copies(F.col("rate"), F.col("seed"), F.col("doc_id"), F.col("size")))
    return rows.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def emit(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of docs, whatever their names. Documents without words are not taken."""
    of, rate, seed, n = fresh("source", "rate", "seed", "n")
    goal = small(plan_rates(sizes_of(docs, key, source, text)).select(F.col("source").alias(of), F.col("rate").alias(rate), F.col("seed").alias(seed)))
    size = n_words_of(F.col(text))
    rows = docs.join(goal, docs[source].eqNullSafe(F.col(of)), "left")
    times = F.when(size > 0, copies(F.col(rate), F.col(seed), F.col(key), size)).otherwise(F.lit(0).cast("long"))
    return rows.withColumn(n, F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])
