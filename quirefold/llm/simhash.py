"""SimHash near-duplicates: tiled exact comparison of fingerprints."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quirefold.llm.common import cut, fresh, small
from quirefold.llm.graph import components

SHINGLE, SEED, RADIUS = 3, 42, 3
TILE = 2048
SUBTILE = 256


def fingerprint(raw: bytes | None) -> int:
    """The unsigned 64-bit SimHash of the ASCII-lower-cased words' shingles; no words: 0."""
    words = (raw or b"").lower().split()  # bytes: A-Z alone are lowered, and ASCII spaces alone separate
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else iter([b" ".join(words)])
    return majority(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """The bits that are 1 in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(x.as_py()) for x in texts], np.uint64).view(np.int64))


def fingerprint_of(text: Column) -> Column:
    """The fingerprint's 64 bits as a signed long."""
    return F.arrow_udf(_fingerprints, LongType())(F.coalesce(text, F.lit("")).cast("binary"))


def _masks(blocks: int) -> list[int]:
    """Bit masks such that two fingerprints within RADIUS bits agree under at least one: RADIUS of the blocks can differ, never more."""
    edge = [64 * i // blocks for i in range(blocks + 1)]
    part = [((1 << (edge[i + 1] - edge[i])) - 1) << edge[i] for i in range(blocks)]
    return [sum(part[i] for i in kept) for kept in combinations(range(blocks), blocks - RADIUS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, tile: int = TILE, blocks: int | None = None) -> DataFrame:
    """Links (a, b) that connect all fingerprints of prints (fp: distinct longs) within RADIUS bits.

    A tile holds fingerprints that agree under a mask, so every pair within the radius meets in some tile; the number of
    blocks rises with the input so that tiles stay small. In a tile, fingerprints whose population counts differ beyond the radius are
    passed over without a comparison. Larger tiles are cut by population count and hash, and those
    parts are compared pair by pair, but for the pairs whose counts differ beyond the radius. All pairs of a tile are compared by
    exclusive-or and bit count; a spanning forest of the tile's links is returned, never all of its pairs.
    """
    n = prints.count()
    blocks = blocks or (4 if n < 100_000_000 else 5 if n < 10_000_000_000 else 6)
    keys = F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(_masks(blocks))]))
    rows = prints.select("fp", F.bit_count("fp").alias("pop"), keys.alias("key"))
    hot = cut(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > tile).select("key"))
    tiles = rows.select("fp", F.lit(0).cast("byte").alias("side"), F.col("key").alias("tile"))
    if not hot.isEmpty():
        tiles = rows.join(small(hot), "key", "left_anti").select("fp", F.lit(0).cast("byte").alias("side"), F.col("key").alias("tile"))
        tiles = tiles.union(_split_tiles(rows.join(small(hot), "key", "left_semi"), tile))
    dealt = tiles.repartition("tile").sortWithinPartitions("tile")
    return cut(dealt.mapInArrow(_compare, "a long, b long"))


def _split_tiles(rows: DataFrame, tile: int, radius: int = RADIUS, carried: tuple[str, ...] = ("fp",)) -> DataFrame:
    """Rows of the hot keys, dealt to pairs of parts: (carried, side, tile). A part is of one key and population count (pop), and near tile rows by hash."""
    cells = cut(rows.groupBy("key", "pop").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts")))
    one = cells.select("key", "pop", F.col("parts").alias("n1"))
    two = cells.select(F.col("key").alias("_k"), F.col("pop").alias("pop2"), F.col("parts").alias("n2"))
    pairs = one.join(two, (F.col("key") == F.col("_k")) & (F.col("pop2") >= F.col("pop")) & (F.col("pop2") <= F.col("pop") + radius))
    pairs = pairs.withColumn("p1", F.explode(F.sequence(F.lit(0), F.col("n1") - 1))).withColumn("p2", F.explode(F.sequence(F.lit(0), F.col("n2") - 1)))
    pairs = pairs.where((F.col("pop") < F.col("pop2")) | (F.col("p1") <= F.col("p2"))).withColumn("tile", F.xxhash64("key", "pop", "p1", "pop2", "p2"))
    own = (F.col("pop") == F.col("pop2")) & (F.col("p1") == F.col("p2"))
    sides = pairs.select("key", "pop", F.col("p1").alias("part"), F.when(own, 0).otherwise(1).cast("byte").alias("side"), "tile")
    sides = sides.union(pairs.where(~own).select("key", F.col("pop2").alias("pop"), F.col("p2").alias("part"), F.lit(2).cast("byte").alias("side"), "tile"))
    parted = rows.join(cells, ["key", "pop"]).withColumn("part", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts").cast("long")).cast("int"))
    return parted.join(sides, ["key", "pop", "part"]).select(*carried, "side", "tile")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole tiles at a time, from batches sorted by tile."""
    held: tuple[np.ndarray, ...] | None = None
    for batch in batches:
        new = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        fp, side, tile = new if held is None else (np.concatenate(x) for x in zip(held, new, strict=True))
        last = int(np.searchsorted(tile, tile[-1])) if len(tile) else 0
        yield from _compare_tiles(fp[:last].view(np.uint64), side[:last], tile[:last])
        held = fp[last:], side[last:], tile[last:]
    if held is not None:
        yield from _compare_tiles(held[0].view(np.uint64), *held[1:])


def _compare_tiles(fp: np.ndarray, side: np.ndarray, tile: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not len(fp):
        return
    start = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
    size = np.diff(np.r_[start, len(tile)])
    few = np.repeat(size <= 64, size)
    found = [_near_in_runs(fp[few], tile[few])]
    for s, n in zip(start[size > 64], size[size > 64], strict=True):
        found.append(_forest(fp[s : s + n], side[s : s + n]))
    a, b = (np.concatenate([x[i] for x in found]) for i in (0, 1))
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def _near_in_runs(fp: np.ndarray, tile: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Small tiles side by side, each in the order of population counts: each fingerprint against the d-th after it in its tile, for all d, as long as their counts are within the radius."""
    pop = np.bitwise_count(fp).astype(np.int16)
    order = np.lexsort((pop, tile))
    fp, tile, pop = fp[order], tile[order], pop[order]
    a, b = [fp[:0]], [fp[:0]]
    for d in range(1, 64):
        same = np.flatnonzero((tile[d:] == tile[:-d]) & (pop[d:] - pop[:-d] <= RADIUS)) if d < len(tile) else []
        if not len(same):
            break
        near = same[np.bitwise_count(fp[same] ^ fp[same + d]) <= RADIUS]
        a.append(fp[near])
        b.append(fp[near + d])
    return np.concatenate(a), np.concatenate(b)


def _forest(fp: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each linked fingerprint of a large tile with its component's first, by sub-tiles in the order of population counts."""
    pop = np.bitwise_count(fp).astype(np.int16)
    order = np.argsort(pop, kind="stable")
    fp, side, pop = fp[order], side[order], pop[order]
    root = np.arange(len(fp))
    for i in range(0, len(fp), SUBTILE):
        x = fp[i : i + SUBTILE]
        for j in range(i, len(fp), SUBTILE):
            if int(pop[j]) - int(pop[min(i + SUBTILE, len(fp)) - 1]) > RADIUS:
                break
            near = np.bitwise_count(x[:, None] ^ fp[None, j : j + SUBTILE]) <= RADIUS
            if side[0] or side[-1]:
                near &= side[i : i + SUBTILE, None] != side[None, j : j + SUBTILE]
            p, q = np.nonzero(near)
            _union(root, p + i, q + j)
    linked = np.flatnonzero(root != np.arange(len(fp)))
    return fp[root[linked]], fp[linked]


def _union(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Join the components of p[k] and q[k], for all k, in root, which holds the first of every component."""
    while True:
        x, y = root[p], root[q]
        differ = x != y
        if not differ.any():
            return
        p, q, x, y = p[differ], q[differ], x[differ], y[differ]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root[:] = root[root]


def classes(prints: DataFrame, linked: Callable[[DataFrame], DataFrame] = links) -> DataFrame:
    """(fp, root, component_id) for prints (doc_id, fp): root is a fingerprint that stands for the component, component_id its smallest doc_id.

    linked gives links (a, b) between the fingerprints of a table (fp).
    """
    each = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(linked(each.select("fp")))
    rooted = each.join(found, each["fp"] == found["node"], "left").select("fp", "first", F.col("node").isNotNull().alias("linked"), F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted)
    least = rooted.where("linked").groupBy("root").agg(F.min("first").alias("least"))
    return cut(rooted.join(least, "root", "left").select("fp", "root", F.coalesce("least", "first").alias("component_id")))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Null and blank texts have the fingerprint zero and are linked like any other. Copies share a fingerprint, which is
    compared once; each fingerprint gets one row of its component, and joining it back is a join whose hot side Spark splits.
    Null doc_ids are passed over for component_id unless a component has no other.
    """
    prints = cut(docs.select(F.col(key).alias("doc_id"), fingerprint_of(F.col(text)).alias("fp")))
    return prints.join(classes(prints), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, with the columns of docs: that of the smallest key."""
    prints = cut(docs.select(F.col(key).alias("doc_id"), fingerprint_of(F.col(text)).alias("fp")))
    return first_of(docs, prints, classes(prints), fingerprint_of, key, text)


def first_of(docs: DataFrame, prints: DataFrame, classed: DataFrame, print_of: Callable[[Column], Column], key: str, text: str) -> DataFrame:
    """The documents whose component, by classed (fp, root, component_id), has no smaller key; prints (doc_id, fp) are theirs by print_of.

    Documents of other keys are taken out by an anti join that hashes the keys to be dropped and sorts no texts. Rows that share a
    key, or have none, are told apart by their fingerprints, and one row stays of those that are first in their component.
    """
    only, fp, of, root, first = fresh("key", "fp", "class_fp", "root", "first")
    shared = cut(prints.groupBy("doc_id").count().where((F.col("count") > 1) | F.col("doc_id").isNull()).select(F.col("doc_id").alias(only)))
    out = cut(prints.join(classed, "fp").where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(only)).union(shared.where(F.col(only).isNotNull())).distinct())
    kept = docs.where(docs[key].isNotNull()).join(out.hint("shuffle_hash"), docs[key] == out[only], "left_anti")
    if shared.isEmpty():
        return kept
    again = docs.join(shared, docs[key].eqNullSafe(shared[only]), "left_semi").withColumn(fp, print_of(F.col(text)))
    classed = classed.select(F.col("fp").alias(of), F.col("root").alias(root), F.col("component_id").alias(first))
    again = again.join(classed, again[fp] == classed[of]).where(F.col(key).eqNullSafe(F.col(first)))
    return kept.union(again.dropDuplicates([root]).select(*docs.columns))
