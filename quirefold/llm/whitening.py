"""Embedding whitening by exact integer products: digit-slice GEMM, whole covariances, one eigendecomposition."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import bind, cut, fresh

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Entries are held within this bound, so that they are whole doubles and sums of them whole longs.
MOST = 1 << 50
#: A limb has so many bits; the product of two, summed over BLOCK rows, is a whole double (2 * 20 + 12 <= 53 bits).
LIMB, BLOCK = 20, 1 << 12
#: Sums of products travel as digits of so many bits, whose sums over all tasks stay whole longs.
DIGIT = 30


def integers(embedding: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    """The vector as longs floor(scale * c) + shift; null if it is null or has a null or non-finite entry. floor(scale * c) is held within 2^50."""
    whole = F.transform(embedding, lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(float(MOST))), F.lit(float(-MOST)))).cast("long") + shift)
    return F.when(embedding.isNotNull() & F.forall(embedding, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))), whole)


@dataclass(frozen=True)
class Whitening:
    """What is fitted on the distinct vectors: their number and sums, and components by falling eigenvalue, as columns of vectors."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    @property
    def projection(self) -> np.ndarray:
        """Centred vectors times this are whitened."""
        return self.vectors / np.sqrt(self.values)


def limbs(y: np.ndarray, count: int) -> list[np.ndarray]:
    """Signed longs as count float64 arrays of LIMB-bit digits: y = sum of limbs[k] << LIMB * k. The last one has the sign."""
    out = []
    for _ in range(count - 1):
        out.append((y & ((1 << LIMB) - 1)).astype(np.float64))
        y = y >> LIMB
    return [*out, y.astype(np.float64)]


def products(blocks: Iterator[np.ndarray], d: int) -> np.ndarray:
    """The exact sum of outer products of the blocks' rows (longs), as d * d big integers."""
    total = np.zeros((d, d), object)
    for block in blocks:
        for at in range(0, len(block), BLOCK):
            y = block[at : at + BLOCK]
            most = int(np.abs(y).max(initial=0))
            parts = limbs(y, max(1, -(-most.bit_length() // LIMB)))
            for a, x in enumerate(parts):
                for b in range(a, len(parts)):
                    p = (x.T @ parts[b]).astype(np.int64).astype(object)
                    total = total + ((p if a == b else p + p.T) << (LIMB * (a + b)))
    return total


def _vectors(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _digits(total: np.ndarray) -> pa.RecordBatch:
    """Big integers as rows (i, j, digit, value) of the upper triangle, digits of DIGIT bits with the number's sign."""
    rows = []
    d = len(total)
    for i in range(d):
        for j in range(i, d):
            x, sign = abs(int(total[i, j])), 1 if total[i, j] >= 0 else -1
            for k in range(-(-x.bit_length() // DIGIT)):
                rows.append((i, j, k, sign * (x >> (DIGIT * k) & ((1 << DIGIT) - 1))))
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["i", "j", "digit", "value"])


def moments(vectors: DataFrame, column: str, d: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums by dimension, n * n * covariances times n): whole numbers of the fit list.

    Sums come first. Each task then centres its rows, n * x - S is split in limbs, and the limbs' products by float64 BLAS are whole; tasks
    send d * (d + 1) / 2 big integers, in digits, which Spark adds. The driver gets one row for each digit of the matrix, whatever n is.
    """
    sums = vectors.select(F.posexplode(column).alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).collect()
    if not sums or not d:
        return 0, [], []
    n = sums[0]["n"]
    s = [int(r["s"]) for r in sorted(sums, key=lambda r: r["i"])]
    # n * x - S = n * (x - m) - (S - n * m): with m next to the mean, the second part is below n, and the first is added in limbs of x - m
    middle = [round(x / n) if abs(x) < 1 << 52 else (2 * x + n) // (2 * n) for x in s]
    rest = [x - n * m for x, m in zip(s, middle, strict=True)]
    at = np.array(middle, np.int64)

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _digits(products((_vectors(b.column(0), d) - at for b in batches if b.num_rows), d))

    found = vectors.select(column).mapInArrow(of_task, "i int, j int, digit int, value long").groupBy("i", "j", "digit").agg(F.sum("value").alias("value")).collect()
    near = [[0] * d for _ in range(d)]
    for r in found:
        near[r["i"]][r["j"]] += r["value"] << (DIGIT * r["digit"])
    # sum over rows of (n (x - m) - rest)_i (..)_j, by the sums of x - m, which are rest
    whole = [[n * (n * near[min(i, j)][max(i, j)] - rest[i] * rest[j]) for j in range(d)] for i in range(d)]
    return n, s, whole


def _long_double(x: int) -> np.longdouble:
    high = float(x)
    return np.longdouble(high) + np.longdouble(float(x - int(high)))


def eigen(whole: list[list[int]], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(covariances, eigenvalues falling, eigenvectors as columns) of whole / n^3, both improved beyond float64 by two steps of iterative refinement."""
    d = len(whole)
    v = np.array([[_long_double(x) for x in row] for row in whole], np.longdouble).reshape(d, d) / np.longdouble(n) ** 3
    x = np.linalg.eigh(v.astype(np.float64))[1].astype(np.longdouble)
    for _ in range(2):
        r = np.eye(d, dtype=np.longdouble) - x.T @ x
        s = x.T @ v @ x
        value = np.diag(s) / (1 - np.diag(r))
        gap = value[None, :] - value[:, None]
        close = np.abs(gap) <= 2 * (np.abs(s - np.diag(value)).max() + np.abs(value).max() * np.abs(r).max()) if d else gap
        x = x + x @ np.where(close, r / 2, (s + value[None, :] * r) / np.where(close, 1, gap))
    value = np.diag(x.T @ v @ x) / np.diag(x.T @ x)
    order = np.argsort(-value, kind="stable")
    return v, value[order], x[:, order]


def fit(vectors: DataFrame, column: str, d: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of a table of distinct vectors of d longs. Components whose eigenvalue is zero, up to rounding, are left out, as nothing can be scaled to their variance."""
    n, sums, whole = moments(vectors, column, d)
    if not n:
        return Whitening(0, [], np.zeros(0), np.zeros((d, 0)), 0.0, 0.0)
    v, value, x = eigen(whole, n)
    kept = np.flatnonzero(value > max(float(value[0]), 0.0) * d * 1e-15)[:components]
    value, x = value[kept].astype(np.float64), x[:, kept].astype(np.float64)
    p = (x / np.sqrt(value)).astype(np.longdouble)
    error = float(np.abs(p.T @ v @ p - np.eye(len(kept))).max(initial=0.0))
    return Whitening(n, sums, value, x, float(np.trace(v)), error)


def whiten(rows: DataFrame, w: Whitening, vector: str, key: str = "vec_id") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) for each row and component; vector has longs.

    deviation is a decimal of whole numbers: the sum over dimensions of (n * x - S)^2.
    """
    n, d, k = w.n, len(w.sums), len(w.values)
    projection, share = w.projection, w.values / w.trace if k else w.values
    middle = np.array([x // n for x in w.sums], np.int64) if n else np.zeros(d, np.int64)
    rest = [x - n * int(m) for x, m in zip(w.sums, middle, strict=True)]
    part, square = np.array([r / n for r in rest]), sum(r * r for r in rest)

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows or not k:
                continue
            y = _vectors(b.column(1), d) - middle  # n * x - S = n * y - rest
            white = (y - part) @ projection
            wide = y.astype(object)
            deviation = [str(n * n * q - 2 * n * c + square) for q, c in zip((wide * wide).sum(axis=1), wide @ np.array(rest, object), strict=True)]
            row = np.repeat(np.arange(b.num_rows), k)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b.num_rows)), pa.array(deviation).take(pa.array(row)), pa.array(white.ravel()), pa.array(np.tile(share, b.num_rows))],
                ["key", "component", "deviation", "whitened", "explained"],
            )

    kind = rows.schema[key].dataType.simpleString()
    found = rows.select(key, vector).mapInArrow(of_task, f"key {kind}, component int, deviation string, whitened double, explained double")
    return found.select(F.col("key").alias(key), "component", F.lit(n).cast("long").alias("n"), F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened", "explained", F.lit(w.identity_error).alias("identity_error"))


def whitened(rows: DataFrame, key: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Fit on each distinct vector of the table once and whiten all its rows: (key, component, n, deviation, whitened, explained, identity_error).

    Rows whose vector is null or has null or non-finite entries are left out, as are those of another length than most (ties: the longer) and empty
    ones; keys may be null or repeat. Copies are removed by a grouping on the vector itself, which sums up map-side however many copies there are.
    A table without vectors, or with a single one, has no components and gives no rows.
    """
    (x,) = fresh("x")
    held = rows.select(key, integers(F.col(embedding)).alias(x)).where(F.col(x).isNotNull() & (F.size(x) > 0))
    length = held.groupBy(F.size(x).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = length["d"] if length else 0
    held = held.where(F.size(x) == d)
    low = F.transform(F.col(x), lambda c: c - SHIFT)  # small numbers make small shuffles
    distinct = cut(held.select(low.alias(x)).distinct().select(F.transform(F.col(x), lambda c: c + SHIFT).alias(x)))
    return whiten(held, fit(distinct, x, d, components), x, key)


def digest(rows: DataFrame) -> DataFrame:
    """The query's columns, with deviation as a long (null where it is beyond one)."""
    return whitened(rows).withColumn("deviation", bind(F.col("deviation"), lambda v: F.when(F.abs(v) <= F.lit((1 << 63) - 1).cast("decimal(38,0)"), v.cast("long"))))
