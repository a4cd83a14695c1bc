"""Toxicity grades by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that the model is fitted on, at most about so many, drawn by hash.
TRAIN_DOCS = 8000
GRADES = 3
BUCKETS = 1 << 20
PREFIXES = (4, 5, 6)
LEAST_DF, LEAST_SHARE, RIDGE, STEPS = 4, 0.4, 3e-5, 600

letters = re.compile(r"[^\W\d_]+").findall


def features_of(word: str) -> list[int]:
    """The buckets of a word and of its first letters."""
    return [zlib.crc32(f"w{word}".encode()) % BUCKETS, *(zlib.crc32(f"{k}{word[:k]}".encode()) % BUCKETS for k in PREFIXES if len(word) >= k)]


def _sparse(texts: pa.Array) -> pa.Array:
    """Each text's features as the bytes of sorted 32-bit numbers."""
    known: dict[str, list[int]] = {}
    out = []
    for x in texts:
        found: set[int] = set()
        for w in set(letters((x.as_py() or "").lower())):
            if w not in known:
                known[w] = features_of(w)
            found.update(known[w])
        out.append(np.array(sorted(found), np.int32).tobytes())
        if len(known) > 500_000:
            known.clear()
    return pa.array(out, pa.binary())


@dataclass
class Grades:
    """P(grade >= k) = 1 / (1 + exp(cuts[k-1] - score)): the thresholds are in order and share the weights.

    score = log(1 + sum of exp(weight)) over a text's features, so that its strongest words decide and not its length.
    """

    weights: dict[int, float]
    cuts: list[float]

    def above(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(np.array(self.cuts)[None, :] - score[:, None], -500, 500)))


def _surely(p: np.ndarray, n: np.ndarray, z: float = 1.64) -> np.ndarray:
    """The lower Wilson bound of the share p / (p + n)."""
    k = np.maximum(p + n, 1)
    share = p / k
    return (share + z * z / (2 * k) - z * np.sqrt(share * (1 - share) / k + z * z / (4 * k * k))) / (1 + z * z / k)


def fit(rows: list[tuple[np.ndarray | list[int], int]], grades: int = GRADES) -> Grades:
    """A proportional-odds model by full-batch Adam on the features that speak for a grade.

    A feature is taken if LEAST_DF rows have it and surely LEAST_SHARE of all such rows are graded. Without
    rows, or with rows of one grade only, all get nearly that grade.
    """
    y = np.array([g for _, g in rows], np.int64)
    flat = np.concatenate([np.asarray(f, np.int32) for f, _ in rows]) if rows else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows]) if rows else flat
    bad = (y > 0)[owner] if rows else np.zeros(0, bool)
    p, n = np.bincount(flat[bad], minlength=BUCKETS), np.bincount(flat[~bad], minlength=BUCKETS)
    bads, goods = int((y > 0).sum()), int((y == 0).sum())
    chosen = np.flatnonzero((_surely(p, n) >= LEAST_SHARE) & (p + n >= LEAST_DF)) if bads and goods else np.zeros(0, np.int64)
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))
    inside = place[flat] >= 0
    at, row = place[flat[inside]], owner[inside]
    share = [(int((y >= k).sum()) + 0.5) / (len(y) + 1) for k in range(1, grades)]
    theta = np.zeros(len(chosen) + grades - 1)  # weights, the first cut, then logarithms of the steps to the next
    theta[len(chosen)] = np.log((1 - share[0]) / share[0])
    level = np.log((1 - np.array(share)) / np.array(share))
    theta[len(chosen) + 1 :] = np.log(np.maximum(np.diff(level), 1e-2))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    w = slice(0, len(chosen))

    def cuts() -> np.ndarray:
        return np.cumsum(np.r_[theta[len(chosen)], np.exp(theta[len(chosen) + 1 :])])

    for step in range(1, STEPS + 1 if len(rows) else 1):
        strength = np.exp(np.minimum(theta[w][at], 50))
        total = 1 + np.bincount(row, strength, minlength=len(rows))
        score = np.log(total)
        up = np.c_[np.ones(len(y)), 1 / (1 + np.exp(np.clip(cuts()[None, :] - score[:, None], -500, 500))), np.zeros(len(y))]
        here = np.maximum(up[np.arange(len(y)), y] - up[np.arange(len(y)), y + 1], 1e-9)
        slope = up * (1 - up)
        lower, upper = slope[np.arange(len(y)), y] / here, slope[np.arange(len(y)), y + 1] / here
        by_cut = np.zeros(grades - 1)  # gradients of the log-likelihood
        for k in range(grades - 1):
            by_cut[k] = -lower[y == k + 1].sum() + upper[y == k].sum()
        grad = np.zeros_like(theta)
        grad[w] = np.bincount(at, (lower - upper)[row] * strength / total[row], minlength=len(chosen)) / len(y) - RIDGE * theta[w]
        tail = np.cumsum(by_cut[::-1])[::-1] / len(y)
        grad[len(chosen) :] = tail
        grad[len(chosen) + 1 :] *= np.exp(theta[len(chosen) + 1 :])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Grades({int(f): float(x) for f, x in zip(chosen, theta[w], strict=True)}, [float(x) for x in cuts()])


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Grades:
    """A model from labelled documents: grade 0 is not toxic, 1 toxic, 2 toxic and of low quality too. Null labels are passed over.

    The labels are thinned by hash to about train_docs rows before any text is read, so the driver gets that many lists of features.
    """
    labels = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    n = labels.count()
    rate = min(1.0, train_docs / n) if n else 1.0
    graded = F.when(F.col("toxic") == 0, 0).when(F.coalesce(F.col("quality"), F.lit(1)) == 0, 2).otherwise(1)
    drawn = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < round(rate * 1_000_000)).groupBy("doc_id").agg(F.max(graded).alias("grade"))
    both = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id")
    both = both.groupBy("doc_id", "grade").agg(F.min("text").alias("text"))  # train_docs rows, within chance: of rows with the same doc_id the least text
    sparse = F.arrow_udf(_sparse, "binary")(F.col("text"))
    rows = both.select(sparse.alias("f"), "grade", "doc_id").collect()
    return fit([(np.frombuffer(r["f"], np.int32), r["grade"]) for r in sorted(rows, key=lambda r: r["doc_id"])])


def grade_of(text: Column, model) -> Column:
    """A struct of expected_severity, severity (the likeliest grade) and p_toxic, by a broadcast model."""
    kind = pa.struct([("expected_severity", pa.float64()), ("severity", pa.int32()), ("p_toxic", pa.float64())])

    def grade(texts: pa.Array) -> pa.Array:
        weights, known, scores = model.value.weights, {}, []
        for x in texts:
            found: set[int] = set()
            for w in set(letters((x.as_py() or "").lower())):
                mine = known.get(w)
                if mine is None:
                    mine = known[w] = [f for f in features_of(w) if f in weights]
                if mine:
                    found.update(mine)
            scores.append(np.log1p(sum(np.exp(weights[f]) for f in sorted(found))))
            if len(known) > 500_000:
                known.clear()
        above = model.value.above(np.array(scores, float))
        each = -np.diff(np.c_[np.ones(len(scores)), above, np.zeros(len(scores))], axis=1)
        return pa.StructArray.from_arrays([pa.array(above.sum(axis=1)), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(above[:, 0])], fields=list(kind))

    return F.arrow_udf(grade, "expected_severity double, severity int, p_toxic double")(F.coalesce(text, F.lit("")))


def graded(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """One row per document: doc_id, expected_severity, severity and toxic (the chance of any grade is least or more).

    Every whole text is graded by itself: null and empty texts get the score 0, repeated rows the same grade.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    rows = docs.select("doc_id", grade_of(F.col("text"), model).alias("g"))
    return rows.select("doc_id", "g.expected_severity", "g.severity", (F.col("g.p_toxic") >= least).alias("toxic"))
