"""Whitening against exact integers and numpy's eigenvectors."""

from __future__ import annotations

import random

import numpy as np
import pytest

from quirefold.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, key int, component int, n string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "clash", 1, 2, "n") for i, v in rows], SCHEMA)


def vectors(count: int, d: int, seed: int = 1):
    rng = np.random.default_rng(seed)
    mixed = rng.normal(size=(count, d)) @ np.diag(np.linspace(0.3, 3, d)) @ rng.normal(size=(d, d))
    return [(i, [float(c) for c in v]) for i, v in enumerate(mixed.astype(np.float32))]


def exact(rows):
    """(n, sums, deviations by row, covariances) by whole numbers."""
    x = [[int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v] for _, v in rows]
    fit = sorted({tuple(r) for r in x})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = [[n * a - b for a, b in zip(r, s, strict=True)] for r in fit]
    d = len(s)
    v = np.array([[sum(r[i] * r[j] for r in centred) / n**3 for j in range(d)] for i in range(d)])
    return n, s, [sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x], v, x


@pytest.mark.parametrize(("count", "d"), [(60, 5), (200, 20)])
def test_against_whole_numbers(spark, count, d):
    good = vectors(count, d)
    good += [(1000 + k, good[3][1]) for k in range(count)]  # a third and more are copies
    bad = [(2000, None), (2001, [None] * d), (2002, [float("nan")] + [0.0] * (d - 1)), (2003, [float("inf")] * d), (2004, []), (2005, [1.0] * (d + 1))]
    got = whitening.digest(frame(spark, good + bad).repartition(5)).collect()
    n, s, deviation, v, x = exact(good)
    value, vector = np.linalg.eigh(v)
    value, vector = value[::-1], vector[:, ::-1]
    k = min(d, 16)
    assert len(got) == len(good) * k and {r.n for r in got} == {n}
    assert all(r.identity_error == got[0].identity_error <= 1e-9 for r in got)
    by = {(r.vec_id, r.component): r for r in got}
    for (i, _), dev, row in zip(good, deviation, x, strict=True):
        for c in range(1, k + 1):
            r = by[i, c]
            assert r.deviation == dev and abs(r.explained - value[c - 1] / value.sum()) <= 1e-9
            assert abs(abs(r.whitened) - abs((np.array([a - b / n for a, b in zip(row, s, strict=True)]) @ vector[:, c - 1]) / np.sqrt(value[c - 1]))) <= 1e-6
    fit = {tuple(row): [by[i, c].whitened for c in range(1, k + 1)] for (i, _), row in zip(good, x, strict=True)}
    w = np.array([*fit.values()])
    assert np.abs(w.T @ w / n - np.eye(k)).max() <= 1e-6


def test_products_are_whole():
    rng = random.Random(2)
    y = np.array([[rng.randrange(-(1 << 45), 1 << 45) for _ in range(4)] for _ in range(9000)])
    want = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j], strict=True)) for j in range(4)] for i in range(4)]
    assert whitening.products(iter([y[:5000], y[5000:]]), 4).tolist() == want


def test_large_offsets_and_entries(spark):
    rows = [(0, [3e38, 1.0]), (1, [-3e38, 2.0]), (2, [0.0, 3.5]), (3, [1e9, 1.0])]
    got = whitening.digest(frame(spark, rows)).collect()
    assert len(got) == 4 and all(np.isfinite(r.whitened) and r.deviation is None for r in got)  # the other direction is below rounding, deviations are beyond a long


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]])
def test_nothing_to_scale(spark, rows):
    assert whitening.digest(frame(spark, rows)).collect() == []


def test_directions_without_variance_are_left_out(spark):
    rows = [(i, [float(i), 2.0 * i, 7.0]) for i in range(20)] + [(None, [3.0, 6.0, 7.0])]
    got = whitening.digest(frame(spark, rows)).collect()
    assert len(got) == 21 and {r.component for r in got} == {1} and abs(got[0].explained - 1) < 1e-9
