"""Hard negatives against a plain computation of all scores: ties, hot vectors, nulls, large numbers, repeated rows, empty tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import hard_negatives
from palimpsest.llm.hard_negatives import angles_to, directions_of, scores, whole_numbers

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, positives=5, negatives=5, asks=lambda i: i % 100 == 0):
    fine = {(i, tuple(v), y) for i, v, y in rows if i is not None and v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)}
    q = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in sorted(fine)]
    out = set()
    for a, va, ya in q:
        if not asks(a):
            continue
        score = [(-sum(x * y for x, y in zip(va, v, strict=False)), i, y) for i, v, y in q if i != a]
        for p, i, _ in sorted(s for s in score if s[2] == ya)[:positives]:
            near = sorted((s, j) for s, j, y in score if y != ya and 80 * -p <= 100 * -s <= 100 * -p)[:negatives]
            out |= {(a, i, r, j, -p, -s) for r, (s, j) in enumerate(near, 1)}
    return out


def mined(spark, rows, schema=SCHEMA, **how):
    df = spark.createDataFrame(rows, schema)
    return {tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 100 == 0, **how).collect()}


def clustered(n, dims=16, seed=1, labels=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dims))
    return [(i, (centres[i % labels] + 0.6 * rng.normal(size=dims)).tolist(), int(rng.integers(labels))) for i in range(n)]


def test_against_all_scores(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 50)
    monkeypatch.setattr(hard_negatives, "GROUP", 3)
    rows = clustered(900)
    assert mined(spark, rows) == brute(rows)


def test_ties_of_a_hot_vector_and_a_hot_label(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 40)
    rng = random.Random(4)
    rows = [(i, [1.0, 0.5, -0.25], rng.randrange(2)) for i in range(300)] + [(i, [rng.random(), rng.random(), 0.0], 0) for i in range(300, 620)]
    assert mined(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = clustered(300, dims=4, seed=3)
    rows += [(400, None, 1), (401, [1.0, float("nan"), 0.0, 0.0], 1), (402, [1.0, float("inf"), 0.0, 0.0], 1), (403, [1.0, None, 0.0, 0.0], 1), (404, [1.0] * 4, None), (None, [1.0] * 4, 1)]
    rows += [(500, [0.0] * 4, 1), (501, [0.0] * 4, 2), (502, [], 1), (503, [2.0, 1.0], 2), (200, rows[200][1], rows[200][2]), (600, [3.0] * 6, 1), (601, [2.9] * 6, 0)]
    assert mined(spark, rows) == brute(rows)


def test_large_numbers(spark):
    rows = [(i, [float(f"{i % 7 + 1}e{9 + i % 4}"), 3e8 + i], i % 2) for i in range(0, 240, 4)]
    got, wanted = mined(spark, rows), brute(rows)
    inside = {r for r in wanted if max(abs(r[4]), abs(r[5])) < 2**63}
    assert {r for r in got if max(abs(r[4]), abs(r[5])) < 2**63 - 1} == {r for r in inside if max(abs(r[4]), abs(r[5])) < 2**63 - 1}


def test_few_rows_and_clashing_columns(spark):
    assert mined(spark, []) == set()
    assert mined(spark, [(0, [1.0], 1)]) == set()
    rows = [(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.85, 0.3], 2)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("id", "asks", "vector", "group", "block", "q", "score", "rank")})
    assert {tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 100 == 0).collect()} == brute(rows)


@pytest.mark.parametrize("dims", [2, 64])
def test_intervals_hold_all_scores(dims):
    rng = np.random.default_rng(dims)
    q = whole_numbers((rng.normal(size=(200, dims)) * rng.random((200, 1))).tolist()).astype(float)
    q = np.concatenate([q, q[:5], -q[:5], 3 * q[:5]])
    norms = np.linalg.norm(q, axis=1)
    angles = angles_to(q, norms, directions_of((q / 256).tolist()))
    for a in range(40):
        found, both = scores(q.astype(np.int64), q[a].astype(np.int64)), norms * norms[a]
        top = np.cos(np.maximum(0, np.abs(angles - angles[a]).max(axis=1) - hard_negatives.MARGIN)) * both
        bottom = np.cos(np.minimum(np.pi, (angles + angles[a]).min(axis=1) + hard_negatives.MARGIN)) * both
        assert (found <= top + 1).all() and (found >= bottom - 1).all()
