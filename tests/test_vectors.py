"""The index of cells against all distances: clustered and random vectors, ties, large cells, odd rows, few rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import vectors
from palimpsest.operators.vectors import VectorIndex

ROWS, QUERIES = "id string, vector array<double>", "query_id long, probe array<double>"


def brute(rows, queries, k):
    out = set()
    for q, p in queries:
        near = sorted((np.floor(sum((a - b) ** 2 for a, b in zip(v, p, strict=True)) * 1e6 + 0.5), i) for i, v in rows)
        out |= {(q, i, n) for n, (_, i) in enumerate(near[:k], 1)}
    return out


def found(spark, rows, queries, k, **how):
    index = VectorIndex.build(spark.createDataFrame(rows, ROWS), **how)
    return index, {(r.query_id, r.id, r.position) for r in index.search(spark.createDataFrame(queries, QUERIES), k).collect()}


@pytest.mark.parametrize("spread, share", [(0.1, 0.5), (3.0, 1.0)])
def test_search_is_exact_and_leaves_cells_out(spark, spread, share):
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(12, 8)) * 3
    rows = [(f"v{i}", (middles[i % 12] + spread * rng.normal(size=8)).tolist()) for i in range(700)]
    queries = [(q, (middles[q % 12] + spread * rng.normal(size=8)).tolist()) for q in range(15)]
    index, got = found(spark, rows, queries, 10)
    assert got == brute(rows, queries, 10)
    reads = index.reads(spark.createDataFrame(queries, QUERIES), 10).collect()
    assert len(reads) == 15 and sum(r.cells_read for r in reads) <= share * sum(r.cells for r in reads)


def test_a_hot_vector_has_parts_and_ties_go_by_id(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PART", 10)
    rows = [(f"v{i:03}", [1.0, 2.0]) for i in range(150)] + [(f"w{i}", [float(i), 0.0]) for i in range(20)]
    index, got = found(spark, rows, [(1, [1.0, 2.0]), (2, [50.0, 0.0])], 7)
    assert got == brute(rows, [(1, [1.0, 2.0]), (2, [50.0, 0.0])], 7)
    assert index.cells.agg(F.max("parts")).first()[0] > 1


def test_odd_and_few_rows(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", None), ("d", []), ("e", [float("nan"), 1.0]), ("f", [None, 1.0]), ("g", [1.0, 2.0, 3.0])]
    queries = [(1, [0.9, 0.0]), (2, None), (3, [1.0]), (4, [float("inf"), 0.0])]
    assert found(spark, rows, queries, 5)[1] == {(1, "a", 1), (1, "b", 2)}
    assert found(spark, [], queries, 5)[1] == set() and found(spark, rows, [], 5)[1] == set()


def test_no_cross_join(spark):
    rows = [(f"v{i}", [float(i), 1.0]) for i in range(300)]
    index, _ = found(spark, rows, [], 5)
    plan = index.search(spark.createDataFrame([(1, [3.0, 1.0])], QUERIES), 5)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
