"""Probing of the index's pieces: no keys or candidates as rows, the same answers however rows and queries are dealt."""

import itertools

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm import hamming


@pytest.mark.parametrize("rows, most", [(2000, 1 << 20), (2000, 64), (6, 1 << 20)])
def test_a_piece_gives_the_nearest_of_each_query(monkeypatch, rows, most):
    monkeypatch.setattr(hamming, "MOST", most)
    rng = np.random.default_rng(rows)
    codes, queries, far = rng.integers(-(2**63), 2**63, (rows, 2)), rng.integers(-(2**63), 2**63, (9, 2)), rng.integers(50, 128, 9)
    ids = np.arange(rows) // 2  # each id with two codes
    left = np.arange(9) % 5
    asks = pa.table({"segment": [1] * 9, "left": left, "far": far, "query": queries.tolist(), "q0": queries[:, 0], "q1": queries[:, 1]})
    piece = pa.table({"id": ids, "w0": codes[:, 0], "w1": codes[:, 1]})
    got = hamming._look(asks, piece, [(0, 0, 3), (1, 5, 10)], 2, 3)
    wanted = []
    for q, bits, limit in zip(queries.tolist(), left.tolist(), far.tolist(), strict=True):
        met = set()
        for i, c in zip(ids.tolist(), codes.tolist(), strict=True):
            a, b = (((x[1] & (2**64 - 1)) >> 5) & 1023 for x in (q, c))
            d = sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(q, c, strict=True))
            met |= {(d, i)} if (a ^ b).bit_count() == bits and d <= limit else set()
        wanted += [(tuple(q), d, i) for d, i in sorted(met)[:4]]
    assert sorted((tuple(r["query"]), r["distance"], r["id"]) for r in got.to_pylist()) == sorted(wanted)


def test_answers_are_the_same_in_many_pieces_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(hamming, "PIECE", 20)
    monkeypatch.setattr(hamming, "ASKED", 7)
    rng = np.random.default_rng(5)
    signs = rng.integers(0, 2, (400, 24)) * 2.0 - 1
    signs[:, :9] = 1.0  # one part has all rows
    rows = [(i, v.tolist()) for i, v in enumerate(signs)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    wanted = set()
    for q in range(0, 400, 20):
        near = sorted((int((signs[q] != v).sum()), i) for i, v in enumerate(signs) if i != q)[:4]
        wanted |= {(q, n + 1, i, d) for n, (d, i) in enumerate(near)}
    assert {tuple(r) for r in hamming.search(df, df.where("vec_id % 20 = 0"), 4).collect()} == wanted


def test_rows_that_a_query_makes_do_not_grow_with_the_keys_of_a_radius(spark):
    cuts = hamming.segments(64, 51_300)
    tops = hamming._tops(cuts, 51_300)
    asked = spark.createDataFrame([([12345], len(cuts), 64)], "query array<bigint>, need int, far int")
    for r in range(5):
        sent = sum(hamming.probes(asked, tops, i).count() for i in range(r + 1))
        assert sent <= len(cuts) * 2**hamming.SPREAD
    assert list(itertools.accumulate(len(hamming._masks(4, r)) for r in range(5))) == [1, 5, 11, 15, 16]
