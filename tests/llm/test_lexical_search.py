"""Search of many items against a plain computation: shared sums, ties, nulls, long texts, repeated rows, empty tables."""

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from palimpsest.llm import lexical_search
from palimpsest.llm.lexical_search import shared_sums, term_counts

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    read = [(i, terms(t)) for i, t in docs]
    read = [(i, w) for i, w in read if w]
    n, length = len(read), sum(len(w) for _, w in read)
    df = {}
    for _, w in read:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in set(items):
        scored = []
        for i, w in read:
            m = 10 + 90 * len(w) * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * w.count(t) // (1000 * w.count(t) + 8 * m)) for t in set(terms(text)) if t in w)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, **how):
    df = lexical_search.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), **how)
    return sorted((tuple(r) for r in df.collect()), key=str)


def text(rng, n, kinds=60):
    return " ".join(f"w{int(kinds * rng.random() ** 2)}" for _ in range(n))


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    docs = [(i, text(rng, rng.randrange(1, 60))) for i in range(150)]
    items = [(i, text(rng, rng.randrange(1, 25), 80)) for i in range(30)]
    wanted = brute(docs, items)
    assert found(spark, docs, items) == wanted
    # Items in several blocks, documents a few at a time.
    monkeypatch.setattr(lexical_search, "CELLS", 1)
    assert found(spark, docs, items, block_terms=100) == wanted


def test_ties_nulls_and_repeats(spark):
    docs = [(5, "Alpha beta"), (3, "alpha-BETA"), (3, "alpha beta"), (3, "alpha beta"), (None, "alpha beta"), (9, None), (10, ""), (11, " .,; "), (12, "Äpfel äpfel ß1"), (13, "x" * 50 + " alpha")]
    docs += [(100 + i, "gamma") for i in range(30)]
    items = [(1, "alpha ALPHA beta"), (1, "alpha ALPHA beta"), (2, None), (3, "..."), (4, "Äpfel"), (5, "äpfel"), (6, "gamma"), (7, "unknown"), (None, "ß1"), (8, "beta"), (8, "gamma alpha")]
    assert found(spark, docs, items) == brute(docs, items)


def test_few_rows_and_clashing_columns(spark):
    assert found(spark, [], [(1, "a")]) == found(spark, [(1, "a")], []) == found(spark, [(1, None)], [(1, "a")]) == []
    docs, items = [(1, "a b"), (2, "b c"), (3, "d"), (4, "e")], [(7, "b a")]
    clash = {c: F.lit(1) for c in ("id", "n", "terms", "counts", "item", "rank", "score")}
    df = lexical_search.search(spark.createDataFrame(docs, "doc_id long, text string").withColumns(clash), spark.createDataFrame(items, "item_id long, text string").withColumns(clash))
    assert sorted((tuple(r) for r in df.collect()), key=str) == brute(docs, items)


def test_long_texts_are_read_whole(monkeypatch):
    rng = random.Random(2)
    long = text(rng, 5000) + " " + "é" * 3000 + "\x00" + "Z" * 700
    monkeypatch.setattr(lexical_search, "PIECE", 97)
    counts = term_counts(long.encode())
    wanted = {}
    for t in terms(long):
        wanted[t.encode()] = wanted.get(t.encode(), 0) + 1
    assert counts == wanted


def test_shared_sums_are_computed_once():
    rng = random.Random(3)
    common = [rng.sample(range(40), 12) for _ in range(4)]
    items = [sorted({*common[i % 4], *rng.sample(range(40, 200), 5)}) for i in range(60)] + [[]]
    graph = shared_sums(items, 200)

    def leaves(node):
        return [node] if node < 200 else [x for p in graph.parts[node - 200] for x in leaves(p)]

    assert [sorted(x for n in r for x in leaves(n)) for r in graph.roots] == items
    assert graph.additions() < 0.6 * sum(max(0, len(i) - 1) for i in items)
    assert all(max(p) < 200 + k for k, p in enumerate(graph.parts))
    of, t = np.array([0, 1, 1]), np.array([items[0][0], items[0][0], items[0][1]])
    assert dict(lexical_search.totals(graph, 2, of, t, np.array([3, 4, 5])))[0].tolist() == [3, 9]
