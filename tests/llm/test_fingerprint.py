"""Prints of texts: sums of paragraphs, edits, likeness, the order of documents, nulls, repeated rows, empty tables."""

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import fingerprint


def text(rng, lines=6):
    return "\n".join(" ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(0, 40))) for _ in range(lines))


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def prints_of(spark, texts):
    return {r.id: r.print for r in fingerprint.fingerprints(docs_of(spark, texts)).collect()}


def likeness_of(spark, a, b):
    return spark.createDataFrame([(a, b)], "a array<bigint>, b array<bigint>").select(fingerprint.likeness(F.col("a"), F.col("b"))).first()[0]


def runs(t):
    out = Counter()
    for line in (t or "").split("\n"):
        w = line.split()
        if w:
            out.update(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    return out


def test_prints_are_sums_of_paragraphs(spark):
    rng = random.Random(1)
    a, b = text(rng), text(rng)
    p = prints_of(spark, [a, b, f"{a}\n{b}", f"{b}\n{a}", "\n".join(sorted(a.split("\n"))), None, "", "\n", a + "x"])
    both = spark.createDataFrame([(p[0], p[1], p[2])], "a array<bigint>, b array<bigint>, c array<bigint>")
    got = both.select(fingerprint.inserted(F.col("a"), F.col("b")), fingerprint.deleted(F.col("c"), F.col("b"))).first()
    assert got[0] == p[2] == p[3] and got[1] == p[0] == p[4]
    assert p[5] == p[6] != p[7] and p[8] != p[0]


def test_likeness_estimates_the_cosine_of_runs(spark):
    rng = random.Random(2)
    texts = [text(rng, 30) for _ in range(6)]
    for k in (3, 10, 20):
        lines = texts[0].split("\n")
        texts.append("\n".join(lines[:-k] + texts[1].split("\n")[-k:]))
    p = prints_of(spark, texts)
    for j in range(1, len(texts)):
        x, y = runs(texts[0]), runs(texts[j])
        cosine = sum(v * y[k] for k, v in x.items()) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
        assert abs(likeness_of(spark, p[0], p[j]) - cosine) < 0.3
    assert likeness_of(spark, p[0], p[0]) == 1.0


def brute(rows):
    """n_chars and edited digest of each row, with ties of an id in any order."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for i, (own, t) in enumerate(order):
        t, follows = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 3
        out.append((own, len(t), t[: len(t) - k] + follows[:k]))
    return out


def test_edits_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(3 * i, text(rng, rng.randrange(1, 8))) for i in range(40)]
    rows += [(1, None), (4, ""), (5, "é" * 7), (7, "ab"), (8, "one line without an end " * 3000), (10, "\n\n\n"), (None, "no id at all")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.id: r for r in fingerprint.edited_prints(df.withColumns({"id": F.lit(1), "th": F.lit("x"), "print": F.lit(0)})).collect()}
    wanted = {i: (n, t) for i, n, t in brute(rows)}
    assert {i: (r.n_chars, r.edited_sha256) for i, r in got.items()} == {i: (n, hashlib.sha256(t.encode()).hexdigest()) for i, (n, t) in wanted.items()}
    # The edited print, made by deleting and inserting paragraphs, is that of the edited text.
    ids = list(wanted)
    whole = prints_of(spark, [wanted[i][1] for i in ids])
    assert all(got[i].edited_print == whole[k] for k, i in enumerate(ids))


def test_repeated_rows_and_ties(spark):
    rows = [(2, "a b c d e f g\nh i"), (2, "a b c d e f g\nh i"), (2, "a b c d e f g\nh i"), (1, "x y z x y z"), (1, "x y z x y z")]
    got = sorted(tuple(r) for r in fingerprint.edited_prints(spark.createDataFrame(rows, "doc_id long, text string")).select("id", "n_chars", "edited_sha256").collect())
    assert got == sorted((i, n, hashlib.sha256(t.encode()).hexdigest()) for i, n, t in brute(rows))
    p = {r.id: r for r in fingerprint.edited_prints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    single = prints_of(spark, [None, "x y z x y z", "a b c d e f g\nh i"])
    assert p[1].print == single[1] and p[2].print == single[2]


@pytest.mark.parametrize("rows", [[], [(1, "alone a b c")]])
def test_few_rows(spark, rows):
    got = fingerprint.edited_prints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.n_chars for r in got] == [len(t) for _, t in rows]


def test_query(spark):
    df = fingerprint.query(spark, "/root/testdata/sf0.001")
    rows = df.collect()
    assert df.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert len(rows) == 200 and all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in rows)
    assert sum(r.near_edited > r.near_next + 0.2 for r in rows) > 180
