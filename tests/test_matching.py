import random

from pyspark.sql import functions as F

from palimpsest.operators import matching
from palimpsest.operators.matching import Asked, best, numbered
from palimpsest.operators.retrieval import by_share, features, tokens
from palimpsest.sources.model import Store
from tests.oracle import SMALL

QUERIES = [(1, ["ab", "12", "abc"], ["a-b"]), (2, ["zz"], []), (3, ["b1", "ab"], [])]


def asked(spark):
    return Asked.of(spark.createDataFrame(QUERIES, "query_id int, words array<string>, fragments array<string>"))


def test_a_task_keeps_the_best_rows_of_each_query(spark):
    draw = random.Random(3)
    given = [(f"{i:03d}", " ".join(draw.choice(["xabx", "112", "12", "abc", "b1", "é", "q"]) for _ in range(draw.randrange(4)))) for i in range(60)] + [("none", None)]
    q, rows = asked(spark), spark.createDataFrame(given, "id string, text string").repartition(3)
    rows = numbered(rows.withColumn("words", tokens("text")), q, {"words": "terms"})
    has = lambda text, t: any(w == t if t == "12" else t in w for w in text.split())
    every = {i: sorted((-sum(has(text, t) for t in words) / len(words), id) for id, text in given if text and any(has(text, t) for t in words)) for i, words, _ in QUERIES}
    assert {len(x) for x in every.values()} > {0}
    for k in (1, 5, None):
        got = best(rows.coalesce(1), q, by_share(q, "terms"), k, [], []).collect()
        assert {i: sorted((-r.score, r.id) for r in got if r.query_id == i) for i in every} == {i: x[:k] for i, x in every.items()}


def test_batches_and_cuts_change_nothing(spark):
    q = asked(spark)
    rows = numbered(spark.range(40_000).select(F.format_string("%05d", "id").alias("id"), F.array(F.lit("ab"), F.when(F.col("id") % 7 == 0, "xb1").otherwise("y")).alias("words")), q, {"words": "terms"}).coalesce(1)
    got = best(rows, q, by_share(q, "terms"), 3, [], []).orderBy("query_id", F.col("score").desc(), "id").collect()
    assert [(r.query_id, r.id) for r in got] == [(1, "00000"), (1, "00001"), (1, "00002"), (3, "00000"), (3, "00007"), (3, "00014")]


def test_own_words_and_fragments(spark):
    rows = spark.createDataFrame([("x", ["ab", "ab", "xab", "12"], "say a-b"), ("y", None, None)], "id string, words array<string>, low string")
    q = asked(spark)
    got = {r.id: r for r in numbered(rows, q, {"words": "terms"}, "low").collect()}
    assert [(q.terms[t], n) for t, n in zip(got["x"].own, got["x"].times)] == [("12", 1), ("ab", 2)]
    assert (got["x"].size, got["x"].fragments, got["y"].terms, got["y"].fragments) == (4, [0], [], [])


def test_places(spark):
    """Terms and fragments in path and kind count; digits alone have no digit next to them, but for the structured bonus."""
    rows = spark.createDataFrame([("x", [], [], "m/ab/a-b.md\nzz"), ("y", [], [], "112\n")], "id string, terms array<int>, fragments array<int>, place string")
    found = best(rows, asked(spark), lambda s: (s.hits("place") + 0.0, {"exact": s.exact("place"), "structured": s.structured("place")}), None, [], ["exact", "structured"])
    got = {(r.query_id, r.id): (r.score, r.exact, r.structured) for r in found.collect()}
    assert got == {(1, "x"): (1, 0.12, 0.26), (2, "x"): (1, 0.0, 0.08), (3, "x"): (1, 0.0, 0.10), (1, "y"): (0, 0.0, 0.12), (2, "y"): (0, 0.0, 0.0), (3, "y"): (0, 0.0, 0.0)}


def test_what_retrieval_writes_has_no_texts(spark):
    """Texts and words are neither written nor shuffled after the terms are found."""
    written = features(Store(spark, SMALL))
    assert not {"text", "words", "kg_data", "kg_words", "low"} & set(written.columns) and written.count() > 0


def test_rounding():
    assert matching.rounded(0.12345) == 0.1235 and matching.rounded(-0.00005) == 0.0
