"""Fusion and boosts over small tables, with expected rows worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.scores import kind_of
from palimpsest.operators import fusion
from palimpsest.sources.model import NOW, Store

SMALL = "/root/testdata/sf0.001"
CHANNELS = "query_id long, id string, channel string, position long, semantic double"
CHUNKS = "id string, path string, text string, updated_at long, kind string, external boolean, confidence double, hits int, protected boolean"
LEXICAL = "query_id long, id string, final_score double, lex double, exact double, structured double, channels string"
QUERIES = "query_id long, words array<string>, fragments array<string>"


def chunk(id, path="memory/x.md", text="", days=1000.0, kind="raw_log", external=False, confidence=0.5, hits=0, protected=False):
    return (id, path, text, int(NOW - days * 86400), kind, external, None if external else confidence, hits, protected)


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_rows_below_the_confidence_go_and_others_move_up(spark):
    chunks = spark.createDataFrame([chunk("a", confidence=0.1499), chunk("b", confidence=0.15), chunk("c", external=True), chunk("d", confidence=None)], CHUNKS)
    found = spark.createDataFrame([(1, i, "fts", n, 0.5) for n, i in enumerate("abcd", 1)] + [(2, "a", "fts", 1, 0.5), (1, "gone", "kg", 1, 0.9), (1, "c", "kg", 2, 0.8)], CHANNELS)
    assert rows(fusion.admitted(found, chunks), "query_id", "id", "channel", "position") == {(1, "b", "fts", 1), (1, "c", "fts", 2), (1, "c", "kg", 1)}


def test_channels_are_fused_by_ranks(spark):
    found = spark.createDataFrame([(1, "a", "vector", 1, 0.9), (1, "a", "kg", 3, 0.6), (1, "b", "fts", 1, 0.5), (1, "c", "vector", 2, -0.25), (2, "a", "recent", 1, 0.4)], CHANNELS)
    expected = {(1, "a", round(1 / 61 + 1 / 63, 4), 0.9, 0.6, "kg,vector"), (1, "b", 0.0164, 0.5, 0.5, "fts"), (1, "c", 0.0161, -0.25, -0.25, "vector"), (2, "a", 0.0164, 0.4, 0.4, "recent")}
    assert rows(fusion.fuse(found), "query_id", "id", "rrf_score", "semantic_score", "similarity", "channels") == expected


def test_boosts_and_tags(spark):
    day = round(0.06 * math.exp(-2 / 2.5), 4)
    given = [
        chunk("new", path="memory/smart-add/2024-01-30.md", days=2, confidence=0.73, kind="preference"),
        chunk("episode", path="memory/episodes/e.md", kind="episodic", text="Session checkpoint", confidence=1.0),
        chunk("checkpoint", text="a session-checkpoint"),
        chunk("key", text="Session_Key: 1"),
        chunk("project", external=True, kind="project"),
        chunk("stats", external=True, kind="stats"),
        chunk("dream", external=True, kind="dreaming"),
        chunk("other", external=True, kind="preference"),
        chunk("null", text=None),
    ]
    expected = {
        ("new", 0.0, day, 0.073, 0.0, "smart-add"), ("episode", 0.12, 0.0, 0.1, 0.0, "episodic,session_checkpoint"), ("checkpoint", 0.1, 0.0, 0.05, 0.0, ""), ("key", 0.0, 0.0, 0.05, 0.0, "session_checkpoint"),
        ("project", 0.05, 0.0, 0.0, 0.05, "external"), ("stats", -0.05, 0.0, 0.0, 0.0, "external"), ("dream", 0.0, 0.0, 0.0, 0.0, "external"), ("other", 0.03, 0.0, 0.0, 0.05, "external"), ("null", 0.0, 0.0, 0.05, 0.0, ""),
    }
    described = fusion.described(spark.createDataFrame(given, CHUNKS))
    assert rows(described, "id", *fusion.BOOSTS, "tags") == expected
    fused = spark.createDataFrame([(1, "new", 0.0164, 0.5), (1, "stats", 0.01, -0.2)], "query_id long, id string, rrf_score double, semantic_score double")
    assert rows(fusion.ranked(fused, described), "id", "final_score") == {("new", round(0.5 + 0.0164 + day + 0.073, 4)), ("stats", -0.24)}


def test_lexical_parts_of_a_row(spark):
    chunks = [chunk("a", path="memory/projects/vector-search.md", text="Vector search design, version 12", kind="project"), chunk("b", path="memory/n.md", text=None)]
    queries = spark.createDataFrame([(1, ["vector", "search", "2", "none"], ["vector-search"]), (2, [], [])], QUERIES)
    fused = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.45), (2, "a", 0.5)], "query_id long, id string, semantic_score double")
    # a: two of four terms, as 2 is a part of 12. Terms: file and path, 8 + 4 hundredths each; fragment: file and path, 10 + 6.
    signal = round(0.5 * 0.55 + 0.12 / 0.36 * 0.2 + 0.15 + 0.05, 4)
    expected = {(1, "a", 0.5, 0.12, 0.4, signal), (1, "b", 0.0, 0.0, 0.0, 0.045), (2, "a", 0.0, 0.0, 0.0, 0.05)}
    assert rows(fusion.enriched(fused, spark.createDataFrame(chunks, CHUNKS), queries), "query_id", "id", "lex", "exact", "structured", "signal") == expected


def test_confidence_of_the_text_channels(spark):
    lexical = [
        (1, "a", 1.2, 1.0, 0.36, 0.4, "kg,fts"), (2, "a", 0.05, 0.0, 0.0, 0.0, "kg"), (3, "a", 0.9, 0.75, 0.12, 0.14, "kg,fts"), (3, "b", 0.5, 0.4, 0.0, 0.08, "fts"),
        (4, "b", 0.6, 0.0, 0.0, 0.0, "fts"), (4, "a", 0.6, 1.0, 0.0, 0.0, "fts"),
    ]
    queries = spark.createDataFrame([(q, [], []) for q in range(1, 6)], QUERIES)
    got = fusion.confidence_of(spark.createDataFrame(lexical, LEXICAL), queries)
    third = round(0.1 + 0.9 / 1.2 * 0.15 + 0.75 * 0.25 + 0.05 + 0.14 / 0.4 * 0.2 + 0.1, 4)
    # Of equal scores, as in 4, the smaller id counts; a query without rows, as 5, has a row of its own.
    assert {tuple(r) for r in got.collect()} == {(1, 1, 1.2, 0.9, True), (2, 1, 0.05, 0.1063, False), (3, 2, 0.9, third, False), (4, 2, 0.6, 0.475, False), (5, 0, 0.0, 0.0, False)}


def test_a_trusted_query_goes_without_vectors(spark, monkeypatch):
    before = fusion.served(Store(spark, SMALL)).where("channel = 'vector'").select("query_id").distinct()
    trust = fusion.lexical_confidence(Store(spark, SMALL))
    limit = trust.agg(F.percentile_approx("lexical_confidence", 0.5)).first()[0]
    sure = {r.query_id for r in trust.where(F.col("lexical_confidence") >= limit).collect()}
    monkeypatch.setattr(fusion.confidence_of, "__defaults__", (limit,))
    after = fusion.served(Store(spark, SMALL)).where("channel = 'vector'").select("query_id").distinct()
    asked = {r.query_id for r in before.collect()}
    assert sure & asked and {r.query_id for r in after.collect()} == asked - sure


@pytest.mark.parametrize(
    "category, path, text, external, kind",
    [
        ("Episodic", "memory/projects/a.md", "", True, "episodic"), (None, "memory/x.md", "Title\ncategory:  Preference\n", True, "preference"), (None, "memory/x.md", "Category: invented", True, "external"),
        (None, "./memory/projects/a.md", None, True, "project"), (None, ".\\memory\\episodes\\a.md", None, True, "episodic"), (None, "/memory/projects/a.md", None, True, "project"), (None, "MEMORY.md", "", True, "core_profile"), (None, "memory/2024-01-02.md", "", True, "daily_journal"),
        (None, "memory/2024-01-02-b.md", "", True, "external"), ("", "memory/2024-01-02-b.md", "", False, "raw_log"), (None, None, None, True, "external"), (None, "memory/smart-add/a.md", "x Category: stats", False, "raw_log"),
    ],
)
def test_kinds(spark, category, path, text, external, kind):
    row = spark.createDataFrame([(category, path, text, external)], "category string, path string, text string, external boolean")
    assert row.select(kind_of(F.col("category"), F.col("path"), F.col("text"), F.col("external"))).first()[0] == kind
