"""Quotas against a plain choice in stages, and levels and windows of events written by hand."""

import datetime
import random

from pyspark.sql import functions as F

from palimpsest.operators.quality import DREAM_RULES, HEADER_RULES, STAGED_RULES, TOOL_RULES, any_rule, picked
from palimpsest.operators.rollups import by_levels, by_time, sliding
from palimpsest.operators.sampling import BUCKETS, sampled

ROWS = "sample_id string, bucket string, boundary double, risk double, conflict boolean, transient boolean"


def plain(rows, limit, shares, buckets=BUCKETS):
    rows, out = list(rows), []
    near = lambda r: (r[2] is None, r[2] or 0, -(r[3] or 0), r[0])
    count = lambda share, n: min(n, max(1, int(limit * share))) if limit > 0 and n > 0 and share > 0 else 0
    chosen = set()

    def take(some, n, reason):
        for r in some:
            if n <= 0:
                break
            if r[0] not in chosen:
                chosen.add(r[0])
                out.append((r[0], reason, len(out) + 1))
                n -= 1

    conflicts, transients = [r for r in rows if r[4]], [r for r in rows if r[5]]
    take(sorted(conflicts, key=near), count(shares["conflict"], len(conflicts)), "conflict")
    take(sorted(transients, key=lambda r: (-(r[3] or 0), *near(r))), min(count(shares["transient"], len(transients)), limit - len(out)), "transient")
    left = min(count(shares["buckets"], len(buckets)), limit - len(out))
    for b in buckets:
        some = sorted((r for r in rows if r[1] == b and r[0] not in chosen), key=near)
        if left > 0 and some:
            take(some[:1], 1, "bucket")
            left -= 1
    take(sorted(rows, key=near), limit - len(out), "boundary")
    return out


def test_stages_against_a_plain_choice(spark):
    rng = random.Random(8)
    rows = [(f"s{i:03}", rng.choice([*BUCKETS, "other", None]), rng.choice([None, *map(float, range(6))]), rng.choice([None, 0.0, 1.0, 5.0]), rng.random() < 0.2, rng.choice([True, False, False, None])) for i in range(90)]
    df = spark.createDataFrame(rows, ROWS).repartition(4)
    for limit, shares in ((20, {"conflict": 0.25, "transient": 0.1, "buckets": 0.3}), (5, {"conflict": 0.9, "transient": 0.9, "buckets": 0.9}), (300, {"conflict": 0.25, "transient": 0.1, "buckets": 0.3}), (0, {"conflict": 0.2, "transient": 0.1, "buckets": 0.3})):
        got = sorted((tuple(r) for r in sampled(df, limit, shares=shares).collect()), key=lambda r: r[2])
        assert got == plain([(*r[:4], bool(r[4]), bool(r[5])) for r in rows], limit, shares)


def test_repeated_and_missing_ids(spark):
    rows = [("a", "todo", 5.0, 1.0, False, False), ("a", "todo", 1.0, 1.0, False, False), (None, "todo", 0.0, 1.0, True, True), ("b", "todo", 2.0, 1.0, False, False)]
    assert [tuple(r) for r in sampled(spark.createDataFrame(rows, ROWS), 5).orderBy("place").collect()] == [("a", "bucket", 1), ("b", "boundary", 2)]
    assert sampled(spark.createDataFrame([], ROWS), 5).count() == 0


EVENTS = "event_type string, session_id string, memory_id string, latency_ms long, category string, source string, created_at timestamp"


def test_levels_tell_nulls_from_sums(spark):
    at = datetime.datetime(2024, 1, 10, 12)
    rows = [("x", "s1", "m", 10, "a", "p", at), ("x", "s1", "m", 20, "a", None, at), ("y", "", "n", 60, None, None, at)]
    got = {tuple(r) for r in by_levels(spark.createDataFrame(rows, EVENTS)).collect()}
    assert got == {
        ("category and source", "a", "p", 1, 1, 10.0), ("category and source", "a", None, 1, 1, 20.0), ("category and source", None, None, 1, 0, 60.0), ("category", "a", None, 2, 1, 15.0), ("category", None, None, 1, 0, 60.0),
        ("source", None, "p", 1, 1, 10.0), ("source", None, None, 2, 1, 40.0), ("all", None, None, 3, 1, 30.0),
    }
    day = at.date()
    assert {tuple(r) for r in by_time(spark.createDataFrame(rows, EVENTS)).collect()} == {(day, "x", 2), (day, "y", 1), (day, None, 3), (None, None, 3)}


def test_windows_overlap_and_end_before_their_last_moment(spark):
    day = lambda d, h=0: datetime.datetime(2024, 1, d, h)
    rows = [("x", "s", "m1", 1, "a", "p", day(10)), ("x", "s", "m1", 1, "a", "p", day(11, 5)), ("x", "s", "m2", 1, "a", "p", day(17))]
    got = {(r.starts.day, r.ends.day, r.events, r.memories) for r in sliding(spark.createDataFrame(rows, EVENTS)).collect()}
    assert got == {(4, 11, 1, 1), *((d, d + 7, 2, 1) for d in range(5, 11)), (11, 18, 2, 2), *((d, d + 7, 1, 1) for d in range(12, 18))}
    assert sliding(spark.createDataFrame([], EVENTS)).count() == 0


def test_people_look_at_some_of_each_bucket_and_the_riskiest_of_the_others(spark):
    draw = random.Random(3)
    for limit, each, n in [(20, 3, 300), (200, 30, 90), (7, 4, 60), (40, 2, 300)]:
        names = ["a", "b", "c", "d"]
        given = [(f"i{k:03d}", [b for b in names if draw.random() < 0.3 * (b != "c")], draw.randrange(6)) for k in range(n)]
        order = sorted(given, key=lambda r: (-r[2], r[0]))
        want: list[str] = []
        for b in names:
            some = [r[0] for r in order if b in r[1] and r[0] not in want][:each]
            want += some[: limit - len(want)]
        want += [r[0] for r in order if r[0] not in want][: limit - len(want)]
        rows = spark.createDataFrame(given, "id string, buckets array<string>, risk int")
        assert sorted(r.id for r in picked(rows, [F.col("risk").desc(), "id"], names, limit, each).collect()) == sorted(want)
        assert len(want) == min(limit, n)


def test_signs_of_outputs_headers_and_dreams(spark):
    texts = {
        "a stdout line": "tool", "> said so": "tool", "x ```\n": "tool", "process exited with CODE 1": "tool", "exitcodes": None, "a > b": None, "stderr": "tool", "no SQLiteError": "tool", "Category : x": "header", "see\n  kg_data: y": "header", "a category: x": None,
        '{"generatedAt" : 1}': "header", "#  Deep Sleep": "dream_log", "Ranked 3 candidate(s) for durable promotion": "dream_log", "Ranked\n candidates for durable promotion": None, "- Candidate: a, Confidence: 1, evidence: b, status: staged": "staged", "- Candidate: a, status: staged": None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rules = {"tool": TOOL_RULES, "header": HEADER_RULES, "dream_log": DREAM_RULES}
    for name, some in rules.items():
        assert {r.text for r in df.where(any_rule(F.col("text"), some)).collect()} == {t for t, n in texts.items() if n == name}
    assert {r.text for r in df.where(" AND ".join(f"text RLIKE r'{rule}'" for rule in STAGED_RULES)).collect()} == {t for t, n in texts.items() if n == "staged"}
