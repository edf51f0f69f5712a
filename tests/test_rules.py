"""Settings, stances and tool summaries on rows whose answers are known."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from palimpsest.operators.checkpoint import tool_summary
from palimpsest.functions.scores import plain
from palimpsest.operators import quality
from palimpsest.operators.quality import changed_flags, holders, judged, marked, mismatched_keys
from palimpsest.operators.text import STANCES, opposed
from palimpsest.sources.model import Store
from tests.oracle import SMALL

SETTINGS = "chunk_id string, text string, set_at long, conflict_flag int"


def test_the_newest_setting_of_a_key_is_not_in_conflict(spark):
    rows = [
        ("a", "配置：Port = 1", 10, 0), ("b", "port = 2", 20, 1), ("c", "note\n配置: port=3", 5, 1), ("d", "alone: x", 1, 1), ("e", "no setting here", 1, 1), ("f", None, 1, 1),
        ("g", "tie = 1", 7, 0), ("h", "tie = 2", 7, None), ("i", "x", 3, 0),
    ]
    got = {(r.chunk_id, r.key, r.conflict_flag) for r in changed_flags(spark.createDataFrame(rows, SETTINGS)).collect()}
    assert got == {("a", "port", 1), ("b", "port", 0), ("d", "alone", 0), ("h", "tie", 1)}


def test_values_differ_beyond_white_space_and_sources(spark):
    rows = [("a", "k = x y, z=1"), ("b", "K=xy （来源：log）"), ("c", "z = 2 (Source: b)"), ("d", "one = 1, one = 2"), ("e", None), ("f", "")]
    got = [tuple(r) for r in mismatched_keys(spark.createDataFrame(rows, "chunk_id string, text string")).collect()]
    assert got == [("z", 2, 2)]


def test_opposed_texts_share_two_topics(spark):
    rows = [
        ("a", "I prefer dark themes for editors"), ("b", "I hate dark themes for editors"), ("c", "I hate dark soup, that with this"), ("d", "prefer dark themes too"), ("e", "hate"), ("f", None), ("g", ""),
        ("h", "我喜欢，深色主题。编辑器很快"), ("i", "我讨厌，深色主题。编辑器很快"),
    ]
    got = {tuple(r) for r in opposed(spark.createDataFrame(rows, "id string, text string")).collect()}
    assert got == {("a", "b", 3, 1), ("b", "d", 2, 1), ("h", "i", 2, 1)}
    assert opposed(spark.createDataFrame([], "id string, text string")).count() == 0


@pytest.mark.parametrize("cell_rows", [3, 2_000])
def test_opposed_pairs_are_those_of_all_pairs_and_none_is_shuffled(spark, cell_rows):
    rng = random.Random(cell_rows)
    topics, said = ["alpha", "beta", "gamma", "delta"], ["prefer", "hate", "great", "terrible", "prefer hate", "great hate", "true", ""]
    rows = [(f"c{i:02}", " ".join([rng.choice(said), *rng.sample(topics, rng.randrange(5)), "longer"])) for i in range(60)] + [("c03", "hate alpha beta"), (None, "hate alpha beta")]
    sides = lambda text: ({i for i, (p, _) in enumerate(STANCES) if re.search(p, text)}, {i for i, (_, n) in enumerate(STANCES) if re.search(n, text)}, {w for w in text.split() if len(w) > 3})
    want = []
    for (i, (p, n, t)), (j, (q, m, u)) in itertools.product([(i, sides(text)) for i, text in rows if i], repeat=2):
        if i < j and len(t & u) > 1 and (p & m or n & q):
            want.append((i, j, len(t & u), len((p & m) | (n & q))))
    found = opposed(spark.createDataFrame(rows, "id string, text string"), cell_rows)
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    # What follows the tables that are written is one join, whose rows go nowhere else.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate|Deduplicate|Window|Distinct", plan)


@pytest.mark.parametrize("side_rows", [4, 2_000])
def test_topics_that_hold_one_another_count_where_none_is_common(spark, side_rows):
    rng = random.Random(side_rows)
    topics, said = ["form", "forms", "reform", "reforms", "inform", "information", "rain", "train", "深色主题", "深色主题很好看", "for", "abc"], ["爱", "hate", "great", "bad", "爱 hate", "爱hate 不行"]
    rows = [(f"c{i:02}", " ".join([rng.choice(said), *rng.sample(topics, rng.randrange(1, 4)), "1234567"]), rng.choice([0.4, 0.5, None])) for i in range(70)] + [("c03", "爱 reforms informs", 0.1), (None, "hate form", 0.5)]
    words = lambda text: {w for w in re.findall(r"[\u4e00-\u9fff]{2,}|[a-z]{4,}", text)}
    sides = lambda text: ({i for i, (p, _) in enumerate(STANCES) if re.search(p, text)}, {i for i, (_, n) in enumerate(STANCES) if re.search(n, text)}, words(text))
    want = []
    for (i, (p, n, t), c), (j, (q, m, u), d) in itertools.product([(i, sides(text), -1 if c is None else c) for i, text, c in rows if i], repeat=2):
        shared = len(t & u)
        if not shared:
            one, other = (t, u) if c >= d else (u, t)
            shared = sum(any(len(v) > 3 and len(w) > 3 and (v in w or w in v) for w in other) for v in one)
        if i < j and shared > 1 and (p & m or n & q):
            want.append((i, j, shared, len((p & m) | (n & q))))
    found = opposed(spark.createDataFrame(rows, "id string, text string, confidence double"), side_rows=side_rows)
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    assert any(not words(dict((i, x) for i, x, _ in rows[:70])[i]) & words(dict((i, x) for i, x, _ in rows[:70])[j]) for i, j, *_ in want)


def test_flags_of_texts_are_told_where_texts_are_read(spark):
    texts = [
        ("a", None, "missing_content"), ("b", " ", "content_empty"), ("c", "short \t\n one", "content_too_short"), ("d", "role : user, said in full", "raw_log_leak"), ("e", "# Assistant\nand more of it all", "raw_log_leak"), ("f", "Traceback (most recent call last)", "debug_noise"),
        ("g", "    at run (a.js:10:5)\nand so on and on", "debug_noise"), ("h", "User TALKED about many things here", "too_generic"), ("i", "User talked about v1.2 of many things", ""), ("j", "x" * 4001, "content_too_long"), ("k", "on 2024-01-05 10:00:00 it was so", "timestamp_pollution"), ("l", "a: b (c) # d, nothing else here", ""),
    ]
    rows = marked(spark.createDataFrame([(i, text) for i, text, _ in texts], "id string, text string"))
    assert {r.id: ",".join(r.marks) for r in rows.collect()} == {i: mark for i, _, mark in texts}
    assert "text" not in judged(Store(spark, SMALL)).columns


def test_plain_texts(spark):
    rows = [(" A  b\tC\n\n d e\x0b",), ("\t",), ("a b c",), (None,), ("",)]
    assert [r[0] for r in spark.createDataFrame(rows, "t string").select(plain(F.col("t"))).collect()] == ["a b c d e", "", "a b c", None, ""]


def test_holders_are_those_of_a_search_for_each_text(spark, monkeypatch):
    monkeypatch.setattr(quality, "SLICE", 16)
    stored = ["", None, "the quick brown fox", "the quick brown fox the quick brown fox", "ünïcödé texts, 用户讨论项目记忆系统", "x" * 50, "用户讨论", "brown fo", "the quick brown", "x the quick"]
    new = [(1, "quick brown"), (1, "the quick brown fox"), (2, "x"), (3, ""), (4, None), (5, "讨论项目记"), (6, "ünïcödé"), (7, "xxxxxxxx"), (8, "nowhere at all"), (9, "foxthe quick"), (10, "quick b")]
    found = holders(spark.createDataFrame([(t,) for t in stored], "low string").repartition(2), spark.createDataFrame(new, "item_id long, new string"))
    want = {}
    for i, text in new:
        want[i] = want.get(i, 0) + sum(text is not None and t is not None and text in t for t in stored)
    assert {r.item_id: r.n for r in found.groupBy("item_id").agg(F.sum("n").alias("n")).collect()} == {i: n for i, n in want.items() if n}
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "tool, command, output, summary",
    [
        ("exec", "npm test", "ok 1 - a\nnot ok 2 - b\nPASS x\n", "tests pass=2, fail=1"),
        ("exec", "x", "# pass 12\n# fail 0\n1 skipped\nduration_ms 9.5\ntap", "tests pass=12, skipped=1, duration_ms=9.5"),
        ("exec", "git status", "On branch dev\n M a\n?? b\n[ahead 2, behind 1]", "git branch=dev, modified=2, untracked=1, status=2"),
        ("exec", "git push", "done", "git command ran"),
        ("exec", "git log", "0123456789abcdef - first", "git commit=0123456789ab"),
        ("doctor", "", "all\n  warn:   slow  disk \nerror: x\nwarning y", "doctor warnings=2, errors=1, highlights=warn: slow disk | error: x"),
        ("x", "y", '[checkpoint] Dry run summary {"targetDate":"2024-01-02","rawCount":0,"combinedTextCharCount":0}', "checkpoint dry-run targetDate=2024-01-02, rawCount=0"),
        ("x", "y", "[checkpoint] Input stats {broken}", None),
        ("read", "", "some text", None),
        ("exec", "npm test", " \n", None),
        ("exec", "npm test", None, None),
    ],
)
def test_tool_summaries(spark, tool, command, output, summary):
    rows = spark.createDataFrame([(tool, command, output)], "tool string, command string, output string")
    got = rows.select(tool_summary(F.col("tool"), F.col("command"), F.col("output"))).first()[0]
    assert got == (summary and f"Tool summary: {summary}")


def test_details_in_han_letters_stand_between_ascii_words(spark):
    from palimpsest.operators.quality import DETAIL_RULES, any_rule

    texts = {"用户讨论完成": False, "用户讨论 done": True, "a完成b": True, "完成": False, "v1.2": True, "the abandoned": False, "用户 FIXED it": True}
    df = spark.createDataFrame(list(texts.items()), "text string, wanted boolean")
    assert {r.text: r.found for r in df.select("text", any_rule(F.col("text"), DETAIL_RULES).alias("found")).collect()} == texts


def test_families_of_signals(spark):
    from palimpsest.operators.text import RESCUE

    texts = {
        "值班Telegram提醒": "transient", "Sol值班 今天": "transient", "Gateway 又重启": "transient", "gateway 又重启": None, "reference utc: 1": None, "Reference UTC: 1": "transient", " [CRON:x] go": "transient", "验证通过": "engineering", "12 tests, 12 pass": "engineering",
        "every: \"0m\"": "engineering", "心跳已关闭": "engineering", "[决策] a [教训] b [偏好] c [待办]": "engineering", "plain text": None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for name in ("transient", "engineering"):
        found = {r.text for r in df.where(F.col("text").rlike(RESCUE[name])).collect()}
        assert found == {t for t, n in texts.items() if n == name}
