"""Intent, skip reasons and the gold replay on prompts whose answers are known."""

import pytest
from pyspark.sql import functions as F

from palimpsest.operators.intent import intents, replayed, skip_reason_of

SCHEMA = "conv_id long, turn int, text string"


@pytest.mark.parametrize(
    "text, reason, recall, long_input, focus",
    [
        (None, "default_allow", True, False, ""),
        ("  \r\n ", "default_allow", True, False, ""),
        ("Tell me of the plan", "default_allow", True, False, "Tell me of the plan"),
        ("Polish this mail", "generic_task_without_history_context", False, False, "Polish this mail"),
        ("polish this\n- a point", "generic_task_without_history_context_long_input", False, True, "polish this - a point"),
        ("translate it as last time", "explicit_history_context", True, False, "结合之前上下文 | translate it as last time"),
        ("上次的 Checkpoint 和 checkpoint", "explicit_history_context", True, False, "结合之前上下文 | Checkpoint checkpoint | 上次的 Checkpoint 和 checkpoint"),
        ("Look:\n```\nTraceback (most recent)", "long_input_without_history_context", False, True, "Look:"),
        ("continue\n2024-01-01 10:00:00 x\nan ERROR line\n|a|b|", "long_input_with_history_context_use_focused_query", True, True, "结合之前上下文 | continue"),
        ("\n".join(["line"] * 31), "long_input_without_history_context", False, True, "line line line"),
        ("x" * 1201, "long_input_without_history_context", False, True, ""),
        ("ab " * 400, "default_allow", True, False, ""),
    ],
)
def test_intents(spark, text, reason, recall, long_input, focus):
    row = intents(spark.createDataFrame([(1, 1, text)], SCHEMA)).first()
    assert (row.reason, row.should_recall, row.long_input, row.focused_query) == (reason, recall, long_input, focus)


def test_skip_reasons(spark):
    cases = {
        None: "empty_prompt", " \n": "empty_prompt", "/new": "slash_command", "hello!!": "greeting", "你好": "greeting", "OK.": "acknowledgement", "ab c": "too_short_compact_le_3", "go there": "too_short_compact_le_8_words_le_2",
        "记得": "none", "recall": "none", "a b c d": "none", "memoryless": "none", "[Mon 2024-01-29 10:30 GMT+8] hi": "greeting", "what is next in the plan": "none",
    }
    rows = spark.createDataFrame([(text,) for text in cases], "text string").select("text", skip_reason_of(F.col("text")).alias("why"))
    assert {r.text: r.why for r in rows.collect()} == cases


def test_replay_counts_invalid_rows_as_failed(spark):
    rows = spark.createDataFrame([(1, 1, "polish it"), (1, 2, "go on with the plan"), (2, 1, "continue")], SCHEMA)
    gold = spark.createDataFrame([(1, 1, False, "generic_task_without_history_context"), (1, 2, False, "default_allow"), (2, 1, None, None), (9, 9, True, "default_allow")], "conv_id long, turn int, expected boolean, expected_reason string")
    got = replayed(rows, gold).first()
    assert (got.total, got.valid, got.passed, got.failed, got.recall_mismatches, got.reason_mismatches, got.pass_rate, got.valid_pass_rate) == (4, 2, 1, 3, 1, 0, 0.25, 0.5)
    none = replayed(rows, gold.limit(0)).first()
    assert (none.total, none.pass_rate, none.valid_pass_rate) == (0, 0.0, 0.0)
