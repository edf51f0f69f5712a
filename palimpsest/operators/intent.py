"""Whether a prompt asks for recall: its intent, a focused query, why it is skipped, and a gold set to hold this against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.registry import query
from palimpsest.functions.scores import rounded, rounded_sql
from palimpsest.sources.model import STAMP, Store, java

EDGES = r"^\s+|\s+$"
# What a prompt says that goes on from earlier talk, and what one says that needs none. Longer phrases that hold one of these are left out.
HISTORY = "(?i)继续|上次|之前|当前基线|结合历史|结合项目|当前状态|记得我说过|continue|previous|last time|remember i said|project history|current baseline"
GENERIC = "(?i)翻译|润色|改写|总结当前文本|提取要点|改格式|生成标题|语法检查|translate|polish|rewrite|summari[sz]e (this|current) text|extract key points|reformat|generate title|grammar check"
# Signs of pasted code, logs, tables and lists.
STRUCTURE = {
    "fence": "```", "indented": r"(?m)^\s{4,}\S", "exception": "Exception|Traceback", "frame": r"at\s+\S+\s+\(", "tag": r"(?m)^\[[A-Z]+\]",
    "stamp": r"(?m)^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}", "table": r"(?m)^\|.+\|.+\|", "bullet": r"(?m)^\s*[-*]\s+\S",
}
# Lines that are no part of an instruction.
NO_INSTRUCTION = {
    "fence": "^```", "table": r"^\|.+\|.+\|?$", "failure": r"(?i)^(exception|traceback|at\s+\S+\s+\()", "stamp": r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}",
    "log": r"(?i)\b(debug|info|warn|error|trace|log[_ -]?\w*)\b",
}
# Prompts that recall is forced for, and those that are too little to recall for.
TRIGGER = r"(?i)\b(remember|recall|memory|memories|previous|last time|said before|preference|preferences|habit|habits)\b|[记忆]|之前|上次|我说过|偏好|习惯"
GREETING = r"(?i)^(hi|hello|hey|yo|good morning|good evening|你好|嗨|早|早上好|晚安)[.!?\s]*$"
ACKNOWLEDGED = r"(?i)^(ok|okay|k|yes|yep|yeah|sure|thanks|thank you|got it|continue|go on|好|好的|可以|嗯|行|收到|继续)[.!?\s]*$"
LONG_CHARS, LONG_LINES, LINE_CHARS, LINES, FOCUS_CHARS, FOCUS_MARK = 1200, 30, 220, 3, 280, "结合之前上下文"
#: Names of a user's own projects and parts of them, as a pattern.
ENTITIES = r"(?i)\b(palimpsest|checkpoint|reinforcement|hybrid_search)\b"


def prompts(s: Store) -> DataFrame:
    """conv_id, turn, text: the user's turns, some with openings and lists of the kinds that the rules know."""
    kind, text = F.col("conv_id") % 9, F.coalesce("text", F.lit(""))
    said = (
        F.when(kind == 1, F.concat(F.lit("Continue with the palimpsest Checkpoint.\r\n"), text)).when(kind == 2, F.concat(F.lit("Please translate: "), text))
        .when(kind == 3, F.concat(text, F.lit("\n- point\n2024-01-01 10:00:00 started\n[INFO] done\n```"))).when(kind == 4, F.concat(F.lit("[Mon 2024-01-29 10:30 GMT+8] remember? "), text))
        .when(kind == 5, F.element_at(F.array(*[F.lit(x) for x in ["ok!", "Hello", "/status", "  ", "x y", "go there", "好的"]]), (F.col("turn") % 7 + 1).cast("int")))
        .when(kind == 6, F.concat(F.lit("previous Traceback\n"), text)).otherwise(text)
    )
    return s.table("conversations").where("role = 'user'").select("conv_id", "turn", said.alias("text"))


_PROMPTS_SQL = """prompts AS (SELECT conv_id, turn, CASE conv_id % 9 WHEN 1 THEN 'Continue with the palimpsest Checkpoint.' || chr(13) || chr(10) || t WHEN 2 THEN 'Please translate: ' || t
    WHEN 3 THEN t || replace('|- point|2024-01-01 10:00:00 started|[INFO] done|```', '|', chr(10)) WHEN 4 THEN '[Mon 2024-01-29 10:30 GMT+8] remember? ' || t
    WHEN 5 THEN (['ok!', 'Hello', '/status', '  ', 'x y', 'go there', '好的'])[(turn % 7 + 1)::INT] WHEN 6 THEN 'previous Traceback' || chr(10) || t ELSE t END AS text
    FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations WHERE role = 'user'))"""


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, EDGES, "")


def any_of(text: Column, rules: dict[str, str]) -> Column:
    found = F.lit(False)
    for pattern in rules.values():
        found = found | text.rlike(java(pattern))
    return found


def _any_sql(text: str, rules: dict[str, str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, '{p}')" for p in rules.values()) + ")"


def focused_query(text: Column, history: Column, entities: Column) -> Column:
    """The first lines that instruct, after the entities named, cut to what a query may have."""
    lines = F.filter(F.transform(F.split(text, "\n"), stripped), lambda x: (x != "") & (F.length(x) <= LINE_CHARS) & ~any_of(x, NO_INSTRUCTION))
    instruction = F.array_join(F.slice(lines, 1, LINES), " ")
    parts = F.concat_ws(" | ", F.when(history, FOCUS_MARK), F.when(F.size(entities) > 0, F.array_join(F.slice(entities, 1, 5), " ")), F.when(instruction != "", instruction))
    return F.substring(stripped(F.regexp_replace(parts, r"\s+", " ")), 1, FOCUS_CHARS)


def intents(rows: DataFrame, entities: str = ENTITIES) -> DataFrame:
    """rows with a text, and reason, should_recall, long_input, generic, history, n_chars, n_lines, entities, focused_query.

    A null text is an empty one. Long is what has many characters or lines, or the signs of pasted code and logs.
    """
    text = stripped(F.regexp_replace(F.coalesce("text", F.lit("")), "\r", ""))
    rows = rows.withColumn("said", text).withColumns({
        "n_chars": F.length("said").cast("long"), "n_lines": F.when(F.col("said") == "", 0).otherwise(F.size(F.split("said", "\n"))).cast("long"), "history": F.col("said").rlike(HISTORY),
        "generic": F.col("said").rlike(GENERIC), "structural": any_of(F.col("said"), STRUCTURE), "entities": F.array_distinct(F.regexp_extract_all("said", F.lit(java(entities)), F.lit(0))),
    })
    rows = rows.withColumn("long_input", (F.col("n_chars") > LONG_CHARS) | (F.col("n_lines") > LONG_LINES) | F.col("structural"))
    long, history, generic = F.col("long_input"), F.col("history"), F.col("generic")
    reason = (
        F.when(generic & ~history & long, "generic_task_without_history_context_long_input").when(generic & ~history, "generic_task_without_history_context").when(long & ~history, "long_input_without_history_context")
        .when(long, "long_input_with_history_context_use_focused_query").when(history, "explicit_history_context").otherwise("default_allow")
    )
    return rows.withColumns({"reason": reason, "should_recall": history | ~(generic | long), "focused_query": focused_query(F.col("said"), history, F.col("entities"))}).drop("said", "structural")


_INTENT_SQL = f"""{_PROMPTS_SQL}, said AS (SELECT *, regexp_replace(replace(text, chr(13), ''), '{EDGES}', '', 'g') AS said FROM prompts),
felt AS (SELECT *, length(said) AS n_chars, CASE WHEN said = '' THEN 0 ELSE len(string_split(said, chr(10))) END AS n_lines, regexp_matches(said, '{HISTORY}') AS history, regexp_matches(said, '{GENERIC}') AS generic,
    regexp_extract_all(said, '{ENTITIES}') AS named, list_filter(list_transform(string_split(said, chr(10)), lambda x: regexp_replace(x, '{EDGES}', '', 'g')), lambda x: x <> '' AND length(x) <= {LINE_CHARS} AND NOT {_any_sql("x", NO_INSTRUCTION)}) AS told FROM said),
i AS (SELECT * EXCLUDE (named), list_filter(named, lambda x, n: list_position(named, x) = n) AS entities, n_chars > {LONG_CHARS} OR n_lines > {LONG_LINES} OR {_any_sql("said", STRUCTURE)} AS long_input FROM felt)"""
_REASON_SQL = "CASE WHEN generic AND NOT history AND long_input THEN 'generic_task_without_history_context_long_input' WHEN generic AND NOT history THEN 'generic_task_without_history_context' WHEN long_input AND NOT history THEN 'long_input_without_history_context' WHEN long_input THEN 'long_input_with_history_context_use_focused_query' WHEN history THEN 'explicit_history_context' ELSE 'default_allow' END"
_FOCUS_SQL = f"substr(trim(regexp_replace(concat_ws(' | ', CASE WHEN history THEN '{FOCUS_MARK}' END, CASE WHEN len(entities) > 0 THEN array_to_string(entities[1:5], ' ') END, CASE WHEN len(told) > 0 THEN array_to_string(told[1:{LINES}], ' ') END), '\\s+', ' ', 'g')), 1, {FOCUS_CHARS})"


@query("recall_intent", f"+ {_INTENT_SQL} SELECT conv_id, turn, {_REASON_SQL} AS reason, history OR NOT (generic OR long_input) AS should_recall, long_input, generic, history, n_chars, n_lines, len(entities) AS n_entities, {_FOCUS_SQL} AS focused_query FROM i")
def recall_intent(s: Store) -> DataFrame:
    return intents(prompts(s)).select("conv_id", "turn", "reason", "should_recall", "long_input", "generic", "history", "n_chars", "n_lines", F.size("entities").cast("long").alias("n_entities"), "focused_query")


def skip_reason_of(text: Column) -> Column:
    """Why a prompt is not looked at, 'none' if it is: commands, greetings and very short texts, unless it asks for memory."""
    said = stripped(F.regexp_replace(stripped(F.coalesce(text, F.lit(""))), STAMP, ""))
    compact, words = F.length(F.regexp_replace(said, r"\s+", "")), F.size(F.split(said, r"\s+"))
    return (
        F.when(said == "", "empty_prompt").when(said.startswith("/"), "slash_command").when(said.rlike(java(TRIGGER)), "none").when(said.rlike(GREETING), "greeting").when(said.rlike(ACKNOWLEDGED), "acknowledgement")
        .when(compact <= 3, "too_short_compact_le_3").when((compact <= 8) & (words <= 2), "too_short_compact_le_8_words_le_2").otherwise("none")
    )


_SKIP_SQL = f"""{_PROMPTS_SQL}, p AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(text, '{EDGES}', '', 'g'), '{STAMP}', ''), '{EDGES}', '', 'g') AS said FROM prompts)
SELECT conv_id, turn, CASE WHEN said = '' THEN 'empty_prompt' WHEN starts_with(said, '/') THEN 'slash_command' WHEN regexp_matches(said, '{TRIGGER}') THEN 'none' WHEN regexp_matches(said, '{GREETING}') THEN 'greeting' WHEN regexp_matches(said, '{ACKNOWLEDGED}') THEN 'acknowledgement'
    WHEN length(regexp_replace(said, '\\s+', '', 'g')) <= 3 THEN 'too_short_compact_le_3' WHEN length(regexp_replace(said, '\\s+', '', 'g')) <= 8 AND len(regexp_split_to_array(said, '\\s+')) <= 2 THEN 'too_short_compact_le_8_words_le_2' ELSE 'none' END AS skip_reason FROM p"""


@query("skip_reason", f"+ {_SKIP_SQL}")
def skip_reason(s: Store) -> DataFrame:
    return prompts(s).select("conv_id", "turn", skip_reason_of(F.col("text")).alias("skip_reason"))


def replayed(rows: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: how the decisions on rows agree with gold (conv_id, turn, expected, expected_reason); a gold row without either is invalid, and fails."""
    both = gold.join(intents(rows), ["conv_id", "turn"], "left")
    n, valid = F.count(F.lit(1)), F.col("expected").isNotNull() & F.col("expected_reason").isNotNull() & F.col("reason").isNotNull()
    recall, why = F.col("should_recall") == F.col("expected"), F.col("reason") == F.col("expected_reason")
    sums = both.agg(n.alias("total"), F.count_if(valid).alias("valid"), F.count_if(valid & recall & why).alias("passed"), F.count_if(valid & ~recall).alias("recall_mismatches"), F.count_if(valid & ~why).alias("reason_mismatches"))
    rate = lambda of: F.when(F.col(of) > 0, rounded(F.col("passed") / F.col(of))).otherwise(0.0)
    return sums.withColumns({"invalid": F.col("total") - F.col("valid"), "failed": F.col("total") - F.col("passed"), "pass_rate": rate("total"), "valid_pass_rate": rate("valid")})


_REPLAY_SQL = f"""{_INTENT_SQL}, g AS (SELECT conv_id % 13 <> 0 AS valid, {_REASON_SQL} AS reason, history OR NOT (generic OR long_input) AS got, conv_id % 9 NOT IN (2, 3) AS expected,
    CASE WHEN conv_id % 9 IN (1, 4) THEN 'explicit_history_context' WHEN conv_id % 9 = 2 THEN 'generic_task_without_history_context' WHEN conv_id % 9 = 3 THEN 'long_input_without_history_context' ELSE 'default_allow' END AS wanted FROM i),
r AS (SELECT count(*) AS total, count(*) FILTER (WHERE valid) AS valid, count(*) FILTER (WHERE valid AND got = expected AND reason = wanted) AS passed, count(*) FILTER (WHERE valid AND got <> expected) AS recall_mismatches, count(*) FILTER (WHERE valid AND reason <> wanted) AS reason_mismatches FROM g)
SELECT *, total - valid AS invalid, total - passed AS failed, CASE WHEN total > 0 THEN {rounded_sql('passed / total::DOUBLE')} ELSE 0 END AS pass_rate, CASE WHEN valid > 0 THEN {rounded_sql('passed / valid::DOUBLE')} ELSE 0 END AS valid_pass_rate FROM r"""


@query("gold_replay", f"+ {_REPLAY_SQL}")
def gold_replay(s: Store) -> DataFrame:
    """The gold set here says what the opening of each prompt asks for; rows of some conversations lack their label."""
    rows, kind = prompts(s), F.col("conv_id") % 9
    wanted = F.when(kind.isin(1, 4), "explicit_history_context").when(kind == 2, "generic_task_without_history_context").when(kind == 3, "long_input_without_history_context").otherwise("default_allow")
    gold = rows.select("conv_id", "turn", F.when(F.col("conv_id") % 13 != 0, ~kind.isin(2, 3)).alias("expected"), wanted.alias("expected_reason"))
    return replayed(rows, gold)
