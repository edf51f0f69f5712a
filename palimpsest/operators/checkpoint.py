"""Collecting the logs of a business day: union of sources, best row of each message, and a greedy budget."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.registry import query
from palimpsest.functions.scores import PLAIN_SQL, plain, rounded, rounded_sql
from palimpsest.sources.model import NOW, Store, java

ZONE = "Asia/Shanghai"
# Characters that a day's logs may take, in all, by kind, and by session.
TOTAL, KINDS, SESSION = 40_000, {"smart_add": 16_000, "conversation": 24_000}, 8_000


@query("business_day", "SELECT DISTINCT (created_at + INTERVAL 8 HOUR)::DATE AS day, epoch((created_at + INTERVAL 8 HOUR)::DATE::TIMESTAMP - INTERVAL 8 HOUR)::BIGINT AS starts, epoch((created_at + INTERVAL 8 HOUR)::DATE::TIMESTAMP + INTERVAL 16 HOUR)::BIGINT AS ends FROM ev")
def business_day(s: Store, zone: str = ZONE) -> DataFrame:
    """Days of a zone that have events, with their bounds in UTC."""
    days = s.events.select(F.to_date(F.from_utc_timestamp("created_at", zone)).alias("day")).distinct()
    start = lambda d: F.unix_timestamp(F.to_utc_timestamp(d.cast("timestamp"), zone))
    return days.select("day", start(F.col("day")).alias("starts"), start(F.date_add("day", 1)).alias("ends"))


def logs(s: Store) -> DataFrame:
    """source, session, role, body, at, position: smart-add entries, sidecar rows and transcripts as one log."""
    entries = s.chunks.where(F.col("path").startswith("memory/smart-add/")).select(F.lit("smart_add").alias("source"), F.col("path").alias("session"), F.lit("note").alias("role"), F.col("text").alias("body"), F.col("updated_at").alias("at"), F.col("doc_id").alias("position"))
    raw = s.chunks.join(s.confidence.where("category = 'raw_log'"), F.col("id") == F.col("chunk_id")).select(F.lit("db").alias("source"), "path", F.lit("note"), "text", "updated_at", "doc_id")
    turns = s.table("conversations").where("role IN ('user', 'assistant')").select(F.lit("transcript").alias("source"), F.concat(F.lit("conv-"), F.col("conv_id").cast("string")), "role", "text", (F.lit(NOW) - F.col("conv_id") * 3600 + F.col("turn") * 60).cast("long"), (F.col("conv_id") * 1000 + F.col("turn")))
    return entries.union(raw).union(turns)


LOGS_SQL = f"""logs AS (SELECT 'smart_add' AS source, path AS session, 'note' AS role, text AS body, updated_at AS logged, doc_id AS position FROM chunks WHERE starts_with(path, 'memory/smart-add/')
    UNION ALL SELECT 'db', path, 'note', text, updated_at, doc_id FROM chunks JOIN conf ON id = chunk_id WHERE category = 'raw_log'
    UNION ALL SELECT 'transcript', 'conv-' || conv_id, role, text, ({NOW} - conv_id * 3600 + turn * 60)::BIGINT, conv_id * 1000 + turn FROM conversations WHERE role IN ('user', 'assistant'))"""
_DAY_SQL = "(make_timestamp(logged * 1000000) + INTERVAL 8 HOUR)::DATE"


def with_day(rows: DataFrame) -> DataFrame:
    return rows.withColumn("day", F.to_date(F.from_utc_timestamp(F.timestamp_seconds("at"), ZONE)))


@query("checkpoint_logs", f"+ {LOGS_SQL} SELECT {_DAY_SQL} AS day, source, count(*) AS n, sum(length(body))::BIGINT AS chars FROM logs GROUP BY 1, 2")
def checkpoint_logs(s: Store) -> DataFrame:
    return with_day(logs(s)).groupBy("day", "source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("body")).alias("chars"))


def best_rows(rows: DataFrame) -> DataFrame:
    """Of rows with the same role and words the best one, first on ties: the source counts most, then a time, then a session."""
    rank = F.when(F.col("source") == "transcript", 20).when(F.col("source") == "db", 10).otherwise(0) + F.when(F.col("at").isNotNull(), 2).otherwise(0) + F.when(F.col("session").isNotNull(), 1).otherwise(0)
    key = rows.withColumns({"key": F.md5(F.concat("role", F.lit("|"), plain(F.coalesce("body", F.lit(""))))), "score": rank})
    best = key.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("less"), "position", "source")).alias("b"))
    return key.join(best, "key").where((F.col("source") == F.col("b.source")) & (F.col("position") == F.col("b.position"))).drop("b", "score")


_BEST_SQL = f"best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY role || '|' || {PLAIN_SQL.format('''coalesce(body, '')''')} ORDER BY CASE source WHEN 'transcript' THEN 20 WHEN 'db' THEN 10 ELSE 0 END + CASE WHEN logged IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN session IS NOT NULL THEN 1 ELSE 0 END DESC, position) AS r FROM logs) WHERE r = 1)"


@query("checkpoint_dedupe", f"+ {LOGS_SQL}, {_BEST_SQL} SELECT source, session, role, position FROM best")
def checkpoint_dedupe(s: Store) -> DataFrame:
    return best_rows(logs(s)).select("source", "session", "role", "position")


@query("checkpoint_completeness", f"""+ {LOGS_SQL}, days AS (SELECT DISTINCT (created_at + INTERVAL 8 HOUR)::DATE AS day FROM ev UNION SELECT {_DAY_SQL} FROM logs), sums AS (SELECT {_DAY_SQL} AS day, count(*) AS n, count(*) FILTER (WHERE trim(body) <> '') AS filled, count(*) FILTER (WHERE trim(body) <> '' AND source = 'transcript') AS turns FROM logs GROUP BY 1)
SELECT day, coalesce(n, 0) AS n, coalesce(filled, 0) AS filled, coalesce(turns, 0) AS turns, CASE WHEN n IS NULL THEN 'no_raw_logs' WHEN filled = 0 THEN 'all_logs_empty' WHEN turns = 0 THEN 'no_conversation' ELSE 'ok' END AS status FROM days LEFT JOIN sums USING (day)""")
def checkpoint_completeness(s: Store) -> DataFrame:
    """Whether a day, of those with events or logs, has what a checkpoint needs: logs, some of them not empty, and turns of a conversation."""
    rows, filled = with_day(logs(s)), F.coalesce(F.trim("body") != "", F.lit(False))
    sums = rows.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.count_if(filled).alias("filled"), F.count_if(filled & (F.col("source") == "transcript")).alias("turns"))
    days = business_day(s).select("day").union(rows.select("day")).distinct()
    status = F.when(F.col("n").isNull(), "no_raw_logs").when(F.col("filled") == 0, "all_logs_empty").when(F.col("turns") == 0, "no_conversation").otherwise("ok")
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return days.join(sums, "day", "left").select("day", none("n"), none("filled"), none("turns"), status.alias("status"))


EDGES = r"^\s+|\s+$"
# What a tool's output is known by, and what is read from it.
TEST_RUN, GIT_RUN, DOCTOR_RUN = r"\b(test|jest|mocha|tap|vitest)\b", r"\bgit\b", r"\b(doctor|status|healthcheck|health check)\b"
PASSED, FAILED, DURATION = r"(?i)#\s*pass\s+(\d+)", r"(?i)#\s*fail\s+(\d+)", r"(?i)duration_ms(?:[:=]|\s)\s*([0-9.]+)"
PASS_LINE, FAIL_LINE = r"(?im)^(ok\s+\d+\s+-|pass\b)", r"(?im)^(not ok\s+\d+\s+-|fail\b)"
SKIPPED, TODO = r"(?i)\bskipped\b", r"(?i)\btodo\b"
BRANCHES = [r"(?m)^\*\s+([^\s]+)", r"(?i)\bon branch\s+([^\s]+)", r"[A-Za-z0-9_]##\s+([^\s.]+)"]
COMMITS = [r"(?i)\bcommit\s+([0-9a-f]{7,40})\b", r"(?i)\b([0-9a-f]{7,40})\s+-\s+"]
MODIFIED, UNTRACKED = [r"(?m)^\s*[AMDRC?]{1,2}\s+", r"(?i)\bmodified:\s+"], [r"(?i)\buntracked files?:", r"(?m)^\?\?\s+"]
AHEAD = [r"(?i)\bahead (\d+).+behind \d+", r"(?i)\[(ahead \d+[^\]]*)\]"]
WARNING, ERROR, HIGHLIGHT = r"(?i)\bwarning\b|⚠️|warn:", r"(?i)\berror\b|❌|fail(ed)?:", r"(?i)\bwarning\b|⚠️|warn:|error|❌"
STATS, DRY_RUN = r"\[checkpoint\]\s+Input stats\s+(\{.+\})", r"\[checkpoint\]\s+Dry run summary\s+(\{.+\})"


def tool_results(s: Store) -> DataFrame:
    """conv_id, turn, tool, command, output: assistants' turns as outputs of tools, a kind by turn."""
    kind, text, key = (F.col("conv_id") + F.col("turn")) % 6, F.coalesce("text", F.lit("")), F.col("conv_id").cast("string")
    output = (
        F.when(kind == 0, F.concat(F.lit("ok 1 - a\nnot ok 2 - b\nok 3 - c skipped\nduration_ms: 12.5\n"), text)).when(kind == 1, F.concat(F.lit("# pass "), key, F.lit("\n# fail 0\nTODO "), text))
        .when(kind == 2, F.concat(F.lit("On branch main\n M a.py\n?? b\ncommit "), F.substring(F.sha2(key, 256), 1, 40), F.lit("\n[ahead 2]\n"))).when(kind == 3, F.concat(F.lit("Warning:  low disk\nno error here\nwarn: x\n"), text))
        .when(kind == 4, F.concat(F.lit('[checkpoint] Input stats {"targetDate":"2024-01-01","budgetApplied":true,"droppedByBudgetCount":2,"finalCombinedTextCharCount":'), key, F.lit('}\n[checkpoint] Dry run summary {"rawCount":3}')))
        .otherwise(text)
    )
    of = lambda names: F.element_at(F.array(*[F.lit(x) for x in names]), (kind + 1).cast("int"))
    return s.table("conversations").where("role = 'assistant'").select("conv_id", "turn", of(["exec", "exec", "exec", "doctor", "exec", "read"]).alias("tool"), of(["npm test", "node --test", "git log", "", "run", ""]).alias("command"), output.alias("output"))


_TOOLS_SQL = """tools AS (SELECT conv_id, turn, (['exec', 'exec', 'exec', 'doctor', 'exec', 'read'])[k + 1] AS tool, (['npm test', 'node --test', 'git log', '', 'run', ''])[k + 1] AS command, replace(CASE k WHEN 0 THEN 'ok 1 - a~not ok 2 - b~ok 3 - c skipped~duration_ms: 12.5~'
    WHEN 1 THEN '# pass ' || conv_id || '~# fail 0~TODO ' WHEN 2 THEN 'On branch main~ M a.py~?? b~commit ' || substr(sha256(conv_id::VARCHAR), 1, 40) || '~[ahead 2]~' WHEN 3 THEN 'Warning:  low disk~no error here~warn: x~'
    WHEN 4 THEN '[checkpoint] Input stats {"targetDate":"2024-01-01","budgetApplied":true,"droppedByBudgetCount":2,"finalCombinedTextCharCount":' || conv_id || '}~[checkpoint] Dry run summary {"rawCount":3}' ELSE '' END, '~', chr(10))
    || CASE WHEN k IN (0, 1, 3, 5) THEN coalesce(text, '') ELSE '' END AS output FROM (SELECT *, ((conv_id + turn) % 6)::INT AS k FROM conversations WHERE role = 'assistant'))"""


def found_first(text, patterns: list[str]):
    """The first group of the first pattern that is there, else null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, java(p), 1), F.lit("")) for p in patterns])


def counted_first(text, patterns: list[str]):
    """How often the first pattern is there that is there at all."""
    return F.coalesce(*[F.nullif(F.regexp_count(text, F.lit(java(p))), F.lit(0)) for p in patterns], F.lit(0))


def tool_summary(tool, command, output):
    """What a tool's output comes to: a dry run's figures, results of tests, the state of a git tree, findings of a doctor; null for others and for empty outputs."""
    count = lambda name, n: F.when(n > 0, F.concat(F.lit(f"{name}="), n.cast("string")))
    given = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}="), value))
    listed = lambda kind, *parts: F.concat(F.lit(f"Tool summary: {kind}"), F.concat_ws(", ", *parts))
    has = lambda text, pattern: F.lower(text).rlike(java(pattern))
    stats, dry = F.regexp_extract(output, STATS, 1), F.regexp_extract(output, DRY_RUN, 1)
    of = lambda key: F.get_json_object(stats, f"$.{key}")
    dry_of = lambda key: F.get_json_object(dry, f"$.{key}")
    rehearsal = F.nullif(listed(
        "checkpoint dry-run ", given("targetDate", F.coalesce(dry_of("targetDate"), of("targetDate"))), given("rawCount", dry_of("rawCount")),
        given("combinedChars", F.coalesce(F.nullif(dry_of("combinedTextCharCount"), F.lit("0")), of("finalCombinedTextCharCount"))), given("budgetApplied", of("budgetApplied")), given("droppedByBudget", of("droppedByBudgetCount")),
    ), F.lit("Tool summary: checkpoint dry-run "))
    passed = F.coalesce(found_first(output, [PASSED]).cast("int"), F.regexp_count(output, F.lit(java(PASS_LINE))))
    failed = F.coalesce(found_first(output, [FAILED]).cast("int"), F.regexp_count(output, F.lit(java(FAIL_LINE))))
    tests = listed("tests ", F.concat(F.lit("pass="), passed.cast("string")), count("fail", failed), count("skipped", counted_first(output, [SKIPPED])), count("todo", counted_first(output, [TODO])), given("duration_ms", found_first(output, [DURATION])))
    tree = listed("git ", given("branch", found_first(output, BRANCHES)), given("commit", F.substring(found_first(output, COMMITS), 1, 12)), count("modified", counted_first(output, MODIFIED)), count("untracked", counted_first(output, UNTRACKED)), given("status", found_first(output, AHEAD)))
    shown = F.slice(F.filter(F.transform(F.split(output, "\n"), lambda x: F.regexp_replace(x, EDGES, "")), lambda x: x.rlike(java(HIGHLIGHT))), 1, 2)
    lines = F.transform(shown, lambda x: F.substring(F.regexp_replace(x, r"\s+", " "), 1, 120))
    findings = listed("doctor ", *[F.concat(F.lit(f"{n}="), F.regexp_count(output, F.lit(java(p))).cast("string")) for n, p in (("warnings", WARNING), ("errors", ERROR))], F.when(F.size(lines) > 0, F.concat(F.lit("highlights="), F.array_join(lines, " | "))))
    said, asked = F.concat_ws(" ", tool, command, output), F.concat_ws(" ", tool, command)
    tree = F.when(tree == "Tool summary: git ", "Tool summary: git command ran").otherwise(tree)
    return F.when(F.regexp_replace(output, EDGES, "") != "", F.coalesce(rehearsal, F.when(has(said, TEST_RUN), tests), F.when(has(asked, GIT_RUN), tree), F.when(has(said, DOCTOR_RUN), findings)))


def _first_sql(patterns: list[str]) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(output, '{p}', 1), '')" for p in patterns) + ")"


def _count_sql(patterns: list[str]) -> str:
    return "coalesce(" + ", ".join(f"nullif(len(regexp_extract_all(output, '{p}')), 0)" for p in patterns) + ", 0)"


_FIGURES_SQL = f"""figures AS (SELECT *, nullif(regexp_extract(output, '{STATS}', 1), '') AS stats, nullif(regexp_extract(output, '{DRY_RUN}', 1), '') AS dry, coalesce({_first_sql([PASSED])}::INT, {_count_sql([PASS_LINE])}) AS passed, coalesce({_first_sql([FAILED])}::INT, {_count_sql([FAIL_LINE])}) AS failed, {_count_sql([SKIPPED])} AS skipped,
    {_count_sql([TODO])} AS todo, {_first_sql([DURATION])} AS took, {_first_sql(BRANCHES)} AS branch, {_first_sql(COMMITS)} AS sha, {_count_sql(MODIFIED)} AS modified, {_count_sql(UNTRACKED)} AS untracked, {_first_sql(AHEAD)} AS ahead, {_count_sql([WARNING])} AS warnings, {_count_sql([ERROR])} AS errors,
    list_filter(list_transform(string_split(output, chr(10)), lambda x: regexp_replace(x, '{{edges}}', '', 'g')), lambda x: regexp_matches(x, '{HIGHLIGHT}'))[1:2] AS shown, lower(concat_ws(' ', tool, command)) AS asked, lower(concat_ws(' ', tool, command, output)) AS said FROM tools)"""
_SUMMARY_SQL = f"""CASE WHEN regexp_replace(output, '{{edges}}', '', 'g') = '' THEN NULL WHEN json_valid(stats) OR json_valid(dry) THEN 'Tool summary: checkpoint dry-run ' || concat_ws(', ', 'targetDate=' || coalesce(json_extract_string(dry, '$.targetDate'), json_extract_string(stats, '$.targetDate')), 'rawCount=' || json_extract_string(dry, '$.rawCount'),
    'combinedChars=' || coalesce(nullif(json_extract_string(dry, '$.combinedTextCharCount'), '0'), json_extract_string(stats, '$.finalCombinedTextCharCount')), 'budgetApplied=' || json_extract_string(stats, '$.budgetApplied'), 'droppedByBudget=' || json_extract_string(stats, '$.droppedByBudgetCount'))
    WHEN regexp_matches(said, '{TEST_RUN}') THEN 'Tool summary: tests ' || concat_ws(', ', 'pass=' || passed, CASE WHEN failed > 0 THEN 'fail=' || failed END, CASE WHEN skipped > 0 THEN 'skipped=' || skipped END, CASE WHEN todo > 0 THEN 'todo=' || todo END, 'duration_ms=' || took)
    WHEN regexp_matches(asked, '{GIT_RUN}') THEN 'Tool summary: git ' || coalesce(nullif(concat_ws(', ', 'branch=' || branch, 'commit=' || substr(sha, 1, 12), CASE WHEN modified > 0 THEN 'modified=' || modified END, CASE WHEN untracked > 0 THEN 'untracked=' || untracked END, 'status=' || ahead), ''), 'command ran')
    WHEN regexp_matches(said, '{DOCTOR_RUN}') THEN 'Tool summary: doctor ' || concat_ws(', ', 'warnings=' || warnings, 'errors=' || errors, CASE WHEN len(shown) > 0 THEN 'highlights=' || array_to_string(list_transform(shown, lambda x: substr(regexp_replace(x, '\\s+', ' ', 'g'), 1, 120)), ' | ') END) END"""


@query("tool_summaries", f"+ {_TOOLS_SQL}, {_FIGURES_SQL} SELECT conv_id, turn, {_SUMMARY_SQL} AS summary FROM figures".replace("{edges}", EDGES))
def tool_summaries(s: Store) -> DataFrame:
    return tool_results(s).select("conv_id", "turn", tool_summary(F.col("tool"), F.col("command"), F.col("output")).alias("summary"))


# How entries are told apart, and the characters between two of them.
TAGGED = r"\b(decision|decided|lesson|learned|todo|follow-up|next step|preference|resolved)\b|决定|结论|教训|经验|待办|偏好|总结"
SUMMARY = r"\b(summary|in short|root cause|resolved|fix|caused by|final|conclusion)\b|总结|结论|原因|修复|已解决"
TOOL_SUMMARY = r"\b(tool summary|command summary|result summary)\b"
TOOLS, SEPARATOR, SUMMARY_CHARS, TOOL_SUMMARY_CHARS = 4_000, 5, 1_200, 400
BUDGET = {"total": TOTAL, "smart_add": KINDS["smart_add"], "conversation": KINDS["conversation"], "session": SESSION, "tool": TOOLS}
BLANK = re.compile(r"[ \t\n\x0b\f\r]+$")


def cut_to(text: str, limit: int) -> str:
    """A text in at most limit characters: with a mark at its end if it is cut and there is room for one."""
    if len(text) <= limit:
        return text
    return "" if limit <= 1 else text[:limit] if limit <= 3 else BLANK.sub("", text[: limit - 1]) + "…"


class Greedy:
    """A day's selection so far. Of the sessions only those are kept that have taken something, which the total bounds."""

    def __init__(self, budget: dict[str, int]):
        self.budget, self.combined, self.picked, self.used, self.sessions = budget, 0, 0, Counter(), Counter()

    def take(self, text: str, kind: str, tool: bool, session: str | None) -> str:
        """What is taken of an entry, "" for nothing; the state goes on from it."""
        rooms = [self.budget["total"] - self.combined, self.budget[kind] - self.used[kind]]
        rooms += [self.budget["tool"] - self.used["tool"]] * tool + [self.budget["session"] - self.sessions[session]] * bool(session)
        between = SEPARATOR if self.picked else 0
        taken = cut_to(text, min(rooms) - between) if min(rooms) > between else ""
        if taken:
            cost = len(taken) + between
            self.combined += len(BLANK.sub("", taken)) + between
            self.picked += 1
            self.used[kind] += cost
            self.used["tool"] += cost * tool
            if session:
                self.sessions[session] += cost
        return taken


def budgeted(rows: DataFrame, budget: dict[str, int] = BUDGET) -> DataFrame:
    """rows with `taken`, what a greedy choice takes of each text: best priority first, then by time, position and part.

    rows: day, priority, at (null last), position, part, kind (smart_add or conversation), tool, session (null or empty: none),
    text (trimmed). Each entry gets what all its limits leave, whole or cut, with the separators counted; one for which
    nothing is left is passed over, and later ones may still fit. A day is one sequence, folded as it is read: a task holds
    the state of one day, and of a text no more than the largest limit can take.
    """
    longest, names = max(budget.values()) + 1, rows.columns
    schema = rows.withColumn("taken", F.lit("")).schema

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        day, state = None, Greedy(budget)
        for batch in batches:
            taken = []
            for of, text, kind, tool, session in zip(*[batch.column(c).to_pylist() for c in ("day", "text", "kind", "tool", "session")], strict=True):
                if of != day:
                    day, state = of, Greedy(budget)
                taken.append(state.take(text or "", kind, bool(tool), session))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(taken, pa.string())], [*names, "taken"])

    order = ["day", F.col("priority").desc(), F.col("at").asc_nulls_last(), "position", "part"]
    return rows.withColumn("text", F.left("text", F.lit(longest))).repartition("day").sortWithinPartitions(*order).mapInArrow(fold, schema)


def budget_rows(s: Store) -> DataFrame:
    """The best log entries and the summaries of tools' outputs, as rows of `budgeted`, with the whole text's size."""
    text = F.regexp_replace(F.coalesce("body", F.lit("")), EDGES, "")
    best = best_rows(logs(s)).select("source", F.when(F.col("source") == "transcript", F.col("session")).alias("session"), "role", text.alias("text"), "at", F.col("position").cast("long").alias("position"), F.lit(0).alias("part"), F.lit(False).alias("made"))
    turns = s.table("conversations").select("conv_id", "turn", F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("session"), (F.lit(NOW) - F.col("conv_id") * 3600 + F.col("turn") * 60).cast("long").alias("at"))
    tools = tool_summaries(s).where("summary IS NOT NULL").join(turns, ["conv_id", "turn"])
    tools = tools.select(F.lit("transcript").alias("source"), "session", F.lit("assistant").alias("role"), F.col("summary").alias("text"), "at", (F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("position"), F.lit(1).alias("part"), F.lit(True).alias("made"))
    plain_text = F.trim(F.regexp_replace("text", r"\s+", " "))
    spoken = (F.col("source") == "transcript") & (F.col("role") == "assistant")
    says = lambda pattern, most: (F.length(plain_text) <= most) & plain_text.rlike("(?i)" + java(pattern))
    rows = best.unionByName(tools).withColumns({"tool": F.col("made") | spoken & says(TOOL_SUMMARY, TOOL_SUMMARY_CHARS), "summary": ~F.col("made") & spoken & says(SUMMARY, SUMMARY_CHARS)})
    tagged = (F.col("source") == "smart_add") & F.col("text").rlike("(?i)" + java(TAGGED))
    priority = F.when(tagged, 500).when(F.col("role") == "user", 400).when(F.col("summary"), 300).when(F.col("tool"), 200).when(F.col("role") == "assistant", 100).otherwise(50)
    return with_day(rows.withColumn("priority", priority)).select("day", "priority", "at", "source", "position", "part", F.when(F.col("source") == "smart_add", "smart_add").otherwise("conversation").alias("kind"), "tool", "session", F.length("text").cast("long").alias("size"), "text")


#: The same fold as a recursion over the ranks of a day's entries.
_BUDGET_SQL = f"""
entries AS (
    SELECT source, CASE WHEN source = 'transcript' THEN session END AS session, role, regexp_replace(coalesce(body, ''), '{EDGES}', '', 'g') AS t, logged, position::BIGINT AS position, 0 AS part, FALSE AS made FROM best
    UNION ALL SELECT 'transcript', 'conv-' || f.conv_id, 'assistant', {_SUMMARY_SQL.replace("{edges}", EDGES)}, ({NOW} - f.conv_id * 3600 + f.turn * 60)::BIGINT, f.conv_id * 1000 + f.turn, 1, TRUE FROM figures f),
flat AS (SELECT *, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS p, source = 'transcript' AND role = 'assistant' AS spoken FROM entries WHERE t IS NOT NULL),
marked AS (
    SELECT *, {_DAY_SQL} AS day, made OR spoken AND length(p) <= {TOOL_SUMMARY_CHARS} AND regexp_matches(p, '(?i){TOOL_SUMMARY}') AS tool, NOT made AND spoken AND length(p) <= {SUMMARY_CHARS} AND regexp_matches(p, '(?i){SUMMARY}') AS summary,
        CASE WHEN source = 'smart_add' THEN 'smart_add' ELSE 'conversation' END AS kind
    FROM flat),
ranked AS (
    SELECT day, source, position, part, kind, tool, session, t, row_number() OVER (PARTITION BY day ORDER BY priority DESC, logged NULLS LAST, position, part) AS r
    FROM (SELECT *, CASE WHEN source = 'smart_add' AND regexp_matches(t, '(?i){TAGGED}') THEN 500 WHEN role = 'user' THEN 400 WHEN summary THEN 300 WHEN tool THEN 200 WHEN role = 'assistant' THEN 100 ELSE 50 END AS priority FROM marked)),
fold(day, r, source, position, part, size, taken, combined, picked, smart, spoken, tools, sessions) AS (
    SELECT DISTINCT day, 0::BIGINT, '', 0::BIGINT, 0, 0::BIGINT, '', 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, CAST(MAP {{}} AS MAP(VARCHAR, BIGINT)) FROM ranked
    UNION ALL
    SELECT day, r, source, position, part, length(t), got, combined + CASE WHEN got = '' THEN 0 ELSE length(rtrim(got, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) + gap END, picked + (got <> '')::INT,
        smart + CASE WHEN kind = 'smart_add' AND got <> '' THEN length(got) + gap ELSE 0 END, spoken + CASE WHEN kind <> 'smart_add' AND got <> '' THEN length(got) + gap ELSE 0 END, tools + CASE WHEN tool AND got <> '' THEN length(got) + gap ELSE 0 END,
        CASE WHEN got <> '' AND coalesce(session, '') <> '' THEN map_concat(sessions, MAP {{session: coalesce(sessions[session], 0) + length(got) + gap}}) ELSE sessions END
    FROM (
        SELECT *, CASE WHEN room <= gap THEN '' WHEN length(t) <= room - gap THEN t WHEN room - gap <= 1 THEN '' WHEN room - gap <= 3 THEN substr(t, 1, room - gap)
            ELSE rtrim(substr(t, 1, room - gap - 1), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) || '…' END AS got
        FROM (
            SELECT k.day, k.r, k.source, k.position, k.part, k.kind, k.tool, k.session, k.t, f.combined, f.picked, f.smart, f.spoken, f.tools, f.sessions, CASE WHEN f.picked > 0 THEN {SEPARATOR} ELSE 0 END AS gap,
                least({TOTAL} - f.combined, CASE WHEN k.kind = 'smart_add' THEN {KINDS["smart_add"]} - f.smart ELSE {KINDS["conversation"]} - f.spoken END, CASE WHEN k.tool THEN {TOOLS} - f.tools ELSE {TOTAL} END,
                    CASE WHEN coalesce(k.session, '') <> '' THEN {SESSION} - coalesce(f.sessions[k.session], 0) ELSE {TOTAL} END)::BIGINT AS room
            FROM fold f JOIN ranked k ON k.day = f.day AND k.r = f.r + 1)))"""


@query("checkpoint_budget", f"+ {LOGS_SQL}, {_BEST_SQL}, {_TOOLS_SQL}, {_FIGURES_SQL.replace('{edges}', EDGES)}, {_BUDGET_SQL} SELECT day, source, position, part, size, length(taken)::BIGINT AS taken, md5(taken) AS taken_md5 FROM fold WHERE r > 0")
def checkpoint_budget(s: Store) -> DataFrame:
    """What a day's budget takes of each entry, by kind, session, tools and in all, in the order of priority and time."""
    return budgeted(budget_rows(s)).select("day", "source", "position", "part", "size", F.length("taken").cast("long").alias("taken"), F.md5("taken").alias("taken_md5"))


# The lines of a Markdown file of entries.
FINGERPRINT_LINE = r"(?im)^[ \t]*<!--[ \t]*smart-add-fingerprint:[ \t]*[a-f0-9]{8,64}[ \t]*-->[ \t]*(\n|$)"
META_LINE = r"(?im)^[ \t]*((category|provenance|kg_data):|##)[^\n]*(\n|$)"
CATEGORY_LINE, PROVENANCE_LINE = r"(?im)^[ \t]*category:[ \t]*([^|\n]*)", r"(?im)^[ \t]*provenance:[ \t]*([^\n]*)"
_FILES_SQL = r"""files AS (SELECT doc_id, 'Head of a file' || chr(13) || chr(10) || '<!-- smart-add-fingerprint: ' || substr(id, 1, 16) || ' -->' || chr(10) || '## ' || substr(id, 1, 8) || chr(10) || 'Category: ' || coalesce(category, '') || ' | x' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'Provenance: User' || chr(13) || chr(10) ELSE '' END || coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '## ' || substr(id, 9, 8) || chr(10) || 'kg_data: {}' || chr(10) || 'second' || chr(10) || '## empty' || chr(10) ELSE '' END AS text FROM chunks LEFT JOIN conf ON id = chunk_id WHERE starts_with(path, 'memory/smart-add/'))"""


def entry_files(s: Store) -> DataFrame:
    """doc_id, text: Markdown files as the store keeps entries, each with one entry or more."""
    rows = s.chunks.where(F.col("path").startswith("memory/smart-add/")).join(s.confidence, F.col("id") == F.col("chunk_id"), "left")
    head = F.concat(F.lit("Head of a file\r\n<!-- smart-add-fingerprint: "), F.substring("id", 1, 16), F.lit(" -->\n## "), F.substring("id", 1, 8), F.lit("\nCategory: "), F.coalesce("category", F.lit("")), F.lit(" | x\n"), F.when(F.col("doc_id") % 2 == 0, "Provenance: User\r\n").otherwise(""))
    more = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\n## "), F.substring("id", 9, 8), F.lit("\nkg_data: {}\nsecond\n## empty\n"))).otherwise("")
    return rows.select("doc_id", F.concat(head, F.coalesce("text", F.lit("")), more).alias("text"))


def entries_of(files: DataFrame) -> DataFrame:
    """entry (from 1), entry_id, category, provenance, body of the entries of Markdown files (doc_id, text).

    An entry begins at a line with ##; what comes before the first one belongs to none. Lines of metadata and fingerprints
    are no part of the body, and an entry without a body is none. A missing category is null, a missing provenance unknown.
    """
    text = F.regexp_replace(F.regexp_replace("text", "\r\n", "\n"), FINGERPRINT_LINE, "")
    blocks = F.split(F.regexp_replace(text, r"(?m)^(##\s)", "\u0001$1"), "\u0001")
    rows = files.select("doc_id", F.posexplode(F.filter(blocks, lambda b: b.startswith("##"))).alias("i", "block"))
    strip = lambda c: F.regexp_replace(c, EDGES, "")
    said = F.lower(strip(F.regexp_extract("block", PROVENANCE_LINE, 1)))
    return rows.select(
        "doc_id", (F.col("i") + 1).alias("entry"), strip(F.regexp_replace(F.regexp_extract("block", r"^##([^\n]*)", 1), r"^#*", "")).alias("entry_id"),
        F.when(F.col("block").rlike(CATEGORY_LINE), strip(F.regexp_extract("block", CATEGORY_LINE, 1))).alias("category"), F.when(F.col("block").rlike(PROVENANCE_LINE), said).otherwise("unknown").alias("provenance"),
        strip(F.regexp_replace("block", META_LINE, "")).alias("body"),
    ).where("body <> ''")


@query("parse_entries", f"""+ {_FILES_SQL}, blocks AS (SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '{FINGERPRINT_LINE}', '', 'g'), '(?m)^(##\\s)', chr(1) || '\\1', 'g'), chr(1)), lambda b: starts_with(b, '##')) AS b FROM files), each AS (SELECT doc_id, unnest(b) AS block, generate_subscripts(b, 1)::INT AS entry FROM blocks),
parsed AS (SELECT doc_id, entry, regexp_replace(regexp_replace(regexp_extract(block, '^##([^\\n]*)', 1), '^#*', ''), '{EDGES}', '', 'g') AS entry_id, CASE WHEN regexp_matches(block, '{CATEGORY_LINE}') THEN regexp_replace(regexp_extract(block, '{CATEGORY_LINE}', 1), '{EDGES}', '', 'g') END AS category,
    CASE WHEN regexp_matches(block, '{PROVENANCE_LINE}') THEN lower(regexp_replace(regexp_extract(block, '{PROVENANCE_LINE}', 1), '{EDGES}', '', 'g')) ELSE 'unknown' END AS provenance, regexp_replace(regexp_replace(block, '{META_LINE}', '', 'g'), '{EDGES}', '', 'g') AS body FROM each)
SELECT doc_id, entry, entry_id, category, provenance, md5(body) AS body_md5 FROM parsed WHERE body <> ''""")
def parse_entries(s: Store) -> DataFrame:
    return entries_of(entry_files(s)).select("doc_id", "entry", "entry_id", "category", "provenance", F.md5("body").alias("body_md5"))
