"""Aggregates over the sidecar and the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.registry import query
from palimpsest.functions.scores import rounded, rounded_sql, share
from palimpsest.sources.model import NOW, Store

DAYS = 86400


def recent(events: DataFrame, days: int) -> DataFrame:
    """Events of the trailing days; there is no upper bound."""
    return events.where(F.unix_timestamp("created_at") >= NOW - max(1, days) * DAYS)


def recent_sql(days: int) -> str:
    return f"epoch(created_at) >= {NOW - max(1, days) * DAYS}"


def _status(rows: DataFrame, *by: str) -> DataFrame:
    n = lambda c: F.sum(c).cast("long")
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("tracked"), n("is_archived").alias("archived"), n("is_protected").alias("protected"), n("conflict_flag").alias("conflicts"),
        rounded(F.avg("confidence")).alias("avg_confidence"), rounded(F.avg("base_tau"), 2).alias("avg_tau"), rounded(F.avg("hit_count"), 2).alias("avg_hits"),
    )


_STATUS_SQL = f"count(*) AS tracked, sum(is_archived)::BIGINT AS archived, sum(is_protected)::BIGINT AS protected, sum(conflict_flag)::BIGINT AS conflicts, {rounded_sql('avg(confidence)')} AS avg_confidence, {rounded_sql('avg(base_tau)', 2)} AS avg_tau, {rounded_sql('avg(hit_count)', 2)} AS avg_hits"


@query("status_summary", f"SELECT s.*, m.missing FROM (SELECT {_STATUS_SQL} FROM conf) s, (SELECT count(*) AS missing FROM chunks WHERE id NOT IN (SELECT chunk_id FROM conf)) m")
def status_summary(s: Store) -> DataFrame:
    missing = s.chunks.join(s.confidence, F.col("id") == F.col("chunk_id"), "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    return _status(s.confidence).crossJoin(missing)  # one row each


@query("status_by_category", f"SELECT category, {_STATUS_SQL} FROM conf GROUP BY category")
def status_by_category(s: Store) -> DataFrame:
    return _status(s.confidence, "category")


@query("status_active_by_category", f"SELECT category, {_STATUS_SQL} FROM conf WHERE is_archived = 0 GROUP BY category")
def status_active_by_category(s: Store) -> DataFrame:
    return _status(s.confidence.where("is_archived = 0"), "category")


@query("overview", f"SELECT count(*) AS tracked, {rounded_sql('avg(confidence)', 3)} AS avg_confidence, sum(CASE WHEN is_archived = 1 THEN 1 ELSE 0 END)::BIGINT AS archived, count(*) FILTER (WHERE conflict_flag = 1) AS conflicts, count(*) FILTER (WHERE is_protected = 1) AS protected FROM conf")
def overview(s: Store) -> DataFrame:
    return s.confidence.agg(F.count(F.lit(1)).alias("tracked"), rounded(F.avg("confidence"), 3).alias("avg_confidence"), F.count_if(F.col("is_archived") == 1).alias("archived"), F.count_if(F.col("conflict_flag") == 1).alias("conflicts"), F.count_if(F.col("is_protected") == 1).alias("protected"))


@query("hit_concentration", f"""+ a AS (SELECT hit_count, row_number() OVER (ORDER BY hit_count DESC, chunk_id) AS r FROM conf WHERE is_archived = 0 AND hit_count > 0), t AS (SELECT sum(hit_count)::DOUBLE AS total FROM a)
SELECT {rounded_sql('sum(hit_count) FILTER (WHERE r <= 10) / any_value(total)')} AS top10_share, {rounded_sql('sum(hit_count * hit_count) / (any_value(total) * any_value(total))')} AS hhi, count(*) AS memories FROM a, t""")
def hit_concentration(s: Store) -> DataFrame:
    active = s.confidence.where("is_archived = 0 AND hit_count > 0")
    top = active.orderBy(F.col("hit_count").desc(), "chunk_id").limit(10).agg(F.sum("hit_count").alias("top"))
    whole = active.agg(F.sum("hit_count").alias("total"), F.sum(F.col("hit_count") * F.col("hit_count")).alias("squares"), F.count(F.lit(1)).alias("memories"))
    return whole.crossJoin(top).select(rounded(F.col("top") / F.col("total")).alias("top10_share"), rounded(F.col("squares") / (F.col("total") * F.col("total"))).alias("hhi"), "memories")


@query("recall_aggregate", f"""SELECT count(*) AS completed, {rounded_sql('avg(latency_ms)', 1)} AS avg_latency, {rounded_sql('avg(candidate_count)', 1)} AS avg_candidates, {rounded_sql('avg(injected_count)', 1)} AS avg_injected,
sum(candidate_count)::BIGINT AS candidates, sum(injected_count)::BIGINT AS injected FROM ev WHERE event_type = 'recall_completed' AND {recent_sql(7)}""")
def recall_aggregate(s: Store) -> DataFrame:
    rows = recent(s.events, 7).where("event_type = 'recall_completed'")
    return rows.agg(F.count(F.lit(1)).alias("completed"), *[rounded(F.avg(c), 1).alias(a) for c, a in (("latency_ms", "avg_latency"), ("candidate_count", "avg_candidates"), ("injected_count", "avg_injected"))], F.sum("candidate_count").alias("candidates"), F.sum("injected_count").alias("injected"))


def entropy_of(counts: DataFrame, *by: str, log=F.ln) -> DataFrame:
    """counts of by, n -> total, kinds, entropy, its share of the highest possible (0 for one kind), share of the largest."""
    return counts.groupBy(*by).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.max("n").alias("most"), F.sum(F.col("n") * log(F.col("n").cast("double"))).alias("nlogn")).select(
        *by, "total", "kinds", rounded(log(F.col("total").cast("double")) - F.col("nlogn") / F.col("total")).alias("entropy"),
        F.when(F.col("kinds") > 1, rounded((log(F.col("total").cast("double")) - F.col("nlogn") / F.col("total")) / log(F.col("kinds").cast("double")))).otherwise(0.0).alias("normalized"), share(F.col("most"), F.col("total")).alias("top_share"),
    )


def _entropy_sql(by: str, log: str) -> str:
    h = f"-sum((n / total) * {log}(n / total))"
    cols = f"{by}, " if by else ""
    over = f"PARTITION BY {by}" if by else ""
    return f"""SELECT {cols}any_value(total)::BIGINT AS total, count(*) AS kinds, {rounded_sql(h)} AS entropy, CASE WHEN count(*) > 1 THEN {rounded_sql(f"({h}) / {log}(count(*))")} ELSE 0 END AS normalized, {rounded_sql('max(n) / any_value(total)')} AS top_share
FROM (SELECT *, (sum(n) OVER ({over}))::DOUBLE AS total FROM counts) {f'GROUP BY {by}' if by else ''}"""


@query("category_diversity", "+ counts AS (SELECT category, count(*) AS n FROM conf WHERE is_archived = 0 GROUP BY category) " + _entropy_sql("", "ln"))
def category_diversity(s: Store) -> DataFrame:
    return entropy_of(s.confidence.where("is_archived = 0").groupBy("category").agg(F.count(F.lit(1)).alias("n")))


@query("retrieval_diversity", f"""+ top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(trace_id, 'missing-trace:' || session_id || ':' || id) ORDER BY rank NULLS LAST, id) AS r FROM ev WHERE event_type = 'memory_candidate_retrieved' AND {recent_sql(30)}) WHERE r <= 10),
pathed AS (SELECT top.*, coalesce(array_to_string(string_split(path, '/')[1:2], '/'), 'unknown') AS prefix FROM top LEFT JOIN (SELECT substr(id, 1, 16) AS of, path FROM chunks) ON of = memory_id),
counts AS (SELECT 'category' AS kind, category AS key, count(*) AS n FROM pathed GROUP BY category UNION ALL SELECT 'source', source, count(*) FROM pathed GROUP BY source UNION ALL SELECT 'path_prefix', prefix, count(*) FROM pathed GROUP BY prefix) """ + _entropy_sql("kind", "log2"))
def retrieval_diversity(s: Store, days: int = 30, top_n: int = 10) -> DataFrame:
    """How categories, sources and path prefixes share the first `top_n` results of each recall; an event without a trace is a recall of its own."""
    rows = recent(s.events, days).where("event_type = 'memory_candidate_retrieved'")
    order = W.partitionBy(F.coalesce("trace_id", F.concat(F.lit("missing-trace:"), "session_id", F.lit(":"), F.col("id").cast("string")))).orderBy(F.col("rank").asc_nulls_last(), "id")
    top = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top_n)
    paths = s.chunks.select(F.substring("id", 1, 16).alias("memory_id"), F.substring_index("path", "/", 2).alias("prefix"))
    top = top.join(paths, "memory_id", "left").withColumn("prefix", F.coalesce("prefix", F.lit("unknown")))
    pairs = top.select(F.explode(F.create_map(F.lit("category"), "category", F.lit("source"), "source", F.lit("path_prefix"), "prefix")).alias("kind", "key"))
    return entropy_of(pairs.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n")), "kind", log=F.log2)


@query("reinforcement_concentration", f"""+ c AS (SELECT memory_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, memory_id) AS r FROM ev WHERE event_type = 'memory_cited' GROUP BY memory_id)
SELECT sum(n)::BIGINT AS total, count(*) AS memories, {rounded_sql('(sum(n) FILTER (WHERE r <= 1)) / sum(n)')} AS top1, {rounded_sql('(sum(n) FILTER (WHERE r <= 5)) / sum(n)')} AS top5, {rounded_sql('(sum(n) FILTER (WHERE r <= 10)) / sum(n)')} AS top10, {rounded_sql('sum(n * n) / (sum(n)::DOUBLE * sum(n))')} AS hhi FROM c""")
def reinforcement_concentration(s: Store) -> DataFrame:
    counts = s.events.where("event_type = 'memory_cited'").groupBy("memory_id").agg(F.count(F.lit(1)).alias("n"))
    best = counts.orderBy(F.col("n").desc(), "memory_id").limit(10).withColumn("r", F.row_number().over(W.orderBy(F.col("n").desc(), "memory_id")))  # ten rows
    tops = best.agg(*[F.sum(F.when(F.col("r") <= k, F.col("n"))).alias(f"t{k}") for k in (1, 5, 10)])
    whole = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("memories"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    return whole.crossJoin(tops).select("total", "memories", *[rounded(F.col(f"t{k}") / F.col("total")).alias(f"top{k}") for k in (1, 5, 10)], rounded(F.col("squares") / (F.col("total").cast("double") * F.col("total"))).alias("hhi"))


def misses(events: DataFrame) -> DataFrame:
    """Retrieved memories that were not injected in their trace; in a trace without injections, nowhere."""
    injected = events.where("event_type = 'memory_injected'")
    in_trace = injected.where("trace_id IS NOT NULL").select("trace_id", "memory_id", F.lit(True).alias("here")).distinct()
    traces = in_trace.select("trace_id", F.lit(True).alias("any_here")).distinct()
    anywhere = injected.select("memory_id", F.lit(True).alias("anywhere")).distinct()
    rows = events.where("event_type = 'memory_candidate_retrieved'").join(in_trace, ["trace_id", "memory_id"], "left").join(traces, "trace_id", "left").join(anywhere, "memory_id", "left")
    return rows.withColumn("miss", ~F.when(F.col("any_here"), F.coalesce("here", F.lit(False))).otherwise(F.coalesce("anywhere", F.lit(False))))


_MISS_SQL = """r AS (SELECT e.memory_id, CASE WHEN e.trace_id IN (SELECT trace_id FROM inj WHERE trace_id IS NOT NULL) THEN NOT EXISTS (SELECT 1 FROM inj i WHERE i.trace_id = e.trace_id AND i.memory_id = e.memory_id)
    ELSE e.memory_id NOT IN (SELECT memory_id FROM inj) END AS miss FROM ev e WHERE event_type = 'memory_candidate_retrieved')"""


@query("recall_miss", f"""+ inj AS (SELECT DISTINCT trace_id, memory_id FROM ev WHERE event_type = 'memory_injected'), {_MISS_SQL}
SELECT memory_id, count(*) AS misses, {rounded_sql("count(*) / (SELECT count(*) FROM r)::DOUBLE", 6)} AS miss_share FROM r WHERE miss GROUP BY memory_id ORDER BY misses DESC, memory_id LIMIT 5""")
def recall_miss(s: Store) -> DataFrame:
    rows = misses(s.events)
    whole = rows.agg(F.count(F.lit(1)).alias("all"))
    counts = rows.where("miss").groupBy("memory_id").agg(F.count(F.lit(1)).alias("misses"))
    return counts.crossJoin(F.broadcast(whole)).select("memory_id", "misses", rounded(F.col("misses") / F.col("all"), 6).alias("miss_share")).orderBy(F.col("misses").desc(), "memory_id").limit(5)


@query("injection_rate", f"""SELECT sum(greatest(0, candidate_count))::BIGINT AS candidates, sum(greatest(0, least(candidate_count, injected_count + cited_count)))::BIGINT AS passed, sum(greatest(0, injected_count))::BIGINT AS injected,
{rounded_sql("sum(greatest(0, least(candidate_count, injected_count + cited_count))) / sum(greatest(0, candidate_count))::DOUBLE")} AS gate_pass_rate, {rounded_sql("sum(greatest(0, injected_count)) / sum(greatest(0, candidate_count))::DOUBLE")} AS injection_rate FROM ev WHERE event_type = 'recall_completed'""")
def injection_rate(s: Store) -> DataFrame:
    above = lambda c: F.sum(F.greatest(F.lit(0), c))
    sums = s.events.where("event_type = 'recall_completed'").agg(above(F.col("candidate_count")).alias("candidates"), above(F.least("candidate_count", F.col("injected_count") + F.col("cited_count"))).alias("passed"), above(F.col("injected_count")).alias("injected"))
    return sums.select("*", share(F.col("passed"), F.col("candidates")).alias("gate_pass_rate"), share(F.col("injected"), F.col("candidates")).alias("injection_rate"))


@query("fallback_observability", f"""SELECT source, count(*) AS observations, count(*) FILTER (WHERE rank IS NULL) AS without_rank, count(*) FILTER (WHERE candidate_count = 0) AS empty, count(*) FILTER (WHERE injected_count = 0 AND candidate_count > 0) AS fell_back,
count(DISTINCT trace_id) AS traces, {rounded_sql("count(*) FILTER (WHERE injected_count = 0 AND candidate_count > 0) / count(*)::DOUBLE")} AS fallback_rate, max(created_at) AS last_at FROM ev WHERE {recent_sql(14)} GROUP BY source""")
def fallback_observability(s: Store) -> DataFrame:
    fell = (F.col("injected_count") == 0) & (F.col("candidate_count") > 0)
    return recent(s.events, 14).groupBy("source").agg(
        F.count(F.lit(1)).alias("observations"), F.count_if(F.col("rank").isNull()).alias("without_rank"), F.count_if(F.col("candidate_count") == 0).alias("empty"), F.count_if(fell).alias("fell_back"),
        F.countDistinct("trace_id").alias("traces"), rounded(F.count_if(fell) / F.count(F.lit(1))).alias("fallback_rate"), F.max("created_at").alias("last_at"),
    )


_SESSION = "coalesce(nullif(session_id, ''), trace_id, 'local')"
_COUNTS = {"retrieved": "memory_candidate_retrieved", "injected": "memory_injected", "cited": "memory_cited"}
_COUNTS_SQL = ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS {a}" for a, t in _COUNTS.items())


def _by_type() -> list:
    return [F.count_if(F.col("event_type") == t).alias(a) for a, t in _COUNTS.items()]


@query("session_rollup", f"SELECT {_SESSION} AS session, count(*) AS events, count(DISTINCT trace_id) AS traces, {_COUNTS_SQL}, {rounded_sql('avg(latency_ms)', 1)} AS avg_latency, min(created_at) AS first_at, max(created_at) AS last_at FROM ev GROUP BY 1")
def session_rollup(s: Store) -> DataFrame:
    return s.events.groupBy(F.expr(_SESSION).alias("session")).agg(F.count(F.lit(1)).alias("events"), F.countDistinct("trace_id").alias("traces"), *_by_type(), rounded(F.avg("latency_ms"), 1).alias("avg_latency"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


@query("session_traces", f"SELECT trace_id, count(*) AS events, max(candidate_count) AS candidates, max(injected_count) AS injected, max(cited_count) AS cited, min(created_at) AS started FROM ev WHERE {_SESSION} = '7' AND trace_id IS NOT NULL GROUP BY trace_id ORDER BY started DESC, trace_id LIMIT 100")
def session_traces(s: Store, session: str = "7") -> DataFrame:
    rows = s.events.where((F.expr(_SESSION) == session) & F.col("trace_id").isNotNull())
    return rows.groupBy("trace_id").agg(F.count(F.lit(1)).alias("events"), F.max("candidate_count").alias("candidates"), F.max("injected_count").alias("injected"), F.max("cited_count").alias("cited"), F.min("created_at").alias("started")).orderBy(F.col("started").desc(), "trace_id").limit(100)


@query("recent_traces", "SELECT trace_id, max_by(session_id, id) AS session_id, count(*) AS events, max(created_at) AS last_at FROM ev WHERE trace_id IS NOT NULL GROUP BY trace_id ORDER BY last_at DESC, trace_id LIMIT 50")
def recent_traces(s: Store) -> DataFrame:
    rows = s.events.where("trace_id IS NOT NULL").groupBy("trace_id").agg(F.max_by("session_id", "id").alias("session_id"), F.count(F.lit(1)).alias("events"), F.max("created_at").alias("last_at"))
    return rows.orderBy(F.col("last_at").desc(), "trace_id").limit(50)


@query("trace_detail", "SELECT id, event_type, memory_id, coalesce(nullif(candidate_count, 0), injected_count) AS candidates, created_at FROM ev WHERE trace_id = (SELECT min(trace_id) FROM ev)")
def trace_detail(s: Store) -> DataFrame:
    first = s.events.agg(F.min("trace_id").alias("trace_id"))
    return s.events.join(F.broadcast(first), "trace_id").select("id", "event_type", "memory_id", F.coalesce(F.nullif("candidate_count", F.lit(0)), "injected_count").alias("candidates"), "created_at")


@query("event_type_counts", f"SELECT event_type, count(*) AS n FROM ev WHERE {recent_sql(7)} GROUP BY event_type")
def event_type_counts(s: Store) -> DataFrame:
    return recent(s.events, 7).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("conflict_metrics", f"SELECT category, count(*) AS conflicted, {rounded_sql('avg(confidence)')} AS avg_confidence FROM conf WHERE conflict_flag = 1 GROUP BY category")
def conflict_metrics(s: Store) -> DataFrame:
    return s.confidence.where("conflict_flag = 1").groupBy("category").agg(F.count(F.lit(1)).alias("conflicted"), rounded(F.avg("confidence")).alias("avg_confidence"))


@query("memory_event_stats", f"SELECT memory_id, count(*) AS total, {_COUNTS_SQL}, min(created_at) AS first_at, max(created_at) AS last_at FROM ev GROUP BY memory_id")
def memory_event_stats(s: Store) -> DataFrame:
    return s.events.groupBy("memory_id").agg(F.count(F.lit(1)).alias("total"), *_by_type(), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


@query("timestamp_ties", "SELECT updated_at, count(*) AS n FROM chunks GROUP BY updated_at HAVING count(*) > 1")
def timestamp_ties(s: Store) -> DataFrame:
    return s.chunks.groupBy("updated_at").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("quarantined_path_counts", "SELECT path, count(*) AS n, max(updated_at) AS newest FROM chunks WHERE starts_with(path, 'memory/generated-smart-add/') GROUP BY path")
def quarantined_path_counts(s: Store) -> DataFrame:
    return s.chunks.where(F.col("path").startswith("memory/generated-smart-add/")).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("updated_at").alias("newest"))


_WEEK_SQL = "date_trunc('week', created_at)::DATE"


@query("weekly_snapshot", f"""+ counts AS (SELECT {_WEEK_SQL} AS week, category, count(*) AS n FROM ev WHERE event_type = 'memory_candidate_retrieved' GROUP BY 1, 2)
SELECT week, sum(n)::BIGINT AS retrieved, count(*) AS kinds, CASE WHEN count(*) > 1 THEN {rounded_sql("-sum((n / t) * ln(n / t)) / ln(count(*))")} ELSE 1 END AS normalized FROM (SELECT *, (sum(n) OVER (PARTITION BY week))::DOUBLE AS t FROM counts) GROUP BY week""")
def weekly_snapshot(s: Store) -> DataFrame:
    """By week; unlike the console's figure, a week with one category counts as fully diverse."""
    counts = s.events.where("event_type = 'memory_candidate_retrieved'").groupBy(F.date_trunc("week", "created_at").cast("date").alias("week"), "category").agg(F.count(F.lit(1)).alias("n"))
    sums = entropy_of(counts, "week")
    return sums.select("week", F.col("total").alias("retrieved"), "kinds", F.when(F.col("kinds") > 1, F.col("normalized")).otherwise(1.0).alias("normalized"))


@query("weekly_category_stats", f"SELECT category, count(*) AS n, {rounded_sql('avg(confidence)')} AS avg_confidence, sum(hit_count)::BIGINT AS hits, sum(is_archived)::BIGINT AS archived FROM conf GROUP BY category")
def weekly_category_stats(s: Store) -> DataFrame:
    return s.confidence.groupBy("category").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("confidence")).alias("avg_confidence"), F.sum("hit_count").alias("hits"), F.sum("is_archived").alias("archived"))


@query("daily_stats", f"""SELECT split_part(path, '/', 2) AS kind, count(*) AS chunks, count(DISTINCT path) AS files, count(*) FILTER (WHERE updated_at >= {NOW - DAYS}) AS last_day, count(*) FILTER (WHERE updated_at >= {NOW - 7 * DAYS}) AS last_week, sum(length(text))::BIGINT AS chars FROM chunks GROUP BY 1""")
def daily_stats(s: Store) -> DataFrame:
    return s.chunks.groupBy(F.split_part("path", F.lit("/"), F.lit(2)).alias("kind")).agg(
        F.count(F.lit(1)).alias("chunks"), F.countDistinct("path").alias("files"), F.count_if(F.col("updated_at") >= NOW - DAYS).alias("last_day"), F.count_if(F.col("updated_at") >= NOW - 7 * DAYS).alias("last_week"), F.sum(F.length("text")).alias("chars")
    )


@query("missing_by_owner", """SELECT count(*) FILTER (WHERE miss) AS missing, count(*) FILTER (WHERE miss AND starts_with(path, 'memory/smart-add/')) AS smart_add, count(*) FILTER (WHERE miss AND starts_with(path, 'memory/episodes/')) AS episodes,
count(*) FILTER (WHERE miss AND starts_with(path, 'memory/projects/')) AS projects, count(*) FILTER (WHERE miss AND starts_with(path, 'memory/dreaming/')) AS dreaming, count(*) FILTER (WHERE miss AND starts_with(path, 'memory/generated-smart-add/')) AS generated
FROM (SELECT path, c.chunk_id IS NULL AS miss FROM chunks LEFT JOIN conf c ON id = c.chunk_id)""")
def missing_by_owner(s: Store) -> DataFrame:
    missing = s.chunks.join(s.confidence, F.col("id") == F.col("chunk_id"), "left_anti")
    parts = {"smart_add": "smart-add", "episodes": "episodes", "projects": "projects", "dreaming": "dreaming", "generated": "generated-smart-add"}
    return missing.agg(F.count(F.lit(1)).alias("missing"), *[F.count_if(F.col("path").startswith(f"memory/{p}/")).alias(a) for a, p in parts.items()])
