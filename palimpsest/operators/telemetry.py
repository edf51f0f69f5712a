"""Evaluators of telemetry: filter, count, compare with limits, say a status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.registry import query
from palimpsest.functions.scores import rounded, rounded_sql
from palimpsest.sources.model import NOW, Store

_ID_SQL = "o AS (SELECT *, CASE WHEN id % 50 <> 0 THEN 'epoch-' || (id % 2) END AS epoch, sha256(source) AS build FROM ev WHERE event_type = 'recall_completed')"


def observations(s: Store) -> DataFrame:
    """Completed recalls with the identity that their evidence belongs to."""
    return s.events.where("event_type = 'recall_completed'").withColumns({"epoch": F.when(F.col("id") % 50 != 0, F.concat(F.lit("epoch-"), (F.col("id") % 2).cast("string"))), "build": F.sha2("source", 256)})


@query("evidence_identity", f"+ {_ID_SQL} SELECT count(DISTINCT epoch) AS epochs, count(DISTINCT build) AS builds, count(*) FILTER (WHERE epoch IS NULL) AS missing, count(*) FILTER (WHERE NOT regexp_matches(build, '^[0-9a-f]{{64}}$')) AS malformed, CASE WHEN count(*) = 0 THEN 'identity_incomplete' WHEN count(*) FILTER (WHERE NOT regexp_matches(build, '^[0-9a-f]{{64}}$')) > 0 THEN 'blocked' WHEN count(DISTINCT epoch) > 1 OR count(DISTINCT build) > 1 THEN 'identity_mixed' WHEN count(*) FILTER (WHERE epoch IS NULL) > 0 THEN 'identity_incomplete' ELSE 'identity_ready' END AS status FROM o")
def evidence_identity(s: Store) -> DataFrame:
    sums = observations(s).agg(F.countDistinct("epoch").alias("epochs"), F.countDistinct("build").alias("builds"), F.count_if(F.col("epoch").isNull()).alias("missing"), F.count_if(~F.col("build").rlike("^[0-9a-f]{64}$")).alias("malformed"), F.count(F.lit(1)).alias("n"))
    status = F.when(F.col("n") == 0, "identity_incomplete").when(F.col("malformed") > 0, "blocked").when((F.col("epochs") > 1) | (F.col("builds") > 1), "identity_mixed").when(F.col("missing") > 0, "identity_incomplete").otherwise("identity_ready")
    return sums.withColumn("status", status).drop("n")


_REASON_SQL = "CASE WHEN trace_id IS NULL THEN 'missing_trace' WHEN session_id = '' THEN 'missing_session' WHEN rank IS NULL THEN 'missing_rank' ELSE 'valid' END"


def reason():
    return F.when(F.col("trace_id").isNull(), "missing_trace").when(F.col("session_id") == "", "missing_session").when(F.col("rank").isNull(), "missing_rank").otherwise("valid")


@query("provenance_summary", f"SELECT event_type, {_REASON_SQL} AS reason, count(*) AS n FROM ev GROUP BY 1, 2")
def provenance_summary(s: Store) -> DataFrame:
    return s.events.groupBy("event_type", reason().alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_ORIGIN_SQL = "CASE WHEN session_id = '' THEN 'system' WHEN source IN ('src0', 'src1') THEN 'natural' WHEN source = 'src2' THEN 'synthetic' ELSE 'unknown' END"


def origin():
    return F.when(F.col("session_id") == "", "system").when(F.col("source").isin("src0", "src1"), "natural").when(F.col("source") == "src2", "synthetic").otherwise("unknown")


@query("traffic_origin", f"SELECT {_ORIGIN_SQL} AS origin, count(*) AS n, count(DISTINCT session_id) AS sessions FROM ev GROUP BY 1")
def traffic_origin(s: Store) -> DataFrame:
    return s.events.groupBy(origin().alias("origin")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("session_id").alias("sessions"))


def widest_gap(rows: DataFrame, *by: str) -> DataFrame:
    """by, first_at, last_at, n, widest_gap: the longest time without an event, in seconds."""
    order = W.partitionBy(*by).orderBy("t")
    gaps = rows.withColumn("t", F.unix_timestamp("created_at")).groupBy(*by, "t").agg(F.count(F.lit(1)).alias("k")).withColumn("gap", F.col("t") - F.lag("t").over(order))
    return gaps.groupBy(*by).agg(F.min("t").alias("first_at"), F.max("t").alias("last_at"), F.sum("k").alias("n"), F.coalesce(F.max("gap"), F.lit(0)).alias("widest_gap"))


def _gap_sql(rows: str, by: str) -> str:
    return f"(SELECT {by}, min(t) AS first_at, max(t) AS last_at, count(*) AS n, coalesce(max(gap), 0) AS widest_gap FROM (SELECT {by}, t, t - lag(t) OVER (PARTITION BY {by} ORDER BY t) AS gap FROM (SELECT {by}, floor(epoch(created_at))::BIGINT AS t FROM {rows})) GROUP BY {by})"


@query("fallback_window", f"SELECT source, n, widest_gap, first_at, last_at, CASE WHEN n < 100 THEN 'too_few' WHEN widest_gap > 86400 THEN 'gap' WHEN last_at - first_at < 7 * 86400 THEN 'too_short' ELSE 'ready' END AS status FROM {_gap_sql('(SELECT * FROM ev WHERE injected_count = 0)', 'source')}")
def fallback_window(s: Store) -> DataFrame:
    rows = widest_gap(s.events.where("injected_count = 0"), "source")
    status = F.when(F.col("n") < 100, "too_few").when(F.col("widest_gap") > 86400, "gap").when(F.col("last_at") - F.col("first_at") < 7 * 86400, "too_short").otherwise("ready")
    return rows.select("source", "n", "widest_gap", "first_at", "last_at", status.alias("status"))


@query("traffic_forecast", f"SELECT event_type, count(*) AS n, count(DISTINCT created_at::DATE) AS active_days, {rounded_sql('count(*) * 7 / 30.0::DOUBLE', 2)} AS next_week FROM ev WHERE epoch(created_at) >= {NOW - 30 * 86400} GROUP BY event_type")
def traffic_forecast(s: Store, days: int = 30, ahead: int = 7) -> DataFrame:
    rows = s.events.where(F.unix_timestamp("created_at") >= NOW - days * 86400)
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.to_date("created_at")).alias("active_days"), rounded(F.count(F.lit(1)) * ahead / float(days), 2).alias("next_week"))


_START = NOW - 30 * 86400


@query("continuity", f"SELECT g.source, n, {rounded_sql('active / 30.0::DOUBLE')} AS active_ratio, greatest(widest_gap, first_at - {_START}, {NOW} - last_at) AS widest_gap, CASE WHEN active >= 24 AND greatest(widest_gap, first_at - {_START}, {NOW} - last_at) <= 2 * 86400 THEN 'continuous' ELSE 'broken' END AS status FROM {_gap_sql('ev', 'source')} g JOIN (SELECT source, count(DISTINCT created_at::DATE) AS active FROM ev GROUP BY source) d ON d.source = g.source")
def continuity(s: Store) -> DataFrame:
    """Gaps count from the window's edges too."""
    active = s.events.groupBy("source").agg(F.countDistinct(F.to_date("created_at")).alias("active"))
    rows = widest_gap(s.events, "source").join(active, "source").withColumn("widest_gap", F.greatest("widest_gap", F.col("first_at") - _START, NOW - F.col("last_at")))
    return rows.select("source", "n", rounded(F.col("active") / 30.0).alias("active_ratio"), "widest_gap", F.when((F.col("active") >= 24) & (F.col("widest_gap") <= 2 * 86400), "continuous").otherwise("broken").alias("status"))


@query("evidence_health", f"SELECT {_ORIGIN_SQL} AS origin, count(*) AS n, ({NOW} - max(floor(epoch(created_at))))::BIGINT AS age, {rounded_sql('count(*) FILTER (WHERE ' + _REASON_SQL + " = 'valid') / count(*)::DOUBLE")} AS valid_rate, CASE WHEN {NOW} - max(floor(epoch(created_at))) > 3 * 86400 THEN 'stale' WHEN count(*) FILTER (WHERE {_REASON_SQL} = 'valid') < 0.5 * count(*) THEN 'degraded' ELSE 'healthy' END AS status FROM ev GROUP BY 1")
def evidence_health(s: Store) -> DataFrame:
    rows = s.events.groupBy(origin().alias("origin")).agg(F.count(F.lit(1)).alias("n"), (F.lit(NOW) - F.max(F.unix_timestamp("created_at"))).alias("age"), F.count_if(reason() == "valid").alias("valid"))
    return rows.select("origin", "n", "age", rounded(F.col("valid") / F.col("n")).alias("valid_rate"), F.when(F.col("age") > 3 * 86400, "stale").when(F.col("valid") < 0.5 * F.col("n"), "degraded").otherwise("healthy").alias("status"))


@query("product_health", f"""+ l AS (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) AS r, count(*) OVER () AS n FROM ev WHERE event_type = 'recall_completed')
SELECT any_value(n) AS completed, max(latency_ms) AS max_latency, min(latency_ms) FILTER (WHERE r >= ceil(n * 0.95)) AS p95_latency, (SELECT count(*) FROM (SELECT trace_id FROM ev WHERE trace_id IS NOT NULL GROUP BY trace_id HAVING count(*) FILTER (WHERE event_type = 'recall_started') > 0 AND count(*) FILTER (WHERE event_type = 'recall_completed') = 0)) AS incomplete_traces FROM l""")
def product_health(s: Store) -> DataFrame:
    """The 95th latency is a nearest rank, found from counts by latency: those are few, whatever the number of events."""
    counts = s.events.where("event_type = 'recall_completed'").groupBy("latency_ms").agg(F.count(F.lit(1)).alias("k"))
    order = W.orderBy("latency_ms")
    ranked = counts.withColumns({"upto": F.sum("k").over(order), "n": F.sum("k").over(W.partitionBy(F.lit(0)))})
    latency = ranked.agg(F.max("n").alias("completed"), F.max("latency_ms").alias("max_latency"), F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * 0.95), F.col("latency_ms"))).alias("p95_latency"))
    traces = s.events.where("trace_id IS NOT NULL").groupBy("trace_id").agg(F.count_if(F.col("event_type") == "recall_started").alias("a"), F.count_if(F.col("event_type") == "recall_completed").alias("b"))
    return latency.crossJoin(traces.agg(F.count_if((F.col("a") > 0) & (F.col("b") == 0)).alias("incomplete_traces")))


@query("rollout_readiness", "SELECT source, count(*) AS n, count(*) FILTER (WHERE candidate_count = 0) AS failures, concat_ws(',', CASE WHEN count(*) < 500 THEN 'too_few_observations' END, CASE WHEN count(*) FILTER (WHERE candidate_count = 0) > 0.05 * count(*) THEN 'failure_rate' END, CASE WHEN count(DISTINCT created_at::DATE) < 14 THEN 'too_few_days' END) AS blockers FROM ev GROUP BY source")
def rollout_readiness(s: Store) -> DataFrame:
    rows = s.events.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("candidate_count") == 0).alias("failures"), F.countDistinct(F.to_date("created_at")).alias("days"))
    blockers = F.concat_ws(",", F.when(F.col("n") < 500, "too_few_observations"), F.when(F.col("failures") > 0.05 * F.col("n"), "failure_rate"), F.when(F.col("days") < 14, "too_few_days"))
    return rows.select("source", "n", "failures", blockers.alias("blockers"))


@query("shadow_loss", f"+ a AS (SELECT DISTINCT source, memory_id FROM ev WHERE event_type = 'memory_candidate_retrieved'), b AS (SELECT DISTINCT source, memory_id FROM ev WHERE event_type = 'memory_candidate_retrieved' AND rank IS NOT NULL) SELECT a.source, count(*) AS before, count(b.memory_id) AS overlap, count(*) - count(b.memory_id) AS dropped, {rounded_sql('(count(*) - count(b.memory_id)) / greatest(count(*), 1)::DOUBLE', 3)} AS loss FROM a LEFT JOIN b ON a.source = b.source AND a.memory_id = b.memory_id GROUP BY a.source")
def shadow_loss(s: Store) -> DataFrame:
    """What a stricter channel would lose of the results of the present one."""
    rows = s.events.where("event_type = 'memory_candidate_retrieved'").groupBy("source", "memory_id").agg(F.max(F.col("rank").isNotNull().cast("int")).alias("stays"))
    sums = rows.groupBy("source").agg(F.count(F.lit(1)).alias("before"), F.sum("stays").cast("long").alias("overlap")).withColumn("dropped", F.col("before") - F.col("overlap"))
    return sums.withColumn("loss", rounded(F.col("dropped") / F.greatest("before", F.lit(1)), 3))


_ARMS_SQL = "r AS (SELECT trace_id, memory_id, rank, id, row_number() OVER (PARTITION BY trace_id ORDER BY rank, id) AS a, row_number() OVER (PARTITION BY trace_id ORDER BY id) AS b FROM ev WHERE trace_id IS NOT NULL AND rank IS NOT NULL), t AS (SELECT trace_id, string_agg(memory_id, ',' ORDER BY a) FILTER (WHERE a <= 5) AS ia, string_agg(memory_id, ',' ORDER BY b) FILTER (WHERE b <= 5) AS ib FROM r GROUP BY trace_id)"


@query("result_equivalence", f"+ {_ARMS_SQL} SELECT count(*) AS traces, count(*) FILTER (WHERE ia = ib) AS same_order, count(*) FILTER (WHERE ia <> ib) AS other_order, (SELECT count(*) FROM (SELECT trace_id, memory_id FROM r WHERE a <= 5 EXCEPT ALL SELECT trace_id, memory_id FROM r WHERE b <= 5)) AS only_first, (SELECT count(*) FROM (SELECT trace_id, memory_id FROM r WHERE b <= 5 EXCEPT ALL SELECT trace_id, memory_id FROM r WHERE a <= 5)) AS only_second FROM t")
def result_equivalence(s: Store, k: int = 5) -> DataFrame:
    """Two arms, the first k results of a trace by rank and by arrival: traces with the same order, and the rows that one arm alone has."""
    rows = s.events.where("trace_id IS NOT NULL AND rank IS NOT NULL").select("trace_id", "memory_id", "rank", "id")
    of = W.partitionBy("trace_id")
    rows = rows.withColumns({"a": F.row_number().over(of.orderBy("rank", "id")), "b": F.row_number().over(of.orderBy("id"))}).where((F.col("a") <= k) | (F.col("b") <= k))
    in_order = lambda c: F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.when(F.col(c) <= k, F.struct(c, "memory_id")))), lambda x: x["memory_id"]))
    orders = rows.groupBy("trace_id").agg(in_order("a").alias("ia"), in_order("b").alias("ib"))
    same = F.col("ia") == F.col("ib")
    first, second = (rows.where(F.col(c) <= k).select("trace_id", "memory_id") for c in ("a", "b"))
    alone = first.exceptAll(second).agg(F.count(F.lit(1)).alias("only_first")).crossJoin(second.exceptAll(first).agg(F.count(F.lit(1)).alias("only_second")))  # one row each
    return orders.agg(F.count(F.lit(1)).alias("traces"), F.count_if(same).alias("same_order"), F.count_if(~same).alias("other_order")).crossJoin(alone)


@query("canary_bucket", "SELECT DISTINCT session_id, (('0x' || substr(sha256('recent-canary-shadow-v1:' || session_id), 1, 8))::BIGINT % 10000) AS bucket FROM ev WHERE session_id <> ''")
def canary_bucket(s: Store, salt: str = "recent-canary-shadow-v1") -> DataFrame:
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), "session_id"), 256)
    return s.events.where("session_id <> ''").select("session_id").distinct().withColumn("bucket", F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 10000)


@query("reinforcement_filter", "SELECT DISTINCT c.trace_id, c.memory_id, EXISTS (SELECT 1 FROM ev i WHERE i.trace_id = c.trace_id AND i.memory_id = c.memory_id AND i.event_type = 'memory_injected') OR EXISTS (SELECT 1 FROM ev i WHERE i.session_id = c.session_id AND i.memory_id = c.memory_id AND i.event_type = 'memory_candidate_retrieved') AS allowed FROM ev c WHERE event_type = 'memory_cited' AND trace_id IS NOT NULL")
def reinforcement_filter(s: Store) -> DataFrame:
    """Cited memories, and whether the turn or the session had brought them."""
    of = lambda kind: s.events.where(F.col("event_type") == kind)
    cited = of("memory_cited").where("trace_id IS NOT NULL").select("trace_id", "session_id", "memory_id").distinct()
    injected = of("memory_injected").select("trace_id", "memory_id", F.lit(True).alias("i")).distinct()
    fetched = of("memory_candidate_retrieved").select("session_id", "memory_id", F.lit(True).alias("f")).distinct()
    rows = cited.join(injected, ["trace_id", "memory_id"], "left").join(fetched, ["session_id", "memory_id"], "left")
    return rows.select("trace_id", "memory_id", (F.coalesce("i", F.lit(False)) | F.coalesce("f", F.lit(False))).alias("allowed"))


_LABELS_SQL = "j AS (SELECT d.doc_id, l.quality, l.toxic, least(1, length(d.text) / 4000.0::DOUBLE) AS score FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
_PRF = "{p} AS precision, {r} AS recall"


def labelled(s: Store) -> DataFrame:
    return s.table("documents").join(s.table("labels"), "doc_id").select("doc_id", "quality", "toxic", F.least(F.lit(1.0), F.length("text") / 4000.0).alias("score"))


def confusion(rows: DataFrame, limit, *by: str) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 of score >= limit for quality 1."""
    hit, good = F.col("score") >= limit, F.col("quality") == 1
    sums = rows.groupBy(*by).agg(F.count_if(hit & good).alias("tp"), F.count_if(hit & ~good).alias("fp"), F.count_if(~hit & good).alias("fn"), F.count_if(~hit & ~good).alias("tn"))
    part = lambda a, b: F.when(a + b > 0, rounded(a / (a + b))).otherwise(0.0)
    f1 = F.when(F.col("tp") > 0, rounded(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))).otherwise(0.0)
    return sums.withColumns({"precision": part(F.col("tp"), F.col("fp")), "recall": part(F.col("tp"), F.col("fn")), "f1": f1})


def _confusion_sql(limit: str) -> str:
    return f"count(*) FILTER (WHERE score >= {limit} AND quality = 1) AS tp, count(*) FILTER (WHERE score >= {limit} AND quality <> 1) AS fp, count(*) FILTER (WHERE score < {limit} AND quality = 1) AS fn, count(*) FILTER (WHERE score < {limit} AND quality <> 1) AS tn, {rounded_sql(f'coalesce(count(*) FILTER (WHERE score >= {limit} AND quality = 1) / nullif(count(*) FILTER (WHERE score >= {limit}), 0)::DOUBLE, 0)')} AS precision, {rounded_sql(f'coalesce(count(*) FILTER (WHERE score >= {limit} AND quality = 1) / nullif(count(*) FILTER (WHERE quality = 1), 0)::DOUBLE, 0)')} AS recall, {rounded_sql(f'coalesce(2 * count(*) FILTER (WHERE score >= {limit} AND quality = 1) / nullif(count(*) FILTER (WHERE score >= {limit}) + count(*) FILTER (WHERE quality = 1), 0)::DOUBLE, 0)')} AS f1"


@query("label_eval", f"+ {_LABELS_SQL} SELECT toxic, {_confusion_sql('0.5')} FROM j GROUP BY toxic")
def label_eval(s: Store) -> DataFrame:
    return confusion(labelled(s), F.lit(0.5), "toxic")


@query("threshold_sweep", f"+ {_LABELS_SQL} SELECT k, {_confusion_sql('k / 10.0::DOUBLE')} FROM j, (SELECT unnest(range(1, 10)) AS k) GROUP BY k")
def threshold_sweep(s: Store) -> DataFrame:
    rows = labelled(s).withColumn("k", F.explode(F.array(*[F.lit(k).cast("long") for k in range(1, 10)])))
    return confusion(rows, F.col("k") / 10.0, "k")


@query("label_summary", f"SELECT source, lang, count(*) AS n, {rounded_sql('count(*) FILTER (WHERE quality = 0) / count(*)::DOUBLE')} AS bad_rate, {rounded_sql('count(*) FILTER (WHERE toxic = 1) / count(*)::DOUBLE')} AS toxic_rate, {rounded_sql('count(*) FILTER (WHERE quality IS NULL) / count(*)::DOUBLE')} AS unsure_rate, count(*) FILTER (WHERE coalesce(quality, 0) NOT IN (0, 1) OR coalesce(toxic, 0) NOT IN (0, 1)) AS invalid FROM documents JOIN labels USING (doc_id) GROUP BY source, lang")
def label_summary(s: Store) -> DataFrame:
    rate = lambda test: rounded(F.count_if(test) / F.count(F.lit(1)))
    return s.table("documents").join(s.table("labels"), "doc_id").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), rate(F.col("quality") == 0).alias("bad_rate"), rate(F.col("toxic") == 1).alias("toxic_rate"), rate(F.col("quality").isNull()).alias("unsure_rate"), F.count_if(~F.coalesce("quality", F.lit(0)).isin(0, 1) | ~F.coalesce("toxic", F.lit(0)).isin(0, 1)).alias("invalid"))


@query("annotation_match", "+ lab AS (SELECT CASE WHEN doc_id % 2 = 0 THEN sha256(doc_id::VARCHAR) END AS sample_id, substr(sha256(doc_id::VARCHAR), 1, 16) AS memory_id, quality FROM labels) SELECT id, coalesce(a.quality, b.quality) AS quality, CASE WHEN a.quality IS NOT NULL THEN 'sample' WHEN b.quality IS NOT NULL THEN 'memory' ELSE 'none' END AS matched_by FROM chunks LEFT JOIN (SELECT sample_id, max(quality) AS quality FROM lab WHERE sample_id IS NOT NULL GROUP BY 1) a ON a.sample_id = id LEFT JOIN (SELECT memory_id, max(quality) AS quality FROM lab WHERE sample_id IS NULL GROUP BY 1) b ON b.memory_id = substr(id, 1, 16)")
def annotation_match(s: Store) -> DataFrame:
    labels = s.table("labels").select(F.when(F.col("doc_id") % 2 == 0, F.sha2(F.col("doc_id").cast("string"), 256)).alias("sample_id"), F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 16).alias("memory_id"), "quality")
    a = labels.where("sample_id IS NOT NULL").groupBy(F.col("sample_id").alias("id")).agg(F.max("quality").alias("qa"))
    b = labels.where("sample_id IS NULL").groupBy("memory_id").agg(F.max("quality").alias("qb"))
    rows = s.chunks.select("id", F.substring("id", 1, 16).alias("memory_id")).join(a, "id", "left").join(b, "memory_id", "left")
    return rows.select("id", F.coalesce("qa", "qb").alias("quality"), F.when(F.col("qa").isNotNull(), "sample").when(F.col("qb").isNotNull(), "memory").otherwise("none").alias("matched_by"))
