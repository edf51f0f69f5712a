"""Changes of the sidecar's state, each as the table of rows after it, and checks of event times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.registry import query
from palimpsest.functions.scores import TAU_SQL, rounded, rounded_sql, tau
from palimpsest.sources.model import NOW, Store

_CITED_SQL = "SELECT memory_id, count(*) AS k FROM ev WHERE event_type = 'memory_cited' GROUP BY 1"


@query("reinforce", f"""SELECT chunk_id, hit_count + coalesce(k, 0) AS hit_count, {rounded_sql('CASE WHEN k IS NULL THEN confidence ELSE least(1, confidence + 0.1::DOUBLE * k) END')} AS confidence, CASE WHEN k IS NULL THEN conflict_flag ELSE 0 END AS conflict_flag, CASE WHEN k IS NULL THEN last_confidence_update ELSE {NOW} END AS last_confidence_update
FROM conf LEFT JOIN ({_CITED_SQL}) c ON c.memory_id = substr(chunk_id, 1, 16) AND is_archived = 0""")
def reinforce(s: Store) -> DataFrame:
    """The sidecar after all citations: each adds a hit and a tenth, up to 1; archived rows stay."""
    cited = s.events.where("event_type = 'memory_cited'").groupBy("memory_id").agg(F.count(F.lit(1)).alias("k"))
    rows = s.confidence.withColumn("memory_id", F.when(F.col("is_archived") == 0, F.substring("chunk_id", 1, 16))).join(cited, "memory_id", "left")
    same = F.col("k").isNull()
    return rows.select(
        "chunk_id", (F.col("hit_count") + F.coalesce("k", F.lit(0))).alias("hit_count"), rounded(F.when(same, F.col("confidence")).otherwise(F.least(F.lit(1.0), F.col("confidence") + 0.1 * F.col("k")))).alias("confidence"),
        F.when(same, F.col("conflict_flag")).otherwise(0).alias("conflict_flag"), F.when(same, F.col("last_confidence_update")).otherwise(NOW).alias("last_confidence_update"),
    )


@query("resolve_prefixes", "+ p AS (SELECT DISTINCT substr(memory_id, 1, 8) AS prefix FROM ev) SELECT prefix, chunk_id FROM (SELECT prefix, chunk_id, row_number() OVER (PARTITION BY prefix ORDER BY last_confidence_update DESC NULLS LAST, hit_count DESC, chunk_id) AS r FROM p JOIN conf ON substr(chunk_id, 1, 8) = prefix WHERE is_archived = 0) WHERE r = 1")
def resolve_prefixes(s: Store, length: int = 8) -> DataFrame:
    prefixes = s.events.select(F.substring("memory_id", 1, length).alias("prefix")).distinct()
    rows = s.confidence.where("is_archived = 0").withColumn("prefix", F.substring("chunk_id", 1, length)).join(prefixes, "prefix", "left_semi")
    best = F.row_number().over(W.partitionBy("prefix").orderBy(F.col("last_confidence_update").desc_nulls_last(), F.col("hit_count").desc(), "chunk_id"))
    return rows.withColumn("r", best).where("r = 1").select("prefix", "chunk_id")


def _age():
    return (F.lit(NOW) - F.col("last_confidence_update")) / 86400.0


_LIVE = "is_archived = 0 AND is_protected = 0 AND category <> 'user_identity'"


@query("archive_candidates", f"SELECT chunk_id, {rounded_sql(f'confidence * exp(-(({NOW} - last_confidence_update) / 86400.0::DOUBLE) / ({TAU_SQL}))')} AS realtime FROM conf WHERE {_LIVE} AND last_confidence_update IS NOT NULL AND confidence * exp(-(({NOW} - last_confidence_update) / 86400.0::DOUBLE) / ({TAU_SQL})) < 0.15::DOUBLE")
def archive_candidates(s: Store) -> DataFrame:
    """Confidence decayed at a rate that hits slow down; conflicts take nothing off here."""
    now = F.col("confidence") * F.exp(-_age() / tau(F.col("hit_count"), F.col("base_tau")))
    return s.confidence.where(_LIVE).where(F.col("last_confidence_update").isNotNull() & (now < 0.15)).select("chunk_id", rounded(now).alias("realtime"))


_NIGHT_SQL = f"CASE WHEN last_confidence_update IS NULL THEN confidence ELSE confidence * exp(-greatest(0, ({NOW} - last_confidence_update) / 86400.0::DOUBLE) / greatest(0.1::DOUBLE, base_tau)) END"


@query("archive_candidates_nightly", f"SELECT chunk_id, {rounded_sql(_NIGHT_SQL)} AS realtime FROM conf WHERE {_LIVE} AND {_NIGHT_SQL} < 0.15::DOUBLE")
def archive_candidates_nightly(s: Store) -> DataFrame:
    """The nightly form: hits do not slow decay, and rows without a time are judged as they are."""
    now = F.when(F.col("last_confidence_update").isNull(), F.col("confidence")).otherwise(F.col("confidence") * F.exp(-F.greatest(F.lit(0.0), _age()) / F.greatest(F.lit(0.1), "base_tau")))
    return s.confidence.where(_LIVE).where(now < 0.15).select("chunk_id", rounded(now).alias("realtime"))


@query("upsert_archive", f"+ req AS (SELECT id AS chunk_id, CASE WHEN doc_id % 37 = 0 THEN 0.01::DOUBLE ELSE 0.05::DOUBLE END AS most FROM chunks WHERE doc_id % 31 = 0 OR doc_id % 37 = 0) SELECT coalesce(c.chunk_id, r.chunk_id) AS chunk_id, {rounded_sql('CASE WHEN r.chunk_id IS NULL THEN confidence ELSE least(coalesce(confidence, 0.5::DOUBLE), most) END')} AS confidence, CASE WHEN r.chunk_id IS NULL THEN is_archived ELSE 1 END AS is_archived, coalesce(category, 'raw_log') AS category FROM conf c FULL JOIN req r ON c.chunk_id = r.chunk_id")
def upsert_archive(s: Store) -> DataFrame:
    """The sidecar after archiving some chunks and deleting others; those without a row get one. A deleted chunk stays as a tombstone of lower confidence."""
    asked = s.chunks.where("doc_id % 31 = 0 OR doc_id % 37 = 0").select(F.col("id").alias("chunk_id"), F.when(F.col("doc_id") % 37 == 0, 0.01).otherwise(0.05).alias("most"))
    rows = s.confidence.join(asked, "chunk_id", "full")
    return rows.select(
        "chunk_id", rounded(F.when(F.col("most").isNull(), F.col("confidence")).otherwise(F.least(F.coalesce("confidence", F.lit(0.5)), "most"))).alias("confidence"),
        F.when(F.col("most").isNull(), F.col("is_archived")).otherwise(1).alias("is_archived"), F.coalesce("category", F.lit("raw_log")).alias("category"),
    )


@query("kg_bridge", "+ best AS (SELECT chunk_id FROM conf WHERE category IN ('kg_node', 'raw_log') AND is_archived = 0 ORDER BY coalesce(last_confidence_update, 0) DESC, chunk_id LIMIT 10), nodes AS (SELECT string_agg(n_name, ',' ORDER BY n_nationkey) AS kg FROM (SELECT * FROM nation ORDER BY n_nationkey LIMIT 20)) SELECT chunk_id, kg FROM best, nodes")
def kg_bridge(s: Store) -> DataFrame:
    """The first 20 nodes of the graph go to the 10 newest rows that take them."""
    best = s.confidence.where("category IN ('kg_node', 'raw_log') AND is_archived = 0").orderBy(F.coalesce("last_confidence_update", F.lit(0)).desc(), "chunk_id").limit(10).select("chunk_id")
    nodes = s.table("nation").orderBy("n_nationkey").limit(20).agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    return best.crossJoin(nodes).select("chunk_id", F.concat_ws(",", "n.n_name").alias("kg"))  # ten rows, one row


@query("kg_node_match", "+ node AS (SELECT DISTINCT term FROM terms WHERE length(term) >= 8) SELECT term, id AS chunk_id FROM (SELECT term, id, row_number() OVER (PARTITION BY term ORDER BY coalesce(confidence, 0) DESC, id) AS r FROM node JOIN chunks ON contains(lower(text), term) LEFT JOIN conf ON id = chunk_id) WHERE r = 1")
def kg_node_match(s: Store) -> DataFrame:
    """For each node name the chunk of the highest confidence whose text has it. Names are the small side."""
    names = s.terms.where(F.length("term") >= 8).select("term").distinct()
    hits = s.chunks.select("id", F.lower("text").alias("low")).join(F.broadcast(names), F.col("low").contains(F.col("term"))).select("id", "term")
    rows = hits.join(s.confidence.select(F.col("chunk_id").alias("id"), "confidence"), "id", "left")
    best = F.row_number().over(W.partitionBy("term").orderBy(F.coalesce("confidence", F.lit(0.0)).desc(), "id"))
    return rows.withColumn("r", best).where("r = 1").select("term", F.col("id").alias("chunk_id"))


_TIMES_SQL = "t AS (SELECT event_id AS id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE epoch(ts)::BIGINT END AS event_at, (['second', 'day', 'unknown', 'month'])[(event_id % 4 + 1)::INT] AS precision, (value % 100) / 100.0::DOUBLE AS confidence FROM events)"


@query("event_time_validate", f"+ {_TIMES_SQL} SELECT id, CASE WHEN precision = 'month' THEN 'invalid_precision' WHEN precision = 'unknown' AND event_at IS NOT NULL THEN 'unexpected_time' WHEN precision <> 'unknown' AND event_at IS NULL THEN 'missing_time' WHEN confidence > 0.5::DOUBLE THEN 'ok' ELSE 'low_confidence' END AS status FROM t")
def event_time_validate(s: Store) -> DataFrame:
    rows = s.table("events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 9 != 0, F.unix_timestamp("ts")).alias("event_at"), F.element_at(F.array(*[F.lit(x) for x in ("second", "day", "unknown", "month")]), (F.col("event_id") % 4 + 1).cast("int")).alias("precision"), ((F.col("value") % 100) / 100.0).alias("confidence"))
    unknown, none = F.col("precision") == "unknown", F.col("event_at").isNull()
    status = F.when(F.col("precision") == "month", "invalid_precision").when(unknown & ~none, "unexpected_time").when(~unknown & none, "missing_time").when(F.col("confidence") > 0.5, "ok").otherwise("low_confidence")
    return rows.select("id", status.alias("status"))
