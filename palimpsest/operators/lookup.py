"""Scans, point lookups, filters and joins of chunks, sidecar, events, vectors and transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.registry import query
from palimpsest.functions.scores import FAMILY_SQL, PLAIN_SQL, REALTIME_SQL, plain, realtime_confidence, rounded, rounded_sql, scope_family
from palimpsest.operators.vectors import VectorIndex
from palimpsest.sources.model import NOW, Store


def with_sidecar(s: Store, chunks: DataFrame | None = None) -> DataFrame:
    """Chunks, those of the store or what is made of them, with their sidecar row; a chunk without one keeps nulls, which mean external."""
    return (s.chunks if chunks is None else chunks).join(s.confidence, F.col("id") == F.col("chunk_id"), "left")


@query("get_by_prefix", "+ hits AS (SELECT id, path, updated_at, c.chunk_id IS NOT NULL AS managed FROM chunks LEFT JOIN conf c ON id = c.chunk_id WHERE starts_with(id, substr(sha256('0'), 1, 8))) SELECT *, (SELECT count(*) FROM hits) > 1 AS ambiguous FROM hits ORDER BY managed DESC, updated_at DESC, id LIMIT 2")
def get_by_prefix(s: Store, prefix: str = "5feceb66") -> DataFrame:
    hits = with_sidecar(s).where(F.col("id").startswith(prefix)).select("id", "path", "updated_at", F.col("chunk_id").isNotNull().alias("managed"))
    best = hits.orderBy(F.col("managed").desc(), F.col("updated_at").desc(), "id").limit(2)
    return best.withColumn("ambiguous", F.count(F.lit(1)).over(W.partitionBy(F.lit(0))) > 1)  # two rows


@query("list_memories", "SELECT id, path, coalesce(is_protected, 0) AS is_protected, confidence FROM chunks LEFT JOIN conf ON id = chunk_id WHERE (contains(lower(text), 'th') OR contains(lower(path), 'th')) AND coalesce(is_archived, 0) = 0 ORDER BY 3 DESC, confidence DESC NULLS LAST, id DESC LIMIT 500")
def list_memories(s: Store, term: str = "th", cap: int = 500) -> DataFrame:
    rows = with_sidecar(s).where((F.lower("text").contains(term) | F.lower("path").contains(term)) & (F.coalesce("is_archived", F.lit(0)) == 0))
    return rows.select("id", "path", F.coalesce("is_protected", F.lit(0)).alias("is_protected"), "confidence").orderBy(F.col("is_protected").desc(), F.col("confidence").desc_nulls_last(), F.col("id").desc()).limit(cap)


_EVENT_KEY = ["event_type", "session_id", "trace_id", "memory_id", "latency_ms", "candidate_count", "injected_count", "cited_count", "rank", "category", "source", "props", "created_at"]
_TEXT_KEYS = ["session_id", "trace_id", "memory_id", "source", "props"]


@query("unified_events", f"+ u AS (SELECT *, 'main' AS origin FROM ev WHERE id % 3 <> 0 UNION ALL SELECT *, 'core' FROM ev WHERE id % 2 = 0) SELECT id, event_type, session_id, trace_id, memory_id, latency_ms, created_at, origin FROM u QUALIFY row_number() OVER (PARTITION BY {', '.join(f"coalesce({c}, '')" if c in _TEXT_KEYS else c for c in _EVENT_KEY)} ORDER BY origin, id DESC) = 1")
def unified_events(s: Store) -> DataFrame:
    """Both event schemas as one. Rows are the same event if all they say is the same, null and empty text alike; the core row counts, and the last one of a schema."""
    both = s.events.where("id % 3 <> 0").withColumn("origin", F.lit("main")).unionByName(s.events.where("id % 2 = 0").withColumn("origin", F.lit("core")))
    key = [F.coalesce(c, F.lit("")).alias(f"key_{c}") if c in _TEXT_KEYS else F.col(c).alias(f"key_{c}") for c in _EVENT_KEY]
    best = both.groupBy(*key).agg(F.max(F.struct((F.col("origin") == "core").alias("core"), "id", "event_type", "session_id", "trace_id", "memory_id", "latency_ms", "created_at", "origin")).alias("best"))
    return best.select(*[f"best.{c}" for c in ("id", "event_type", "session_id", "trace_id", "memory_id", "latency_ms", "created_at", "origin")])


@query("vector_validate", "SELECT vec_id, CASE WHEN vector IS NULL THEN 'not_an_array' WHEN len(vector) = 0 THEN 'empty' WHEN len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 THEN 'not_finite' ELSE 'ok' END AS status, len(vector)::INT AS dim FROM vectors")
def vector_validate(s: Store) -> DataFrame:
    v = F.col("vector")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return s.vectors.select("vec_id", F.when(v.isNull(), "not_an_array").when(F.size(v) == 0, "empty").when(odd, "not_finite").otherwise("ok").alias("status"), F.size(v).alias("dim"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, position, distance (squared): the k nearest of each query, by an index of cells."""
    return VectorIndex.build(vectors).search(queries, k)


NEAREST_SQL = f"""near AS (SELECT query_id, id, position, distance FROM (SELECT q.item_id AS query_id, v.id, list_sum([(a[1]::DOUBLE - a[2]::DOUBLE) * (a[1]::DOUBLE - a[2]::DOUBLE) FOR a IN list_zip(v.vector, p.vector)]) AS distance,
    row_number() OVER (PARTITION BY q.item_id ORDER BY {rounded_sql('list_sum([(a[1]::DOUBLE - a[2]::DOUBLE) * (a[1]::DOUBLE - a[2]::DOUBLE) FOR a IN list_zip(v.vector, p.vector)])', 6)}, v.id) AS position FROM vectors v, benchmark q JOIN vectors p ON p.vec_id = q.item_id) WHERE position <= 30)"""


def probes(s: Store) -> DataFrame:
    """A vector for each query; without an embedding service the stored one with the query's number."""
    return s.table("benchmark").select(F.col("item_id").alias("query_id")).join(s.vectors.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("probe")), "query_id")


@query("vector_topk", f"+ {NEAREST_SQL} SELECT query_id, id, position::INT AS position, {rounded_sql('1 - distance')} AS similarity FROM near")
def vector_topk(s: Store) -> DataFrame:
    return nearest(s.vectors, probes(s), 30).select("query_id", "id", "position", rounded(1 - F.col("distance")).alias("similarity"))


@query("missing_vectors", "SELECT id, substr(text, 1, 2000) AS text FROM chunks WHERE id IN (SELECT chunk_id FROM conf WHERE is_archived = 0) AND id NOT IN (SELECT id FROM vectors) AND trim(text) <> ''")
def missing_vectors(s: Store) -> DataFrame:
    active = s.confidence.where("is_archived = 0").select(F.col("chunk_id").alias("id"))
    return s.chunks.join(active, "id", "left_semi").join(s.vectors.select("id"), "id", "left_anti").where(F.trim("text") != "").select("id", F.substring("text", 1, 2000).alias("text"))


@query("indexed_path_state", "SELECT path, max(updated_at) AS updated_at FROM chunks GROUP BY path")
def indexed_path_state(s: Store) -> DataFrame:
    return s.chunks.groupBy("path").agg(F.max("updated_at").alias("updated_at"))


@query("backfill_confidence", "SELECT id, CASE WHEN starts_with(path, 'memory/episodes/') THEN 'episodic' ELSE 'raw_log' END AS category, CASE WHEN starts_with(path, 'memory/episodes/') THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS confidence, CASE WHEN starts_with(path, 'memory/episodes/') THEN 30.0::DOUBLE ELSE 7.0::DOUBLE END AS base_tau FROM chunks WHERE (starts_with(path, 'memory/smart-add/') OR starts_with(path, 'memory/episodes/')) AND id NOT IN (SELECT chunk_id FROM conf) ORDER BY updated_at DESC, id LIMIT 500")
def backfill_confidence(s: Store, cap: int = 500) -> DataFrame:
    episode = F.col("path").startswith("memory/episodes/")
    rows = s.chunks.where(F.col("path").startswith("memory/smart-add/") | episode).join(s.confidence, F.col("id") == F.col("chunk_id"), "left_anti").orderBy(F.col("updated_at").desc(), "id").limit(cap)
    return rows.select("id", F.when(episode, "episodic").otherwise("raw_log").alias("category"), F.when(episode, 0.7).otherwise(0.5).alias("confidence"), F.when(episode, 30.0).otherwise(7.0).alias("base_tau"))


FINGERPRINT_SQL = f"substr(sha256(category || '|0|' || {PLAIN_SQL.format('text')}), 1, 16)"


def fingerprint(category, text):
    return F.substring(F.sha2(F.concat(category, F.lit("|0|"), plain(text)), 256), 1, 16)


@query("fingerprints", f"SELECT id, {FINGERPRINT_SQL} AS fingerprint FROM chunks JOIN conf ON id = chunk_id")
def fingerprints(s: Store) -> DataFrame:
    return s.chunks.join(s.confidence, F.col("id") == F.col("chunk_id")).select("id", fingerprint(F.col("category"), F.col("text")).alias("fingerprint"))


@query("smart_add_dedupe", f"+ f AS (SELECT id, doc_id, path, substr(sha256('raw_log|0|' || {PLAIN_SQL.format('text')}), 1, 16) AS fp FROM chunks) SELECT id, fp AS fingerprint FROM f WHERE path NOT LIKE 'memory/smart-add/%' AND fp NOT IN (SELECT fp FROM f WHERE path LIKE 'memory/smart-add/%')")
def smart_add_dedupe(s: Store) -> DataFrame:
    """New entries whose fingerprint the smart-add files do not have."""
    rows = s.chunks.select("id", "path", fingerprint(F.lit("raw_log"), F.col("text")).alias("fingerprint"))
    known = F.col("path").startswith("memory/smart-add/")
    return rows.where(~known).join(rows.where(known).select("fingerprint"), "fingerprint", "left_anti").select("id", "fingerprint")


@query("missing_confidence", "SELECT id, path FROM chunks WHERE id NOT IN (SELECT chunk_id FROM conf)")
def missing_confidence(s: Store) -> DataFrame:
    return s.chunks.join(s.confidence, F.col("id") == F.col("chunk_id"), "left_anti").select("id", "path")


@query("orphan_confidence", "SELECT chunk_id, category FROM conf WHERE chunk_id NOT IN (SELECT id FROM chunks)")
def orphan_confidence(s: Store) -> DataFrame:
    return s.confidence.join(s.chunks, F.col("id") == F.col("chunk_id"), "left_anti").select("chunk_id", "category")


@query("orphan_diagnostics", """+ o AS (SELECT *, strftime(make_timestamp(last_confidence_update * 1000000), '%Y-%m') AS month FROM conf WHERE chunk_id NOT IN (SELECT id FROM chunks))
SELECT coalesce(month, 'none') AS month, length(chunk_id)::INT AS id_length, count(*) AS orphans, count(*) FILTER (WHERE substr(chunk_id, 1, 16) NOT IN (SELECT substr(id, 1, 16) FROM chunks)) AS truly_missing,
    count(*) FILTER (WHERE substr(chunk_id, 1, 16) IN (SELECT substr(id, 1, 16) FROM chunks)) AS prefix_fake, count(*) FILTER (WHERE substr(chunk_id, 1, 16) IN (SELECT memory_id FROM ev)) AS seen_in_events FROM o GROUP BY 1, 2""")
def orphan_diagnostics(s: Store) -> DataFrame:
    """Sidecar rows without a chunk, by month and length of the id: truly missing, or fake where a chunk has the id's first 16 characters."""
    orphans = s.confidence.join(s.chunks, F.col("id") == F.col("chunk_id"), "left_anti").withColumn("memory_id", F.substring("chunk_id", 1, 16))
    seen = s.events.select("memory_id", F.lit(1).alias("seen")).distinct()
    prefixes = s.chunks.select(F.substring("id", 1, 16).alias("memory_id"), F.lit(1).alias("fake")).distinct()
    month = F.coalesce(F.date_format(F.timestamp_seconds("last_confidence_update"), "yyyy-MM"), F.lit("none"))
    rows = orphans.join(seen, "memory_id", "left").join(prefixes, "memory_id", "left").groupBy(month.alias("month"), F.length("chunk_id").alias("id_length"))
    return rows.agg(F.count(F.lit(1)).alias("orphans"), F.count_if(F.col("fake").isNull()).alias("truly_missing"), F.count("fake").alias("prefix_fake"), F.count("seen").alias("seen_in_events"))


@query("orphan_cleanup_preview", f"SELECT count(*) FILTER (WHERE o) AS would_delete, count(*) AS rows, {rounded_sql('count(*) FILTER (WHERE o) / count(*)::DOUBLE', 6)} AS ratio FROM (SELECT chunk_id NOT IN (SELECT id FROM chunks) AS o FROM conf)")
def orphan_cleanup_preview(s: Store) -> DataFrame:
    known = s.chunks.select(F.col("id").alias("chunk_id"), F.lit(True).alias("known"))
    rows = s.confidence.join(known, "chunk_id", "left").agg(F.count_if(F.col("known").isNull()).alias("would_delete"), F.count(F.lit(1)).alias("rows"))
    return rows.withColumn("ratio", rounded(F.col("would_delete") / F.col("rows"), 6))


@query("quality_candidates", f"""SELECT id, path, {FAMILY_SQL} AS family, category, c.chunk_id IS NOT NULL AS has_confidence, coalesce(e.retrieved, 0) AS retrieved, coalesce(e.injected, 0) AS injected FROM chunks LEFT JOIN conf c ON id = c.chunk_id
LEFT JOIN (SELECT memory_id, count(*) FILTER (WHERE event_type = 'memory_candidate_retrieved') AS retrieved, count(*) FILTER (WHERE event_type = 'memory_injected') AS injected FROM ev GROUP BY 1) e ON e.memory_id = substr(id, 1, 16)
WHERE NOT starts_with(path, 'memory/generated-smart-add/') AND NOT starts_with(path, 'memory/dreaming/')""")
def quality_candidates(s: Store) -> DataFrame:
    return candidates(s).select("id", "path", "family", "category", "has_confidence", "retrieved", "injected")


def used(s: Store, chunks: DataFrame | None = None) -> DataFrame:
    """All chunks with sidecar, family and use."""
    use = s.events.groupBy("memory_id").agg(F.count_if(F.col("event_type") == "memory_candidate_retrieved").alias("retrieved"), F.count_if(F.col("event_type") == "memory_injected").alias("injected"))
    rows = with_sidecar(s, chunks).withColumn("memory_id", F.substring("id", 1, 16)).join(use, "memory_id", "left")
    return rows.withColumns({"family": scope_family(F.col("path")), "has_confidence": F.col("chunk_id").isNotNull(), "retrieved": F.coalesce("retrieved", F.lit(0)), "injected": F.coalesce("injected", F.lit(0))})


def candidates(s: Store, chunks: DataFrame | None = None) -> DataFrame:
    """What quality is judged by: chunk, sidecar, family and use; two path families are out of scope."""
    return used(s, chunks).where(~F.col("path").startswith("memory/generated-smart-add/") & ~F.col("path").startswith("memory/dreaming/"))


@query("chunks_without_confidence", f"SELECT {FAMILY_SQL} AS family, count(*) AS n, count(*) FILTER (WHERE f.path IS NULL) AS without_file, max(updated_at) AS newest FROM chunks LEFT JOIN conf c ON id = c.chunk_id LEFT JOIN (SELECT DISTINCT path FROM chunks WHERE doc_id % 3 = 0) f USING (path) WHERE c.chunk_id IS NULL GROUP BY 1")
def chunks_without_confidence(s: Store) -> DataFrame:
    files = s.chunks.where("doc_id % 3 = 0").select("path", F.lit(True).alias("file")).distinct()
    rows = with_sidecar(s).where("chunk_id IS NULL").join(files, "path", "left")
    return rows.groupBy(scope_family(F.col("path")).alias("family")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("file").isNull()).alias("without_file"), F.max("updated_at").alias("newest"))


@query("event_prefix_join", "+ p AS (SELECT substr(id, 1, 16) AS memory_id, count(*) AS n FROM chunks GROUP BY 1) SELECT CASE WHEN p.n IS NULL THEN 'unmatched' WHEN p.n > 1 THEN 'ambiguous' ELSE 'matched' END AS status, count(*) AS events, count(DISTINCT e.memory_id) AS memories FROM ev e LEFT JOIN p USING (memory_id) GROUP BY 1")
def event_prefix_join(s: Store) -> DataFrame:
    prefixes = s.chunks.groupBy(F.substring("id", 1, 16).alias("memory_id")).agg(F.count(F.lit(1)).alias("n"))
    status = F.when(F.col("n").isNull(), "unmatched").when(F.col("n") > 1, "ambiguous").otherwise("matched")
    return s.events.join(prefixes, "memory_id", "left").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("events"), F.countDistinct("memory_id").alias("memories"))


def source_tags(path, category, text, external):
    t = F.lower(text)
    checkpoint = t.rlike(r"session\s*checkpoint|session[_ -]?key|session[_ -]?id") | F.lower(path).rlike("session[-_]?checkpoint")
    tags = {"retrieval_excluded": path.startswith("memory/generated-smart-add/"), "smart-add": path.startswith("memory/smart-add/"), "episodic": path.startswith("memory/episodes/") | (category == "episodic"), "session_checkpoint": checkpoint, "external": external}
    return F.array_compact(F.array(*[F.when(c, t) for t, c in tags.items()]))


_TAGS_SQL = """concat_ws(',', CASE WHEN starts_with(path, 'memory/generated-smart-add/') THEN 'retrieval_excluded' END, CASE WHEN starts_with(path, 'memory/smart-add/') THEN 'smart-add' END,
    CASE WHEN starts_with(path, 'memory/episodes/') OR category = 'episodic' THEN 'episodic' END, CASE WHEN regexp_matches(lower(text), 'session\\s*checkpoint|session[_ -]?key|session[_ -]?id') THEN 'session_checkpoint' END, CASE WHEN c.chunk_id IS NULL THEN 'external' END)"""


@query("source_tags", f"SELECT id, {_TAGS_SQL} AS tags FROM chunks LEFT JOIN conf c ON id = c.chunk_id")
def source_tags_query(s: Store) -> DataFrame:
    return with_sidecar(s).select("id", F.concat_ws(",", source_tags(F.col("path"), F.col("category"), F.col("text"), F.col("chunk_id").isNull())).alias("tags"))


@query("normalize_candidates", f"SELECT id, CASE WHEN c.chunk_id IS NULL THEN 'external' ELSE 'managed' END AS confidence_mode, CASE WHEN c.chunk_id IS NOT NULL THEN {rounded_sql(f'least(1, greatest(0, {REALTIME_SQL}))')} END AS confidence, substr(text, 1, 600) AS text, c.chunk_id IS NOT NULL AND coalesce(is_protected, 0) = 0 AS decays FROM chunks LEFT JOIN conf c ON id = c.chunk_id WHERE coalesce(is_archived, 0) = 0")
def normalize_candidates(s: Store) -> DataFrame:
    managed = F.col("chunk_id").isNotNull()
    rows = with_sidecar(s).where(F.coalesce("is_archived", F.lit(0)) == 0)
    # A chunk without a sidecar row has no confidence, which is not 0.
    live = F.when(managed, rounded(F.least(F.lit(1.0), F.greatest(F.lit(0.0), realtime_confidence()))))
    return rows.select("id", F.when(managed, "managed").otherwise("external").alias("confidence_mode"), live.alias("confidence"), F.substring("text", 1, 600).alias("text"), (managed & (F.coalesce("is_protected", F.lit(0)) == 0)).alias("decays"))


@query("realtime_confidence", f"SELECT chunk_id, {rounded_sql(REALTIME_SQL)} AS realtime FROM conf")
def realtime_query(s: Store) -> DataFrame:
    return s.confidence.select("chunk_id", rounded(realtime_confidence()).alias("realtime"))


@query("unknown_paths", f"SELECT path, count(*) AS n FROM (SELECT path, {FAMILY_SQL} AS family FROM chunks) WHERE family IN ('unknown', 'non_memory', 'daily_memory') GROUP BY path")
def unknown_paths(s: Store) -> DataFrame:
    return s.chunks.where(scope_family(F.col("path")).isin("unknown", "non_memory", "daily_memory")).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query("stale_quarantined", f"SELECT path, count(*) AS n, min(updated_at) AS oldest FROM chunks WHERE starts_with(path, 'memory/generated-smart-add/') AND updated_at < {NOW - 7 * 86400} GROUP BY path")
def stale_quarantined(s: Store) -> DataFrame:
    return s.chunks.where(F.col("path").startswith("memory/generated-smart-add/") & (F.col("updated_at") < NOW - 7 * 86400)).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("updated_at").alias("oldest"))


@query("non_lifecycle_usage", f"""+ u AS (SELECT memory_id, count(*) FILTER (WHERE event_type = 'memory_candidate_retrieved') AS retrieved, count(*) FILTER (WHERE event_type = 'memory_injected') AS injected FROM ev GROUP BY 1)
SELECT id, {FAMILY_SQL} AS family, injected, retrieved FROM chunks JOIN u ON memory_id = substr(id, 1, 16) WHERE {FAMILY_SQL} NOT IN ('smart_add', 'episode', 'unknown') ORDER BY injected DESC, retrieved DESC, family, id LIMIT 10""")
def non_lifecycle_usage(s: Store) -> DataFrame:
    use = s.events.groupBy("memory_id").agg(F.count_if(F.col("event_type") == "memory_candidate_retrieved").alias("retrieved"), F.count_if(F.col("event_type") == "memory_injected").alias("injected"))
    rows = s.chunks.select("id", F.substring("id", 1, 16).alias("memory_id"), scope_family(F.col("path")).alias("family")).where(~F.col("family").isin("smart_add", "episode", "unknown"))
    return rows.join(use, "memory_id").select("id", "family", "injected", "retrieved").orderBy(F.col("injected").desc(), F.col("retrieved").desc(), "family", "id").limit(10)
