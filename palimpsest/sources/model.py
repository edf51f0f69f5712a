"""The memory store as DataFrames: chunks, confidence sidecar, event log, vectors, transcripts, queries.

`Store` reads one folder of source tables and lays the store's model over them; MODEL_SQL states the same views in SQL.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2024-01-31T00:00:00Z, the clock of all queries: wall time would change their results.
NOW = 1706659200
CATEGORIES = ["temporary", "raw_log", "episodic", "preference", "kg_node", "user_identity"]
TAU = {"temporary": 2.0, "raw_log": 7.0, "episodic": 30.0, "preference": 30.0, "kg_node": 90.0, "user_identity": 365.0}
EVENT_TYPES = {"view": "memory_candidate_retrieved", "click": "memory_injected", "purchase": "memory_cited", "signup": "recall_started", "error": "recall_completed"}
WORD = r"[\p{L}\p{N}_]+"
# How query texts are read, and how many terms and fragments of one count.
STAMP = r"(?i)^\[(mon|tue|wed|thu|fri|sat|sun)\s+\d{4}[-/]\d{1,2}[-/]\d{1,2}\s[^\]]*(gmt|utc)[^\]]*\]\s*"
VERSION = r"(\d+(?:_\d+)+)\+?"
NOISE = r"mon|tue|wed|thu|fri|sat|sun|gmt|utc|20\d\d|\d{1,2}"
TERM = r"\p{Han}{2,}|[\p{L}\p{N}_]{2,}"
FRAGMENT = r"\p{Han}{2,}|[\p{L}\p{N}]+(?:[.+-][\p{L}\p{N}]+)+"
BROAD = ["memory", "engine", "model", "模型"]
MAX_TERMS, MAX_FRAGMENTS = 10, 8


def category_of(number) -> F.Column:
    return F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (number % 6 + 1).cast("int"))


def java(pattern: str) -> str:
    """A pattern as Spark writes it; a word's bounds are those of letters, digits and signs of ASCII."""
    return pattern.replace(r"\p{Han}", r"\p{IsHan}").replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def query_terms(raw: F.Column, most: int) -> F.Column:
    """The first `most` distinct terms of a lower-case query text.

    A version (2.1, 2_1+) is one term; week days, years and numbers of one or two digits are noise; terms have two letters
    or more; a run of more than four Han letters gives each two that are next to each other.
    """
    joined = raw
    for _ in range(2):  # numbers of one digit share their neighbours
        joined = F.regexp_replace(joined, r"(\d)[.](\d)", "$1_$2")
    words = F.regexp_extract_all(F.regexp_replace(joined, VERSION, " version_$1 "), F.lit(WORD), F.lit(0))
    terms = F.regexp_extract_all(F.array_join(F.filter(words, lambda w: ~w.rlike(f"^(?:{NOISE})$")), " "), F.lit(java(TERM)), F.lit(0))
    pairs = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))
    return F.slice(F.array_distinct(F.flatten(F.transform(terms, lambda t: F.when(t.rlike(java(r"^\p{Han}{5,}$")), pairs(t)).otherwise(F.array(t))))), 1, most)


def query_fragments(raw: F.Column, most: int) -> F.Column:
    """The first `most` distinct fragments of a lower-case query text that count when found as they stand: Han runs, words joined by signs."""
    return F.slice(F.array_distinct(F.regexp_extract_all(raw, F.lit(java(FRAGMENT)), F.lit(0))), 1, most)


def terms_of(queries: DataFrame) -> DataFrame:
    """query_id, term, and in how many terms its query has."""
    return queries.select("query_id", F.explode("words").alias("term"), F.size("words").cast("long").alias("n_terms"))


@dataclass(frozen=True)
class Store:
    """The store over a folder of tables; a query has max_terms terms and max_fragments fragments at most."""

    spark: SparkSession
    folder: str
    max_terms: int = MAX_TERMS
    max_fragments: int = MAX_FRAGMENTS

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def chunks(self) -> DataFrame:
        d, day = F.col("doc_id"), F.format_string("%02d", F.col("doc_id") % 30 + 1)
        path = (
            F.when(d % 10 <= 3, F.concat(F.lit("memory/smart-add/2024-01-"), day, F.lit(".md")))
            .when(d % 10 <= 5, F.concat(F.lit("memory/episodes/2024-01-"), day, F.lit(".md")))
            .when(d % 10 == 6, F.concat(F.lit("memory/projects/p"), (d % 7).cast("string"), F.lit(".md")))
            .when(d % 10 == 7, F.concat(F.lit("memory/dreaming/light/d"), (d % 5).cast("string"), F.lit(".md")))
            .when(d % 10 == 8, F.concat(F.lit("memory/2024-01-"), day, F.lit(".md")))
            .otherwise(F.concat(F.lit("memory/generated-smart-add/g"), (d % 3).cast("string"), F.lit(".md")))
        )
        return self.table("documents").select(
            F.sha2(d.cast("string"), 256).alias("id"), path.alias("path"), "source", "lang", "text", (F.lit(NOW) - (d % 60) * 43200).cast("long").alias("updated_at"), F.sha2("text", 256).alias("hash"), "doc_id"
        )

    @cached_property
    def confidence(self) -> DataFrame:
        d, category = F.col("doc_id"), category_of(F.col("doc_id"))
        tau = F.create_map(*[x for k, v in TAU.items() for x in (F.lit(k), F.lit(v))])
        flag = lambda n: (d % n == 0).cast("int")
        texts = self.table("documents").select("doc_id", F.when(d % 4 == 0, F.lower("text")).alias("words"))  # the others' texts stay out of the join
        owned = texts.join(self.table("labels"), "doc_id").select("doc_id", "toxic", "words", F.sha2(d.cast("string"), 256).alias("chunk_id"))
        orphans = self.table("labels").where(d % 29 == 0).select("doc_id", "toxic", F.lit(None).cast("string").alias("words"), F.sha2(F.concat(F.lit("orphan-"), d.cast("string")), 256).alias("chunk_id"))
        return owned.unionByName(orphans).select(
            "chunk_id", (F.lit(0.4) + F.lit(0.05) * (d % 12)).alias("confidence"), F.when(d % 19 != 0, F.lit(NOW) - (d % 45) * 86400).cast("long").alias("last_confidence_update"),
            F.element_at(tau, category).alias("base_tau"), (d % 7).cast("int").alias("hit_count"), flag(13).alias("is_archived"), flag(17).alias("is_protected"), F.col("toxic").cast("int").alias("conflict_flag"),
            category.alias("category"), F.col("words").alias("kg_data"),
        )

    @cached_property
    def events(self) -> DataFrame:
        k, kind = F.get_json_object("props", "$.k").cast("long"), F.create_map(*[F.lit(x) for kv in EVENT_TYPES.items() for x in kv])
        hour = F.date_format("ts", "yyyyMMddHH")
        return self.table("events").select(
            F.col("event_id").alias("id"), F.element_at(kind, F.col("event_type")).alias("event_type"), F.when(F.col("user_id") % 11 != 0, F.col("user_id").cast("string")).otherwise("").alias("session_id"),
            F.when(F.col("event_id") % 23 != 0, F.concat_ws("-", F.col("user_id").cast("string"), hour)).alias("trace_id"), F.substring(F.sha2((F.col("event_id") % 2000).cast("string"), 256), 1, 16).alias("memory_id"),
            F.floor(F.col("value") * 10).cast("long").alias("latency_ms"), (k % 30).alias("candidate_count"), (k % 6).alias("injected_count"), (k % 3).alias("cited_count"),
            F.when(F.col("event_id") % 7 != 0, k % 9).alias("rank"), category_of(F.col("event_id")).alias("category"), F.concat(F.lit("src"), (k % 5).cast("string")).alias("source"), F.col("ts").alias("created_at"), "props",
        )

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.sha2(F.col("vec_id").cast("string"), 256).alias("id"), "vec_id", F.col("embedding").alias("vector"), "label")

    @cached_property
    def queries(self) -> DataFrame:
        """Recall queries, the whole benchmark texts: query_id, words (terms, `max_terms` at most), fragments (`max_fragments`)."""
        raw = F.lower(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), STAMP, "")))
        return self.table("benchmark").select(F.col("item_id").alias("query_id"), query_terms(raw, self.max_terms).alias("words"), query_fragments(raw, self.max_fragments).alias("fragments"))

    @cached_property
    def terms(self) -> DataFrame:
        """query_id, term, n_terms of all queries."""
        return terms_of(self.queries)


_DAY = "lpad((doc_id % 30 + 1)::VARCHAR, 2, '0')"
_CATEGORY = "(['temporary', 'raw_log', 'episodic', 'preference', 'kg_node', 'user_identity'])[({} % 6 + 1)::INT]"
_DOT, _HAN_RUN = r"(\d)[.](\d)", r"\p{Han}{5,}"
#: The same views for DuckDB, as the start of a query.
MODEL_SQL = f"""
WITH RECURSIVE chunks AS (
    SELECT sha256(doc_id::VARCHAR) AS id, CASE WHEN doc_id % 10 <= 3 THEN 'memory/smart-add/2024-01-' || {_DAY} || '.md' WHEN doc_id % 10 <= 5 THEN 'memory/episodes/2024-01-' || {_DAY} || '.md'
        WHEN doc_id % 10 = 6 THEN 'memory/projects/p' || (doc_id % 7) || '.md' WHEN doc_id % 10 = 7 THEN 'memory/dreaming/light/d' || (doc_id % 5) || '.md'
        WHEN doc_id % 10 = 8 THEN 'memory/2024-01-' || {_DAY} || '.md' ELSE 'memory/generated-smart-add/g' || (doc_id % 3) || '.md' END AS path,
        source, lang, text, ({NOW} - (doc_id % 60) * 43200)::BIGINT AS updated_at, sha256(text) AS hash, doc_id FROM documents),
sidecar AS (
    SELECT d.doc_id, l.toxic, lower(d.text) AS words, sha256(d.doc_id::VARCHAR) AS chunk_id FROM documents d JOIN labels l ON d.doc_id = l.doc_id
    UNION ALL SELECT doc_id, toxic, NULL, sha256('orphan-' || doc_id) FROM labels WHERE doc_id % 29 = 0),
conf AS (
    SELECT chunk_id, 0.4::DOUBLE + 0.05::DOUBLE * (doc_id % 12) AS confidence, CASE WHEN doc_id % 19 <> 0 THEN {NOW} - (doc_id % 45) * 86400 END AS last_confidence_update,
        ([2.0, 7.0, 30.0, 30.0, 90.0, 365.0])[(doc_id % 6 + 1)::INT]::DOUBLE AS base_tau, (doc_id % 7)::INT AS hit_count, (doc_id % 13 = 0)::INT AS is_archived, (doc_id % 17 = 0)::INT AS is_protected,
        toxic::INT AS conflict_flag, {_CATEGORY.format("doc_id")} AS category, CASE WHEN doc_id % 4 = 0 THEN words END AS kg_data FROM sidecar),
ev AS (
    SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'memory_candidate_retrieved' WHEN 'click' THEN 'memory_injected' WHEN 'purchase' THEN 'memory_cited' WHEN 'signup' THEN 'recall_started' WHEN 'error' THEN 'recall_completed' END AS event_type,
        CASE WHEN user_id % 11 <> 0 THEN user_id::VARCHAR ELSE '' END AS session_id, CASE WHEN event_id % 23 <> 0 THEN user_id || '-' || strftime(ts, '%Y%m%d%H') END AS trace_id,
        substr(sha256((event_id % 2000)::VARCHAR), 1, 16) AS memory_id, floor(value * 10)::BIGINT AS latency_ms, k % 30 AS candidate_count, k % 6 AS injected_count, k % 3 AS cited_count,
        CASE WHEN event_id % 7 <> 0 THEN k % 9 END AS rank, {_CATEGORY.format("event_id")} AS category, 'src' || (k % 5) AS source, ts AS created_at, props
    FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events)),
vectors AS (SELECT sha256(vec_id::VARCHAR) AS id, vec_id, embedding AS vector, label FROM embeddings),
qraw AS (SELECT item_id AS query_id, lower(trim(regexp_replace(coalesce(text, ''), '{STAMP}', ''))) AS raw FROM benchmark),
qterms AS (SELECT query_id, raw, regexp_extract_all(array_to_string(list_filter(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(raw, '{_DOT}', '\\1_\\2', 'g'), '{_DOT}', '\\1_\\2', 'g'), '{VERSION}', ' version_\\1 ', 'g'), '{WORD}'),
    lambda w: NOT regexp_full_match(w, '{NOISE}')), ' '), '{TERM}') AS found FROM qraw),
qparts AS (SELECT query_id, flatten(list_transform(found, lambda t: CASE WHEN regexp_full_match(t, '{_HAN_RUN}') THEN list_transform(range(1, length(t)), lambda i: substr(t, i, 2)) ELSE [t] END)) AS parts, regexp_extract_all(raw, '{FRAGMENT}') AS pieces FROM qterms),
qwords AS (SELECT query_id, list_filter(parts, lambda x, i: list_position(parts, x) = i)[1:{MAX_TERMS}] AS words, list_filter(pieces, lambda x, i: list_position(pieces, x) = i)[1:{MAX_FRAGMENTS}] AS fragments FROM qparts),
terms AS (SELECT query_id, unnest(words) AS term, len(words)::BIGINT AS n_terms FROM qwords)
"""
