"""Fusion of the channels of retrieval, boosts, and the decision to go without vectors.

The text channels (sidecar and full text) are fused first. How well the best of their rows covers its query's terms says
whether the query's vectors are searched at all. Then all channels are fused by reciprocal ranks, and boosts are added whose
terms are rounded before, as callers see them. `semantic` is a channel's own score of a row.

The functions take DataFrames: channels (query_id, id, channel, position from 1, semantic), queries (query_id, words,
fragments) and chunks as `retrieval.searchable` has them. Of equal scores the smaller id comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.registry import query
from palimpsest.functions.scores import rounded, rounded_sql
from palimpsest.operators.retrieval import (
    BOOSTS, CHANNELS, CHANNELS_SQL, CHECKPOINT, CHECKPOINT_PATH, EPISODIC, EXACT_SQL, EXTERNAL, EXTERNAL_KINDS, HAYSTACK_SQL, OTHER_EXTERNAL, RRF, SESSION_CHECKPOINT, STRUCTURED_SQL, cached_once, channel_rows,
    coverage, described, exact_bonus, features, haystack, hits_sql, recency_sql, signal, signal_sql, structured_bonus, texts, top,
)
from palimpsest.sources.model import Store

#: Managed rows need this confidence; a query whose text channels reach the second goes without vectors.
MIN_CONFIDENCE, SKIP_VECTORS = 0.15, 0.7
TEXT_CHANNELS = ["kg", "fts"]


def admitted(channels: DataFrame, chunks: DataFrame, at_least: float = MIN_CONFIDENCE) -> DataFrame:
    """The channel rows of chunks that are external or have the confidence; those after a row that goes move up."""
    good = chunks.where(F.col("external") | (F.col("confidence") >= at_least)).select("id")
    place = F.row_number().over(W.partitionBy("query_id", "channel").orderBy("position", "id"))
    return channels.join(good, "id", "left_semi").select("query_id", "id", "channel", place.cast("long").alias("position"), "semantic")


def fuse(channels: DataFrame) -> DataFrame:
    """A row for each query and id: reciprocal ranks summed, the best semantic score, that of its first channel (similarity), its channels in order."""
    number = F.element_at(F.create_map(*[x for i, c in enumerate(CHANNELS) for x in (F.lit(c), F.lit(i))]), F.col("channel"))
    rows = channels.groupBy("query_id", "id").agg(
        F.sum(1 / (RRF + F.col("position"))).alias("rrf"), F.max("semantic").alias("semantic"), F.min_by("semantic", number).alias("similarity"),
        F.sort_array(F.collect_set(F.struct(number.alias("i"), "channel"))).alias("c"),
    )
    return rows.select("query_id", "id", rounded(F.col("rrf")).alias("rrf_score"), rounded(F.col("semantic")).alias("semantic_score"), "similarity", F.concat_ws(",", "c.channel").alias("channels"))


def ranked(fused: DataFrame, described: DataFrame) -> DataFrame:
    """Fused rows with their chunk's boosts and final_score, the sum of all."""
    rows, score = fused.join(described, "id"), F.col("semantic_score") + F.col("rrf_score")
    for name in BOOSTS:
        score = score + F.col(name)
    return rows.withColumn("final_score", rounded(score))


def enriched(fused: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Fused rows of the text channels with lex (share of the query's terms in path, text or kind), exact, structured, signal."""
    rows = fused.join(chunks.select("id", "path", "kind", haystack().alias("haystack")), "id").join(queries.select("query_id", "words", "fragments"), "query_id")
    parts = {"lex": coverage(F.col("words"), F.col("haystack")), "exact": exact_bonus(F.col("fragments")), "structured": structured_bonus()}
    return rows.select(*fused.columns, *[c.alias(name) for name, c in parts.items()]).withColumn("signal", signal(F.col("semantic_score")))


def confidence_of(lexical: DataFrame, queries: DataFrame, skip_at: float = SKIP_VECTORS) -> DataFrame:
    """How far a query's text channels can be trusted without vectors: a row for each query, of none with rows 0 and false.

    lexical: query_id, id, final_score, lex, exact, structured, channels. The best row counts, with the number of all.
    """
    first = top(lexical, 1, F.col("final_score").desc(), "id").drop("position")
    counts = lexical.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    one = lambda x: F.least(F.lit(1.0), x)
    support = one(F.size(F.split("channels", ",")) / 2.0) * 0.1
    total = one(F.col("n") / 3.0) * 0.15 + one(F.col("final_score") / 1.2) * 0.15 + F.col("lex") * 0.25 + one(F.col("exact") / 0.36) * 0.15 + one(F.col("structured") / 0.4) * 0.2 + support
    found = first.join(counts, "query_id").select("query_id", "n", "final_score", rounded(total).alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return queries.select("query_id").join(found, "query_id", "left").select(
        "query_id", F.coalesce("n", F.lit(0)).alias("lexical_candidate_count"), zero("final_score").alias("lexical_top_score"), zero("total").alias("lexical_confidence"),
        F.coalesce(F.col("total") >= skip_at, F.lit(False)).alias("vector_skipped"),
    )


# Each step's table is written once for a store: the queries below share them.


def _described(s: Store) -> DataFrame:
    return features(s).select("id", "path", "kind", "external", "confidence", "hits", "protected", "updated_at", "tags", *BOOSTS)


def _text_channels(s: Store) -> DataFrame:
    return cached_once(s, "text_channels", lambda: admitted(channel_rows(s, *TEXT_CHANNELS), _described(s)))()


def _lexical(s: Store) -> DataFrame:
    """Texts are read for the rows alone that these channels found, some for each query."""
    fused = cached_once(s, "text_ranked", lambda: ranked(fuse(_text_channels(s)), _described(s)).select("query_id", "id", "rrf_score", "semantic_score", "channels", "final_score"))()
    found = lambda: texts(s, fused).join(features(s).select("id", "path", "kind"), "id")
    return cached_once(s, "lexical", lambda: enriched(fused, found(), s.queries))()


def served(s: Store) -> DataFrame:
    """The rows of all channels that are fused: those of vectors only where the text channels do not do."""
    skipped = confidence_of(_lexical(s), s.queries).where("vector_skipped").select("query_id")
    others = channel_rows(s, *[c for c in CHANNELS if c not in TEXT_CHANNELS], skipped=skipped)
    return _text_channels(s).unionByName(admitted(others, _described(s)))


def boosted(s: Store) -> DataFrame:
    return cached_once(s, "boosted", lambda: ranked(fuse(served(s)), _described(s)).withColumn("sources", F.concat_ws(",", "channels", F.when(F.col("tags") != "", F.col("tags")))))()


_ORDER_SQL = "list_position(['" + "', '".join(CHANNELS) + "'], channel)"
_KIND_BOOST_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in EXTERNAL_KINDS.items()) + f" ELSE {OTHER_EXTERNAL}::DOUBLE END"
_TAGS_SQL = f"""concat_ws(',', CASE WHEN starts_with(path, 'memory/smart-add/') THEN 'smart-add' END, CASE WHEN starts_with(path, 'memory/episodes/') OR kind = 'episodic' THEN 'episodic' END,
    CASE WHEN regexp_matches(lower(coalesce(text, '')), '{CHECKPOINT}') OR regexp_matches(path, '{CHECKPOINT_PATH}') THEN 'session_checkpoint' END, CASE WHEN external THEN 'external' END)"""


def _fuse_sql(channels: str) -> str:
    return f"""SELECT query_id, id, {rounded_sql("sum(1 / (60 + position)::DOUBLE)")} AS rrf_score, {rounded_sql("max(semantic)")} AS semantic_score,
        arg_min(semantic, {_ORDER_SQL}) AS similarity, string_agg(channel, ',' ORDER BY {_ORDER_SQL}) AS channels FROM {channels} GROUP BY query_id, id"""


def _rank_sql(fused: str) -> str:
    return f"""SELECT *, {rounded_sql("semantic_score + rrf_score + category_boost + recency_boost + confidence_boost + external_boost")} AS final_score FROM (
        SELECT f.*, s.* EXCLUDE (id), {recency_sql(0.06)} AS recency_boost, {_TAGS_SQL} AS tags,
            CASE WHEN external THEN {_KIND_BOOST_SQL} WHEN kind = 'episodic' THEN {EPISODIC}::DOUBLE
                WHEN contains(lower(text), 'session checkpoint') OR contains(lower(text), 'session-checkpoint') THEN {SESSION_CHECKPOINT}::DOUBLE ELSE 0 END AS category_boost,
            CASE WHEN external THEN 0 ELSE coalesce({rounded_sql("confidence * 0.1::DOUBLE")}, 0) END AS confidence_boost,
            CASE WHEN external AND kind NOT IN ('dreaming', 'stats') THEN {EXTERNAL}::DOUBLE ELSE 0 END AS external_boost
        FROM {fused} f JOIN searchable s USING (id))"""


LEXICAL_SQL = f"""{CHANNELS_SQL},
admitted AS (SELECT query_id, id, channel, semantic, row_number() OVER (PARTITION BY query_id, channel ORDER BY position, id) AS position
    FROM channels JOIN searchable USING (id) WHERE external OR confidence >= {MIN_CONFIDENCE}),
text_fused AS ({_fuse_sql("(SELECT * FROM admitted WHERE channel IN ('kg', 'fts'))")}),
text_ranked AS ({_rank_sql("text_fused")}),
text_parts AS (SELECT query_id, id, rrf_score, semantic_score, channels, final_score, {EXACT_SQL.format("fragments")} AS exact, {STRUCTURED_SQL} AS structured,
        CASE WHEN n_terms > 0 THEN {rounded_sql(hits_sql("haystack", "ts") + " / n_terms::DOUBLE")} ELSE 0 END AS lex
    FROM (SELECT *, {HAYSTACK_SQL} AS haystack FROM text_ranked) JOIN qset USING (query_id)),
lexical AS (SELECT *, {signal_sql("semantic_score")} AS signal FROM text_parts),
text_totals AS (SELECT query_id, n, final_score, {rounded_sql('''least(1, n / 3.0::DOUBLE) * 0.15::DOUBLE + least(1, final_score / 1.2::DOUBLE) * 0.15::DOUBLE + lex * 0.25::DOUBLE + least(1, exact / 0.36::DOUBLE) * 0.15::DOUBLE
        + least(1, structured / 0.4::DOUBLE) * 0.2::DOUBLE + least(1, len(string_split(channels, ',')) / 2.0::DOUBLE) * 0.1::DOUBLE''')} AS total
    FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, id) AS r FROM lexical) WHERE r = 1),
trust AS (SELECT q.query_id, coalesce(n, 0) AS lexical_candidate_count, coalesce(final_score, 0) AS lexical_top_score, coalesce(total, 0) AS lexical_confidence, coalesce(total >= {SKIP_VECTORS}, false) AS vector_skipped
    FROM qset q LEFT JOIN text_totals USING (query_id))"""
FUSED_SQL = f"""{LEXICAL_SQL},
served AS (SELECT * FROM admitted WHERE channel <> 'vector' OR query_id NOT IN (SELECT query_id FROM trust WHERE vector_skipped)),
fused AS ({_fuse_sql("served")})"""
BOOSTED_SQL = f"{FUSED_SQL}, boosted AS (SELECT *, concat_ws(',', channels, CASE WHEN tags <> '' THEN tags END) AS sources FROM ({_rank_sql('fused')}))"


@query("lexical_fusion", f"+ {LEXICAL_SQL} SELECT query_id, id, channels, rrf_score, semantic_score, final_score, lex, exact, structured, signal FROM lexical")
def lexical_fusion(s: Store) -> DataFrame:
    """The text channels fused, each row with what it has of its query."""
    return _lexical(s)


@query("lexical_confidence", f"+ {LEXICAL_SQL} SELECT * FROM trust")
def lexical_confidence(s: Store) -> DataFrame:
    return confidence_of(_lexical(s), s.queries)


@query("rrf_fusion", f"+ {FUSED_SQL} SELECT * FROM fused")
def rrf_fusion(s: Store) -> DataFrame:
    return fuse(served(s))


SEARCH_SQL = f"""+ {BOOSTED_SQL}
SELECT query_id, rank, substr(id, 1, 16) AS id, substr(text, 1, 240) AS text, path, kind AS category, CASE WHEN external THEN 'external' ELSE 'managed' END AS confidence_mode,
    CASE WHEN external THEN 'core' ELSE 'managed' END AS source_type, external AS external_badge, NOT external AND NOT protected AS decay_eligible, NOT external AND NOT protected AS archive_eligible,
    semantic_score, rrf_score, recency_boost, category_boost, confidence_boost, external_boost, final_score, sources, similarity, confidence, hits, updated_at AS created_at
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, id) AS rank FROM boosted) WHERE rank <= 5"""


@query("hybrid_search", SEARCH_SQL)
def hybrid_search(s: Store, k: int = 5) -> DataFrame:
    """The k best rows of each query; texts are read for these alone."""
    best = top(boosted(s), k, F.col("final_score").desc(), "id")
    best = best.join(texts(s, best), "id")
    managed, keeps = ~F.col("external"), F.col("protected")
    return best.select(
        "query_id", F.col("position").cast("long").alias("rank"), F.substring("id", 1, 16).alias("id"), F.substring("text", 1, 240).alias("text"), "path", F.col("kind").alias("category"),
        F.when(managed, "managed").otherwise("external").alias("confidence_mode"), F.when(managed, "managed").otherwise("core").alias("source_type"), F.col("external").alias("external_badge"),
        (managed & ~keeps).alias("decay_eligible"), (managed & ~keeps).alias("archive_eligible"), "semantic_score", "rrf_score", "recency_boost", "category_boost", "confidence_boost", "external_boost",
        "final_score", "sources", "similarity", "confidence", "hits", F.col("updated_at").alias("created_at"),
    )


BREAKDOWN_SQL = f"""+ {BOOSTED_SQL}
SELECT query_id, 'channel' AS part, channel AS name, count(*) AS n FROM served GROUP BY query_id, channel
UNION ALL SELECT query_id, 'source', name, count(*) FROM (SELECT query_id, unnest(list_distinct(string_split(sources, ','))) AS name FROM boosted) GROUP BY query_id, name
UNION ALL SELECT query_id, 'category', kind, count(*) FROM boosted GROUP BY query_id, kind"""


@query("hybrid_breakdown", BREAKDOWN_SQL)
def hybrid_breakdown(s: Store) -> DataFrame:
    """How many rows each channel gave a query (channel), and how many fused rows each source and category has."""
    rows = boosted(s)

    def named(part: str, names: Column) -> Column:
        return F.transform(F.array_distinct(names), lambda name: F.struct(F.lit(part).alias("part"), name.alias("name")))

    parts = [named("channel", F.split("channels", ",")), named("source", F.split("sources", ",")), named("category", F.array("kind"))]
    each = rows.select("query_id", F.explode(F.concat(*parts)).alias("x"))
    return each.groupBy("query_id", "x.part", "x.name").agg(F.count(F.lit(1)).alias("n"))


def _rerank_sql(stage: str, score: str) -> str:
    return f"""SELECT query_id, '{stage}' AS stage, rank, substr(id, 1, 16) AS id, {score} AS score, kind AS category, sources FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, id) AS rank FROM boosted) WHERE rank <= 8"""


@query("hybrid_rerank", f"+ {BOOSTED_SQL} {_rerank_sql('pre', 'rrf_score')} UNION ALL {_rerank_sql('post', 'final_score')}")
def hybrid_rerank(s: Store, k: int = 8) -> DataFrame:
    """The k best rows of each query before the boosts (by reciprocal ranks alone) and after them."""
    rows = boosted(s)
    best = lambda stage, score: top(rows, k, F.col(score).desc(), "id").select("query_id", F.lit(stage).alias("stage"), F.col("position").cast("long").alias("rank"), F.substring("id", 1, 16).alias("id"), F.col(score).alias("score"), F.col("kind").alias("category"), "sources")
    return best("pre", "rrf_score").unionByName(best("post", "final_score"))
