"""The channels of ranked retrieval, for a table of queries at once.

Channels propose candidates: sidecar text, full text (BM25), vectors, substring, recency, episodes. Each row carries its
query, so that one plan answers all queries. What they propose is fused in `fusion`.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.registry import query
from palimpsest.functions.tables import saved
from palimpsest.functions.scores import KIND_SQL, REALTIME_SQL, kind_of, realtime_confidence, rounded, rounded_sql
from palimpsest.operators import matching
from palimpsest.operators.lookup import NEAREST_SQL, nearest, probes, with_sidecar
from palimpsest.operators.matching import WEIGHTS, Asked, Score, Sheet, best, numbered, share
from palimpsest.sources.model import BROAD, NOW, WORD, Store

K1, B = 1.2, 0.75
RRF = 60
CHECKPOINT = r"session\s*checkpoint|session[_ -]?key|session[_ -]?id"
CHECKPOINT_PATH = r"(?i)session[-_]?checkpoint"
# What a row's kind adds to its score.
EXTERNAL_KINDS = {"core_profile": 0.06, "project": 0.05, "daily_journal": 0.02, "dreaming": 0.0, "stats": -0.05, "external": 0.03}
OTHER_EXTERNAL, EXTERNAL, WITHOUT_EXTERNAL = 0.03, 0.05, ["dreaming", "stats"]
EPISODIC, SESSION_CHECKPOINT = 0.12, 0.10
BOOSTS = ["category_boost", "recency_boost", "confidence_boost", "external_boost"]
CHANNELS = ["kg", "fts", "vector", "like", "recent", "episode", "recent_fallback"]


def tokens(text) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def recency(at: Column, base: float) -> Column:
    return rounded(base * F.exp(-F.greatest(F.lit(0.0), (F.lit(NOW) - at) / 86400.0) / 2.5))


def recency_sql(base: float) -> str:
    return rounded_sql(f"{base}::DOUBLE * exp(-greatest(0, ({NOW} - updated_at) / 86400.0::DOUBLE) / 2.5::DOUBLE)")


def searchable(s: Store) -> DataFrame:
    """Chunks that retrieval may return, with what the sidecar says of them: realtime confidence, kind, hits, protection.

    `category` is the sidecar's own; `kind` is never null: it falls back to what text and path say.
    """
    rows = with_sidecar(s).where((F.coalesce("is_archived", F.lit(0)) == 0) & ~F.col("path").startswith("memory/generated-smart-add/"))
    managed = F.col("chunk_id").isNotNull()
    confidence = F.when(managed, rounded(F.least(F.lit(1.0), F.greatest(F.lit(0.0), realtime_confidence()))))
    return rows.select(
        "id", "path", "text", "updated_at", "category", "kg_data", confidence.alias("confidence"), (~managed).alias("external"),
        kind_of(F.col("category"), F.col("path"), F.col("text"), ~managed).alias("kind"),
        F.coalesce("hit_count", F.lit(0)).alias("hits"), (F.coalesce("is_protected", F.lit(0)) != 0).alias("protected"),
    )


def boosts() -> dict[str, Column]:
    """What kind, age and confidence of a chunk add to its score."""
    low, kind, external = F.lower("text"), F.col("kind"), F.col("external")
    by_kind = F.coalesce(F.element_at(F.create_map(*[x for k, v in EXTERNAL_KINDS.items() for x in (F.lit(k), F.lit(v))]), kind), F.lit(OTHER_EXTERNAL))
    managed = F.when(kind == "episodic", EPISODIC).when(low.contains("session checkpoint") | low.contains("session-checkpoint"), SESSION_CHECKPOINT).otherwise(0.0)
    return {
        "category_boost": F.when(external, by_kind).otherwise(managed),
        "recency_boost": recency(F.col("updated_at"), 0.06),
        "confidence_boost": F.when(external, 0.0).otherwise(F.coalesce(rounded(F.col("confidence") * 0.1), F.lit(0.0))),
        "external_boost": F.when(external & ~kind.isin(WITHOUT_EXTERNAL), EXTERNAL).otherwise(0.0),
    }


def tags() -> Column:
    """What a chunk is besides the channels that found it, joined by commas."""
    session = F.lower("text").rlike(CHECKPOINT) | F.col("path").rlike(CHECKPOINT_PATH)
    tests = {"smart-add": F.col("path").startswith("memory/smart-add/"), "episodic": F.col("path").startswith("memory/episodes/") | (F.col("kind") == "episodic"), "session_checkpoint": session, "external": F.col("external")}
    return F.concat_ws(",", *[F.when(test, name) for name, test in tests.items()])


def described(chunks: DataFrame) -> DataFrame:
    """Chunks without their texts, with boosts and tags: what ranking needs of them."""
    return chunks.select("id", "path", "kind", "external", "confidence", "hits", "protected", "updated_at", tags().alias("tags"), *[c.alias(name) for name, c in boosts().items()])


def asked(s: Store) -> Asked:
    """The store's queries, read once."""
    if "asked" not in s.__dict__:
        s.__dict__["asked"] = Asked.of(s.queries)
    return s.__dict__["asked"]


def place(*columns: str) -> Column:
    """Columns in lower case, a line each."""
    return F.lower(F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in columns]))


def features(s: Store) -> DataFrame:
    """searchable(s) without texts, with boosts and tags, and the terms of all queries that text (`terms`) and kg_data (`kg_terms`) have: written once for a store, for all channels and steps after them."""

    def make() -> DataFrame:
        text, rows = F.lower("text"), searchable(s)
        checkpoint = F.coalesce(text.rlike(CHECKPOINT), F.lit(False)) | F.col("path").rlike(CHECKPOINT_PATH)
        rows = rows.select(
            "id", "path", "updated_at", "category", "confidence", "external", "kind", "hits", "protected", checkpoint.alias("checkpoint"), tags().alias("tags"), *[c.alias(name) for name, c in boosts().items()],
            tokens("text").alias("words"), tokens(F.nullif("kg_data", F.lit(""))).alias("kg_words"), text.alias("low"),
        )
        q = asked(s)
        return numbered(rows if q.fragments else rows.drop("low"), q, {"words": "terms", "kg_words": "kg_terms"}, "low" if q.fragments else None)

    return cached_once(s, "features", make)()


def texts(s: Store, ids: DataFrame) -> DataFrame:
    """id, text of some rows: ids are few for each query."""
    return s.chunks.select("id", "text").join(F.broadcast(ids.select("id").distinct()), "id", "left_semi")


SEARCHABLE_SQL = f"""searchable AS (
    SELECT id, path, text, updated_at, category, kg_data, CASE WHEN c.chunk_id IS NOT NULL THEN {rounded_sql(f'least(1, greatest(0, {REALTIME_SQL}))')} END AS confidence,
        c.chunk_id IS NULL AS external, {KIND_SQL} AS kind, coalesce(hit_count, 0) AS hits, coalesce(is_protected, 0) <> 0 AS protected
    FROM chunks LEFT JOIN conf c ON id = c.chunk_id WHERE coalesce(is_archived, 0) = 0 AND NOT starts_with(path, 'memory/generated-smart-add/')),
qset AS (SELECT query_id, words AS ts, len(words) AS n_terms, fragments FROM qwords)"""


def matched(s: Store, rows: DataFrame, column: str, terms: DataFrame | None = None) -> DataFrame:
    """rows for each query with `lex`: the share of its terms that column has, and `share`, the same unrounded; rows without any go.

    A term is a substring; one of digits alone has no digit next to it. It has no white space or signs, so it is part of a
    text if it is part of one of its words.
    """
    terms = s.terms if terms is None else terms
    q = Asked.of(terms.groupBy("query_id").agg(F.collect_set("term").alias("words"), F.array().cast("array<string>").alias("fragments")))
    found = best(numbered(rows.withColumn("words", tokens(column)), q, {"words": "terms"}), q, by_share(q, "terms"), None, rows.columns, [])
    return found.withColumnRenamed("score", "share").withColumn("lex", rounded(F.col("share")))


def by_share(q: Asked, terms: str) -> Score:
    """A query's share of terms that the rows' column `terms` has."""
    return lambda sheet: (np.where((hits := sheet.spread(*sheet.items(terms))) > 0, share(hits, q), -np.inf), {})


def newest_with_share(sheet: Sheet) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Rows that have a term of a query, newest first."""
    hits = sheet.hits()
    return np.where(hits > 0, sheet.column("updated_at").astype(float), -np.inf), {"share": share(hits, sheet.asked)}


def hits_sql(text: str, terms: str = "q.ts") -> str:
    """How many of the terms a lower-case text has."""
    return f"len(list_filter({terms}, lambda t: contains({text}, t) AND (NOT regexp_full_match(t, '[0-9]+') OR regexp_matches({text}, '(^|[^0-9])' || t || '([^0-9]|$)'))))"


MATCHED_SQL = f"matched AS (SELECT s.*, q.query_id, {rounded_sql(hits_sql('lower(s.text)') + ' / q.n_terms::DOUBLE')} AS lex FROM searchable s, qset q WHERE {hits_sql('lower(s.text)')} > 0)"


def full_text(s: Store, k: int, missing: int | None = None) -> DataFrame:
    """query_id, id, hits (terms of the query that the text has), n_terms, score: each task's k best by BM25; with missing, of texts that have all terms but so many."""
    q, rows = asked(s), features(s).select("id", "own", "times", "size")
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean")).first()
    # Rows that repeat an id are one text.
    rows = rows.where(F.size("own") > 0).groupBy("id").agg(F.flatten(F.collect_list("own")).alias("own"), F.flatten(F.collect_list("times")).alias("times"), F.first("size").alias("size"))
    rows = cached_once(s, "postings", lambda: rows)()
    df = dict(rows.select(F.explode(F.array_distinct("own")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect())  # a row for each term that is asked for
    n, mean = whole.n, float(whole.mean or 0)
    idf = np.array([np.log(1 + (n - df.get(t, 0) + 0.5) / (df.get(t, 0) + 0.5)) for t in range(len(q.terms))])

    def bm25(sheet: Sheet) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        row, term = sheet.items("own")
        key, again = np.unique(row * max(1, len(idf)) + term, return_inverse=True)
        tf, row, term = np.bincount(again, sheet.items("times")[1], len(key)), key // max(1, len(idf)), key % max(1, len(idf))
        length = sheet.column("size")[:, 0].astype(float)[row]
        score = matching.rounded(sheet.spread(row, term, idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))))
        hits = sheet.spread(row, term)
        need = 1 if missing is None else np.maximum(1, sheet.asked.n_terms - missing)[None, :]
        return np.where(hits >= need, score, -np.inf), {"hits": hits, "n_terms": sheet.asked.n_terms[None, :]}

    found = best(rows, q, bm25, k, [], ["hits", "n_terms"])
    return found.select("query_id", "id", F.col("hits").cast("long").alias("hits"), F.col("n_terms").cast("long").alias("n_terms"), "score")


FULL_TEXT_SQL = f"""post AS (SELECT id, term, count(*) AS tf, any_value(length) AS length FROM (SELECT id, unnest(w) AS term, len(w) AS length FROM (SELECT id, regexp_extract_all(lower(text), '{WORD}') AS w FROM searchable)) GROUP BY id, term),
    df AS (SELECT term, count(*) AS df FROM post GROUP BY term), whole AS (SELECT count(*) AS n, avg(len(regexp_extract_all(lower(text), '{WORD}'))) AS mean FROM searchable),
    fts AS (SELECT query_id, id, count(*) AS hits, any_value(n_terms) AS n_terms, {rounded_sql('sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean)))')} AS score
        FROM post JOIN terms USING (term) JOIN df USING (term), whole GROUP BY query_id, id)"""


def top(rows: DataFrame, k: int, *order) -> DataFrame:
    """The first k rows of each query, with their position from 1."""
    return rows.withColumn("position", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("position") <= k)


def top_sql(rows: str, k: int, order: str) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS position FROM ({rows})) WHERE position <= {k}"


@query("fts_or", f"+ {SEARCHABLE_SQL}, {FULL_TEXT_SQL} {top_sql('SELECT * FROM fts', 20, 'score DESC, id')}")
def fts_or(s: Store) -> DataFrame:
    return top(full_text(s, 20), 20, F.col("score").desc(), "id")


@query("fts_strict", f"+ {SEARCHABLE_SQL}, {FULL_TEXT_SQL} {top_sql('SELECT * FROM fts WHERE hits >= n_terms', 20, 'score DESC, id')}")
def fts_strict(s: Store, missing: int = 0) -> DataFrame:
    """Texts that have all terms of a query, or all but `missing`."""
    return top(full_text(s, 20, missing), 20, F.col("score").desc(), "id")


def text_channels(s: Store, rows: DataFrame, no_text: DataFrame) -> DataFrame:
    """query_id, id, channel, position, semantic of the channels like, recent and episode: texts are held against the terms once.

    like has the newest matches of the queries of no_text; recent the newest matches of two families, by score; episode
    those of them that are episodes.
    """
    newest, score = (F.col("updated_at").desc(), F.col("id")), (F.col("semantic").desc(), F.col("updated_at").desc(), F.col("id"))
    family = F.col("path").startswith("memory/smart-add/") | F.col("path").startswith("memory/episodes/")
    part = lambda test, k: best(rows.where(test).select("id", "path", "terms", "updated_at"), asked(s), newest_with_share, k, ["path", "updated_at"], ["share"])
    text = part(family, 120).unionByName(part(~family, 30)).select("query_id", "id", "path", "updated_at", rounded(F.col("share")).alias("lex"), family.alias("family"))
    text = text.join(no_text.withColumn("no_text", F.lit(True)), "query_id", "left").withColumn("no_text", F.coalesce("no_text", F.lit(False)))
    # A row of another family is far enough down its own list to go, where full text has found something.
    nth = F.row_number().over(W.partitionBy("query_id", "family").orderBy(*newest))
    text = text.withColumn("nth", nth).where("nth <= 120").where((F.col("family") & (F.col("nth") <= 120)) | (F.col("no_text") & (F.col("nth") <= 30)))
    text = text.withColumns({"semantic": rounded(0.35 + F.col("lex") + recency(F.col("updated_at"), 0.06)), "own": F.col("family") & (F.col("nth") <= 120), "episode": F.col("path").startswith("memory/episodes/")})
    places = {"like": W.partitionBy("query_id").orderBy(*newest), "recent": W.partitionBy("query_id", "own").orderBy(*score), "episode": W.partitionBy("query_id", "own", "episode").orderBy(*score)}
    text = text.withColumns({f"at_{c}": F.row_number().over(w) for c, w in places.items()})
    tests = {"like": (F.col("no_text") & (F.col("at_like") <= 30), 0.3 + F.col("lex")), "recent": (F.col("own"), F.col("semantic")), "episode": (F.col("own") & F.col("episode") & (F.col("at_episode") <= 20), F.col("semantic") + 0.08)}
    each = [F.when(test, F.struct(F.lit(c).alias("channel"), F.col(f"at_{c}").cast("long").alias("position"), rounded(x).alias("semantic"))) for c, (test, x) in tests.items()]
    return text.select("query_id", "id", F.explode(F.array_compact(F.array(*each))).alias("c")).select("query_id", "id", "c.*")


def channel_rows(s: Store, *wanted: str, skipped: DataFrame | None = None) -> DataFrame:
    """query_id, id, channel, position, semantic: the candidates of the wanted channels, of all if none is named.

    All channels read one table of rows and the terms they have, without texts. The queries of skipped (query_id) go
    without vectors.
    """
    wanted, rows = wanted or tuple(CHANNELS), features(s)
    newest = (F.col("updated_at").desc(), F.col("id"))
    family = F.col("path").startswith("memory/smart-add/") | F.col("path").startswith("memory/episodes/")
    found = cached_once(s, "full_text_found", lambda: fts_or(s).select("query_id", "id", "position", F.lit(0.5).alias("semantic")))
    no_text = cached_once(s, "no_text", lambda: s.queries.select("query_id").distinct().join(found(), "query_id", "left_anti"))

    def kg() -> DataFrame:
        score = lambda sheet: (matching.rounded(0.45 + matching.rounded(by_share(sheet.asked, "kg_terms")(sheet)[0])), {})
        held = best(rows.where(F.size("kg_terms") > 0).select("id", "kg_terms", "updated_at"), asked(s), score, 20, ["updated_at"], [], ("updated_at",)).withColumnRenamed("score", "semantic")
        return top(held, 20, F.col("semantic").desc(), *newest)

    def vector() -> DataFrame:
        asked = probes(s) if skipped is None else probes(s).join(skipped, "query_id", "left_anti")
        return nearest(s.vectors, asked, 30).join(rows.select("id"), "id").select("query_id", "id", "position", rounded(1 - F.col("distance")).alias("semantic"))

    def recent_fallback() -> DataFrame:
        last = rows.where(family).select("id", "updated_at").orderBy(*newest).limit(20)
        return top(last.crossJoin(no_text()), 20, *newest).withColumn("semantic", rounded(0.25 + recency(F.col("updated_at"), 0.06)))  # 20 rows a query

    def texts() -> DataFrame:
        none = s.queries.select("query_id").limit(0)
        return text_channels(s, rows, no_text() if "like" in wanted else none).where(F.col("channel").isin(*wanted))

    shaped = lambda name, part: part.select("query_id", "id", F.lit(name).alias("channel"), F.col("position").cast("long").alias("position"), F.col("semantic").cast("double").alias("semantic"))
    parts = [shaped(name, make()) for name, make in {"kg": kg, "fts": found, "vector": vector, "recent_fallback": recent_fallback}.items() if name in wanted]
    if {"like", "recent", "episode"} & set(wanted):
        parts.append(texts())
    return reduce(DataFrame.unionByName, parts)


def cached_once(s: Store, name: str, make: Callable[[], DataFrame]) -> Callable[[], DataFrame]:
    """make, called once for a store and written: several channels and steps read what it gives."""

    def get() -> DataFrame:
        if name not in s.__dict__:
            s.__dict__[name] = saved(make(), name.replace("_", "-"))
        return s.__dict__[name]

    return get


_FAMILY = "(starts_with(path, 'memory/smart-add/') OR starts_with(path, 'memory/episodes/'))"
_SCORE = "semantic DESC, updated_at DESC, id"
_RECENT = f"SELECT * EXCLUDE (position), {rounded_sql(f'0.35::DOUBLE + lex + {recency_sql(0.06)}')} AS semantic FROM ({top_sql(f'SELECT * FROM matched WHERE {_FAMILY}', 120, 'updated_at DESC, id')})"
_KG_LEX = rounded_sql(f"{hits_sql('lower(s.kg_data)')} / q.n_terms::DOUBLE")
CHANNELS_SQL = f"""{SEARCHABLE_SQL}, {MATCHED_SQL}, {FULL_TEXT_SQL}, {NEAREST_SQL},
ftop AS ({top_sql('SELECT * FROM fts', 20, 'score DESC, id')}), no_text AS (SELECT query_id FROM qset WHERE query_id NOT IN (SELECT query_id FROM ftop)), rec AS ({_RECENT}),
channels AS (
    SELECT query_id, id, 'kg' AS channel, position, semantic FROM ({top_sql(f"SELECT s.id, s.updated_at, q.query_id, {rounded_sql(f'0.45::DOUBLE + {_KG_LEX}')} AS semantic FROM searchable s, qset q WHERE s.kg_data <> '' AND {hits_sql('lower(s.kg_data)')} > 0", 20, _SCORE)})
    UNION ALL SELECT query_id, id, 'fts', position, 0.5 FROM ftop
    UNION ALL SELECT query_id, id, 'vector', position, {rounded_sql('1 - distance')} FROM near WHERE id IN (SELECT id FROM searchable)
    UNION ALL SELECT query_id, id, 'like', position, {rounded_sql('0.3::DOUBLE + lex')} FROM ({top_sql('SELECT * FROM matched WHERE query_id IN (SELECT query_id FROM no_text)', 30, 'updated_at DESC, id')})
    UNION ALL SELECT query_id, id, 'recent', position, semantic FROM ({top_sql('SELECT * FROM rec', 120, _SCORE)})
    UNION ALL SELECT query_id, id, 'episode', position, semantic FROM ({top_sql(f"SELECT * EXCLUDE (semantic), {rounded_sql('semantic + 0.08::DOUBLE')} AS semantic FROM rec WHERE starts_with(path, 'memory/episodes/')", 20, _SCORE)})
    UNION ALL SELECT query_id, id, 'recent_fallback', position, {rounded_sql(f'0.25::DOUBLE + {recency_sql(0.06)}')} FROM ({top_sql(f'SELECT s.*, n.query_id FROM searchable s, no_text n WHERE {_FAMILY}', 20, 'updated_at DESC, id')}))"""


for _name, _channel in (("kg_channel", "kg"), ("like_channel", "like"), ("recent_channel", "recent"), ("episode_channel", "episode"), ("recent_fallback_channel", "recent_fallback")):
    if _channel not in ("like", "recent_fallback"):
        query(_name, f"+ {CHANNELS_SQL} SELECT query_id, id, position, semantic FROM channels WHERE channel = '{_channel}'")(lambda s, c=_channel: channel_rows(s, c).drop("channel"))


@query("like_channel", f"+ {SEARCHABLE_SQL}, {MATCHED_SQL} SELECT query_id, id, position, {rounded_sql('0.3::DOUBLE + lex')} AS semantic FROM ({top_sql('SELECT * FROM matched', 30, 'updated_at DESC, id')})")
def like_channel(s: Store) -> DataFrame:
    """The substring channel by itself, without the test that full text came up empty."""
    rows = best(features(s).select("id", "terms", "updated_at"), asked(s), newest_with_share, 30, ["updated_at"], ["share"])
    rows = top(rows, 30, F.col("updated_at").desc(), "id")
    return rows.select("query_id", "id", F.col("position").cast("long").alias("position"), rounded(0.3 + rounded(F.col("share"))).alias("semantic"))


@query("recent_fallback_channel", f"+ {SEARCHABLE_SQL} SELECT query_id, id, position, {rounded_sql(f'0.25::DOUBLE + {recency_sql(0.06)}')} AS semantic FROM ({top_sql(f'SELECT s.*, q.query_id FROM searchable s, qset q WHERE {_FAMILY}', 20, 'updated_at DESC, id')})")
def recent_fallback_channel(s: Store) -> DataFrame:
    family = F.col("path").startswith("memory/smart-add/") | F.col("path").startswith("memory/episodes/")
    newest = searchable(s).where(family).select("id", "updated_at").orderBy(F.col("updated_at").desc(), "id").limit(20)
    rows = top(newest.crossJoin(s.queries.select("query_id")), 20, F.col("updated_at").desc(), "id")
    return rows.select("query_id", "id", F.col("position").cast("long").alias("position"), rounded(0.25 + recency(F.col("updated_at"), 0.06)).alias("semantic"))


_PLACES_SQL = {"kind": "lower(kind)", "file": "split_part(lower(path), '/', -1)", "module": "split_part(lower(path), '/', -2)", "path": "lower(path)"}
_BONUS_SQL = " + ".join(f"{w} * len(list_filter({items}, lambda t: contains({_PLACES_SQL[place]}, t)))" for k, items in enumerate(("ts", "fragments")) for place, w in ((p, v[k]) for p, v in WEIGHTS.items()))
EXACT_SQL = "least(36, 12 * len(list_filter({}, lambda f: contains(haystack, f)))) / 100.0::DOUBLE"
STRUCTURED_SQL = f"least(40, {_BONUS_SQL}) / 100.0::DOUBLE"
HAYSTACK_SQL = "lower(path || chr(10) || coalesce(text, '') || chr(10) || kind)"


def signal_sql(semantic: str) -> str:
    return rounded_sql(f"0.55::DOUBLE * lex + least(1, exact / 0.36::DOUBLE) * 0.2::DOUBLE + least(1, structured / 0.4::DOUBLE) * 0.15::DOUBLE + least(1, {semantic}) * 0.1::DOUBLE")


_ENRICH_SQL = f"""{SEARCHABLE_SQL}, hay AS (SELECT *, {HAYSTACK_SQL} AS haystack FROM searchable),
held AS (SELECT h.*, q.query_id, q.ts, q.fragments, {rounded_sql(hits_sql('h.haystack') + ' / q.n_terms::DOUBLE')} AS lex FROM hay h, qset q WHERE {hits_sql('h.haystack')} > 0),
lexical AS (SELECT *, {signal_sql('0.3::DOUBLE + lex')} AS signal FROM (SELECT query_id, id, lex, updated_at, {EXACT_SQL.format('fragments')} AS exact, {STRUCTURED_SQL} AS structured FROM held))"""


def haystack() -> Column:
    return F.lower(F.concat_ws("\n", "path", F.coalesce("text", F.lit("")), "kind"))


def coverage(terms: Column, text: Column) -> Column:
    """The share of the terms that a lower-case text has; one of digits alone has no digit next to it. No terms have 0."""
    alone = lambda t: ~t.rlike("^[0-9]+$") | F.regexp_like(text, F.concat(F.lit("(^|[^0-9])"), t, F.lit("([^0-9]|$)")))
    return F.when(F.size(terms) > 0, rounded(F.size(F.filter(terms, lambda t: text.contains(t) & alone(t))) / F.size(terms))).otherwise(F.lit(0.0))


def exact_bonus(fragments: Column) -> Column:
    """12 hundredths for each fragment that the row's haystack has, 36 at most."""
    return F.least(F.lit(36), 12 * F.size(F.filter(fragments, lambda f: F.col("haystack").contains(f)))) / 100.0


def structured_bonus() -> Column:
    """Hundredths for terms (`words`) and `fragments` in a row's kind, file, module and path."""
    parts = F.split(F.lower("path"), "/")
    places = {"kind": F.lower("kind"), "file": F.element_at(parts, -1), "module": F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(""), "path": F.lower("path")}
    count_in = lambda items, c: F.size(F.filter(items, lambda t: c.contains(t)))
    bonus = F.lit(0)
    for k, items in enumerate(("words", "fragments")):
        for place, c in places.items():
            bonus = bonus + WEIGHTS[place][k] * count_in(items, c)
    return F.least(F.lit(40), bonus) / 100.0


def signal(semantic: Column) -> Column:
    """What coverage (lex), exact and structured matches and a semantic score say together."""
    one = lambda x: F.least(F.lit(1.0), x)
    return rounded(0.55 * F.col("lex") + one(F.col("exact") / 0.36) * 0.2 + one(F.col("structured") / 0.4) * 0.15 + one(semantic) * 0.1)


def enrichment(sheet: Sheet) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """signal, lex, exact and structured of the rows whose path, text or kind has a term of the query; the semantic share is that of the substring channel."""
    hits = sheet.hits("place")
    lex, exact, structured = matching.rounded(share(hits, sheet.asked)), sheet.exact("place"), sheet.structured("place")
    total = 0.55 * lex + np.minimum(1.0, exact / 0.36) * 0.2 + np.minimum(1.0, structured / 0.4) * 0.15 + np.minimum(1.0, 0.3 + lex) * 0.1
    return np.where(hits > 0, matching.rounded(total), -np.inf), {"lex": lex, "exact": exact, "structured": structured}


@query("lexical_enrich", f"+ {_ENRICH_SQL} SELECT query_id, id, lex, exact, structured, signal FROM ({top_sql('SELECT * FROM lexical', 20, 'signal DESC, updated_at DESC, id')})")
def lexical_enrich(s: Store) -> DataFrame:
    rows = features(s).select("id", "updated_at", "terms", "fragments", place("path", "kind").alias("place"))
    rows = best(rows, asked(s), enrichment, 20, ["updated_at"], ["lex", "exact", "structured"], ("updated_at",)).withColumnRenamed("score", "signal")
    return top(rows, 20, F.col("signal").desc(), F.col("updated_at").desc(), "id").select("query_id", "id", "lex", "exact", "structured", "signal")


_BROAD_SQL = "('" + "', '".join(BROAD) + "')"
_FALLBACK_SQL = f"""{SEARCHABLE_SQL}, told AS (SELECT query_id, list_filter(ts, lambda t: t NOT IN {_BROAD_SQL}) AS ts, list_filter(fragments, lambda f: f NOT IN {_BROAD_SQL}) AS fragments FROM qset),
hay AS (SELECT *, lower(path || chr(10) || coalesce(text, '')) AS haystack FROM searchable), held AS (SELECT h.*, q.query_id, q.fragments, {hits_sql('h.haystack')} / len(q.ts)::DOUBLE AS share FROM hay h, told q WHERE {hits_sql('h.haystack')} > 0),
boosts AS (SELECT query_id, id, updated_at, share, {EXACT_SQL.format('fragments')} AS exact, CASE WHEN starts_with(path, 'memory/smart-add/') THEN 0.18::DOUBLE ELSE 0 END + CASE WHEN starts_with(path, 'memory/episodes/') OR category = 'episodic' THEN 0.12::DOUBLE ELSE 0 END
    + CASE WHEN regexp_matches(lower(coalesce(text, '')), '{CHECKPOINT}') OR regexp_matches(path, '{CHECKPOINT_PATH}') THEN 0.08::DOUBLE ELSE 0 END AS boost FROM held)"""


@query("fts_fallback_rank", f"+ {_FALLBACK_SQL} {top_sql(f"SELECT query_id, id, {rounded_sql(f'1.6::DOUBLE * share + exact + boost + {recency_sql(0.08)}')} AS score FROM boosts", 20, 'score DESC, id')}")
def fts_fallback_rank(s: Store) -> DataFrame:
    """Rows whose path or text has a term of the query; broad words say nothing, as terms and as fragments."""
    boost = F.when(F.col("path").startswith("memory/smart-add/"), 0.18).otherwise(0.0) + F.when(F.col("path").startswith("memory/episodes/") | (F.coalesce("category", F.lit("")) == "episodic"), 0.12).otherwise(0.0)
    boost = boost + F.when(F.col("checkpoint"), 0.08).otherwise(0.0)

    def score(sheet: Sheet) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        hits = sheet.hits("place")
        total = 1.6 * share(hits, sheet.asked) + sheet.exact("place") + sheet.column("boost") + sheet.column("recency")
        return np.where(hits > 0, matching.rounded(total), -np.inf), {}

    rows = features(s).select("id", "terms", "fragments", place("path").alias("place"), boost.alias("boost"), recency(F.col("updated_at"), 0.08).alias("recency"))
    return top(best(rows, asked(s).without(BROAD), score, 20, [], []), 20, F.col("score").desc(), "id")
