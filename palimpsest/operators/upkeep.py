"""Upkeep of the sidecar: penalties of conflicts, values that a user sets, what ids are stored as, and weekly warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.registry import query
from palimpsest.functions.scores import rounded, rounded_sql
from palimpsest.functions.tables import saved
from palimpsest.operators import quality
from palimpsest.sources.model import NOW, TAU, Store

# The confidence that a category starts with, and what a conflict takes off.
START = {"temporary": 0.4, "raw_log": 0.5, "episodic": 0.7, "preference": 0.7, "kg_node": 0.85, "user_identity": 0.95}
MISMATCH_PENALTY, NEAR_PENALTY, FLOOR = 0.5, 0.2, 0.01
# The ranges of weekly figures, each with what it says; the first that holds counts.
ENTROPY = [("< 0.2", "too_low"), ("> 0.8", "too_high"), ("< 0.4", "low"), ("> 0.6", "high")]
HHI = [("> 0.40", "monopoly"), ("> 0.20", "high"), ("< 0.05", "low")]
MISS = [("> 0.70", "too_strict"), ("> 0.40", "high"), ("< 0.05", "too_loose"), ("< 0.10", "low")]


def penalised(rows: DataFrame, mismatched: DataFrame, near: DataFrame) -> DataFrame:
    """chunk_id, confidence, conflict_flag of a sidecar after a night's penalties.

    mismatched (chunk_id) are rows whose settings differ, near (id_a, id_b) pairs of near duplicates; a pair with a row
    whose settings differ has no part. Each penalty is taken once and leaves a floor; repeated ids and pairs change nothing.
    """
    bad = mismatched.select("chunk_id").distinct()
    for side in ("id_a", "id_b"):
        near = near.join(bad.withColumnRenamed("chunk_id", side), side, "left_anti")
    close = near.select(F.explode(F.array("id_a", "id_b")).alias("chunk_id")).distinct()
    found = rows.join(bad.withColumn("bad", F.lit(True)), "chunk_id", "left").join(close.withColumn("close", F.lit(True)), "chunk_id", "left")
    after = F.when(F.col("bad"), F.greatest(F.lit(FLOOR), F.col("confidence") - MISMATCH_PENALTY)).when(F.col("close"), F.greatest(F.lit(FLOOR), F.col("confidence") - NEAR_PENALTY)).otherwise(F.col("confidence"))
    return found.select("chunk_id", rounded(after).alias("confidence"), F.when(F.coalesce("bad", "close", F.lit(False)), 1).otherwise(F.coalesce("conflict_flag", F.lit(0))).alias("conflict_flag"))


_BAD_SQL = f"""{quality._SETTINGS_SQL}, p AS (SELECT chunk_id, lower(key) AS key, regexp_replace(regexp_replace(value, '{quality.SETTING_SOURCE}', '', 'g'), '\\s+', '', 'g') AS value FROM (SELECT chunk_id, unnest(regexp_extract_all(text, '{quality.SETTING}', 1)) AS key, unnest(regexp_extract_all(text, '{quality.SETTING}', 2)) AS value FROM settings)),
bad AS (SELECT DISTINCT chunk_id FROM p WHERE key IN (SELECT key FROM p GROUP BY key HAVING count(DISTINCT value) > 1 AND count(DISTINCT chunk_id) > 1))"""
_NEAR_SQL = f"""tok AS (SELECT id, category, list_distinct(regexp_extract_all(lower(text), '{quality.TOKEN}')) AS t FROM chunks JOIN conf ON id = chunk_id), near AS (SELECT a.id AS id_a, b.id AS id_b FROM tok a JOIN tok b ON a.category = b.category AND a.id < b.id
    WHERE len(list_intersect(a.t, b.t)) > 0.6::DOUBLE * (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) AND a.id NOT IN (SELECT chunk_id FROM bad) AND b.id NOT IN (SELECT chunk_id FROM bad)), close AS (SELECT id_a AS chunk_id FROM near UNION SELECT id_b FROM near)"""


@query("conflict_penalties", f"""+ {_BAD_SQL}, {_NEAR_SQL} SELECT chunk_id, {rounded_sql(f'CASE WHEN b THEN greatest({FLOOR}::DOUBLE, confidence - {MISMATCH_PENALTY}::DOUBLE) WHEN n THEN greatest({FLOOR}::DOUBLE, confidence - {NEAR_PENALTY}::DOUBLE) ELSE confidence END')} AS confidence,
    CASE WHEN b OR n THEN 1 ELSE coalesce(conflict_flag, 0) END AS conflict_flag FROM (SELECT *, chunk_id IN (SELECT chunk_id FROM bad) AS b, chunk_id IN (SELECT chunk_id FROM close) AS n FROM conf)""")
def conflict_penalties(s: Store) -> DataFrame:
    """Only who has a near duplicate counts: of equal sets of words each member is paired with the first, of similar ones the first members."""
    bad = saved(quality.mismatched_chunks(quality.settings(s)), "mismatched")
    members, links = quality.similar_sets(quality.token_sets(s).join(bad.withColumnRenamed("chunk_id", "id"), "id", "left_anti"), 0.6)
    first = saved(members.groupBy("row").agg(F.min("id").alias("first")), "first-members")
    equal = members.join(first, "row").where("id <> first").select(F.col("first").alias("id_a"), F.col("id").alias("id_b"))
    side = lambda x: first.select(F.col("row").alias(x), F.col("first").alias(f"id_{x}"))
    return penalised(s.confidence, bad, equal.unionByName(links.join(side("a"), "a").join(side("b"), "b").where("id_a <> id_b").select("id_a", "id_b")))


def confidence_set(rows: DataFrame, asked: DataFrame, now: int) -> DataFrame:
    """chunk_id, confidence, last_confidence_update after a console set values: asked has chunk_id and value, which is held to 0..1.

    Of repeated requests the largest value counts; a null or infinite value changes nothing; a chunk without a row gets one.
    """
    value = F.when(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "value")))
    new = asked.withColumn("value", value).where("value IS NOT NULL").groupBy("chunk_id").agg(F.max("value").alias("value"))
    both = rows.join(new, "chunk_id", "full")
    return both.select("chunk_id", rounded(F.coalesce("value", "confidence")).alias("confidence"), F.when(F.col("value").isNotNull(), F.lit(now)).otherwise(F.col("last_confidence_update")).cast("long").alias("last_confidence_update"))


@query("confidence_set", f"""+ asked AS (SELECT id AS chunk_id, greatest(0, least(1, (doc_id % 15) / 10.0::DOUBLE - 0.2::DOUBLE)) AS value FROM chunks WHERE doc_id % 7 = 0)
SELECT coalesce(c.chunk_id, a.chunk_id) AS chunk_id, {rounded_sql('coalesce(value, confidence)')} AS confidence, CASE WHEN value IS NOT NULL THEN {NOW} ELSE last_confidence_update END AS last_confidence_update FROM conf c FULL JOIN asked a ON c.chunk_id = a.chunk_id""")
def confidence_set_by_console(s: Store) -> DataFrame:
    asked = s.chunks.where("doc_id % 7 = 0").select(F.col("id").alias("chunk_id"), (F.col("doc_id") % 15 / 10.0 - 0.2).alias("value"))
    return confidence_set(s.confidence, asked, NOW)


def updated(rows: DataFrame, asked: DataFrame, now: int) -> DataFrame:
    """prefix, status, and for one match the row's new chunk_id, category, confidence, base_tau, hit_count, is_protected.

    asked has prefix (all of one length), category, hit, protect. A known category sets confidence and tau anew, an unknown
    one changes nothing; null fields stay. No match and several matches change no row.
    """
    asked = asked.withColumnRenamed("category", "wanted").withColumn("size", F.length("prefix"))
    sizes = [r["size"] for r in asked.select("size").where("size > 0").distinct().limit(65).collect()]  # prefixes of a 64-digit id have 64 lengths at most
    keyed = rows.withColumn("prefix", F.explode(F.array(*[F.substring("chunk_id", 1, n) for n in sizes]) if sizes else F.array().cast("array<string>")))
    matches = keyed.join(asked.select("prefix").distinct(), "prefix", "left_semi").groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct(*rows.columns), "chunk_id").alias("row"))
    found, one = asked.join(matches, "prefix", "left"), F.col("n") == 1
    status = F.when(one, "updated").when(F.col("n") > 1, "multiple_matches").otherwise("no_match")
    set_to = lambda table, old: F.when(one, F.coalesce(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])[F.col("wanted")], F.col(old)))
    return found.select(
        "prefix", status.alias("status"), F.when(one, F.col("row.chunk_id")).alias("chunk_id"), set_to({k: k for k in START}, "row.category").alias("category"), rounded(set_to(START, "row.confidence")).alias("confidence"), set_to(TAU, "row.base_tau").alias("base_tau"),
        F.when(one, F.col("row.hit_count") + F.coalesce(F.col("hit").cast("int"), F.lit(0))).alias("hit_count"), F.when(one, F.coalesce(F.col("protect").cast("int"), "row.is_protected")).alias("is_protected"), F.when(one, F.lit(now)).alias("last_confidence_update"),
    )


_BY_CATEGORY = lambda table: "CASE wanted " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in table.items()) + " END"


@query("memory_update", f"""+ asked AS (SELECT DISTINCT substr(memory_id, 1, CASE WHEN id % 3 = 0 THEN 2 ELSE 16 END) AS prefix FROM ev), req AS (SELECT prefix, CASE WHEN prefix < '4' THEN 'kg_node' WHEN prefix < '8' THEN 'other' END AS wanted, prefix > '5' AS hit, CASE WHEN prefix > 'a' THEN true END AS protect FROM asked),
m AS (SELECT r.*, count(c.chunk_id) OVER (PARTITION BY prefix) AS n, c.* FROM req r LEFT JOIN conf c ON starts_with(c.chunk_id, prefix))
SELECT DISTINCT prefix, CASE WHEN n = 1 THEN 'updated' WHEN n > 1 THEN 'multiple_matches' ELSE 'no_match' END AS status, CASE WHEN n = 1 THEN chunk_id END AS chunk_id, CASE WHEN n = 1 THEN CASE WHEN wanted IN ({', '.join(f"'{k}'" for k in START)}) THEN wanted ELSE category END END AS category,
    {rounded_sql(f'CASE WHEN n = 1 THEN coalesce({_BY_CATEGORY(START)}, confidence) END')} AS confidence, CASE WHEN n = 1 THEN coalesce({_BY_CATEGORY(TAU)}, base_tau) END AS base_tau, CASE WHEN n = 1 THEN hit_count + hit::INT END AS hit_count,
    CASE WHEN n = 1 THEN coalesce(protect::INT, is_protected) END AS is_protected, CASE WHEN n = 1 THEN {NOW} END AS last_confidence_update FROM m""")
def memory_update(s: Store) -> DataFrame:
    prefix = F.col("prefix")
    asked = s.events.select(F.when(F.col("id") % 3 == 0, F.substring("memory_id", 1, 2)).otherwise(F.substring("memory_id", 1, 16)).alias("prefix")).distinct()
    asked = asked.select("prefix", F.when(prefix < "4", "kg_node").when(prefix < "8", "other").alias("category"), (prefix > "5").alias("hit"), F.when(prefix > "a", True).alias("protect"))
    return updated(s.confidence, asked, NOW)


def storage_class(value: Column) -> Column:
    """What a value kept as text would be stored as: null, integer, real or text."""
    return F.when(value.isNull(), "null").when(value.rlike(r"^[+-]?[0-9]{1,18}$"), "integer").when(value.rlike(r"^[+-]?([0-9]+[.][0-9]*|[.][0-9]+|[0-9]+)([eE][+-]?[0-9]+)?$"), "real").otherwise("text")


_CLASS_SQL = "CASE WHEN v IS NULL THEN 'null' WHEN regexp_matches(v, '^[+-]?[0-9]{1,18}$') THEN 'integer' WHEN regexp_matches(v, '^[+-]?([0-9]+[.][0-9]*|[.][0-9]+|[0-9]+)([eE][+-]?[0-9]+)?$') THEN 'real' ELSE 'text' END"


@query("storage_classes", f"SELECT field, {_CLASS_SQL} AS class, count(*) AS n FROM (SELECT 'session_id' AS field, session_id AS v FROM ev UNION ALL SELECT 'trace_id', trace_id FROM ev UNION ALL SELECT 'rank', rank::VARCHAR FROM ev UNION ALL SELECT 'memory_id', memory_id FROM ev) GROUP BY 1, 2")
def storage_classes(s: Store, fields: tuple[str, ...] = ("session_id", "trace_id", "rank", "memory_id")) -> DataFrame:
    """How many values of each field are of each class."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields])
    return s.events.select(F.explode(pairs).alias("p")).groupBy(F.col("p.field").alias("field"), storage_class(F.col("p.v")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def warning(name: str, ranges: list[tuple[str, str]]) -> Column:
    return F.expr("CASE " + " ".join(f"WHEN {name} {test} THEN '{says}'" for test, says in ranges) + f" WHEN {name} IS NULL THEN NULL ELSE 'ok' END").alias(f"{name}_flag")


def _warning_sql(name: str, ranges: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {name} {test} THEN '{says}'" for test, says in ranges) + f" WHEN {name} IS NULL THEN NULL ELSE 'ok' END AS {name}_flag"


@query("weekly_flags", f"""+ k AS (SELECT date_trunc('week', created_at)::DATE AS week, category, count(*)::DOUBLE AS n FROM ev WHERE event_type = 'memory_candidate_retrieved' GROUP BY 1, 2), e AS (SELECT week, CASE WHEN count(*) > 1 THEN {rounded_sql('(ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(count(*))')} ELSE 1 END AS entropy FROM k GROUP BY week),
m AS (SELECT date_trunc('week', created_at)::DATE AS week, memory_id, count(*)::DOUBLE AS n FROM ev WHERE event_type = 'memory_injected' GROUP BY 1, 2), h AS (SELECT week, {rounded_sql('sum(n * n) / (sum(n) * sum(n))')} AS hhi FROM m GROUP BY week),
r AS (SELECT date_trunc('week', created_at)::DATE AS week, {rounded_sql('count(*) FILTER (WHERE injected_count = 0) / count(*)::DOUBLE')} AS miss FROM ev WHERE event_type = 'recall_completed' GROUP BY 1)
SELECT week, entropy, hhi, miss, {_warning_sql('entropy', ENTROPY)}, {_warning_sql('hhi', HHI)}, {_warning_sql('miss', MISS)} FROM e FULL JOIN h USING (week) FULL JOIN r USING (week)""")
def weekly_flags(s: Store) -> DataFrame:
    """A week's entropy of categories retrieved (1 with one category), concentration of what was injected, and share of recalls that injected nothing, each with a warning. A week without such events has nulls."""
    ev, week = s.events.withColumn("week", F.date_trunc("week", "created_at").cast("date")), ["week"]
    of = lambda kind: F.col("event_type") == kind
    n, sums = F.col("n"), F.sum("n")
    kinds = ev.where(of("memory_candidate_retrieved")).groupBy("week", "category").agg(F.count(F.lit(1)).cast("double").alias("n")).groupBy("week")
    entropy = kinds.agg(F.when(F.count(F.lit(1)) > 1, rounded((F.log(sums) - F.sum(n * F.log(n)) / sums) / F.log(F.count(F.lit(1))))).otherwise(1.0).alias("entropy"))
    hhi = ev.where(of("memory_injected")).groupBy("week", "memory_id").agg(F.count(F.lit(1)).cast("double").alias("n")).groupBy("week").agg(rounded(F.sum(n * n) / (sums * sums)).alias("hhi"))
    miss = ev.where(of("recall_completed")).groupBy("week").agg(rounded(F.count_if(F.col("injected_count") == 0) / F.count(F.lit(1))).alias("miss"))
    rows = entropy.join(hhi, week, "full").join(miss, week, "full")
    return rows.select("week", "entropy", "hhi", "miss", warning("entropy", ENTROPY), warning("hhi", HHI), warning("miss", MISS))
