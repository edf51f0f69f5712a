"""A sample of rows for review that is drawn in stages, each with a quota; what a stage leaves open the last one fills.

Each stage takes the first of what the stages before it have not taken. What is taken is no more than the sample, so that it
is a table of bounded size, and a stage is a top-k of an anti join with it; no order of all rows is made.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.registry import query
from palimpsest.functions.tables import saved
from palimpsest.operators.text import _RESCUE_SQL, RESCUE_AT, rescue_score
from palimpsest.sources.model import Store

# The shares of a sample, and the buckets in the order in which each gives a row.
SHARES = {"conflict": 0.25, "transient": 0.10, "buckets": 0.30}
BUCKETS = ["decision", "preference", "todo", "project", "transient", "keyword"]


def quota(limit: int, share: float, available: int) -> int:
    """The rows of a stage: its share of the sample, one at least, as many as there are at most."""
    return min(available, max(1, int(limit * share))) if limit > 0 and available > 0 and share > 0 else 0


def sampled(samples: DataFrame, limit: int = 20, *, shares: dict[str, float] = SHARES, buckets: Sequence[str] = BUCKETS) -> DataFrame:
    """sample_id, reason, place: up to `limit` of the rows, which have sample_id, bucket, boundary, risk, conflict, transient.

    1. rows with evidence for and against (conflict), nearest to the decision's boundary first; 2. transient ones, by risk;
    3. from each of `buckets` in turn the row nearest to the boundary; 4. the nearest of all others. Ties go by larger risk
    and then by id. A missing risk is 0, a missing boundary is last, missing flags are false; rows without an id are left out
    and rows that repeat one count as one, the nearest to the boundary.
    """
    best = F.min(F.struct(F.col("boundary").isNull().alias("none"), F.col("boundary").cast("double").alias("boundary"), (-F.coalesce("risk", F.lit(0)).cast("double")).alias("less"), "bucket", F.coalesce("conflict", F.lit(False)).alias("conflict"), F.coalesce("transient", F.lit(False)).alias("transient")))
    rows = samples.where("sample_id IS NOT NULL").groupBy("sample_id").agg(best.alias("b")).select("sample_id", "b.*")
    rows = saved(rows, "samples")
    counts = rows.agg(F.count_if("conflict").alias("conflict"), F.count_if("transient").alias("transient")).first()
    nearest = ["none", "boundary", "less", "sample_id"]
    taken = rows.limit(0).select("sample_id", F.lit("").alias("reason"), F.lit(0).alias("place"))
    size = 0

    def take(some: DataFrame, order: list[str], count: int, reason: str) -> None:
        nonlocal taken, size
        left = some.join(F.broadcast(taken.select("sample_id")), "sample_id", "left_anti")  # `limit` rows at most
        ids = [r.sample_id for r in left.orderBy(*order).select("sample_id").limit(max(0, count)).collect()]
        more = [(i, reason, size + n) for n, i in enumerate(ids, 1)]
        taken = taken.unionByName(rows.sparkSession.createDataFrame(more, taken.schema)) if more else taken
        size += len(more)

    take(rows.where("conflict"), nearest, quota(limit, shares["conflict"], counts.conflict), "conflict")
    take(rows.where("transient"), ["less", *nearest], min(quota(limit, shares["transient"], counts.transient), limit - size), "transient")
    number = F.array_position(F.array(*[F.lit(b) for b in buckets]), F.col("bucket"))
    left = rows.where(number > 0).join(F.broadcast(taken.select("sample_id")), "sample_id", "left_anti")
    firsts = left.groupBy("bucket").agg(F.min(F.struct(*nearest)).getField("sample_id").alias("sample_id")).withColumn("number", number)  # a row for each bucket
    take(firsts, ["number"], min(quota(limit, shares["buckets"], len(buckets)), limit - size), "bucket")
    take(rows, nearest, limit - size, "boundary")
    return taken


_FIRST = "boundary IS NULL, boundary, risk DESC, id"


def _stage_sql(name: str, some: str, order: str, count: str, before: list[str], reason: str) -> str:
    gone = " AND ".join(f"id NOT IN (SELECT id FROM {b})" for b in before) or "TRUE"
    return f"{name} AS (SELECT id, '{reason}' AS reason, row_number() OVER (ORDER BY {order}) AS n FROM {some} WHERE {gone} QUALIFY row_number() OVER (ORDER BY {order}) <= {count})"


LIMIT = 16
_TAKEN = lambda *names: " + ".join(f"(SELECT count(*) FROM {n})" for n in names)
SQL = f"""+ {_RESCUE_SQL}, x AS (
    SELECT b.id, abs(score - {RESCUE_AT})::DOUBLE AS boundary, hit_count AS risk, conflict_flag = 1 AS conflict, k.category = 'temporary' AS transient,
        CASE k.category WHEN 'preference' THEN 'preference' WHEN 'user_identity' THEN 'decision' WHEN 'episodic' THEN 'todo' WHEN 'kg_node' THEN 'project' WHEN 'temporary' THEN 'transient' ELSE 'other' END AS bucket
    FROM b JOIN conf k ON b.id = k.chunk_id),
{_stage_sql("s1", "(SELECT * FROM x WHERE conflict)", _FIRST, f"least((SELECT count(*) FROM x WHERE conflict), {int(LIMIT * SHARES['conflict'])})", [], "conflict")},
{_stage_sql("s2", "(SELECT * FROM x WHERE transient)", f"risk DESC, {_FIRST}", f"least((SELECT count(*) FROM x WHERE transient), {max(1, int(LIMIT * SHARES['transient']))})", ["s1"], "transient")},
f AS (SELECT id, list_position(['{"', '".join(BUCKETS)}'], bucket) AS number FROM x WHERE list_contains(['{"', '".join(BUCKETS)}'], bucket) AND id NOT IN (SELECT id FROM s1) AND id NOT IN (SELECT id FROM s2) QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY {_FIRST}) = 1),
{_stage_sql("s3", "f", "number", str(int(LIMIT * SHARES["buckets"])), [], "bucket")},
{_stage_sql("s4", "x", _FIRST, f"{LIMIT} - {_TAKEN('s1', 's2', 's3')}".replace(" + ", " - "), ["s1", "s2", "s3"], "boundary")}
SELECT id AS sample_id, reason, n::INT AS place FROM s1 UNION ALL SELECT id, reason, n + {_TAKEN('s1')} FROM s2 UNION ALL SELECT id, reason, n + {_TAKEN('s1', 's2')} FROM s3 UNION ALL SELECT id, reason, n + {_TAKEN('s1', 's2', 's3')} FROM s4"""


@query("review_sample", SQL)
def review_sample(s: Store) -> DataFrame:
    """Archived rows for review: near the boundary of the rescue score, with quotas for conflicting and transient ones and for buckets."""
    kinds = {"preference": "preference", "user_identity": "decision", "episodic": "todo", "kg_node": "project", "temporary": "transient"}
    bucket = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("category")), F.lit("other"))
    flags = s.confidence.select(F.col("chunk_id").alias("id"), F.col("hit_count").alias("risk"), (F.col("conflict_flag") == 1).alias("conflict"), (F.col("category") == "temporary").alias("transient"), bucket.alias("bucket"))
    rows = rescue_score(s).join(flags, "id").select(F.col("id").alias("sample_id"), "bucket", F.col("boundary_distance").alias("boundary"), "risk", "conflict", "transient")
    return sampled(rows, LIMIT)
