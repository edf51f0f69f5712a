"""Which cited memories may be reinforced: those that the same turn was given or fetched, by a join of two streams.

Citations and allowances are streams of their own. An allowance (an injected memory that may be reinforced, or one that the
turn fetched) holds for citations of the same session and trace that come at its time or up to `within` after it. Both sides
have watermarks, so that state is bounded by the rows of `within` and the delay, and rows that come later are dropped; a cited
id comes out as reinforced when its allowance is there, and as ignored once the watermark says that none can come any more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.registry import query
from palimpsest.sources.model import Store
from palimpsest.streaming.turns import run, stream

REASON = "not_in_reinforcement_allowed_ids"


def short_ids(ids: Column) -> Column:
    """The first 16 characters of each id, without blanks at the ends; empty ones and repetitions are left out."""
    short = F.transform(F.coalesce(ids, F.array().cast("array<string>")), lambda x: F.trim(F.substring(x, 1, 16)))
    return F.array_distinct(F.filter(short, lambda x: x.isNotNull() & (x != "")))


def cited(citations: DataFrame, allowances: DataFrame, *, within: str = "10 minutes", delay: str = "1 minute") -> DataFrame:
    """citation, at, session_id, trace_id, place, memory_id, allowed: a row for each cited id, whether it may be reinforced.

    citations: citation (its number), at, session_id, trace_id, memory_ids; allowances: at, session_id, trace_id, memory_ids.
    place is the order among the distinct ids of the citation. A row without a session or a trace is met by those without.
    Of several allowances of a memory in one turn within the delay the first counts.
    """
    keyed = lambda df: df.where("at IS NOT NULL").withColumns({"session_id": F.coalesce("session_id", F.lit("")), "trace_id": F.coalesce("trace_id", F.lit(""))}).withWatermark("at", delay)
    asks = keyed(citations).select("citation", "at", "session_id", "trace_id", F.posexplode(short_ids(F.col("memory_ids"))).alias("place", "memory_id"))
    given = keyed(allowances).select(F.col("at").alias("given_at"), F.col("session_id").alias("of_session"), F.col("trace_id").alias("of_trace"), F.explode(short_ids(F.col("memory_ids"))).alias("of_memory"))
    same = (F.col("session_id") == F.col("of_session")) & (F.col("trace_id") == F.col("of_trace")) & (F.col("memory_id") == F.col("of_memory"))
    in_time = (F.col("given_at") <= F.col("at")) & (F.col("at") <= F.col("given_at") + F.expr(f"INTERVAL {within}"))
    return asks.join(given, same & in_time, "left").select("citation", "at", "session_id", "trace_id", "place", "memory_id", F.col("given_at").isNotNull().alias("allowed"))


def by_citation(rows: DataFrame) -> DataFrame:
    """citation, reinforced_ids, ignored_ids, in the order cited: from the rows of `cited` once the stream has written them."""
    each = rows.groupBy("citation", "place", "memory_id").agg(F.max("allowed").alias("allowed"))
    ordered = lambda keep: F.sort_array(F.collect_list(F.when(keep, F.struct("place", "memory_id")))).getField("memory_id")
    return each.groupBy("citation").agg(ordered(F.col("allowed")).alias("reinforced_ids"), ordered(~F.col("allowed")).alias("ignored_ids"))


def _memory(*back: int) -> Column:
    return F.array(*[F.sha2(((F.col("event_id") - k) % 2000).cast("string"), 256) for k in back])


def _turn(events: DataFrame, *kinds: str) -> DataFrame:
    """Events of some kinds; users in threes share a session here, and a day is a trace, so that turns hold several events."""
    return events.where(F.col("event_type").isin(*kinds)).select("event_id", F.col("ts").alias("at"), (F.col("user_id") % 3).cast("string").alias("session_id"), F.date_format("ts", "yyyyMMdd").alias("trace_id"))


def citations(events: DataFrame) -> DataFrame:
    """Purchases cite the memories of the events before them, some twice."""
    return _turn(events, "purchase").withColumns({"citation": F.col("event_id"), "memory_ids": _memory(3, 1, 2, 1, 4, 0)})


def allowances(events: DataFrame) -> DataFrame:
    """Clicks inject their memory, and views fetch theirs."""
    return _turn(events, "click", "view").withColumn("memory_ids", _memory(0))


SQL = """+ turn AS (SELECT event_id, event_type, epoch_us(ts) AS us, user_id % 3 AS session_id, strftime(ts, '%Y%m%d') AS trace_id, substr(sha256((event_id % 2000)::VARCHAR), 1, 16) AS own FROM events),
asks AS (SELECT event_id AS citation, us, session_id, trace_id, unnest([3, 1, 2, 4, 0]) AS back, generate_subscripts([3, 1, 2, 4, 0], 1) AS place FROM turn WHERE event_type = 'purchase'),
ids AS (SELECT * EXCLUDE (back), substr(sha256(((citation - back) % 2000)::VARCHAR), 1, 16) AS memory_id FROM asks),
marked AS (SELECT i.*, EXISTS (SELECT 1 FROM turn t WHERE t.event_type IN ('click', 'view') AND t.session_id = i.session_id AND t.trace_id = i.trace_id AND t.own = i.memory_id AND t.us <= i.us AND i.us <= t.us + 14400000000) AS allowed FROM ids i),
w AS (SELECT least(max(us) FILTER (WHERE event_type = 'purchase'), max(us) FILTER (WHERE event_type IN ('click', 'view'))) // 1000 * 1000 - 3600000000 AS mark FROM turn)
SELECT citation, coalesce(array_to_string(list(memory_id ORDER BY place) FILTER (WHERE allowed), ','), '') AS reinforced_ids, coalesce(array_to_string(list(memory_id ORDER BY place) FILTER (WHERE NOT allowed), ','), '') AS ignored_ids
FROM marked, w WHERE us < mark GROUP BY citation"""


@query("stream_reinforcement", SQL)
def stream_reinforcement(s: Store) -> DataFrame:
    """Citations of the event log that the last watermark has passed, an hour behind the newest event of both streams."""
    rows = run(lambda t: cited(citations(stream(t)), allowances(stream(t)), within="4 hours", delay="1 hour"), "append", s)
    # The join may answer citations that the watermark has not passed; those are still open.
    last = [df.agg(F.max(F.unix_millis(F.col("ts").cast("timestamp"))).alias("ms")) for df in (s.table("events").where("event_type = 'purchase'"), s.table("events").where("event_type IN ('click', 'view')"))]
    mark = last[0].unionByName(last[1]).agg((F.min("ms") - 3_600_000).alias("mark"))
    passed = rows.join(F.broadcast(mark), F.unix_micros("at") < 1000 * F.col("mark"))  # one row
    return by_citation(passed).select("citation", *[F.array_join(c, ",").alias(c) for c in ("reinforced_ids", "ignored_ids")])
