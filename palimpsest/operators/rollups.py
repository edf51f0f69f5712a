"""Figures of the event log on several levels at once, and over windows that slide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.registry import query
from palimpsest.functions.scores import rounded, rounded_sql
from palimpsest.sources.model import Store

LEVELS = {0: "category and source", 1: "category", 2: "source", 3: "all"}


def by_levels(events: DataFrame) -> DataFrame:
    """level, category, source, events, sessions, mean_latency: by both, by each, and in all, from one pass over the rows.

    A null on a level that is grouped by its column is a group of rows that have none; level tells it from a sum over all.
    """
    level = F.grouping_id("category", "source")
    names = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])
    summed = events.cube("category", "source").agg(level.cast("int").alias("id"), F.count(F.lit(1)).alias("events"), F.countDistinct(F.nullif("session_id", F.lit(""))).alias("sessions"), rounded(F.avg("latency_ms")).alias("mean_latency"))
    return summed.select(F.element_at(names, F.col("id")).alias("level"), "category", "source", "events", "sessions", "mean_latency")


def by_time(events: DataFrame) -> DataFrame:
    """day, event_type, events: each day's kinds, each day, and all, by a rollup; null stands for what is summed over."""
    return events.withColumn("day", F.to_date("created_at")).rollup("day", "event_type").agg(F.count(F.lit(1)).alias("events"))


def sliding(events: DataFrame, length: str = "7 days", step: str = "1 day") -> DataFrame:
    """starts, ends (dates), event_type, events, memories: windows that begin at each step and overlap.

    An event lies in length / step windows, and each is counted before anything moves; a window with no event has no row.
    """
    counted = events.groupBy(F.window("created_at", length, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("memory_id").alias("memories"))
    return counted.select(F.to_date("w.start").alias("starts"), F.to_date("w.end").alias("ends"), "event_type", "events", "memories")


@query("event_levels", f"""SELECT CASE grouping(category, source) WHEN 0 THEN 'category and source' WHEN 1 THEN 'category' WHEN 2 THEN 'source' ELSE 'all' END AS level, category, source, count(*) AS events,
    count(DISTINCT nullif(session_id, '')) AS sessions, {rounded_sql('avg(latency_ms)')} AS mean_latency FROM ev GROUP BY CUBE (category, source)""")
def event_levels(s: Store) -> DataFrame:
    return by_levels(s.events)


@query("event_rollup", "SELECT created_at::DATE AS day, event_type, count(*) AS events FROM ev GROUP BY ROLLUP (created_at::DATE, event_type)")
def event_rollup(s: Store) -> DataFrame:
    return by_time(s.events)


@query("event_weeks", """+ starts AS (SELECT unnest(range(min(created_at)::DATE - 6, max(created_at)::DATE + 1, INTERVAL 1 DAY))::DATE AS starts FROM ev)
SELECT starts, starts + 7 AS ends, event_type, count(*) AS events, count(DISTINCT memory_id) AS memories FROM starts JOIN ev ON created_at >= starts AND created_at < starts + 7 GROUP BY ALL""")
def event_weeks(s: Store) -> DataFrame:
    """Kinds of events over seven days, for each day that such a week may begin."""
    return sliding(s.events)
