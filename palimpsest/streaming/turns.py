"""Structured Streaming over the event log: daily counts, session windows, and turn state that expires."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.registry import query
from palimpsest.functions.tables import shared_folder
from palimpsest.sources.model import Store

SCHEMA = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def stream(s: Store) -> DataFrame:
    """The event log as a stream of files."""
    return s.spark.readStream.schema(SCHEMA).option("pathGlobFilter", "*.parquet").parquet(f"{s.folder}/events*")


def daily_counts(events: DataFrame) -> DataFrame:
    return events.withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.to_date("window.start").alias("day"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    return events.withWatermark("ts", "1 day").groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.unix_timestamp("session_window.start").alias("starts"), "n")


def first_in_turn(events: DataFrame, ttl: str = "1 hour") -> DataFrame:
    """The first event of each kind that a user's turn brings; a turn's state goes when its time is over."""
    return events.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["user_id", "event_type"])


def finished(df: DataFrame, mode: str, folder: str) -> None:
    """Runs a stream over all that is there now, to the end, and writes its rows to folder/table. A batch that runs again
    writes the same files again; a later call with the same folder goes on where this one ended."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table" if mode == "complete" else f"{folder}/table/batch={number}")

    df.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def run(make: Callable[[Store], DataFrame], mode: str, s: Store, settings: dict | None = None) -> DataFrame:
    """The rows of a stream over the store, as a Parquet table. Settings hold for the stream's own session alone."""
    folder, session = f"{shared_folder(s.spark)}/stream-{uuid.uuid4().hex}", s.spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        session.conf.set(key, s.spark.conf.get(key))
    for key, value in (settings or {}).items():
        session.conf.set(key, value)
    df = make(Store(session, s.folder))
    finished(df, mode, folder)
    return s.spark.read.schema(df.schema).parquet(f"{folder}/table").select(*df.columns)


@query("stream_daily_counts", "SELECT created_at::DATE AS day, CASE event_type WHEN 'memory_candidate_retrieved' THEN 'view' WHEN 'memory_injected' THEN 'click' WHEN 'memory_cited' THEN 'purchase' WHEN 'recall_started' THEN 'signup' ELSE 'error' END AS event_type, count(*) AS n FROM ev GROUP BY 1, 2")
def stream_daily_counts(s: Store) -> DataFrame:
    return run(lambda t: daily_counts(stream(t)), "complete", s)


@query("stream_sessions", "+ g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, floor(epoch(min(ts)))::BIGINT AS starts, count(*) AS n FROM k GROUP BY user_id, session")
def stream_sessions(s: Store) -> DataFrame:
    return run(lambda t: sessions(stream(t)), "complete", s)


@query("stream_first_in_turn", "SELECT DISTINCT user_id, event_type FROM events")
def stream_first_in_turn(s: Store) -> DataFrame:
    """What a user's turn brings first; all that is there is one batch, so that no turn's time is over within it."""
    return run(lambda t: first_in_turn(stream(t)), "append", s).select("user_id", "event_type")
