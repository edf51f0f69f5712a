"""State of turns that expires: what a run of the assistant fetched and was given, kept while it is touched in time.

`turns` is a transformWithState operator over a stream of operations. Operations of a run wait in a list until the watermark
has passed them, so that they act in the order of their times whatever batches they came in, and one timer, for the first of
them, acts on all that are due; the turn itself is a value, and its expiry a timer that each touch puts off. A row comes out when a turn is finalized or has expired.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from palimpsest.functions.registry import query
from palimpsest.sources.model import Store
from palimpsest.streaming.turns import run, stream

#: A turn lives this long after it was last touched (fixed value); the delay is how late operations may come.
TTL_MS = 60_000


def _fields(text: str = "", lists: str = "", longs: str = "") -> list[T.StructField]:
    """Fields by name: workers have no session that would parse a schema."""
    kinds = ((text, T.StringType()), (lists, T.ArrayType(T.StringType())), (longs, T.LongType()))
    return [T.StructField(name, kind) for names, kind in kinds for name in names.split()]


OPERATION = T.StructType(_fields("kind session_id trace_id", "memory_ids allowed_ids", "ms seq"))
TURN = T.StructType(_fields("session_id trace_id", "get_ids injected_ids allowed_ids", "created_ms touched_ms"))
ENDED = T.StructType([*_fields("run_id"), *TURN.fields, *_fields("ended")])


def short_ids(values) -> list[str]:
    """The first 16 characters of each id, without blanks at the ends; empty ones and repetitions are left out."""
    return list(dict.fromkeys(s for v in values or () if (s := (v or "")[:16].strip())))


class Turns(StatefulProcessor):
    """One run's state. Kinds of operations: open, recall, get, touch, finalize.

    open and recall begin a turn, or touch it, and say its session and trace; recall says what was injected and what may be
    reinforced, get adds a fetched id, touch only looks. The last three act on a turn that is there, and do nothing
    otherwise. A turn is there until `ttl_ms` after it was last touched.
    """

    def __init__(self, ttl_ms: int = TTL_MS):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turn = handle.getValueState("turn", TURN)
        self.waiting = handle.getListState("waiting", OPERATION)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        came = [(r.kind, r.session_id, r.trace_id, r.memory_ids, r.allowed_ids, r.ms, r.seq) for r in rows]
        self.waiting.appendList(came)
        # The first of those that wait has a timer; when it is due, what is left then gets the next.
        self.handle.registerTimer(min(r[5] for r in came))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        state = list(self.turn.get()) if self.turn.exists() else None
        waiting = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[5], r[6]))
        due = [r for r in waiting if r[5] <= now]
        before = state and state[6]
        for kind, session, trace, memory_ids, allowed_ids, ms, _ in due:
            if state and ms >= state[6] + self.ttl_ms:
                yield self.ended(key, state, "expired")
                state = None
            if kind in ("open", "recall"):
                state = state or [None, None, [], [], [], ms, ms]
                state[0], state[1], state[6] = session or None, trace or None, ms
                if kind == "recall":
                    state[3], state[4] = short_ids(memory_ids), short_ids(allowed_ids)
            elif state and kind == "finalize":
                yield self.ended(key, state, "finalized")
                state = None
            elif state:
                state[6] = ms
                if kind == "get":
                    state[2] = short_ids([*state[2], *(memory_ids or ())])
        if state and now >= state[6] + self.ttl_ms:
            yield self.ended(key, state, "expired")
            state = None
        if due:
            left = [r for r in waiting if r[5] > now]
            self.waiting.put(left) if left else self.waiting.clear()
            if left:
                self.handle.registerTimer(left[0][5])
        if state:
            self.turn.update(tuple(state))
            if state[6] != before:
                self.handle.registerTimer(state[6] + self.ttl_ms)
        elif self.turn.exists():
            self.turn.clear()

    @staticmethod
    def ended(key, state: list, how: str) -> Row:
        return Row(run_id=key[0], session_id=state[0], trace_id=state[1], get_ids=state[2], injected_ids=state[3], allowed_ids=state[4], created_ms=state[5], touched_ms=state[6], ended=how)

    def close(self) -> None:
        pass


def turns(operations: DataFrame, ttl_ms: int = TTL_MS, delay: str = "1 minute") -> DataFrame:
    """Turns that have ended: run_id, session_id, trace_id, get_ids, injected_ids, allowed_ids, created_ms, touched_ms, ended.

    operations: run_id, at (time), seq (order within a time), kind, session_id, trace_id, memory_ids, allowed_ids. Rows without
    a run or a time are left out; rows that come later than `delay` behind the newest may be dropped, as watermarks do.
    """
    rows = operations.where("trim(run_id) <> '' AND at IS NOT NULL").withColumns({"run_id": F.trim("run_id"), "ms": F.unix_millis("at")}).withWatermark("at", delay)
    return rows.groupBy("run_id").transformWithState(Turns(ttl_ms), ENDED, "append", "EventTime")


def ended_turns(operations: DataFrame, ttl_ms: int = TTL_MS) -> DataFrame:
    """The same turns from a table of operations: turns end where a gap of `ttl_ms` comes, or a finalize; none is left open."""
    from pyspark.sql import Window as W

    order = W.partitionBy("run_id").orderBy("ms", "seq")
    rows = operations.where("trim(run_id) <> '' AND at IS NOT NULL").withColumns({"run_id": F.trim("run_id"), "ms": F.unix_millis("at")})
    new = (F.col("ms") - F.lag("ms").over(order) >= ttl_ms) | (F.lag("kind").over(order) == "finalize")
    rows = rows.withColumn("new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("life", F.sum("new").over(order))
    begins = F.col("kind").isin("open", "recall")
    rows = rows.withColumn("begun", F.max(begins.cast("int")).over(W.partitionBy("run_id", "life").orderBy("ms", "seq"))).where("begun = 1")
    place, short = F.struct("ms", "seq"), lambda c: F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(F.substring(x, 1, 16))), lambda x: x != ""))
    last = lambda c, when: F.max_by(F.struct(c), F.when(when, place))
    recall = F.col("kind") == "recall"
    lives = rows.groupBy("run_id", "life").agg(
        last(F.nullif("session_id", F.lit("")).alias("v"), begins).alias("session"), last(F.nullif("trace_id", F.lit("")).alias("v"), begins).alias("trace"),
        F.sort_array(F.collect_list(F.when(F.col("kind") == "get", F.struct("ms", "seq", "memory_ids")))).alias("gets"), last(F.col("memory_ids").alias("v"), recall).alias("injected"), last(F.col("allowed_ids").alias("v"), recall).alias("allowed"),
        F.min("ms").alias("created_ms"), F.max(F.when(F.col("kind") != "finalize", F.col("ms"))).alias("touched_ms"), F.max(F.when(F.col("kind") == "finalize", F.col("ms"))).alias("finalized_ms"),
    )
    return lives.select(
        "run_id", F.col("session.v").alias("session_id"), F.col("trace.v").alias("trace_id"), short(F.flatten("gets.memory_ids")).alias("get_ids"), short(F.col("injected.v")).alias("injected_ids"),
        short(F.col("allowed.v")).alias("allowed_ids"), "created_ms", "touched_ms", F.when(F.col("finalized_ms").isNotNull(), "finalized").otherwise("expired").alias("ended"),
        F.coalesce("finalized_ms", F.col("touched_ms") + ttl_ms).alias("ended_ms"),
    )


#: In the event log a run is a user; kinds of events stand for operations.
KINDS = {"signup": "open", "click": "recall", "view": "get", "purchase": "touch", "error": "finalize"}
HOURS = 6


def operations(events: DataFrame) -> DataFrame:
    """The event log as operations."""
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    ids = lambda *n: F.array(*[F.sha2(((F.col("event_id") + k) % 2000).cast("string"), 256) for k in n])
    return events.select(
        F.col("user_id").cast("string").alias("run_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.element_at(kind, F.col("event_type")).alias("kind"), F.concat(F.lit("s"), (F.col("user_id") % 7).cast("string")).alias("session_id"),
        F.when(F.col("event_id") % 23 != 0, F.date_format("ts", "yyyyMMddHH")).alias("trace_id"), ids(0, 1, 0).alias("memory_ids"), F.when(F.col("event_id") % 2 == 0, ids(1)).alias("allowed_ids"),
    )


SQL = f"""+ ops AS (SELECT user_id::VARCHAR AS run_id, epoch_us(ts) // 1000 AS ms, event_id AS seq, CASE event_type WHEN 'signup' THEN 'open' WHEN 'click' THEN 'recall' WHEN 'view' THEN 'get' WHEN 'purchase' THEN 'touch' ELSE 'finalize' END AS kind,
    's' || (user_id % 7) AS session_id, CASE WHEN event_id % 23 <> 0 THEN strftime(ts, '%Y%m%d%H') END AS trace_id, substr(sha256((event_id % 2000)::VARCHAR), 1, 16) AS one, substr(sha256(((event_id + 1) % 2000)::VARCHAR), 1, 16) AS two FROM events),
marked AS (SELECT *, CASE WHEN ms - lag(ms) OVER o < {HOURS * 3600000} AND lag(kind) OVER o <> 'finalize' THEN 0 ELSE 1 END AS new FROM ops WINDOW o AS (PARTITION BY run_id ORDER BY ms, seq)),
lives AS (SELECT *, sum(new) OVER (PARTITION BY run_id ORDER BY ms, seq) AS life FROM marked),
begun AS (SELECT *, max((kind IN ('open', 'recall'))::INT) OVER (PARTITION BY run_id, life ORDER BY ms, seq) AS begun FROM lives),
l AS (SELECT run_id, list({{'k': kind, 's': session_id, 't': trace_id, 'a': one, 'b': two, 'e': seq, 'ms': ms}} ORDER BY ms, seq) AS ops FROM begun WHERE begun = 1 GROUP BY run_id, life),
x AS (SELECT run_id, list_filter(ops, lambda o: o.k IN ('open', 'recall'))[-1] AS said, list_filter(ops, lambda o: o.k = 'recall')[-1] AS recall, flatten([[o.a, o.b] FOR o IN ops IF o.k = 'get']) AS gets,
    ops[1].ms AS created_ms, list_filter(ops, lambda o: o.k <> 'finalize')[-1].ms AS touched_ms, CASE WHEN ops[-1].k = 'finalize' THEN ops[-1].ms END AS finalized_ms FROM l),
w AS (SELECT max(ms) - 3600000 AS mark FROM ops)
SELECT run_id, said.s AS session_id, said.t AS trace_id, array_to_string(list_filter(gets, lambda g, i: list_position(gets, g) = i), ',') AS get_ids, CASE WHEN recall IS NULL THEN '' ELSE recall.a || ',' || recall.b END AS injected_ids,
    CASE WHEN recall.e % 2 = 0 THEN recall.b ELSE '' END AS allowed_ids, created_ms, touched_ms, CASE WHEN finalized_ms IS NULL THEN 'expired' ELSE 'finalized' END AS ended
FROM x, w WHERE coalesce(finalized_ms, touched_ms + {HOURS * 3600000}) <= mark"""


@query("stream_turn_state", SQL)
def stream_turn_state(s: Store) -> DataFrame:
    """Turns of the event log that have ended by the last watermark, an hour behind the newest event."""
    ended = run(lambda t: turns(operations(stream(t)), HOURS * 3_600_000, "1 hour"), "append", s, STATE)
    return ended.select("run_id", "session_id", "trace_id", *[F.array_join(c, ",").alias(c) for c in ("get_ids", "injected_ids", "allowed_ids")], "created_ms", "touched_ms", "ended")


#: transformWithState keeps its state in RocksDB.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
