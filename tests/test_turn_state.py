"""Turns in a stream of several batches against the same turns from a table: touched in time, expired, finalized, late, out of order."""

import datetime
import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from palimpsest.streaming.turn_state import STATE, Turns, ended_turns, short_ids, turns
from palimpsest.streaming.turns import finished

OPS = "run_id string, at timestamp, seq bigint, kind string, session_id string, trace_id string, memory_ids array<string>, allowed_ids array<string>"
START = datetime.datetime(2024, 1, 1)


def op(run, seconds, kind, seq=0, ids=(), allowed=(), session="s", trace="t"):
    return (run, START + datetime.timedelta(seconds=seconds), seq, kind, session, trace, list(ids), list(allowed))


def streamed(spark, tmp_path, batches, ttl_ms=60_000, delay="10 seconds"):
    """The rows after all batches, each a file of its own and read as one."""
    session = spark.newSession()
    for key, value in {**STATE, "spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": "2"}.items():
        session.conf.set(key, value)
    out = f"file://{tmp_path}/out"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, OPS).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/{k}")
        source = session.readStream.schema(spark.createDataFrame([], OPS).schema).parquet(f"file://{tmp_path}/in/*")
        # A call for each batch: the state goes on from the checkpoint.
        df = turns(source, ttl_ms, delay)
        finished(df, "append", out)
    return {tuple(map(str, r)) for r in spark.read.schema(df.schema).parquet(f"{out}/table").select(*df.columns).collect()}


def test_a_turn_expires_and_another_is_touched_in_time(spark, tmp_path):
    batches = [
        [op("A", 0, "open"), op("B", 0, "open"), op("B", 1, "get", ids=["A1234567890abcdef", " b "]), op("C", 5, "get", ids=["x"])],
        [op("A", 50, "touch"), op("A", 55, "get", ids=["one", "two", "one"]), op("B", 40, "get", ids=["late within the delay"])],
        [op("A", 108, "recall", ids=["inj1234567890abcdef", "inj1234567890abcdef"], allowed=["allow1234567890abcd"], trace=""), op("A", 110, "finalize"), op("B", 130, "get", ids=["gone"])],
        [op("B", 150, "open", trace="t2"), op("Z", 400, "open")],
    ]
    got = streamed(spark, tmp_path, batches)
    ms = int(START.replace(tzinfo=datetime.UTC).timestamp() * 1000)
    row = lambda run, trace, gets, injected, allowed, created, touched, ended: tuple(map(str, (run, "s", trace, gets, injected, allowed, ms + created * 1000, ms + touched * 1000, ended)))
    assert got == {
        row("A", None, ["one", "two"], ["inj1234567890abc"], ["allow1234567890a"], 0, 108, "finalized"),
        row("B", "t", ["A1234567890abcde", "b", "late within the"], [], [], 0, 40, "expired"),
        row("B", "t2", [], [], [], 150, 150, "expired"),
    }


def test_what_is_later_than_the_delay_is_dropped(spark, tmp_path):
    got = streamed(spark, tmp_path, [[op("A", 0, "open"), op("B", 100, "open")], [op("A", 20, "get", ids=["too late"]), op("A", 30, "open")], [op("Z", 900, "open")]])
    assert {(r[0], r[3], r[8]) for r in got} == {("A", "[]", "expired"), ("B", "[]", "expired")}


def test_random_operations_in_any_split_are_those_of_the_table(spark, tmp_path):
    rng = random.Random(5)
    kinds = ["open", "recall", "get", "get", "touch", "finalize"]
    rows = [op(f"r{rng.randrange(6)}", rng.randrange(3000), rng.choice(kinds), k, [f"m{rng.randrange(30)}" for _ in range(3)], [f"m{rng.randrange(30)}"], rng.choice(["s1", "s2", ""]), rng.choice(["t", None])) for k in range(160)]
    rows.sort(key=lambda r: (r[1] + datetime.timedelta(seconds=rng.randrange(9)), r[2]))  # a little out of order
    batches = [rows[:50], rows[50:60], rows[60:], [op("end", 9000, "open"), (None, START, 0, "open", None, None, None, None)]]
    table = spark.createDataFrame([r for b in batches for r in b], OPS)
    wanted = {tuple(map(str, r)) for r in ended_turns(table, 60_000).where("run_id <> 'end'").drop("ended_ms").collect()}
    assert len(wanted) > 15 and streamed(spark, tmp_path, batches) == wanted


def test_short_ids():
    assert short_ids([" a ", None, "", "a", "b" * 20]) == ["a", "b" * 16] and short_ids(None) == []


def test_no_operations(spark):
    assert ended_turns(spark.createDataFrame([], OPS).withColumn("new", F.lit(1))).count() == 0


class Calls:
    """A handle and states in memory that count what a processor asks of them."""

    def __init__(self):
        self.timers, self.registered, self.value, self.rows = set(), 0, None, []

    def registerTimer(self, ms):  # noqa: N802
        self.registered += 1
        self.timers.add(ms)

    exists = lambda self: self.value is not None
    get = lambda self: self.value
    update = lambda self, value: setattr(self, "value", value)
    appendList = lambda self, rows: self.rows.extend(rows)
    put = lambda self, rows: setattr(self, "rows", rows)
    clear = lambda self: (setattr(self, "value", None), setattr(self, "rows", []))


def test_timers_do_not_grow_with_the_operations_of_a_batch():
    handle, turn, waiting = Calls(), Calls(), Calls()
    waiting.get = lambda: waiting.rows
    turns = Turns(60_000)
    turns.handle, turns.turn, turns.waiting = handle, turn, waiting
    came = [Row(kind="open" if k == 0 else "get", session_id="s", trace_id="t", memory_ids=[f"m{k}"], allowed_ids=[], ms=1_000 * k, seq=k) for k in range(50)]
    turns.handleInputRows(("r",), iter(came), None)
    ended, fired = [], 0
    for now in (20_500, 1_000_000):  # the watermark passes some first, then all
        while due := sorted(t for t in handle.timers if t <= now):
            handle.timers.remove(due[0])
            fired += 1
            ended += turns.handleExpiredTimer(("r",), type("T", (), {"getCurrentWatermarkInMs": lambda self, now=now: now})(), None)
    assert [(r.ended, r.created_ms, r.touched_ms, len(r.get_ids)) for r in ended] == [("expired", 0, 49_000, 49)]
    assert handle.registered <= 4 and fired <= 4 and not waiting.rows
