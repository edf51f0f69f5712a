"""Citations against allowances in two streams of several batches: time bounds, other turns, repetitions, late rows."""

import datetime

from pyspark.sql import functions as F

from palimpsest.streaming.reinforcement import by_citation, cited
from palimpsest.streaming.turns import finished

CITED = "citation bigint, at timestamp, session_id string, trace_id string, memory_ids array<string>"
GIVEN = "at timestamp, session_id string, trace_id string, memory_ids array<string>"
START = datetime.datetime(2024, 1, 1)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def answers(spark, tmp_path, batches):
    session = spark.newSession()
    for key, value in {"spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": "2"}.items():
        session.conf.set(key, value)
    out, streams = f"file://{tmp_path}/out", []
    for k, (asks, given) in enumerate(batches):
        for name, rows, schema in (("asks", asks, CITED), ("given", given, GIVEN)):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/{name}/{k}")
        streams = [session.readStream.schema(spark.createDataFrame([], schema).schema).parquet(f"file://{tmp_path}/{name}/*") for name, schema in (("asks", CITED), ("given", GIVEN))]
        df = cited(*streams, within="60 seconds", delay="10 seconds")
        finished(df, "append", out)
    rows = spark.read.schema(df.schema).parquet(f"{out}/table").select(*df.columns)
    return {r.citation: (r.reinforced_ids, r.ignored_ids) for r in by_citation(rows).collect()}


END = ([(99, at(5000), "end", "end", ["x"])], [(at(5000), "end", "end", ["y"])])


def test_ids_that_the_turn_was_given_are_reinforced_in_the_order_cited(spark, tmp_path):
    long = "A1234567890abcdefXYZ"
    first = (
        [(1, at(20), "s", "t", ["m3", "m1", "m3", long, " ", "other"]), (2, at(20), "s", "t2", ["m1"]), (3, at(70), "s", "t", ["m1", "m2"]), (4, at(5), None, None, ["m9"]), (5, at(9), "s", "t", []), (6, at(9), "s", "t", None)],
        [(at(0), "s", "t", ["m1", "m3"]), (at(10), "s", "t", ["m2", long[:16], "m1"]), (at(1), None, "", ["m9"]), (at(30), "s", "t", ["other"])],
    )
    got = answers(spark, tmp_path, [first, END])
    assert got[1] == (["m3", "m1", long[:16]], ["other"])  # what is fetched afterwards does not count
    assert got[2] == ([], ["m1"]) and got[4] == (["m9"], [])
    assert got[3] == (["m1", "m2"], []) and not {5, 6} & set(got)


def test_rows_of_later_batches_meet_until_they_are_late(spark, tmp_path):
    batches = [
        ([(1, at(50), "s", "t", ["a", "b", "c"])], [(at(45), "s", "t", ["a"])]),
        ([], [(at(48), "s", "t", ["b"])]),  # within the delay
        ([(2, at(200), "s", "t", ["a"])], [(at(190), "s", "u", ["z"])]),
        ([(3, at(60), "s", "t", ["a"])], [(at(49), "s", "t", ["c"]), (at(195), "s", "t", ["a"])]),  # both late but for the last one
        END,
    ]
    got = answers(spark, tmp_path, batches)
    assert got[1] == (["a", "b"], ["c"]) and got[2] == (["a"], []) and 3 not in got


def test_the_same_from_tables(spark):
    asks = spark.createDataFrame([(1, at(20), "s", "t", ["m1", "m2"])], CITED)
    given = spark.createDataFrame([(at(10), "s", "t", ["m2"]), (at(11), "s", "t", ["m2"])], GIVEN)
    assert [tuple(r) for r in by_citation(cited(asks, given)).collect()] == [(1, ["m2"], ["m1"])]
    assert by_citation(cited(asks.limit(0), given).withColumn("extra", F.lit(1))).count() == 0
