"""Batches that run twice, rows that two batches carry, the hook's good and bad answers, and copies into an empty table."""

from pyspark.sql import types as T

from palimpsest.sources.model import NOW
from palimpsest.streaming.sinks import SIDECAR, VECTORS, AppendTable, add_memories, embedded

ROWS = "id string, value int"


def table(spark, tmp_path, name="t", ddl=ROWS, key="id"):
    return AppendTable(spark, f"file://{tmp_path}/{name}", T.StructType.fromDDL(ddl), key)


def held(t):
    return sorted((r.id, r.value, r.source, r.batch) for r in t.rows().collect())


def test_a_replayed_batch_leaves_one_copy(spark, tmp_path):
    t, df = table(spark, tmp_path), lambda *rows: spark.createDataFrame(list(rows), ROWS)
    assert held(t) == []
    for _ in range(2):
        t.append(df(("a", 1), ("b", 2), ("b", 2), (None, 3)), 0)
    t.append(df(("b", 9), ("c", 3)), 1)
    t.append(df(("c", 9), ("d", 4)), 1, "other")
    wanted = [("a", 1, "main", 0), ("b", 2, "main", 0), ("c", 3, "main", 1), ("d", 4, "other", 1)]
    assert held(t) == wanted
    t.append(df(("b", 9), ("c", 3)), 1)
    t.append(df(("a", 1), ("b", 2)), 0)
    assert held(t) == wanted
    t.append(df().withColumnRenamed("value", "value"), 2)
    assert held(t) == wanted


def test_a_stream_whose_checkpoint_is_lost_appends_nothing_twice(spark, tmp_path):
    t = table(spark, tmp_path)
    spark.createDataFrame([("a", 1), ("b", 2)], ROWS).coalesce(1).write.parquet(f"file://{tmp_path}/in/0")
    source = spark.readStream.schema(t.schema).parquet(f"file://{tmp_path}/in/*")
    t.take(source, f"file://{tmp_path}/c1")
    spark.createDataFrame([("b", 7), ("c", 3)], ROWS).coalesce(1).write.parquet(f"file://{tmp_path}/in/1")
    t.take(source, f"file://{tmp_path}/c1")
    assert [r[:2] for r in held(t)] == [("a", 1), ("b", 2), ("c", 3)]
    t.take(source, f"file://{tmp_path}/c2")
    assert sorted(r[0] for r in held(t)) == ["a", "b", "c"]


def test_copies_go_into_an_empty_table_alone(spark, tmp_path):
    t, old = table(spark, tmp_path), spark.createDataFrame([("a", 1), ("b", 2)], ROWS)
    assert t.copy_once(None) == (0, "table_missing")
    assert t.copy_once(old) == (2, "ok") and t.copy_once(old) == (0, "not_empty")
    assert [r[0] for r in held(t)] == ["a", "b"]


def answers(texts):
    if "raise" in texts:
        raise RuntimeError("service down")
    found = {"short": [1.0], "nan": [1.0, float("nan")], "none": None, "words": ["x", "y"]}
    return [found.get(t, [float(len(t)), 0.5]) for t in texts][: 0 if "fewer" in texts else None]


def test_the_hook_is_given_bounded_texts_and_its_faults_stay_with_them(spark):
    texts = [("1", "y" * 3000), ("2", "short"), ("3", "nan"), ("4", "none"), ("5", ""), ("6", None), ("7", " \n"), ("8", "words"), ("9", "raise"), ("10", "fewer")]
    df = spark.createDataFrame(texts, "id string, text string").coalesce(1)
    got = {r.id: (r.vector, r.status, len(r.text or "")) for r in embedded(df, answers, dims=2, at_a_time=1).collect()}
    assert got == {
        "1": ([2000.0, 0.5], "ok", 2000), "2": (None, "wrong_length", 5), "3": (None, "not_finite", 3), "4": (None, "no_vector", 4), "5": (None, "empty", 0), "6": (None, "empty", 0), "7": (None, "empty", 2),
        "8": (None, "not_finite", 5), "9": (None, "failed", 5), "10": (None, "failed", 5),
    }
    assert {r.status for r in embedded(df, answers, at_a_time=64).collect()} == {"failed", "empty"}


def test_no_sidecar_row_without_a_vector(spark, tmp_path):
    vectors, sidecar = table(spark, tmp_path, "v", VECTORS), table(spark, tmp_path, "s", SIDECAR, "chunk_id")
    chunks = spark.createDataFrame([("a", "fine", "preference"), ("b", "raise", "episodic"), ("c", "me", "user_identity"), ("d", "odd", "else")], "id string, text string, category string").repartition(4, "id")
    for _ in range(2):
        add_memories(chunks, vectors, sidecar, lambda t: answers(t), 0, dims=2)
    got = {r.chunk_id: (r.confidence, r.base_tau, r.is_protected, r.category, r.last_confidence_update) for r in sidecar.rows().collect()}
    stored = {r.id for r in vectors.rows().collect()}
    assert set(got) == stored and "b" not in stored and sidecar.rows().count() == len(got)
    assert got["c"] == (0.95, 365.0, 1, "user_identity", NOW) or "c" not in stored
    add_memories(chunks, vectors, sidecar, lambda t: [[1.0, 2.0] for _ in t], 1, dims=2)
    got = {r.chunk_id: (r.confidence, r.category) for r in sidecar.rows().collect()}
    assert got == {"a": (0.7, "preference"), "b": (0.7, "episodic"), "c": (0.95, "user_identity"), "d": (0.5, "raw_log")}
