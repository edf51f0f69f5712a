"""Penalties, values set by a user and weekly warnings on rows whose answers are known."""

from pyspark.sql import functions as F

from palimpsest.operators.upkeep import HHI, confidence_set, penalised, storage_class, updated, warning

SIDECAR = "chunk_id string, category string, confidence double, base_tau double, hit_count int, is_protected int, conflict_flag int, last_confidence_update long"


def sidecar(spark, *rows):
    return spark.createDataFrame([(i, "raw_log", c, 7.0, 1, 0, f, 5) for i, c, f in rows], SIDECAR)


def test_penalties_are_taken_once_and_leave_a_floor(spark):
    rows = sidecar(spark, ("a", 0.9, 0), ("b", 0.3, 0), ("c", 0.9, 0), ("d", 0.1, None), ("e", 0.8, 1), ("f", None, 0))
    bad = spark.createDataFrame([("a",), ("b",), ("a",)], "chunk_id string")
    near = spark.createDataFrame([("a", "e"), ("c", "d"), ("c", "d"), ("c", "f")], "id_a string, id_b string")
    got = {r.chunk_id: (r.confidence, r.conflict_flag) for r in penalised(rows, bad, near).collect()}
    assert got == {"a": (0.4, 1), "b": (0.01, 1), "c": (0.7, 1), "d": (0.01, 1), "e": (0.8, 1), "f": (0.01, 1)}
    assert penalised(rows.limit(0), bad, near).count() == 0


def test_values_are_held_between_nothing_and_one(spark):
    asked = spark.createDataFrame([("a", 1.5), ("a", 0.2), ("b", float("nan")), ("c", -1.0), ("d", None)], "chunk_id string, value double")
    got = {r.chunk_id: (r.confidence, r.last_confidence_update) for r in confidence_set(sidecar(spark, ("a", 0.5, 0), ("b", 0.5, 0)), asked, 99).collect()}
    assert got == {"a": (1.0, 99), "b": (0.5, 5), "c": (0.0, 99)}


def test_an_update_needs_one_match(spark):
    rows = sidecar(spark, ("ab1", 0.5, 0), ("ab2", 0.5, 0), ("cd1", 0.5, 0))
    asked = spark.createDataFrame([("ab", "kg_node", True, None), ("cd", "kg_node", True, True), ("ab1", "unknown", None, None), ("zz", None, None, None), ("", None, None, None)], "prefix string, category string, hit boolean, protect boolean")
    got = {r.prefix: tuple(r)[1:] for r in updated(rows, asked, 99).collect()}
    none = (None,) * 7
    assert got == {
        "ab": ("multiple_matches", *none), "cd": ("updated", "cd1", "kg_node", 0.85, 90.0, 2, 1, 99), "ab1": ("updated", "ab1", "raw_log", 0.5, 7.0, 1, 0, 99),
        "zz": ("no_match", *none), "": ("no_match", *none),
    }


def test_storage_classes_and_warnings(spark):
    values = {"12": "integer", "-3": "integer", "1.5": "real", "2e5": "real", "9" * 19: "real", "x1": "text", "": "text", None: "null"}
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", storage_class(F.col("v")).alias("c"))
    assert {r.v: r.c for r in rows.collect()} == values
    shares = {0.5: "monopoly", 0.4: "high", 0.2: "ok", 0.05: "ok", 0.04: "low", None: None}
    rows = spark.createDataFrame([(v,) for v in shares], "hhi double").select("hhi", warning("hhi", HHI))
    assert {r.hhi: r.hhi_flag for r in rows.collect()} == shares
