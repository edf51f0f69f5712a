import math

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.scores import plain, realtime_confidence, rounded, scope_family
from palimpsest.sources.model import NOW

SIDECAR = "confidence double, last_confidence_update long, base_tau double, hit_count int, is_protected int, conflict_flag int"


@pytest.mark.parametrize("x, expected", [(0.00005, 0.0001), (-2.5e-4, -0.0002), (1.23456, 1.2346), (0.0, 0.0)])
def test_half_goes_up(spark, x, expected):
    assert spark.range(1).select(rounded(F.lit(x))).first()[0] == pytest.approx(expected, abs=1e-9)


def test_realtime_confidence(spark):
    day = NOW - 86400
    rows = [(0.8, day, 7.0, 0, 0, 0), (0.8, day, 7.0, 0, 1, 0), (0.8, None, 7.0, 0, 0, 0), (0.8, 0, 7.0, 0, 0, 0), (0.3, day, 7.0, 0, 0, 1), (0.8, day, 365.0, 9, 0, 0)]
    got = [r[0] for r in spark.createDataFrame(rows, SIDECAR).select(realtime_confidence()).collect()]
    assert got == pytest.approx([0.8 * math.exp(-1 / 7), 0.8, 0.8, 0.8, 0.0, 0.8 * math.exp(-1 / 365)])


def test_families_and_plain_text(spark):
    paths = ["MEMORY.md", "memory/generated-smart-add/x.md", "memory/smart-add/2024-01-01.md", "memory/2024-01-01.md", "memory/other.md", "x.md"]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in paths], "path string").select(scope_family(F.col("path"))).collect()]
    assert got == ["curated_memory", "generated_smart_add", "smart_add", "daily_memory", "unknown", "non_memory"]
    assert spark.range(1).select(plain(F.lit("  A\t\nb  C "))).first()[0] == "a b c"
