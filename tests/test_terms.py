"""How query texts are read, and what a row gets for the terms and fragments that it has."""

import pytest
from pyspark.sql import functions as F

from palimpsest.operators.retrieval import matched
from palimpsest.sources.model import STAMP, Store, query_fragments, query_terms, terms_of


@pytest.mark.parametrize(
    "text, terms, fragments",
    [
        ("[Mon 2024-01-29 10:30 GMT+8] Which model runs v2.1.3?", ["which", "model", "runs", "version_2_1_3"], ["v2.1.3"]),
        ("release 10.2+ of 2024, on Tue 12", ["release", "version_10_2", "of", "on"], ["10.2"]),
        ("foo-bar a foo foo.bar-baz", ["foo", "bar", "baz"], ["foo-bar", "foo.bar-baz"]),
        ("记忆引擎模型 abc", ["记忆", "忆引", "引擎", "擎模", "模型", "abc"], ["记忆引擎模型"]),
        ("", [], []),
        ("a ! 7", [], []),
        (" ".join(f"t{i}x" for i in range(30)), [f"t{i}x" for i in range(10)], []),
    ],
)
def test_terms_and_fragments(spark, text, terms, fragments):
    raw = F.lower(F.trim(F.regexp_replace(F.lit(text), STAMP, "")))
    got = spark.range(1).select(query_terms(raw, 10), query_fragments(raw, 8)).first()
    assert (got[0], got[1]) == (terms, fragments)


def test_numbers_have_no_digit_next_to_them(spark):
    rows = spark.createDataFrame([("a", "see 123 there"), ("b", "x1234"), ("c", "v123b"), ("d", None), ("e", "")], "id string, text string")
    terms = terms_of(spark.createDataFrame([(1, ["123", "here"]), (2, [])], "query_id int, words array<string>"))
    got = {(r.query_id, r.id): (r.share, r.lex) for r in matched(Store(spark, ""), rows, "text", terms).collect()}
    assert got == {(1, "a"): (1.0, 1.0), (1, "c"): (0.5, 0.5)}
