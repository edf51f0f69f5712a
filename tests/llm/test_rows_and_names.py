"""Repeated texts and ids, headers of any length, and columns of clashing names."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import line_dedup, mixing, near_dedup, quality, suffix_dedup, warc

DOCS = "doc_id long, text string, lang string, source string"


def letters(rng, n):
    return "".join(rng.choice("abcdefgh ") for _ in range(n))


def test_trusted_texts_that_repeat_leave_each_byte_a_probability(spark):
    rng = random.Random(1)
    texts = [t for times in (1, 2, 3, 4) for t in [letters(rng, 60 * 2 ** rng.randrange(5)) for _ in range(8)] for _ in range(times)]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(9000, "abc\x7fabc", "en", "s"), (9001, "", "en", "s"), (9002, None, None, "s")]
    labels = spark.createDataFrame([(i, 1) for i in range(len(texts))], "doc_id long, quality int")
    got = quality.classify(spark.createDataFrame(rows, DOCS), labels).collect()
    assert len(got) == len(rows) and all(r.log_prob is not None and float("-inf") < r.log_prob < 0 for r in got)


def test_rows_of_one_id_have_their_own_links(spark):
    rng = random.Random(2)
    rows, links = [], {}
    for k in range(12):
        a, b = (" ".join(f"w{rng.randrange(9999)}" for _ in range(40)) for _ in range(2))
        rows += [(10 * k, a), (10 * k, b), (10 * k + 1, a), (10 * k + 2, b)]
        links |= {10 * k: {10 * k}, 10 * k + 1: {10 * k}, 10 * k + 2: {10 * k}}
    rows += [(500, rows[1][1]), (3, "short text"), (3, rows[0][1] + " and more")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {}
    for r in near_dedup.near_duplicates(df).collect():
        got.setdefault(r.id, set()).add(r.component_id)
    assert got == links | {500: {0}, 3: {0, 3}}
    kept = sorted((r.doc_id, r.text) for r in near_dedup.without_near_duplicates(df).collect())
    assert kept == sorted([(10 * k, t) for k in range(12) for t in (rows[4 * k][1], rows[4 * k + 1][1])] + [(3, "short text")])


@pytest.mark.parametrize("suffix", [".warc", ".warc.gz"])
@pytest.mark.parametrize("ours", [True, False])
def test_headers_of_any_length(spark, tmp_path, suffix, ours):
    warc.register(spark)
    head = "HTTP/1.1 200 OK\r\n" + "".join(f"X-{i}: {'v' * 90}\r\n" for i in range(60)) + "\r\n"
    block = head.encode() + b"p" * 5000
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    if suffix == ".warc":
        data = record
    else:
        data = warc.member(record, 1) if ours else gzip.compress(record)
    (tmp_path / f"a{suffix}").write_bytes(data)
    path = f"file://{tmp_path}"
    assert [r.payload_length for r in warc.read(spark, path).collect()] == [5000]
    assert [r.payload_length for r in warc.read(spark, path, payload="false").collect()] == [5000]


NAMES = ["own", "own_hash", "id", "hash", "dropped", "lines", "i", "t", "ranges", "taken", "rows", "copies", "more", "lot", "times", "copy", "lost_id", "lost_hash", "bad_id", "th", "text_hash", "__own", "__id", "__lost", "__bad"]


def test_columns_of_clashing_names_stay(spark):
    rng = random.Random(3)
    line = "a line that is in many of the documents here"
    texts = [f"{line}\n{letters(rng, 200)}" for _ in range(6)] + [letters(rng, 90)]
    rows = [(i, t, "en", "s") for i, t in enumerate([*texts, texts[0]])]
    plain = spark.createDataFrame(rows, DOCS)
    wide = plain.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in NAMES})
    labels = spark.createDataFrame([(i, 1) for i in range(len(rows))], "doc_id long, quality int")
    for f in (line_dedup.dedup_lines, suffix_dedup.dedup_substrings, near_dedup.without_near_duplicates, mixing.mixed_documents, lambda d: quality.good_documents(d, labels)):
        one, two = f(plain), f(wide)
        assert two.columns[: len(wide.columns)] == wide.columns
        got = two.collect()
        assert all(r[n] == f"{n}{r.doc_id}" for r in got for n in NAMES)
        assert sorted(map(str, one.collect())) == sorted(map(str, two.select(*one.columns).collect()))
