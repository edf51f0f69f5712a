"""Each operator on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import gzip
import hashlib
import itertools
import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import bpe, hamming, line_dedup, media, mixing, near_dedup, passage_dedup, quality, registry, suffix_dedup, warc
from palimpsest.llm.graph import components
from tests.oracle import SMALL, check

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, start=1):
    return spark.createDataFrame([(start + i, t, "en", f"s{i % 3}", 0) for i, t in enumerate(texts)], DOCS)


def words(n, seed):
    rng = random.Random(seed)
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_has_the_rows_of_its_sql(spark, name):
    check(spark, registry.queries()[name], registry.oracle_sql()[name])


def test_columns_of_queries(spark):
    wanted = {"op5_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], "op6_suffix_array_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]}
    for name, columns in wanted.items():
        assert registry.queries()[name](spark, SMALL).columns[: len(columns)] == columns


# Top-k search


def brute_nearest(rows, queries, k):
    sign = {i: [x > 0 for x in v] for i, v in rows if v}
    out = set()
    for q in queries:
        near = sorted((sum(a != b for a, b in itertools.zip_longest(sign[q], s, fillvalue=False)), i) for i, s in sign.items() if i != q)
        out |= {(q, r + 1, i, d) for r, (d, i) in enumerate(near[:k])}
    return out


@pytest.mark.parametrize("dims, n", [(8, 40), (64, 300), (100, 60)])
def test_search_is_exact(spark, dims, n):
    rng = np.random.default_rng(dims)
    rows = [(i, rng.normal(size=dims).astype(float).tolist()) for i in range(n)] + [(n + i, [1.0] * dims) for i in range(30)]
    df = spark.createDataFrame([*rows, (999, None), (None, [1.0] * dims), (998, [])], "vec_id long, embedding array<double>")
    got = {tuple(r) for r in hamming.search(df, df.where("vec_id % 20 = 0"), 5).collect()}
    assert got == brute_nearest(rows, [i for i, _ in rows if i % 20 == 0], 5)


def test_keys_of_a_radius_are_made_once(spark):
    cuts, code = [(0, 0, 6), (0, 6, 5)], 0b10110_101101
    df = spark.createDataFrame([([code], 2), ([0], 1)], "query array<bigint>, need int")
    for r in range(7):
        got = [(r_.query[0], r_.segment, r_.key) for r_ in hamming.probes(df, cuts, r).collect()]
        wanted = {(q, i, k) for q, need in ((code, 2), (0, 1)) for i, (_, at, w) in enumerate(cuts[:need]) for k in range(2**w) if ((q >> at & (2**w - 1)) ^ k).bit_count() == r}
        assert len(got) == len(wanted) and set(got) == wanted


def test_search_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert hamming.search(df, df, 5).count() == 0


# Near duplicates


def brute_components(texts, percent=85):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in texts}
    for _ in texts:
        for a, b in itertools.combinations(texts, 2):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                comp[a] = comp[b] = min(comp[a], comp[b])
    return {i: (i, len(sets[i]), comp[i], comp[i] == i) for i in texts}


def test_near_duplicates_against_all_pairs(spark):
    base, rng, texts = words(120, 1), random.Random(2), []
    for k in range(30):
        own = list(base)
        for _ in range(rng.randrange(8)):
            own[rng.randrange(len(own))] = f"x{k}{rng.randrange(99)}"
        texts.append(" ".join(own))
    texts += [None, "", " \n", "one two", "ONE  two", " ".join(words(5000, 3)), texts[0], " ".join(words(60, 4))]
    df = docs_of(spark, texts)
    got = {r.id: tuple(r) for r in near_dedup.near_duplicates(df).collect()}
    assert got == brute_components(dict(enumerate(texts, 1)))
    assert near_dedup.without_near_duplicates(df).columns == df.columns


def test_near_duplicates_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    got = sorted((r.id or 0, r.component_id or 0, r.kept) for r in near_dedup.near_duplicates(df).collect())
    assert got == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def pair_rows(spark, monkeypatch, df):
    """The components, and how many pairs around centres were left to confirm."""
    seen = []
    others = near_dedup._others
    monkeypatch.setattr(near_dedup, "_others", lambda *a: seen.append(others(*a)) or seen[-1])
    got = {r.id: r.component_id for r in near_dedup.near_duplicates(df).collect()}
    return got, seen[0].count()


def linked_pairs(texts, percent=85):
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    return {(a + 1, b + 1) for a, b in itertools.combinations(range(len(sets)), 2) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}


def test_texts_that_each_hold_half_of_one_make_few_pairs(spark, monkeypatch):
    lines, rng = [words(20, 1000 + k) for k in range(30)], random.Random(8)
    texts = [" ".join(itertools.chain.from_iterable(lines))]
    texts += [" ".join(itertools.chain.from_iterable(lines[i] for i in sorted(rng.sample(range(30), 15)))) for _ in range(600)]
    got, pairs = pair_rows(spark, monkeypatch, docs_of(spark, texts))
    wanted = linked_pairs(texts)
    assert pairs <= 4 * len(texts)
    assert all(got[a] == got[b] for a, b in wanted) and len(set(got.values())) >= len(texts) - len(wanted)


def test_copies_altered_apart_make_few_pairs(spark, monkeypatch):
    base, rng, texts = words(200, 90), random.Random(9), []
    for k in range(300):
        own = list(base)
        for j in rng.sample(range(40), 4 + k % 5):  # 0.90 to 0.67 to the text itself
            own[5 * j] = f"x{k}y{j}"
        texts.append(" ".join(own))
    texts.append(" ".join(base))
    got, pairs = pair_rows(spark, monkeypatch, docs_of(spark, texts))
    wanted = linked_pairs(texts)
    assert pairs <= 4 * len(texts) and all(got[a] == got[b] for a, b in wanted)


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(5)
    for n in (1, 3, 2000):
        assert (near_dedup.sketches([rng.integers(1, 2**63, n).astype(np.uint64)]) != near_dedup.EMPTY).all()
    common, a, b = (rng.integers(1, 2**63, n).astype(np.uint64) for n in (800, 100, 100))
    x, y = near_dedup.sketches([np.concatenate((common, a)), np.concatenate((common, b))])
    assert abs((x == y).mean() - 0.8) < 0.15


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)]
    got = {r.v: r.c for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


# Quality


def brute_log_prob(trusted, texts, order=5):
    """n and log probability of each text from dictionaries of counts, by the definition."""
    padded = lambda t: b"\0" * (order - 1) + (t or "").encode() + b"\0"
    runs = lambda t: [padded(t)[i : i + order] for i in range(len(padded(t)) - order + 1)]
    counts = {order: Counter(g for t in trusted if t for g in runs(t))}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    off, total, left = {}, Counter(), Counter()
    for n, c in counts.items():
        of = Counter(c.values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] + of[2] else 0
        ds = [k - (k + 1) * y * of[k + 1] / of[k] if of[k] else 0 for k in (1, 2, 3)]
        off[n] = [0] + [d if 0 < d <= k else 0.5 * k for k, d in enumerate(ds, 1)]
        for g, k in c.items():
            total[g[:-1]] += k
            left[g[:-1]] += off[n][min(k, 3)]

    def p(g):
        if not g:
            return 1 / 256
        h, k = g[:-1], counts[len(g)][g]
        if not total[h]:
            return p(g[1:])
        return (k - off[len(g)][min(k, 3)]) / total[h] + left[h] / total[h] * p(g[1:])

    return [(len(runs(t)), sum(math.log(p(g)) for g in runs(t))) for t in texts]


def test_quality_scores_against_brute_force(spark, monkeypatch):
    good = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", None, "", "é cat"]
    texts = ["the cat", "zq!!", None, "", "x" * 70_000, "the dog sat on the mat and the log " * 300, "a\0b"]
    wanted = brute_log_prob(good, texts)
    model = quality.train(docs_of(spark, good))
    docs = docs_of(spark, texts).union(docs_of(spark, texts[4:6], 5))
    for chunk, piece in ((32 << 20, 1 << 20), (1000, 1 << 12), (1000, 7)):
        monkeypatch.setattr(quality, "PIECE", piece)
        rows = quality.score(docs.where("n_chars >= 0 AND doc_id <> 5") if piece == 7 else docs, model, id_cols=["doc_id"], chunk_bytes=chunk).collect()
        assert len(rows) == (7 if piece == 7 else 9)
        for r in rows:
            assert (r.n_bytes, r.log_prob) == (wanted[r.doc_id - 1][0], pytest.approx(wanted[r.doc_id - 1][1], rel=1e-9))
    assert quality.score(docs.limit(0), model, id_cols=["doc_id"]).count() == 0


def test_quality_decisions_against_brute_force(spark):
    """The whole query on small tables: perplexities by the definition, limits by sorting."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    rows, good = docs.orderBy("doc_id").collect(), {r.doc_id for r in labels.collect() if r.quality == 1}
    scores = dict(zip([r.doc_id for r in rows], brute_log_prob([r.text for r in rows if r.doc_id in good], [r.text for r in rows]), strict=True))
    place = lambda r: (r.lang, int(math.log2(scores[r.doc_id][0])))
    nats = {i: -lp / n for i, (n, lp) in scores.items()}

    def limit(near):
        bins = sorted(math.floor(nats[r.doc_id] / quality.STEP) for r in rows if r.doc_id in good and scores[r.doc_id][0] > 1 and near(*place(r)))
        at = lambda q: (bins[max(0, math.ceil(q * len(bins) - 1e-9) - 1)] + 1) * quality.STEP
        return (2 * at(0.99) - at(0.5), len(bins)) if bins else (None, 0)

    for r in quality.classify(docs, labels).collect():
        own = next(x for x in rows if x.doc_id == r.id)
        lang, size = place(own)
        tries = [limit(lambda a, b: a == lang and abs(b - size) <= 1), limit(lambda a, b: a == lang), limit(lambda a, b: abs(b - size) <= 1)]
        wanted = next((m for m, n in tries if n >= 20), limit(lambda a, b: True)[0])
        assert r.perplexity == pytest.approx(math.exp(nats[r.id]), rel=1e-9) and r.limit == pytest.approx(math.exp(wanted))
        assert r.kept == (scores[r.id][0] <= 1 or nats[r.id] <= wanted)


def test_quality_keeps_good_and_rejects_junk(spark):
    from tests.oracle import SMALL

    docs, labels = (spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.quality: (r.k, r.n) for r in quality.classify(docs, labels).join(labels, F.col("id") == F.col("doc_id")).groupBy("quality").agg(F.count_if("kept").alias("k"), F.count(F.lit(1)).alias("n")).collect()}
    assert got[1][0] >= 0.98 * got[1][1] and got[0][0] <= 0.2 * got[0][1]


def test_a_small_language_is_judged_by_its_own_limit(spark):
    rows = [("en", 6, 0.5 + 0.01 * (k % 5), True) for k in range(400)] + [("xx", 3, 2.0 + 0.02 * (k % 5), True) for k in range(60)] + [("xx", 6, 2.1, True)] * 3 + [("yy", 6, 0.6, True)]
    limits = {(r.lang, r.size_class): r.limit for r in quality.quantile_limits(spark.createDataFrame(rows, "lang string, size_class int, nats double, trusted boolean")).collect()}
    assert limits["en", 6] < 1 and limits["yy", 6] < 3
    assert limits["xx", 6] == pytest.approx(limits["xx", 3], abs=0.2) and limits["xx", 6] > 2.1


def test_quality_without_labels_keeps_all(spark):
    docs, none = docs_of(spark, ["abc", None, ""]), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.good_documents(docs, none).count() == 3
    assert quality.good_documents(docs.limit(0), none).columns == docs.columns


# Passages


def test_passages_are_found_and_clean_texts_left_alone(spark):
    passage = words(60, 7)
    texts = [" ".join(words(100, 20 + k) + passage + words(80, 40 + k)) for k in range(6)] + [" ".join(words(300, 90)), None, "", "short text", " ".join(words(70, 91))]
    texts += [texts[-1]]
    near = list(passage)
    near[30] = "changed"
    texts.append(" ".join(words(40, 92) + near))
    got = {}
    for r in passage_dedup.passages(docs_of(spark, texts)).collect():
        got.setdefault(r.id, []).append(r)
    assert set(got) == {1, 2, 3, 4, 5, 6, 11, 12, 13}
    assert all(any(r.start <= 100 and r.start + r.words >= 160 for r in got[i]) for i in range(1, 7))
    assert all(r.similarity >= 0.8 for rows in got.values() for r in rows)
    assert passage_dedup.passages(docs_of(spark, texts).limit(0)).count() == 0


def alike(a, b):
    """Whether two passages of one length have, at one place, windows of 50 words or more that are 0.8 alike: the brute-force link."""
    one, two = ([tuple(p[i : i + 5]) for i in range(len(p) - 4)] for p in (a, b))
    for lo in range(len(one) - 45):
        for hi in range(lo + 46, len(one) + 1):
            x, y = set(one[lo:hi]), set(two[lo:hi])
            if len(x & y) >= 0.8 * len(x | y):
                return True
    return False


@pytest.fixture(scope="module")
def altered_copies(spark):
    """Rows of passages() and (first id, copies) of groups of 30 and 100, with one and with two words changed in each copy."""
    rng, texts, groups = random.Random(5), [], []
    for g, (size, changes) in enumerate([(30, 1), (30, 2), (100, 1), (100, 2)]):
        passage, copies = words(60, 700 + g), []
        for k in range(size):
            copy = list(passage)
            for at in rng.sample(range(60), changes):
                copy[at] = f"changed{g}x{k}x{at}"
            copies.append(copy)
            texts.append(" ".join(words(60, 10_000 + len(texts)) + copy + words(60, 20_000 + len(texts))))
        groups.append((len(texts) - size + 1, copies))
    return passage_dedup.passages(docs_of(spark, texts)).collect(), groups


def test_components_are_of_the_rows_and_join_no_strangers(altered_copies):
    rows, groups = altered_copies
    of = {r.id: r.component_id for r in rows}
    group = {first + k: n for n, (first, copies) in enumerate(groups) for k in range(len(copies))}
    assert all(of[r.id] == of[r.other] == r.component_id and group[r.id] == group[r.other] for r in rows)
    assert all(c == min(i for i in of if of[i] == c) for c in set(of.values()))


@pytest.mark.xfail(reason="four functions, of which two must agree, miss texts whose changed words hold the min-hashes: see README")
def test_components_hold_the_links_of_brute_force(altered_copies):
    """0.95 of the links or more in each group; measured with this seed: 239 of 259, 30 of 32, 2,808 of 2,808, 117 of 161."""
    rows, groups = altered_copies
    of = {r.id: r.component_id for r in rows}
    for first, copies in groups:
        links = [(first + i, first + j) for i in range(len(copies)) for j in range(i) if alike(copies[i], copies[j])]
        assert links and sum(of.get(a, -a) == of.get(b, -b) for a, b in links) >= 0.95 * len(links)


def test_components_hold_every_link_of_brute_force(altered_copies):
    rows, groups = altered_copies
    of = {r.id: r.component_id for r in rows}
    for first, copies in groups:
        links = [(first + i, first + j) for i in range(len(copies)) for j in range(i) if alike(copies[i], copies[j])]
        assert [(a, b) for a, b in links if of.get(a, -a) != of.get(b, -b)] == []


def test_texts_that_share_a_short_line_make_no_pairs_in_the_second_round(spark):
    line = words(12, 800)
    docs = docs_of(spark, [" ".join(words(50, 810 + 2 * k) + line + words(50, 811 + 2 * k)) for k in range(40)])
    base = docs.selectExpr("cast(doc_id as long) as id", "xxhash64(cast(text as binary)) as th", "cast(text as binary) as text")
    windows = base.mapInArrow(passage_dedup._windows, passage_dedup.WINDOWS)
    shared = windows.join(windows.groupBy("key").agg(F.min("th").alias("a"), F.max("th").alias("b")).where("a <> b"), "key")
    assert shared.count() > 0
    none = spark.createDataFrame([], passage_dedup.PASSAGES)
    assert passage_dedup._others(shared, none).count() == 0


def test_passages_do_not_depend_on_how_many_pairs_move_at_a_time(spark, monkeypatch):
    passage = words(60, 820)
    docs = docs_of(spark, [" ".join(words(40, 830 + k) + passage[:k] + passage[k + 1 :] + words(40, 850 + k)) for k in range(8)])
    whole = sorted(map(tuple, passage_dedup.passages(docs).collect()))
    monkeypatch.setattr(passage_dedup, "PART", 1)
    assert whole and sorted(map(tuple, passage_dedup.passages(docs).collect())) == whole


def test_word_hashes_tell_words_apart():
    text = b"  Ab\tab  abc\x0bab\xc3\xa9 ab\xc3\x89 x" + b" y z" * 20000
    hashed = passage_dedup.word_hashes(text).tolist()
    assert len(hashed) == 40006 and dict(zip(text.lower().split(), hashed, strict=True)) == {w: h for h, w in zip(hashed, text.lower().split(), strict=True)}
    assert len(set(hashed)) == len(set(text.lower().split()))
    assert passage_dedup.word_hashes(b" \n").tolist() == []


def test_aligned_chains_are_those_of_the_token_by_token_search():
    rng = random.Random(821)
    for _ in range(200):
        x = [rng.randrange(1 << 60) for _ in range(rng.randrange(1, 200))]
        y = [v for v in x if rng.random() > 0.1] + [5]
        at = rng.randrange(len(y))
        y[at:at] = [rng.randrange(1 << 60) for _ in range(rng.choice([0, 3, 40]))]
        found = passage_dedup.aligned(np.array(x), np.array(y))
        if found is not None:
            where = {v: [j] for j, v in enumerate(y)}
            assert [list(zip(i.tolist(), j.tolist(), strict=True)) for i, j in found] == passage_dedup.chains(x, where)


def test_compact_windows_are_the_large_subtrees():
    rng = np.random.default_rng(3)
    x = np.concatenate(([0], rng.integers(1, 2**60, 300), [0], rng.integers(1, 2**60, 50), [0])).astype(np.uint64)
    expected = []
    for q in np.flatnonzero(x > 0).tolist():
        a = b = q
        while x[a - 1] > x[q]:
            a -= 1
        while x[b + 1] >= x[q]:
            b += 1
        if b - a + 1 >= 10:
            expected.append(q)
    assert passage_dedup.compact_windows(x, 10)[0].tolist() == expected


@pytest.mark.parametrize("again", [[20, 40], [0, 30], [3, 18, 33, 50]])
def test_passage_with_an_internal_repeat(again):
    passage, phrase = words(60, 31), words(6, 32)
    for at in again:
        passage[at : at + 6] = phrase
    t = passage_dedup.tokens(" ".join(passage).encode(), near_dedup.WordHashes())
    assert [r[:4] for r in passage_dedup.confirmed(t, t)] == [(0, 55, 0, 55)]
    longer = passage_dedup.tokens(" ".join(words(30, 33) + phrase + words(20, 34) + passage + words(30, 35)).encode(), near_dedup.WordHashes())
    assert [r[:4] for r in passage_dedup.confirmed(t, longer)] == [(0, 55, 56, 111)]
    assert [r[:4] for r in passage_dedup.confirmed(longer, t)] == [(56, 111, 0, 55)]


def test_pairs_of_windows_have_one_order(spark):
    # 1 is a centre of key 7, 2 is one of key 8: both functions count for the pair.
    win = lambda c, k: (c << 20) | (k << 16) | (20 << 8) | 30
    rows = [(i, 10 * i, key, win(100 * i + 5 * k, k)) for key, k in ((7, 0), (8, 1)) for i in (1, 2)]
    df = spark.createDataFrame(rows, "id long, th long, key long, win long")
    partners = df.where("(key = 7 AND id = 1) OR (key = 8 AND id = 2)")
    got = sorted(map(tuple, passage_dedup._met(df, partners).collect()))
    assert got == [(2, 20, 1, 10, win(200, 0), win(100, 0)), (2, 20, 1, 10, win(205, 1), win(105, 1))]


def test_altered_copies_meet_where_no_centre_confirms_them(spark):
    texts = []
    for group in range(4):
        passage = words(70, 100 + group)
        texts.append(" ".join(words(60, 200 + group) + passage + words(60, 300 + group)))
        for k in range(8):
            own = list(passage)
            own[23 + 3 * k] = f"changed{k}"  # 0.86 to the passage, less than 0.8 to the other copies
            texts.append(" ".join(words(30, 400 + 20 * group + k) + own + words(30, 500 + 20 * group + k)))
    phrase = words(12, 600)
    texts += [" ".join(words(100, 700 + k) + phrase + words(100, 800 + k)) for k in range(20)]
    got = {(r.id, r.other) for r in passage_dedup.passages(docs_of(spark, texts)).collect()}
    wanted = {(9 * g + k + 1, 9 * g + 1) for g in range(4) for k in range(1, 9)}
    assert len(got & wanted) >= 0.95 * len(wanted)  # 2 of 4 functions miss some
    assert all(a <= 36 and b <= 36 and (a - 1) // 9 == (b - 1) // 9 for a, b in got)


# BPE


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_agrees_with_the_library(spark):
    rng = random.Random(5)
    texts = ["<|endoftext|>x<|startoftext|> <|end", "", None, "ΑΣ ΟΔΟΣ", "don't CAN'T we'LL 12 3.5!!", " 　x\x85y\x1cz​", "é", "İstanbul", "ﬁ ﷺ", "a՘b", "word " * 30_000]
    texts += ["".join(rng.choice(k) for _ in range(n)) for k in ("abc", "etaoinshr", "aaab", "lolrofl") for n in (5, 300, 5000)]
    t = library()
    for r, text in zip(sorted(bpe.encode_texts(docs_of(spark, texts), bpe.vocabulary()).collect(), key=lambda r: r.doc_id), texts, strict=True):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_reads_back():
    e = bpe.encoder(bpe.vocabulary())
    ids = [i for block in e.ids("héllo wörld 12") for i in block]
    d = bpe.TextDecoder(e)
    assert "".join(d.take(i) for i in ids) == "héllo wörld 1 2 "
    assert e.merges.lookahead > 0


# Substrings


@pytest.mark.parametrize("hot", [1 << 16, 2])
def test_substrings_against_brute_force(spark, hot):
    rng, passage = random.Random(9), "".join(chr(97 + random.Random(8).randrange(26)) for _ in range(180))
    text = lambda n: "".join(chr(97 + rng.randrange(26)) for _ in range(n))
    texts = [text(300) + passage + text(100), text(50) + passage[20:150] + text(70), passage, text(49), None, "", passage, "é" * 200, "é" * 120, text(60) + passage[:49], passage[:50], "ab" * 300, "ab" * 100 + passage]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.h) for r in suffix_dedup.dedup_substrings(docs_of(spark, texts), hot=hot).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("text", 256).alias("h")).collect()}
    assert got == suffix_dedup.brute(list(enumerate(texts, 1)))


def lost_bytes(texts):
    """What first_ids leaves of each text, without Spark."""
    owner, key, start, n = suffix_dedup.anchor_runs(texts)
    ranges = [[] for _ in texts]
    for k in np.unique(key):
        at = np.flatnonzero(key == k)
        runs = [texts[owner[i]][start[i] : start[i] + n[i] + suffix_dedup.LENGTH - 1] for i in at]
        code, least, parts = suffix_dedup.first_ids(runs, owner[at], n[at], key[at].view(np.int64))
        for c, i in zip(code.tolist(), at.tolist(), strict=True):
            found = parts.get(c, np.full(n[i], least[c]))
            ranges[owner[i]] += suffix_dedup.lost_ranges(found < owner[i], int(start[i]))
    return [suffix_dedup.kept_bytes(t, sorted(r)) for t, r in zip(texts, ranges, strict=True)]


def test_substrings_with_a_repeated_anchor():
    rng, several = random.Random(13), 0
    text = lambda n: bytes(97 + rng.randrange(26) for _ in range(n))
    units = [bytes([c]) for c in range(33, 127)] + [text(k) for k in range(2, 36) for _ in range(3)]
    for unit in units:
        tail, period = text(60), len(unit)
        one, two = (unit * 60)[: 19 + period], (unit * 60)[: 19 + period + (2 if period == 1 else period)]
        texts = [text(80) + one + tail, text(80) + two + tail] if period == 1 else [text(80) + unit * -(-len(one) // period) + tail, text(80) + unit * -(-len(two) // period) + tail]
        _, key, start, n = suffix_dedup.anchor_runs(texts[:1])
        h = suffix_dedup.gram_hashes(np.frombuffer(texts[0], np.uint8))
        several += any((h[s : s + m + suffix_dedup.LENGTH - suffix_dedup.GRAM] == k).sum() > 1 for k, s, m in zip(key, start, n, strict=True))
        wanted = suffix_dedup.brute([(i, t.decode()) for i, t in enumerate(texts)])
        assert [(len(t), g, s, hashlib.sha256(left).hexdigest()) for t, (left, g, s) in zip(texts, lost_bytes(texts), strict=True)] == [wanted[0], wanted[1]], unit
    assert several > 10


def test_suffix_array_order():
    rng = np.random.default_rng(1)
    for symbols in (2, 30):
        t = rng.integers(1, symbols + 1, 2000).astype(np.int16)
        t[rng.integers(0, 2000, 20)] = 0
        t[-1] = 0
        whole = lambda i: t[i : i + 56].tolist()[: (t[i : i + 56].tolist() + [0]).index(0) + 1]
        order = suffix_dedup.suffix_array(t).tolist()
        assert sorted(order) == list(range(2000)) and all(whole(a) <= whole(b) for a, b in itertools.pairwise(order))


# Mixing


def test_mix_meets_targets_and_reruns_agree(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 60)), "en", rng.choice(["a", "b", "c", "d", None]), 0) for i in range(1500)] + [(5000, None, "en", "a", 0), (5001, "", "en", "z", 0), (7, "w w", "en", "a", 0), (7, "w w", "en", "a", 0)]
    df = spark.createDataFrame(rows, DOCS)
    a, b = ([tuple(r) for r in mixing.mix(df, chunk=16).orderBy("id", "th", "source").collect()] for _ in range(2))
    assert a == b and sum(r[3] for r in a) == len(rows)
    for source in ("a", "b", "c", "d", None):
        own = [r for r in a if r[2] == source]
        assert abs(sum(r[4] * (r[3] * r[7] + r[8]) for r in own) - own[0][6]) <= 60 and max(r[7] + (r[8] > 0) for r in own) <= 3
    assert sum({r[2]: r[6] for r in a}.values()) == pytest.approx(sum(r[3] * r[4] for r in a))
    out = mixing.mixed_documents(df, chunk=16)
    assert out.columns == df.columns and out.count() == sum(r[3] * r[7] + r[8] for r in a)
    assert mixing.mix(df.limit(0)).count() == 0


def test_repeated_rows_come_near_the_target_too(spark):
    rows = [(1, "w " * 10, "en", "a", k) for k in range(1000)] + [(10 + k, "w " * (1 + k % 10), "en", "a", 0) for k in range(50)] + [(100 + k, "w " * 30, "en", "b", 0) for k in range(130)]
    df = spark.createDataFrame(rows, DOCS)
    a = mixing.mix(df).collect()
    for source in ("a", "b"):
        own = [r for r in a if r.source == source]
        assert abs(sum(r.size * (r.rows * r.copies + r.more) for r in own) - own[0].target) <= (10 if source == "a" else 30)
        assert all(0 <= r.more <= r.rows for r in own)
    assert mixing.mixed_documents(df).where("source = 'a'").selectExpr("sum(size(filter(split(text, ' '), x -> x <> '')))").first()[0] == sum(r.size * (r.rows * r.copies + r.more) for r in a if r.source == "a")


def test_targets_stop_at_three_times(spark):
    df = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx({"a": 30.0, "b": 1980 * 2 / 3, "c": 1980 / 3, None: 0.0})


# Ogg


def test_ogg_round_trip_and_damage():
    for n in (0, 1, 63, 64, 255, 4000, 65_025, 400_000):
        payload, size = media.payload_of(b"x" * n)
        got = media.decode(media.encode(payload, size))
        assert got["payload"] == payload and got["n_bytes"] == n and len(payload) % 64 == 0 and payload
    data = bytearray(media.encode(*media.payload_of(b"abc" * 5000)))
    data[200] ^= 1
    with pytest.raises(ValueError):
        media.decode(bytes(data))
    pages = media.pages_of([b"h", b"x" * 70_000, b"", b"z" * 255], [0, 1, 2, 3], 5)
    streams, bad = media.read_ogg(b"noise" + b"".join(pages))
    assert not bad and [len(p) for p in streams[5].packets] == [1, 70_000, 0, 255] and streams[5].granules[-1] == 3
    streams, _ = media.read_ogg(pages[0] + pages[2])
    assert streams[5].lost == 1


def test_ogg_query_columns(spark, tmp_path):
    texts = ["abc", None, "", "é" * 5000, "abc"]
    path = f"{tmp_path}/documents.parquet"
    docs_of(spark, texts).write.parquet(path)
    rows = {r.doc_id: r.asDict() for r in media.query(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts, 1):
        assert {k: rows[i][k] for k in media.expected(t)} == media.expected(t)
    assert {k: v for k, v in rows[1].items() if k != "doc_id"} == {k: v for k, v in rows[5].items() if k != "doc_id"}
    assert json.loads(rows[1]["feature"])["streams"] == 2


def test_ogg_null_and_damaged_values(spark):
    whole = media.encode(*media.payload_of(b"abc" * 3000))
    broken = bytearray(whole)
    broken[300] ^= 1
    df = spark.createDataFrame([(1, whole), (2, None), (3, bytes(broken)), (4, b""), (5, b"OggS"), (6, whole[:-40])], "doc_id long, media binary")
    got = {r.doc_id: (r.n_bytes, r.payload is None, r.media_error is None) for r in media.read_media(df).collect()}
    assert got == {1: (9000, False, True), **{i: (None, True, False) for i in range(2, 7)}}
    assert media.read_media(df.limit(0)).columns == ["doc_id", "media", "n_bytes", "payload", "feature", "media_error"]


# WARC


def test_warc_damaged_records_are_left_out(spark, tmp_path):
    record = lambda i, length=None: warc.record_bytes({"record_type": "response", "record_id": f"<urn:page:{i}>", "target_uri": "http://a", "refers_to": None, "payload_digest": "sha256:x", "payload_length": 300, "payload": b"p" * 300}, "2024-01-01T00:00:00Z") if length is None else record(i).replace(b"\r\nContent-Length: ", b"\r\nContent-Length: " + length, 1)
    good = [record(i) for i in (1, 2, 3)]
    members = [warc.member(x, 1) for x in good]
    files = {
        "length.warc": good[0] + record(8, b"x") + good[1], "cut.warc": good[2] + record(9)[:-100], "cut.warc.gz": gzip.compress(good[0] + good[1])[:-60],
        "member.warc.gz": members[0] + warc.member(record(8, b"-"), 1) + members[1][:60] + bytes(40) + members[1][100:] + members[2], "empty.warc": b"", "noise.warc": b"nothing here",
    }
    for name, data in files.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / name).write_bytes(data)
    ids = lambda name: sorted(r.record_id for r in warc.read(spark, f"file://{tmp_path}/{name}").select("record_id", "payload").collect())
    assert ids("length.warc") == ["urn:page:1", "urn:page:2"] and ids("cut.warc") == ["urn:page:3"]
    assert set(ids("cut.warc.gz")) <= {"urn:page:1", "urn:page:2"} and ids("member.warc.gz") == ["urn:page:1", "urn:page:3"]
    assert ids("empty.warc") == ids("noise.warc") == []


def test_warc_pushdown_and_plain_gzip(spark, tmp_path):
    warc.register(spark)
    body = "p" * 200
    pages = spark.createDataFrame([(2, "http://b", body), (1, "http://a", body), (3, None, "x"), (4, "u\nv", None), (5, "u", "x"), (1, "http://a", body), (None, "n", body)], "page_id long, url string, html string")
    records = warc.records_of(pages)
    for level in (0, 1):
        path = f"file://{tmp_path}/w{level}"
        records.write.format("warc").mode("append").option("path", path).option("level", str(level)).save()
        assert warc.read(spark, path).where("record_type = 'revisit'").select("record_id", "refers_to", "payload_length").collect() == [("urn:page:2", "urn:page:1", 200)]
        assert warc.read(spark, path).count() == 7 and warc.read(spark, path).where("target_uri LIKE 'http://%'").count() == 3
        assert warc.read(spark, path, payload="false").where("payload IS NOT NULL").count() == 0
    plain = b"".join(warc.record_bytes(r.asDict() | {"payload": bytes(r.payload) if r.payload is not None else None}, "2024-01-01T00:00:00Z") for r in records.collect())
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "a.warc.gz").write_bytes(gzip.compress(plain))
    plain_gzip = f"file://{tmp_path}/g"
    assert warc.read(spark, plain_gzip).count() == 7 and warc.read(spark, plain_gzip).where("record_type = 'response'").count() == 6


# Lines


def test_lines_runs_and_rules(spark):
    line = "this line is long enough to count"
    texts = [f"a\n{line}\nb", f"{line.upper()}  \n{line}\nx", f"\t{line}", "short\nshort", None, "", line + "\n" + "short", f"{line} not the same"]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(docs_of(spark, texts)).collect()}
    assert got == {1: (3, 1, "a\nb"), 2: (3, 2, "x"), 3: (1, 1, ""), 4: (2, 0, "short\nshort"), 5: (1, 0, ""), 6: (1, 0, ""), 7: (2, 0, texts[6]), 8: (1, 0, texts[7])}
    assert line_dedup.dedup_lines(docs_of(spark, texts).limit(0)).count() == 0


def test_line_runs_compact_and_tell_the_unseen(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    lines = lambda *hs: spark.createDataFrame([(h, 0, 10 - h) for h in hs], "h1 long, h2 long, id long")
    for batch in ((1, 2), (2, 3), (3, 4, 4)):
        runs.add(lines(*batch))
    assert len(runs.names()) == 2
    assert {(r.h1, r.n) for r in runs.keys().collect()} == {(1, 1), (2, 2), (3, 2), (4, 2)}
    assert [r.h1 for r in runs.unseen(lines(2, 5)).collect()] == [5]


# Pipeline


def test_pipeline_drops_near_duplicates_from_80_percent_on(spark):
    import corpus_pipeline

    base, texts = words(150, 61), []
    for k in range(12):
        own = list(base)
        for j in range(k % 6):
            own[10 + 25 * j] = f"x{k}y{j}"
        texts.append(" ".join(own))
    texts += [" ".join(words(150, 62)), None, ""]
    three = " ".join("z" if i in (40, 80, 120) else w for i, w in enumerate(words(150, 63)))
    texts += [" ".join(words(150, 63)), three]
    docs = docs_of(spark, texts)
    got = {r.doc_id for r in corpus_pipeline.without_near_duplicates(spark, docs, SMALL).collect()}
    assert got == {i for i, r in brute_components(dict(enumerate(texts, 1)), 80).items() if r[3]}
    assert len(texts) not in got


def test_pipeline_stages(spark):
    import corpus_pipeline
    from palimpsest.llm.common import written

    docs, kept = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SMALL), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            docs = out
        kept.append(out.count())
    assert kept[0] < 200 and kept[2] < kept[1] and kept[4] == kept[3]
    assert math.isclose(kept[3], sum(r[0] for r in docs.groupBy("doc_id").agg(F.count(F.lit(1))).select("count(1)").collect()))
