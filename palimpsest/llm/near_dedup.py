"""MinHash near-duplicate detection by fast similarity sketching.

A sketch has T coordinates. Round i hashes each element of a set to a bin and a value; a bin keeps the smallest value of
the first round that reaches it. From round T on, round T + b sends all elements to bin b, so that after 2 T rounds at most
every coordinate is filled; a set much larger than T fills them in one or two. Coordinates agree with a probability that is
the Jaccard similarity, and their number of agreements is concentrated as for independent ones. BANDS bands of ROWS
coordinates make candidates: at a similarity of 0.85 a pair misses all of them with a probability below 1e-7.

Documents with the same set are one class. In each bucket of a band a class is held against the bucket's centre alone, and
links are joined to components. Other pairs around a centre matter only if their components differ, and most of those are
ruled out before they are made. The two texts are described by how they differ from the centre c, as d(x), the symmetric
difference of x and c: two sets are similar enough only if d(x) and d(y) have about half of their elements in common, so with
elements in the order of how few texts around the centre have them, they share one of the first ones, at places that leave
enough common ones behind them; and one-bit sketches must agree as often as those of linked sets do. What is left is confirmed
on full sets. So a group of n near copies costs about n comparisons, and no candidate is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import free_names, table, written
from palimpsest.llm.graph import components

BANDS, ROWS = 28, 5
T = BANDS * ROWS
WORDS = 5
CACHED = 200_000
BATCH_BYTES = 4 << 20
EMPTY = np.uint64(2**64 - 1)
#: Standard deviations below the mean of linked sets at which agreements of one-bit sketches rule a pair out.
DEVIATIONS = 6


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: each bit of the result depends on each of x."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


SEEDS = mixed(np.arange(1, 2 * T + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class WordHashes(dict):
    """64-bit hashes of words; keeps those of the first CACHED words."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHED:
            self[word] = h
        return h


def shingle_sets(texts: list[bytes | None], hashes: WordHashes, words: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of `words` words; of fewer words all of them make one."""
    split = [(t or b"").lower().split() for t in texts]  # bytes: A-Z and ASCII white space alone
    counts = np.fromiter(map(len, split), np.int64, len(split))
    flat = np.fromiter((h for w in split for h in map(hashes.__getitem__, w)), np.uint64, int(counts.sum()))
    ends = np.cumsum(counts)
    p = np.uint64(0x9E3779B97F4A7C15)
    n = max(0, len(flat) - words + 1)
    runs = np.zeros(n, np.uint64)
    for k in range(words):
        runs = runs * p + flat[k : k + n]
    runs = mixed(runs)
    out = []
    for end, count in zip(ends.tolist(), counts.tolist(), strict=True):
        if count >= words:
            own = np.sort(runs[end - count : end - words + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif count:
            h = 0
            for x in flat[end - count : end].tolist():
                h = (h * int(p) + x) % 2**64
            out.append(mixed(np.array([h ^ (count << 56)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of T coordinates for each set; those of empty sets stay EMPTY."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    out = np.full((len(sets), T), EMPTY, np.uint64)
    flat, owner = (np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)), np.repeat(np.arange(len(sets)), sizes)
    for i in range(2 * T):
        if not len(flat):
            break
        h = mixed(flat ^ SEEDS[i])
        value = (h & np.uint64(0xFFFFFFFF)) | np.uint64(i << 32)
        if i < T:
            at = ((h >> np.uint64(32)) * np.uint64(T)) >> np.uint64(32)
            np.minimum.at(out.reshape(-1), owner * T + at.astype(np.int64), value)
        else:
            np.minimum.at(out[:, i - T], owner, value)
        open_ = (out == EMPTY).any(axis=1)[owner]
        if not open_.all():
            flat, owner = flat[open_], owner[open_]
    return out


def band_hashes(sketch: np.ndarray) -> np.ndarray:
    """A hash for each band, which tells bands apart."""
    parts = sketch.reshape(len(sketch), BANDS, ROWS)
    h = np.broadcast_to(mixed(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(sketch), BANDS)).copy()
    for k in range(ROWS):
        h = mixed(h ^ parts[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
    return h.view(np.int64)


def low_bits(sketch: np.ndarray) -> np.ndarray:
    """The last bit of each coordinate, in rows of longs; those after the last coordinate are 0."""
    bits = np.zeros((len(sketch), -(-T // 64) * 64), np.uint8)
    bits[:, :T] = sketch & np.uint64(1)
    return np.packbits(bits, axis=1).view(np.int64)


def _parts(values: list) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, v in enumerate(values):
        size += len(v or b"")
        if size >= BATCH_BYTES or i + 1 == len(values):
            yield first, i + 1
            first, size = i + 1, 0


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows).view(np.int64) if rows else np.zeros(0, np.int64)))


def _set_id(own: np.ndarray) -> bytes | None:
    """128 bits of a set; none for the empty one."""
    return xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None


def sketch(docs: DataFrame) -> DataFrame:
    """docs of id, th, text -> id, th, n (shingles), set_id (of the set; null without words), bands, bits (of the sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            ids, ths, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            for a, b in _parts(texts):
                sets = shingle_sets(texts[a:b], hashes)
                rows = sketches(sets)
                bands, bits = band_hashes(rows), low_bits(rows)
                rows = [r if len(s) else r[:0] for r, s in zip(bands, sets, strict=True)]
                yield pa.RecordBatch.from_arrays([ids[a:b], ths[a:b], pa.array([len(s) for s in sets], pa.int64()), pa.array(map(_set_id, sets), pa.binary()), _lists(rows), _lists(list(bits))], ["id", "th", "n", "set_id", "bands", "bits"])

    return docs.select("id", "th", F.col("text").cast("binary").alias("text")).mapInArrow(run, "id long, th long, n long, set_id binary, bands array<long>, bits array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """docs of id, text -> id, set_id, shingles: the whole set of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in _parts(texts):
                sets = shingle_sets(texts[a:b], hashes)
                yield pa.RecordBatch.from_arrays([ids[a:b], pa.array(map(_set_id, sets), pa.binary()), _lists(sets)], ["id", "set_id", "shingles"])

    return docs.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "id long, set_id binary, shingles array<long>")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose sets are similar enough."""
    one, two = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(one, "a").join(two, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return both.where(100 * F.col("common") >= percent * (F.size("sa") + F.size("sb") - F.col("common"))).select("a", "b")


def _around(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """For pairs of a centre c and a class x: n and n_c (sizes), common."""
    one, two = sets.select(F.col("id").alias("x"), F.col("shingles").alias("sx")), sets.select(F.col("id").alias("c"), F.col("shingles").alias("sc"))
    both = pairs.join(one, "x").join(two, "c")
    return both.select("c", "x", F.size("sx").alias("n"), F.size("sc").alias("n_c"), F.size(F.array_intersect("sx", "sc")).alias("common"))


def _others(around: DataFrame, found: DataFrame, sets: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The pairs of classes around one centre, in different components, that may be linked.

    With f = (100 - percent) / (100 + percent), x and y are linked if and only if the symmetric difference of d(x) and d(y)
    has f * (n(x) + n(y)) elements at most, so that `need` = half of |d(x)| + |d(y)| - f * (n(x) + n(y)) are common. One of
    the two is not linked with the centre itself, hence need > 0; and as |d(y)| >= n(y) - n(c), no partner y needs less of x
    than half of |d(x)| - f * (n(x) + n(c)), which bounds the elements of x that are looked at.
    """
    labels = found.select(F.col("v").alias("x"), "comp")
    members = around.join(labels, "x", "left").withColumn("comp", F.coalesce("comp", "x"))
    own = around.select("c").distinct().join(labels.withColumnRenamed("x", "c"), "c", "left").select("c", F.coalesce("comp", "c").alias("comp"))
    parts = members.select("c", "comp").unionByName(own).groupBy("c", "comp").agg(F.count(F.lit(1)).alias("k"))
    split = parts.groupBy("c").agg(F.max(F.struct("k", "comp")).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("c", F.col("top.comp").alias("top"))
    members = members.join(split, "c").withColumn("main", F.col("comp") == F.col("top")).select("c", "x", "n", "n_c", "comp", "main")
    # A centre that has all its members in its own component but for one has no two members to hold against each other.
    several = members.groupBy("c").agg(F.count_if(~F.col("main")).alias("out"), F.count(F.lit(1)).alias("k")).where("out > 0 AND k > 1").select("c")
    one, two = sets.select(F.col("id").alias("x"), F.col("shingles").alias("sx")), sets.select(F.col("id").alias("c"), F.col("shingles").alias("sc"))
    differing = F.concat(F.array_except("sx", "sc"), F.array_except("sc", "sx"))
    members = members.join(several, "c", "left_semi").join(one, "x").join(two, "c").join(bits.select(F.col("id").alias("x"), "bits"), "x")
    members = written(members.select("c", "x", "n", "n_c", "comp", "main", "bits", differing.alias("d")), "differing")
    each = members.select("c", "x", F.explode("d").alias("t"))
    shared = each.groupBy("c", "t").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    each = each.join(shared, ["c", "t"]).groupBy("c", "x").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("d_shared"))
    # Elements that no other text has come first; they take up places, and make no pairs.
    f, size = (100 - percent) / (100 + percent), F.size("d")
    kept = size - F.ceil((size - f * (F.col("n") + F.col("n_c"))) / 2 - 1e-9).cast("int") + 1
    alone = size - F.size("d_shared")
    first = members.join(each, ["c", "x"]).select("c", "x", "n", "comp", "main", "bits", size.alias("size"), alone.alias("alone"), F.slice("d_shared.t", 1, F.greatest(F.lit(0), F.least(kept, size) - alone)).alias("first"))
    rows = written(first.select("c", "x", "n", "comp", "main", "bits", "size", "alone", F.posexplode("first").alias("at", "t")).withColumn("left", F.col("size") - F.col("alone") - F.col("at")).drop("alone", "at"), "prefixes")
    a = rows.where("NOT main").select("c", "t", *[F.col(k).alias(f"{k}_a") for k in ("x", "n", "comp", "bits", "size", "left")])
    b = rows.select("c", "t", "main", *[F.col(k).alias(f"{k}_b") for k in ("x", "n", "comp", "bits", "size", "left")])
    need = (100 + percent) * (F.col("size_a") + F.col("size_b")) - (100 - percent) * (F.col("n_a") + F.col("n_b"))
    fit = (F.col("comp_a") != F.col("comp_b")) & (F.col("main") | (F.col("x_a") < F.col("x_b"))) & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    fit &= 2 * (100 + percent) * F.least("left_a", "left_b") >= need
    # Of T bits, linked sets have (1 + similarity) / 2 in common in the mean.
    p = (1 + percent / 100) / 2
    most = T * (1 - p) + DEVIATIONS * (T * p * (1 - p)) ** 0.5
    fit &= sum(F.bit_count(F.get("bits_a", F.lit(i)).bitwiseXOR(F.get("bits_b", F.lit(i)))) for i in range(-(-T // 64))) <= most
    return a.join(b, ["c", "t"]).where(fit).select(F.least("x_a", "x_b").alias("a"), F.greatest("x_a", "x_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """id, n_shingles, component_id, kept for each document.

    Linked are documents with 100 * |common| >= percent * |union|; component_id is the smallest id that links lead to, and
    kept is whether it is the document's own. Null and empty texts and those of white space alone have no shingles and are
    linked with nothing. Rows that repeat an id are documents of their own, each with its links, so that rows of one id may
    have different components; those without an id are linked with nothing,
    have no component_id, and are kept.
    """
    return _labelled(docs, id_col, text_col, percent).drop("th")


def _labelled(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """The rows of near_duplicates, with th, the hash of the text."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    all_rows = written(sketch(texts).withColumn("row", F.monotonically_increasing_id()), "sketches")
    linked = all_rows.where("n > 0 AND id IS NOT NULL")
    # A class is named by one of its rows, since classes of different sets may have the same smallest id.
    classes = linked.groupBy("set_id").agg(F.min(F.struct("id", "row")).alias("first")).select("set_id", F.col("first.id").alias("least"), F.col("first.row").alias("rep"))
    own = F.col("row") == F.col("rep")
    members = linked.join(classes, "set_id").select("id", "th", "n", "rep", "least", *[F.when(own, F.col(c)).alias(c) for c in ("set_id", "bands", "bits")])
    members = written(members, "members")
    first = members.where("bands IS NOT NULL")

    banded = first.select("rep", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.count(F.lit(1)).alias("k")).where("low < high").select("band", "k")
    met = written(banded.join(shared, "band"), "buckets")
    # The centre of a bucket is the class that meets most others: of a text and its altered copies, the text itself.
    degree = met.groupBy("rep").agg(F.sum("k").alias("degree"))
    centres = met.join(degree, "rep").groupBy("band").agg(F.max(F.struct("degree", (-F.col("rep")).alias("less"))).alias("best")).select("band", (-F.col("best.less")).alias("c"))
    stars = written(met.join(centres, "band").where("rep <> c").select("c", F.col("rep").alias("x")).distinct(), "stars")
    wanted = stars.select("x").unionByName(stars.select(F.col("c").alias("x"))).distinct().join(first.select(F.col("rep").alias("x"), "id", "set_id"), "x")
    sets = full_sets(texts.join(wanted.hint("shuffle_hash"), "id", "left_semi")).join(wanted, ["id", "set_id"])
    sets = written(sets.select(F.col("x").alias("id"), "shingles").dropDuplicates(["id"]), "sets")

    around = written(_around(stars, sets), "around")
    union = F.col("n") + F.col("n_c") - F.col("common")
    links = around.where(100 * F.col("common") >= percent * union).select(F.col("c").alias("a"), F.col("x").alias("b"))
    found = components(links)
    bits = first.select(F.col("rep").alias("id"), "bits")
    pairs = _others(around, found.withColumnRenamed("c", "comp"), sets, bits, percent)
    more = written(_links(pairs, sets, percent), "links")
    if not more.isEmpty():
        found = components(links.unionByName(more))
    named = found.join(first.select(F.col("rep").alias("v"), "least"), "v")
    named = named.join(named.groupBy("c").agg(F.min("least").alias("component_id")), "c").select(F.col("v").alias("rep"), "component_id")
    final = members.join(named, "rep", "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "least").alias("component_id"), "th")
    alone = all_rows.where("n = 0 OR id IS NULL").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), "th")
    return final.unionByName(alone).select("id", "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"), "th")


def without_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """docs with one document of each group. Of rows that repeat an id those go whose own text has a smaller id beside it."""
    of, th = free_names(docs, "lost_id", "lost_hash")
    lost = _labelled(docs, id_col, text_col, percent).where("NOT kept").select(F.col("id").alias(of), F.col("th").alias(th)).distinct()
    return docs.join(lost.hint("shuffle_hash"), (F.col(id_col) == F.col(of)) & (F.xxhash64(F.col(text_col)) == F.col(th)), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


ORACLE = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
    FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END AS s
    FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least_of AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(l.c, s.doc_id)) AS component_id,
    s.doc_id = least(s.doc_id, coalesce(l.c, s.doc_id)) AS kept
FROM sets s LEFT JOIN least_of l ON s.doc_id = l.a
"""
