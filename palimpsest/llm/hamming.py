"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into m segments, each with an index of its own. Once the first j segments have been searched to radius r and the
others to r - 1, all codes within m * r + j - 1 bits have been verified: two codes that differ in no more bits than that differ
in at most r bits in one of the first j segments, or in at most r - 1 in one of the others. Radii grow round by round, and in a
round a query searches only as many segments as the distance of its k-th verified neighbour so far asks for; it is done when
that distance is covered. No code is looked at that no segment has led to.

A key's first bits say in which part of its segment's index it lies. A query is sent to the parts that are up to r bits from its
own, and looks up there the keys that differ in what is left of r in the other bits. Parts are dealt over tasks in pieces of
about PIECE codes; a task returns of each query the k nearest that it has met, so that neither keys nor candidates are shuffled.
"""

from __future__ import annotations

import math
from functools import cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import table, written

PIECE, ASKED, SPREAD = 8192, 65536, 3
MOST = 1 << 20


def sign_code(vector: Column) -> Column:
    """The signs of a vector's coordinates, 1 for above 0, in words of 64 bits; null for null and empty vectors."""
    bit = F.transform(vector, lambda x: F.when((x > 0) & ~F.isnan(x), F.lit(1)).otherwise(0))
    words = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(vector) - 1) / 64).cast("int")),
        lambda w: F.aggregate(F.slice(bit, w * 64 + 1, 64), F.struct(F.lit(0).cast("long").alias("word"), F.lit(0).alias("at")), lambda a, b: F.struct(a.word.bitwiseOR(F.call_function("shiftleft", b.cast("long"), a["at"])).alias("word"), (a["at"] + 1).alias("at")), lambda a: a.word),
    )
    return F.when(F.size(vector) > 0, words)


def segments(bits: int, rows: int) -> list[tuple[int, int, int]]:
    """(word, first bit, width) of the segments: about log2(rows) bits each, none over two words, none above 32."""
    out = []
    for word in range(0, -(-bits // 64)):
        size = min(64, bits - 64 * word)
        parts = max(1, round(size / min(32.0, max(1.0, math.log2(max(rows, 2))))), -(-size // 32))
        edges = [size * i // parts for i in range(parts + 1)]
        out += [(word, a, b - a) for a, b in zip(edges, edges[1:], strict=False) if b > a]
    return out


def _keys(cuts: list[tuple[int, int, int]], code: str = "code") -> Column:
    """An array of (segment, width, key) of a code."""
    parts = [F.struct(F.lit(i).alias("segment"), F.lit(w).alias("width"), F.shiftrightunsigned(F.coalesce(F.get(code, F.lit(word)), F.lit(0).cast("long")), a).bitwiseAND((1 << w) - 1).alias("key")) for i, (word, a, w) in enumerate(cuts)]
    return F.array(*parts)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query, ties by id."""
    order = W.partitionBy("query").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, id, distance: the k rows of vectors nearest to each of queries, itself excluded, ties by id.

    Rows without an id or a vector are neither found nor ask. Vectors of other lengths count as filled up with zeros. Rows
    that repeat an id with its code count once; an id with several codes is found with each of them. With fewer than k
    others, all are returned.
    """
    def coded(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("id"), sign_code(F.col(vector_col)).alias("code")).where("id IS NOT NULL AND code IS NOT NULL").distinct()

    rows = written(coded(vectors), "codes")
    asked = written(coded(queries), "queries")
    # Of each code as many ids as any answer can need: a hot code is cut down before it moves.
    first = rows.withColumn("nth", F.row_number().over(W.partitionBy("code").orderBy("id"))).where(F.col("nth") <= k + 1)
    first = written(first, "first-ids")
    n, words, ids = first.agg(F.count(F.when(F.col("nth") == 1, 1)), F.max(F.size("code")), F.count(F.lit(1))).first()
    cuts = segments(64 * (words or 1), n)
    m = len(cuts)
    tops = _tops(cuts, n)
    index, sizes = _index(first, cuts, tops, words) if n else (None, None)
    pending = asked.select(F.col("code").alias("query"), F.lit(m).alias("need"), F.lit(64 * (words or 1)).alias("far")).distinct()
    left = asked.count()
    answers, best, r = None, None, 0
    while n:
        hits = _hits(pending, index, sizes, cuts, tops, words, r, k, -(-left // ASKED))
        best = written(_best((hits if best is None else hits.unionByName(best)).distinct(), k + 1), "best")
        state = pending.drop("far").join(best.groupBy("query").agg(F.count(F.lit(1)).alias("found"), F.max("distance").alias("far")), "query", "left")
        covered = m * r + F.col("need") - 1
        whole = (F.col("found") > k) & (F.col("far") <= covered) | (F.col("found") == ids) | F.lit(r >= max(w for _, _, w in cuts))
        # Of the next radius a query needs as many segments as its k-th neighbour so far is beyond what all have covered.
        need = F.when(F.col("found") > k, F.least(F.lit(m), F.col("far") - (m * (r + 1) - 1))).otherwise(m)
        far = F.when(F.col("found") > k, F.col("far")).otherwise(64 * words)
        state = written(state.select("query", F.coalesce(whole, F.lit(False)).alias("done"), need.cast("int").alias("need"), far.alias("far")), "pending")
        own = best.join(state.where("done").select("query"), "query", "left_semi")
        answers = own if answers is None else answers.unionByName(own)
        pending = state.where("NOT done").select("query", "need", "far")
        left = pending.count()
        if not left:
            break
        best = best.join(pending.select("query"), "query", "left_semi")
        r += 1
    if answers is None:
        answers = vectors.sparkSession.createDataFrame([], "query array<bigint>, distance int, id long")
    per = asked.select(F.col("id").alias("query_id"), F.col("code").alias("query")).join(answers, "query").where("query_id <> id")
    order = W.partitionBy("query_id", "query").orderBy("distance", "id")
    return per.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def probes(pending: DataFrame, cuts: list[tuple[int, int, int]], r: int) -> DataFrame:
    """query, segment, key, and what else pending has: for the first `need` segments of each query all keys at r bits from its own."""
    kept = [c for c in pending.columns if c != "need"]
    rows = pending.select(*kept, "need", F.explode(_keys(cuts, "query")).alias("s")).where("s.segment < need").select(*kept, "s.*", F.lit(-1).alias("top"))
    for _ in range(r):
        # Bits are flipped in rising order, so that each key comes once.
        rows = rows.where("top < width - 1").withColumn("bit", F.explode(F.sequence(F.col("top") + 1, F.col("width") - 1)))
        rows = rows.select(*kept, "segment", "width", F.expr("key ^ shiftleft(1L, bit)").alias("key"), F.col("bit").alias("top"))
    return rows.select(*kept, "segment", "key")


def _tops(cuts: list[tuple[int, int, int]], rows: int) -> list[tuple[int, int, int]]:
    """The first bits of each segment, as many as part its codes into pieces of about PIECE."""
    bits = max(SPREAD, math.ceil(math.log2(max(rows / PIECE, 1))))
    return [(word, a + w - min(w, bits), min(w, bits)) for word, a, w in cuts]


def _words(code: str, words: int, prefix: str) -> list[Column]:
    return [F.coalesce(F.get(code, F.lit(i)), F.lit(0).cast("long")).alias(f"{prefix}{i}") for i in range(words)]


def _index(first: DataFrame, cuts: list, tops: list, words: int) -> tuple[DataFrame, DataFrame]:
    """segment, part, piece, id and a code's words, a row for each id and segment; and the pieces of each part."""
    rows = first.select("id", "code", F.explode(_keys(tops)).alias("s")).select("s.segment", F.col("s.key").alias("part"), "id", "code")
    sizes = written(rows.groupBy("segment", "part").agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("pieces")), "parts")
    rows = rows.join(sizes, ["segment", "part"]).select("segment", "part", F.pmod(F.xxhash64("code"), "pieces").cast("int").alias("piece"), "id", *_words("code", words, "w"))
    return written(rows, "segments"), sizes


PLACE = ["segment", "part", "piece", "block"]
HITS = "query array<bigint>, distance int, id long"


def _hits(pending: DataFrame, index: DataFrame, sizes: DataFrame, cuts: list, tops: list, words: int, r: int, k: int, blocks: int) -> DataFrame:
    """HITS: of the codes with a segment at r bits from a query's, the k + 1 nearest in each piece."""
    far = [probes(pending, tops, i).withColumn("left", F.lit(r - i)) for i in range(min(r, max(w for _, _, w in tops)) + 1)]
    asks = reduce(DataFrame.unionByName, far).withColumnRenamed("key", "part").join(sizes, ["segment", "part"])
    asks = asks.select("segment", "part", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block"), "left", "far", "query", *_words("query", words, "q"))
    # As many queries as a task should hold at once meet a piece; with more, each block of them has it.
    there = index.withColumn("block", F.lit(0)) if blocks == 1 else index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    shape = [(word, a, w - top) for (word, a, w), (_, _, top) in zip(cuts, tops, strict=True)]
    return asks.groupBy(*PLACE).cogroup(there.groupBy(*PLACE)).applyInArrow(lambda x, y: _look(x, y, shape, words, k), HITS)


@cache
def _masks(bits: int, r: int) -> np.ndarray:
    return np.array([sum(1 << i for i in at) for at in combinations(range(bits), r)], np.uint64)


def _look(asks: pa.Table, piece: pa.Table, shape: list[tuple[int, int, int]], words: int, k: int) -> pa.Table:
    """HITS of the queries of asks in a piece of the index; shape has (word, first bit, width) of each segment's last bits.

    A radius with more keys than the piece holds is held against the keys that are there.
    """
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64))]
    if asks.num_rows and piece.num_rows:
        ids, far, left = piece["id"].to_numpy(), asks["far"].to_numpy(), asks["left"].to_numpy()
        mine = [piece[f"w{i}"].to_numpy().view(np.uint64) for i in range(words)]
        theirs = [asks[f"q{i}"].to_numpy().view(np.uint64) for i in range(words)]
        word, a, width = shape[asks["segment"][0].as_py()]
        last = lambda code: (code >> np.uint64(a)) & np.uint64((1 << width) - 1)
        own, asked, again = last(mine[word]), last(theirs[word]), len(np.unique(ids)) < len(ids)
        by = np.argsort(own)
        keys, begins = np.unique(own[by], return_index=True)
        counts = np.diff(begins, append=len(by))
        for bits in np.unique(left):
            todo, several = np.flatnonzero(left == bits), math.comb(width, int(bits))
            step = max(1, MOST // max(min(several, len(keys)), len(by)))
            for s in range(0, len(todo), step):
                some = todo[s : s + step]
                if several > len(keys):
                    x, y = np.nonzero(np.bitwise_count(asked[some][:, None] ^ keys) == bits)
                else:
                    wanted = asked[some][:, None] ^ _masks(width, int(bits))
                    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                    x, y = np.nonzero(keys[at] == wanted)
                    y = at[x, y]
                n = counts[y]
                x, y = np.repeat(some[x], n), by[np.arange(n.sum()) + np.repeat(begins[y] - np.cumsum(n) + n, n)]
                d = sum(np.bitwise_count(mine[i][y] ^ theirs[i][x]).astype(np.int32) for i in range(words))
                near = d <= far[x]
                out.append(_nearest(x[near], d[near], ids[y[near]], k, again))
    x, d, i = (np.concatenate(c) for c in zip(*out, strict=True))
    return pa.table({"query": asks["query"].take(pa.array(x)), "distance": pa.array(d), "id": pa.array(i)})


def _nearest(x: np.ndarray, d: np.ndarray, ids: np.ndarray, k: int, again: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k + 1 least of (d, id) for each x; with again, an id may come more than once and counts once for each d."""
    if len(x) and not again:
        # Beyond the distance that k + 1 rows of x have nothing needs to be sorted.
        at, most = x - x.min(), int(d.max()) + 1
        upto = np.bincount(at * most + d, minlength=(int(at.max()) + 1) * most).reshape(-1, most).cumsum(axis=1)
        keep = d <= np.where(upto[:, -1] > k, (upto > k).argmax(axis=1), most)[at]
        x, d, ids = x[keep], d[keep], ids[keep]
    by = np.lexsort((ids, d, x))
    x, d, ids = x[by], d[by], ids[by]
    if again and len(x):
        new = np.append(True, (x[1:] != x[:-1]) | (d[1:] != d[:-1]) | (ids[1:] != ids[:-1]))
        x, d, ids = x[new], d[new], ids[new]
    keep = np.arange(len(x)) - np.searchsorted(x, x) <= k
    return x[keep], d[keep], ids[keep]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = search(vectors, vectors.where(F.col("vec_id") % 20 == 0))
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), F.col("id").alias("vec_id"), F.col("distance").cast("long").alias("distance"))


ORACLE = """
WITH c AS (SELECT vec_id, [x > 0 for x in embedding] AS s FROM embeddings),
p AS (
    SELECT q.vec_id AS query_id, v.vec_id, len(list_filter(range(1, 65), lambda i: q.s[i] <> v.s[i]))::BIGINT AS distance
    FROM c q JOIN c v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
"""
