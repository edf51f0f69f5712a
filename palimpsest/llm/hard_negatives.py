"""Hard-negative mining by angular triangle filtering.

Each vector keeps its angles to `references` directions. For an anchor a and a row x, the angle between them is at least the
largest |angle(a, d) - angle(x, d)| and at most the smallest angle(a, d) + angle(x, d), over all directions d; the cosines of
the two, times both norms and with a margin for rounding, bound the integer score. Rows lie in blocks of one label and one
nearest direction, sorted by their angle to it, and anchors in groups of one label. The blocks' and groups' ranges of angles
and norms are compared first; of a pair of group and block that may matter, an anchor takes the window of rows whose angle to
the block's direction lies near enough to its own, the bounds of all directions thin the window out, and only what is left
gets its integer score. Three rounds: a near block of its own label gives each anchor a first bound for its positives, all
blocks of its label give the positives, and their scores make the windows that negatives must lie in.

Blocks and groups have bounded sizes and are written once; ranges alone are compared pair by pair, and a group's rows travel
to a block only if their ranges meet. No group of equal labels or equal vectors meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import partitions, table, written

#: Rows of a block, anchors of a group, directions, and the bounded sample of rows from which directions are taken.
BLOCK, GROUP, REFERENCES, SAMPLE = 1024, 64, 16, 1024
#: Far above the rounding error of an angle that comes from a cosine (1.5e-8).
MARGIN = 1e-6
EXACT = 2**53
ROWS = "id long, label long, q binary, norm double, angles binary, near int, turn double"
PACKED = "label long, near int, ids array<bigint>, q binary, norms binary, angles binary, low array<double>, high array<double>, least double, most double"


def whole_numbers(vectors: list[list[float]], scale: float = 256.0) -> np.ndarray:
    """floor(scale * x) for vectors of any lengths, filled up with zeros; Python integers where 64 bits do not hold them."""
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    out = np.floor(out * scale)
    return out.astype(np.int64) if not out.size or np.abs(out).max() < 2**62 else np.array([[int(x) for x in r] for r in out], object)


def scores(rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Integer inner products. Doubles where they are exact, else 64 bits, else Python's integers, held to 64 bits at last."""
    if not len(rows):
        return np.zeros(0, np.int64)
    width = min(rows.shape[1], len(anchor))
    rows, anchor = rows[:, :width], anchor[:width]
    most = width * (int(abs(rows).max()) if width else 0) * (int(abs(anchor).max()) if width else 0)
    if most < EXACT:
        return (rows.astype(float) @ anchor.astype(float)).astype(np.int64)
    if most < 2**63:
        return rows @ anchor
    return np.array([max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(r, anchor, strict=True)))) for r in rows], np.int64)


def angles_to(q: np.ndarray, norms: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """The angle of each row to each direction; 0 for rows of norm 0, whose score is 0 whatever the angle."""
    dims = directions.shape[1]
    rows = np.zeros((len(q), dims))
    rows[:, : min(dims, q.shape[1])] = q[:, :dims]  # what lies beyond the directions' length is at a right angle to them
    cosine = np.divide(rows @ directions.T, norms[:, None], out=np.ones((len(q), len(directions))), where=norms[:, None] > 0)
    return np.arccos(np.clip(cosine, -1, 1))


def directions_of(sample: list[list[float]], count: int = REFERENCES) -> np.ndarray:
    """Up to `count` unit vectors of a sample, each the farthest from those before it; the first axis where there is none."""
    q = whole_numbers(sample).astype(float)
    norms = np.linalg.norm(q, axis=1)
    unit = q[norms > 0] / norms[norms > 0][:, None]
    if not len(unit):
        return np.eye(1)
    taken, near = [0], unit @ unit[0]
    while len(taken) < min(count, len(unit)) and near.min() < 1 - 1e-9:
        taken.append(int(near.argmin()))
        near = np.maximum(near, unit @ unit[taken[-1]])
    return unit[taken]


def _bytes(a: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in np.ascontiguousarray(a)]


def _placed(rows: DataFrame, directions: np.ndarray) -> DataFrame:
    """rows of id, label, vector -> ROWS: whole numbers, norm, angles, the nearest direction and the angle to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = whole_numbers(batch.column(2).to_pylist())
            norms = np.linalg.norm(q.astype(float), axis=1)
            angles = angles_to(q.astype(float), norms, directions)
            near = angles.argmin(axis=1).astype(np.int32)
            packed = _bytes(q.astype(np.int64)) if q.dtype != object else [b"".join(x.to_bytes(136, "little", signed=True) for x in r) + b"\0" for r in q.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary()), pa.array(norms), pa.array(_bytes(angles), pa.binary()), pa.array(near), pa.array(angles[np.arange(len(q)), near])], ["id", "label", "q", "norm", "angles", "near", "turn"])

    return rows.select("id", "label", "vector").mapInArrow(run, ROWS)


def _numbers(packed: list[bytes]) -> np.ndarray:
    """The whole numbers of rows, filled up with zeros to one length. A row of odd length is one of Python's integers."""
    rows = [[int.from_bytes(p[k : k + 136], "little", signed=True) for k in range(0, len(p) - 1, 136)] if len(p) % 8 else np.frombuffer(p, np.int64) for p in packed]
    out = np.zeros((len(rows), max(map(len, rows), default=0)), object if any(len(p) % 8 for p in packed) else np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _joined(packed: list[bytes]) -> bytes:
    """Rows one after another, each with its length before it."""
    return b"".join(len(p).to_bytes(8, "little") + p for p in packed)


def _parted(joined: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(joined):
        n = int.from_bytes(joined[at : at + 8], "little")
        out.append(joined[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def packed(rows: DataFrame, size: int) -> DataFrame:
    """ROWS -> PACKED: runs of up to `size` rows of one label and nearest direction, in the order of their angle to it.

    Rows are dealt out by ranges, to the id, so that equal vectors may lie in several blocks; low and high are the ranges of
    angles to all directions, least and most those of norms.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def out(part: pd.DataFrame) -> pd.DataFrame:
            angles = np.frombuffer(b"".join(part["angles"]), float).reshape(len(part), -1)
            one = {"label": part["label"].iloc[0], "near": part["near"].iloc[0], "ids": part["id"].to_numpy(np.int64), "q": _joined(part["q"].tolist()), "norms": part["norm"].to_numpy(float).tobytes(), "angles": angles.tobytes()}
            return pd.DataFrame([one | {"low": angles.min(axis=0), "high": angles.max(axis=0), "least": part["norm"].min(), "most": part["norm"].max()}])

        for frame in frames:
            for _, part in frame.groupby(["label", "near"], sort=False):
                if held and (held[0]["label"].iloc[0], held[0]["near"].iloc[0]) != (part["label"].iloc[0], part["near"].iloc[0]):
                    yield out(pd.concat(held))
                    held = []
                held.append(part)
                whole = pd.concat(held)
                while len(whole) >= size:
                    yield out(whole.iloc[:size])
                    whole = whole.iloc[size:]
                held = [whole] if len(whole) else []
        if held:
            yield out(pd.concat(held))

    order = ["label", "near", "turn", "id"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(run, PACKED)


def _bounds(group: str, block: str) -> tuple[Column, Column]:
    """The least and the largest score that rows of a block can have with anchors of a group, from their ranges alone."""
    g, b = lambda c: F.col(f"{group}.{c}"), lambda c: F.col(f"{block}.{c}")
    apart = F.zip_with(F.zip_with(g("low"), b("high"), lambda x, y: x - y), F.zip_with(b("low"), g("high"), lambda x, y: x - y), lambda x, y: F.greatest(x, y))
    gap = F.greatest(F.lit(0.0), F.array_max(apart) - MARGIN)
    most = F.least(F.lit(float(np.pi)), F.array_min(F.zip_with(g("high"), b("high"), lambda x, y: x + y)) + MARGIN)
    times = lambda cosine, up: F.when((cosine >= 0) == F.lit(up), cosine * g("most") * b("most")).otherwise(cosine * g("least") * b("least"))
    low, high = times(F.cos(most), False), times(F.cos(gap), True)
    return low - F.abs(low) * 1e-9 - 1, high + F.abs(high) * 1e-9 + 1


FOUND = "anchor_id long, positive_id long, positive_score long, id long, score long"


def _windows(group: dict, block: dict, k: int) -> Iterator[tuple]:
    """(anchor, positive, positive's score, id, score): for each wish of each anchor the first k rows of a block that meet it.

    A wish is (positive's id, positive's score, low, high). For positives it is one, without a positive, and without an end.
    """
    ids, norms = np.array(block["ids"], np.int64), np.frombuffer(block["norms"], float)
    angles = np.frombuffer(block["angles"], float).reshape(len(ids), -1)
    q, anchors = _numbers(_parted(block["q"])), _numbers(_parted(group["q"]))
    anchor_norms, anchor_angles = np.frombuffer(group["norms"], float), np.frombuffer(group["angles"], float).reshape(len(anchors), -1)
    turn = angles[:, block["near"]]
    for i, (anchor, wishes) in enumerate(zip(group["ids"], group["wishes"], strict=True)):
        if not len(wishes):
            continue
        low, high = min(w["low"] for w in wishes), max(w["high"] for w in wishes)
        reach, own = anchor_norms[i] * block["most"], anchor_angles[i]
        # A score of `low` or more asks for an angle of `wide` at most, so that the angles to one direction differ by no more.
        wide = np.arccos(min(1.0, low / reach) if reach > 0 else 1.0) + MARGIN if low > 1 else np.pi
        a, b = np.searchsorted(turn, own[block["near"]] - wide, "left"), np.searchsorted(turn, own[block["near"]] + wide, "right")
        if a == b:
            continue
        both = anchor_norms[i] * norms[a:b]
        top = np.cos(np.maximum(0, np.abs(angles[a:b] - own).max(axis=1) - MARGIN)) * both
        bottom = np.cos(np.minimum(np.pi, (angles[a:b] + own).min(axis=1) + MARGIN)) * both
        open_ = np.flatnonzero((top + np.abs(top) * 1e-9 + 1 >= low) & (bottom - np.abs(bottom) * 1e-9 - 1 <= high) & (ids[a:b] != anchor)) + a
        found, of = scores(q[open_], anchors[i]), ids[open_]
        by = np.lexsort((of, -found))
        found, of = found[by], of[by]
        for w in wishes:
            if w["positive"] is None:
                fit = found >= w["low"]
            else:
                p = int(w["score"])
                up = found <= p
                # 80 * p <= 100 * score, in whole numbers that do not overflow.
                fit = up & (found >= -(-4 * p // 5))
            for j in np.flatnonzero(fit)[:k].tolist():
                yield anchor, w["positive"], w["score"], int(of[j]), int(found[j])


def _met(groups: DataFrame, blocks: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """FOUND for pairs (group, block): groups travel to blocks, and each of the two is bounded in rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if out := list(_windows(r["g"], r["b"], k)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["anchor_id", "positive_id", "positive_score", "id", "score"])

    asks = pairs.join(groups.select("group", F.struct("ids", "q", "norms", "angles", "wishes").alias("g")), "group")
    both = asks.join(blocks.select("block", F.struct("ids", "q", "norms", "angles", "near", "most").alias("b")), "block").select("g", "b")
    return written(both.mapInArrow(run, FOUND), "met")


def _first(found: DataFrame, k: int, by: list[str]) -> DataFrame:
    """The k first of each group of FOUND, with their rank."""
    order = W.partitionBy(*by).orderBy(F.col("score").desc(), F.col("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _with_wishes(groups: DataFrame, wishes: DataFrame) -> DataFrame:
    """groups with wishes: for each of their anchors an array of (positive, score, low, high), and their range as a whole."""
    anchors = groups.select("group", F.posexplode("ids").alias("at", "anchor"))
    each = anchors.join(wishes.groupBy(F.col("anchor_id").alias("anchor")).agg(F.collect_list("wish").alias("wishes")), "anchor", "left")
    each = each.withColumn("wishes", F.coalesce("wishes", F.array().cast("array<struct<positive:bigint,score:bigint,low:double,high:double>>")))
    whole = each.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("at", "wishes"))).getField("wishes").alias("wishes"), F.min(F.array_min(F.col("wishes.low"))).alias("from"), F.max(F.array_max(F.col("wishes.high"))).alias("to"))
    return groups.join(whole.where(F.col("from").isNotNull()), "group")


def _wish(positive: Column, score: Column, low: Column, high: Column) -> Column:
    return F.struct(positive.cast("long").alias("positive"), score.cast("long").alias("score"), low.cast("double").alias("low"), high.cast("double").alias("high")).alias("wish")


def mine(rows: DataFrame, anchors: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 5) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows of the condition `anchors`. Scores are inner products of floor(256 * x); higher ones come first,
    ties by smaller id. An anchor's positives are its first `positives` other rows of its label; for each of them the first
    `negatives` rows of other labels with scores from 80 % of the positive's to all of it are returned, fewer if there are
    fewer. Rows without an id or a label, without a vector, or with a null or a non-finite component take no part. Rows that
    are the same in id, label and vector count once; rows that share an id are never each other's positives. Shorter
    vectors are filled up with zeros; a score beyond 64 bits is held to their ends. An id whose rows differ asks with each
    of them, and what they find is put together.
    """
    fine = F.col(vector_col).isNotNull() & ~F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    clean = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.coalesce(fine, F.lit(False)))
    clean = clean.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(anchors, F.lit(False)).alias("asks")).distinct()
    clean = written(clean, "vectors")
    sample = [r.vector for r in clean.select("vector", F.xxhash64("id", "vector").alias("h")).orderBy("h").limit(SAMPLE).collect()]  # bounded
    directions = directions_of(sample)
    blocks = written(packed(_placed(clean, directions), BLOCK).withColumn("block", F.monotonically_increasing_id()), "blocks")
    groups = written(packed(_placed(clean.where("asks"), directions), GROUP).withColumn("group", F.monotonically_increasing_id()), "groups")

    ranges = ["low", "high", "least", "most", "label"]
    # The ranges of all blocks meet those of all groups: some hundred bytes for each 1,024 rows and 64 anchors.
    shards = partitions(rows.sparkSession)
    summary = groups.select("group", *ranges, F.pmod(F.xxhash64("group"), F.lit(shards)).alias("shard"))
    spread = blocks.select("block", *ranges, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    low, high = _bounds("g", "b")
    facing = summary.alias("g").join(spread.alias("b"), "shard").select("group", "block", (F.col("g.label") == F.col("b.label")).alias("same"), low.alias("lowest"), high.alias("highest"))

    # A first bound: the block of the label that may score highest.
    nearest = facing.where("same").groupBy("group").agg(F.max_by("block", F.struct("highest", "block")).alias("block"))
    open_ended = _wish(F.lit(None), F.lit(None), F.lit(float("-inf")), F.lit(float("inf")))
    every = groups.select(F.explode("ids").alias("anchor_id")).select("anchor_id", open_ended)
    near = _met(_with_wishes(groups, every), blocks, nearest, positives)
    bound = near.groupBy("anchor_id").agg(F.when(F.count(F.lit(1)) >= positives, F.min("score").cast("double")).alias("least"))
    least = F.col("least") - F.abs("least") * 1e-9 - 1
    wishes = every.select("anchor_id").distinct().join(bound, "anchor_id", "left").select("anchor_id", _wish(F.lit(None), F.lit(None), F.coalesce(least, F.lit(float("-inf"))), F.lit(float("inf"))))
    asking = _with_wishes(groups, wishes)
    pairs = facing.where("same").join(asking.select("group", "from"), "group").where(F.col("highest") >= F.col("from")).select("group", "block")
    taken = _first(_met(asking, blocks, pairs, positives).distinct(), positives, ["anchor_id"])
    taken = written(taken.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    score = F.col("positive_score").cast("double")
    wishes = taken.select("anchor_id", _wish(F.col("positive_id"), F.col("positive_score"), F.col("positive_score") * F.lit(0.8) - F.abs(score) * 1e-9 - 1, score + F.abs(score) * 1e-9 + 1)).where("positive_score >= 0")
    asking = _with_wishes(groups, wishes)
    pairs = facing.where("NOT same").join(asking.select("group", "from", "to"), "group").where((F.col("highest") >= F.col("from")) & (F.col("lowest") <= F.col("to"))).select("group", "block")
    found = _met(asking, blocks, pairs, negatives).distinct()
    best = _first(found, negatives, ["anchor_id", "positive_id", "positive_score"])
    return best.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH r AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
    FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 5
"""
