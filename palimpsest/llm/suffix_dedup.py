"""Removal of byte strings that an earlier document has too, on suffix arrays.

1. Anchors: of the hashes of all GRAM-byte strings within each LENGTH-byte string the smallest is its anchor, so that equal
   strings have equal anchors, and a text has a run of starts for about each eighteenth byte. Runs whose anchor occurs in
   one text only hold no repeated string and go no further.
2. Suffix arrays: the runs that are left meet on their anchors. Each block of whole anchor groups is sorted in two stages:
   suffixes smaller than their successors directly, the others induced from them by a scan over the buckets. Neighbours with
   a common prefix of LENGTH bytes hold the same string; the smallest id among them keeps it.
   Equal runs are merged before, and runs that differ on both sides of the anchor are left out.
3. Anchors that very many documents share send each distinct run once, with its smallest id, and get the answer by a join.
Texts that are equal as a whole are dealt with before, by their SHA-256 digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import free_names, partitions, release, scratch, table, written
from palimpsest.llm.near_dedup import mixed

LENGTH = 50
GRAM = 16
#: Runs of one anchor that go to one task as they are: some 5 MB.
HOT = 1 << 16
BATCH_BYTES = 2 << 20
BLOCK_BYTES = 2 << 20
NO_ID = -(2**63)


def words_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as one word."""
    n = len(data) - 7
    out = np.empty(n, np.uint64)
    for k in range(8):
        whole = (len(data) - k) // 8
        out[k::8] = data[k : k + 8 * whole].view(">u8")[: len(out[k::8])]
    return out


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM (16) bytes at each place."""
    words = words_of(np.ascontiguousarray(data))
    n = len(data) - GRAM + 1
    h = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += words[8 : 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    return h


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` neighbours: of a block's end and the next one's start."""
    n = len(x) - width + 1
    blocks = np.full(-(-len(x) // width) * width, np.uint64(2**64 - 1))
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, width)
    ends = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(ends[:n], starts[width - 1 : width - 1 + n])


def anchor_runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Index of the text, anchor, first start and number of starts of each run of LENGTH-byte strings with one anchor."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    if sizes.sum() < LENGTH:
        none = np.zeros(0, np.int64)
        return none, none.view(np.uint64), none, none
    least = sliding_least(gram_hashes(np.frombuffer(b"".join(texts), np.uint8)), LENGTH - GRAM + 1)
    begins = np.concatenate(([0], np.cumsum(sizes)))
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(least)]
    inside = np.arange(len(least)) + LENGTH <= begins[owner + 1]
    at = np.flatnonzero(inside)
    least, owner = least[at], owner[at]
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return owner[first], least[first], at[first] - begins[owner[first]], np.diff(np.append(first, len(at)))


def suffix_array(text: np.ndarray, depth: int = 56) -> np.ndarray:
    """The order of the suffixes of text (symbols 0 to 256; 0 last) by their first `depth` symbols at least, in two stages."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int32) - text[:-1].astype(np.int32))
    step[-1] = 1
    # A run of one symbol is as what follows it.
    index = np.where(step != 0, np.arange(n), n - 1)
    step = step[np.minimum.accumulate(index[::-1])[::-1]]
    larger = step < 0
    small = np.flatnonzero(~larger)
    words = packed(text)
    order = small[np.argsort(words[small])]
    for k in range(8, depth, 8):
        # Refine: ties so far are ordered by the next eight symbols.
        key = words[order]
        same = np.zeros(len(order), bool)
        if k == 8:
            group = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]).astype(np.int64)))) if len(order) else np.zeros(0, np.int64)
        same[1:] = group[1:] == group[:-1]
        tied = same.copy()
        tied[:-1] |= same[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        ahead = order[at] + k
        more = np.where(ahead < n, words[np.minimum(ahead, n - 1)], 0)
        sub = np.lexsort((more, group[at]))
        order[at] = order[at][sub]
        more, own = more[sub], group[at]
        fresh = np.zeros(len(order), np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (own[1:] != own[:-1]) | (more[1:] != more[:-1])
        fresh[at] = new
        fresh[~tied] = 1
        group = np.cumsum(fresh)
    heads = text[order]
    cut = np.searchsorted(heads, np.arange(258))
    waiting: list[list[np.ndarray]] = [[] for _ in range(257)]
    out: list[np.ndarray] = []

    def induce(done: np.ndarray, c: int) -> list[np.ndarray]:
        """Those before the done ones that are larger than them go to the ends of their buckets, in this order."""
        before = done[done > 0] - 1
        before = before[larger[before]]
        if not len(before):
            return []
        symbols = text[before]
        own = [before[symbols == c]]
        rest = symbols != c
        before, symbols = before[rest], symbols[rest]
        by = np.argsort(symbols, kind="stable")
        before, symbols = before[by], symbols[by]
        edges = np.flatnonzero(np.diff(symbols)) + 1
        for piece in np.split(before, edges) if len(before) else ():
            waiting[int(text[piece[0]])].append(piece)
        return own

    for c in range(257):
        todo = waiting[c]
        while todo:
            part = todo.pop(0)
            if len(part):
                out.append(part)
                todo.extend(induce(part, c))
        part = order[cut[c] : cut[c + 1]]
        if len(part):
            out.append(part)
            induce(part, c)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def packed(text: np.ndarray) -> np.ndarray:
    """Eight symbols from each place on in one word, in their order; 0 ends a text, and what follows it counts as 0.

    Symbols 1 to 256 are bytes; byte 255 and 254 share a code, told apart by common_prefixes alone.
    """
    n = len(text)
    codes = np.minimum(text, 255).astype(np.uint64)
    wide = np.concatenate((codes, np.zeros(8, np.uint64)))
    out = np.zeros(n, np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | wide[i : i + n]
    return out


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Symbols, up to `most`, that each suffix in order has in common with the one before it; 0 for the first."""
    n = len(text)
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for k in range(most):
        a, b = order[live] + k, order[live - 1] + k
        ok = (a < n) & (b < n)
        live, a, b = live[ok], a[ok], b[ok]
        live = live[text[a] == text[b]]
        out[live] += 1
        if not len(live):
            break
    return out


def may_share(text: np.ndarray, begins: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the runs, that begin at begins (and end at the last) and have the anchors keys, may share a string with another one.

    A string of LENGTH bytes has 17 or more on one side of its anchor, so that runs that share one have equal GRAM bytes
    before their anchors or after them. A run holds its anchor several times where its bytes repeat: each place counts.
    """
    h = gram_hashes(text)
    owner = np.repeat(np.arange(len(keys)), np.diff(begins))[: len(h)]
    place = np.flatnonzero((h == keys[owner]) & (np.arange(len(h)) + GRAM <= begins[owner + 1]))
    run = owner[place]
    out = np.zeros(len(keys), bool)
    for side, fits in ((place - GRAM, place - GRAM >= begins[run]), (place + GRAM, place + 2 * GRAM <= begins[run + 1])):
        runs, codes = run[fits], mixed(keys[run[fits]] ^ mixed(h[side[fits]]))
        by = np.lexsort((runs, codes))
        runs, codes = runs[by], codes[by]
        once = np.ones(len(by), bool)  # a run counts once for each code
        once[1:] = (runs[1:] != runs[:-1]) | (codes[1:] != codes[:-1])
        runs, codes = runs[once], codes[once]
        same = codes[1:] == codes[:-1]
        out[runs[1:][same]] = True
        out[runs[:-1][same]] = True
    return out


def first_ids(runs: list[bytes], ids: np.ndarray, starts: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """The smallest id that has the string at each start of each run, which is its starts and LENGTH - 1 bytes more.

    Equal runs are one: code gives its number for each run, least its smallest id, and parts, for those of which other runs
    share strings with smaller ids, the smallest id at each start. Only runs that may share strings are sorted.
    """
    code, distinct = pd.factorize(np.array(runs, object))
    least = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(least, code, ids)
    one = np.zeros(len(distinct), np.int64)
    one[code] = np.arange(len(code))
    joined = np.frombuffer(b"".join(distinct), np.uint8)
    begins = np.concatenate(([0], np.cumsum([len(r) for r in distinct])))
    picked = np.flatnonzero(may_share(joined, begins, keys[one].view(np.uint64))) if len(distinct) else one
    if not len(picked):
        return code, least, {}
    some = [distinct[i] for i in picked.tolist()]
    sizes = np.fromiter(map(len, some), np.int64, len(some)) + 1
    text = np.frombuffer(b"\0".join(some) + b"\0", np.uint8).astype(np.int16) + np.int16(1)
    begins = np.concatenate(([0], np.cumsum(sizes)))
    text[begins[1:] - 1] = 0
    owner = np.repeat(np.arange(len(some)), sizes)
    whole = np.arange(len(text)) - begins[owner] < starts[one[picked]][owner]
    order = suffix_array(text)
    order = order[whole[order]]
    heads = np.flatnonzero(common_prefixes(text, order) < LENGTH)
    lowest = np.minimum.reduceat(least[picked][owner[order]], heads)
    found = np.zeros(len(text), np.int64)
    found[order] = np.repeat(lowest, np.diff(np.append(heads, len(order))))
    lower = np.unique(owner[order][found[order] < least[picked][owner[order]]])
    return code, least, {int(picked[i]): found[begins[i] : begins[i] + starts[one[picked[i]]]] for i in lower.tolist()}


def _pieces(values: list[bytes | None]) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, v in enumerate(values):
        size += len(v or b"")
        if size >= BATCH_BYTES or i + 1 == len(values):
            yield first, i + 1
            first, size = i + 1, 0


def _batch(names: list[str], *cols: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(cols), names)


ANCHORS = "id long, th long, key long, start int, n int"


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, hashes, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
        for a, b in _pieces(texts):
            owner, key, start, n = anchor_runs([t or b"" for t in texts[a:b]])
            yield _batch(["id", "th", "key", "start", "n"], pa.array(ids[a:b][owner]), pa.array(hashes[a:b][owner]), pa.array(key.view(np.int64)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)))


RUNS = "id long, th long, key long, start int, n int, run binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of id, th, text, runs (key, start, n) -> a row for each run with its bytes."""
    names = [c.split()[0] for c in RUNS.split(", ")]
    for batch in batches:
        ids, hashes, texts, lists = (batch.column(i) for i in range(4))
        flat, ends = lists.flatten(), lists.offsets.to_numpy()
        key, start, n = (flat.field(i).to_numpy() for i in range(3))
        owner = np.repeat(np.arange(batch.num_rows), np.diff(ends))
        at = 0
        texts = texts.to_pylist()
        while at < len(owner):
            to = min(len(owner), at + 50_000)
            runs = [texts[o][s : s + k + LENGTH - 1] for o, s, k in zip(owner[at:to].tolist(), start[at:to].tolist(), n[at:to].tolist(), strict=True)]
            rows = owner[at:to]
            yield _batch(names, pa.array(ids.to_numpy()[rows]), pa.array(hashes.to_numpy()[rows]), pa.array(key[at:to]), pa.array(start[at:to]), pa.array(n[at:to]), pa.array(runs, pa.binary()))
            at = to


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by key in blocks of whole groups, of BLOCK_BYTES or one group."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size < BLOCK_BYTES:
            continue
        t = pa.Table.from_batches(held)
        key = t.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1]))  # the last group may go on
        if cut:
            yield t.slice(0, cut)
            held = t.slice(cut).to_batches()
            size = sum(b.nbytes * b.num_rows // max(1, t.num_rows) for b in held)
    if held:
        yield pa.Table.from_batches(held)


def _blocks(t: pa.Table) -> Iterator[pa.Table]:
    """t cut between groups to about BLOCK_BYTES of runs each."""
    key, sizes = t.column("key").to_numpy(), np.cumsum(t.column("n").to_numpy() + LENGTH)
    a = 0
    while a < t.num_rows:
        b = int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + BLOCK_BYTES, "right"))
        b = max(b, a + 1)
        b = int(np.searchsorted(key, key[b - 1], "right")) if b < t.num_rows else t.num_rows
        yield t.slice(a, b - a)
        a = b


LOST = "id long, th long, lo int, hi int"


def _lost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by key -> byte ranges of the strings that a smaller id has."""
    for t in (b for g in _groups(batches) for b in _blocks(g)):
        ids, th, key, start, n = (t.column(c).to_numpy() for c in ("id", "th", "key", "start", "n"))
        code, least, parts = first_ids(t.column("run").to_pylist(), ids, n.astype(np.int64), key)
        odd = np.isin(code, np.fromiter(parts, np.int64, len(parts)))
        gone = np.flatnonzero((least[code] < ids) & ~odd)
        yield _batch(["id", "th", "lo", "hi"], pa.array(ids[gone]), pa.array(th[gone]), pa.array(start[gone]), pa.array((start[gone] + n[gone] + LENGTH - 1).astype(np.int32)))
        out = [(int(ids[i]), int(th[i]), *r) for i in np.flatnonzero(odd).tolist() for r in lost_ranges(parts[code[i]] < ids[i], int(start[i]))]
        if out:
            yield _batch(["id", "th", "lo", "hi"], *[pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)])


def lost_ranges(lost: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Byte ranges that the strings at the lost starts cover."""
    if not lost.any():
        return []
    edges = np.flatnonzero(np.diff(np.concatenate(([0], lost.astype(np.int8), [0]))))
    return [(start + int(a), start + int(b) + LENGTH - 1) for a, b in zip(edges[::2], edges[1::2], strict=True)]


FIRSTS = "key long, run binary, lens array<int>, ids array<long>"


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct runs sorted by key, with their smallest ids -> for each the smallest id at each start, in run lengths."""
    for t in (b for g in _groups(batches) for b in _blocks(g)):
        runs, n = t.column("run").to_pylist(), t.column("n").to_numpy().astype(np.int64)
        code, least, parts = first_ids(runs, t.column("id").to_numpy(), n, t.column("key").to_numpy())
        found = [parts[c] if c in parts else np.full(k, least[c]) for c, k in zip(code.tolist(), n.tolist(), strict=True)]
        lens, ids = [], []
        for f in found:
            at = np.flatnonzero(np.concatenate(([True], f[1:] != f[:-1])))
            lens.append(np.diff(np.append(at, len(f))).tolist())
            ids.append(f[at].tolist())
        yield _batch(["key", "run", "lens", "ids"], t.column("key").combine_chunks(), pa.array(runs, pa.binary()), pa.array(lens, pa.list_(pa.int32())), pa.array(ids, pa.list_(pa.int64())))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of id, th, start, lens, ids -> byte ranges of the strings that a smaller id has."""
    for batch in batches:
        out = []
        for i, th, start, lens, ids in zip(*[batch.column(c).to_pylist() for c in ("id", "th", "start", "lens", "ids")], strict=True):
            if min(ids) < i:
                out += [(i, th, *r) for r in lost_ranges(np.repeat(np.array(ids) < i, lens), start)]
        if out:
            yield _batch(["id", "th", "lo", "hi"], *[pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)])


def repeated_ranges(texts: DataFrame, hot: int = HOT) -> DataFrame:
    """texts of id, th, text (binary) -> id, th, ranges: sorted byte ranges (lo, hi) that are to go.

    th tells texts of one id apart. Of equal texts the one with the smallest id alone is looked at; the others have no row here.
    """
    n, (path, shared_path, runs_path) = partitions(texts.sparkSession), [scratch(texts.sparkSession, name) for name in ("anchors", "shared-runs", "runs")]
    anchors = written(texts.where(F.octet_length("text") >= LENGTH).mapInArrow(_anchors, ANCHORS), "anchors", path)
    keys = anchors.groupBy("key").agg(F.min("th").alias("a"), F.max("th").alias("b"), F.count(F.lit(1)).alias("times")).where("a <> b")
    keys = written(keys.select("key", (F.col("times") > hot).alias("hot")), "shared-anchors")
    shared = written(anchors.join(keys.select("key").hint("shuffle_hash"), "key"), "shared-runs", shared_path)
    release(anchors, path)
    own = texts.select("id", "th", F.unhex(F.sha2("text", 256)).alias("digest")).groupBy("digest").agg(F.min(F.struct("id", "th")).alias("own")).select("own.id", "own.th")
    wanted = written(shared.groupBy("id", "th").agg(F.collect_list(F.struct("key", "start", "n")).alias("runs")).join(own, ["id", "th"], "left_semi"), "runs", runs_path)
    release(shared, shared_path)
    cut = texts.join(wanted.hint("shuffle_hash"), ["id", "th"]).select("id", "th", "text", "runs").mapInArrow(_cut, RUNS)
    cut = written(cut, "cut")
    release(wanted, runs_path)
    often = keys.where("hot").select("key")
    few = cut.join(often.hint("shuffle_hash"), "key", "left_anti").repartition(n, "key").sortWithinPartitions("key").mapInArrow(_lost, LOST)
    lost = written(few, "lost")
    if not often.isEmpty():
        many = cut.join(often.hint("shuffle_hash"), "key", "left_semi")
        distinct = many.groupBy("key", "run").agg(F.min("id").alias("id"), F.first("n").alias("n"))
        firsts = distinct.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_firsts, FIRSTS)
        firsts = written(firsts.where("size(ids) > 0"), "firsts")
        lost = lost.unionByName(written(many.join(firsts, ["key", "run"]).select("id", "th", "start", "lens", "ids").mapInArrow(_compared, LOST), "lost"))
    return lost.groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("ranges"))


def kept_bytes(raw: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of raw, the bytes removed, and the maximal runs of them; ranges are sorted."""
    parts, at, gone, spans, to = [], 0, 0, 0, -1
    for lo, hi in ranges:
        if lo > to:
            spans += 1
            parts.append(raw[at:lo])
            gone += hi - lo
        else:
            gone += max(0, hi - to)
        to = max(to, hi)
        at = to
    return b"".join([*parts, raw[at:]]), gone, spans


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """docs with text_col as the bytes that are left of it, and n_bytes, n_removed and n_spans.

    A byte goes if a string of LENGTH bytes covers it that starts in a document with a smaller id too, as the texts come.
    Null and empty texts lose nothing and become empty. Ids that are null are below all others; rows with the same id do
    not count against each other. Other columns stay; those named n_bytes, n_removed, n_spans are replaced.
    """
    new = ["n_bytes", "n_removed", "n_spans"]
    own_id, own_th, of_id, of_th, to_go = free_names(docs, "own", "own_hash", "i", "t", "ranges")
    base = docs.drop(*new).withColumns({text_col: F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")), own_id: F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))}).withColumn(own_th, F.xxhash64(text_col))
    texts = base.select(F.col(own_id).alias("id"), F.col(own_th).alias("th"), F.col(text_col).alias("text"))
    # Whole texts that a smaller id has.
    copies = base.select(F.col(own_id).alias("id"), F.col(own_th).alias("th"), F.unhex(F.sha2(text_col, 256)).alias("digest"), F.octet_length(text_col).alias("size")).where(F.col("size") >= LENGTH)
    firsts = copies.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("digest", "first")
    whole = copies.join(firsts, "digest").where("id > first").select("id", "th", F.array(F.struct(F.lit(0).alias("lo"), F.col("size").alias("hi"))).alias("ranges")).distinct()
    plan = written(repeated_ranges(texts, hot).unionByName(whole), "ranges").select(F.col("id").alias(of_id), F.col("th").alias(of_th), F.col("ranges").alias(to_go))
    joined = base.join(plan.hint("shuffle_hash"), (F.col(own_id) == F.col(of_id)) & (F.col(own_th) == F.col(of_th)), "left").drop(own_id, own_th, of_id, of_th)
    names = [*[c for c in joined.columns if c != to_go], *new]
    schema = joined.drop(to_go).withColumns({c: F.lit(0).cast("long") for c in new}).schema

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ranges = batch.column(text_col).to_pylist(), batch.column(to_go).to_pylist()
            found = [kept_bytes(t, [(r["lo"], r["hi"]) for r in rs or ()]) for t, rs in zip(texts, ranges, strict=True)]
            own = {text_col: pa.array([f[0] for f in found], pa.binary()), "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "n_removed": pa.array([f[1] for f in found], pa.int64()), "n_spans": pa.array([f[2] for f in found], pa.int64())}
            yield pa.RecordBatch.from_arrays([own[c] if c in own else batch.column(c) for c in names], names)

    return joined.mapInArrow(apply, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256"))


def brute(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, int, str]]:
    """The query's result from a dictionary of all strings, for tests."""
    raw = {i: (t or "").encode() for i, t in docs}
    first: dict[bytes, int] = {}
    for i in sorted(raw):
        for k in range(len(raw[i]) - LENGTH + 1):
            first.setdefault(raw[i][k : k + LENGTH], i)
    out = {}
    for i, t in raw.items():
        ranges = [(k, k + LENGTH) for k in range(len(t) - LENGTH + 1) if first[t[k : k + LENGTH]] < i]
        left, gone, spans = kept_bytes(t, ranges)
        out[i] = (len(t), gone, spans, hashlib.sha256(left).hexdigest())
    return out
