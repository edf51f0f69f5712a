"""Ranked lexical search of many items at once, with the sums that items share computed once.

Items are taken in blocks of bounded size. A block's terms are the leaves of a graph: terms that the same items hold are one
node, and then, round by round, the two nodes that most items hold side by side (in order of how many hold them) become one,
until no two items share a pair. So a node is a set of terms that several items share, an item is the sum of a few nodes, and
each node is computed from its two or more parts once for all items above it. One pass over the documents tells the length of
each and how often the block's terms occur in it; document frequencies are counted from that; in a second pass each task holds
the accumulators of all nodes for some documents at a time, as dense columns, and keeps the k best documents of each item. What
moves is k rows for each item and task.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import table, written

#: Terms are runs of ASCII letters and digits and of code points beyond ASCII; in UTF-8 those are bytes from 128 on.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
OTHER = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
#: Distinct (item, term) pairs of a block of items: what the driver and each task hold of the items at a time.
BLOCK_TERMS = 200_000
PIECE = 1 << 20
#: Cells of the accumulators that a task holds at a time.
CELLS = 1 << 23


def term_counts(text: bytes | None) -> Counter:
    """How often each term occurs in a whole text. Long texts are read in pieces that end between terms."""
    text, counts, at = text or b"", Counter(), 0
    while at < len(text):
        end = OTHER.search(text, at + PIECE)
        end = end.start() if end else len(text)
        counts.update(TERM.findall(text[at:end].lower()))  # of bytes, lower() takes A-Z alone
        at = end
    return counts


@dataclass
class Graph:
    """Nodes 0 to leaves - 1 are terms; node leaves + i is the sum of parts[i]; roots are the nodes that each item is the sum of."""

    leaves: int
    parts: list[tuple[int, ...]]
    roots: list[list[int]]

    def additions(self) -> int:
        return sum(len(p) - 1 for p in self.parts) + sum(max(0, len(r) - 1) for r in self.roots)


def shared_sums(items: list[list[int]], leaves: int) -> Graph:
    """The graph of items that are lists of distinct terms (0 to leaves - 1)."""
    held: defaultdict[int, list[int]] = defaultdict(list)
    for i, terms in enumerate(items):
        for t in terms:
            held[t].append(i)
    parts: list[tuple[int, ...]] = []
    roots: list[list[int]] = [[] for _ in items]
    uses: dict[int, int] = {}
    classes: defaultdict[tuple[int, ...], list[int]] = defaultdict(list)
    for t in sorted(held):
        classes[tuple(held[t])].append(t)
    for own, terms in classes.items():
        node = terms[0]
        if len(terms) > 1 and len(own) > 1:
            node = leaves + len(parts)
            parts.append(tuple(terms))
        for i in own:
            roots[i] += [node] if len(own) > 1 or len(terms) == 1 else terms
        uses |= {node: len(own)} if len(own) > 1 or len(terms) == 1 else dict.fromkeys(terms, 1)
    while True:
        for r in roots:
            r.sort(key=lambda n: (-uses[n], n))
        side = Counter(p for r in roots for p in zip(r, r[1:], strict=False))
        made: dict[tuple[int, int], int] = {}
        for k, r in enumerate(roots):
            out, j = [], 0
            while j < len(r):
                pair = (r[j], r[j + 1]) if j + 1 < len(r) else None
                if pair and side[pair] > 1 and (j + 2 >= len(r) or side[pair] >= side[r[j + 1], r[j + 2]]):
                    if pair not in made:
                        made[pair] = leaves + len(parts)
                        parts.append(pair)
                    out.append(made[pair])
                    j += 2
                else:
                    out.append(r[j])
                    j += 1
            roots[k] = out
        if not made:
            return Graph(leaves, parts, roots)
        uses = dict(Counter(n for r in roots for n in r))


def _postings(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """docs of id, text -> id, n (terms with repeats), terms (numbers of those asked for), counts: a row for each with a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids = [], batch.column(0)
            for text in batch.column(1):
                counts = term_counts(text.as_py())
                found = sorted((terms[t], c) for t, c in counts.items() if t in terms)
                rows.append((counts.total(), [t for t, _ in found], [c for _, c in found]))
            n, of, c = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(of, pa.list_(pa.int32())), pa.array(c, pa.list_(pa.int64()))], ["id", "n", "terms", "counts"])

    return docs.mapInArrow(run, "id long, n long, terms array<int>, counts array<long>").where("n > 0")


def totals(graph: Graph, docs: int, of: np.ndarray, terms: np.ndarray, scores: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(item, score of each document): from the scores of postings (document, term), node by node and then item by item."""
    by = np.argsort(terms, kind="stable")
    of, terms, scores = of[by], terms[by], scores[by]
    edges = np.searchsorted(terms, np.arange(graph.leaves + 1))
    sums: list[np.ndarray] = []

    def summed(nodes) -> np.ndarray:
        out = np.zeros(docs, np.int64)
        for node in nodes:
            if node < graph.leaves:
                a, b = edges[node], edges[node + 1]
                out[of[a:b]] += scores[a:b]
            else:
                out += sums[node - graph.leaves]
        return out

    for nodes in graph.parts:
        sums.append(summed(nodes))
    for item, nodes in enumerate(graph.roots):
        yield item, summed(nodes)


def _first(score: np.ndarray, ids: np.ndarray, null: np.ndarray, k: int) -> np.ndarray:
    """The places of the k first: highest score, smallest id, null ids last."""
    if len(score) > 4 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= least)
        return some[np.lexsort((ids[some], null[some], -score[some]))[:k]]
    return np.lexsort((ids, null, -score))[:k]


def _ranked(postings: DataFrame, graph: Graph, items: list[tuple], weights: np.ndarray, docs: int, length: int, k: int) -> DataFrame:
    """item_id, item (as items name them), id, score: the k best documents of each item in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(16, min(2048, CELLS // (len(graph.parts) + 1)))
        nothing = np.zeros(0, np.int64)
        best = [(nothing, nothing, nothing)] * len(graph.roots)
        for whole in batches:
            for first in range(0, whole.num_rows, step):
                batch = whole.slice(first, step)
                ids = np.asarray(batch.column(0).fill_null(0)).astype(np.int64)
                null = np.asarray(batch.column(0).is_null()).astype(np.int64)
                m = np.array([10 + 90 * n * docs // length for n in batch.column(1).to_pylist()], np.int64)
                terms, tf = (c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[2:])
                of = np.repeat(np.arange(batch.num_rows), np.asarray(batch.column(2).value_lengths()))
                scores = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[of]))
                for item, total in totals(graph, batch.num_rows, of, terms, scores):
                    s, i, z = best[item]
                    at = np.flatnonzero(total >= (s[-1] if len(s) == k else 1))
                    if len(at):
                        s, i, z = np.concatenate((s, total[at])), np.concatenate((i, ids[at])), np.concatenate((z, null[at]))
                        keep = _first(s, i, z, k)
                        best[item] = s[keep], i[keep], z[keep]
        for (item_id, item), (s, i, z) in zip(items, best, strict=True):
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array([item_id] * len(s), pa.int64()), pa.array(np.full(len(s), item)), pa.array(i, mask=z == 1), pa.array(s)], ["item_id", "item", "id", "score"])

    return postings.select("id", "n", "terms", "counts").mapInArrow(run, "item_id long, item long, id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: for each item the k documents of highest score above 0, ties by smaller id (null last).

    Terms are read in whole texts; a null text has none. An item's term counts once, whatever its number there. Rows of docs
    that repeat an id are documents of their own, and so are rows that are repeated as a whole; rows of items that are the
    same in id and text are one item, others that share an id are items of their own. Items without terms, and all items
    over documents without terms, have no rows. Weights are floor(1000 * ln((2 N + 2) / (2 df + 1))); the rest is whole numbers.
    """
    spark = docs.sparkSession

    def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted(term_counts(t.as_py())) for t in batch.column(1)], pa.list_(pa.binary()))], ["item_id", "terms"])

    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("binary").alias("text")).distinct()
    asked = asked.mapInArrow(terms_of, "item_id long, terms array<binary>").where(F.size("terms") > 0)
    asked = written(asked.withColumn("item", F.monotonically_increasing_id()), "items")
    pairs = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = -(-pairs // block_terms)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    found = spark.createDataFrame([], "item_id long, item long, id long, score long")
    for block in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).orderBy("item").collect()  # about block_terms terms
        names = sorted({bytes(t) for r in some for t in r.terms})
        number = {t: i for i, t in enumerate(names)}
        graph = shared_sums([[number[bytes(t)] for t in r.terms] for r in some], len(names))
        postings = written(_postings(texts, number), "postings")
        count, length = postings.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not count:
            break
        weight = F.floor(1000 * F.ln((2 * F.lit(count).cast("double") + 2) / (2 * F.col("df") + 1)))
        frequent = postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        weights = np.zeros(len(names), np.int64)
        for r in frequent.select("term", weight.alias("w")).collect():  # a row for each term of the block
            weights[r.term] = r.w
        ranked = _ranked(postings, graph, [(r.item_id, r.item) for r in some], weights, count, length, k)
        found = found.unionByName(ranked)
    order = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH terms AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents),
wanted AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark),
lengths AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM lengths),
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms WHERE term IN (SELECT term FROM wanted) GROUP BY doc_id, term),
weights AS (SELECT term, floor(1000 * ln((2 * docs::DOUBLE + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY term, docs),
scored AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // length)))))::BIGINT AS score
    FROM wanted JOIN tf USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), whole GROUP BY item_id, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
