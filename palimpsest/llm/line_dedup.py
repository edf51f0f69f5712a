"""Line deduplication on levelled sorted runs of line hashes. DataFrame functions only.

`LineRuns` is the store. A run is a table of line keys, bucketed and sorted by key. Each new batch is merge-anti-joined
with the runs, which tells the keys that no earlier batch had, and is then added as a run of its own; `fanout` runs of one
level are compacted into one of the next. All runs have the same buckets, so neither the anti-joins nor a compaction
shuffles the runs: only a batch's own lines move, summed within each task before they do.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import BLANKS, ascii_lower, free_names, partitions, scratch, table, written

KEY = ["h1", "h2"]
RUN = "h1 long, h2 long, n long, first_id long"


def line_key(line: Column) -> Column:
    """The line without white space at its ends and with A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def lines_of(text: Column) -> Column:
    """The lines of a text; null and empty texts are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """Levelled runs of line keys (128-bit hashes) in the shared folder.

    A run has a row for each key: n, the documents of its batches that hold the line, and first_id, the document that
    holds it in the first batch it came with (null in a run whose keys came before).
    """

    def __init__(self, spark: SparkSession, fanout: int = 4, buckets: int | None = None):
        if fanout < 2:
            raise ValueError("fanout must be 2 or more")
        self.spark, self.fanout, self.buckets = spark, fanout, buckets or partitions(spark)
        self.levels: list[list[str]] = []

    def _save(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (run.write.format("parquet").option("path", scratch(self.spark, "run")).bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name))
        return name

    def _put(self, name: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._put(self._merge(full), level + 1)

    def _merge(self, names: list[str]) -> str:
        merged = self._save(self._summed(names))
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
        return merged

    def _summed(self, names: list[str]) -> DataFrame:
        # The runs share their buckets: joining them two by two needs no shuffle, as a union of them would.
        runs = [self.spark.table(n) for n in names]
        while len(runs) > 1:
            runs = [self._both(runs[i], runs[i + 1]) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
        return runs[0]

    @staticmethod
    def _both(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.select(*KEY, F.col("n").alias("n_b"), F.col("first_id").alias("first_b"))
        return a.join(b, KEY, "full").select(
            *KEY, (F.coalesce("n", F.lit(0)) + F.coalesce("n_b", F.lit(0))).alias("n"), F.coalesce("first_id", "first_b").alias("first_id")
        )

    def names(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def unseen(self, batch: DataFrame) -> DataFrame:
        """The rows of batch whose keys no run holds."""
        for name in self.names():
            batch = batch.join(self.spark.table(name).select(*KEY), KEY, "left_anti")
        return batch

    def add(self, lines: DataFrame) -> None:
        """Adds a batch: rows of h1, h2 and id, one for each document that holds the line."""
        summed = self._save(lines.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("first_id")))
        if not self.names():
            self._put(summed, 0)
            return
        batch = self.spark.table(summed)
        new = self.unseen(batch).select(*KEY, F.lit(True).alias("new"))
        marked = batch.join(new, KEY, "left").select(*KEY, "n", F.when(F.col("new"), F.col("first_id")).alias("first_id"))
        run = self._save(marked)
        self.spark.sql(f"DROP TABLE {summed}")
        self._put(run, 0)

    def keys(self) -> DataFrame:
        """A row for each key of all runs: n documents in all, and first_id."""
        names = self.names()
        return self._summed(names) if names else self.spark.createDataFrame([], RUN)


def repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 4) -> DataFrame:
    """The lines to drop: id, text_hash and positions (from 0) for each document that loses lines.

    A key of at least min_chars code points that at least min_docs documents hold stays in the document with the largest
    id alone. Batches go from the largest ids to the smallest, so that the first batch with a key has the document that
    keeps it. Rows with the same id and text count as one document; a null id is below all others.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
    rows = rows.select("id", "text_hash", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    rows = rows.select("id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    lines = written(rows.groupBy("id", "text_hash", *KEY).agg(F.collect_list("pos").alias("at")), "lines")
    low, high = lines.agg(F.min("id"), F.max("id")).first()
    runs = LineRuns(spark, fanout)
    if low is not None:
        edges = [high - (high - low + 1) * k // batches for k in range(batches + 1)]
        for top, bottom in zip(edges, edges[1:], strict=False):
            if top > bottom:
                runs.add(lines.where((F.col("id") <= top) & (F.col("id") > bottom)).select(*KEY, "id"))
    often = runs.keys().where(F.col("n") >= min_docs).select(*KEY, "first_id")
    lost = lines.join(often, KEY).where(F.col("id") != F.col("first_id"))
    return lost.groupBy("id", "text_hash").agg(F.flatten(F.collect_list("at")).alias("dropped"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **rules) -> DataFrame:
    """docs with text replaced by what is left of it, and n_lines and n_dropped added.

    A null or empty text is one empty line, which is too short to drop; what is left of it is "". A text that loses all
    its lines becomes "". All other columns stay, whatever their names, but for n_lines and n_dropped, which are replaced.
    """
    own, own_hash, id_, hash_, dropped, at = free_names(docs, "own", "own_hash", "id", "hash", "dropped", "lines")
    lost = repeated_lines(docs, id_col=id_col, text_col=text_col, **rules).select(F.col("id").alias(id_), F.col("text_hash").alias(hash_), F.col("dropped").alias(dropped))
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumns({own: F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))), own_hash: F.xxhash64(text)})
    # Most rows of the left side hold a whole text: a hashed join does not sort them.
    joined = keyed.join(lost.hint("shuffle_hash"), (F.col(own) == F.col(id_)) & (F.col(own_hash) == F.col(hash_)), "left")
    lines = lines_of(F.col(text_col))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(dropped)), lambda i: F.get(F.col(at), i))
    joined = joined.withColumn(at, lines).withColumns(
        {
            "n_lines": F.size(at).cast("long"),
            "n_dropped": F.coalesce(F.size(dropped), F.lit(0)).cast("long"),
            text_col: F.when(F.col(dropped).isNull(), text).otherwise(F.array_join(kept, "\n")),
        }
    )
    return joined.select(*[c for c in docs.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents),
keyed AS (
    SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines),
often AS (
    SELECT key, max(doc_id) AS last_id FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
    SELECT k.doc_id, k.line, k.pos, coalesce(k.doc_id <> o.last_id, FALSE) AS lost FROM keyed k LEFT JOIN often o USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(lost::INT)::BIGINT AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
