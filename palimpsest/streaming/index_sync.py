"""Incremental sync of a store's files with its index: only files that changed since the last run are read.

A run lists the files' metadata, compares their times with the newest time that a run before has seen (the mark, kept in a
table of runs), puts the contents of changed files into an inbox, and ends with a stream over the inbox that takes all there
is and stops. The stream's checkpoint tells what has been taken, its batches overwrite their own part of the index if they run
again, and the mark is written last; so a run that breaks off anywhere is made good by the next one.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.registry import query
from palimpsest.functions.tables import shared_folder
from palimpsest.operators.checkpoint import entries_of
from palimpsest.sources.files import exists, files, write_files
from palimpsest.sources.model import Store

INBOX = "path string, mtime long, text string"
INDEX = "path string, mtime long, entry int, entry_id string, category string, provenance string, body string"


@dataclass(frozen=True)
class IndexSync:
    """The files in `dirs` of `root`, and their index in `state`."""

    spark: SparkSession
    root: str
    dirs: Sequence[str]
    state: str

    def table(self, name: str, schema: str) -> DataFrame:
        path = f"{self.state}/{name}"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def versions(self) -> DataFrame:
        """path, mtime: the version of each file that the index has."""
        return self.table("index", INDEX).groupBy("path").agg(F.max("mtime").alias("mtime"))

    def chunks(self) -> DataFrame:
        """The entries of the newest version of each file."""
        return self.table("index", INDEX).join(self.versions(), ["path", "mtime"]).where("entry > 0").select(*[c.split()[0] for c in INDEX.split(", ")]).distinct()

    def sync(self, reason: str = "recall") -> DataFrame:
        """One run: path, changed, indexed_before, indexed_after, updated_at (of the indexed version), synced, reason.

        A row for each file that is there. The first run takes all; a later one those whose time is after the mark. Nothing
        is read if there are none: then synced is false and the reason is fresh. A file that has gone stays in the index.
        """
        runs = self.table("runs", "number long, mark long").agg(F.max("number"), F.max("mark")).first()
        number, mark = (runs[0] or 0) + 1, runs[1]
        seen = files(self.spark, self.root, self.dirs)
        listed = f"{self.state}/listed/{number}"
        seen.select("path", "mtime").write.mode("overwrite").parquet(listed)
        listed = self.spark.read.schema("path string, mtime long").parquet(listed)
        newest = listed.agg(F.max("mtime")).first()[0]
        before = self.versions().select("path", F.lit(True).alias("indexed_before"))
        before.write.mode("overwrite").parquet(f"{self.state}/before/{number}")
        before = self.spark.read.schema("path string, indexed_before boolean").parquet(f"{self.state}/before/{number}")
        fresh = mark is not None and (newest is None or newest <= mark)
        after = F.timestamp_millis(F.lit(mark if mark is not None else -1))
        if not fresh:
            changed = seen.where(F.col("modificationTime") > after).select("path", "mtime", F.col("content").cast("string").alias("text"))
            changed.write.mode("overwrite").parquet(f"{self.state}/inbox/run={number}")
            self._take()
            marked = max(x for x in (mark, newest, 0) if x is not None)
            self.spark.range(1).select(F.lit(number).cast("long").alias("number"), F.lit(marked).cast("long").alias("mark")).write.mode("overwrite").parquet(f"{self.state}/runs/run={number}")
        rows = listed.join(before, "path", "left").join(self.versions().withColumnRenamed("mtime", "updated_at"), "path", "left")
        return rows.select(
            "path", (F.lit(not fresh) & (F.timestamp_millis("mtime") > after)).alias("changed"), F.coalesce("indexed_before", F.lit(False)).alias("indexed_before"), F.col("updated_at").isNotNull().alias("indexed_after"), "updated_at",
            F.lit(not fresh).alias("synced"), F.lit("fresh" if fresh else reason).alias("reason"),
        )

    def _take(self) -> None:
        """Takes what has come to the inbox into the index. A file without entries leaves a row, entry 0, that says it was read."""

        def add(batch: DataFrame, number: int) -> None:
            read = batch.select("path", "mtime", "text")
            entries = entries_of(read.select(F.struct("path", "mtime").alias("doc_id"), "text")).select("doc_id.*", F.col("entry").cast("int").alias("entry"), "entry_id", "category", "provenance", "body")
            empty = F.lit(None).cast("string")
            marks = read.select("path", "mtime", F.lit(0).alias("entry"), empty.alias("entry_id"), empty.alias("category"), empty.alias("provenance"), empty.alias("body"))
            entries.unionByName(marks).write.mode("overwrite").parquet(f"{self.state}/index/batch={number}")

        source = self.spark.readStream.schema(INBOX).parquet(f"{self.state}/inbox")
        source.writeStream.foreachBatch(add).option("checkpointLocation", f"{self.state}/checkpoint").trigger(availableNow=True).start().awaitTermination()


DIRS = ["memory/smart-add", "memory/episodes", "memory/not-there"]


def entry_rows(s: Store, under: str, mark: str) -> DataFrame:
    """The store's texts as entries of Markdown files: path, place, text."""
    line = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\s#:]+", " "))
    entry = F.concat(F.lit("## "), F.substring("id", 1, 16), F.lit("\nCategory: episodic\n\n"), F.when(line != "", F.concat(F.lit(mark), line)).otherwise(""), F.lit("\n\n"))
    return s.chunks.where(F.col("path").startswith(under)).select("path", F.col("doc_id").alias("place"), entry.alias("text"))


@query("index_sync", r"""+ b AS (SELECT path, trim(regexp_replace(coalesce(text, ''), '[\s#:]+', ' ', 'g')) <> '' AS filled FROM chunks WHERE starts_with(path, 'memory/smart-add/') OR starts_with(path, 'memory/episodes/'))
SELECT path, TRUE AS first, starts_with(path, 'memory/episodes/') AS second, FALSE AS third, count(*) FILTER (WHERE filled) AS entries, count(*) FILTER (WHERE filled AND starts_with(path, 'memory/episodes/')) AS again FROM b GROUP BY path""")
def index_sync(s: Store) -> DataFrame:
    """Three runs over files that are made of the store's texts: all are new, those of one folder are written again, none is."""
    base = f"{shared_folder(s.spark)}/sync-{uuid.uuid4().hex}"
    root = base if "://" in base else f"file://{base.removeprefix('file:')}"
    sync, runs = IndexSync(s.spark, f"{root}/store", DIRS, f"{root}/state"), []
    for under, mark in (("memory/", ""), ("memory/episodes/", "again "), (None, "")):
        if under:
            write_files(entry_rows(s, under, mark), sync.root)
        sync.sync().select("path", "changed").write.parquet(f"{root}/result/{len(runs)}")
        runs.append(s.spark.read.schema("path string, changed boolean").parquet(f"{root}/result/{len(runs)}"))
    found = sync.chunks().groupBy("path").agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("body").startswith("again ")).alias("again"))
    out = runs[0].withColumnRenamed("changed", "first")
    for name, r in zip(("second", "third"), runs[1:], strict=True):
        out = out.join(r.withColumnRenamed("changed", name), "path")
    zero = F.lit(0).cast("long")
    return out.join(found, "path", "left").select("path", "first", "second", "third", F.coalesce("entries", zero).alias("entries"), F.coalesce("again", zero).alias("again"))
