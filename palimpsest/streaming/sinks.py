"""Tables that are appended to and may be written twice, an embedding hook, and adding memories with both.

A batch has a folder of its own, by source and number, and overwrites it if it runs again; rows whose key another batch has
are left out. So a batch that is replayed, and a row that two batches carry, leave one copy.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.registry import query
from palimpsest.functions.tables import saved, shared_folder
from palimpsest.operators.upkeep import START
from palimpsest.sources.files import exists
from palimpsest.sources.model import NOW, TAU, Store
from palimpsest.streaming.turns import stream

#: Characters of a text that are embedded (fixed value), and texts that the hook is given at a time.
TEXT_CHARS, AT_A_TIME = 2_000, 64


@dataclass(frozen=True)
class AppendTable:
    """A table of rows with a key, in folders by source and batch."""

    spark: SparkSession
    path: str
    schema: T.StructType
    key: str

    def rows(self) -> DataFrame:
        """All rows, with source and batch."""
        whole = T.StructType([*self.schema.fields, T.StructField("source", T.StringType()), T.StructField("batch", T.LongType())])
        return self.spark.read.schema(whole).parquet(self.path) if exists(self.spark, self.path) else self.spark.createDataFrame([], whole)

    def append(self, rows: DataFrame, batch: int, source: str = "main") -> None:
        """Appends a batch. Rows without a key are left out; of rows that repeat one in the batch one is kept.

        Batches are appended one after another: two at a time do not see each other's rows.
        """
        others = self.rows().where(~((F.col("source") == source) & (F.col("batch") == batch))).select(self.key)
        new = rows.where(F.col(self.key).isNotNull()).select(*self.schema.names).dropDuplicates([self.key]).join(others, self.key, "left_anti")
        new.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/source={source}/batch={batch}")

    def take(self, rows: DataFrame, checkpoint: str, source: str = "main") -> None:
        """Appends all that a stream has now, batch by batch."""
        writer = rows.writeStream.foreachBatch(lambda df, number: self.append(df, number, source)).option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start().awaitTermination()

    def copy_once(self, rows: DataFrame | None) -> tuple[int, str]:
        """Copies rows of an older table into this one if it is empty: how many, and why none."""
        if rows is None:
            return 0, "table_missing"
        if not self.rows().isEmpty():
            return 0, "not_empty"
        self.append(rows, 0, "copied")
        return self.rows().count(), "ok"


def vector_state(vector, dims: int | None) -> str:
    if not isinstance(vector, list | tuple) or not vector:
        return "no_vector"
    if dims is not None and len(vector) != dims:
        return "wrong_length"
    return "ok" if all(isinstance(x, int | float) and math.isfinite(x) for x in vector) else "not_finite"


def embedded(texts: DataFrame, embed: Callable[[list[str]], list], *, dims: int | None = None, most: int = TEXT_CHARS, at_a_time: int = AT_A_TIME) -> DataFrame:
    """id, text (its first `most` characters), vector, status of texts (id, text), by a function from texts to their vectors.

    embed runs in tasks, for `at_a_time` texts of bounded length at once. A text that is null or blank is not sent (empty);
    a vector of another length, with numbers that are not finite, or none at all is null and says so; if embed raises or
    returns another number of vectors, its texts are failed, and the job goes on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, at_a_time):
                part = batch.slice(first, at_a_time)
                texts = [t or "" for t in part.column(1).to_pylist()]
                asked = [t for t in texts if t.strip()]
                try:
                    found = list(embed(asked)) if asked else []
                    if len(found) != len(asked):
                        raise ValueError
                    found = [(v, vector_state(v, dims)) for v in found]
                except Exception:  # the hook is the caller's, and its texts may be sent again
                    found = [(None, "failed")] * len(asked)
                each = iter(found)
                rows = [next(each) if t.strip() else (None, "empty") for t in texts]
                vectors = [[float(x) for x in v] if state == "ok" else None for v, state in rows]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(vectors, pa.list_(pa.float64())), pa.array([s for _, s in rows])], ["id", "text", "vector", "status"])

    cut = texts.select(F.col("id").cast("string").alias("id"), F.substring("text", 1, most).alias("text"))
    return cut.mapInArrow(run, "id string, text string, vector array<double>, status string")


def add_memories(chunks: DataFrame, vectors: AppendTable, sidecar: AppendTable, embed: Callable, batch: int, *, dims: int | None = None, now: int = NOW) -> DataFrame:
    """Adds new chunks (id, text, category): id, status. A chunk gets its sidecar row only once its vector is stored.

    So none is left with a row and without a vector: what failed is added by a later batch. A replayed batch changes nothing.
    An unknown category counts as raw_log.
    """
    tried = saved(embedded(chunks, embed, dims=dims), "embedded")
    vectors.append(tried.where("status = 'ok'").select("id", "text", "vector"), batch)
    stored = chunks.select(F.col("id").cast("string").alias("chunk_id"), "category").join(vectors.rows().select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
    values = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    category = F.when(F.col("category").isin(list(START)), F.col("category")).otherwise("raw_log")
    start = F.element_at(values(START), category)
    sidecar.append(stored.select("chunk_id", start.alias("initial_confidence"), start.alias("confidence"), F.lit(now).cast("long").alias("last_confidence_update"), F.element_at(values(TAU), category).alias("base_tau"), F.lit(0).alias("hit_count"), F.lit(0).alias("is_archived"), (category == "user_identity").cast("int").alias("is_protected"), F.lit(0).alias("conflict_flag"), category.alias("category")), batch)
    return tried.select("id", "status")


def _schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


VECTORS = "id string, text string, vector array<double>"
SIDECAR = "chunk_id string, initial_confidence double, confidence double, last_confidence_update long, base_tau double, hit_count int, is_archived int, is_protected int, conflict_flag int, category string"


def _folder(s: Store, name: str) -> str:
    return f"{shared_folder(s.spark)}/{name}-{uuid.uuid4().hex}"


@query("event_append", "SELECT event_id AS id, CASE WHEN event_id % 3 <> 0 THEN 'main' ELSE 'core' END AS source FROM events WHERE event_id % 3 <> 0 OR event_id % 2 = 0")
def event_append(s: Store) -> DataFrame:
    """Two streams of events that share rows, appended to one table, the second one twice: the checkpoint is lost between."""
    base = _folder(s, "append")
    table = AppendTable(s.spark, f"{base}/events", _schema("event_id long, event_type string"), "event_id")
    table.take(stream(s).where("event_id % 3 <> 0"), f"{base}/main")
    for again in range(2):
        table.take(stream(s).where("event_id % 2 = 0"), f"{base}/core-{again}", "core")
    return table.rows().select(F.col("event_id").alias("id"), "source")


def lengths(texts: list[str]) -> list[list[float]]:
    """A plain function in an embedding service's place."""
    return [[len(t) % 7, len(t) % 11, 1.0] for t in texts]


@query("memory_add", f"""SELECT id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty' ELSE 'ok' END AS status, (length(substr(text, 1, {TEXT_CHARS})) % 7)::DOUBLE AS first, c.category, CASE c.category {' '.join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in START.items())} ELSE 0.5 END AS confidence
    FROM chunks LEFT JOIN (SELECT chunk_id, any_value(category) AS category FROM conf GROUP BY chunk_id) c ON id = chunk_id WHERE trim(coalesce(text, '')) <> ''""".replace("c.category, CASE c.category", "coalesce(c.category, 'raw_log') AS category, CASE c.category"))
def memory_add(s: Store) -> DataFrame:
    """The store's texts added to empty tables, and the same batch once more."""
    base = _folder(s, "add")
    vectors = AppendTable(s.spark, f"{base}/vectors", _schema(VECTORS), "id")
    sidecar = AppendTable(s.spark, f"{base}/sidecar", _schema(SIDECAR), "chunk_id")
    categories = s.confidence.groupBy("chunk_id").agg(F.first("category").alias("category"))
    chunks = saved(s.chunks.select("id", "text").join(categories, F.col("id") == F.col("chunk_id"), "left").select("id", "text", "category"), "new-chunks")
    for _ in range(2):
        status = add_memories(chunks, vectors, sidecar, lengths, 0, dims=3)
    both = vectors.rows().join(sidecar.rows().select(F.col("chunk_id").alias("id"), "category", "confidence"), "id").join(status, "id")
    return both.select("id", "status", F.get("vector", F.lit(0)).alias("first"), "category", "confidence")
