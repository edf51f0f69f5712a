"""A vector index of cells, searched exactly: cells are left out only where the triangle inequality rules them out.

Centres are taken from a bounded sample, each the farthest from those before it. A vector lies in the cell of its nearest
centre, with its distance to it; a large cell has several parts. For a query q, a vector x and a centre c,
|d(q, c) - d(x, c)| <= d(q, x), so that no vector of a cell is nearer than d(q, c) less the cell's radius. The search reads
the nearest cells that hold k vectors; the k-th distance found there bounds what is left: cells and, within them, vectors
whose lower bound is above it are passed over, and all others are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.scores import rounded
from palimpsest.functions.tables import saved

#: The sample that centres come from, how many there are at most, rows of a part, and a margin above all rounding.
SAMPLE, CENTRES, PART, MARGIN = 4096, 256, 4096, 1e-6


def fine(vector: Column) -> Column:
    """Whether a vector has numbers alone, and at least one."""
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def centres_of(sample: np.ndarray, count: int) -> np.ndarray:
    """Up to `count` rows of a sample, each the farthest from those before it."""
    taken, far = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(taken) < min(count, len(sample)) and far.max() > 0:
        taken.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[taken[-1]]) ** 2).sum(axis=1))
    return sample[taken]


@dataclass
class VectorIndex:
    """rows: cell, part, id, vector, off (distance to the cell's centre); cells: cell, centre, n, parts, radius."""

    rows: DataFrame
    cells: DataFrame

    @classmethod
    def build(cls, vectors: DataFrame, *, id_col: str = "id", vector_col: str = "vector", centres: int | None = None) -> VectorIndex:
        """The index of the vectors of one length, the commonest; others, and those with odd numbers, are not in it."""
        clean = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(fine(F.col("vector")))
        shape = clean.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").first()
        size, n = (shape.size, shape.n) if shape else (0, 0)
        clean = clean.where(F.size("vector") == size)
        sample = clean.select("vector", F.xxhash64("id").alias("h")).orderBy("h", F.col("id")).limit(SAMPLE).collect() if n else []  # bounded
        wanted = centres or max(1, min(CENTRES, round(n**0.5)))
        found = centres_of(np.array([r.vector for r in sample]), wanted) if sample else np.zeros((1, max(1, size)))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, -1)
                cell, off = np.zeros(len(v), np.int32), np.zeros(len(v))
                for a in range(0, len(v), 256):
                    d = ((v[a : a + 256, None, :] - found[None]) ** 2).sum(axis=2)
                    cell[a : a + 256], off[a : a + 256] = d.argmin(axis=1), np.sqrt(d.min(axis=1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(off)], ["id", "vector", "cell", "off"])

        placed = clean.mapInArrow(place, clean.withColumns({"cell": F.lit(0), "off": F.lit(0.0)}).schema)
        placed = saved(placed.withColumn("h", F.pmod(F.xxhash64("id"), F.lit(1 << 30))), "vectors")
        sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("off").alias("radius")).withColumn("parts", F.ceil(F.col("n") / PART).cast("int"))
        spark = vectors.sparkSession
        middle = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(found)], "cell int, centre array<double>")
        cells = saved(middle.join(sizes, "cell"), "cells")
        rows = placed.join(F.broadcast(cells.select("cell", "parts")), "cell")  # CENTRES rows at most
        rows = rows.select("id", "vector", "off", "cell", F.pmod("h", F.col("parts")).cast("int").alias("part"))
        return cls(saved(rows.repartition("cell", "part").sortWithinPartitions("cell", "part"), "vector-index", "cell"), cells)

    def bounds(self, queries: DataFrame) -> DataFrame:
        """query_id, probe, cell, n, parts, away (distance to the centre), lower (of all distances in the cell)."""
        each = queries.select("query_id", F.col("probe").cast("array<double>").alias("probe")).where(fine(F.col("probe")))
        both = each.join(F.broadcast(self.cells), F.size("probe") == F.size("centre"))  # CENTRES rows at most
        away = F.sqrt(squared(F.col("probe"), F.col("centre")))
        return both.select("query_id", "probe", "cell", "n", "parts", away.alias("away")).join(F.broadcast(self.cells.select("cell", "radius")), "cell").withColumn("lower", F.greatest(F.lit(0.0), F.col("away") - F.col("radius")))

    def _looked_at(self, asked: DataFrame, bound: Column) -> DataFrame:
        """query_id, id, distance of the rows in the cells of asked (query_id, probe, cell, parts, away) that may lie within bound."""
        parts = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        near = parts.join(self.rows, ["cell", "part"]).where(F.abs(F.col("away") - F.col("off")) <= bound + MARGIN)
        return near.select("query_id", "id", squared(F.col("probe"), F.col("vector")).alias("distance"))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, id, position, distance (squared): the k nearest of each of queries (query_id, probe), ties by id.

        Distances that are equal in six decimals are ties. A query without a fine vector, or of another length, finds nothing.
        """
        bounds = saved(self.bounds(queries), "cell-bounds")
        order = W.partitionBy("query_id").orderBy("lower", "away", "cell")
        ahead = F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        first = saved(bounds.withColumn("ahead", ahead).where(F.col("ahead") < k).drop("ahead"), "first-cells")
        found = saved(_best(self._looked_at(first, F.lit(float("inf"))), k), "first-found")
        kth = found.where(F.col("position") == k).select("query_id", (F.sqrt(F.col("distance") + MARGIN) + MARGIN).alias("kth"))
        # A query with fewer than k rows so far has been through all cells.
        rest = bounds.join(first.select("query_id", "cell"), ["query_id", "cell"], "left_anti").join(kth, "query_id").where("lower <= kth")
        return _best(found.select("query_id", "id", "distance").unionByName(self._looked_at(rest, F.col("kth"))), k)

    def reads(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, cells, cells_read, rows, rows_read (rows of the cells read): what a search looks at, for reports."""
        bounds = self.bounds(queries)
        kth = self.search(queries, k).groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.sqrt(F.max("distance") + MARGIN) + MARGIN).otherwise(float("inf")).alias("kth"))
        read = F.col("lower") <= F.col("kth")
        return bounds.join(kth, "query_id").groupBy("query_id").agg(F.count(F.lit(1)).alias("cells"), F.count_if(read).alias("cells_read"), F.sum("n").alias("rows"), F.sum(F.when(read, F.col("n"))).alias("rows_read"))


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(rounded(F.col("distance"), 6), "id")
    return found.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k).select("query_id", "id", "position", "distance")
