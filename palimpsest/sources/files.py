"""Files of a memory store: their metadata as a table, their contents, and writing them, through Spark's or Arrow's file systems."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def files(spark: SparkSession, root: str, dirs: Sequence[str], suffix: str = ".md") -> DataFrame:
    """path (below root), mtime (milliseconds), length, content of the files that lie in dirs themselves, not in folders below.

    Folders that are not there are left out. Content is read only where it is selected, and only of the files that a condition
    on modificationTime (kept as a column) leaves.
    """
    root = root.rstrip("/")
    there = [f"{root}/{d.strip('/')}" for d in dirs if exists(spark, f"{root}/{d.strip('/')}")]
    if not there:
        return spark.createDataFrame([], "path string, mtime long, length long, modificationTime timestamp, content binary")
    # A folder below must not be taken for a partition, nor its files for the folder's own.
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "false").load(there)
    # Hadoop writes file:/a where a caller writes file:///a.
    prefix = len(re.sub(r"^[a-z0-9]+:/*", "/", root)) + 2
    below = F.expr(rf"substring(regexp_replace(path, '^[a-z0-9]+:/*', '/'), {prefix})")
    return found.select(below.alias("path"), F.unix_millis("modificationTime").alias("mtime"), "length", "modificationTime", "content")


def write_files(rows: DataFrame, root: str) -> int:
    """Writes one file for each path of rows (path, place, text): its texts in the order of place. Returns how many files.

    A file is written piece by piece by one task, so that no file's texts meet in memory.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        now, out = None, None
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if path != now:
                    if out:
                        out.close()
                    fs.create_dir(f"{base}/{path}".rsplit("/", 1)[0], recursive=True)
                    now, out = path, fs.open_output_stream(f"{base}/{path}")
                    yield pa.RecordBatch.from_arrays([pa.array([path])], ["path"])
                out.write((text or "").encode())
        if out:
            out.close()

    return rows.repartition("path").sortWithinPartitions("path", "place").select("path", "text").mapInArrow(write, "path string").count()
