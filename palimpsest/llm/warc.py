"""WARC archives as a PySpark data source.

Reading: files are dealt to partitions by size; a partition goes from record to record, parses a record's headers first, and
goes past its block undecoded if pushed predicates (on record_type, record_id, target_uri, payload_digest, refers_to) rule
it out or payloads are not asked for (option payload=false). Records that this source compressed say how long they are in
their gzip header, so that going past one does not even inflate it; others are inflated without being kept.
Writing: each task writes files of its own; a manifest that lists those of the tasks that were committed makes them visible,
so that tasks that ran twice or were lost leave nothing to read.
"""

from __future__ import annotations

import gzip
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from palimpsest.llm.common import scratch, table

SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_length long, payload binary"
#: Fixed by the format (WARC 1.1): the names of its headers, and the profile of revisits of an identical payload.
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
BATCH_BYTES = 8 << 20
READ = 1 << 20
#: The subfield of a gzip header that holds the length of the member.
FIELD = b"sl"


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(row: dict, date: str) -> bytes:
    """One record: a response with its payload, or a revisit with the HTTP headers alone."""
    payload = row["payload"] or b""
    length = row["payload_length"] if row["payload_length"] is not None else len(payload)
    block = HTTP % length + (payload if row["record_type"] == "response" else b"")
    head = ["WARC/1.1", f"WARC-Date: {date}", *[f"{h}: {_clean(str(row[c]))}" for c, h in HEADERS.items() if row[c] is not None]]
    if row["record_type"] == "revisit":
        head.append(f"WARC-Profile: {PROFILE}")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """data as a gzip member of its own, whose header holds the member's length."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    size = 10 + 2 + 8 + len(body) + 8
    head = struct.pack("<4sIBB", b"\x1f\x8b\x08\x04", 0, 0, 255) + struct.pack("<H2sHI", 8, FIELD, 4, size & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class _Records:
    """The bytes of one record after another, from a file that seeks: a plain one, or a gzip file as it inflates."""

    def __init__(self, f):
        self.f, self.data = f, b""

    def upto(self, mark: bytes) -> bytes | None:
        """What comes before and with mark; None at the end of the file."""
        while (i := self.data.find(mark)) < 0:
            more = self.f.read(READ)
            if not more:
                return None
            self.data += more
        out, self.data = self.data[: i + len(mark)], self.data[i + len(mark) :]
        return out

    def take(self, n: int) -> bytes | None:
        """The next n bytes; None if the file has fewer."""
        while len(self.data) < n:
            more = self.f.read(max(READ, n - len(self.data)))
            if not more:
                return None
            self.data += more
        out, self.data = self.data[:n], self.data[n:]
        return out

    def skip(self, n: int) -> None:
        if n > len(self.data):
            self.f.seek(n - len(self.data), 1)
            self.data = b""
        else:
            self.data = self.data[n:]


def _members(f) -> Iterator[tuple[bytes, object]]:
    """Members that say their length: the first bytes of each, inflated, and a function that inflates the rest."""
    while True:
        head = f.read(20)
        if len(head) < 20 or head[:4] != b"\x1f\x8b\x08\x04":
            return
        (size,) = struct.unpack_from("<I", head, 16)
        start = f.tell() - len(head)
        z = zlib.decompressobj(31)
        try:
            first = z.decompress(head + f.read(max(0, min(size - 20, 2048))), 4096)
        except zlib.error:
            f.seek(start + max(size, 20))
            continue

        def rest(z=z, first=first, at=f.tell(), left=start + size) -> bytes:
            f.seek(at)
            return first + z.decompress(z.unconsumed_tail + f.read(left - at)) + z.flush()

        yield first, rest
        f.seek(start + max(size, 20))


def parse_headers(head: bytes) -> dict[str, str]:
    """Header names in lower case to values; the first of a name counts, and lines that go on are joined."""
    out: dict[str, str] = {}
    last = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            last = name.strip().lower()
            out.setdefault(last, value.strip())
    return out


def _length(headers: dict[str, str]) -> int | None:
    """The length of a record's block; None where the header is missing or no number."""
    said = headers.get("content-length", "")
    return int(said) if said.isascii() and said.isdigit() else None


def _columns(headers: dict[str, str]) -> dict:
    out = {c: headers.get(h.lower()) for c, h in HEADERS.items()}
    for c in ("record_id", "refers_to"):
        if out[c]:
            out[c] = out[c].strip("<>")
    return out


def _body(block: bytes) -> tuple[int | None, bytes]:
    """The length that the HTTP headers of a block give, and what comes after them."""
    head, mark, rest = block.partition(b"\r\n\r\n")
    if not head.startswith(b"HTTP/") or not mark:
        return None, block
    said = parse_headers(head).get("content-length")
    return (int(said) if said and said.isdigit() else None), rest


def _open_head(block: bytes) -> bool:
    """Whether HTTP headers begin a block and have not ended in what is there of it."""
    return (block.startswith(b"HTTP/") or b"HTTP/".startswith(block)) and b"\r\n\r\n" not in block


@dataclass
class _Files(InputPartition):
    paths: list[str]

    def __init__(self, paths: list[str]):
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"], str(options.get("payload", "true")).lower() == "true"
        self.split = int(options.get("split_bytes", 32 << 20))
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else ""
            if column in HEADERS and isinstance(f, EqualTo):
                self.tests.append((column, "in", (f.value,)))
            elif column in HEADERS and isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            elif column in HEADERS and isinstance(f, StringStartsWith):
                self.tests.append((column, "starts", (f.value,)))
            elif column in HEADERS and isinstance(f, IsNotNull):
                self.tests.append((column, "set", ()))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True)) if fs.get_file_info(root).type == pafs.FileType.Directory else [fs.get_file_info(root)]
        manifests = [i.path for i in found if i.base_name.startswith("_manifest-")]
        if manifests:
            files = []
            for m in manifests:
                with fs.open_input_stream(m) as f:
                    files += [(f"{root}/{name}", size) for name, size in json.loads(f.read())]
        else:
            files = [(i.path, i.size) for i in found if i.path.endswith((".warc", ".warc.gz"))]
        parts, now, size = [], [], 0
        for path, n in sorted(files, key=lambda x: (-x[1], x[0])):
            if now and size + n > self.split:
                parts.append(_Files(now))
                now, size = [], 0
            now.append(path)
            size += n
        return [*parts, _Files(now)] if now else parts or [_Files([])]

    def wanted(self, row: dict) -> bool:
        for column, kind, values in self.tests:
            x = row[column]
            if x is None or kind == "in" and x not in values or kind == "starts" and not x.startswith(values[0]):
                return False
        return True

    def records(self, f) -> Iterator[dict]:
        """The wanted records of a file. One without a proper length, or with damaged bytes, is left out and reading goes on
        after it; one that the file cuts short, or a gzip file that is not whole, ends the reading of that file."""
        magic = f.read(16)
        f.seek(0)
        if magic[:4] == b"\x1f\x8b\x08\x04" and magic[12:14] == FIELD:
            for first, rest in _members(f):
                try:
                    whole = first if b"\r\n\r\n" in first else rest()
                    head, _, more = whole.partition(b"\r\n\r\n")
                    headers = parse_headers(head)
                    row, n = _columns(headers), _length(headers)
                    if n is None or not self.wanted(row):
                        continue
                    need = n if self.payload or _open_head(more[:n]) else min(n, 1024)
                    block = more if len(more) >= need else rest().partition(b"\r\n\r\n")[2]
                except zlib.error:
                    continue
                if len(block) >= need:
                    yield self.row(row, block[:n], n)
            return
        source = _Records(gzip.GzipFile(fileobj=f) if magic[:2] == b"\x1f\x8b" else f)
        try:
            while (head := source.upto(b"\r\n\r\n")) is not None:
                headers = parse_headers(head.lstrip(b"\r\n"))
                row, n = _columns(headers), _length(headers)
                if n is None:
                    if source.upto(b"\r\nWARC/") is None:
                        return
                    source.data = b"WARC/" + source.data
                    continue
                if not self.wanted(row):
                    source.skip(n + 4)
                    continue
                block = source.take(n if self.payload else min(n, 4096))
                while block is not None and len(block) < n and _open_head(block):
                    more = source.take(min(n - len(block), len(block)))
                    block = more and block + more
                if block is None:
                    return
                source.skip(n + 4 - len(block))
                yield self.row(row, block, n)
        except (EOFError, OSError, zlib.error):
            return

    def row(self, row: dict, block: bytes, n: int) -> dict:
        said, body = _body(block)
        own = n - (len(block) - len(body))
        row["payload_length"] = own if row["record_type"] != "revisit" or said is None else said
        row["payload"] = body if self.payload and row["record_type"] != "revisit" else None
        return row

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.int64() if c == "payload_length" else pa.binary() if c == "payload" else pa.string() for c in names]
        rows, size = [], 0
        for path in partition.paths:
            with fs.open_input_file(path) as f:
                for row in self.records(f):
                    rows.append(row)
                    size += 500 + len(row["payload"] or b"")
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds, strict=True)], names)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds, strict=True)], names)


@dataclass
class _Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.date = options["path"], options.get("date", "1970-01-01T00:00:00Z")
        self.level, self.most = int(options.get("level", 1)), int(options.get("file_bytes", 64 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    files.append([f"part-{uuid.uuid4().hex}.warc" + ".gz" * bool(self.level), 0])
                    out, size = fs.open_output_stream(f"{root}/{files[-1][0]}", compression=None), 0
                data = record_bytes(row, self.date)
                size += out.write(member(data, self.level) if self.level else data)
                files[-1][1] = size
                if size >= self.most:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return _Written(files)

    def commit(self, messages: list) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([x for m in messages if m is not None for x in m.files]).encode())

    def abort(self, messages: list) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        for m in messages:
            for name, _ in m.files if m is not None else []:
                fs.delete_file(f"{root}/{name}")


class WarcDataSource(DataSource):
    """spark.read.format("warc") with path, payload, split_bytes; df.write.format("warc") with path, date, level (0: not compressed), file_bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The records at path. Read anew for each query: Spark 4.1 keeps the predicates that a query pushed for later ones on the same DataFrame."""
    register(spark)
    return spark.read.format("warc").option("path", path).options(**options).load()


def records_of(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least_bytes: int = 100) -> DataFrame:
    """A record for each page, with the columns of SCHEMA.

    Of pages with the same payload of at least least_bytes bytes, that with the smallest id is the response and the others
    revisit it; other pages are responses. A null body is an empty payload. Rows that repeat the smallest id with its
    payload are responses too; a page without an id is a response and is referred to by none.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("target_uri"), F.coalesce(F.col(body_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "payload_length": F.octet_length("payload").cast("long")})
    firsts = rows.where((F.col("payload_length") >= least_bytes) & F.col("id").isNotNull()).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("k"))
    firsts = firsts.where("k > 1").select(F.col("digest").alias("of"), "first")
    # Pages carry their payloads: a hashed join does not sort them.
    rows = rows.join(firsts.hint("shuffle_hash"), F.col("digest") == F.col("of"), "left")
    again = F.coalesce(F.col("id") != F.col("first"), F.lit(False))
    return rows.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("none")), F.lit(">")).alias("record_id"), "target_uri",
        F.when(again, F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))).alias("refers_to"), F.concat(F.lit("sha256:"), "digest").alias("payload_digest"), "payload_length",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    path = scratch(spark, "warc")
    path = path if "://" in path else f"file://{path}" if path.startswith("/") else path.replace("file:/", "file:///", 1)
    records_of(table(spark, sf_dir, "pages")).write.format("warc").mode("append").option("path", path).save()
    # Responses are digested as read; revisits, whose headers alone are read, say the digest of the one they refer to.
    responses = read(spark, path).where("record_type = 'response'").withColumn("digest", F.sha2("payload", 256))
    revisits = read(spark, path, payload="false").where("record_type = 'revisit'").withColumn("digest", F.substring_index("payload_digest", ":", -1))
    number = lambda c: F.substring_index(c, ":", -1).try_cast("long")
    out = [number(F.col("record_id")).alias("page_id"), F.col("payload_length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", number(F.col("refers_to")).alias("refers_to")]
    return responses.select(*out).unionByName(revisits.select(*out))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
k AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM k
"""
