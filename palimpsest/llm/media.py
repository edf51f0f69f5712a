"""Media columns: Ogg.

A column of payloads becomes a column of Ogg physical streams and is read back from it. A reader finds pages by their
capture pattern, drops those whose checksum is wrong, parts them by serial number into logical streams, joins lacing
values into packets (which may go on over pages), and derives times from granule positions. Here a stream pair holds a
payload: one logical stream of 8-bit mono samples and one with a comment packet, their pages interleaved.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import table

#: Fixed by the container format (RFC 3533): capture pattern, header layout, flags, most segments of a page.
CAPTURE = b"OggS"
HEAD = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
SEGMENTS = 255
NO_GRANULE = -1

SAMPLES = b"\x80pcm-u8\x00"
COMMENT = b"\x81note\x00\x00\x00"
RATE = 8000
PACKET = 4000
BATCH_BYTES = 4 << 20
UNIT = 64

_FLIP = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, most significant bit first, from 0, as pages have it.

    zlib's runs over mirrored bits, so bytes are mirrored on the way in and the sum on the way out.
    """
    mirrored = zlib.crc32(page.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{mirrored:032b}"[::-1], 2)


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    page = HEAD.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body
    return page[:22] + struct.pack("<I", page_checksum(page)) + page[26:]


def pages_of(packets: list[bytes], granules: list[int], serial: int) -> list[bytes]:
    """The pages of one logical stream. The first packet, its header, has a page of its own.

    A page's granule position is that of the last packet that ends on it, or NO_GRANULE if none does.
    """
    pages, lacing, body, granule, goes_on = [], bytearray(), bytearray(), NO_GRANULE, False

    def close(last: bool, open_packet: bool) -> None:
        nonlocal granule, goes_on
        flags = (CONTINUED if goes_on else 0) | (FIRST if not pages else 0) | (LAST if last else 0)
        pages.append(_page(flags, granule, serial, len(pages), bytes(lacing), bytes(body)))
        lacing.clear()
        body.clear()
        granule, goes_on = NO_GRANULE, open_packet

    for i, (packet, at) in enumerate(zip(packets, granules, strict=True)):
        todo = [255] * (len(packet) // 255) + [len(packet) % 255]
        start = 0
        for k, n in enumerate(todo):
            if len(lacing) == SEGMENTS:
                close(False, k > 0)
            lacing.append(n)
            body += packet[start : start + n]
            start += n
        granule = at
        if i == 0 and len(packets) > 1:
            close(False, False)
    close(True, False)
    return pages


@dataclass
class Stream:
    """A logical stream as far as it could be read. times: the seconds at which packets end, where pages tell; lost: pages missing."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    ended: bool = False
    lost: int = 0
    pages: int = 0
    _next: int = 0
    _open: bytearray | None = None

    def take(self, flags: int, granule: int, number: int, lacing: bytes, body: bytes) -> None:
        if number != self._next:
            self.lost += max(1, number - self._next)
            self._open = None
        self._next, self.pages = number + 1, self.pages + 1
        skip = bool(flags & CONTINUED) and self._open is None  # the end of a packet whose start is lost
        part = self._open if self._open is not None and flags & CONTINUED else bytearray()
        start, done = 0, len(self.packets)
        for n in lacing:
            part += body[start : start + n]
            start += n
            if n < 255:
                if not skip:
                    self.packets.append(bytes(part))
                    self.granules.append(NO_GRANULE)
                part, skip = bytearray(), False
        self._open = part if lacing and lacing[-1] == 255 and not skip else None
        if granule != NO_GRANULE and len(self.packets) > done:
            self.granules[-1] = granule
        self.ended |= bool(flags & LAST)


def read_ogg(data: bytes) -> tuple[dict[int, Stream], int]:
    """The logical streams by serial number, and how many pages were dropped for a wrong checksum or a missing end."""
    streams: dict[int, Stream] = {}
    at, bad = data.find(CAPTURE), 0
    while at >= 0:
        end = 0
        if at + HEAD.size <= len(data):
            _, version, flags, granule, serial, number, said, n = HEAD.unpack_from(data, at)
            lacing = data[at + HEAD.size : at + HEAD.size + n]
            end = at + HEAD.size + n + sum(lacing)
            page = data[at:end]
            if version == 0 and len(lacing) == n and len(page) == end - at and page_checksum(page[:22] + b"\0\0\0\0" + page[26:]) == said:
                streams.setdefault(serial, Stream()).take(flags, granule, number, lacing, page[HEAD.size + n :])
            else:
                bad, end = bad + 1, 0
        else:
            bad += 1
        at = data.find(CAPTURE, end or at + 1)
    return streams, bad


def encode(payload: bytes, n_bytes: int) -> bytes:
    """A payload of 8-bit samples as an Ogg stream: equal payloads and lengths give equal bytes."""
    serial = zlib.crc32(payload) & 0x7FFFFFFF
    packets, granules = [SAMPLES + struct.pack("<I", RATE)], [0]
    for start in range(0, len(payload), PACKET):
        packets.append(payload[start : start + PACKET])
        granules.append(min(start + PACKET, len(payload)))
    samples = pages_of(packets, granules, serial)
    notes = pages_of([COMMENT, json.dumps({"bytes": n_bytes}).encode()], [0, len(payload)], serial ^ 0x80000000)
    # Headers of all streams come before other pages; then pages go by time.
    return b"".join([samples[0], notes[0], *samples[1:-1], *notes[1:], samples[-1]])


def decode(media: bytes) -> dict:
    """What a stream made by encode() holds, all of it from its pages."""
    streams, bad = read_ogg(media)
    own = [s for s in streams.values() if s.packets and s.packets[0].startswith(SAMPLES)]
    notes = [s for s in streams.values() if s.packets and s.packets[0].startswith(COMMENT)]
    if bad or len(own) != 1 or len(notes) != 1 or own[0].lost or not own[0].ended:
        raise ValueError("the media bytes are damaged")
    (rate,) = struct.unpack_from("<I", own[0].packets[0], len(SAMPLES))
    payload = b"".join(own[0].packets[1:])
    ends = [g for g in own[0].granules[1:] if g != NO_GRANULE]
    x = np.frombuffer(payload, np.uint8)
    level = x.astype(np.int64)
    feature = {
        "streams": len(streams), "pages": sum(s.pages for s in streams.values()), "packets": len(own[0].packets) - 1, "rate": rate,
        "seconds": ends[-1] / rate, "last_packet_at": (ends[-2] if len(ends) > 1 else 0) / rate, "mean": round(float(level.mean()), 4),
        "rms": round(float(np.sqrt(((level - 128) ** 2).mean())), 4), "peak": int(np.abs(level - 128).max()), "crossings": int(((x[1:] >= 128) != (x[:-1] >= 128)).sum()),
    }
    return {"n_bytes": json.loads(notes[0].packets[1])["bytes"], "payload": payload, "feature": json.dumps(feature)}


def payload_of(raw: bytes | None) -> tuple[bytes, int]:
    """A text's bytes and bytes 0 up to a positive multiple of UNIT; and the text's length. Null is an empty text."""
    raw = raw or b""
    return raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT)), len(raw)


def with_media(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without text_col and with a binary column `media`; a column of that name is replaced."""
    schema = docs.drop("media").drop(text_col).withColumn("media", F.lit(b"").cast("binary")).schema

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches, text_col):
            media = pa.array([encode(*payload_of(t)) for t in batch.column(text_col).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(f.name) if f.name != "media" else media for f in schema], [f.name for f in schema])

    return docs.withColumn(text_col, F.col(text_col).cast("binary")).mapInArrow(write, schema)


def _small(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The rows of batches in batches of about BATCH_BYTES of a binary column."""
    for batch in batches:
        first, size = 0, 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
            size += n
            if size >= BATCH_BYTES or i + 1 == batch.num_rows:
                yield batch.slice(first, i + 1 - first)
                first, size = i + 1, 0


def decoded(media: bytes | None) -> dict:
    """What decode() gives, with media_error null; or media_error, and nulls."""
    try:
        if media is None:
            raise ValueError("there are no media bytes")
        return {**decode(media), "media_error": None}
    except (ValueError, KeyError, IndexError, TypeError, struct.error) as e:
        return {"n_bytes": None, "payload": None, "feature": None, "media_error": str(e) or type(e).__name__}


def read_media(df: DataFrame, media_col: str = "media") -> DataFrame:
    """df with payload, n_bytes, feature read from media_col, and media_error; columns of these names are replaced.

    Null and damaged values give nulls in the first three, and say what is wrong in media_error, which is null else.
    """
    kinds = {"n_bytes": pa.int64(), "payload": pa.binary(), "feature": pa.string(), "media_error": pa.string()}
    schema = df.drop(*kinds).withColumns({"n_bytes": F.lit(0).cast("long"), "payload": F.lit(b"").cast("binary"), "feature": F.lit(""), "media_error": F.lit("")}).schema
    for f in schema:
        f.nullable = True
    names = [f.name for f in schema]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches, media_col):
            found = [decoded(m) for m in batch.column(media_col).to_pylist()]
            own = {c: pa.array([x[c] for x in found], kind) for c, kind in kinds.items()}
            yield pa.RecordBatch.from_arrays([own[n] if n in own else batch.column(n) for n in names], names)

    return df.mapInArrow(read, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = read_media(with_media(docs))
    return found.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, greatest(1, length(payload) - 63), 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


def expected(text: str | None) -> dict:
    """The query's columns that follow from the text alone, for tests."""
    payload, n = payload_of((text or "").encode())
    return {"n_bytes": n, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:])}
