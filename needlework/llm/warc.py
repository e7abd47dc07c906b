"""WARC records in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each with whole WARC
records, a skippable frame with the map from record identifiers to (frame,
offset in the frame, length), and the seek table of the Zstandard seekable
format as its last skippable frame. A reader goes from the footer to the table,
to one frame, to one record.

Bundles are rows of a Parquet table in the shared folder: its committer makes
retried tasks safe, and any store that Spark writes to will do. ``export``
puts them out as plain ``.warc.zst`` files.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratch_path
from .bpe import small

#: Fixed values of the Zstandard seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
RECORD_MAP = 0x184D2A50
DATE = "1970-01-01T00:00:00Z"
BUNDLE_SCHEMA = "bundle string, records bigint, content binary"


class BundleWriter:
    """One bundle; frames close once they hold ``frame_bytes`` of records."""

    def __init__(self, frame_bytes: int = 256 << 10, level: int = 3):
        self.frame_bytes, self.compressor = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.out, self.held, self.held_bytes = [], [], 0
        self.frames: list[tuple[int, int]] = []
        self.map: list[tuple[str, int, int, int]] = []
        self.size = 0

    def add(self, record_id: str, record: bytes) -> None:
        self.map.append((record_id, len(self.frames), self.held_bytes, len(record)))
        self.held.append(record)
        self.held_bytes += len(record)
        if self.held_bytes >= self.frame_bytes:
            self._close()

    def _close(self) -> None:
        if self.held:
            packed = self.compressor.compress(b"".join(self.held))
            self.frames.append((len(packed), self.held_bytes))
            self.out.append(packed)
            self.size += len(packed)
            self.held, self.held_bytes = [], 0

    def finish(self) -> bytes:
        self._close()
        index = self.compressor.compress(json.dumps(self.map).encode())
        self.out.append(struct.pack("<II", RECORD_MAP, len(index)) + index)
        self.frames.append((len(index) + 8, 0))
        table = b"".join(struct.pack("<II", *f) for f in self.frames)
        table += struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.append(struct.pack("<II", SKIPPABLE, len(table)) + table)
        return b"".join(self.out)


class BundleReader:
    """Random access to the records of a bundle; keeps the last frame it opened."""

    def __init__(self, content: bytes):
        self.content = content
        count, flags, magic = struct.unpack_from("<IBI", content, len(content) - 9)
        if magic != SEEKABLE:
            raise ValueError("no seek table at the end")
        entry = 12 if flags & 0x80 else 8
        at = len(content) - 9 - count * entry
        if struct.unpack_from("<II", content, at - 8) != (SKIPPABLE, count * entry + 9):
            raise ValueError("damaged seek table")
        self.frames, start = [], 0
        for k in range(count):
            packed, size = struct.unpack_from("<II", content, at + k * entry)
            self.frames.append((start, packed, size))
            start += packed
        if start != at - 8:
            raise ValueError("frames and seek table disagree")
        self.decompressor, self.last = zstandard.ZstdDecompressor(), (-1, b"")
        start, packed, _ = self.frames[-1]
        magic, length = struct.unpack_from("<II", content, start)
        if magic != RECORD_MAP or length != packed - 8:
            raise ValueError("no record map")
        self.map = {r: (f, o, n) for r, f, o, n in json.loads(self.decompressor.decompress(content[start + 8 : start + packed]))}

    def frame(self, k: int) -> bytes:
        if self.last[0] != k:
            start, packed, size = self.frames[k]
            data = self.decompressor.decompress(self.content[start : start + packed], max_output_size=size)
            if len(data) != size:
                raise ValueError("damaged frame")
            self.last = (k, data)
        return self.last[1]

    def record(self, record_id: str) -> bytes:
        frame, offset, length = self.map[record_id]
        return self.frame(frame)[offset : offset + length]


def record_uri(page_id: int | None, digest: str, copy: int = 0) -> str:
    """Different for rows of one id: by payload (hex SHA-1), then by copy."""
    return f"<urn:page:{'null' if page_id is None else page_id}:{digest[:20]}:{copy}>"


def page_of(uri: str) -> int | None:
    page = uri[1:-1].split(":")[2]
    return None if page == "null" else int(page)


def warc_record(uri: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A response, or a revisit with the headers of the answer and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    clean = "".join(c for c in url or "" if c not in "\r\n").strip()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {uri}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean or 'about:blank'}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = lambda b: dict(x.split(": ", 1) for x in b.decode().split("\r\n")[1:])
    warc = fields(head)
    block, end = rest[: int(warc["Content-Length"])], rest[int(warc["Content-Length"]) :]
    if end != b"\r\n\r\n":
        raise ValueError("a record's length and its end disagree")
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http), payload


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def first_pages(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least_bytes: int = 0, salts: int = 64) -> DataFrame:
    """(page_id, digest, first_id) by different page: the smallest id with an equal payload.

    Only ids and digests are shuffled. A digest is first reduced in ``salts``
    parts, so copies of a third of all pages don't meet in one task: what meets
    is a row per part.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    slim = pages.select(F.col(id_col).alias("page_id"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n"))
    slim = slim.where(F.col("n") >= least_bytes).select("page_id", "digest", F.pmod(F.xxhash64("page_id"), F.lit(salts)).alias("salt")).distinct()
    parts = slim.groupBy("digest", "salt").agg(F.min("page_id").alias("first_id"))
    whole = parts.groupBy("digest").agg(F.min("first_id").alias("first_id"), F.collect_list("salt").alias("salt"))
    return slim.join(whole.select("digest", "first_id", F.explode("salt").alias("salt")), ["digest", "salt"]).select("page_id", "digest", "first_id")


def _key():
    """The page's id as a key that is never null."""
    return F.coalesce(F.col("page_id").cast("string"), F.lit("null"))


def write_bundles(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, bundle_bytes: int = 16 << 20) -> None:
    """A WARC record per row of ``pages``, in bundles of about ``bundle_bytes``, as a table at ``path``.

    Of rows with equal payloads of ``least_bytes`` or more the one with the
    smallest id is a response, the others are revisits that refer to it; rows
    that repeat an id and payload refer to the first of them. A null payload is
    empty, a null url is ``about:blank``; null ids come after all others. A
    payload of any length is one record, in memory whole.
    Other columns are ignored; an empty table gives an empty one.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest")).withColumn("key", _key())
    first = first_pages(pages.withColumn(id_col, F.col(id_col).cast("long")), id_col, payload_col, least_bytes)
    first = first.select("digest", _key().alias("key"), "first_id", F.lit(True).alias("linked"))
    # the window has the join's keys, so the payloads are shuffled once
    copy = F.row_number().over(W.partitionBy("digest", "key").orderBy("url")) - 1
    joined = rows.join(first, ["digest", "key"], "left").withColumn("copy", copy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, writer = TaskContext.get().partitionId(), 0, BundleWriter()

        def close() -> pa.RecordBatch:
            nonlocal made, writer
            row = [[f"{part:06d}-{made:04d}"], [len(writer.map)], [writer.finish()]]
            made, writer = made + 1, BundleWriter()
            return pa.RecordBatch.from_arrays([pa.array(row[0], pa.string()), pa.array(row[1], pa.int64()), pa.array(row[2], pa.binary())], ["bundle", "records", "content"])

        for batch in batches:
            for some in small(batch, 200):
                for row in some.to_pylist():
                    uri = record_uri(row["page_id"], row["digest"], row["copy"])
                    original = row["linked"] and (row["first_id"] != row["page_id"] or row["copy"] > 0)
                    refers = record_uri(row["first_id"], row["digest"]) if original else None
                    digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
                    writer.add(uri, warc_record(uri, row["url"], row["payload"], digest, refers))
                    if writer.size >= bundle_bytes:
                        yield close()
        if writer.map:
            yield close()

    joined.mapInArrow(run, BUNDLE_SCHEMA).write.parquet(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the bundles at ``path``, found through its map: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    Payloads of responses are checked against length and digest. Those of
    revisits are null; their bytes and digest are the original's.
    """
    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                reader, rows = BundleReader(content.as_py()), []
                for record_id in reader.map:
                    warc, http, payload = parse_record(reader.record(record_id))
                    digest, size, kind = warc["WARC-Payload-Digest"].removeprefix("sha1:"), int(http["Content-Length"]), warc["WARC-Type"]
                    if kind == "response" and (len(payload) != size or sha1_base32(payload) != digest):
                        raise ValueError(f"damaged payload of {record_id}")
                    refers = page_of(warc["WARC-Refers-To"]) if kind == "revisit" else None
                    rows.append((page_of(warc["WARC-Record-ID"]), warc["WARC-Target-URI"], size, digest, kind, refers, payload if kind == "response" else None))
                    if len(rows) == 200:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names)

    return spark.read.schema(BUNDLE_SCHEMA).parquet(path).select("content").mapInArrow(run, schema)


def export(spark: SparkSession, path: str, folder: str) -> None:
    """The bundles at ``path`` as files in ``folder``, which every executor must mount."""

    def run(rows) -> None:
        os.makedirs(folder, exist_ok=True)
        for row in rows:
            to = os.path.join(folder, f"{row['bundle']}.warc.zst")
            with open(f"{to}.{TaskContext.get().taskAttemptId()}", "wb") as f:
                f.write(row["content"])
            os.replace(f.name, to)

    spark.read.schema(BUNDLE_SCHEMA).parquet(path).foreachPartition(run)


def roundtrip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``pages`` written as bundles to the shared folder and read back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_bundles(pages, path, least_bytes=least_bytes)
    return read_records(pages.sparkSession, path)
