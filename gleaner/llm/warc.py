"""WARC files and the chunked record table.

A record becomes rows ``(record_id, chunk_no, ...)`` of at most ``chunk_bytes`` of payload each,
with digests of the payload up to and with the chunk, so that the last chunk's digest is the
payload's. Files are read front to back through a buffer of fixed size, plain or gzip (one member
for each record, or several in one), and rows leave in batches of bounded size: neither a
record nor a file ever stands in memory whole.

Damage costs what it hits and no more: after a record without a usable length, bytes that are no record,
a gzip member that doesn't unpack or a torn end, reading goes on at the next head, and a row with a
``problem`` and without a chunk says what was lost.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import col, shared_dir, written
from gleaner.llm.files import one_task_each, open_path, rename

CHUNK_BYTES = 1 << 16
_BATCH_BYTES = 1 << 23
_BLOCK = 1 << 16
#: Heads have no bound: lines of these fields are kept whole, of others only the start.
_FIELDS = (b"content-length", b"content-type", b"warc-type", b"warc-record-id", b"warc-target-uri", b"warc-payload-digest")
_HEAD = re.compile(rb"WARC/\d+\.\d+\s*\Z")
CHUNKS = T.StructType([T.StructField(n, t) for n, t in (
    ("file", T.StringType()), ("record_id", T.StringType()), ("warc_type", T.StringType()), ("target_uri", T.StringType()), ("payload_bytes", T.LongType()),
    ("chunk_no", T.IntegerType()), ("offset", T.LongType()), ("n_bytes", T.IntegerType()), ("is_last", T.BooleanType()), ("sha256_so_far", T.StringType()), ("digest_ok", T.BooleanType()), ("chunk", T.BinaryType()), ("problem", T.StringType()))])


class _Damage(Exception):
    """The stream is broken here; what follows begins elsewhere."""


def _unzipped(data: bytes, stream: BinaryIO) -> Iterator[bytes | None]:
    """The members of a gzip file one after another, a block at a time. None stands where a member
    doesn't unpack: what follows is from the next place at which one does."""
    while data := data or stream.read(_BLOCK):
        data = data.lstrip(b"\0")
        if not data:
            continue
        made, fresh = zlib.decompressobj(31), True
        try:
            while not made.eof:
                if out := made.decompress(data, _BLOCK):
                    yield out
                data, fresh = made.unconsumed_tail, False
                if not data and not made.eof and not (data := stream.read(_BLOCK)):
                    yield None
                    return
            data = made.unused_data
        except zlib.error:
            yield None
            at = data.find(b"\x1f\x8b\x08", int(fresh))
            while at < 0:
                more = stream.read(_BLOCK)
                if not more:
                    return
                data = data[-2:] + more
                at = data.find(b"\x1f\x8b\x08")
            data = data[at:]


def _plain(data: bytes, stream: BinaryIO) -> Iterator[bytes]:
    while data:
        yield data
        data = stream.read(_BLOCK)


class _Reader:
    """Lines and bytes of a stream of blocks, of which one or two stand in memory."""

    def __init__(self, blocks: Iterator[bytes | None]) -> None:
        self.blocks, self.block, self.at = blocks, b"", 0

    def more(self) -> bool:
        if self.at < len(self.block):
            return True
        block = next(self.blocks, b"")
        self.block, self.at = block or b"", 0
        if block is None:
            raise _Damage
        return bool(block)

    def read(self, n: int) -> bytes:
        """So many bytes, fewer only at the end."""
        parts = []
        while n and self.more():
            parts.append(self.block[self.at : self.at + n])
            self.at += len(parts[-1])
            n -= len(parts[-1])
        return b"".join(parts)

    def line(self, most: int | None = None, known: tuple[bytes, ...] | None = None, folded: bool = False) -> tuple[bytes, int]:
        """The start of the next line and its size, at most ``most``; the whole line if it begins with a known word."""
        parts, size, kept = [], 0, 0
        while (most is None or size < most) and self.more():
            end = self.block.find(b"\n", self.at) + 1
            stop = end or len(self.block)
            if most is not None:
                stop = min(stop, self.at + most - size)
            piece = self.block[self.at : stop]
            self.at, size = stop, size + len(piece)
            if kept < 128 or (known and (folded or b"".join(parts[:4])[:32].lower().startswith(known))):
                parts.append(piece if known else piece[:128])
                kept += len(parts[-1])
            if end and stop == end:
                break
        return b"".join(parts), size

    def to_head(self) -> tuple[int, bool]:
        """Goes behind the next line that opens a record; bytes skipped before it, and whether there is one."""
        lost = 0
        while True:
            line, size = self.line()
            if not size:
                return lost, False
            if size <= 128 and _HEAD.match(line):
                return lost, True
            lost += size if size > 128 or line.strip() else 0

    def fields(self) -> dict[str, str] | None:
        """The known fields of a record's head, up to and with the empty line; None if the stream ends before that."""
        out: dict[str, str] = {}
        name = ""
        while True:
            line, size = self.line(known=_FIELDS, folded=bool(name) and self.more() and self.block[self.at : self.at + 1] in b" \t")
            if not size:
                return None
            if size <= 128 and not line.strip():
                return out
            text = line.decode("utf-8", "replace")
            if line[:1] in b" \t":
                if name:
                    out[name] = f"{out[name]} {text.strip()}".strip()
                continue
            key, _, value = text.partition(":")
            name = key.strip().lower() if key.strip().lower().encode() in _FIELDS and _ else ""
            if name:
                out[name] = value.strip()

    def skip_http_head(self, left: int) -> int:
        """Bytes of the lines up to and with the first empty one, within so many bytes."""
        gone = 0
        while gone < left:
            line, size = self.line(left - gone)
            gone += size
            if not size or (size <= 128 and not line.strip()):
                break
        return gone


def _digest_like(name: str) -> "hashlib._Hash | None":
    return hashlib.new(name.lower()) if name.lower() in ("sha1", "sha256", "md5") else None


def _same_digest(value: str, digest: bytes) -> bool:
    return value.upper() in (digest.hex().upper(), base64.b32encode(digest).decode().rstrip("="), base64.b32encode(digest).decode())


def read_records(stream: BinaryIO, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple]:
    """The chunk rows of a WARC stream, without the file's name. A payload is a response's body
    after its HTTP head, and other records' block. An empty payload has one row of no bytes. The last
    row says whether the payload agrees with ``WARC-Payload-Digest``, null where there is none.

    A row with a ``problem`` has no chunk: ``junk`` (so many ``payload_bytes`` that are no record), ``length`` (the record's
    length is missing, no number or negative), ``cut`` (the stream ends inside the record, whose rows so far are there and
    none of them last), ``unpack`` (a gzip member is broken; the record it was in, if known, isn't complete)."""
    start = stream.read(_BLOCK)
    reader = _Reader(_unzipped(start, stream) if start[:2] == b"\x1f\x8b" else _plain(start, stream))
    nobody: tuple[str | None, ...] = (None, None, None)
    who = nobody

    def problem(kind: str, size: int | None = None) -> tuple:
        return (*who, size, None, None, None, None, None, None, None, kind)

    while True:
        try:
            who = nobody
            lost, found = reader.to_head()
            if lost:
                yield problem("junk", lost)
            if not found:
                return
            fields = reader.fields()
            if fields is None:
                yield problem("cut")
                return
            who = (fields["warc-record-id"].strip("<>") if "warc-record-id" in fields else None, fields.get("warc-type"), fields.get("warc-target-uri"))
            said = fields.get("content-length", "")
            if not re.fullmatch("[0-9]{1,18}", said):
                yield problem("length")
                continue
            left = int(said)
            if fields.get("warc-type") == "response" and fields.get("content-type", "").startswith("application/http"):
                left -= reader.skip_http_head(left)
            name, _, digest = fields.get("warc-payload-digest", "").partition(":")
            other = _digest_like(name) if digest else None
            size, at, number, sha = left, 0, 0, hashlib.sha256()
            while True:
                chunk = reader.read(min(chunk_bytes, left))
                if left and not chunk:
                    yield problem("cut", size - at)
                    return
                sha.update(chunk)
                if other:
                    other.update(chunk)
                left -= len(chunk)
                ok = _same_digest(digest, other.digest()) if other and not left else None
                yield (*who, size, number, at, len(chunk), not left, sha.hexdigest(), ok, chunk, None)
                at, number = at + len(chunk), number + 1
                if not left:
                    break
        except _Damage:
            yield problem("unpack")


def read_warc_chunks(files: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table of WARC files, given a table with their paths (column ``path``). Null paths
    and repeated ones are skipped; no files, and files of no bytes, give no rows. Each file is a task. Payloads of any length go
    through a chunk at a time. Repeated records are separate ones. Only the paths are read of the table, so other columns can't clash."""
    paths = one_task_each(files.select("path").where("path is not null").distinct(), "path")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("file", pa.string()), ("record_id", pa.string()), ("warc_type", pa.string()), ("target_uri", pa.string()), ("payload_bytes", pa.int64()), ("chunk_no", pa.int32()), ("offset", pa.int64()), ("n_bytes", pa.int32()), ("is_last", pa.bool_()), ("sha256_so_far", pa.string()), ("digest_ok", pa.bool_()), ("chunk", pa.binary()), ("problem", pa.string())])
        for batch in it:
            for path in batch.column(0).to_pylist():
                with open_path(path, "rb") as stream:
                    rows, held = [], 0
                    for row in read_records(stream, chunk_bytes):
                        rows.append((path, *row))
                        held += len(row[-2] or b"") + 256 + len(row[2] or "")
                        if held >= _BATCH_BYTES:
                            yield _batch(rows, kinds)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows, kinds)

    return paths.mapInArrow(batches, CHUNKS)


def _batch(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)


def write_warc(rows: DataFrame, path: str, id_col: str, uri_col: str, payload_col: str, level: int = 1) -> DataFrame:
    """Writes a gzip member for each row, and a file for each task below ``path``; returns the table of files ``(path, records,
    bytes)``. A null payload is an empty one, a null id or URI is written as the empty word, and a line
    break in them as a space. Payloads and URIs of any length are written whole, repeated rows as separate records; an empty table
    gives no files. Columns are chosen by name and get new names at once, so others can't clash. A file has its name only when it
    is complete, and a repeated task leaves one more, which the table of files doesn't list."""
    some = rows.select(col(id_col).cast("string").alias("id"), col(uri_col).cast("string").alias("uri"), col(payload_col).cast("binary").alias("payload"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{path}/part-{uuid.uuid4().hex}.warc.gz"
        out, records, size = None, 0, 0
        for batch in it:
            for i, uri, payload in zip(*batch.columns, strict=True):
                out = out or open_path(name + ".part", "wb")
                body = memoryview(payload.as_buffer()) if payload.is_valid else memoryview(b"")
                named = [re.sub(r"[\r\n]+", " ", x.as_py() or "") for x in (i, uri)]
                sha = base64.b32encode(hashlib.sha1(body).digest()).decode()
                head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:row:{named[0]}>\r\nWARC-Target-URI: {named[1]}\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: text/html\r\nWARC-Payload-Digest: sha1:{sha}\r\nContent-Length: {len(body)}\r\n\r\n"
                made = zlib.compressobj(level, zlib.DEFLATED, 31)
                for part in (head.encode(), *(body[k : k + CHUNK_BYTES] for k in range(0, len(body), CHUNK_BYTES)), b"\r\n\r\n"):
                    size += out.write(made.compress(part))
                size += out.write(made.flush())
                records += 1
        if out:
            out.close()
            rename(name + ".part", name)
            yield pa.RecordBatch.from_pydict({"path": [name], "records": pa.array([records], pa.int64()), "bytes": pa.array([size], pa.int64())})

    return written(some.mapInArrow(batches, "path string, records bigint, bytes bigint"), "warc-files")


def op1_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written to WARC files in the shared folder and streamed back as chunks."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    files = write_warc(pages, shared_dir(spark, "warc"), "page_id", "url", "html")
    chunks = read_warc_chunks(files)
    page = F.regexp_extract("record_id", "^urn:row:(-?[0-9]+)$", 1)
    return chunks.select(page.cast("long").alias("page_id"), F.col("target_uri").alias("url"), "payload_bytes", "chunk_no", "offset", "n_bytes", "is_last", "sha256_so_far", "digest_ok", F.translate(F.base64("chunk"), "\r\n", "").alias("chunk_base64"))


OP1_SQL = f"""
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS b FROM pages),
c AS (SELECT p.*, unnest(range(0, greatest(1, CAST(ceil(octet_length(b) / {CHUNK_BYTES}.0) AS BIGINT)))) AS k FROM p)
SELECT page_id, url, octet_length(b) AS payload_bytes, CAST(k AS INTEGER) AS chunk_no, k * {CHUNK_BYTES} AS "offset",
  CAST(octet_length(b[k * {CHUNK_BYTES} + 1 : (k + 1) * {CHUNK_BYTES}]) AS INTEGER) AS n_bytes,
  (k + 1) * {CHUNK_BYTES} >= octet_length(b) AS is_last, sha256(b[1 : (k + 1) * {CHUNK_BYTES}]) AS sha256_so_far,
  CASE WHEN (k + 1) * {CHUNK_BYTES} >= octet_length(b) THEN TRUE END AS digest_ok,
  base64(b[k * {CHUNK_BYTES} + 1 : (k + 1) * {CHUNK_BYTES}]) AS chunk_base64
FROM c
"""
