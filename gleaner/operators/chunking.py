"""Chunks and windows of entries, as byte ranges.

Chunking carries its position from chunk to chunk, so it runs in Arrow batches; windows of fixed
size are plain arithmetic and stay in the JVM.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.storage import slices, small_batches, spread

CHUNK, OVERLAP, SNAP = 512, 256, 64
WINDOW, STRIDE = 384, 192
_CHUNKS = "wal_entry_id bigint, source_path string, chunk_id int, byte_start bigint, byte_end bigint, line_start int, line_end int, text string"


def chunk_spans(data: bytes, size: int = CHUNK, overlap: int = OVERLAP, snap: int = SNAP) -> list[tuple[int, int, int, int]]:
    """``(start, end, first line, last line)`` of each chunk. Ends, and starts after the first,
    move to the nearest line start within ``snap`` bytes (the earlier of two as near), then back to the
    start of a character."""
    size, n = max(1, size), len(data)
    overlap = min(overlap, size - 1)
    breaks = (np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1).tolist()

    def near(at: int, low: int, high: int) -> int:
        """The line start nearest to ``at`` between ``low`` and ``high``, else ``at``."""
        k = bisect_right(breaks, at)
        left = breaks[k - 1] if k and breaks[k - 1] > at - snap else None
        right = breaks[k] if k < len(breaks) and breaks[k] <= min(n, at + snap) else None
        best = left if right is None or left is not None and at - left <= right - at else right
        return best if best is not None and low < best < high else at

    def whole(at: int) -> int:
        while 0 < at < n and data[at] & 0xC0 == 0x80:
            at -= 1
        return min(at, n)

    out, start = [], 0
    while start < n:
        end = whole(n if start + size >= n else near(start + size, start, n + 1))
        if end <= start:
            break
        first, last = bisect_right(breaks, start) + 1, bisect_left(breaks, end + 1) + 1
        out.append((start, end, first, max(first, last)))
        if end == n:
            break
        again = max(0, end - overlap)
        begin = whole(near(again, -1, end) if again else 0)
        start = begin if begin > start else end
    return out


def chunks(entries: DataFrame) -> DataFrame:
    """The chunk table of ``(wal_entry_id, source_path, content)``; null and empty contents have no chunks."""
    small_batches(entries.sparkSession)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it, 2):
            rows = []
            for entry, path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = (content or "").encode()
                rows += [(entry, path, k, a, b, first, last, data[a:b].decode()) for k, (a, b, first, last) in enumerate(chunk_spans(data))]
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
            names = [x.split()[0] for x in _CHUNKS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)], names=names)

    return spread(entries.select("wal_entry_id", "source_path", "content")).mapInArrow(batches, _CHUNKS)


def fixed_windows(size: Column) -> Column:
    """``array<struct<start, end>>`` of overlapping windows over so many bytes."""
    last = F.greatest(F.ceil((size - WINDOW) / STRIDE), F.lit(0)).cast("int")
    made = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct((k * STRIDE).cast("long").alias("start"), F.least(k * STRIDE + WINDOW, size).cast("long").alias("end")))
    return F.when(size > 0, made).otherwise(F.slice(made, 1, 0))


def fixed_spans(n: int) -> list[tuple[int, int]]:
    return [(k, min(k + WINDOW, n)) for k in range(0, max(n - WINDOW + STRIDE, 1), STRIDE)] if n else []


def paragraphs(data: bytes) -> list[tuple[int, int]]:
    out, at = [], 0
    for part in data.split(b"\n\n"):
        if part:
            out.append((at, at + len(part)))
        at += len(part) + 2
    return out


def prose_spans(data: bytes) -> list[tuple[int, int]]:
    """Paragraphs, or fixed windows of a text that has none."""
    return paragraphs(data) or fixed_spans(len(data))


def code_spans(data: bytes) -> list[tuple[int, int]]:
    """Blocks between empty lines, short ones joined with the next; long ones cut with overlap."""
    joined: list[tuple[int, int]] = []
    for a, b in paragraphs(data):
        if joined and joined[-1][1] - joined[-1][0] < 128:
            joined[-1] = (joined[-1][0], b)
        else:
            joined.append((a, b))
    out = []
    for a, b in joined:
        while b - a > 1024:
            out.append((a, a + 1024))
            a += 512
        out.append((a, b))
    return out or fixed_spans(len(data))


def spans_of(kind: str, data: bytes) -> list[tuple[int, int]]:
    if kind == "Code":
        return code_spans(data)
    return prose_spans(data) if kind in ("Prose", "Mixed") else fixed_spans(len(data))


def windows(entries: DataFrame) -> DataFrame:
    """``(wal_entry_id, window_start, window_end)`` of ``(wal_entry_id, content, content_type)``,
    by content type."""
    small_batches(entries.sparkSession)
    by_size = ~F.col("content_type").isin("Code", "Prose", "Mixed")
    fixed = entries.where(by_size).select("wal_entry_id", F.explode(fixed_windows(F.octet_length("content"))).alias("w")).select("wal_entry_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it, 1):
            rows = [(e, a, b) for e, text, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True) for a, b in spans_of(kind, (text or "").encode())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["wal_entry_id", "window_start", "window_end"])

    rest = spread(entries.where(~by_size).select("wal_entry_id", "content", "content_type")).mapInArrow(batches, "wal_entry_id bigint, window_start bigint, window_end bigint")
    return fixed.unionByName(rest)
