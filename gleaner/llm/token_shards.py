"""Token shards: concatenated ids, and document boundaries as Elias-Fano codes.

Each task writes shards ``name.bin`` (ids of 16 or 32 bits, one document after another) and
``name.ef`` (the n + 1 boundaries). The code splits a boundary into low bits, packed, and high
bits, unary: about 2 + log2(tokens per document) bits each. The place of every ``SAMPLE``-th one of
the unary part is kept in 32 bits, so the boundary of any document is found by counting
bits in a few words; there is no table of 64-bit offsets.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import col, shared_dir, written
from gleaner.llm.files import one_task_each, open_path, rename
from gleaner.llm.pieces import encode_pieces

SAMPLE = 256
#: A shard is closed with the first document that takes it to so many tokens.
SHARD_TOKENS = 1 << 27
_MAGIC = b"GLEF0001"


class EliasFano:
    """A sequence that never falls, with ``select``. Bits are stored from the least on."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.n, self.width, self.low, self.high, self.samples = n, width, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        if n and (values[1:] < values[:-1]).any():
            raise ValueError("the sequence falls")
        width = max(0, (top // n).bit_length() - 1) if n else 0
        bits = ((values[:, None] >> np.arange(width, dtype=np.uint64)[None, :]) & np.uint64(1)).astype(np.uint8)
        low = np.packbits(bits.reshape(-1), bitorder="little")
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        if n and ones[-1] >= 1 << 32:
            raise ValueError("too many values for 32-bit samples")
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        return cls(n, width, low, np.packbits(unary, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        head = struct.pack("<8sQIQQQ", _MAGIC, self.n, self.width, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        magic, n, width, a, b, c = struct.unpack_from("<8sQIQQQ", data)
        if magic != _MAGIC:
            raise ValueError("not an Elias-Fano file")
        at = struct.calcsize("<8sQIQQQ")
        return cls(n, width, np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a), np.frombuffer(data, "<u4", c, at + a + b))

    def select(self, i: int) -> int:
        """The i-th value, from one sample, the bytes up to the bit, and ``width`` low bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        start = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte, first = start >> 3, int(self.high[start >> 3]) & (0xFF << (start & 7)) & 0xFF
        while (count := first.bit_count()) <= left:
            left -= count
            byte += 1
            first = int(self.high[byte])
        for _ in range(left):
            first &= first - 1
        place = byte * 8 + (first & -first).bit_length() - 1
        value = place - i << self.width
        if self.width:
            at = i * self.width
            part = int.from_bytes(self.low[at >> 3 : (at + self.width + 7) >> 3].tobytes(), "little")
            value |= part >> (at & 7) & ((1 << self.width) - 1)
        return value

    def span(self, start: int, stop: int) -> np.ndarray:
        """Values ``start`` to ``stop``, without the others."""
        if start >= stop:
            return np.zeros(0, np.int64)
        k = start // SAMPLE
        byte = int(self.samples[k]) >> 3
        end_block = -(-stop // SAMPLE)
        last = (int(self.samples[end_block]) >> 3) + 1 if end_block < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[byte:last], bitorder="little")) + byte * 8
        ones = ones[ones >= int(self.samples[k])][start - k * SAMPLE : stop - k * SAMPLE]
        i = np.arange(start, stop)
        value = (ones - i) << self.width
        if self.width:
            a = start * self.width
            bits = np.unpackbits(self.low[a >> 3 : (stop * self.width + 7) >> 3], bitorder="little")[a & 7 :][: (stop - start) * self.width]
            value |= bits.reshape(-1, self.width).astype(np.int64) @ (1 << np.arange(self.width, dtype=np.int64))
        return value


class _Shard:
    """A shard that is being written; it gets its name when it is complete."""

    def __init__(self, path: str, kind: str) -> None:
        self.path, self.kind, self.out, self.tokens = path, kind, open_path(f"{path}.bin.part", "wb"), 0
        self.ends: list[np.ndarray] = [np.zeros(1, np.int64)]
        self.ids: list[pa.Array] = []

    def add(self, ids: pa.Array, lists: pa.ListArray) -> None:
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        self.out.write(flat.astype(self.kind).tobytes())
        sizes = pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.ends.append(self.tokens + np.cumsum(sizes))
        self.tokens += int(sizes.sum())
        self.ids.append(ids)

    def close(self) -> tuple[int, int, pa.Array]:
        self.out.close()
        code = EliasFano.of(np.concatenate(self.ends)).to_bytes()
        with open_path(f"{self.path}.ef.part", "wb") as out:
            out.write(code)
        for kind in ("ef", "bin"):
            rename(f"{self.path}.{kind}.part", f"{self.path}.{kind}")
        return self.tokens, len(code), pa.concat_arrays(self.ids)


def write_token_shards(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "token_ids", vocabulary: int = 32_000, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes shards below ``path``; returns the table of them ``(shard, path, kind, n_docs,
    n_tokens, ef_bytes, doc_ids)``. A null list is a document of no tokens; ids beyond ``vocabulary`` and null ids
    in a list are errors. A task that is repeated writes files of other names, and the table lists
    those of the one that succeeded. Repeated rows are separate documents, null ids are kept as null, and a list of any
    length goes whole into one shard. An empty table gives no shards. Columns are chosen by name and get new names at once, so others
    can't clash. Nothing is shuffled; rows keep their order."""
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    some = rows.select(col(id_col).alias("id"), col(ids_col).alias("ids"))
    schema = T.StructType([T.StructField("shard", T.StringType()), T.StructField("path", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("n_docs", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ef_bytes", T.LongType()), T.StructField("doc_ids", T.ArrayType(some.schema["id"].dataType))])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        task, number, shard = context.partitionId() if context else 0, 0, None

        def closed(name: str, s: _Shard) -> pa.RecordBatch:
            tokens, size, ids = s.close()
            return pa.RecordBatch.from_pydict({"shard": [name], "path": [s.path], "kind": [kind], "n_docs": pa.array([len(ids)], pa.int64()), "n_tokens": pa.array([tokens], pa.int64()), "ef_bytes": pa.array([size], pa.int64()), "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)})

        for batch in it:
            k = 0
            while k < len(batch):
                ids, lists = batch.column(0).slice(k, 512), batch.column(1).slice(k, 512)
                sizes = np.cumsum(pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
                full = np.flatnonzero(sizes >= shard_tokens - (shard.tokens if shard else 0))
                if len(full):
                    ids, lists = ids.slice(0, full[0] + 1), lists.slice(0, full[0] + 1)
                k += len(ids)
                flat = lists.flatten()
                if flat.null_count or len(flat) and not 0 <= pa.compute.min(flat).as_py() <= pa.compute.max(flat).as_py() < vocabulary:
                    raise ValueError(f"a token id is null or not below {vocabulary}")
                shard = shard or _Shard(f"{path}/{task:06d}-{number:04d}-{uuid.uuid4().hex}", kind)
                shard.add(ids, lists)
                if shard.tokens >= shard_tokens:
                    yield closed(f"{task:06d}-{number:04d}", shard)
                    number, shard = number + 1, None
        if shard:
            yield closed(f"{task:06d}-{number:04d}", shard)

    return written(some.mapInArrow(batches, schema), "token-shards")


def read_token_shards(shards: DataFrame) -> DataFrame:
    """For each document of the shards its place ``(doc_id, shard, ordinal, start, stop)`` from the
    Elias-Fano code, and the xxHash of its ids as they stand in the file."""
    id_type = shards.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("shard", T.StringType()), T.StructField("ordinal", T.LongType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("ids_xxh64", T.StringType())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for name, path, kind, n, ids in zip(*batch.columns, strict=True):
                path, wide, n = path.as_py(), int(kind.as_py()[-1]), n.as_py()
                with open_path(f"{path}.ef", "rb") as f:
                    code = EliasFano.from_bytes(f.read())
                with open_path(f"{path}.bin", "rb") as f:
                    for k in range(0, n, 4096):
                        ends = code.span(k, min(n, k + 4096) + 1)
                        hashes = [xxhash.xxh64_hexdigest(f.read(size * wide)) for size in np.diff(ends).tolist()]
                        m = len(hashes)
                        yield pa.RecordBatch.from_arrays([ids.values.slice(k, m), pa.array([name.as_py()] * m), pa.array(np.arange(k, k + m)), pa.array(ends[:-1]), pa.array(ends[1:]), pa.array(hashes)], names=schema.names)

    each = one_task_each(shards.select("shard", "path", "kind", "n_docs", "doc_ids"), "path")
    return each.mapInArrow(batches, schema)


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written to shards in the shared folder, and the index read back."""
    docs = encode_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    shards = write_token_shards(docs, shared_dir(spark, "shards"))
    return read_token_shards(shards).withColumn("n_tokens", F.col("stop") - F.col("start"))
