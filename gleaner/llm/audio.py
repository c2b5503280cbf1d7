"""Audio features: polyphase resampling, log-mel filterbanks and hysteresis segmentation.

A clip is mono PCM of 16 bits (little-endian) in a binary column. It is centred, resampled by a
windowed sinc whose phases are the columns of one matrix (a block of input samples times the
matrix is a block of output samples), framed with overlap, and mapped to log-mel bands. Frames
whose level passes ``HIGH_DB`` below the clip's loudest frame open a segment, which ends when the level
falls below ``LOW_DB``. A segment is stored as tensors of one fixed shape with their time spans.

A clip passes through in blocks of ``BLOCK_FRAMES`` frames, once for its levels and once for the bands of its
segments, so that beside its bytes a clip of any length takes a fixed amount of memory. All is computed in
double precision and cast at the end: bands near silence would else hold the noise of the sums.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import col, shared_dir, written
from gleaner.llm.files import one_task_each, open_path, open_random, rename

RATE_IN = 22_050
RATE = 16_000
WINDOW, HOP, FFT, MELS = 400, 160, 512, 64
#: Frames of a tensor.
FRAMES = 16
HIGH_DB, LOW_DB = -12.0, -18.0
ZEROS = 16
BLOCK_FRAMES = 4096


@lru_cache(maxsize=8)
def polyphase(rate_in: int, rate_out: int) -> tuple[int, int, int, np.ndarray]:
    """Samples per block before and after, margin on either side, and the matrix of all phases."""
    g = gcd(rate_in, rate_out)
    up, down = rate_out // g, rate_in // g
    cut = min(1.0, up / down)
    margin = int(np.ceil(ZEROS / cut)) + 1
    at = np.arange(up) * down / up
    t = np.arange(-margin, down + margin)[:, None] - at[None, :]
    taps = cut * np.sinc(cut * t) * np.where(np.abs(t) * cut < ZEROS, np.cos(np.pi * t * cut / (2 * ZEROS)) ** 2, 0)
    return down, up, margin, taps / taps.sum(0)


class Clip:
    """The samples and frames of a clip, computed where they are asked for. Beyond its ends a clip is silent."""

    def __init__(self, pcm: bytes, rate_in: int = RATE_IN, rate_out: int = RATE) -> None:
        self.raw = np.frombuffer(pcm, "<i2", len(pcm) // 2)
        self.mean = int(self.raw.sum(dtype=np.int64)) / max(1, len(self.raw))
        self.down, self.up, self.margin, self.matrix = polyphase(rate_in, rate_out)
        self.n = -(-len(self.raw) * self.up // self.down)
        self.n_frames = max(1, -(-(self.n - WINDOW) // HOP) + 1) if self.n else 0
        self.held: tuple[int, int, np.ndarray] = (0, 0, np.zeros(0))

    def samples(self, start: int, stop: int) -> np.ndarray:
        """Samples ``start`` to ``stop`` at the rate that is wanted."""
        low, high, made = self.held
        if not low <= start <= stop <= high:
            low, blocks = start // self.up, -(-stop // self.up) - start // self.up
            first = low * self.down - self.margin
            padded = np.zeros(blocks * self.down + 2 * self.margin)
            part = self.raw[max(0, first) : max(0, first + len(padded))]
            at = max(0, -first)
            padded[at : at + len(part)] = (part - self.mean) / 32768
            views = np.lib.stride_tricks.sliding_window_view(padded, self.down + 2 * self.margin)[:: self.down]
            low, made = low * self.up, (views @ self.matrix).reshape(-1)
            made[max(0, self.n - low) :] = 0
            self.held = (low, low + len(made), made)
        return made[start - low : stop - low]

    def frames(self, start: int, stop: int) -> np.ndarray:
        """Windows every ``HOP`` samples; the last is filled up with silence, so that all samples count."""
        return np.lib.stride_tricks.sliding_window_view(self.samples(start * HOP, (stop - 1) * HOP + WINDOW), WINDOW)[::HOP]

    def levels(self) -> np.ndarray:
        parts = [levels(self.frames(k, min(self.n_frames, k + BLOCK_FRAMES))) for k in range(0, self.n_frames, BLOCK_FRAMES)]
        return np.concatenate(parts) if parts else np.zeros(0)


@lru_cache(maxsize=8)
def mel_matrix(rate: int = RATE, fft: int = FFT, mels: int = MELS) -> np.ndarray:
    """Triangles with equal spacing in mel, each of height 1, over the spectrum's bins."""
    edge = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), mels + 2) / 2595) - 1)
    f = np.arange(fft // 2 + 1) * rate / fft
    rise = (f[:, None] - edge[None, :-2]) / np.diff(edge)[None, :-1]
    fall = (edge[None, 2:] - f[:, None]) / np.diff(edge)[None, 1:]
    return np.maximum(0, np.minimum(rise, fall))


def log_mel(frames: np.ndarray) -> np.ndarray:
    spectrum = np.fft.rfft(frames * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(WINDOW) / WINDOW)), FFT, axis=1)
    return np.log(np.maximum((spectrum.real**2 + spectrum.imag**2) @ mel_matrix(), 1e-10)).astype(np.float32)


def levels(self) -> np.ndarray:
        parts = [levels(self.frames(k, min(self.n_frames, k + BLOCK_FRAMES))) for k in range(0, self.n_frames, BLOCK_FRAMES)]
        return np.concatenate(parts) if parts else np.zeros(0)


@lru_cache(maxsize=8)
def mel_matrix(rate: int = RATE, fft: int = FFT, mels: int = MELS) -> np.ndarray:
    """Triangles with equal spacing in mel, each of height 1, over the spectrum's bins."""
    edge = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), mels + 2) / 2595) - 1)
    f = np.arange(fft // 2 + 1) * rate / fft
    rise = (f[:, None] - edge[None, :-2]) / np.diff(edge)[None, :-1]
    fall = (edge[None, 2:] - f[:, None]) / np.diff(edge)[None, 1:]
    return np.maximum(0, np.minimum(rise, fall))


def frames_of(x: np.ndarray) -> np.ndarray:
    """Windows every ``HOP`` samples; the last is filled up with silence, so that all samples count."""
    n = max(1, -(-(len(x) - WINDOW) // HOP) + 1)
    padded = np.zeros((n - 1) * HOP + WINDOW, np.float32)
    padded[: len(x)] = x
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::HOP]


def log_mel(frames: np.ndarray) -> np.ndarray:
    shape = (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(WINDOW) / WINDOW)).astype(np.float32)
    out = np.empty((len(frames), MELS), np.float32)
    for k in range(0, len(frames), 4096):
        spectrum = np.fft.rfft(frames[k : k + 4096] * shape, FFT, axis=1)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        out[k : k + 4096] = np.log(np.maximum(power @ mel_matrix(), 1e-10))
    return out


def levels(frames: np.ndarray) -> np.ndarray:
    """Mean square of each frame in decibels."""
    return 10 * np.log10(np.maximum(np.einsum("ij,ij->i", frames, frames) / frames.shape[1], 1e-12))


def segments(db: np.ndarray, high: float = HIGH_DB, low: float = LOW_DB) -> list[tuple[int, int]]:
    """Frames ``[start, end)`` of each segment: it opens at ``high`` below the loudest frame or
    above and closes under ``low``. A silent clip has none."""
    if not len(db) or db.max() <= -100:
        return []
    relative = db - db.max()
    mark = np.where(relative >= high, 1, np.where(relative < low, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.where(last >= 0, mark[last] == 1, False)
    edges = np.flatnonzero(np.diff(np.r_[False, on, False].astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def clip_tensors(pcm: bytes, rate_in: int = RATE_IN) -> Iterator[tuple[int, int, float, float, int, np.ndarray]]:
    """``(segment, part, start, end, frames, tensor)`` of a clip, one after another. An odd last byte,
    which is no sample, doesn't count."""
    clip = Clip(pcm, rate_in)
    length = clip.n / RATE
    parts = [(s, p, k, min(FRAMES, b - k)) for s, (a, b) in enumerate(segments(clip.levels())) for p, k in enumerate(range(a, b, FRAMES))]
    at = 0
    while at < len(parts):
        first, end = parts[at][2], at
        while end < len(parts) and parts[end][2] + parts[end][3] - first <= BLOCK_FRAMES:
            end += 1
        mel = log_mel(clip.frames(first, parts[end - 1][2] + parts[end - 1][3]))
        for s, p, k, n in parts[at:end]:
            tensor = np.zeros((FRAMES, MELS), np.float32)
            tensor[:n] = mel[k - first : k - first + n]
            yield s, p, k * HOP / RATE, min(length, ((k + n - 1) * HOP + WINDOW) / RATE), n, tensor
        at = end


def audio_features(rows: DataFrame, id_col: str, pcm_col: str, rate_in: int = RATE_IN) -> DataFrame:
    """``(id, segment, part, start_s, end_s, n_frames, log_mel)`` for the segments of each clip;
    log_mel holds ``FRAMES`` x ``MELS`` numbers row by row, zero after ``n_frames`` rows.

    A null or empty clip, one of a single byte and a silent one have no rows; a null id stays null, and repeated rows give
    repeated rows. No clips: no rows. A clip of hours goes through in blocks. Other columns are not carried, so their names
    can't clash. Nothing is shuffled."""
    some = rows.select(col(id_col).alias("id"), col(pcm_col).cast("binary").alias("pcm"))
    schema = T.StructType([some.schema["id"], *[T.StructField(n, t) for n, t in (("segment", T.IntegerType()), ("part", T.IntegerType()), ("start_s", T.DoubleType()), ("end_s", T.DoubleType()), ("n_frames", T.IntegerType()), ("log_mel", T.ArrayType(T.FloatType())))]])
    kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int32()]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            at, found = [], []
            for k in range(len(batch)):
                pcm = batch.column(1)[k]
                for tensor in clip_tensors(pcm.as_buffer(), rate_in) if pcm.is_valid else ():
                    at.append(k)
                    found.append(tensor)
                    if len(found) == 2048:
                        yield made(batch, at, found)
                        at, found = [], []
            if found:
                yield made(batch, at, found)

    def made(batch: pa.RecordBatch, at: list[int], found: list[tuple]) -> pa.RecordBatch:
        flat = pa.array(np.concatenate([f[5].reshape(-1) for f in found]))
        tensors = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * FRAMES * MELS, pa.int32()), flat)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array([f[c] for f in found], kind) for c, kind in enumerate(kinds)], tensors], names=schema.names)

    return some.mapInArrow(batches, schema)


def as_tensors(lists: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A ``log_mel`` column as Arrow's fixed-shape tensors, without copying the numbers."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    kind = pa.fixed_shape_tensor(pa.float32(), (FRAMES, MELS), dim_names=("frame", "mel"))
    return pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(lists.flatten(), FRAMES * MELS))


def write_tensors(features: DataFrame, path: str) -> DataFrame:
    """Writes Arrow files in which ``log_mel`` is a fixed-shape tensor column, one for each task, and the
    buffers are compressed; returns the table of them ``(path, n_tensors)``. No rows: no files."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, writer, n = f"{path}/part-{uuid.uuid4().hex}.arrow", None, None, 0
        for batch in it:
            at = batch.schema.get_field_index("log_mel")
            batch = batch.set_column(at, "log_mel", as_tensors(batch.column(at)))
            if writer is None:
                out = open_path(name + ".part", "wb")
                writer = pa.ipc.new_file(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
            writer.write_batch(batch)
            n += len(batch)
        if writer is not None:
            writer.close()
            out.close()
            rename(name + ".part", name)
            yield pa.RecordBatch.from_pydict({"path": [name], "n_tensors": pa.array([n], pa.int64())})

    return written(features.mapInArrow(batches, "path string, n_tensors bigint"), "tensor-files")


def read_tensors(files: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows of the files of ``write_tensors``, whose features had this schema; a task for each file.
    A tensor comes as ``array<float>``, row by row, since Spark has no tensors. No files: no rows."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for path in batch.column("path").to_pylist():
                with open_random(path) as stream:
                    reader = pa.ipc.open_file(stream)
                    for k in range(reader.num_record_batches):
                        part = reader.get_batch(k)
                        at = part.schema.get_field_index("log_mel")
                        flat = part.column(at).storage.flatten()
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * FRAMES * MELS, pa.int32()), flat)
                        yield part.set_column(at, "log_mel", lists)

    return one_task_each(files.select("path"), "path").mapInArrow(batches, schema)


def op4_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tensors of every page, whose bytes are taken as samples (the tables hold no recordings), stored as Arrow's
    fixed-shape tensors in the shared folder and read back from there."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.col("html").cast("binary").alias("pcm"))
    features = audio_features(pages, "page_id", "pcm")
    files = write_tensors(features, shared_dir(spark, "tensors"))
    return read_tensors(files, features.schema).withColumnRenamed("id", "page_id")
