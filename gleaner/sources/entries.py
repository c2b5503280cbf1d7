"""Entries, the append-only table of texts, from files, tables and JSON lines."""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions.text import content_type

ENTRY = "wal_entry_id bigint, source_path string, content string, content_hash string, byte_length bigint, committed_at timestamp, line_start int, line_end int, content_type string"


def as_entries(rows: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Rows ``(wal_entry_id, source_path, content)`` with what an entry derives from them, and the columns ``more``."""
    n = F.size(F.split("content", "\n", -1))
    return rows.select(
        F.col("wal_entry_id").cast("long"), "source_path", "content", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"), F.octet_length("content").cast("long").alias("byte_length"),
        (F.col("committed_at") if "committed_at" in rows.columns else F.lit(None).cast("timestamp")).alias("committed_at"), F.lit(1).alias("line_start"), n.alias("line_end"), content_type(F.col("source_path")).alias("content_type"), *more,
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as entries: a path for each document below its source and language."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("doc_id").alias("wal_entry_id"), path.alias("source_path"), F.col("text").alias("content"))


def _ignored(root: str) -> list[str]:
    path = os.path.join(root, ".gitignore")
    if not os.path.exists(path):
        return []
    with open(path, encoding="utf-8", errors="replace") as f:
        return [x.strip() for x in f if x.strip() and not x.startswith("#")]


def ignores(patterns: list[str], path: str) -> bool:
    """Whether the last of the ignore patterns that fits a path, or a folder above it, excludes it."""
    out, parts = False, path.split("/")
    for p in patterns:
        keep, p = p.startswith("!"), p.removeprefix("!")
        folder, anchored, p = p.endswith("/"), "/" in p.strip("/") or p.startswith("/"), p.strip("/")
        ways = ["/".join(parts[: k + 1]) for k in range(len(parts) - folder)] if anchored else parts[: len(parts) - folder]
        if any(fnmatch.fnmatchcase(w, p) for w in ways):
            out = not keep
    return out


def directory(spark: SparkSession, root: str, skip: tuple[str, ...] = (".git", ".index"), gitignore: bool = True) -> DataFrame:
    """``(source_path, content, mtime, size)`` of all files below a folder, hidden ones too, which
    Spark's own file sources leave out. Bytes that aren't UTF-8 become replacement characters. The
    driver lists names and judges the ignore rules; contents are read by the tasks."""
    system, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), os.path.abspath(root))
    patterns = _ignored(base) if gitignore and isinstance(system, fs.LocalFileSystem) else []
    rows = []
    for f in system.get_file_info(fs.FileSelector(base, recursive=True)):
        name = f.path[len(base) :].lstrip("/")
        if f.type == fs.FileType.File and not set(skip) & set(name.split("/")) and not ignores(patterns, name):
            rows.append((name, f.path, f.mtime, f.size))
    files = spark.createDataFrame(rows, "source_path string, place string, mtime timestamp, size bigint")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for k, place in enumerate(batch.column("place").to_pylist()):
                with system.open_input_stream(place, compression=None) as stream:
                    text = stream.read().decode("utf-8", "replace")
                one = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([one.column(0), pa.array([text]), one.column(2), one.column(3)], names=["source_path", "content", "mtime", "size"])

    return files.repartition(max(1, min(len(rows), 4 * spark.sparkContext.defaultParallelism))).mapInArrow(batches, "source_path string, content string, mtime timestamp, size bigint")


def recover_metadata(lines: DataFrame, content_bytes: int) -> DataFrame:
    """Metadata rows from JSON lines (column ``value``): those that parse, hold their fields and end inside
    the content. A torn tail is dropped, as are lines with ranges beyond it."""
    schema = "wal_entry_id bigint, source_path string, content_hash string, byte_offset bigint, byte_length bigint, committed_at bigint, line_range_start int, line_range_end int"
    rows = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("m")).select("m.*")
    ok = rows.where("wal_entry_id is not null and source_path is not null and byte_offset is not null and byte_length is not null")
    return ok.where(F.col("byte_offset") + F.col("byte_length") <= content_bytes).fillna(1, ["line_range_start", "line_range_end"])


def code_examples(spark: SparkSession, path: str) -> DataFrame:
    """``(code, docstring)`` of cached JSON lines, without those that lack either."""
    rows = spark.read.schema("code string, docstring string").json(path)
    return rows.where("trim(code) <> '' and trim(docstring) <> ''")


def next_ids(rows: DataFrame, last: int, key: str = "source_path") -> DataFrame:
    """``rows`` with dense ids after ``last``, in the order of a hash of a column, then of the column.

    Rows are numbered in buckets of the hash, each from the number of rows in the buckets before it.
    Nothing depends on how rows are partitioned, so a repeated task gives the same ids."""
    taken = {c.lower() for c in rows.columns}
    if taken & {"gl_hash", "gl_bucket", "gl_start"}:
        raise ValueError("columns named gl_hash, gl_bucket or gl_start are taken")
    hashed = rows.withColumn("gl_hash", F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))).withColumn("gl_bucket", F.substring("gl_hash", 1, 4))
    counts = hashed.groupBy("gl_bucket").agg(F.count("*").alias("n"))
    starts = counts.select("gl_bucket", (F.sum("n").over(Window.orderBy("gl_bucket")) - F.col("n")).alias("gl_start"))
    rank = F.row_number().over(Window.partitionBy("gl_bucket").orderBy("gl_hash", key))
    return hashed.withColumn("wal_entry_id", rank.cast("long")).join(starts, "gl_bucket").withColumn("wal_entry_id", F.lit(last) + F.col("gl_start") + F.col("wal_entry_id")).drop("gl_hash", "gl_bucket", "gl_start")
