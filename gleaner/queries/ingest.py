"""Queries over state: manifest, snapshot, content types, hashes, counters, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as tx
from gleaner.operators import catalog, chunking, evaluate
from gleaner.sources.entries import as_entries, documents, next_ids, recover_metadata
from gleaner.storage import shared_dir
from gleaner.streaming.append import appended, stream_append

DOCS = "(SELECT doc_id AS wal_entry_id, concat_ws('/', source, lang, doc_id || '.txt') AS source_path, text AS content FROM documents)"
_TYPE = " ".join(f"WHEN x IN ({', '.join(repr(e) for e in exts)}) THEN '{name}'" for name, exts in tx.EXTENSIONS.items())


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as versions of a path: a conversation is a path, a turn appends it again."""
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("string").alias("source_path"), F.col("turn").alias("wal_entry_id"), F.col("text").alias("content"))


def content_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", tx.content_type(F.col("url")).alias("content_type"))


def dominant_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.dominant_content_type(documents(spark, sf_dir))


def latest_per_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.latest_per_path(_turns(spark, sf_dir))


def manifest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir).where("content is not null")
    asked = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user'").select(F.col("conv_id").cast("string").alias("source_path"), F.col("turn").alias("wal_entry_id"))
    return catalog.upsert(catalog.latest_per_path(turns), catalog.latest_per_path(asked))


def manifest_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("wal_entry_id"))
    manifest = documents(spark, sf_dir).select("source_path", "wal_entry_id")
    return catalog.prune(manifest, seen, "wal_entry_id")


def unchanged_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The English documents were read before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("source_path"), F.col("lang").alias("mtime"), F.col("n_chars").alias("size"))
    return catalog.unchanged(docs, docs.where("mtime = 'en'"))


def snapshot_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents are active, English ones indexed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    active = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("wal_entry_id"))
    indexed, fresh = catalog.snapshot(active, docs.where("lang = 'en'").select(F.col("doc_id").alias("wal_entry_id")))
    return indexed.withColumn("part", F.lit("indexed")).unionByName(fresh.withColumn("part", F.lit("fresh")))


def pending_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("wal_entry_id"))
    return catalog.pending(documents(spark, sf_dir), done).select("wal_entry_id", "source_path")


def entry_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = as_entries(documents(spark, sf_dir))
    return made.select("wal_entry_id", "source_path", "content_hash", "byte_length", "line_start", "line_end", "content_type")


def read_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contents of all labelled entries."""
    wanted = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("wal_entry_id"))
    return documents(spark, sf_dir).join(wanted, "wal_entry_id", "left_semi").select("wal_entry_id", "content")


def recovered_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata lines of all documents, of which those that end beyond the content are dropped."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = docs.select(F.to_json(F.struct(F.col("doc_id").alias("wal_entry_id"), F.col("source").alias("source_path"), F.lit("").alias("content_hash"), F.col("doc_id").alias("byte_offset"), F.col("n_chars").alias("byte_length"), F.lit(0).alias("committed_at"))).alias("value"))
    torn = docs.select(F.concat(F.lit('{"wal_entry_id": '), F.col("doc_id").cast("string")).alias("value"))
    return recover_metadata(lines.unionByName(torn), 5000).select("wal_entry_id", "source_path", "byte_offset", "byte_length", "line_range_start")


def dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.format_string("%012d", "doc_id").alias("source_path"))
    return next_ids(docs, 99)


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("wal_entry_id", "content")
    read = lambda name, col: spark.read.parquet(f"{sf_dir}/{name}.parquet").select(F.col(col).alias("wal_entry_id"))
    windows = docs.select(F.explode(chunking.fixed_windows(F.octet_length("content"))))
    active = read("labels", "doc_id")
    return catalog.status(docs, active, spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang = 'en'").select(F.col("doc_id").alias("wal_entry_id")), read("embeddings", "vec_id"), windows)


def stream_append_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table, read as a stream, appended, and counted by type."""
    where = shared_dir(spark, "stream")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    stream_append(source, f"{where}/out", f"{where}/checkpoint").awaitTermination()
    return appended(spark, f"{where}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def bench_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean order value by status and priority, as a report has runners by deadlines."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    ends = [0, 100, 500, 1000, 5000, -1]
    metrics = orders.groupBy(F.col("o_orderstatus").alias("runner")).agg(F.avg("o_totalprice").alias("v")).withColumn("deadline_ms", F.explode(F.array(*map(F.lit, ends)))).withColumn("recall", F.round(F.col("v") / 1e6, 6))
    wide = evaluate.report(metrics)
    return wide.select("runner", *[F.col(f"`{e}`").alias(f"at_{e}" if e >= 0 else "steady") for e in ends])


QUERIES = {f.__name__: f for f in (content_types, dominant_type, latest_per_path, manifest_upsert, manifest_prune, unchanged_skip, snapshot_partition, pending_entries, entry_metadata, read_entries, recovered_metadata, dense_ids, status_counts, stream_append_events, bench_report)}
ORACLE_SQL = {
    "content_types": f"SELECT page_id, CASE {_TYPE} ELSE 'Unknown' END AS content_type FROM (SELECT page_id, lower(regexp_extract(url, '\\.([^./\\\\]+)$', 1)) AS x FROM pages)",
    "dominant_type": "SELECT 'Prose' AS content_type, count(*) AS n FROM documents",
    "latest_per_path": "SELECT CAST(conv_id AS VARCHAR) AS source_path, max(turn) AS wal_entry_id FROM conversations GROUP BY conv_id",
    "manifest_upsert": """
        WITH a AS (SELECT CAST(conv_id AS VARCHAR) AS p, max(turn) AS t FROM conversations WHERE text IS NOT NULL GROUP BY 1),
        u AS (SELECT CAST(conv_id AS VARCHAR) AS p, max(turn) AS t FROM conversations WHERE role = 'user' GROUP BY 1)
        SELECT coalesce(u.p, a.p) AS source_path, coalesce(u.t, a.t) AS wal_entry_id FROM a FULL JOIN u ON a.p = u.p""",
    "manifest_prune": f"SELECT source_path, wal_entry_id FROM {DOCS} WHERE wal_entry_id IN (SELECT doc_id FROM labels)",
    "unchanged_skip": "SELECT doc_id AS source_path, lang AS mtime, n_chars AS size FROM documents WHERE lang <> 'en'",
    "snapshot_partition": "SELECT l.doc_id AS wal_entry_id, CASE WHEN d.lang = 'en' THEN 'indexed' ELSE 'fresh' END AS part FROM labels l LEFT JOIN documents d USING (doc_id)",
    "pending_entries": f"SELECT wal_entry_id, source_path FROM {DOCS} WHERE wal_entry_id NOT IN (SELECT doc_id FROM labels)",
    "entry_metadata": f"SELECT wal_entry_id, source_path, sha256(content) AS content_hash, CAST(strlen(content) AS BIGINT) AS byte_length, 1 AS line_start, CAST(len(string_split(content, chr(10))) AS INTEGER) AS line_end, 'Prose' AS content_type FROM {DOCS}",
    "read_entries": f"SELECT wal_entry_id, content FROM {DOCS} WHERE wal_entry_id IN (SELECT doc_id FROM labels)",
    "recovered_metadata": "SELECT doc_id AS wal_entry_id, source AS source_path, doc_id AS byte_offset, n_chars AS byte_length, 1 AS line_range_start FROM documents WHERE doc_id + n_chars <= 5000",
    "dense_ids": "SELECT printf('%012d', doc_id) AS source_path, 99 + row_number() OVER (ORDER BY md5(printf('%012d', doc_id)), doc_id) AS wal_entry_id FROM documents",
    "status_counts": """
        WITH w AS (SELECT sum(CASE WHEN strlen(text) = 0 THEN 0 ELSE 1 + greatest(CAST(ceil((strlen(text) - 384) / 192.0) AS BIGINT), 0) END) AS chunks FROM documents),
        c AS (SELECT (SELECT count(*) FROM documents) AS entries, (SELECT count(*) FROM labels) AS active,
          (SELECT count(*) FROM labels SEMI JOIN (SELECT doc_id FROM documents WHERE lang = 'en') e USING (doc_id)) AS indexed,
          (SELECT count(*) FROM embeddings) AS embedded)
        SELECT c.*, CAST(chunks AS BIGINT) AS chunks, active - indexed AS unindexed, greatest(active - embedded, 0) AS delta, greatest(active - embedded, 0) > 50 AS delta_skipped,
          round(100 * indexed / greatest(active, 1), 6) AS indexed_percent FROM c, w""",
    "stream_append_events": "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type",
    "bench_report": "WITH m AS (SELECT o_orderstatus AS runner, round(avg(o_totalprice) / 1e6, 6) AS v FROM orders GROUP BY 1) SELECT runner, " + ", ".join(f"v AS {n}" for n in ("at_0", "at_100", "at_500", "at_1000", "at_5000", "steady")) + " FROM m",
}
