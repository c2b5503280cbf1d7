"""Queries over the embeddings table, whose labels stand for files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.operators import dense

_DIM = 64
#: The query vector: falling weights of alternating sign, of about unit length.
QUERY = [round((-1) ** k * 0.9**k * 0.42, 6) for k in range(_DIM)]


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("wal_entry_id"), F.concat(F.lit("file"), F.format_string("%03d", "label")).alias("source_path"), "embedding")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors with their dot product and their rank within the file."""
    rows = _vectors(spark, sf_dir).select("wal_entry_id", "source_path", F.round(dense.dot(F.col("embedding"), QUERY), 6).alias("score"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("source_path").orderBy(F.desc("score"), "wal_entry_id")))


def knn_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dense.knn(_vectors(spark, sf_dir), QUERY, 20, ("source_path", "wal_entry_id"))
    return found.select("wal_entry_id", "source_path", F.round("score", 6).alias("score"))


def knn_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Among the vectors of labelled documents only."""
    active = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("wal_entry_id"))
    found = dense.knn(_vectors(spark, sf_dir), QUERY, 20, ("source_path", "wal_entry_id"), allowed=active)
    return found.select("wal_entry_id", "source_path", F.round("score", 6).alias("score"))


def knn_cosine_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.knn_by_file(_vectors(spark, sf_dir), QUERY, "source_path").withColumn("score", F.round("score", 6))


def collapse_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.collapse_by_file(_scored(spark, sf_dir)).select("source_path", "wal_entry_id", "score")


def recency_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).select("wal_entry_id", "score")
    return dense.recency_bonus(rows, _vectors(spark, sf_dir)).withColumn("score", F.round("score", 6))


def query_promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is one chunk; documents with a vector are embedded; license lines are hits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("wal_entry_id"), "text")
    chunks = docs.select("wal_entry_id", F.lit(0).alias("chunk_id"))
    embedded = _vectors(spark, sf_dir)
    hits = docs.where(F.col("text").contains("license")).select("wal_entry_id", F.col("wal_entry_id").alias("rank"))
    return dense.promoted(chunks, embedded, hits, docs)


def delta_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of the last label are not yet embedded; their number may not pass 500."""
    rows = _vectors(spark, sf_dir).withColumn("chunk_id", F.lit(0))
    last = rows.agg(F.max("source_path").alias("last"))
    embedded = rows.crossJoin(F.broadcast(last)).where("source_path <> last")
    found = dense.delta(rows, embedded, rows.select("wal_entry_id"), QUERY, 10, budget=500)
    return found.select("source_path", F.round("score", 6).alias("score"))


def vector_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths and norms of all vectors."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return _vectors(spark, sf_dir).select("wal_entry_id", F.size("embedding").alias("dimension"), F.round(norm, 4).alias("norm"))


QUERIES = {f.__name__: f for f in (knn_dot, knn_active, knn_cosine_by_file, collapse_by_file, recency_bonus, query_promoted, delta_fallback, vector_check)}

_Q = "[" + ", ".join(f"{x}::DOUBLE" for x in QUERY) + "]"
_NORM = sum(x * x for x in QUERY)
_V = f"v AS (SELECT vec_id AS wal_entry_id, 'file' || printf('%03d', label) AS source_path, list_dot_product(CAST(embedding AS DOUBLE[]), {_Q}) AS raw, list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS sq FROM embeddings)"
ORACLE_SQL = {
    "knn_dot": f"WITH {_V} SELECT wal_entry_id, source_path, round(raw, 6) AS score FROM v ORDER BY raw DESC, source_path, wal_entry_id LIMIT 20",
    "knn_active": f"WITH {_V} SELECT wal_entry_id, source_path, round(raw, 6) AS score FROM v WHERE wal_entry_id IN (SELECT doc_id FROM labels) ORDER BY raw DESC, source_path, wal_entry_id LIMIT 20",
    "knn_cosine_by_file": f"WITH {_V} SELECT source_path, round(max(raw / sqrt(sq * {_NORM!r})), 6) AS score FROM v GROUP BY 1",
    "collapse_by_file": f"WITH {_V} SELECT source_path, wal_entry_id, round(raw, 6) AS score FROM v QUALIFY row_number() OVER (PARTITION BY source_path ORDER BY round(raw, 6) DESC, wal_entry_id) = 1",
    "recency_bonus": f"WITH {_V}, r AS (SELECT wal_entry_id, row_number() OVER (ORDER BY wal_entry_id DESC) - 1 AS p, least(8, count(*) OVER ()) AS n FROM v) SELECT v.wal_entry_id, round(round(raw, 6) + CASE WHEN p < 8 THEN 0.02 * (n - p) / n ELSE 0 END, 6) AS score FROM v JOIN r USING (wal_entry_id)",
    "query_promoted": """
        WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) AS k FROM documents)
        SELECT d.doc_id AS wal_entry_id, CAST(0 AS INTEGER) AS chunk_id FROM documents d JOIN r USING (doc_id) WHERE d.doc_id NOT IN (SELECT vec_id FROM embeddings) AND (contains(text, 'license') OR k <= 8)
        ORDER BY CASE WHEN contains(text, 'license') THEN d.doc_id ELSE 2147483647 END, CASE WHEN k <= 8 THEN k ELSE 2147483647 END, d.doc_id DESC LIMIT 10""",
    "delta_fallback": f"WITH {_V}, l AS (SELECT * FROM v WHERE source_path = (SELECT max(source_path) FROM v)) SELECT source_path, round(max(raw), 6) AS score FROM l WHERE (SELECT count(*) FROM l) <= 500 GROUP BY 1",
    "vector_check": f"WITH {_V} SELECT wal_entry_id, CAST(len(embedding) AS INTEGER) AS dimension, round(sqrt(sq), 4) AS norm FROM v JOIN embeddings ON vec_id = wal_entry_id",
}
