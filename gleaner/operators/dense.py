"""Dense retrieval over given vectors: exact nearest neighbours, collapse, recency, promotion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(vector: Column, query: Sequence[float]) -> Column:
    """Sum of products in double precision. A vector of another length is an error."""
    products = F.zip_with(vector, F.array(*[F.lit(float(x)) for x in query]), lambda a, b: a.cast("double") * b)
    total = F.aggregate(products, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(vector) == len(query), total).otherwise(F.raise_error(F.concat(F.lit("vector of length "), F.size(vector).cast("string"))).cast("double"))


def cosine(vector: Column, query: Sequence[float]) -> Column:
    """0 where either has hardly any length."""
    norm = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    mine = sum(float(x) ** 2 for x in query)
    return F.when((norm > 1e-12) & F.lit(mine > 1e-12), dot(vector, query) / F.sqrt(norm * F.lit(mine))).otherwise(0.0)


def knn(vectors: DataFrame, query: Sequence[float], limit: int, order: Sequence[str], vector: str = "embedding", allowed: DataFrame | None = None, key: str = "wal_entry_id") -> DataFrame:
    """The best of all allowed vectors by dot product, then by ``order``. Filtering comes before
    the limit, so as many rows come back as there are."""
    if allowed is not None:
        vectors = vectors.join(allowed.select(key), key, "left_semi")
    return vectors.withColumn("score", dot(F.col(vector), query)).orderBy(F.desc("score"), *order).limit(limit)


def knn_by_file(vectors: DataFrame, query: Sequence[float], path: str, vector: str = "embedding") -> DataFrame:
    """The greatest cosine of each file."""
    return vectors.groupBy(path).agg(F.max(cosine(F.col(vector), query)).alias("score"))


def collapse_by_file(rows: DataFrame, path: str = "source_path", order: Sequence[str] = ("rank",)) -> DataFrame:
    """Of each file the row of the greatest score, of equals the first in order. Aggregated before
    the shuffle; no file's rows are sorted."""
    keep = [c for c in rows.columns if c not in (path, "score", *order)]
    best = rows.groupBy(path).agg(F.min(F.struct((-F.col("score")).alias("score"), *order, *keep)).alias("b"))
    return best.select(path, (-F.col("b.score")).alias("score"), *[F.col(f"b.{c}").alias(c) for c in (*order, *keep)])


def recency_bonus(results: DataFrame, entries: DataFrame, newest: int = 8, most: float = 0.02, entry: str = "wal_entry_id") -> DataFrame:
    """Adds up to ``most`` to the scores of the newest entries, falling with their place."""
    last = entries.select(entry).orderBy(F.desc(entry)).limit(newest)
    n = F.count("*").over(Window.partitionBy())
    at = F.row_number().over(Window.orderBy(F.desc(entry))) - 1
    bonus = last.select(entry, (F.lit(most) * (n - at) / n).alias("_bonus"))
    return results.join(F.broadcast(bonus), entry, "left").withColumn("score", F.col("score") + F.coalesce("_bonus", F.lit(0.0))).drop("_bonus")


def promoted(chunks: DataFrame, embedded: DataFrame, hits: DataFrame, entries: DataFrame, limit: int = 10, recent: int = 8, entry: str = "wal_entry_id") -> DataFrame:
    """Chunks without vectors that are worth one for this query: of entries that the scan found
    (in its order), then of the most recent ones."""
    latest = entries.select(entry).orderBy(F.desc(entry)).limit(recent)
    newest = latest.select(entry, F.row_number().over(Window.orderBy(F.desc(entry))).alias("_recent"))
    ranks = hits.groupBy(entry).agg(F.min("rank").alias("_hit"))
    far = F.lit((1 << 31) - 1)
    some = chunks.join(embedded.select(entry), entry, "left_anti").join(ranks, entry, "left").join(F.broadcast(newest), entry, "left")
    some = some.where("_hit is not null or _recent is not null")
    return some.orderBy(F.coalesce("_hit", far), F.coalesce("_recent", far), F.desc(entry), "chunk_id").limit(limit).drop("_hit", "_recent")


def delta(vectors: DataFrame, embedded: DataFrame, active_ids: DataFrame, query: Sequence[float], limit: int, budget: int = 50, path: str = "source_path", entry: str = "wal_entry_id") -> DataFrame:
    """The best chunk per file of active entries that the vector table lacks, if these are no more than the budget."""
    left = active_ids.join(embedded.select(entry).distinct(), entry, "left_anti")
    few = left.agg((F.count("*") <= budget).alias("_few"))
    some = vectors.join(left, entry, "left_semi").crossJoin(F.broadcast(few)).where("_few").drop("_few")
    scored = some.withColumn("score", dot(F.col("embedding"), query)).drop("embedding")
    return collapse_by_file(scored, path, ("chunk_id",)).orderBy(F.desc("score"), path).limit(limit)
