"""Retrieval metrics and the benchmark's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recall_hit_mrr(hits: DataFrame, relevant: DataFrame, k: int, by: str = "episode", path: str = "path") -> DataFrame:
    """``(by, recall, hit, mrr)`` of hits ``(by, path, rank)`` with ranks from 1. Episodes without
    relevant paths have none of them found."""
    good = relevant.select(by, path).distinct()
    total = good.groupBy(by).agg(F.count("*").alias("n"))
    found = hits.where(F.col("rank") <= k).join(good, [by, path]).groupBy(by).agg(F.countDistinct(path).alias("got"), F.min("rank").alias("first"))
    episodes = hits.select(by).union(good.select(by)).distinct()
    out = episodes.join(total, by, "left").join(found, by, "left")
    return out.select(by, (F.coalesce("got", F.lit(0)) / F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))).alias("recall"), F.coalesce(F.col("got") > 0, F.lit(False)).alias("hit"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"))


def retention(at_start: Column, at_end: Column) -> Column:
    """The share of the final recall that is there at the start; 0 where the end has next to none."""
    return F.when(at_end < 1e-6, 0.0).otherwise(at_start / at_end)


def lower_percentile(values: Column, percent: int) -> Column:
    """The value at ``(n - 1) * percent / 100`` of the sorted list, rounded down."""
    return F.get(F.sort_array(values), F.floor((F.size(values) - 1) * percent / 100).cast("int"))


def aggregate_metrics(episodes: DataFrame, by: list[str]) -> DataFrame:
    """Means of recall, hit and MRR, and the lower median and 95th percentile of latency."""
    lists = episodes.groupBy(*by).agg(F.avg("recall").alias("recall"), F.avg(F.col("hit").cast("double")).alias("hit_rate"), F.avg("mrr").alias("mrr"), F.collect_list("latency_ms").alias("l"))
    return lists.select(*by, "recall", "hit_rate", "mrr", lower_percentile(F.col("l"), 50).alias("p50"), lower_percentile(F.col("l"), 95).alias("p95"))


def hard_subset(episodes: DataFrame, baseline: DataFrame, by: str = "episode") -> DataFrame:
    """Episodes that the baseline missed."""
    return episodes.join(baseline.where("not hit").select(by), by, "left_semi")


def within_deadline(hits: DataFrame) -> DataFrame:
    """No hits that came after a deadline above 0; a null deadline waits for all."""
    return hits.where("deadline_ms is null or deadline_ms = 0 or latency_ms <= deadline_ms")


def token_idf_rank(files: DataFrame, tokens: list[str], path: str = "source_path", text: str = "content") -> DataFrame:
    """Files by the sum of ``ln((n + 1) / (df + 0.5)) + 1`` over the tokens they hold, whatever their case; ``n`` is 1
    as in a list of single files. One scan counts, one scores; only counts are shuffled."""
    words = list(dict.fromkeys(w.lower() for w in tokens if len(w) >= 3))
    if not words:
        return files.limit(0).select(path, F.lit(0.0).alias("score"))
    low = F.lower(F.col(text))
    held = files.select(path, F.array(*[low.contains(w).cast("int") for w in words]).alias("h"))
    df = held.agg(*[F.sum(F.col("h")[k]).alias(f"d{k}") for k in range(len(words))])
    gain = sum((F.col("h")[k] * (F.log(2 / (F.col(f"d{k}") + 0.5)) + 1) for k in range(len(words))), F.lit(0.0))
    return held.crossJoin(F.broadcast(df)).where(F.array_max("h") == 1).select(path, gain.alias("score"))


def by_file(results: DataFrame, path: str = "source_path") -> DataFrame:
    return results.groupBy(path).agg(F.max("score").alias("score"))


def report(metrics: DataFrame) -> DataFrame:
    """Recall by runner and deadline, one column for each deadline (-1: no deadline)."""
    return metrics.groupBy("runner").pivot("deadline_ms", [0, 100, 500, 1000, 5000, -1]).agg(F.first("recall"))


def episodes(examples: DataFrame, stable: int, fresh: int, seed: int = 42) -> DataFrame:
    """Shuffled examples as stable and fresh ones."""
    order = examples.withColumn("_o", F.xxhash64(F.lit(seed), *examples.columns)).orderBy("_o").limit(stable + fresh)
    k = F.row_number().over(Window.orderBy("_o"))
    return order.withColumn("role", F.when(k <= stable, "stable").otherwise("fresh")).drop("_o")
