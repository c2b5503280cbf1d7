"""Queries of the benchmark: metrics, percentiles, deadlines, baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.operators import evaluate
from gleaner.sources.entries import documents


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders by price are an episode's hits; its urgent ones are relevant."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return orders.select(F.col("o_custkey").alias("episode"), F.col("o_orderkey").alias("path"), rank.alias("rank"), (F.col("o_orderpriority") == "1-URGENT").alias("good"), F.col("o_totalprice").alias("latency_ms"))


def eval_recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(spark, sf_dir)
    out = evaluate.recall_hit_mrr(hits, hits.where("good"), 5)
    return out.withColumns({"recall": F.round("recall", 6), "mrr": F.round("mrr", 6)})


def eval_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = items.select("l_returnflag", "l_linestatus", F.col("l_discount").alias("recall"), (F.col("l_quantity") > 25).alias("hit"), F.col("l_tax").alias("mrr"), F.col("l_extendedprice").alias("latency_ms"))
    out = evaluate.aggregate_metrics(rows, ["l_returnflag", "l_linestatus"])
    return out.withColumns({c: F.round(c, 6) for c in ("recall", "hit_rate", "mrr")})


def semantic_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes that find nothing among their first hits, with all their hits."""
    hits = _hits(spark, sf_dir)
    missed = evaluate.recall_hit_mrr(hits, hits.where("good"), 1)
    return evaluate.hard_subset(hits.select("episode", "path"), missed)


def zero_prep_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recall of the first hit against that of the first ten."""
    hits = _hits(spark, sf_dir)
    a, b = (evaluate.recall_hit_mrr(hits, hits.where("good"), k).select("episode", F.col("recall").alias(f"r{k}")) for k in (1, 10))
    return a.join(b, "episode").select("episode", F.round(evaluate.retention(F.col("r1"), F.col("r10")), 6).alias("retention"), F.round(F.col("r10") - F.col("r1"), 6).alias("lift"))


def deadline_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits that came in time, for a deadline by the kind of event."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    deadline = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 50)
    rows = events.select("event_id", "event_type", F.col("value").alias("latency_ms"), deadline.alias("deadline_ms"))
    return evaluate.within_deadline(rows).groupBy("event_type").agg(F.count("*").alias("n"))


def token_idf_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.token_idf_rank(documents(spark, sf_dir), ["license", "Mail", "of", "idiot", "token"]).withColumn("score", F.round("score", 6))


def results_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return evaluate.by_file(items.select(F.col("l_partkey").alias("source_path"), F.col("l_extendedprice").alias("score")))


QUERIES = {f.__name__: f for f in (eval_recall_mrr, eval_percentiles, semantic_hard, zero_prep_retention, deadline_cutoff, token_idf_rank, results_by_file)}

_H = "h AS (SELECT o_custkey AS episode, o_orderkey AS path, o_orderpriority = '1-URGENT' AS good, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)"


def _recall(k: int) -> str:
    return f"SELECT episode, count(*) FILTER (good AND rank <= {k}) / greatest(count(*) FILTER (good), 1) AS recall, count(*) FILTER (good AND rank <= {k}) > 0 AS hit, coalesce(1.0 / min(rank) FILTER (good AND rank <= {k}), 0) AS mrr FROM h GROUP BY episode"


ORACLE_SQL = {
    "eval_recall_mrr": f"WITH {_H} SELECT episode, round(recall, 6) AS recall, hit, CAST(round(mrr, 6) AS DOUBLE) AS mrr FROM ({_recall(5)})",
    "eval_percentiles": """
        SELECT l_returnflag, l_linestatus, round(avg(l_discount), 6) AS recall, round(avg(CAST(l_quantity > 25 AS DOUBLE)), 6) AS hit_rate, round(avg(l_tax), 6) AS mrr,
          any_value(x.p[(len(x.p) - 1) * 50 // 100 + 1]) AS p50, any_value(x.p[(len(x.p) - 1) * 95 // 100 + 1]) AS p95
        FROM lineitem JOIN (SELECT l_returnflag, l_linestatus, list_sort(list(l_extendedprice)) AS p FROM lineitem GROUP BY ALL) x USING (l_returnflag, l_linestatus) GROUP BY ALL""",
    "semantic_hard": f"WITH {_H} SELECT episode, path FROM h WHERE episode IN (SELECT episode FROM ({_recall(1)}) WHERE NOT hit)",
    "zero_prep_retention": f"WITH {_H}, a AS ({_recall(1)}), b AS ({_recall(10)}) SELECT episode, round(CASE WHEN b.recall < 1e-6 THEN 0 ELSE a.recall / b.recall END, 6) AS retention, round(b.recall - a.recall, 6) AS lift FROM a JOIN b USING (episode)",
    "deadline_cutoff": "SELECT event_type, count(*) AS n FROM events WHERE event_type <> 'view' OR value <= 50 GROUP BY 1",
    "token_idf_rank": "WITH t AS (SELECT concat_ws('/', source, lang, doc_id || '.txt') AS source_path, w, contains(lower(text), w) AS held FROM documents, (VALUES ('license'), ('mail'), ('idiot'), ('token')) v(w)), d AS (SELECT *, sum(CAST(held AS INTEGER)) OVER (PARTITION BY w) AS df FROM t) SELECT source_path, round(sum(ln(2 / (df + 0.5)) + 1), 6) AS score FROM d WHERE held GROUP BY 1",
    "results_by_file": "SELECT l_partkey AS source_path, max(l_extendedprice) AS score FROM lineitem GROUP BY 1",
}
