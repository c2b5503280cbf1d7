"""Mixing sources to target weights that change during training.

A schedule gives each source weights at times from 0 to 1, normalised over the sources at each of
these times and linear in between. The integral of a source's weight times the budget of tokens is the demand for it up
to a time; inverting it at the running sum of the source's tokens gives each document's position.
Since the weights sum to 1, a position is also the share of the budget trained on before it, so
equal ranges of positions hold equal numbers of tokens and need no sampling to sort by.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import col, fresh, written

Schedule = Mapping[str, Sequence[tuple[float, float]]]
#: Times and weights by source; ``*`` stands for the sources that aren't named.
SCHEDULE: Schedule = {
    "*": [(0.0, 1.0), (1.0, 1.0)],
    "src0": [(0.0, 4.0), (0.6, 3.0), (1.0, 1.0)],
    "src1": [(0.0, 0.5), (1.0, 3.0)],
    "src2": [(0.0, 2.0), (0.5, 0.5), (1.0, 0.0)],
}
#: Uses of a document from which a schedule counts as a mistake: a source is far too small for its weight.
MOST_USES = 10_000
#: Each source is summed and ordered in at least so many parts, so that a hot source has as many tasks as there
#: are cores, and in so many more that a part has about ``BUCKET_ROWS`` documents.
BUCKETS = 4096
BUCKET_ROWS = 20_000


def n_tokens(text: Column) -> Column:
    """White-space separated words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("\\S+")), F.lit(0)).cast("long")


def knots(schedule: Schedule, supply: Mapping[str, float], budget: float) -> dict[str, list[tuple[float, float, float]]]:
    """``(time, weight, demand up to then in tokens)`` by source, at all times of the schedule.
    A source that the schedule lacks, as does ``*``, weighs nothing."""
    times = np.array(sorted({0.0, 1.0} | {float(t) for s in supply for t, _ in schedule.get(s, schedule.get("*", ())) if 0 <= t <= 1}))
    raw = {}
    for s in supply:
        points = sorted(schedule.get(s, schedule.get("*", ())))
        if any(w < 0 for _, w in points):
            raise ValueError(f"a weight of {s} is negative")
        raw[s] = np.interp(times, [t for t, _ in points], [w for _, w in points]) if points else np.zeros(len(times))
    total = np.maximum(sum(raw.values(), np.zeros(len(times))), 1e-300)
    out = {}
    for s, w in raw.items():
        w = w / total
        area = np.concatenate([[0], np.cumsum(np.diff(times) * (w[1:] + w[:-1]) / 2)])
        out[s] = list(zip(times.tolist(), w.tolist(), (area * budget).tolist(), strict=True))
    return out


def natural_schedule(supply: Mapping[str, float], documents: Mapping[str, int], tilt: float = 0.5) -> Schedule:
    """Weights whose integral is each source's own share of the tokens, so that every document is
    used once: sources with short documents weigh more at first, those with long ones later."""
    total = sum(supply.values()) or 1.0
    order = sorted(supply, key=lambda s: (supply[s] / max(1, documents[s]), s))
    lean = {s: tilt * (2 * k / max(1, len(order) - 1) - 1) for k, s in enumerate(order)}
    mean = sum(lean[s] * supply[s] for s in supply) / total
    lean = {s: v - mean for s, v in lean.items()}
    most = max(1.0, *(abs(v) for v in lean.values())) if lean else 1.0
    return {s: [(0.0, supply[s] / total * (1 - lean[s] / most)), (1.0, supply[s] / total * (1 + lean[s] / most))] for s in supply}


def _position(demand: Column, curve: Column, budget: float) -> Column:
    """The time at which the demand of a source reaches so many tokens. In a segment that starts at
    weight w with slope s it solves ``w x + s x^2 / 2 = y``."""
    k = F.greatest(F.lit(1), F.least(F.size(curve) - 1, F.size(F.filter(curve, lambda p: p["d"] <= demand))))
    a, b = F.get(curve, k - 1), F.get(curve, k)
    y = (demand - a["d"]) / F.lit(budget)
    slope = (b["w"] - a["w"]) / (b["t"] - a["t"])
    root = a["w"] + F.sqrt(F.greatest(F.lit(0.0), a["w"] * a["w"] + 2 * slope * y))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), a["t"] + F.when(root > 0, 2 * y / root).otherwise(0.0)))


def mix(docs: DataFrame, schedule: Schedule | None = SCHEDULE, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget: int | None = None, max_epochs: int | None = None, buckets: int | None = None, position: str = "position", epoch: str = "epoch") -> DataFrame:
    """``docs`` in training order: sorted by position, over and within partitions.

    Adds the position and the epoch (0 for a document's first use). ``budget`` tokens (by default
    as many as there are) are asked for; a source that has more than its demand loses the rest, in order of a hash of the id,
    and one that has less is used as often as it takes, so every target is met; a source that would take more than ``MOST_USES``
    uses is an error. ``max_epochs`` bounds the uses instead; what sources then lack is in ``shortfall``. ``schedule=None``: ``natural_schedule``.

    Null sources count as the source ''. Null or empty texts have no tokens and stay beside their
    neighbour in the hash order, unless nothing of their source is wanted. Repeated rows are separate documents. Ties in the hash fall to the id,
    then to a hash of the text. An empty table gives an empty one. Long texts are counted whole. Helper columns get names that no column has; columns named
    as the position or the epoch are replaced.

    Running sums are taken in buckets of the hash, and only the buckets' sums are summed over a
    source. The documents are shuffled twice: by bucket, and by position."""
    spark = docs.sparkSession
    buckets = buckets or min(1 << 24, max(BUCKETS, 1 << (docs.count() // BUCKET_ROWS).bit_length()))
    src, order, bucket, tokens, th, base, curve, supply_c, run = fresh(docs, "src", "order", "bucket", "tokens", "th", "base", "curve", "supply", "run")
    rows = docs.withColumns({src: F.coalesce(col(source_col).cast("string"), F.lit("")), order: F.md5(F.coalesce(col(id_col).cast("string"), F.lit(""))), tokens: n_tokens(col(text_col))})
    rows = rows.withColumn(bucket, F.conv(F.substring(order, 1, 6), 16, 10).cast("long") * buckets / F.lit(1 << 24)).withColumn(bucket, F.floor(bucket).cast("int"))
    sums = written(rows.groupBy(src, bucket).agg(F.sum(tokens).alias(tokens), F.count("*").alias("n")), "bucket-sums")
    have = {r[0]: (r[1], r[2]) for r in sums.groupBy(src).agg(F.sum(tokens), F.sum("n")).collect()}
    supply = {s: float(n) for s, (n, _) in have.items()}
    total = float(budget if budget is not None else sum(supply.values())) or 1.0
    curves = knots(natural_schedule(supply, {s: n for s, (_, n) in have.items()}) if schedule is None else schedule, supply, total)
    uses = {s: curves[s][-1][2] / n for s, n in supply.items() if n}
    if max_epochs is None and max(uses.values(), default=0) > MOST_USES:
        raise ValueError(f"sources are too small for their weights: {sorted(s for s, n in uses.items() if n > MOST_USES)}")
    # from Arrow, since a list of rows goes through Python workers of its own, which then stay beside the others
    points = pa.list_(pa.struct([(c, pa.float64()) for c in "twd"]))
    made = [pa.array(list(curves), pa.string()), pa.array([[dict(zip("twd", p, strict=True)) for p in k] for k in curves.values()], points), pa.array([supply[s] for s in curves], pa.float64())]
    plan = spark.createDataFrame(pa.table(made, names=[src, curve, supply_c]))
    before = F.coalesce(F.sum(tokens).over(Window.partitionBy(src).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(src, bucket, before.alias(base)).join(plan, src)
    placed = rows.join(starts, [src, bucket]).withColumn(th, F.xxhash64(col(text_col)))
    within = Window.partitionBy(src, bucket).orderBy(order, col(id_col), th).rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn(run, F.col(base) + F.sum(tokens).over(within) - F.col(tokens) / 2)
    last = F.element_at(F.col(curve), -1)["d"]
    used = (last > 0) | (F.lit(schedule is None) & (F.col(supply_c) == 0))
    most = F.lit(max_epochs - 1) if max_epochs is not None else F.when(F.col(supply_c) > 0, F.ceil(last / F.col(supply_c))).otherwise(0).cast("int")
    epochs = F.filter(F.sequence(F.lit(0), most), lambda e: (F.col(run) + e * F.col(supply_c) <= last * (1 + 1e-9)) & used & ((e == 0) | (F.col(tokens) > 0)))
    placed = placed.withColumn(epoch, F.explode(epochs))
    placed = placed.withColumn(position, _position(F.col(run) + F.col(epoch) * F.col(supply_c), F.col(curve), total))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = placed.select(*[col(c) for c in docs.columns], position, epoch, order)
    ranged = ranged.repartitionById(parts, F.least(F.lit(parts - 1), F.floor(F.col(position) * parts)).cast("int"))
    return ranged.sortWithinPartitions(position, order, col(id_col)).drop(order)


def shortfall(docs: DataFrame, schedule: Schedule = SCHEDULE, text_col: str = "text", source_col: str = "source", budget: int | None = None, max_epochs: int = 1) -> DataFrame:
    """``(source, supply, demand, uses, unmet)`` in tokens: how often each source would have to be used, and what
    of its demand ``max_epochs`` uses leave open. Null sources count as ''. No documents: no rows."""
    rows = docs.select(F.coalesce(col(source_col).cast("string"), F.lit("")).alias("source"), n_tokens(col(text_col)).alias("n"))
    supply = {r[0]: float(r[1]) for r in rows.groupBy("source").agg(F.sum("n")).collect()}
    curves = knots(schedule, supply, float(budget if budget is not None else sum(supply.values())))
    out = [(s, n, curves[s][-1][2], curves[s][-1][2] / n if n else 0.0, max(0.0, curves[s][-1][2] - max_epochs * n)) for s, n in supply.items()]
    return docs.sparkSession.createDataFrame(out, "source string, supply double, demand double, uses double, unmet double")


def op5_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that the schedule uses, in training order."""
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.withColumn("position", F.round("position", 9))


OP5_SQL = r"""
WITH d AS (
  SELECT *, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS tokens, md5(CAST(doc_id AS VARCHAR)) AS o FROM documents),
run AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY o, doc_id ROWS UNBOUNDED PRECEDING) - tokens / 2 AS c,
  sum(tokens) OVER (PARTITION BY source) AS supply, sum(tokens) OVER () AS budget FROM d),
s AS (SELECT DISTINCT source FROM documents),
t(t) AS (VALUES (0.0::DOUBLE), (0.5), (0.6), (1.0)),
raw AS (SELECT source, t, CASE source
    WHEN 'src0' THEN CASE WHEN t <= 0.6 THEN 4 - t / 0.6 ELSE 3 - 2 * (t - 0.6) / 0.4 END
    WHEN 'src1' THEN 0.5 + 2.5 * t
    WHEN 'src2' THEN CASE WHEN t <= 0.5 THEN 2 - 3 * t ELSE 0.5 - (t - 0.5) END
    ELSE 1 END AS w FROM s, t),
norm AS (SELECT source, t, w / sum(w) OVER (PARTITION BY t) AS w FROM raw),
seg AS (SELECT source, t AS t0, w AS w0, lead(t) OVER k AS t1, lead(w) OVER k AS w1 FROM norm WINDOW k AS (PARTITION BY source ORDER BY t)),
area AS (SELECT *, (t1 - t0) * (w0 + w1) / 2 AS a, sum((t1 - t0) * (w0 + w1) / 2) OVER (PARTITION BY source ORDER BY t0) AS upto,
  sum((t1 - t0) * (w0 + w1) / 2) OVER (PARTITION BY source) AS whole FROM seg WHERE t1 IS NOT NULL),
most AS (SELECT source, CASE WHEN min(supply) > 0 THEN CAST(ceil(max(whole) * min(budget) / min(supply)) AS BIGINT) ELSE 0 END AS m FROM area JOIN run USING (source) GROUP BY source),
used AS (SELECT run.*, CAST(e.epoch AS INTEGER) AS epoch, c + e.epoch * supply AS x FROM run JOIN (SELECT source, unnest(range(m + 1)) AS epoch FROM most) e USING (source)
  WHERE e.epoch = 0 OR tokens > 0),
hit AS (SELECT used.*, t0, w0, (w1 - w0) / (t1 - t0) AS slope, (x - (upto - a) * budget) / budget AS y
  FROM used JOIN area USING (source)
  WHERE x <= whole * budget * (1 + 1e-9) AND whole > 0
    AND (x >= (upto - a) * budget OR t0 = 0) AND (x < upto * budget OR t1 = 1))
SELECT doc_id, text, lang, source, n_chars, epoch,
  round(greatest(0, least(1, t0 + CASE WHEN w0 + sqrt(greatest(0, w0 * w0 + 2 * slope * y)) > 0
    THEN 2 * y / (w0 + sqrt(greatest(0, w0 * w0 + 2 * slope * y))) ELSE 0 END)), 9) AS position
FROM hit
"""
