"""The compiler's word lists as columns and small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.plans.lexicon import _SHARE, ALIASES


def shape_share(token: Column) -> Column:
    """How common an unknown word without separators is likely to be, by its letters alone."""
    n = F.octet_length(token)
    by_size = F.when(n <= 2, 0.05).when(n == 3, 0.025).when(n == 4, 0.012).when(n <= 7, 0.006).when(n <= 12, 0.003).otherwise(0.0015)
    hexadecimal = (n >= 8) & token.rlike("^[0-9a-fA-F]+$") & token.rlike("[0-9]")
    return F.when(F.trim(token) == "", 0.20).when(token.rlike("^[0-9]+$"), 0.0015).when(hexadecimal, 0.0008).otherwise(by_size)


def document_share(token: Column) -> Column:
    """The prior share of documents that hold a word in lower case and without separators."""
    known = F.create_map(*[F.lit(x) for pair in _SHARE.items() for x in pair])
    return F.coalesce(F.try_element_at(known, token), shape_share(token))


def alias_table(spark: SparkSession) -> DataFrame:
    """``(term, alias)`` both ways round."""
    pairs = sorted({(a, b) for a, b in ALIASES.items()} | {(b, a) for a, b in ALIASES.items()})
    return spark.createDataFrame(pairs, "term string, alias string")


def strongest(patterns: DataFrame, text: str, weight: str, order: str) -> DataFrame:
    """Of patterns with the same text the first of the greatest weight."""
    rest = [c for c in patterns.columns if c != text]
    best = patterns.groupBy(text).agg(F.min(F.struct((-F.col(weight)).alias("_w"), F.col(order).alias("_o"), *rest)).alias("b"))
    return best.select(text, *[F.col(f"b.{c}").alias(c) for c in rest])
