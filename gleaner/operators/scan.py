"""Scans of entries without any index: substring, regular expression, query words.

All return ``(wal_entry_id, source_path, line_number, byte_start, byte_end, snippet, score)``, one
row for each matching line. Entries are filtered by the same test before lines are looked at, which
reaches the Parquet scan for literals.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import line_start, matching_lines

HITS = ["wal_entry_id", "source_path", "line_number", "byte_start", "byte_end", "snippet", "score"]


def _hits(entries: DataFrame, whole: Column, matches: "callable") -> DataFrame:
    found = entries.where(whole).select("wal_entry_id", "source_path", "content", matching_lines(F.col("content"), matches).alias("hits"))
    placed = F.transform("hits", lambda x: F.struct(x["line_index"].alias("k"), x["line"].alias("line"), line_start(F.col("content"), x["line_index"]).alias("at"), x["bytes"].alias("n")))
    rows = found.select("wal_entry_id", "source_path", F.explode(placed).alias("h"))
    return rows.select("wal_entry_id", "source_path", (F.col("h.k") + 1).cast("int").alias("line_number"), F.col("h.at").alias("byte_start"), (F.col("h.at") + F.col("h.n")).alias("byte_end"), F.col("h.line").alias("snippet"), F.lit(1.0).alias("score"))


def scan_substring(entries: DataFrame, needle: str) -> DataFrame:
    """Lines that hold the needle, case and all. An empty needle finds nothing. Of a needle of
    several lines the line that holds its start is found."""
    if not needle:
        return _hits(entries, F.lit(False), lambda line: F.lit(False))
    if "\n" not in needle:
        return _hits(entries, F.col("content").contains(needle), lambda line: line.contains(needle))
    starts = F.col("content").contains(needle)
    n = F.lit(needle.count("\n"))
    split = F.split("content", "\n", -1)
    numbered = F.transform(split, lambda line, k: F.struct(k.alias("k"), line.alias("line"), F.array_join(F.slice(split, k + 1, n + 1), "\n").alias("run")))
    found = entries.where(starts).select("wal_entry_id", "source_path", "content", F.explode(F.filter(numbered, lambda x: x["run"].contains(needle))).alias("h"))
    at = line_start(F.col("content"), F.col("h.k"))
    return found.select("wal_entry_id", "source_path", (F.col("h.k") + 1).cast("int").alias("line_number"), at.alias("byte_start"), (at + F.octet_length("h.line")).alias("byte_end"), F.regexp_replace("h.line", "\r$", "").alias("snippet"), F.lit(1.0).alias("score"))


def scan_regex(entries: DataFrame, pattern: str) -> DataFrame:
    """Lines in which a match of the pattern starts. Anchors mean the whole entry and the dot no
    line break, so a pattern with an anchor, a line break or a class that may hold one is matched against the entry, in Arrow
    batches; all others line by line with built-in functions."""
    if not re.search(r"[\^$]|\\[nsSRAzZvWDB]|\[\^|\(\?|\n", pattern):
        return _hits(entries, F.col("content").rlike(pattern), lambda line: line.rlike(pattern))

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = re.compile(pattern)
        for pdf in it:
            out = []
            for entry, path, content in pdf.itertuples(index=False):
                seen = -1
                for m in found.finditer(content or ""):
                    start = content.rfind("\n", 0, m.start()) + 1
                    if start != seen:
                        seen = start
                        end = content.find("\n", start)
                        line = content[start : end if end >= 0 else len(content)]
                        b = len(content[:start].encode())
                        out.append((entry, path, content.count("\n", 0, start) + 1, b, b + len(line.encode()), line.removesuffix("\r"), 1.0))
            yield pd.DataFrame(out, columns=HITS)

    schema = "wal_entry_id bigint, source_path string, line_number int, byte_start bigint, byte_end bigint, snippet string, score double"
    return entries.select("wal_entry_id", "source_path", "content").mapInPandas(batches, schema)


def scan_query(entries: DataFrame, query: str) -> DataFrame:
    """Lines with the whole query; if there are none, lines with any of its words, scored by the
    number of words of the query (repeated ones too) that they hold."""
    exact = scan_substring(entries, query)
    words = query.split()
    if len(words) < 2 or not exact.isEmpty():
        return exact
    any_word = lambda text: F.greatest(*[text.contains(w) for w in words], F.lit(False))
    hits = _hits(entries, any_word(F.col("content")), any_word)
    score = sum((F.col("snippet").contains(w).cast("double") for w in words), F.lit(0.0))
    return hits.withColumn("score", score)


def hit_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """``hits`` with the first chunk that holds their byte, or chunk 0 and their own range."""
    c = chunks.select(F.col("wal_entry_id").alias("_e"), F.col("chunk_id").alias("_c"), F.col("byte_start").alias("_a"), F.col("byte_end").alias("_b"))
    joined = hits.join(c, (F.col("wal_entry_id") == F.col("_e")) & (F.col("byte_start") >= F.col("_a")) & (F.col("byte_start") < F.col("_b")), "left")
    first = joined.groupBy(*hits.columns).agg(F.min(F.struct("_c", "_a", "_b")).alias("_m"))
    return first.select(*hits.columns, F.coalesce("_m._c", F.lit(0)).alias("chunk_id"), F.coalesce("_m._a", "byte_start").alias("chunk_start"), F.coalesce("_m._b", "byte_end").alias("chunk_end"))
