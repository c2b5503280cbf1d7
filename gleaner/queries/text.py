"""Queries over text: tokens, lines, chunks, windows, snippets, priors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions import text as tx
from gleaner.operators import chunking, lexical, scan
from gleaner.plans.compile import variant_quality
from gleaner.queries.chunks import _chunks_sql
from gleaner.queries.ingest import DOCS
from gleaner.sources.entries import documents

_WORDS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def tokens_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = lexical.postings(documents(spark, sf_dir))
    return table.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def tokens_ident(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("wal_entry_id"), F.col("html").alias("content"))
    return lexical.postings(pages, "ident").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def subtokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", F.array_join(tx.subtokens(F.col("url")), " ").alias("subtokens"))


def subtoken_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words between spaces are counted first, and only different ones are cut into subtokens."""
    words = documents(spark, sf_dir).select(F.explode(F.split("content", r"\s+")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return words.select("n", F.explode(tx.subtoken_text(F.col("w"))).alias("term")).groupBy("term").agg(F.sum("n").alias("cf"))


def dense_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which conversation turns would be searched by vectors."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.select("conv_id", "turn", tx.use_dense(F.col("text")).alias("dense"))


def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunks(documents(spark, sf_dir))


def windows_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("content_type", F.lit("Unknown"))
    return chunking.windows(docs)


def windows_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with each line break doubled, so that lines are paragraphs."""
    docs = documents(spark, sf_dir).withColumn("content", F.regexp_replace("content", "\n", "\n\n")).withColumn("content_type", F.lit("Prose"))
    return chunking.windows(docs)


def windows_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("content", F.regexp_replace("content", "\n", "\n\n")).withColumn("content_type", F.lit("Code"))
    return chunking.windows(docs)


def range_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return docs.select("wal_entry_id", tx.snippet_of_range(F.col("content"), F.lit(2), F.lit(3), F.lit("-")).alias("short"), tx.snippet_of_range(F.col("content"), F.lit(1), F.lit(9), F.lit("-")).alias("long"))


def byte_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text between the first two line breaks, cut out by bytes."""
    docs = documents(spark, sf_dir)
    start, end = tx.line_start(F.col("content"), F.lit(1)), tx.line_start(F.col("content"), F.lit(2)) - 1
    return docs.where(F.size(F.split("content", "\n", -1)) > 2).select("wal_entry_id", start.alias("byte_start"), end.alias("byte_end"), tx.byte_slice(F.col("content"), start, end).alias("slice"))


def first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    line = lexical.first_line_with(F.col("content"), "that the")
    return docs.select("wal_entry_id", (line["k"] + 1).alias("line_number"), line["line"].alias("line"))


def text_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with an address, as text and JSON output with a line of context on either side."""
    docs = documents(spark, sf_dir)
    hits = scan.scan_substring(docs, "@")
    text = F.format_string("[%s] %s:%d:%d-%d:%s", F.lit("scan"), "source_path", "line_number", "byte_start", "byte_end", F.regexp_replace("snippet", "\n", "\\\\n"))
    context = hits.join(docs.select("wal_entry_id", "content"), "wal_entry_id")
    return context.select("wal_entry_id", "line_number", text.alias("text"), tx.context_lines(F.col("content"), F.col("line_number"), F.col("line_number"), 1).alias("context"))


def json_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = scan.scan_substring(documents(spark, sf_dir), "@")
    row = F.struct(F.col("source_path").alias("path"), F.col("line_number").alias("line"), F.lit(0).alias("chunk_id"), F.array("byte_start", "byte_end").alias("byte_range"), F.lit("scan").alias("layer"))
    return hits.select("wal_entry_id", F.to_json(row).alias("json"))


def hit_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines with ``license`` and the chunks that they start in."""
    docs = documents(spark, sf_dir)
    hits = scan.scan_substring(docs, "license").select("wal_entry_id", "line_number", "byte_start", "byte_end")
    return scan.hit_chunks(hits, chunking.chunks(docs.where(F.col("content").contains("license"))))


def variant_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of each part name as a variant, with a prior by its length."""

    @F.pandas_udf(T.DoubleType())
    def quality(names):  # noqa: ANN001, ANN202
        return names.map(lambda n: round(variant_quality(n, 0.002 * len(n), 0.5, True, "_" in n, False), 6))

    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return parts.select("p_partkey", quality("p_name").alias("quality"))


QUERIES = {f.__name__: f for f in (tokens_body, tokens_ident, subtokens, subtoken_counts, dense_gate, chunk_table, windows_fixed, windows_prose, windows_code, range_snippets, byte_slices, first_lines, text_sink, json_sink, hit_chunks, variant_scores)}

_LINES = f"""l AS (SELECT wal_entry_id, source_path, content, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM {DOCS}),
o AS (SELECT *, CAST(coalesce(sum(strlen(line) + 1) OVER (PARTITION BY wal_entry_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a FROM l)"""

ORACLE_SQL = {
    "chunk_table": f"WITH RECURSIVE {_chunks_sql()} SELECT wal_entry_id, source_path, chunk_id, byte_start, byte_end, l1 AS line_start, greatest(l1, l2) AS line_end, text FROM cx",
    "hit_chunks": f"""WITH RECURSIVE {_LINES}, {_chunks_sql()},
        h AS (SELECT wal_entry_id, CAST(n AS INTEGER) AS line_number, a AS byte_start, a + strlen(line) AS byte_end FROM o WHERE contains(line, 'license'))
        SELECT h.wal_entry_id, line_number, h.byte_start, h.byte_end, coalesce(min(chunk_id), 0) AS chunk_id, coalesce(arg_min(cx.byte_start, chunk_id), h.byte_start) AS chunk_start, coalesce(arg_min(cx.byte_end, chunk_id), h.byte_end) AS chunk_end
        FROM h LEFT JOIN cx ON h.wal_entry_id = cx.wal_entry_id AND h.byte_start >= cx.byte_start AND h.byte_start < cx.byte_end GROUP BY h.wal_entry_id, line_number, h.byte_start, h.byte_end""",
    "tokens_body": f"SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM (SELECT doc_id AS id, unnest({_WORDS.format('text')}) AS term FROM documents) GROUP BY term",
    "tokens_ident": r"SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM (SELECT page_id AS id, lower(unnest(regexp_extract_all(html, '[\w:./\\-]+'))) AS term FROM pages) GROUP BY term",
    "subtokens": r"SELECT page_id, array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(url, '([a-z])([A-Z])', '\1_\2', 'g')), '[_\-.:/\\]'), lambda x: x <> ''), ' ') AS subtokens FROM pages",
    "subtoken_counts": r"""
        WITH w AS (SELECT unnest(regexp_split_to_array(text, '[ \t\n\r\f\v]+')) AS w FROM documents),
        t AS (SELECT regexp_replace(w, '^[^A-Za-z0-9_:.]+|[^A-Za-z0-9_:.]+$', '', 'g') AS w FROM w),
        s AS (SELECT lower(w) AS term FROM t WHERE w <> '' UNION ALL
          SELECT unnest(list_filter(regexp_split_to_array(lower(regexp_replace(w, '([a-z])([A-Z])', '\1_\2', 'g')), '[_\-.:/\\]'), lambda x: x <> '')) FROM t WHERE w <> '')
        SELECT term, count(*) AS cf FROM s GROUP BY term""",
    "dense_gate": r"""
        WITH t AS (SELECT *, list_filter(regexp_split_to_array(regexp_replace(text, '[^\p{L}\p{N}]', ' ', 'g'), ' +'), lambda x: x <> '') AS w FROM conversations)
        SELECT conv_id, turn, (len(w) >= 2 AND len(list_filter(w, lambda x: strlen(x) > 4)) > 0)
          OR (regexp_matches(text, '[:._/\-]') AND len(w) >= 2 AND len(list_filter(w, lambda x: strlen(x) >= 3)) > 0) AS dense FROM t""",
    "windows_fixed": """
        WITH w AS (SELECT doc_id AS wal_entry_id, strlen(text) AS n, unnest(range(0, CASE WHEN strlen(text) = 0 THEN 0 ELSE 1 + greatest(CAST(ceil((strlen(text) - 384) / 192.0) AS BIGINT), 0) END)) AS k FROM documents)
        SELECT wal_entry_id, k * 192 AS window_start, least(k * 192 + 384, n) AS window_end FROM w""",
    "windows_prose": f"""WITH {_LINES.replace("strlen(line) + 1", "strlen(line) + 2")},
        p AS (SELECT wal_entry_id, a AS window_start, a + strlen(line) AS window_end FROM o WHERE line <> '')
        SELECT * FROM p""",
    "range_snippets": """
        WITH s AS (SELECT doc_id AS wal_entry_id, string_split(text, chr(10)) AS l FROM documents),
        t AS (SELECT *, array_to_string(l[2:3], chr(10)) AS a, CASE WHEN len(l[1:9]) > 3 THEN coalesce(list_filter(l[1:9], lambda x: trim(x) <> '')[1], '') ELSE array_to_string(l[1:9], chr(10)) END AS b FROM s)
        SELECT wal_entry_id, CASE WHEN trim(a) = '' THEN '-' ELSE a END AS short, CASE WHEN trim(b) = '' THEN '-' ELSE b END AS long FROM t""",
    "byte_slices": f"WITH {_LINES} SELECT wal_entry_id, a AS byte_start, a + strlen(line) AS byte_end, line AS slice FROM o WHERE n = 2 AND len(string_split(content, chr(10))) > 2",
    "first_lines": """
        WITH s AS (SELECT doc_id AS wal_entry_id, string_split(text, chr(10)) AS l FROM documents),
        k AS (SELECT *, list_transform(l, lambda x: contains(x, 'that the')) AS e, list_transform(l, lambda x: contains(x, 'that') OR contains(x, 'the')) AS w FROM s),
        n AS (SELECT *, CASE WHEN list_contains(e, TRUE) THEN list_position(e, TRUE) WHEN list_contains(w, TRUE) THEN list_position(w, TRUE) ELSE 1 END AS i FROM k)
        SELECT wal_entry_id, CAST(i AS INTEGER) AS line_number, l[i] AS line FROM n""",
    "text_sink": f"""WITH {_LINES}
        SELECT wal_entry_id, CAST(n AS INTEGER) AS line_number, '[scan] ' || source_path || ':' || n || ':' || a || '-' || (a + strlen(line)) || ':' || line AS text,
          array_to_string(string_split(content, chr(10))[greatest(n - 1, 1) : n + 1], chr(10)) AS context FROM o WHERE contains(line, '@')""",
    "json_sink": f"""WITH {_LINES}
        SELECT wal_entry_id, '{{"path":"' || source_path || '","line":' || n || ',"chunk_id":0,"byte_range":[' || a || ',' || (a + strlen(line)) || '],"layer":"scan"}}' AS json FROM o WHERE contains(line, '@')""",
    "variant_scores": """
        SELECT p_partkey, round(0.30 + 0.20 * least(1, greatest(0, (strlen(p_name) - 3) / 8.0)) + 0.20 * 0.5 + 0.15 + 0.10 * CAST(contains(p_name, '_') AS INTEGER)
          - 0.20 * least(1, greatest(0, 0.002 * length(p_name) / 0.10)), 6) AS quality FROM part""",
}
